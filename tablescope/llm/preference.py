"""Preference formatting: common turn prefix once as prompt, paired masked completions.

A pair is two conversations, chosen and rejected, under one pair id. Their turns are ordered; the
longest run of equal leading turns (role and text) is rendered once as the prompt, what
follows on each side is its completion. The mask lists the character ranges of the
completion that are learnt: the text and end mark of assistant turns. One shuffle on the pair
id brings a pair together; everything after it is array expressions in the JVM.

A pair is one training example and so one row, as long as its own turns. A third of
all rows under one pair id is one such example; the number of pairs with the same turns does
not matter, since nothing is grouped by content.

Defined results: turns are ordered by (turn, role, text), a null turn number last; null
roles and texts are empty; turns that repeat a number stay, in that order; a pair with one side only has an empty other
side and no common prefix; equal sides have empty completions; rows with a null pair id are
one pair. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ChatML turn marks and the role whose words are learnt.
START, END = "<|im_start|>", "<|im_end|>"
LEARNT = "assistant"


def _turns(df: DataFrame, side: str, pair: str) -> DataFrame:
    def text(c):
        return F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    turn = F.struct(F.coalesce(F.col("turn").cast("long"), F.lit((1 << 63) - 1)).alias("turn"), text("role"), text("text"))
    return df.select(F.col(f"`{pair}`").alias("pair_id"), F.lit(side).alias("side"), turn.alias("t"))


def render(turns):
    """Turns (array of role, text structs) as ChatML strings."""
    return F.transform(turns, lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(END + "\n")))


def learnt_ranges(turns):
    """[start, end) character ranges of assistant words in the rendered turns."""
    head = len(START) + 1
    tail = len(END)
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("out"))

    def step(acc, t):
        begin = acc["at"] + F.length(t["role"]) + head
        end = begin + F.length(t["text"]) + tail
        span = F.struct(begin.alias("s"), end.alias("e"))
        out = F.when(t["role"] == LEARNT, F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
        return F.struct((end + 1).alias("at"), out.alias("out"))
    return F.aggregate(turns, state, step, lambda acc: acc["out"])


def format_pairs(chosen: DataFrame, rejected: DataFrame, pair: str = "pair_id") -> DataFrame:
    """pair_id, n_common, prompt, chosen, rejected (text), chosen_mask, rejected_mask (ranges)."""
    both = _turns(chosen, "c", pair).unionByName(_turns(rejected, "r", pair))

    def side(name):
        return F.array_sort(F.collect_list(F.when(F.col("side") == name, F.col("t")))).alias(name)
    sides = both.groupBy("pair_id").agg(side("c"), side("r"))
    # equal leading turns: the position of the first difference among the shared positions
    same = F.zip_with(F.slice("c", 1, F.least(F.size("c"), F.size("r"))), F.slice("r", 1, F.least(F.size("c"), F.size("r"))),
                      lambda a, b: a.eqNullSafe(b))
    differs = F.array_position(same, False)
    n = F.when(differs > 0, differs - 1).otherwise(F.size(same)).cast("int")
    out = sides.withColumn("n_common", n)

    def rest(name):
        return F.slice(name, F.col("n_common") + 1, F.size(name))
    return out.select(
        "pair_id", "n_common", F.array_join(render(F.slice("c", 1, F.col("n_common"))), "").alias("prompt"),
        F.array_join(render(rest("c")), "").alias("chosen"), F.array_join(render(rest("r")), "").alias("rejected"),
        learnt_ranges(rest("c")).alias("chosen_mask"), learnt_ranges(rest("r")).alias("rejected_mask"))


def last_reply_swapped(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chosen, rejected) turns from plain conversations: the rejected side ends at the last
    assistant turn and gives the first assistant reply of the conversation there (an empty one if there is no
    other). Turns are ordered as in ``format_pairs``: null turn numbers last, rows with a null id one conversation.

    Left out, as they hold nothing to choose between: conversations without an assistant turn, and the turns
    after the last assistant turn."""
    rows = conversations.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text",
                                F.coalesce(F.col("turn").cast("long"), F.lit((1 << 63) - 1)).alias("at"))
    reply = F.when(F.col("role") == LEARNT, F.struct("at", "text"))
    ends = (rows.groupBy("pair_id").agg(F.max(reply).alias("last"), F.min(reply).alias("first"))
            .filter("last is not null").withColumnRenamed("pair_id", "id"))
    turns = rows.join(ends, F.col("pair_id").eqNullSafe(F.col("id"))).filter(F.col("at") <= F.col("last.at"))
    swapped = F.when((F.col("role") == LEARNT) & (F.col("at") == F.col("last.at")),
                     F.when(F.col("first.at") < F.col("last.at"), F.col("first.text")).otherwise(F.lit(""))).otherwise(F.col("text"))
    return turns.select("pair_id", "turn", "role", "text"), turns.select("pair_id", "turn", "role", swapped.alias("text"))
