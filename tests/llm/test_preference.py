from tablescope.llm import preference
from tablescope.llm.queries import QUERIES


def rendered(turns):
    out, mask = "", []
    for _, role, text in turns:
        out += f"<|im_start|>{role}\n"
        if role == "assistant":
            mask.append((len(out), len(out) + len(text) + len("<|im_end|>")))
        out += f"{text}<|im_end|>\n"
    return out, mask


def brute(chosen, rejected):
    pairs = {p for p, *_ in chosen} | {p for p, *_ in rejected}
    out = {}
    for p in pairs:
        c, r = (sorted((t if t is not None else 1 << 63, ro or "", x or "") for q, t, ro, x in s if q == p) for s in (chosen, rejected))
        n = 0
        while n < min(len(c), len(r)) and c[n] == r[n]:
            n += 1
        (a, am), (b, bm) = rendered(c[n:]), rendered(r[n:])
        out[p] = (n, rendered(c[:n])[0], a, b, am, bm)
    return out


def collected(df):
    return {r.pair_id: (r.n_common, r.prompt, r.chosen, r.rejected, [tuple(x) for x in r.chosen_mask], [tuple(x) for x in r.rejected_mask])
            for r in df.collect()}


def test_pairs_and_edges(spark):
    c = [(1, 0, "user", "hi"), (1, 1, "assistant", "éa"), (1, 2, "user", "more"), (1, 3, "assistant", "good"),
         (2, 0, "user", "same"), (2, 1, "assistant", "same"), (3, 0, None, None), (3, None, "assistant", "late"), (4, 0, "user", "only chosen"),
         (None, 0, "user", "q"), (6, 1, "user", "b"), (6, 1, "user", "a"), (6, 1, "user", "a"), (7, 0, "user", "x" * 50_000), (8, 0, "user", "")]
    r = [(1, 0, "user", "hi"), (1, 1, "assistant", "éa"), (1, 2, "user", "other"), (1, 3, "assistant", "bad"), (1, 4, "assistant", ""),
         (2, 0, "user", "same"), (2, 1, "assistant", "same"), (3, 0, None, None), (5, 0, "assistant", "only rejected"),
         (None, 0, "user", "z"), (6, 1, "user", "a"), (6, 1, "user", "b"), (7, 0, "user", "x" * 50_000), (7, 1, "assistant", "y"), (8, 0, "system", "")]
    schema = "pair_id long, turn long, role string, text string"
    got = collected(preference.format_pairs(spark.createDataFrame([(*x, 1) for x in c], schema + ", side int").repartition(3),
                                            spark.createDataFrame([(*x, 1) for x in r], schema + ", c int").repartition(3)))
    assert got == brute(c, r)
    assert got[1][0] == 2 and got[2][2] == got[2][3] == ""
    empty = spark.createDataFrame([], schema)
    assert preference.format_pairs(empty, empty).count() == 0


def test_query(spark, sf, tables):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in tables("conversations")]
    chosen, rejected = [], []
    for p in {r[0] for r in rows}:
        own = sorted(r for r in rows if r[0] == p)
        replies = [r for r in own if r[2] == "assistant"]
        if replies:
            last = replies[-1]
            upto = [r for r in own if r[1] <= last[1]]
            chosen += upto
            other = replies[0][3] if len(replies) > 1 else ""
            rejected += [(*r[:3], other) if r == last else r for r in upto]
    want = brute(chosen, rejected)
    got = {r["pair_id"]: r for r in QUERIES["op9_preference_formatting"](spark, sf).collect()}
    assert set(got) == set(want)
    for p, (n, prompt, c, r, cm, rm) in want.items():
        g = got[p]
        assert (g["n_common"], g["prompt"], g["chosen"], g["rejected"]) == (n, prompt, c, r)
        assert (g["chosen_mask"], g["rejected_mask"]) == tuple(",".join(f"{a}-{b}" for a, b in m) for m in (cm, rm))


def test_swapped_keeps_null_turns_and_ids(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, None, "assistant", "late"), (None, 0, "user", "x"), (None, 1, "assistant", "y"),
            (None, 2, "user", "z"), (None, 3, "assistant", "w"), (None, 4, "user", "after"), (2, 0, "user", "no reply"), (3, None, "assistant", "alone")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(3)
    chosen, rejected = (sorted(map(tuple, x.collect()), key=str) for x in preference.last_reply_swapped(df))
    kept = [r for r in rows if r[0] != 2 and r[3] != "after"]
    assert chosen == sorted(kept, key=str)
    other = {"late": "a", "w": "y", "alone": ""}
    assert rejected == sorted(((*r[:3], other.get(r[3], r[3])) for r in kept), key=str)
