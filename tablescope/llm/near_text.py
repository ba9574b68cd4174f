"""MinHash near-dedup by Order MinHash, verified by banded alignment.

A text is the sequence of its five-word shingles, each labelled with its occurrence number, so
a sketch sees repetitions. One sketch is the ``PICK`` shingles with the smallest hashes, kept
in text order: it agrees for two texts when the same shingles survive in the same order, which
follows edit similarity rather than set overlap. Two texts are near copies when their edit
similarity, 1 - (word edits) / (words of the longer text), is at least ``threshold``. Steps:

1. exact copies collapse by digest; one text of each class goes on;
2. texts that share a sketch meet in a bucket. A bucket elects a leader by hash, and every member
   is compared with it: *linked* (similar enough), *near* (more than the allowed share of
   edits, at most half of the longer text) or *far* (more than half);
3. linked members are in the leader's component and leave the bucket. A far member can't be
   similar to a linked one: word edits are a metric, so it is more than half minus a fifth away, lengths
   within the threshold included (see ``far_share``). Near and far ones elect the next leader as long as
   leaders link at least a quarter of their bucket, until all pairs of what is left are fewer than its rows, or
   ``ROUNDS`` times. Then the links so far
   give components, and only what they leave apart is compared: near members with the linked
   members of their star, and the members left over with each other. They are joined by their rarest words
   (``prefix_pairs``): similar texts share one of them, texts that merely hold the same passage don't. So a large
   group of copies costs a few stars and not all its pairs, a common passage costs its holders' own words,
   and no link between different components is lost;
4. a pair is verified by aligning the two word sequences inside a diagonal band as wide as the
   edits that the threshold allows, so the band excludes no pair that would pass; the distance is exact
   up to there. The band is a bit vector, one column a step;
5. connected components give the groups; the smallest id of a group is kept.

With 40 sketches of 3 shingles, a pair that shares a part J of its labelled shingles in order is
met with probability 1 - (1 - J^3)^40: 1 - 10^-12 at 0.8, 0.9999 at 0.6, 0.995 at 0.5, 0.93 at 0.4.
One changed word costs up to five shingles, so J = 0.5 is about one edit in 15 words, and J = 0.8
(the library's rule for word shingles) one in 45. With substitutions at random on a share p of the words, J is about
q / (2 - q) with q = (1 - p)^5; by these formulas (computed, not measured) a pair is missed with probability 0.23 at edit
similarity 0.87 (J 0.33), 0.39 at 0.85 (J 0.29), 0.62 at 0.82 (J 0.23) and 0.74 at 0.80 (J 0.20), unless other members link it. Pairs that are similar by edits but whose edits are
spread so evenly that J is lower are found less often; links are exact in any case.

Defined results: texts without words (null, empty) link with nothing; a text of fewer than
five words has one shingle, all its words; a null id links with nothing and is kept; rows that share an id are one
document and share its group. Only id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablescope.llm.components import components
from tablescope.llm.text import iter_words, mix, shingle_hash
from tablescope.session import discard, materialize

SHINGLE = 5
SKETCHES = 40
PICK = 3
THRESHOLD = 0.8
ROUNDS = 6
USEFUL = 0.25                # a bucket whose leader links a smaller share of its members elects no further one
BAG = 64                     # slots of a text's word-count signature
BEFORE = 16                  # rarer words of its text that a word of a prefix brings along
# Let L be a leader, y linked to it and x with d(x, L) > far_share * max(|x|, |L|). At threshold 0.8: d(y, L) <=
# 0.2 max(|y|, |L|) <= 0.25 |L|, and x ~ y would mean d(x, y) <= 0.2 max(|x|, |y|) <= 0.25 max(|x|, |L|);
# together d(x, L) <= 0.5 max(|x|, |L|). For a threshold t the same sum is 2 (1 - t) / t.
def far_share(threshold: float) -> float:
    return 2 * (1 - threshold) / threshold


_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
_LABEL = np.uint64(0xA24BAED4963EE407)


def labelled_shingles(words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(bounds per text, labelled shingle hashes in text order) of a group of texts."""
    n_words = np.diff(words.bounds())
    at, value = words.shingles(k)
    doc = words.doc[at]
    short = np.flatnonzero((n_words > 0) & (n_words < k))
    if len(short):
        start = words.bounds()[short]
        whole = np.concatenate([shingle_hash(words.hash, start[n_words[short] == n], n) for n in range(1, k)])
        owner = np.concatenate([short[n_words[short] == n] for n in range(1, k)])
        value, doc = np.concatenate((value, whole)), np.concatenate((doc, owner))
        order = np.argsort(doc, kind="stable")
        value, doc = value[order], doc[order]
    label, _ = _occurrences(doc, value)
    return np.searchsorted(doc, np.arange(words.n_docs + 1)), mix(value + label.astype(np.uint64) * _LABEL)


def _occurrences(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each value came before, and comes after, in its own text; ``doc`` ascends."""
    order = np.lexsort((value, doc))                  # stable: equal values stay in text order
    same = np.concatenate(([False], (value[order][1:] == value[order][:-1]) & (doc[order][1:] == doc[order][:-1])))[:len(order)]
    run = np.arange(len(order))
    label = run - np.maximum.accumulate(np.where(same, 0, run))
    group = np.cumsum(~same) - 1
    before, after = np.empty_like(run), np.empty_like(run)
    before[order], after[order] = label, np.bincount(group)[group] - 1 - label
    return before, after


def order_sketches(bounds: np.ndarray, value: np.ndarray, sketches: int, pick: int) -> np.ndarray:
    """(texts, sketches) int64; a text of fewer than ``pick`` shingles sketches its whole sequence."""
    size = np.diff(bounds)
    out = np.zeros((len(size), sketches), dtype=np.uint64)
    for d in np.flatnonzero((size > 0) & (size < pick)):
        out[d] = shingle_hash(value[bounds[d]:bounds[d + 1]], np.array([0]), int(size[d]))[0]
    long = np.flatnonzero(size >= pick)
    if len(long):
        member = np.repeat(size >= pick, size)
        own, n = value[member], size[long]
        start = np.cumsum(n) - n
        for s in range(sketches):
            v = mix(own ^ mix(np.full(1, s + 1, dtype=np.uint64))[0])
            best = np.empty((pick, len(long)), dtype=np.int64)
            for p in range(pick):
                low = np.minimum.reduceat(v, start)
                at = np.flatnonzero(v == np.repeat(low, n))
                owner = np.searchsorted(start, at, side="right") - 1
                best[p, owner[::-1]] = at[::-1]       # the first of equals
                v[best[p]] = _TOP
            picked = own[np.sort(best, axis=0)]
            h = np.full(len(long), s + 1, dtype=np.uint64)
            for p in range(pick):
                h = mix(h ^ picked[p]) + np.uint64(p)
            out[long, s] = h
    return out.view(np.int64)


def edit_distance(a: list, b: list, most: int) -> int:
    """Levenshtein distance of two sequences, or ``most + 1`` when it is larger.

    Column by column over b, the cells |row - column| <= most as bits of two integers (vertical
    steps +1 and -1); cells outside the band count as reached by plain insertions.
    """
    lo = 0
    while lo < len(a) and lo < len(b) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < len(a) - lo and hi < len(b) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo:len(a) - hi], b[lo:len(b) - hi]
    m, n = len(a), len(b)
    if abs(m - n) > most:
        return most + 1
    if not m or not n:
        return max(m, n)
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    base, height = 0, min(m, most)               # rows base + 1 .. base + height
    plus, minus, score = (1 << height) - 1, 0, height
    for j, x in enumerate(b, 1):
        if base + height < min(m, j + most):     # one more row at the lower end
            plus |= 1 << height
            height, score = height + 1, score + 1
        if base + 1 < j - most:                  # the uppermost row leaves the band
            plus, minus, base, height = plus >> 1, minus >> 1, base + 1, height - 1
        full = (1 << height) - 1
        eq = (where.get(x, 0) >> base & full) | minus
        diagonal = (((eq & plus) + plus) ^ plus) | eq
        right_up = minus | ~(diagonal | plus) & full
        right_down = diagonal & plus & full
        last = 1 << (height - 1)
        if right_up & last:
            score += 1
        elif right_down & last:
            score -= 1
        right_up, right_down = (right_up << 1 | 1) & full, right_down << 1 & full
        plus, minus = right_down | ~(diagonal | right_up) & full, right_up & diagonal & full
    return min(score, most + 1)


def compare(a: np.ndarray, b: np.ndarray, share: float) -> float:
    """Word edits as a share of the longer text, when at most ``share``; else 2."""
    longer = max(len(a), len(b))
    if not len(a) or not len(b):
        return 2.0
    most = int(share * longer + 1e-9)
    if longer - min(len(a), len(b)) > most:
        return 2.0
    # A text d edits away shares all but d of its words: a cheap test that loses nothing.
    words, side = np.unique(np.concatenate((a, b)), return_inverse=True)
    common = np.minimum(np.bincount(side[:len(a)], minlength=len(words)), np.bincount(side[len(a):], minlength=len(words))).sum()
    if longer - common > most:
        return 2.0
    edits = edit_distance(side[:len(a)].tolist(), side[len(a):].tolist(), most)
    return edits / longer if edits <= most else 2.0


def _sketch(k: int, sketches: int, pick: int):
    def run(batches):
        for b in batches:
            for w in iter_words(b.column("text")):
                bounds, value = labelled_shingles(w, k)
                found = order_sketches(bounds, value, sketches, pick)
                rows = slice(w.first, w.first + w.n_docs)
                size = np.diff(bounds)
                cut = (np.concatenate(([0], np.cumsum(size > 0))) * sketches).astype(np.int32)
                bag = np.bincount(w.doc * BAG + (w.hash & np.uint64(BAG - 1)).astype(np.int64), minlength=w.n_docs * BAG)
                bag_cut = (np.arange(w.n_docs + 1) * BAG).astype(np.int32)
                yield pa.record_batch({
                    **{c: b.column(c)[rows] for c in ("digest", "did", "doc")}, "n": pa.array(np.diff(w.bounds()).astype(np.int32)),
                    "sketch": pa.ListArray.from_arrays(cut, pa.array(found[size > 0].ravel())),
                    "bag": pa.ListArray.from_arrays(bag_cut, pa.array(bag.astype(np.int32)))})
    return run


def _verify(threshold: float, share: float):
    def sequences(column):
        for w in iter_words(column):
            bounds = w.bounds()
            yield from (w.hash[bounds[i]:bounds[i + 1]] for i in range(w.n_docs))

    def run(batches):
        for b in batches:
            found = np.array([compare(x, y, share)
                              for x, y in zip(sequences(b.column("text_a")), sequences(b.column("text_b")), strict=True)])
            kind = np.where(found <= 1 - threshold + 1e-9, LINKED, np.where(found <= share, NEAR, FAR)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(kind)], ["a", "b", "kind"])
    return run


LINKED, NEAR, FAR = 0, 1, 2


def _compared(pairs: DataFrame, texts: DataFrame, threshold: float, share: float) -> DataFrame:
    """(a, b, kind) of every pair; ``texts`` holds (doc, text) of the class representatives."""
    left = pairs.join(texts.select(F.col("doc").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("doc").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_verify(threshold, share), "a long, b long, kind int")


def bucket_links(members: DataFrame, texts: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """(a, b): enough verified links to connect every pair of similar members of a bucket.

    ``members`` has band, key, doc and n (words), one row per member of a bucket; ``bags`` has doc and
    bag, the counts of its words by hash slot."""
    spark = members.sparkSession
    links = spark.createDataFrame([], "a long, b long")
    stars = spark.createDataFrame([], "r int, band int, key long, doc long, n int, leader long, kind int")
    rest, done = members, members.limit(0)
    for r in range(ROUNDS):
        sizes = rest.groupBy("band", "key").agg(F.count("*").alias("c"))
        pairs, rows = sizes.agg(F.sum(F.expr("c * (c - 1) / 2")), F.sum("c")).first()
        if (pairs or 0) <= (rows or 0):
            break
        # the smallest id first (an original as a rule), then by hash
        rank = F.col("doc") if r == 0 else F.xxhash64(F.lit(r), "doc")
        leader = (rest.groupBy("band", "key").agg(F.min(F.struct(rank.alias("h"), "doc")).alias("l"))
                  .select("band", "key", F.col("l.doc").alias("leader")))
        star = materialize(rest.join(leader, ["band", "key"]).filter("doc <> leader")
                           .withColumns({"a": F.least("doc", "leader"), "b": F.greatest("doc", "leader")}), "near-star")
        kinds = materialize(_compared(star.select("a", "b").distinct(), texts, threshold, far_share(threshold)), "near-kinds")
        links = links.union(kinds.filter(F.col("kind") == LINKED).select("a", "b"))
        star = materialize(star.join(kinds, ["a", "b"]).select(F.lit(r).alias("r"), *stars.columns[1:]), "near-star")
        stars = stars.union(star)
        unlinked = star.filter(F.col("kind") != LINKED).select("band", "key", "doc", "n")
        useful = (star.groupBy("band", "key").agg(F.avg((F.col("kind") == LINKED).cast("int")).alias("share"))
                  .filter(F.col("share") >= USEFUL).select("band", "key"))
        rest = unlinked.join(useful, ["band", "key"], "left_semi")
        done = done.union(unlinked.join(useful, ["band", "key"], "left_anti"))
    rest = rest.union(done)

    # What is still to be compared: near members with linked ones, and the remaining members with each
    # other, as far as the links found so far have not put them into one component.
    group = materialize(components(links), "near-groups")

    def placed(frame, doc, name):
        own = group.select(F.col("id").alias(doc), F.col("component").alias(name))
        return frame.join(own, doc, "left").withColumn(name, F.coalesce(name, doc))

    near = materialize(placed(placed(stars.filter(F.col("kind") == NEAR), "doc", "g"), "leader", "lead").filter("g <> lead")
                       .select("r", "band", "key", "doc"), "near-open")
    close = stars.filter(F.col("kind") == LINKED).join(near.select("r", "band", "key").distinct(), ["r", "band", "key"], "left_semi")
    open_ = (rest.select("doc", F.lit(1).alias("active")).union(near.select("doc", F.lit(1)))
             .union(close.select("doc", F.lit(0))).groupBy("doc").agg(F.max("active").alias("active")))
    found = _compared(prefix_pairs(texts, placed(open_, "doc", "g"), bags, threshold), texts, threshold, 1 - threshold)
    return links.union(found.filter(F.col("kind") == LINKED).select("a", "b"))


def _tokens(batches):
    """A row per word of each text: the word labelled with its occurrence, how often it came before (``nth``) and comes
    after (``left``), and the number of words."""
    for b in batches:
        for w in iter_words(b.column("text")):
            at, value = w.shingles(1)
            nth, left = _occurrences(w.doc[at], value)
            size = np.diff(w.bounds())
            rows = pa.array(np.repeat(np.arange(w.first, w.first + w.n_docs), size))
            yield pa.record_batch({**{c: b.column(c).take(rows) for c in ("doc", "did", "g", "active")},
                                   "n": pa.array(np.repeat(size, size).astype(np.int32)), "nth": pa.array(nth.astype(np.int32)),
                                   "left": pa.array(left.astype(np.int32)),
                                   "token": pa.array(mix(value + nth.astype(np.uint64) * _LABEL).view(np.int64))})


def first_shared(prefix: DataFrame, threshold: float) -> DataFrame:
    """(doc, doc2, longer): a row for the first word that two prefixes share, and few for further ones.

    The first one is the last occurrence of its word in one of the texts, as later occurrences are rarer and come first;
    what is left of both texts behind it holds the shared words that the threshold asks for; and none of the ``BEFORE``
    words in front of it is shared. So a word that many texts repeat many times doesn't bring the same pairs once for
    each occurrence, and pairs that it alone can't make similar don't come at all.
    """
    other = prefix.select("token", *[F.col(c).alias(f"{c}2") for c in ("doc", "g", "active", "n", "left", "rank", "before")])
    longer = F.greatest("n", "n2")
    return (prefix.filter("active = 1").join(other, "token")
            .filter("g <> g2 and (active2 = 0 or doc < doc2) and (left = 0 or left2 = 0)")
            .filter(1 + F.least(F.col("n") - F.col("rank"), F.col("n2") - F.col("rank2")) >= longer - F.floor((1 - threshold) * longer + 1e-9))
            .filter(~F.arrays_overlap("before", "before2"))
            .select("doc", "doc2", longer.alias("longer")))


def prefix_pairs(texts: DataFrame, roles: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """(a, b): every pair of different groups ``g``, one side active, that can reach the threshold by its words.

    ``roles`` has doc, active, g. Similar texts share all but (1 - threshold) of the longer one's labelled words, so their
    rarest words, one more than that share of each, have one in common. A passage of many texts is made of words
    that many hold; they come last, so texts that share nothing else don't meet.
    """
    tokens = materialize(texts.withColumn("did", F.xxhash64("text")).join(roles, "doc").select("doc", "did", "g", "active", "text")
                         .mapInArrow(_tokens, "doc long, did long, g long, active int, n int, nth int, left int, token long"), "near-tokens")
    held = materialize(tokens.groupBy("token").agg(F.count("*").alias("df"), F.min("g").alias("lo"), F.max("g").alias("hi"),
                                                   F.max("active").alias("any")), "near-token-counts")
    own = Window.partitionBy("doc", "did")
    prefix = materialize(tokens.join(held, "token").withColumn("rank", F.row_number().over(own.orderBy("df", F.col("nth").desc(), "token")))
                         .filter(F.col("rank") <= F.floor((1 - threshold) * F.col("n") + 1e-9) + 1)
                         .filter("lo < hi and any = 1")
                         .withColumn("before", F.collect_list("token").over(own.orderBy("rank").rowsBetween(-BEFORE, -1)))
                         .select("doc", "g", "active", "n", "left", "rank", "before", "token"), "near-prefix")
    discard(tokens, held)
    pairs = first_shared(prefix, threshold).distinct()
    # A bound that loses nothing: an edit changes two word counts by one.
    apart = F.aggregate(F.zip_with("bag", "bag2", lambda x, y: F.abs(x - y)), F.lit(0), lambda t, x: t + x)
    bags2 = bags.withColumnsRenamed({"doc": "doc2", "bag": "bag2"})
    fits = (pairs.join(bags, "doc").join(bags2, "doc2").filter(apart <= 2 * ((1 - threshold) * F.col("longer") + 1e-9)))
    out = fits.select(F.least("doc", "doc2").alias("a"), F.greatest("doc", "doc2").alias("b")).distinct()
    return out


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD,
                    k: int = SHINGLE, sketches: int = SKETCHES, pick: int = PICK) -> DataFrame:
    """Per row of docs: doc_id, digest, class_id (first exact copy), component_id (smallest id of
    the group), kept (the id is its group's smallest)."""
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    src = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc"), F.md5(body.cast("binary")).alias("digest"),
                      F.xxhash64(body).alias("did"), body.alias("text"))
    sketched = materialize(
        src.filter("doc is not null").mapInArrow(_sketch(k, sketches, pick), "digest string, did long, doc long, n int, sketch array<long>, bag array<int>"),
        "near-sketches").filter("n > 0")
    # One text per class; a document (id) with several texts stands in several classes.
    classes = materialize(sketched.groupBy("digest").agg(F.min("doc").alias("doc"), F.first("did").alias("did"),
                                                         F.first("n").alias("n"), F.first("sketch").alias("sketch"),
                                                         F.first("bag").alias("bag")), "near-classes")
    entries = classes.select("did", "doc", "n", F.posexplode("sketch").alias("band", "key"))
    first = entries.groupBy("band", "key").agg(F.min("doc").alias("a"), F.max("doc").alias("last")).filter("a < last").select("band", "key")
    buckets = materialize(entries.join(first, ["band", "key"]), "near-buckets")
    # Only texts that share a bucket are needed again.
    texts = materialize(src.join(buckets.select("did", "doc").distinct(), ["did", "doc"], "left_semi")
                        .select("doc", "text").distinct(), "near-texts")

    links = bucket_links(buckets.select("band", "key", "doc", "n").distinct(), texts,
                         classes.select("doc", "bag"), threshold)
    group = components(materialize(links, "near-links")).withColumnRenamed("id", "class_id")

    of_class = (classes.select("digest", F.col("doc").alias("class_id")).join(group, "class_id", "left")
                .select("digest", "class_id", F.coalesce("component", "class_id").alias("component_id")))
    out = src.select("doc", "digest").join(of_class, "digest", "left")
    known = F.col("doc").isNotNull() & F.col("class_id").isNotNull()
    return out.select(F.col("doc").alias("doc_id"), "digest",
                      F.when(known, F.col("class_id")).otherwise(F.col("doc")).alias("class_id"),
                      F.when(known, F.col("component_id")).otherwise(F.col("doc")).alias("component_id"),
                      F.when(known, F.col("doc") == F.col("component_id")).otherwise(True).alias("kept"))
