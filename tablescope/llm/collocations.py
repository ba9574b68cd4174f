"""Phrase collocations: level-wise counting with broadcast double-array tries.

A phrase is 2 to 5 neighbouring words of one piece of text. It is a candidate when it occurs at least
``least`` times in its language; its score compares that count with the counts of its two parts at the
cheapest cut. Steps:

1. word counts per language (partial counts per task, added by a map-side combined aggregate); words of ``least`` and more get
   dense numbers, common words first, one range for all languages, so a number implies its language;
2. texts are written once as those numbers, 0 for a rare word, the end of a piece and the end of a document;
3. for n = 2 to 5: a window of n words can only be frequent when its first and its last n - 1 words are
   (Apriori). Such windows are counted in hash buckets, ``SPARE`` / ``least`` of them or more to a window;
   their counts are added by pieces of 2^16 buckets. The distinct windows in buckets of ``least`` and more are the candidates
   (``_candidates``). They are counted exactly: a block of at most ``BLOCK_PHRASES``
   becomes a double-array trie, numpy moves the states of all text positions through it together, one word a
   level, the accepting states are binned and the counts of the shards are added;
4. scores, the rule against parts of longer candidates and the first ``top`` of each language are joins and
   aggregates over the frequent phrases.

Tries and the word table are broadcast in blocks of a fixed size, one block after another, however many phrases
there are. A task hands on the buckets of its windows, at most three bytes a window, and gets back the hot ones, about as
many as there are frequent windows; the filter only ever drops windows that can't reach ``least``. With 2^32 buckets, at 8
thousand million windows of a level and the usual ``least``, their number stops growing, so beyond that it drops fewer.
Words are found by 64-bit hash.

The rule against parts needs only candidates one word longer: if a phrase lies in a longer candidate with the same count, all
phrases between the two have that count and are candidates too.

Defined results: null texts have no words; a null language is ``und``; repeated rows count each; an empty
table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import itertools
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablescope.llm.ranks import ranked
from tablescope.llm.text import ASCII_LOWER, iter_words, mix
from tablescope.session import materialize

LEAST = 100
LONGEST = 5
TOP = 2000
BLOCK_WORDS = 1_000_000      # words of one broadcast word table (12 MB)
BLOCK_PHRASES = 400_000      # phrases of one trie (about 40 MB with 250,000 words)
SPARE = 50                   # the windows of a level divided by its buckets are a 50th of ``least`` at most
BUCKET_BITS = 20, 32         # fewest and most bits of a bucket's number
PIECE_BITS = 16              # buckets 2^16 to one partial-count row
HELD_BUCKETS = 1 << 22       # windows whose buckets a task holds before it hands on their counts (16 MB)
MAP_BITS = 20, 27            # fewest and most bits of the map of hot buckets (at most 16 MB)
SEEN_BITS = 12, 21           # fewest and most bits of a place among the windows that a task has named (at most 16 MB)
BINS = 1 << 11               # phrases of one count row
CHUNK = 1 << 19              # text positions advanced at once
HELD_WORDS = 200_000         # different words whose counts a task holds before it hands them on
HELD_WINDOWS = 500_000       # different windows that a task holds before it hands them on
FIRST_SHARE = 16             # the texts that name their windows before all others are one part in so many
KNOWN_TRIES = 4              # blocks of windows already named that a task holds; what further ones hold is named again
KNOWN_WINDOWS = 1_000_000    # windows of such a block (8 MB)

# Bytes that end a piece, and bytes between the words of a piece.
_BREAK = np.zeros(256, dtype=bool)
_BREAK[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
PHRASE_WORDS = ~_BREAK
PHRASE_WORDS[[0x20, 0x09]] = False


def _salt(lang: str) -> np.uint64:
    body = lang.encode()
    return mix(np.array([zlib.crc32(body) << 32 | zlib.crc32(body[::-1] + b"~")], dtype=np.uint64))[0]


def _salted(g, batch) -> tuple[np.ndarray, list, np.ndarray]:
    """(word keys with their language, languages, language of each text) of a group of texts."""
    own = batch.column("lang").slice(g.first, g.n_docs).dictionary_encode()
    langs = own.dictionary.to_pylist()
    code = np.asarray(own.indices)
    salt = np.array([_salt(x) for x in langs], dtype=np.uint64)
    return mix(g.hash ^ salt[code[g.doc]]), langs, code


def _spelled(g, at: np.ndarray) -> np.ndarray:
    """The words ``at`` of a group of texts, as strings."""
    size = g.end[at] - g.start[at]
    cut = np.concatenate(([0], np.cumsum(size)))
    body = g.data[np.repeat(g.start[at] - cut[:-1], size) + np.arange(cut[-1])]
    column = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(cut.astype(np.int32)), pa.py_buffer(body)])
    return column.to_numpy(zero_copy_only=False)


def _count_words(batches):
    """Counts of the words of a task, handed on whenever ``HELD_WORDS`` different ones are held."""
    none = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64), np.empty(0, dtype=object), np.empty(0, dtype=object)
    held, count, lang, word = none
    for b in batches:
        for g in iter_words(b.column("text"), PHRASE_WORDS, ASCII_LOWER):
            key, langs, code = _salted(g, b)
            key, at, n = np.unique(key, return_index=True, return_counts=True)
            place = np.searchsorted(held, key)
            known = np.flatnonzero(held[np.minimum(place, len(held) - 1)] == key) if len(held) else np.empty(0, np.int64)
            count[place[known]] += n[known]
            new = np.setdiff1d(np.arange(len(key)), known, assume_unique=True)
            spelled, own = _spelled(g, at[new]), np.array(langs, dtype=object)[code[g.doc[at[new]]]]
            where = place[new]
            held, count = np.insert(held, where, key[new]), np.insert(count, where, n[new])
            lang, word = np.insert(lang, where, own), np.insert(word, where, spelled)
            if len(held) >= HELD_WORDS:
                yield pa.record_batch({"lang": pa.array(lang, pa.string()), "word": pa.array(word, pa.string()), "a": pa.array(count)})
                held, count, lang, word = none
    yield pa.record_batch({"lang": pa.array(lang, pa.string()), "word": pa.array(word, pa.string()), "a": pa.array(count)})


def _word_keys(batches):
    """The key that ``_salted`` gives a word, and its number as four bytes."""
    for b in batches:
        key = np.empty(b.num_rows, dtype=np.uint64)
        for g in iter_words(b.column("word"), PHRASE_WORDS):
            key[g.first:g.first + g.n_docs], _, _ = _salted(g, b)
        raw = np.asarray(b.column("id")).astype(">i4").tobytes()
        yield pa.record_batch({
            "id": b.column("id"), "hash": pa.array(key.view(np.int64)), "lang": b.column("lang"), "word": b.column("word"),
            "a": b.column("a"), "n": b.column("n"),
            "key": pa.array([raw[i:i + 4] for i in range(0, len(raw), 4)], pa.binary())})


def _encode(table, carry: bool, last: bool):
    """Texts as word numbers, little-endian 32 bits; a break is 0. ``carry``: numbers found by earlier blocks of
    the word table stay; the last block returns no text."""
    def run(batches):
        hashes, numbers = table.value
        for b in batches:
            out, before = [], b.column("ids").to_pylist() if carry else None
            for g in iter_words(b.column("text"), PHRASE_WORDS, ASCII_LOWER):
                key, _, _ = _salted(g, b)
                at = np.minimum(np.searchsorted(hashes, key), len(hashes) - 1)
                number = np.where(hashes[at] == key, numbers[at], 0).astype(np.int32) if len(hashes) else np.zeros(len(key), np.int32)
                pieces = np.cumsum(_BREAK[g.data], dtype=np.int32)[g.start]
                took = np.ones(len(number), dtype=np.int64)      # a word, and the 0 of a break before it
                took[1:] += (pieces[1:] != pieces[:-1]) & (g.doc[1:] == g.doc[:-1])
                whole = np.zeros(int(took.sum()) + g.n_docs, dtype=np.int32)
                whole[np.cumsum(took) - 1 + g.doc] = number      # each text before it has a 0 at its end
                total = np.concatenate(([0], np.cumsum(took)))[g.bounds()]
                cut = total + np.arange(g.n_docs + 1)
                out += [whole[cut[i]:cut[i + 1]].tobytes() for i in range(g.n_docs)]
            if carry:
                joined = []
                for x, y in zip(before, out, strict=True):
                    x, y = np.frombuffer(x, "<i4"), np.frombuffer(y, "<i4")
                    joined.append(np.where(x == 0, y, x).tobytes())
                out = joined
            rest = {} if last else {"lang": b.column("lang"), "text": b.column("text")}
            yield pa.record_batch({**rest, "ids": pa.array(out, pa.binary())})
    return run


@dataclass
class Trie:
    """A double-array trie over word numbers: the child of state s by word c is base[s] + c if check there is s.
    State 0 is dead, state 1 the root; where a phrase ends, base is its row. ``first``: phrases of the tries before it."""

    base: np.ndarray
    check: np.ndarray
    phrases: np.ndarray
    first: int = 0

    def __post_init__(self):
        self.top = int(self.phrases.max())

    def advance(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        to = self.base[state] + word
        return np.where(self.check[to] == state, to, 0)

    def _reached(self, ids: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
        """Those of the first ``count`` positions where a phrase starts, and the phrases."""
        ids = np.where(ids <= self.top, ids, 0)                      # words of no phrase
        to = self.base[1] + ids[:count]
        at = np.flatnonzero(self.check[to] == 1)
        state = to[at]
        for j in range(1, self.phrases.shape[1]):                    # only positions that are alive go on
            to = self.base[state] + ids[at + j]
            alive = self.check[to] == state
            at, state = at[alive], to[alive]
        return at, self.base[state]

    def ends(self, ids: np.ndarray, count: int) -> np.ndarray:
        """For the first ``count`` positions, the phrase of the trie that starts there, or -1."""
        out = np.full(count, -1, dtype=np.int32)
        at, phrase = self._reached(ids, count)
        out[at] = phrase
        return out

    def numbers(self, ids: np.ndarray, count: int) -> np.ndarray:
        """As ``ends``, with the numbers that phrases have among all tries of their level, from 1, and 0 for none."""
        out = np.zeros(count, dtype=np.int32)
        at, phrase = self._reached(ids, count)
        out[at] = phrase + np.int32(self.first + 1)
        return out

    def holds(self, rows: np.ndarray) -> np.ndarray:
        """Whether each row of words (m, n) is a phrase of the trie."""
        state = np.ones(len(rows), dtype=np.int32)
        rows = np.where(rows <= self.top, rows, 0)
        for j in range(rows.shape[1]):
            state = self.advance(state, rows[:, j])
        return state > 0


def double_array(phrases: np.ndarray) -> Trie:
    """Trie of distinct phrases (m, n), sorted by rows, with numbers from 1.

    The children of all states of a level are placed together: every state draws a base, those whose
    slots are free and not claimed by an earlier state take them, the others draw again from a
    growing table. States with many children go first.
    """
    m, n = phrases.shape
    symbols = int(phrases.max()) + 1
    rng = np.random.default_rng(1)
    size = 2 * symbols + 4
    check, base = np.full(size, -1, dtype=np.int32), np.zeros(size, dtype=np.int32)
    check[:2] = -2
    first = np.zeros(1, dtype=np.int64)          # first row of each node of the level above
    state = np.ones(1, dtype=np.int32)
    changed = np.zeros(m, dtype=bool)
    changed[0] = True
    for j in range(n):
        changed[1:] |= phrases[1:, j] != phrases[:-1, j]
        rows = np.flatnonzero(changed)
        parent = np.searchsorted(first, rows, side="right") - 1
        word = phrases[rows, j].astype(np.int64)
        kids = np.bincount(parent, minlength=len(state))
        start = np.cumsum(kids) - kids
        own = np.empty(len(rows), dtype=np.int32)
        for big in sorted({int(x).bit_length() for x in kids}, reverse=True):
            open_ = np.flatnonzero((kids >= 1 << (big - 1)) & (kids < 1 << big))
            high = max(len(rows) * 2, 2)
            while len(open_):
                count = kids[open_]
                draw = rng.integers(2, high + 2, len(open_)) if j else np.full(1, 2)
                at = np.repeat(start[open_] - (np.cumsum(count) - count), count) + np.arange(count.sum())
                who = np.repeat(np.arange(len(open_)), count)
                slot = draw[who] + word[at]
                if (need := int(slot.max()) + symbols + 1) > len(check):
                    more = max(need, len(check) * 5 // 4) - len(check)
                    check = np.concatenate((check, np.full(more, -1, dtype=np.int32)))
                    base = np.concatenate((base, np.zeros(more, dtype=np.int32)))
                _, earliest, place = np.unique(slot, return_index=True, return_inverse=True)
                lost = (check[slot] != -1) | (who[earliest][place] != who)
                ok = np.bincount(who[lost], minlength=len(open_)) == 0
                won = ok[who]
                own[at[won]] = slot[won]
                check[slot[won]] = state[open_][who[won]]
                base[state[open_[ok]]] = draw[ok]
                if ok.mean() < 0.05:
                    high += high // 64 + symbols // 64 + 1
                open_ = open_[~ok]
        first, state = rows, own
    size = int(base.max()) + symbols
    base[state] = np.arange(m)
    return Trie(base[:size].copy(), check[:size].copy(), phrases)


def _values(column) -> np.ndarray:
    """The bytes of a binary column, one value behind the other."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.empty(0, np.uint8)
    offsets = np.frombuffer(offsets, np.int32)
    return np.frombuffer(data, np.uint8)[int(offsets[column.offset]):int(offsets[column.offset + len(column)])]


def _binary(values: np.ndarray, cut: np.ndarray) -> pa.Array:
    """Binary values, value i the items cut[i] to cut[i + 1] of ``values``."""
    cut = (cut * values.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer(cut), pa.py_buffer(np.ascontiguousarray(values).view(np.uint8))])


def _chunks(batch, longest: int):
    """(ids with ``longest`` zeros or following words behind, positions to look at) over the texts of a batch."""
    ids = _values(batch.column("ids")).view("<i4")
    for i in range(0, len(ids), CHUNK):
        part = ids[i:i + CHUNK + longest]
        count = min(CHUNK, len(ids) - i)
        yield np.concatenate((part, np.zeros(max(0, count + longest - len(part)), dtype=np.int32))), count


def _mark(trie, carry: bool):
    """Adds ``number``: four bytes a position, the number of the phrase of the trie that starts there, or 0."""
    def run(batches):
        t = trie.value
        for b in batches:
            number = [t.numbers(x, n) for x, n in _chunks(b, LONGEST)]
            number = np.concatenate(number) if number else np.empty(0, np.int32)
            if carry:
                number = np.maximum(number, _values(b.column("number")).view("<i4"))      # a phrase is in one trie
            cut = np.concatenate(([0], np.cumsum(np.asarray(pa.compute.binary_length(b.column("ids"))) // 4)))
            yield pa.record_batch({"ids": b.column("ids"), "number": _binary(number, cut)})
    return run


def _live_windows(batch, n: int, trie):
    """(ids, positions, hashes) of the windows of n words whose first and last n - 1 words are frequent: those of ``trie``,
    and those that earlier tries of the level have numbered. The hash of a window is its identity: a bijection of the
    number of its first n - 1 words and its last word, and never 0."""
    marks = _values(batch.column("number")).view("<i4") if "number" in batch.schema.names else np.empty(0, np.int32)
    at = 0
    for ids, count in _chunks(batch, LONGEST):
        number = ids[:count + 1] if trie is None else trie.value.numbers(ids, count + 1)
        own = marks[at:at + count + 1]
        if len(own):
            number[:len(own)] = np.maximum(number[:len(own)], own)
        alive = number != 0
        where = np.flatnonzero(alive[:-1] & alive[1:])
        yield ids, where, mix(number[where].astype(np.uint64) << np.uint64(32) | ids[where + n - 1].astype(np.uint64))
        at += count


def _among(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(x), dtype=bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)] == x


@dataclass
class HotBuckets:
    """Buckets that can hold a frequent window: their numbers, sorted, and a bit map of the lowest bits of the numbers.
    The bucket of a window is the first ``bits`` bits of its hash."""

    bits: int
    buckets: np.ndarray

    def __post_init__(self):
        fold = min(max(len(self.buckets).bit_length() + 5, MAP_BITS[0]), MAP_BITS[1], self.bits)
        self.mask = np.uint64((1 << fold) - 1)
        self.map = np.zeros(1 << (fold - 3), dtype=np.uint8)
        low = self.buckets.astype(np.uint64) & self.mask
        np.bitwise_or.at(self.map, (low >> np.uint64(3)).astype(np.int64), np.uint8(1) << (low & np.uint64(7)).astype(np.uint8))

    def may_hold(self, h: np.ndarray) -> np.ndarray:
        """False only for windows of no hot bucket."""
        low = (h >> np.uint64(64 - self.bits)) & self.mask
        return (self.map[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)

    def hold(self, h: np.ndarray) -> np.ndarray:
        return _among(self.buckets, (h >> np.uint64(64 - self.bits)).astype(np.uint32))


def _bucket_rows(bucket: np.ndarray, cap: int) -> pa.RecordBatch:
    """(piece, at, counts): how often each bucket occurs, a row for every piece of 2^PIECE_BITS buckets that has any."""
    bucket.sort()
    first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    counts = np.minimum(np.diff(first, append=len(bucket)), cap).astype(np.uint8)     # ``cap`` in one shard decides already
    bucket = bucket[first]
    piece = (bucket >> np.uint32(PIECE_BITS)).astype(np.int32)
    start = np.flatnonzero(np.concatenate(([True], piece[1:] != piece[:-1])))
    cut = np.append(start, len(bucket))
    at = (bucket & np.uint32((1 << PIECE_BITS) - 1)).astype("<u2")
    return pa.record_batch({"piece": pa.array(piece[start]), "at": _binary(at, cut), "counts": _binary(counts, cut)})


def _fill_buckets(n: int, least: int, trie, bits: int):
    cap = min(least, 255)

    def run(batches):
        held, size = [], 0
        for b in batches:
            for _, _, h in _live_windows(b, n, trie):
                held.append((h >> np.uint64(64 - bits)).astype(np.uint32))
                size += len(h)
                if size >= HELD_BUCKETS:
                    yield _bucket_rows(np.concatenate(held), cap)
                    held, size = [], 0
        if size:
            yield _bucket_rows(np.concatenate(held), cap)
    return run


def _add_buckets(cap: int):
    """(piece, at) of the buckets of a piece whose counts add up to ``cap``."""
    def run(table: pa.Table) -> pa.Table:
        total = np.bincount(_values(table["at"]).view("<u2"), weights=_values(table["counts"]), minlength=1 << PIECE_BITS)
        hot = np.flatnonzero(total >= cap).astype("<u2")
        return pa.table({"piece": table["piece"].slice(0, 1), "at": pa.array([hot.tobytes()], pa.binary())})
    return run


def _hot_buckets(positions: DataFrame, n: int, least: int, trie, windows: int) -> HotBuckets:
    """The buckets that hold ``least`` windows or more. Their number follows ``windows``, which is no fewer than there are;
    every task adds up the buckets of some pieces."""
    bits = min(max((windows * SPARE // least).bit_length(), BUCKET_BITS[0]), BUCKET_BITS[1])
    cap = min(least, 255)
    rows = positions.mapInArrow(_fill_buckets(n, least, trie, bits), "piece int, at binary, counts binary")
    hot = materialize(rows.groupBy("piece").applyInArrow(_add_buckets(cap), "piece int, at binary"), "colloc-buckets").toArrow()
    size = np.asarray(pa.compute.binary_length(hot["at"])) // 2
    buckets = np.repeat(np.asarray(hot["piece"]).astype(np.uint32) << np.uint32(PIECE_BITS), size) | _values(hot["at"]).view("<u2")
    return HotBuckets(bits, np.sort(buckets))


def _keys(rows: np.ndarray) -> pa.Array:
    """Phrases (m, n) as binary keys: four bytes a word, so a part of a phrase is a part of its key."""
    raw = np.ascontiguousarray(rows.astype(">i4")).view(np.uint8).ravel()
    cut = (np.arange(len(rows) + 1) * rows.shape[1] * 4).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(cut), pa.py_buffer(raw)])


def _emit(n: int, hot, trie, known: list):
    """(key, hash) of the windows that pass, each once a task unless it holds very many; those whose hashes are in ``known``
    are left out."""
    def run(batches):
        buckets = hot.value
        bits = min(max(len(buckets.buckets).bit_length() + 1, SEEN_BITS[0]), SEEN_BITS[1])
        seen = np.zeros(1 << bits, dtype=np.uint64)      # at the last bits of a hash, the window seen last that has them
        held, size = [(np.empty(0, np.uint64), np.empty((0, n), np.int32))], 0

        def rows():
            h, words = (np.concatenate(x) for x in zip(*held, strict=True))
            h, first = np.unique(h, return_index=True)
            return pa.record_batch({"key": _keys(words[first]), "hash": pa.array(h.view(np.int64))})
        for b in batches:
            for ids, at, h in _live_windows(b, n, trie):
                some = np.flatnonzero(buckets.may_hold(h))
                place = h[some] & np.uint64((1 << bits) - 1)
                new = np.flatnonzero(seen[place] != h[some])
                seen[place[new]] = h[some[new]]
                h, first = np.unique(h[some[new]], return_index=True)
                at = at[some[new[first]]]
                passed = buckets.hold(h)
                for other in known:
                    passed &= ~_among(other.value, h)
                h, at = h[passed], at[passed]
                held.append((h, np.stack([ids[at + j] for j in range(n)], axis=1)))
                size += len(h)
                if size >= HELD_WINDOWS:
                    yield rows()
                    held, size = held[:1], 0
        yield rows()
    return run


def _candidates(ids: DataFrame, positions, n: int, hot, trie) -> DataFrame:
    """The distinct windows of hot buckets (column key); ``positions`` marks texts for them.

    A window that is frequent stands in nearly every task, so naming it in each would cost windows times tasks. The texts are
    taken in two parts by their hash: a ``FIRST_SHARE``-th of them, dealt to as large a part of the tasks, names nearly all of
    them, and the others name only what the first part lacks. Every window of every text is in one of the two.
    """
    part, schema = F.pmod(F.xxhash64("ids"), F.lit(FIRST_SHARE)), "key binary, hash long"
    tasks = -(-ids.rdd.getNumPartitions() // FIRST_SHARE)
    first = positions(ids.filter(part == 0).repartition(tasks)).mapInArrow(_emit(n, hot, trie, []), schema)
    first = materialize(first.distinct(), f"colloc-first-{n}")
    known = [ids.sparkSession.sparkContext.broadcast(np.sort(np.asarray(block.select("hash").toArrow()["hash"]).view(np.uint64)))
             for block in itertools.islice(_blocks(first, first.count(), KNOWN_WINDOWS), KNOWN_TRIES)]
    others = positions(ids.filter(part != 0)).mapInArrow(_emit(n, hot, trie, known), schema)
    out = materialize(first.union(others).select("key").distinct(), f"colloc-candidates-{n}")
    for other in known:
        other.destroy()
    return out


def _count_rows(total: np.ndarray, salt: int, first: int = 0) -> pa.RecordBatch:
    """(piece, salt, at, counts): the counts that are not 0, a row for every ``BINS`` phrases that have any."""
    some = np.flatnonzero(total)
    piece = some // BINS
    start = np.flatnonzero(np.concatenate(([True], piece[1:] != piece[:-1]))) if len(some) else some
    cut = np.append(start, len(some))
    counts = total[some]
    counts = counts.astype(np.min_scalar_type(int(counts.max()))) if len(some) else counts
    return pa.record_batch({"piece": pa.array((piece[start] + first).astype(np.int32)), "salt": pa.array(np.full(len(start), salt, np.int32)),
                            "at": _binary((some % BINS).astype("<u2"), cut), "counts": _binary(counts, cut)})


def _count_phrases(trie):
    """Bins of the accepting states of one shard, ``BINS`` phrases a row."""
    def run(batches):
        from pyspark import TaskContext
        t = trie.value
        total = np.zeros(len(t.phrases) + 1, dtype=np.int64)
        for b in batches:
            for ids, count in _chunks(b, LONGEST):
                total += np.bincount(t.ends(ids, count) + 1, minlength=len(total))
        yield _count_rows(total[1:], TaskContext.get().partitionId() // 64)
    return run


def _counts(at, counts) -> tuple[np.ndarray, np.ndarray]:
    """The places in a piece and the counts of a row of ``_count_rows``."""
    at = np.frombuffer(at.as_buffer(), "<u2")
    counts = counts.as_buffer()
    return at, np.frombuffer(counts, f"<u{counts.size // len(at)}")


def _add_counts(table: pa.Table) -> pa.Table:
    total = np.zeros(BINS, dtype=np.int64)
    for x, y in zip(table["at"], table["counts"], strict=True):
        at, counts = _counts(x, y)
        total[at] += counts.astype(np.int64)
    return pa.Table.from_batches([_count_rows(total, 0, table["piece"][0].as_py())])


def _frequent(trie, least: int):
    """(key, a) of the phrases whose added bins reach ``least``."""
    def run(batches):
        phrases = trie.value.phrases
        for b in batches:
            for piece, x, y in zip(b.column("piece").to_pylist(), b.column("at"), b.column("counts"), strict=True):
                at, a = _counts(x, y)
                some = np.flatnonzero(a >= least)
                yield pa.record_batch({"key": _keys(phrases[piece * BINS + at[some].astype(np.int64)]), "a": pa.array(a[some].astype(np.int64))})
    return run


def _blocks(table: DataFrame, rows: int, limit: int):
    """``table`` in blocks of about ``limit`` rows by hash of its key, each read to the driver alone."""
    n = max(1, -(-rows // limit))
    for i in range(n):
        yield table.filter(F.pmod(F.xxhash64("key"), F.lit(n)) == i)


def _tries(phrases: DataFrame, rows: int, n: int, limit: int):
    """Broadcast tries over the blocks of a phrase table (column key)."""
    first = 0
    for part in _blocks(phrases, rows, limit):
        keys = b"".join(part.select("key").toArrow()["key"].to_pylist())
        if keys:
            ids = np.frombuffer(keys, ">i4").astype(np.int32).reshape(-1, n)
            ids = ids[np.lexsort(ids.T[::-1])]
            trie = double_array(ids)
            trie.first = first
            first += len(ids)
            yield phrases.sparkSession.sparkContext.broadcast(trie)


def frequent_phrases(ids: DataFrame, words: int, least: int, longest: int, block_phrases: int) -> list[DataFrame]:
    """Tables (key, a) of the phrases of 2, 3, ... words that occur at least ``least`` times; ``words``: how many words of
    ``ids`` are not 0."""
    out: list[DataFrame] = []
    windows = words
    for n in range(2, longest + 1):
        trie, earlier = None, []
        if n > 2:
            *earlier, trie = _tries(out[-1], out[-1].count(), n - 1, block_phrases)

        def positions(texts, earlier=earlier):
            for i, other in enumerate(earlier):
                texts = texts.mapInArrow(_mark(other, i > 0), "ids binary, number binary")
            return texts
        hot = ids.sparkSession.sparkContext.broadcast(_hot_buckets(positions(ids), n, least, trie, windows))
        found = _candidates(ids, positions, n, hot, trie)
        counted = None
        for block in _tries(found, found.count(), n, block_phrases):
            schema = "piece int, salt int, at binary, counts binary"
            added = (ids.mapInArrow(_count_phrases(block), schema).groupBy("piece", "salt").applyInArrow(_add_counts, schema)
                     .groupBy("piece").applyInArrow(_add_counts, schema))
            part = materialize(added.mapInArrow(_frequent(block, least), "key binary, a long"), f"colloc-phrases-{n}")
            counted = part if counted is None else counted.union(part)
            block.destroy()
        hot.destroy()
        for other in [*earlier, trie] if trie else []:
            other.destroy()
        if counted is None or counted.isEmpty():
            break
        out.append(counted)
        windows = counted.agg(F.sum("a")).first()[0]
    return out


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST,
                 top: int = TOP, block_words: int = BLOCK_WORDS, block_phrases: int = BLOCK_PHRASES) -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n, score: the first ``top`` phrases of each language."""
    spark = docs.sparkSession
    src = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"),
                      F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    counts = materialize(src.mapInArrow(_count_words, "lang string, word string, a long")
                         .groupBy("lang", "word").agg(F.sum("a").alias("a")), "colloc-words")
    sizes = counts.groupBy("lang").agg(F.sum("a").alias("n"))
    common = counts.filter(F.col("a") >= least).join(sizes, "lang")
    common = common.select(F.lit(0).alias("all"), (-F.col("a")).alias("less"), "lang", "word", "a", F.col("n").alias("words"))
    numbered = ranked(common, "all", ["less", "lang", "word"], "colloc-order")
    words = materialize(numbered.select((F.col("pos") + 1).cast("int").alias("id"), "lang", "word", "a", F.col("words").alias("n"))
                        .mapInArrow(_word_keys, "id int, hash long, lang string, word string, a long, n long, key binary"), "colloc-vocabulary")

    encoded, rows = src, words.count()
    blocks = list(_blocks(words, rows, block_words))
    for i, part in enumerate(blocks):
        own = part.select("hash", "id").toArrow()
        hashes = np.asarray(own["hash"]).view(np.uint64)
        order = np.argsort(hashes)
        table = spark.sparkContext.broadcast((hashes[order], np.asarray(own["id"])[order]))
        last = i == len(blocks) - 1
        encoded = encoded.mapInArrow(_encode(table, i > 0, last), "ids binary" if last else "lang string, text string, ids binary")
    ids = materialize(encoded, "colloc-ids")

    levels = frequent_phrases(ids, words.agg(F.sum("a")).first()[0] or 0, least, longest, block_phrases)
    if not levels:
        return spark.createDataFrame([], "lang string, rank int, phrase string, a long, l long, r long, n long, score long")
    phrases = levels[0]
    for level in levels[1:]:
        phrases = phrases.union(level)
    phrases = phrases.withColumn("size", (F.octet_length("key") / 4).cast("int"))
    parts = words.select("key", "a").union(phrases.select("key", "a"))

    # scores of all cuts, the lowest counts
    cuts = phrases.select("key", "a", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")).select(
        "key", "a", "size", "k", F.expr("substring(key, 1, 4 * k)").alias("left"), F.expr("substring(key, 4 * k + 1)").alias("right"),
        F.expr("substring(key, 1, 4)").alias("head"))
    scored = (cuts.join(parts.select(F.col("key").alias("left"), F.col("a").alias("l")), "left")
              .join(parts.select(F.col("key").alias("right"), F.col("a").alias("r")), "right")
              .join(words.select(F.col("key").alias("head"), "lang", "n"), "head"))
    scored = scored.withColumn("score", F.expr("(1000 * cast(a as decimal(17,0)) * cast(n as decimal(17,0))) div "
                                               "(cast(l as decimal(17,0)) * cast(r as decimal(17,0)))"))
    best = scored.groupBy("key", "a", "size", "lang", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    # parts of a candidate one word longer that occurs as often
    longer = (phrases.filter("size > 2").select("a", F.explode(F.array(
        F.expr("substring(key, 1, 4 * (size - 1))"), F.expr("substring(key, 5)"))).alias("key"))
        .groupBy("key").agg(F.max("a").alias("longer")))
    kept = best.join(longer, "key", "left").filter(F.coalesce(100 * F.col("longer") < 100 * F.col("a"), F.lit(True)))
    kept = kept.select("key", "lang", "a", "n", "size", "c.*")
    spelled = (kept.select("key", F.posexplode(F.expr("transform(sequence(0, size - 1), i -> substring(key, 4 * i + 1, 4))")).alias("at", "word_key"))
               .join(words.select(F.col("key").alias("word_key"), "word"), "word_key")
               .groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase")))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    out = kept.join(spelled, "key").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
