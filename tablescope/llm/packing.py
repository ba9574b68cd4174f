"""Hierarchical multi-length packing of tokenised documents.

Each task tokenises its documents and packs them in chunks of bounded size:

1. a document's full windows (``window`` tokens) become sequences of their own;
2. what is left is routed to the smallest context tier that holds it (a power of two);
3. each tier is packed from its longest piece down, and the gap of a window is filled from
   the shorter tiers: the longest piece that fits, again and again, and at last the head of
   the shortest longer piece, so that every sequence is exactly full;
4. pieces that fill no window wait for the next chunk; at the end of the task they are cut
   into sequences whose lengths are the powers of two in their token sum;
5. the sequences of a tier are dealt in snake order of their attention cost (sum of squared
   piece lengths) to step groups of ``group`` sequences.

So there is no padding at all and no shuffle: a hot source or a large group of copies is
just more rows of the scan. Memory is one chunk (``chunk_tokens``) plus the longest
document. Sequence and group ids hold the partition number in their upper bits, so a task
that is run again yields the same ids.

Defined results: null and empty texts are one end token; repeated rows and repeated ids are
packed each; an empty table gives no pieces; columns other than id and text are not read.
"""

from __future__ import annotations

import json
from bisect import bisect_left, bisect_right, insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 2048
TIERS = (256, 512, 1024, 2048)
END_ID = 1
CHUNK_TOKENS = 1_000_000
GROUP = 16

# Fixed value: the pre-tokenizer pattern that byte-level BPE files of this kind imply.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONG_TEXT = 200_000          # longer texts go to the slower library, which has no depth limit

SCHEMA = ("doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, "
          "tier int, step_group long, ids binary")


def _byte_alphabet() -> dict[str, int]:
    """Printable stand-in character -> byte, by the byte-level rule: printable bytes stand for
    themselves, the others for the code points from 256 up in byte order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def load_tokenizer(path: str):
    """text -> uint32 ids of a byte-level BPE file, equal to ``tokenizers`` without special tokens.

    The vocabulary of the file runs in ``tiktoken``, which is about four times as fast; texts
    that hold an added token's string, and very long ones, go to ``tokenizers`` itself.
    """
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    added = [t["content"] for t in spec.get("added_tokens", [])]
    alphabet = _byte_alphabet()
    ranks = {bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
    fast = tiktoken.Encoding("byte_bpe", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if len(text) > LONG_TEXT or any(t in text for t in added):
            return np.array(slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return fast.encode_to_numpy(text, disallowed_special=())
    return encode


class TierPools:
    """Waiting pieces (length, document, start) by tier; each pool is sorted by length."""

    def __init__(self, tiers: tuple[int, ...]):
        self.tiers = tiers
        self.pools: list[list[tuple]] = [[] for _ in tiers]

    def add(self, piece: tuple) -> None:
        insort(self.pools[bisect_left(self.tiers, piece[0])], piece)

    def take_fitting(self, gap: int) -> tuple | None:
        """The longest piece of at most ``gap`` tokens."""
        for pool in self.pools[min(bisect_left(self.tiers, gap), len(self.tiers) - 1)::-1]:
            if i := bisect_right(pool, gap, key=lambda p: p[0]):
                return pool.pop(i - 1)
        return None

    def take_shortest(self, last_tier: int) -> tuple | None:
        return next((pool.pop(0) for pool in self.pools[:last_tier + 1] if pool), None)

    def pack(self) -> list[tuple[int, list[tuple]]]:
        """Full sequences (tier size, pieces), the longest tier first."""
        out = []
        for t in range(len(self.tiers) - 1, -1, -1):
            while self.pools[t]:
                seq, gap = [first := self.pools[t].pop()], self.tiers[t] - first[0]
                while gap:
                    piece = self.take_fitting(gap)
                    if piece is None:
                        piece = self.take_shortest(t)
                        if piece is None:
                            break
                        length, doc, start = piece
                        self.add((length - gap, doc, start + gap))
                        piece = (gap, doc, start)
                    seq.append(piece)
                    gap -= piece[0]
                if gap:                      # nothing is left to fill with: these wait
                    for piece in seq:
                        self.add(piece)
                    return out
                out.append((self.tiers[t], seq))
        return out

    def drain(self) -> list[tuple[int, list[tuple]]]:
        """The waiting pieces as sequences of power-of-two lengths, the longest first."""
        rest = sorted((p for pool in self.pools for p in pool), reverse=True)
        self.pools = [[] for _ in self.tiers]
        total, out = sum(p[0] for p in rest), []
        while total:
            size = min(1 << (total.bit_length() - 1), self.tiers[-1])
            seq, gap = [], size
            while gap:
                length, doc, start = rest.pop(0)
                if length > gap:
                    rest.insert(0, (length - gap, doc, start + gap))
                    length = gap
                seq.append((length, doc, start))
                gap -= length
            out.append((size, seq))
            total -= size
        return out


def step_groups(sequences: list[tuple[int, list[tuple]]], group: int) -> list[int]:
    """Group number per sequence: one tier per group, snake order of attention cost."""
    number, base = [0] * len(sequences), 0
    for size in sorted({s for s, _ in sequences}, reverse=True):
        mine = [i for i, (s, _) in enumerate(sequences) if s == size]
        mine.sort(key=lambda i: -sum(p[0] ** 2 for p in sequences[i][1]))
        n = -(-len(mine) // group)
        for k, i in enumerate(mine):
            lap, at = divmod(k, n)
            number[i] = base + (at if lap % 2 == 0 else n - 1 - at)
        base += n
    return number


def _pack_task(path: str, end_id: int, tiers: tuple[int, ...], chunk_tokens: int, group: int):
    window = tiers[-1]

    def emit(sequences, docs, ids_at, groups):
        if not sequences:
            return None
        number = step_groups(sequences, group)
        pieces = [(doc, start, length, ids_at[0] + s, size, ids_at[1] + number[s])
                  for s, (size, seq) in enumerate(sequences) for length, doc, start in seq]
        doc, start, length, seq, tier, step = (np.array(c, dtype=np.int64) for c in zip(*pieces, strict=True))
        first = np.concatenate(([True], seq[1:] != seq[:-1]))
        before = np.cumsum(length) - length
        ids = [docs[d][1][s:s + n] for d, s, n in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)]
        ends = np.concatenate(([0], np.cumsum(length))) * 4
        ids_at[0] += len(sequences)
        ids_at[1] += max(number) + 1
        return pa.record_batch({
            "doc_id": pa.array([docs[d][0] for d in doc.tolist()], pa.int64()),
            "start": pa.array(start), "length": pa.array(length),
            "doc_tokens": pa.array([len(docs[d][1]) for d in doc.tolist()], pa.int64()),
            "sequence_id": pa.array(seq), "offset": pa.array(before - before[np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))]),
            "tier": pa.array(tier.astype(np.int32)), "step_group": pa.array(step),
            "ids": pa.Array.from_buffers(pa.binary(), len(ids), [
                None, pa.py_buffer(ends.astype(np.int32).tobytes()),
                pa.py_buffer(np.concatenate(ids).astype("<u4").tobytes())])})

    def run(batches):
        encode = load_tokenizer(path)
        base = TaskContext.get().partitionId() << 33
        ids_at, pools, docs, sequences, held, serial = [base, base], TierPools(tiers), {}, [], 0, 0
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id))
                docs[serial] = (doc_id, ids)
                full = len(ids) // window * window
                sequences += [(window, [(window, serial, s)]) for s in range(0, full, window)]
                if len(ids) > full:
                    pools.add((len(ids) - full, serial, full))
                held, serial = held + len(ids), serial + 1
                if held >= chunk_tokens:
                    sequences += pools.pack()
                    if sequences:
                        yield emit(sequences, docs, ids_at, group)
                    waiting = {p[1] for pool in pools.pools for p in pool}
                    docs, sequences, held = {k: v for k, v in docs.items() if k in waiting}, [], 0
        sequences += pools.pack() + pools.drain()
        if sequences:
            yield emit(sequences, docs, ids_at, group)
    return run


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID,
         tiers: tuple[int, ...] = TIERS, chunk_tokens: int = CHUNK_TOKENS, group: int = GROUP) -> DataFrame:
    """One row per piece, with its token ids (unsigned 32-bit little-endian) in ``ids``.

    Every sequence has exactly ``tier`` tokens; ``tiers`` are powers of two, the last one is
    the window. ``tokenizer`` is the path of a byte-level BPE file that every executor can read.
    """
    if list(tiers) != sorted(tiers) or any(t & (t - 1) for t in tiers):
        raise ValueError("tiers must be ascending powers of two")
    src = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return src.mapInArrow(_pack_task(tokenizer, end_id, tuple(tiers), chunk_tokens, group), SCHEMA)
