"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Each merge rank has a bucket with the linked-list positions whose pair has that
rank. A two-level bitmap says which buckets are in use; find-first-set on the
summary word and then on one leaf word gives the least rank. A position whose
pair has changed since it was queued is stale and skipped when it comes up. So a
pre-token of n bytes takes O(n log n), which matters for pre-tokens of many
thousand bytes.

Most pre-tokens are a few bytes long, and there Python's steps cost more than the merges. ``encode_texts`` so
takes the new pre-tokens of many texts at once: those of up to ``SHORT`` bytes have a row each in numpy arrays, with a
queue of the same kind (words of 64 bits in three levels), and each round takes the least rank of every row.

Texts of a Python worker share one cache from pre-token to its packed ids, of at
most ``CACHE_BYTES`` bytes; pre-tokens of over ``LONG`` characters are never kept. A
pre-token that is long itself needs memory in proportion to its bytes, in plain
arrays. ``round_trip`` encodes and decodes in one map, so that a task has one worker.

Edge cases: a null or empty text has no ids and decodes to no bytes; equal rows
give equal results; other columns are not read; an empty table gives an empty
table; a null doc_id stays null; null ids decode to no bytes.
"""

from __future__ import annotations

import base64
import struct
from array import array
from collections.abc import Iterator
from functools import cached_property, partial
from heapq import heappop, heappush
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts, worker_held

#: Bytes of the cache of one Python worker, and what an entry takes besides its characters and ids.
CACHE_BYTES, ENTRY_BYTES = 128_000_000, 200
#: Longer pre-tokens are not kept in the cache, and use arrays of machine integers.
LONG = 4096
#: Pre-tokens of so many bytes are merged side by side, so many at a time; texts of more characters are encoded by themselves.
SHORT, ROWS, WHOLE = 64, 2048, 1_000_000
LEAF_BITS = 8
LEAF_MASK = (1 << LEAF_BITS) - 1
BITS = [1 << k for k in range(1 << LEAF_BITS)]


def lowest_bit(words: np.ndarray) -> np.ndarray:
    """The place of the lowest bit that is set."""
    return np.bitwise_count((words & (~words + np.uint64(1))) - np.uint64(1)).astype(np.int64)


def bit(places: np.ndarray) -> np.ndarray:
    return np.uint64(1) << (places & 63).astype(np.uint64)


class RankQueues:
    """A hierarchical bitmap of ranks for each of ROWS rows: 64 bits a word, in three levels."""

    def __init__(self, width: int):
        self.leaves = np.zeros((ROWS, (width >> 6) + 1), np.uint64)
        self.summary = np.zeros((ROWS, (width >> 12) + 1), np.uint64)
        self.top = np.zeros((ROWS, (width >> 18) + 1), np.uint64)

    def add(self, rows: np.ndarray, ranks: np.ndarray) -> None:
        """One rank for each of some different rows."""
        self.leaves[rows, ranks >> 6] |= bit(ranks)
        self.summary[rows, ranks >> 12] |= bit(ranks >> 6)
        self.top[rows, ranks >> 18] |= bit(ranks >> 12)

    def in_use(self, rows: np.ndarray) -> np.ndarray:
        return rows[self.top[rows].any(axis=1)]

    def least(self, rows: np.ndarray) -> np.ndarray:
        at = (self.top[rows] != 0).argmax(axis=1)
        for level in (self.top, self.summary, self.leaves):
            at = (at << 6) + lowest_bit(level[rows, at])
        return at

    def remove(self, rows: np.ndarray, ranks: np.ndarray) -> None:
        for level in (self.leaves, self.summary, self.top):
            left = level[rows, ranks >> 6] & ~bit(ranks)
            level[rows, ranks >> 6] = left
            rows, ranks = rows[left == 0], ranks[left == 0] >> 6


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file has one base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern)
        self.bytes_of = [ranks[bytes([b])] for b in range(256)]
        self.width = max(ranks.values()) + 1
        #: The bytes of each id, None for ids that no token has.
        self.tokens: list[bytes | None] = [None] * self.width
        for t, i in ranks.items():
            self.tokens[i] = t
        #: The queue: positions by rank, and bits of the ranks in use; empty between pre-tokens.
        self.buckets: dict[int, list[int]] = {}
        self.leaves = [0] * ((self.width >> LEAF_BITS) + 1)
        outer = self

        class Cache(dict):
            """Packed ids by pre-token, in two generations of CACHE_BYTES / 2: what the older one still serves moves up."""

            older: dict[str, bytes] = {}
            room = CACHE_BYTES // 2

            def __missing__(self, piece: str) -> bytes:
                out = self.older.get(piece)
                if out is None:
                    ids = outer.encode_piece(piece.encode())
                    out = struct.pack(f"<{len(ids)}I", *ids)
                return self.keep(piece, out)

            def keep(self, piece: str, out: bytes) -> bytes:
                if len(piece) <= LONG:
                    self.room -= ENTRY_BYTES + 4 * len(piece) + len(out)
                    if self.room < 0:
                        self.older, self.room = dict(self), CACHE_BYTES // 2
                        self.clear()
                    self[piece] = out
                return out

        self.cache = Cache()

    @cached_property
    def merge(self) -> dict[int, int]:
        """(left, right) ids to the id of their concatenation, which is the rank of that merge; decoding needs none."""
        ranks = self.ranks
        return {ranks[t[:i]] * self.width + ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}

    def encode_piece(self, piece: bytes) -> list[int]:
        """Merges one pre-token. The queue is written out here, since most pre-tokens are a few bytes long."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        width, merge, leaves, buckets = self.width, self.merge.get, self.leaves, self.buckets
        n = len(piece)
        held = list if n <= LONG else partial(array, "i")
        ids = held([self.bytes_of[b] for b in piece] if n <= LONG else map(self.bytes_of.__getitem__, piece))
        after, before = held(range(1, n + 1)), held(range(-1, n - 1))
        #: The rank of the pair that begins at each position, -1 for none.
        pair = held(merge(a * width + b, -1) for a, b in pairwise(ids))
        pair.append(-1)
        summary = 0
        for i, rank in enumerate(pair):
            if rank >= 0:
                if rank in buckets:
                    buckets[rank].append(i)  # ascending, so a heap
                else:
                    buckets[rank] = [i]
                    leaves[rank >> LEAF_BITS] |= BITS[rank & LEAF_MASK]
                    summary |= 1 << (rank >> LEAF_BITS)
        while summary:
            # Find-first-set on the summary, then on its leaf: the least rank in use.
            leaf = (summary & -summary).bit_length() - 1
            word = leaves[leaf]
            rank = (leaf << LEAF_BITS) + (word & -word).bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                del buckets[rank]
                word &= word - 1
                leaves[leaf] = word
                if not word:
                    summary &= summary - 1
            if pair[i] != rank:
                continue  # stale
            j = after[i]
            k = after[j]
            ids[i], ids[j], pair[j], after[i] = rank, -1, -1, k
            if k < n:
                before[k] = i
                found = merge(rank * width + ids[k], -1)
            else:
                found = -1
            pair[i] = found
            h = before[i]
            left = merge(ids[h] * width + rank, -1) if h >= 0 else -1
            for found, at in ((found, i), (left, h)):
                if at == h and h >= 0:
                    pair[h] = left
                if found >= 0:
                    if found in buckets:
                        heappush(buckets[found], at)
                    else:
                        buckets[found] = [at]
                        leaves[found >> LEAF_BITS] |= BITS[found & LEAF_MASK]
                        summary |= 1 << (found >> LEAF_BITS)
        return [x for x in ids if x >= 0]

    @cached_property
    def merge_arrays(self) -> tuple[np.ndarray, np.ndarray, RankQueues]:
        """The pairs of `merge` in order with their ranks, and empty queues. The last pair stands for none."""
        pairs = np.fromiter(self.merge.keys(), np.int64, len(self.merge))
        order = np.argsort(pairs)
        ranks = np.fromiter(self.merge.values(), np.int64, len(self.merge))
        none = np.iinfo(np.int64).max
        return np.append(pairs[order], none), np.append(ranks[order], -1), RankQueues(self.width)

    def encode_short(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of at most ROWS pre-tokens of few bytes, all merged side by side."""
        keys, ranks, queues = self.merge_arrays
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        n = int(lengths.max())
        # Places without a token, and one place more at the end of each row, hold an id that no pair has.
        none = np.int64(1) << 40
        held = np.frombuffer(b"".join(p.ljust(n + 1, b"\0") for p in pieces), np.uint8).reshape(len(pieces), n + 1)
        ids = np.array(self.bytes_of, np.int64)[held]
        ids[np.arange(n + 1) >= lengths[:, None]] = none

        def rank_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            pair = np.where((a == none) | (b == none), -1, a * self.width + b)
            at = np.searchsorted(keys, pair)
            return np.where(keys[at] == pair, ranks[at], -1)

        every = np.arange(len(pieces))
        after = np.tile(np.minimum(np.arange(1, n + 2), n), (len(pieces), 1))
        before = np.tile(np.where(np.arange(n + 1) == 0, n, np.arange(-1, n)), (len(pieces), 1))
        pair = np.full(ids.shape, -1, np.int64)
        pair[:, :n] = rank_of(ids[:, :n], ids[:, 1:])
        for column in pair.T[:n]:
            queues.add(every[column >= 0], column[column >= 0])
        rows = queues.in_use(every)
        while len(rows):
            least = queues.least(rows)
            places = pair[rows] == least[:, None]
            times, i = places.sum(axis=1), places.argmax(axis=1)
            queues.remove(rows[times < 2], least[times < 2])  # the last place, or a stale rank
            met, i, rank = rows[times > 0], i[times > 0], least[times > 0]
            j = after[met, i]
            k, h = after[met, j], before[met, i]
            ids[met, i], ids[met, j], pair[met, j] = rank, none, -1
            after[met, i], before[met, k] = k, i
            for at, found in ((i, rank_of(rank, ids[met, k])), (h, rank_of(ids[met, h], rank))):
                pair[met, at] = found
                queues.add(met[found >= 0], found[found >= 0])
            rows = queues.in_use(rows)
        kept = ids != none
        packed, ends = ids[kept].astype("<u4").tobytes(), 4 * np.cumsum(kept.sum(axis=1))
        return [packed[a:b] for a, b in pairwise([0, *ends.tolist()])]

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """The same as encode of each text; the new pre-tokens of all texts are merged together."""
        split = [self.split.findall(t) if len(t) <= WHOLE else None for t in texts]
        found, short = {}, []
        for piece in set(chain.from_iterable(s for s in split if s)):
            if piece in self.cache or piece in self.cache.older:
                found[piece] = self.cache[piece]
            else:
                coded = piece.encode()
                if 1 < len(coded) <= SHORT and coded not in self.ranks:
                    short.append((len(coded), piece, coded))
                else:
                    found[piece] = self.cache[piece]
        short.sort()  # rows of about equal length
        for at in range(0, len(short), ROWS):
            part = short[at : at + ROWS]
            for (_, piece, _), out in zip(part, self.encode_short([p[2] for p in part]), strict=True):
                found[piece] = self.cache.keep(piece, out)
        return [self.encode(t) if s is None else b"".join(map(found.__getitem__, s)) for t, s in zip(texts, split, strict=True)]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if len(text) <= LONG * LONG:
            return b"".join(map(self.cache.__getitem__, self.split.findall(text)))
        return b"".join(self.cache[m[0]] for m in self.split.finditer(text))  # no list of all pre-tokens

    def decode(self, packed: bytes) -> bytes:
        """The bytes of little-endian ids; an id of no token is an error."""
        return b"".join(map(self.tokens.__getitem__, memoryview(packed).cast("I")))


def model(path: str, pattern: str) -> ByteBpe:
    """One model and cache for each Python worker."""
    return worker_held(("bpe", path, pattern), lambda: ByteBpe(load_ranks(path), pattern))


def encode(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids: the ids of each whole text, packed as little-endian unsigned 32-bit integers.

    rank_path names a rank file that every executor can open.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(rank_path, pattern)
        for batch in slices(batches):
            ids = bpe.encode_texts(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return texts(docs).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids binary")


def decode(encoded: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded: the bytes that the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(rank_path, pattern)
        for batch in batches:
            out = [bpe.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "decoded"])

    rows = encoded.select("doc_id", "n_tokens", F.coalesce("ids", F.lit(b"")).alias("ids"))
    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids binary, decoded binary")


def round_trip(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded of each whole text: encode, then decode from the ids, in the same task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(rank_path, pattern)
        for batch in slices(batches):
            ids = bpe.encode_texts(batch.column("text").to_pylist())
            out = [bpe.decode(x) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(out, pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])

    return texts(docs).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids binary, decoded binary")
