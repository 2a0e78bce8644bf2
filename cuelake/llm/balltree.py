"""Ranked lexical search: exact largest inner products by sparse ball trees.

A document is a sparse vector of integer impacts, one for each of its terms, and an item one
of term weights; the score is their inner product. One pass over the documents counts
their terms and keeps those that pass a filter of 1 MB with the bits of all items' terms;
a term that passes by chance costs a little room and changes no score.

Documents are dealt in chunks of about ``CHUNK`` kept terms. A chunk's task builds a ball tree
over them: a node is split at the median of the projection on the line through
two far documents, and holds its centroid and the largest distance from it. Dimensions are
scaled by how rare a term is in the chunk, which the item's weights take back. For an item no
document of a node can score over

    q . centroid + |q restricted to the node's terms| * radius

since other terms of the item occur in none of them. Nodes are visited best first from a
heap until the best bound is under the k-th score; in leaves whole scores are added in 64-bit
integers. Bounds are doubles and are raised by far more than their rounding, so that
no document is lost; documents of equal score are all scored, since a bound must be
under the score to end the search. Items stream past the tree, and each chunk returns
its best k for each.

Edge cases: a null text has no terms; a document without terms counts nowhere and is never found; an
item without terms, or with none that a document holds, has no rows; equal items
count once, items of equal id with different texts are ranked apart; every row of documents is a
document of its own, also where ids repeat; a null doc_id comes before all others (and
-2^63 is taken for null); empty tables give an empty table; other columns are not read.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import FILTER_BITS, drop_stored, n_chunks, runs, slices, stored

#: Fixed value: what a term is made of, as UTF-8; all bytes of characters beyond ASCII are in it.
TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Bytes of a text that are counted at once.
PART = 1 << 20
#: Kept terms of a chunk, and below which it isn't cut further; documents of a leaf.
CHUNK, LEAST, LEAF = 1_000_000, 150_000, 24
NO_ID = -(1 << 63)
RESULT = "item_id bigint, item_text bigint, doc_id bigint, score bigint"


def count_terms(text: bytes) -> Counter:
    """Terms of a whole text with their numbers; only A-Z become small, as bytes.lower() does it."""
    counts: Counter = Counter()
    at = 0
    while at < len(text):
        end = at + PART
        while end < len(text) and TERM.match(text, end, end + 1):
            end += 1
        counts.update(TERM.findall(text[at:end].lower()))
        at = end
    return counts


def counted(rows: DataFrame, keys: str, bits: bytes | None = None) -> DataFrame:
    """The key columns, n (terms with repeats), terms (joined by spaces) and their numbers; with bits, only of terms whose bit is set."""
    names = [k.split()[0] for k in keys.split(", ")]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            n, terms, numbers = [], [], []
            for text in b.column("text").cast(pa.binary()):
                counts = count_terms(text.as_py() or b"")
                n.append(counts.total())
                kept = list(counts) if bits is None else [t for t in counts if bits[(h := zlib.crc32(t) % FILTER_BITS) >> 3] >> (h & 7) & 1]
                terms.append(b" ".join(kept).decode())
                numbers.append([counts[t] for t in kept])
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in names), pa.array(n, pa.int64()), pa.array(terms, pa.string()), pa.array(numbers, pa.list_(pa.int64()))], [*names, "n", "terms", "numbers"])

    return rows.mapInArrow(task, f"{keys}, n bigint, terms string, numbers array<bigint>")


def term_bits(terms: DataFrame) -> bytes:
    """FILTER_BITS bits, set for the checksums of the terms: 1 MB, however many terms there are."""
    bit, size = F.crc32(F.col("term").cast("binary")) % FILTER_BITS, 1 << 15
    maps = terms.select(bit.alias("bit")).groupBy(F.floor(F.col("bit") / size).cast("int").alias("map")).agg(F.bitmap_construct_agg(F.col("bit") % size).alias("bits"))
    out = bytearray(FILTER_BITS // 8)
    for r in maps.collect():  # 256 rows of 4 KB at most
        out[r["map"] * size // 8 : (r["map"] + 1) * size // 8] = bytes(r["bits"])
    return bytes(out)


class Ball:
    """A node: the range of its documents, a sparse centroid, a radius, and two children unless it is a leaf."""

    __slots__ = ("start", "end", "dims", "values", "radius", "kids")


class BallTree:
    """The ball tree of documents with impacts in rows [starts[i], starts[i + 1]) of dims and impacts."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray, dims: np.ndarray, impacts: np.ndarray, n_dims: int):
        self.n_dims = n_dims
        sizes = np.diff(starts)
        rarity = np.log((2 * len(ids) + 2) / (2 * np.bincount(dims, minlength=n_dims) + 1))
        self.scale = 0.1 + np.maximum(0.0, rarity)
        self.scaled = impacts * self.scale[dims]
        self.starts, self.dims, self.sizes = starts, dims, sizes
        self.squares = np.add.reduceat(self.scaled * self.scaled, starts[:-1])
        self.order = np.arange(len(ids))
        self.root = self.node(0, len(ids))
        todo = [self.root]
        while todo:
            todo.extend(self.split(todo.pop()))
        # Rows in the tree's order, so that a leaf is one stretch of them.
        at = self.entries(self.order)
        self.ids, self.dims, self.impacts = ids[self.order], dims[at], impacts[at]
        self.starts = np.r_[0, np.cumsum(sizes[self.order])]
        self.scored = 0
        del self.scaled, self.squares, self.order, self.sizes

    def entries(self, rows: np.ndarray) -> np.ndarray:
        sizes = self.sizes[rows]
        return np.repeat(self.starts[rows] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())

    def products(self, at: np.ndarray, sizes: np.ndarray, vector: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.scaled[at] * vector[self.dims[at]], np.r_[0, np.cumsum(sizes)[:-1]])

    def node(self, start: int, end: int) -> Ball:
        ball, rows = Ball(), self.order[start:end]
        at, sizes = self.entries(rows), self.sizes[rows]
        middle = np.bincount(self.dims[at], self.scaled[at], self.n_dims) / (end - start)
        square = float(middle @ middle)
        far = self.squares[rows] - 2 * self.products(at, sizes, middle) + square
        ball.start, ball.end, ball.kids = start, end, None
        ball.dims = np.flatnonzero(middle)
        ball.values = middle[ball.dims]
        ball.radius = float(np.sqrt(max(0.0, float(far.max())) + 1e-11 * (float(self.squares[rows].max()) + square)))
        if end - start > LEAF:
            first = rows[int(far.argmax())]
            to_first = self.products(at, sizes, self.dense(first))
            second = rows[int((self.squares[rows] - 2 * to_first).argmax())]
            along = to_first - self.products(at, sizes, self.dense(second))
            # Documents all alike can't be split, and needn't be.
            if along.max() > along.min():
                self.order[start:end] = rows[np.argsort(along, kind="stable")]
                ball.kids = ()
        return ball

    def dense(self, row: int) -> np.ndarray:
        out = np.zeros(self.n_dims)
        own = slice(self.starts[row], self.starts[row + 1])
        out[self.dims[own]] = self.scaled[own]
        return out

    def split(self, ball: Ball) -> tuple[Ball, ...]:
        if ball.kids is None:
            return ()
        half = (ball.start + ball.end) // 2
        ball.kids = self.node(ball.start, half), self.node(half, ball.end)
        return ball.kids

    def search(self, dims: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores over 0 of the k best documents for integer weights of some dimensions."""
        whole = np.zeros(self.n_dims, np.int64)
        whole[dims] = weights
        query = whole / self.scale

        def bound(ball: Ball) -> float:
            own = query[ball.dims]
            return (float(own @ ball.values) + ball.radius * float(np.sqrt(own @ own))) * (1 + 1e-9)

        ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        heap = [(-bound(self.root), 0, self.root)]
        least, nth = 1, 1
        while heap and -heap[0][0] >= least:
            ball = heapq.heappop(heap)[2]
            if ball.kids:
                for kid in ball.kids:
                    if (most := bound(kid)) >= least:
                        heapq.heappush(heap, (-most, nth, kid))
                        nth += 1
                continue
            self.scored += ball.end - ball.start
            lo, hi = self.starts[ball.start], self.starts[ball.end]
            found = np.add.reduceat(whole[self.dims[lo:hi]] * self.impacts[lo:hi], self.starts[ball.start : ball.end] - lo)
            some = np.flatnonzero(found >= least)
            if len(some):
                ids, scores = np.r_[ids, self.ids[ball.start : ball.end][some]], np.r_[scores, found[some]]
                best = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[best], scores[best]
                if len(ids) == k:
                    least = int(scores[-1])
        return ids, scores


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of highest score over 0 for each item, equal scores by doc_id."""
    spark = docs.sparkSession
    own = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    own = stored(counted(own.withColumn("item_text", F.xxhash64("text")), "item_id bigint, item_text bigint"), "items")
    pair = F.explode(F.arrays_zip(F.split("terms", " ").alias("term"), F.col("numbers").alias("number")))
    asked = own.where("n > 0").select("item_id", "item_text", pair.alias("x")).select("item_id", "item_text", "x.term", "x.number")
    names = asked.select("term").distinct()
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = stored(counted(rows, "doc_id bigint", term_bits(names)), "terms")
    seen = rows.agg(F.count_if(F.col("n") > 0).alias("n_docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_terms"), F.coalesce(F.sum(F.size("numbers")), F.lit(0)).alias("kept")).first()
    n_docs, n_terms = int(seen.n_docs), int(seen.n_terms)
    near = rows.where(F.size("numbers") > 0)
    chunks = n_chunks(spark, int(seen.kept), CHUNK, LEAST)

    # Terms are counted in tasks first, so that a term of all documents is one row of each.
    held = near.select(F.explode(F.split("terms", " ")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.ln((2 * F.lit(float(n_docs)) + 2) / (2 * F.col("df") + 1)))
    weighed = asked.join(names.join(held, "term"), "term").select("item_id", "item_text", F.struct("term", (weight * F.col("number")).cast("bigint").alias("weight")).alias("x"))
    queries = weighed.groupBy("item_id", "item_text").agg(F.sort_array(F.collect_list("x")).alias("x"))
    asking = queries.select(
        F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), F.lit(1).alias("kind"), F.col("item_id").alias("id"), F.col("item_text").alias("n"),
        F.array_join("x.term", " ").alias("terms"), F.col("x.weight").alias("numbers"),
    )
    number = F.pmod(F.xxhash64("doc_id", "n", "terms"), F.lit(chunks)).cast("int")
    indexed = near.select(number.alias("chunk"), F.lit(0).alias("kind"), F.col("doc_id").alias("id"), "n", "terms", "numbers")
    dealt = indexed.unionByName(asking).repartition("chunk").sortWithinPartitions("chunk", "kind", "id")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, parts, tree, names = None, [], None, {}
        for (chunk, kind), part in runs(batches, "chunk", "kind"):
            if chunk != here:
                here, parts, tree, names = chunk, [], None, {}
            terms = part.column("terms").cast(pa.binary())
            if kind == 0:
                # Numbers instead of terms at once, so that a chunk's texts don't add up.
                dims = np.array([names.setdefault(t, len(names)) for row in terms for t in row.as_py().split(b" ")], np.int32)
                numbers = part.column("numbers")
                n = part.column("n").to_numpy().astype(object)  # 25 * n * N may need more than 64 bits
                m = np.array([75 + 25 * x * n_docs // n_terms for x in n], np.int64)
                sizes = np.diff(numbers.offsets.to_numpy())
                tf = numbers.flatten().to_numpy()
                impacts = 1_000_000_000 * tf // (1000 * tf + 12 * np.repeat(m, sizes))
                parts.append((part.column("id").to_numpy(), sizes, dims, impacts))
                continue
            if tree is None and parts:
                ids, sizes, dims, impacts = (np.concatenate(x) for x in zip(*parts, strict=True))
                tree, parts = BallTree(ids, np.r_[0, np.cumsum(sizes)], dims, impacts, len(names)), []
            if tree is None:
                continue
            out_item, out_text, out_doc, out_score = [], [], [], []
            for item, text, words, weights in zip(part.column("id"), part.column("n"), terms, part.column("numbers"), strict=True):
                known = [(names[t], w) for t, w in zip(words.as_py().split(b" "), weights.as_py(), strict=True) if t in names]
                if not known:
                    continue
                ids, scores = tree.search(np.array([d for d, _ in known]), np.array([w for _, w in known], np.int64), k)
                out_item += [item.as_py()] * len(ids)
                out_text += [text.as_py()] * len(ids)
                out_doc.append(ids)
                out_score.append(scores)
            none = [np.zeros(0, np.int64)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(out_item, pa.int64()), pa.array(out_text, pa.int64()), pa.array(np.concatenate(out_doc or none)), pa.array(np.concatenate(out_score or none))],
                ["item_id", "item_text", "doc_id", "score"],
            )

    found = dealt.mapInArrow(task, RESULT)
    first = Window.partitionBy("item_id", "item_text").orderBy(F.desc("score"), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
    out = stored(ranked.select("item_id", "rank", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "score"), "ranking")
    drop_stored(own, rows)
    return out
