"""Approximate nearest neighbours by an inverted multi-index.

The two halves of the vectors are quantised separately by centroids fitted with
k-means on a sample of at most ``SAMPLE`` vectors, those of the least hash of their
id. Every vector goes into the cell of its pair of centroids. A query walks over
pairs of centroids with a heap, in the order of the summed nearness of its halves to
them (the negative inner product as distance), until the cells hold enough vectors,
which are then ranked by exact inner products in double precision. A cell
holds about ``CELL`` vectors, more once there are ``MOST_CENTROIDS``. The heap holds the next
cell of each first centroid that the walk has opened, so it opens no more than it needs.

How many are enough is measured on the table itself: the true neighbours of at most
``PROBES`` queries are found by exact comparison with all vectors, and the walk goes
as far, ``candidates`` at least, as it takes to meet the share ``RECALL`` of them. So
the number grows with the table, up to all of it where the halves tell nothing.

The first centroid makes a region; a region of over ``CHUNK`` vectors is cut into
chunks, small regions share one. The walk ends at a summed nearness, and its cells are
all those at least as near; so a query is sent with this number, not with its cells,
and once to each chunk that holds a region it visits. A task holds one chunk, streams
the queries past it, and returns each query's best k of the cells that the walk met.

Equal vectors: equal rows count once. A result of k rows takes the smallest ids among
equal scores, so of equal vectors only the k + 1 of smallest id can be in any result;
the others are found in the same cell but need no ranking, and are left out before the
index by a window limit that runs before the shuffle.

Edge cases: vectors that are null, zero, of another length than most, or hold null
or non-finite components take no part; ties go to the smaller id; with fewer than
k other vectors all are returned; rows of equal id are never each other's
neighbours, and of the different vectors of one id the least, number by number, is the
query; cells as near as the last one are met too; rows with a null id take no part; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_stored, n_chunks, stored

SAMPLE = 20_000
MOST_CENTROIDS = 512
#: Vectors of a cell on average: a step of the heap takes about the time of so many comparisons.
CELL = 8
#: Vectors of a chunk, at most and (for tables of fewer chunks than tasks) at least.
CHUNK, LEAST = 50_000, 2_000
#: Queries whose true neighbours are found by exact comparison, and the share of these that the walk must meet.
PROBES = 200
RECALL = 0.95
#: Rows of a batch of visits, each with its query's vector.
VISITS = 2_000
RESULT = "query_id bigint, vec_id bigint, score double"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v: the vectors that take part."""
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(
        "vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x <> 0)"
    )
    common = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").first()
    return rows.where(F.size("v") == (common.n if common else 0))


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(11)
    distinct = np.unique(x, axis=0)
    c = distinct[rng.permutation(len(distinct))[:k]]
    for _ in range(rounds):
        near = ((c * c).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def nearness(v: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inner products of one vector's halves with the centroids, to the last bit the same in every task."""
    half = one.shape[1]
    return (one * v[:half]).sum(axis=1), (two * v[half:]).sum(axis=1)


def walk(near_1: np.ndarray, near_2: np.ndarray, sizes: list[list[int]], wanted: int) -> tuple[list[tuple[int, int]], float]:
    """Filled pairs of centroids in descending order of summed nearness, until they hold enough, and the last sum.

    Pairs with that same sum are all met.
    """
    order_1, order_2 = np.argsort(-near_1, kind="stable").tolist(), np.argsort(-near_2, kind="stable").tolist()
    a, b = near_1[order_1].tolist(), near_2[order_2].tolist()
    # One entry for each opened first centroid: its next pair.
    heap, found, held, last = [(-(a[0] + b[0]), 0, 0)], [], 0, 0.0
    while heap and (held < wanted or heap[0][0] == last):
        last, i, j = heap[0]
        if j + 1 < len(b):
            heapq.heapreplace(heap, (-(a[i] + b[j + 1]), i, j + 1))
        else:
            heapq.heappop(heap)
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (-(a[i + 1] + b[0]), i + 1, 0))
        n = sizes[order_1[i]][order_2[j]]
        if n:
            found.append((order_1[i], order_2[j]))
            held += n
    return found, -last


def deal(regions: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """First chunk and number of chunks of each region: large regions are cut, small neighbours share a chunk."""
    first, parts = np.zeros(len(regions), np.int64), np.maximum(1, -(-regions // most))
    chunk, held = 0, 0
    for p, n in enumerate(regions.tolist()):
        if held and held + n > most:
            chunk, held = chunk + 1, 0
        first[p] = chunk
        held += n
        if parts[p] > 1:
            chunk, held = chunk + int(parts[p]), 0
    return first, parts


def true_neighbours(index: DataFrame, ids: np.ndarray, x: np.ndarray, k: int) -> DataFrame:
    """probe, score, c1, c2: the best k of all vectors for each of the given queries, with their cells."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The best so far: a row for each place, a column for each query.
        score, c1, c2 = np.zeros((0, len(ids))), np.zeros((0, len(ids)), np.int32), np.zeros((0, len(ids)), np.int32)
        for b in batches:
            if not b.num_rows:
                continue
            new = matrix(b.column("v")) @ x.T
            new[b.column("vec_id").to_numpy()[:, None] == ids] = -np.inf
            score = np.vstack([score, new])
            c1, c2 = (np.vstack([old, np.broadcast_to(b.column(name).to_numpy()[:, None], new.shape)]) for old, name in ((c1, "c1"), (c2, "c2")))
            best = np.argsort(-score, axis=0, kind="stable")[:k]
            score, c1, c2 = (np.take_along_axis(a, best, 0) for a in (score, c1, c2))
        place, probe = np.nonzero(score > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(probe, pa.int32()), *(pa.array(a[place, probe]) for a in (score, c1, c2))], ["probe", "score", "c1", "c2"])

    best = Window.partitionBy("probe").orderBy(F.desc("score"), "c1", "c2")
    found = index.select("vec_id", "v", "c1", "c2").mapInArrow(compare, "probe int, score double, c1 int, c2 int")
    return found.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k).select("probe", "score", "c1", "c2")


def enough(near_1: np.ndarray, near_2: np.ndarray, sizes: np.ndarray, cells: list[list[tuple[int, int]]], share: float) -> int:
    """How many vectors the walks must hold to meet so large a share of the neighbours in the given cells."""
    needs = []
    for a, b, own in zip(near_1, near_2, cells, strict=True):
        near = (a[:, None] + b[None, :]).ravel()
        order = np.argsort(-near, kind="stable")
        held = np.cumsum(sizes.ravel()[order])
        ranked = -near[order]
        for p, q in own:
            # The vectors of all cells at least as near, so that ties can't cut a cell off.
            needs.append(int(held[np.searchsorted(ranked, -(a[p] + b[q]), "right") - 1]))
    needs.sort()
    return needs[math.ceil(share * len(needs)) - 1] if needs else 0


def search(vectors: DataFrame, query_every: int = 20, k: int = 20, candidates: int = 400) -> DataFrame:
    """query_id, rank, vec_id, score: for each vector whose id is divisible by query_every, its k nearest found.

    A query is compared with ``candidates`` vectors at least, and with as many more as the probes ask for.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    total = rows.count()
    if total == 0:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    n_centroids = int(min(MOST_CENTROIDS, max(1, math.sqrt(total / CELL))))
    # The sample's size is bounded by SAMPLE.
    sample = np.array([r.v for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()])
    half = max(1, sample.shape[1] // 2)
    one, two = kmeans(sample[:, :half], n_centroids), kmeans(sample[:, half:], n_centroids)

    # Equal rows first become one, so that the limit counts distinct ids.
    distinct = rows.groupBy("vec_id", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(3), "v").alias("h2")).agg(F.first("v").alias("v"))
    same = Window.partitionBy("h1", "h2").orderBy("vec_id")
    kept = distinct.withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= k + 1).select("vec_id", "v")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = matrix(b.column("v"))
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(nearest(x[:, :half], one), pa.int32()), pa.array(nearest(x[:, half:], two), pa.int32())], ["vec_id", "v", "c1", "c2"])

    # Stored, since the sizes of cells, the probes and the ranking all read it.
    index = stored(kept.mapInArrow(place, "vec_id bigint, v array<double>, c1 int, c2 int"), "index")
    # At most MOST_CENTROIDS squared counts.
    sizes = np.zeros((len(one), len(two)), np.int64)
    for r in index.groupBy("c1", "c2").count().collect():
        sizes[r.c1, r.c2] = r["count"]
    n_held = int(sizes.sum())
    first, parts = deal(sizes.sum(axis=1), -(-n_held // n_chunks(spark, n_held, CHUNK, LEAST)))
    # A fixed number of partitions: few bytes, but a long walk for each row.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    queries = rows.where(F.col("vec_id") % query_every == 0).repartition(tasks, "vec_id").groupBy("vec_id").agg(F.min("v").alias("v"))
    wanted = candidates + k + 1
    if wanted < sizes.sum():
        probes = queries.orderBy(F.xxhash64(F.lit(5), "vec_id")).limit(PROBES).collect()
        if probes:
            x = np.array([r.v for r in probes])
            cells: list[list[tuple[int, int]]] = [[] for _ in probes]
            # At most k rows for each of PROBES queries.
            for r in true_neighbours(index, np.array([r.vec_id for r in probes], np.int64), x, k).collect():
                cells[r.probe].append((r.c1, r.c2))
            wanted = max(wanted, enough(x[:, :half] @ one.T, x[:, half:] @ two.T, sizes, cells, RECALL))

    counts = sizes.tolist()

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, row, chunk, least = matrix(b.column("v")), [], [], []
            for n in range(len(x)):
                found, last = walk(*nearness(x[n], one, two), counts, wanted)
                mine = sorted({c for p in {p for p, _ in found} for c in range(first[p], first[p] + parts[p])})
                row += [n] * len(mine)
                chunk += mine
                least += [last] * len(mine)
                if len(row) >= VISITS or n == len(x) - 1:
                    at = pa.array(row, pa.int64())
                    yield pa.RecordBatch.from_arrays([b.column("vec_id").take(at), b.column("v").take(at), pa.array(chunk, pa.int32()), pa.array(least, pa.float64())], ["vec_id", "v", "chunk", "least"])
                    row, chunk, least = [], [], []

    visits = queries.mapInArrow(visit, "vec_id bigint, v array<double>, chunk int, least double")
    of_region = lambda values: F.element_at(F.array(*[F.lit(int(n)) for n in values]), F.col("c1") + 1)
    chunk = (of_region(first) + F.pmod(F.xxhash64("vec_id"), of_region(parts))).cast("int")
    entries = index.select(chunk.alias("chunk"), F.lit(0).alias("kind"), "c1", "c2", "vec_id", "v", F.lit(0.0).alias("least"))
    asked = visits.select("chunk", F.lit(1).alias("kind"), F.lit(-1).alias("c1"), F.lit(-1).alias("c2"), "vec_id", "v", "least")
    dealt = entries.unionByName(asked).repartition("chunk").sortWithinPartitions("chunk", "kind", "c1", "c2", "vec_id")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, vectors_here = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            kinds, x, ids = b.column("kind").to_numpy(), matrix(b.column("v")), b.column("vec_id").to_numpy()
            cell, least_near = b.column("c1").to_numpy() * len(two) + b.column("c2").to_numpy(), b.column("least").to_numpy()
            out_q, out_v, out_s = [], [], []
            for n, key in enumerate(b.column("chunk").to_pylist()):
                if key != here:
                    here, held, vectors_here = key, [], None
                if kinds[n] == 0:
                    held.append((cell[n], ids[n], x[n]))
                    continue
                if vectors_here is None:
                    own = np.array([h[1] for h in held], np.int64)
                    cells, in_cell = np.unique(np.array([h[0] for h in held], np.int64), return_counts=True)
                    cells_1, cells_2 = np.divmod(cells, len(two))
                    vectors_here = np.array([h[2] for h in held])
                    longest = np.sqrt((vectors_here * vectors_here).sum(axis=1).max()) if held else 0.0
                    held = [None]
                if not len(vectors_here):
                    continue
                near_1, near_2 = nearness(x[n], one, two)
                # Entries are sorted by cell.
                some = np.flatnonzero(np.repeat(near_1[cells_1] + near_2[cells_2] >= least_near[n], in_cell))
                some = some[own[some] != ids[n]]
                if len(some) > k:
                    # A fast product leaves out rows that lie under the k-th by more than its rounding.
                    rough = (vectors_here @ x[n])[some] if 4 * len(some) > len(own) else vectors_here[some] @ x[n]
                    least = np.partition(rough, len(some) - k)[len(some) - k] - 1e-14 * len(x[n]) * longest * np.sqrt((x[n] * x[n]).sum())
                    if np.isfinite(least):
                        some = some[rough >= least]
                if len(some):
                    # Row by row, so that equal vectors get equal scores in any chunk.
                    score = (vectors_here[some] * x[n]).sum(axis=1)
                    best = np.lexsort((own[some], -score))[:k]
                    out_q += [ids[n]] * len(best)
                    out_v += own[some][best].tolist()
                    out_s += score[best].tolist()
            if out_q:
                yield pa.RecordBatch.from_arrays([pa.array(out_q, pa.int64()), pa.array(out_v, pa.int64()), pa.array(out_s, pa.float64())], ["query_id", "vec_id", "score"])

    found = dealt.mapInArrow(rank, RESULT)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = stored(found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "neighbours")
    drop_stored(index)
    return out
