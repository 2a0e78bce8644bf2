"""Hard negatives by exact integer scores, looked up in tables of subset sums (Four Russians).

Components become integers, floor(256 x). Those of a candidate are cut into bit planes
of the two's complement, and eight dimensions of a plane make one byte. For an anchor
and a group of eight dimensions a table holds the sums of all 256 subsets of its
components; a candidate's byte picks the sum of the dimensions that are set in the
plane. The sums over groups are added from the top plane down, doubling in between, and
the top plane counts negatively, which gives the whole inner product exactly: 64
multiplications become one lookup for each byte of the candidate.

Candidates are dealt in chunks by a hash of their id. A task holds the packed bytes of one chunk
(some 100 bytes a row of 64 numbers) and streams anchors past it, ``BLOCK`` at a time,
and returns the best of each. That is done twice: first every anchor meets the rows of its
own label, which gives its positives; then it meets the rows of other labels, whose scores
must lie in the range below each positive. A label that holds most rows is dealt to
all chunks like any other.

Edge cases: rows with a null id or label, or a vector that is null, holds null or
non-finite components, or has another length than most, take no part; nor do rows with a
component so large that products could leave 64 bits (``limit``: 65,536 for 64
dimensions). Zero vectors take part. Rows of equal id are one row, that of the smallest
label, then of the smallest vector. Equal scores go to the smaller id. An anchor without
other rows of its label has no positives, a positive without rows in range has no
negatives, and neither is in the result; an empty table gives an empty table. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_stored, n_chunks, runs, stored

#: Rows of a chunk, and rows below which a chunk isn't cut further.
CHUNK, LEAST = 200_000, 2_000
#: Anchors whose tables stand in memory together, and candidates scored at once.
BLOCK, SLICE = 64, 2_048
RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def limit(dimensions: int) -> int:
    """Integers must stay below this, so that 100 times a score fits 64 bits."""
    return 1 << ((55 - int(dimensions).bit_length()) // 2)


def usable(vectors: DataFrame, label: Column) -> DataFrame:
    """vec_id, label, q (array of bigint): one row for each id that takes part."""
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), label.cast("bigint").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))")
    common = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").first()
    n = common.n if common else 0
    small = rows.where((F.size("v") == n) & F.forall("v", lambda x: F.abs(x) * 256 < limit(n) - 1))
    whole = small.select("vec_id", F.struct("label", F.transform("v", lambda x: F.floor(x * 256).cast("bigint")).alias("q")).alias("row"))
    return whole.groupBy("vec_id").agg(F.min("row").alias("row")).select("vec_id", "row.label", "row.q")


def planes_of(x: np.ndarray, n_planes: int) -> np.ndarray:
    """Bytes [row, plane, group] of integers [row, dimension]; the last plane is the sign's."""
    x = np.pad(x, ((0, 0), (0, -x.shape[1] % 8)))
    out = np.empty((len(x), n_planes, x.shape[1] // 8), np.uint8)
    for p in range(n_planes):
        out[:, p] = np.packbits(((x >> p) & 1).astype(np.uint8), axis=1, bitorder="little")
    return out


def subset_sums(anchors: np.ndarray, kind: type) -> np.ndarray:
    """Tables [group, byte, anchor]: the sum of the components whose bits are set in the byte."""
    anchors = np.pad(anchors, ((0, 0), (0, -anchors.shape[1] % 8))).astype(kind)
    tables = np.zeros((anchors.shape[1] // 8, 256, len(anchors)), kind)
    for group in range(len(tables)):
        for i in range(8):
            np.add(tables[group, : 1 << i], anchors[:, 8 * group + i], out=tables[group, 1 << i : 2 << i])
    return tables


def scores(planes: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Inner products [candidate, anchor] of candidates' bytes [plane, group, candidate] with the anchors of the tables."""
    out = np.empty((planes.shape[2], tables.shape[2]), tables.dtype)
    for at in range(0, len(out), SLICE):
        part = planes[:, :, at : at + SLICE]
        total, found = out[at : at + SLICE], np.empty_like(out[at : at + SLICE])
        for p in range(len(planes) - 1, -1, -1):
            if p == len(planes) - 1:
                total[:] = 0
            else:
                np.left_shift(total, 1, out=total)
            change = np.subtract if p == len(planes) - 1 else np.add
            for group in range(len(tables)):
                np.take(tables[group], part[p, group], axis=0, out=found, mode="clip")
                change(total, found, out=total)
    return out


def best(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest, largest first; equal ones by place."""
    if len(score) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        above = np.flatnonzero(score > least)
        some = np.r_[above, np.flatnonzero(score == least)[: k - len(above)]]
        some.sort()
    else:
        some = np.arange(len(score))
    return some[np.argsort(-score[some], kind="stable")]


class Chunk:
    """The packed candidates of a chunk, by label and id."""

    def __init__(self, parts: list[pa.RecordBatch], n_planes: int):
        self.ids = np.concatenate([b.column("vec_id").to_numpy() for b in parts]) if parts else np.zeros(0, np.int64)
        self.labels = np.concatenate([b.column("label").to_numpy() for b in parts]) if parts else np.zeros(0, np.int64)
        packed = np.frombuffer(b"".join(x for b in parts for x in b.column("planes").to_pylist()), np.uint8)
        self.planes = np.ascontiguousarray(packed.reshape(len(self.ids), n_planes, -1).transpose(1, 2, 0)) if parts else None

    def of_label(self, label: int) -> slice:
        return slice(*np.searchsorted(self.labels, [label, label + 1]).tolist())


def mine(
    vectors: DataFrame, label: Column | None = None, anchor_every: int = 100, n_positives: int = 5, n_negatives: int = 5, share: tuple[int, int] = (80, 100)
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by anchor_every; an anchor's positives are
    its best n_positives rows of its label; a positive's negatives are the best n_negatives rows
    of other labels with share[0] * positive_score <= share[1] * negative_score <= share[1] * positive_score.
    """
    spark = vectors.sparkSession
    rows = stored(usable(vectors, F.col("label") if label is None else label), "integers")
    seen = rows.agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("q", lambda x: F.greatest(x, -x - 1)))).alias("most"), F.max(F.size("q")).alias("size")).first()
    if not seen.n:
        drop_stored(rows)
        return spark.createDataFrame([], RESULT)
    n_planes = int(seen.most).bit_length() + 1
    kind = np.int32 if seen["size"] << 2 * n_planes < 1 << 31 else np.int64
    chunks = n_chunks(spark, seen.n, CHUNK, LEAST)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column("q").flatten().to_numpy().reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array([p.tobytes() for p in planes_of(x, n_planes)], pa.binary())], ["vec_id", "label", "planes"])

    packed = stored(rows.mapInArrow(pack, "vec_id bigint, label bigint, planes binary"), "planes")
    anchors = rows.where(F.col("vec_id") % anchor_every == 0)
    nothing = {"planes": F.lit(None).cast("binary"), "q": F.lit(None).cast("array<bigint>"), "positives": F.lit(None).cast("array<struct<id: bigint, score: bigint>>")}
    columns = ["chunk", "kind", "label", "vec_id", *nothing]

    def side(table: DataFrame, chunk: Column, kind: int) -> DataFrame:
        return table.withColumns({"chunk": chunk, "kind": F.lit(kind), **{c: x for c, x in nothing.items() if c not in table.columns}}).select(*columns)

    def meet(asked: DataFrame, run, schema: str) -> DataFrame:
        """run(chunk, anchors) for each chunk and stretch of at most BLOCK anchors."""
        candidates = side(packed, F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).cast("int"), 0)
        asking = side(asked, F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))), 1)
        dealt = candidates.unionByName(asking).repartition("chunk").sortWithinPartitions("chunk", "kind", "label", "vec_id")

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            here, parts, chunk = None, [], None
            for (number, what), part in runs(batches, "chunk", "kind"):
                if number != here:
                    here, parts, chunk = number, [], None
                if what == 0:
                    parts.append(part)
                    continue
                if chunk is None:
                    chunk, parts = Chunk(parts, n_planes), []
                for at in range(0, part.num_rows if len(chunk.ids) else 0, BLOCK):
                    yield run(chunk, part.slice(at, BLOCK))

        return dealt.mapInArrow(task, schema)

    def tables_of(part: pa.RecordBatch) -> np.ndarray:
        return subset_sums(part.column("q").flatten().to_numpy().reshape(part.num_rows, -1), kind)

    def positives(chunk: Chunk, part: pa.RecordBatch) -> pa.RecordBatch:
        ids, out = part.column("vec_id").to_numpy(), ([], [], [])
        # Anchors come sorted by label.
        for (same,), own in runs(iter([part]), "label"):
            where = chunk.of_label(same)
            found = scores(chunk.planes[:, :, where], tables_of(own))
            ids = own.column("vec_id").to_numpy()
            for n in range(len(ids)):
                # One row more, since the anchor may be among them.
                some = best(found[:, n], n_positives + 1)
                some = some[chunk.ids[where][some] != ids[n]][:n_positives]
                for values, new in zip(out, ([ids[n]] * len(some), chunk.ids[where][some], found[some, n]), strict=True):
                    values.extend(new)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["anchor_id", "positive_id", "positive_score"])

    def negatives(chunk: Chunk, part: pa.RecordBatch) -> pa.RecordBatch:
        found, out = scores(chunk.planes, tables_of(part)), ([], [], [], [], [])
        low, high = share
        for n, (anchor, same, wanted) in enumerate(zip(*(part.column(c).to_pylist() for c in ("vec_id", "label", "positives")), strict=True)):
            score = found[:, n].astype(np.int64)
            inside = (high * score >= low * min(p["score"] for p in wanted)) & (score <= max(p["score"] for p in wanted))
            inside[chunk.of_label(same)] = False
            some = np.flatnonzero(inside)
            some = some[np.argsort(chunk.ids[some], kind="stable")]
            for p in wanted:
                mine_ = some[(high * score[some] >= low * p["score"]) & (score[some] <= p["score"])]
                mine_ = mine_[best(score[mine_], n_negatives)]
                for values, new in zip(out, ([anchor] * len(mine_), [p["id"]] * len(mine_), chunk.ids[mine_], [p["score"]] * len(mine_), score[mine_]), strict=True):
                    values.extend(new)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])

    first = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    near = meet(anchors, positives, "anchor_id bigint, positive_id bigint, positive_score bigint")
    near = near.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= n_positives)
    lists = near.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_list(F.struct(F.col("positive_id").alias("id"), F.col("positive_score").alias("score")))).alias("positives"))
    asked = stored(anchors.join(lists, "vec_id"), "positives")
    first = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    hard = meet(asked, negatives, "anchor_id bigint, positive_id bigint, negative_id bigint, positive_score bigint, negative_score bigint")
    hard = hard.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= n_negatives)
    out = stored(hard.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives")
    drop_stored(rows, packed, asked)
    return out
