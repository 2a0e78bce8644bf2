"""Helpers shared by the operators: stored stages, label splits and Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may do without (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found


#: With this setting Spark deletes a query's shuffle files once the query has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back, which cuts its lineage; its shuffle files go at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        writer.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def drop_stored(*tables: DataFrame) -> None:
    """Deletes stored tables that no later step reads."""
    for df in tables:
        delete(df.sparkSession, df.stored_at)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def crc_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of doc_id as text, modulo; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def texts(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id and whole text only, null text as empty, so that other columns can't clash."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def fresh(name: str, *tables: DataFrame) -> str:
    """The name, lengthened until no table has a column of that name, in any case."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Bits of the filter below: 256 maps of 4 KB, however many keys there are.
FILTER_BITS, MAP_BITS = 1 << 23, 1 << 15


def bit_of(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))


def bit_maps(keys: DataFrame, key: str) -> DataFrame:
    """map, bits: which bits of the filter the bigint column `key` sets; FILTER_BITS / MAP_BITS rows at most."""
    bits = keys.where(F.col(key).isNotNull()).select(bit_of(F.col(key)).alias("bit"))
    return bits.groupBy(F.floor(F.col("bit") / MAP_BITS).cast("int").alias("map")).agg(F.bitmap_construct_agg(F.col("bit") % MAP_BITS).alias("bits"))


def maybe_in(rows: DataFrame, value: Column, keys: DataFrame, key: str, mark: str) -> DataFrame:
    """Adds the column `mark`: false where the bigint value is surely not among the keys.

    A one-hash Bloom filter of 1 MB, built by an aggregate and sent to all tasks. It
    keeps wide rows that no key meets out of the shuffle of an exact join.
    """
    bit, number, bits = (fresh(x, rows) for x in ("filter_bit", "filter_map", "filter_bits"))
    maps = bit_maps(keys, key).withColumnsRenamed({"map": number, "bits": bits})
    placed = rows.withColumn(bit, bit_of(value)).withColumn(number, F.floor(F.col(bit) / MAP_BITS).cast("int"))
    joined = placed.join(F.broadcast(maps), number, "left")  # at most 256 rows of 4 KB
    at = (F.col(bit) % MAP_BITS).cast("int")
    byte = F.conv(F.hex(F.substring(F.col(bits), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.expr("1").bitwiseAND(F.call_function("shiftright", byte, (at % 8).cast("int"))) == 1, F.lit(False))
    return joined.withColumn(mark, hit).drop(bit, number, bits)


def text_key(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """What tells rows of documents apart: the id, and a hash of the text."""
    return doc_id.cast("bigint"), F.xxhash64(F.coalesce(text, F.lit("")))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose doc_id and text are not in gone(doc_id, text_id).

    Only rows that may be among them are shuffled. Columns of docs may have any names.
    """
    doc_id, text_id = text_key(F.col("doc_id"), F.col("text"))
    keys = gone.select("doc_id", "text_id", F.xxhash64("doc_id", "text_id").alias("k")).distinct()
    mark, a, b = (fresh(x, docs) for x in ("may_go", "gone_doc", "gone_text"))
    marked = maybe_in(docs, F.xxhash64(doc_id, text_id), keys, "k", mark)
    far, near = marked.where(~F.col(mark)).select(*docs.columns), marked.where(F.col(mark)).select(*docs.columns)
    named = keys.select(F.col("doc_id").alias(a), F.col("text_id").alias(b))
    return far.unionByName(near.join(named, (text_id == F.col(b)) & doc_id.eqNullSafe(F.col(a)), "left_anti"))


#: A key with over one in so many rows is hot, so that there are fewer hot keys than this.
HOT = 2000


def hot_join(rows: DataFrame, keys: DataFrame, on: list[str], weight: str, spread: list[str]) -> DataFrame:
    """The inner join of rows with keys, a stored table with one row for each value of `on` and the number of its rows in `weight`.

    Rows of hot keys meet their key in a table of under ``HOT`` rows that is sent to
    all tasks; in the shuffle that joins the others they are dealt by the columns `spread`.
    """
    total = keys.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    hot = keys.where(F.col(weight) > total / HOT)
    payload = [c for c in keys.columns if c not in on]
    h, c, salt = "hot_row", "cold_row", "salt"
    packed = lambda table, name: table.select(*on, F.struct(*payload).alias(name))
    marked = rows.join(F.broadcast(packed(hot, h)), on, "left")
    salted = marked.withColumn(salt, F.when(F.col(h).isNotNull(), F.xxhash64(*spread).bitwiseOR(F.lit(1))).otherwise(F.lit(0).cast("bigint")))
    cold = packed(keys.where(F.col(weight) <= total / HOT), c).withColumn(salt, F.lit(0).cast("bigint"))
    met = salted.join(cold, [*on, salt], "left").withColumn(h, F.coalesce(h, c)).where(F.col(h).isNotNull())
    return met.select(*rows.columns, *(F.col(f"{h}.{x}").alias(x) for x in payload))


_held: dict = {}


def worker_held(key: tuple, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps between tasks: one model with its cache. Another operator's goes first.

    Spark uses workers again for later stages, so that caches of several operators would add up.
    """
    if key not in _held:
        release_held()
        _held[key] = make()
    return _held[key]


def release_held() -> None:
    """Lets go of what earlier stages have left in this Python worker."""
    if _held:
        _held.clear()
        give_back()


def give_back() -> None:
    """Returns freed memory to the system; idle workers would keep it otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], chars: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about so many bytes of text, so that a task holds few decoded texts at a time."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // chars
        cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, int)
        for at, end in zip(cuts.tolist(), [*cuts[1:].tolist(), len(part)], strict=False):
            yield batch.slice(at, end - at)
    give_back()


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all bits of 64-bit keys; a bijection."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The batches of a sorted stream in stretches of equal values of the integer columns `keys`."""
    for batch in batches:
        values = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        if not batch.num_rows:
            continue
        moved = np.zeros(batch.num_rows, bool)
        moved[0] = True
        for v in values:
            moved[1:] |= v[1:] != v[:-1]
        starts = np.flatnonzero(moved).tolist()
        for at, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            yield tuple(int(v[at]) for v in values), batch.slice(at, end - at)


def n_chunks(spark: SparkSession, rows: int, most: int, least: int) -> int:
    """Chunks of `most` rows at most; smaller ones, not under `least`, while there are fewer than shuffle partitions."""
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-rows // most), min(partitions, rows // least))
