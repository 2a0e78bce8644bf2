"""Listing and housekeeping of files, hidden ones too, on a file system that driver and executors reach.

Spark's own readers skip names that begin with _ or a dot and hold a binary file whole, so folders are
listed and contents read by tasks here, through pyarrow's file systems (local or mounted
paths, or URIs of a store that pyarrow knows).
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import shared_folder, write_stage_tables

#: Suffixes of media files, and of transcripts.
MEDIA_SUFFIXES = (".aac", ".avi", ".flac", ".m4a", ".mkv", ".mov", ".mp3", ".mp4", ".ogg", ".wav", ".webm")
TRANSCRIPT_SUFFIXES = (".json",)
#: Bytes of a file that one task searches, and that are read at once.
RANGE, BLOCK = 64 << 20, 4 << 20
ENTRY = "path string, rel_path string, length bigint, is_folder boolean"


def opened(root: str) -> tuple[Any, str]:
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    if "://" in root and not root.startswith("file://"):
        return fs.FileSystem.from_uri(root)
    return fs.LocalFileSystem(), os.path.abspath(root.removeprefix("file://"))


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """path, rel_path, length of all files under root, or of the file root itself; contents are not read.

    Tasks list the folders of a level and give those of the next; the driver only hears whether there are any.
    Links to folders are not followed.
    """
    from pyarrow import fs

    system, top = opened(root)
    top = top.rstrip("/")
    about = system.get_file_info(top)
    if about.type == fs.FileType.NotFound:
        raise FileNotFoundError(root)
    if about.type == fs.FileType.File:
        return spark.createDataFrame([(top, top.rpartition("/")[2], about.size)], "path string, rel_path string, length bigint")

    def children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, _ = opened(root)
        for b in batches:
            for folder in b.column("path").to_pylist():
                found = system.get_file_info(fs.FileSelector(folder))
                for at in range(0, len(found), 10_000):
                    some = found[at : at + 10_000]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([x.path for x in some], pa.string()), pa.array([x.path[len(top) + 1 :] for x in some], pa.string()),
                            pa.array([x.size or 0 for x in some], pa.int64()), pa.array([x.type == fs.FileType.Directory and not linked(system, x.path) for x in some], pa.bool_()),
                        ],
                        ["path", "rel_path", "length", "is_folder"],
                    )

    work, depth, out = f"{shared_folder(spark)}/listing-{uuid.uuid4().hex}", 0, None
    level = spark.createDataFrame([(top,)], "path string")
    while True:
        listed = write_stage_tables(str(depth), level.mapInArrow(children, ENTRY), work)
        files = listed.where("NOT is_folder").select("path", "rel_path", "length")
        out = files if out is None else out.unionByName(files)
        folders = listed.where("is_folder")
        if folders.isEmpty():
            return out
        level, depth = folders.repartition("path").select("path"), depth + 1


def linked(system: Any, path: str) -> bool:
    from pyarrow import fs

    return isinstance(system, fs.LocalFileSystem) and os.path.islink(path)


def order_inputs(files: DataFrame) -> DataFrame:
    """Files by folded relative path, then path."""
    return files.orderBy(F.lower("rel_path"), "rel_path")


def discover_inputs(spark: SparkSession, root: str, suffixes: Sequence[str] = MEDIA_SUFFIXES + TRANSCRIPT_SUFFIXES) -> DataFrame:
    """Files whose suffix is one of suffixes, whatever its case, in order; none is an error."""
    suffix = F.lower(F.regexp_extract("rel_path", r"(\.[^./]+)$", 1))
    found = list_files(spark, root).where(suffix.isin(*[s.lower() for s in suffixes]))
    if found.isEmpty():
        raise FileNotFoundError(f"no input files under {root}")
    return order_inputs(found)


def kept(files: DataFrame, exclude: Sequence[str]) -> DataFrame:
    for part in exclude:
        if part:
            files = files.where(~F.contains("path", F.lit(part)))
    return files


def blocks(system: Any, path: str, start: int, end: int) -> Iterator[bytes]:
    """The bytes of a file from start to end, BLOCK at a time."""
    with system.open_input_file(path) as file:
        while start < end:
            found = file.read_at(min(BLOCK, end - start), start)
            if not found:
                return
            yield found
            start += len(found)


def file_checksums(spark: SparkSession, root: str, exclude: Sequence[str] = ()) -> DataFrame:
    """path, sha256 of each file, hidden ones too, sorted, without paths that contain an excluded part.

    A file is one stream of blocks in one task, of any size.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = opened(root)
        for b in batches:
            for path, length in zip(b.column("path").to_pylist(), b.column("length").to_pylist(), strict=True):
                sha = hashlib.sha256()
                for block in blocks(system, path, 0, length):
                    sha.update(block)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([sha.hexdigest()])], ["path", "sha256"])

    files = kept(list_files(spark, root), exclude).select("path", "length")
    return files.repartition("path").mapInArrow(digest, "path string, sha256 string").orderBy("path")


def secret_scan(spark: SparkSession, root: str, secrets: Sequence[str], exclude: str = "/configs/") -> DataFrame:
    """Paths of files, hidden ones too, that hold a secret, except in the excluded folder.

    Files are cut in ranges of RANGE bytes, each searched in a task of its own for all secrets at once by an
    Aho-Corasick automaton. A range is read on by the longest secret's length less one, and blocks carry as
    much over, so that a secret across an edge is found. Empty secrets are left out.
    """
    wanted = sorted({s.encode() for s in secrets if s})
    if not wanted:
        return spark.createDataFrame([], "path string")
    carry = max(map(len, wanted)) - 1

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        # Bytes as the first 256 characters, so that any file can be searched.
        automaton = ahocorasick.Automaton()
        for s in wanted:
            automaton.add_word(s.decode("latin-1"), 1)
        automaton.make_automaton()
        system, _ = opened(root)
        for b in batches:
            hits = []
            for path, start, end, length in zip(*(b.column(c).to_pylist() for c in ("path", "start", "end", "length")), strict=True):
                tail = ""
                for block in blocks(system, path, start, min(length, end + carry)):
                    text = tail + block.decode("latin-1")
                    if next(automaton.iter(text), None) is not None:
                        hits.append(path)
                        break
                    tail = text[len(text) - carry :] if carry else ""
            yield pa.RecordBatch.from_arrays([pa.array(hits, pa.string())], ["path"])

    files = kept(list_files(spark, root), [exclude]).where("length > 0")
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(RANGE).cast("bigint"))).alias("start"))
    ranges = ranges.select("path", "start", (F.col("start") + RANGE).alias("end"), "length")
    return ranges.repartition("path", "start").mapInArrow(search, "path string").distinct().orderBy("path")
