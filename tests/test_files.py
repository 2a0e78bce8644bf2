"""Listing, checksums and secrets of all files, and writes that are whole or not there."""

import hashlib
import os

import pyarrow as pa
import pytest

from cuelake.sources import files, sinks

NAMES = ["plain.txt", ".env", "_log.txt", ".cfg/a.txt", "a/b/c/d.bin", "a b/%20#x.txt", "empty"]


@pytest.fixture
def tree(tmp_path):
    for k, name in enumerate(NAMES):
        path = tmp_path / "in" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"" if name == "empty" else b"x" * k + b" my-key \xff\x00" + name.encode())
    os.symlink(tmp_path / "in", tmp_path / "in" / "loop")
    return tmp_path / "in"


def test_all_files_are_listed_and_read(spark, tree):
    found = {r.rel_path: r.length for r in files.list_files(spark, str(tree)).where("rel_path <> 'loop'").collect()}
    assert found == {n: (tree / n).stat().st_size for n in NAMES}
    got = {r.path: r.sha256 for r in files.file_checksums(spark, f"file://{tree}", ["loop"]).collect()}
    assert got == {str(tree / n): hashlib.sha256((tree / n).read_bytes()).hexdigest() for n in NAMES}
    hits = [r.path for r in files.secret_scan(spark, str(tree), ["my-key", "", "nothing"], exclude="loop").collect()]
    assert hits == sorted(str(tree / n) for n in NAMES if n != "empty")
    assert files.secret_scan(spark, str(tree), ["", "nothing"], exclude="loop").collect() == []
    with pytest.raises(FileNotFoundError):
        files.list_files(spark, str(tree / "none"))


@pytest.mark.parametrize("at", [0, 95, 99, 100, 101, 197, 990])
def test_secrets_across_edges(spark, tmp_path, monkeypatch, at):
    """Ranges of 100 bytes, read in blocks of 7."""
    monkeypatch.setattr(files, "RANGE", 100)
    monkeypatch.setattr(files, "BLOCK", 7)
    for name, secret in (("here", b"s\xc3\xa9cret-key"), ("near", b"s\xc3\xa9cret-kex")):
        body = bytearray(os.urandom(1000).replace(b"s", b"t"))
        body[at : at + len(secret)] = secret
        (tmp_path / name).write_bytes(body)
    assert [r.path for r in files.secret_scan(spark, str(tmp_path), ["sécret-key", "x" * 30]).collect()] == [str(tmp_path / "here")]


def rows(spark, pairs):
    return spark.createDataFrame(pairs, "rel_path string, body string")


def names(root):
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, fs in os.walk(root) for f in fs)


def test_a_failing_write_leaves_nothing(spark, tmp_path):
    out = str(tmp_path / "out")
    pairs = [(f"{k}/f.txt", "x") for k in range(6)]
    with pytest.raises(Exception):
        sinks.write_documents(rows(spark, [*pairs, ("bad", None)]).repartition(7), out)
    assert not os.path.exists(out)
    sinks.write_documents(rows(spark, pairs), out)
    assert names(out) == sorted(p for p, _ in pairs)
    with pytest.raises(FileExistsError):
        sinks.write_documents(rows(spark, [("new.txt", "y"), ("3/f.txt", "y")]), out)
    assert names(out) == sorted(p for p, _ in pairs)
    sinks.write_documents(rows(spark, [("new.txt", "y"), ("3/f.txt", "y")]), out, overwrite="replace")
    assert len(names(out)) == 7 and (tmp_path / "out/3/f.txt").read_text() == "y"


@pytest.mark.parametrize("pair", [("c.txt", "x/../c.txt"), ("c.txt", "./c.txt"), ("a//b", "a/b")])
def test_one_path_written_in_two_ways(spark, tmp_path, pair):
    with pytest.raises(ValueError, match="one output path"):
        sinks.write_documents(rows(spark, [(pair[0], "1"), (pair[1], "2")]), str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()


def test_a_cut_short_commit_is_finished_by_the_next(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    whole = sinks.finish_documents
    monkeypatch.setattr(sinks, "finish_documents", lambda spark, out: 0)  # as if the driver died before the renames
    sinks.write_documents(rows(spark, [("a.txt", "1"), ("b/c.txt", "2")]), out)
    monkeypatch.setattr(sinks, "finish_documents", whole)
    staged = os.listdir(os.path.join(out, sinks.STAGING))
    assert len(staged) == 1 and not os.path.exists(os.path.join(out, "a.txt"))
    # One file got its name before a second failure.
    manifest = spark.read.parquet(os.path.join(out, sinks.STAGING, staged[0], sinks.MANIFEST)).where("rel_path = 'a.txt'").first()
    os.replace(manifest.temporary, os.path.join(out, "a.txt"))
    sinks.write_documents(rows(spark, [("d.txt", "3")]), out)
    assert names(out) == ["a.txt", "b/c.txt", "d.txt"] and sinks.finish_documents(spark, out) == 0


def test_few_bodies_are_in_a_worker_at_once(spark, tmp_path, monkeypatch):
    """Bodies come in small batches, whatever the session's size, and reach their files byte for byte."""
    from contextlib import contextmanager

    body = "a\r\nü漢😀  \n" * 50
    pairs = [(f"{k:04d}.txt", f"{k}{body}") for k in range(500)]
    seen, real = [], sinks.bodies_in_a_batch

    @contextmanager
    def watched(session):
        with real(session):
            sizes = session.range(500, numPartitions=1).mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in batches), "n bigint")
            seen.extend(r.n for r in sizes.collect())
            yield

    monkeypatch.setattr(sinks, "bodies_in_a_batch", watched)
    before = spark.conf.get(sinks.BATCH_ROWS)
    sinks.write_documents(rows(spark, pairs).coalesce(1), str(tmp_path / "out"))
    assert spark.conf.get(sinks.BATCH_ROWS) == before
    assert max(seen) == sinks.BODIES and sum(seen) == 500
    assert all((tmp_path / "out" / name).read_bytes() == text.encode() for name, text in pairs)
