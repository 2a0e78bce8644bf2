import random

from cuelake.llm.linededup import dedup_lines

from .helpers import docs

BLANKS = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def brute(rows, min_chars=20, min_docs=3):
    held = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                held.setdefault(key(line), set()).add(i)
    common = {k: max(v) for k, v in held.items() if len(v) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (key(x) in common and common[key(x)] != i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def test_against_brute_force(spark):
    rng = random.Random(5)
    lines = [f"this is the common line no {k} of all" for k in range(6)] + ["short", "", "  Ärger ÜBER alles und mehr  ", "\x1cseparator stays in its key\x1c"]
    rows = [(i, "\n".join(rng.choice([x, x.upper(), f" {x}\r"]) for x in rng.choices(lines, k=rng.randrange(9)))) for i in range(60)]
    rows += [(70, None), (71, ""), (72, rows[3][1]), (72, rows[3][1]), (72, rows[5][1]), (73, "\n".join(lines * 400))]
    got = sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in dedup_lines(docs(spark, rows)).collect())
    assert got == brute(rows)


def test_native_and_empty(spark):
    out = dedup_lines(docs(spark, []))
    assert out.count() == 0
    assert "Python" not in out._jdf.queryExecution().toString() and "Arrow" not in out._jdf.queryExecution().toString()


def test_null_id(spark):
    line = "a line that is long enough to count"
    got = {r.doc_id: r.n_dropped for r in dedup_lines(docs(spark, [(None, line), (1, line), (2, line)])).collect()}
    assert got == {None: 1, 1: 1, 2: 0}


def test_hot_keys_join_apart(spark, monkeypatch, tmp_path):
    """Keys over the share are met in a small table, the others in a shuffle; the rows are those of a plain join."""
    from collections import Counter

    from cuelake.llm import common

    rows = [(k % 50 if k % 3 else 7, k) for k in range(600)] + [(99, 1), (None, 2)]
    df = spark.createDataFrame(rows, "key int, x int")
    sizes = Counter(k for k, _ in rows if k is not None and k != 99)
    keys = spark.createDataFrame([(k, n, f"p{k}") for k, n in sizes.items()], "key int, n bigint, payload string")
    want = Counter((k, x, sizes[k], f"p{k}") for k, x in rows if k in sizes)
    for hot in (1, 10, 2000):
        monkeypatch.setattr(common, "HOT", hot)
        assert Counter(map(tuple, common.hot_join(df, keys, ["key"], "n", ["x"]).collect())) == want
