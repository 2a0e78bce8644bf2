"""The registered opN_ queries and the corpus pipeline against their contracts, on small tables with planted cases."""

import hashlib
import math
import os
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from cuelake.llm import bpe, decontam, linededup, nearjoin, queries, tokencount, toxicity

from .test_chat import digest
from .test_decontam import slow_leaks
from .test_katz import Model, tokens
from .test_nearjoin import brute as near_brute
from .test_nearjoin import shingles
from .test_pii import brute as pii_brute
from .test_tokencount import brute as count_brute

WORDS = [f"word{k}" for k in range(300)]
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, maybe string, kept string, was_null string, n_lines string, n_dropped string, text_id string, carried string, k string"
PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def planted():
    """Clean, toxic, copied, leaked, null and empty texts, and lines that many share."""
    rng = random.Random(17)
    some = lambda n: " ".join(rng.choices(WORDS, k=n))
    items = [(k, " ".join(f"item{k}x{j}" for j in range(30))) for k in range(5)]
    rows, marks = [], []
    for i in range(240):
        toxic = i % 6 == 0
        lines = [some(rng.randrange(5, 40)) for _ in range(rng.randrange(1, 4))]
        if toxic:
            lines.append(some(4) + " you blockhead rascal " + some(3))
        if i % 5 == 1:
            lines.insert(1, "  ALL rights reserved by the owner of this text ")
        if i % 40 == 7:
            lines.append(items[i // 40 % 5][1])
        if i % 10 == 3:
            lines.append(f"Write to jo{i}@site.example or 10.0.0.{i} or +1 555 010 {1000 + i}")
        rows.append((i, "\n".join(lines)))
        marks.append((i, 0, int(toxic)))
    for i in (11, 20, 31):
        rows += [(1000 + i, rows[i][1]), (2000 + i, rows[i][1] + " more")]
    rows += [(3000, None), (3001, ""), (3002, None), (None, some(12)), (11, rows[11][1])]
    return rows, marks, items


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    rows, marks, items = planted()
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), *"abcdefgh") for i, t in rows], DOCS).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    turns = [(c, k, ["system", "user", "assistant"][k] if k < 3 else "user", rng_text) for c in range(30) for k, rng_text in enumerate(["be kind", "</s> hi", "[INST] yes\\", None][: 1 + c % 4])]
    spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{d}/conversations.parquet")
    rng = random.Random(4)
    vectors = [(k, [rng.gauss(0, 1) for _ in range(8)] if k % 17 else None) for k in range(120)]
    spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
    return d


@pytest.fixture(scope="module")
def docs():
    return planted()[0]


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def test_op1(spark, tables, docs):
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
    seen = Counter(x for i, t in docs if not held(i) for x in tokens(t))
    got = queries.op1_katz_backoff(spark, tables)
    assert got.columns[:7] == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    want = Counter((i, held(i), len(tokens(t)), sum(x in seen for x in tokens(t)), sum(seen.values())) for i, t in docs)
    assert rows_of(got.select(*got.columns[:5])) == want
    model = Model([t for i, t in docs if not held(i)], 2)
    base = {x: math.log10((seen[x] + 1) / (sum(seen.values()) + len(seen) + 1)) for _, t in docs for x in tokens(t)}
    scores = sorted((-1 if i is None else i, sum(base[x] for x in tokens(t)), model.score(t)) for i, t in docs)
    for r, (i, b, s) in zip(sorted(got.collect(), key=lambda r: (-1 if r.doc_id is None else r.doc_id, r.base_score)), scores, strict=True):
        assert (-1 if r.doc_id is None else r.doc_id, r.base_score, r.score) == (i, pytest.approx(b), pytest.approx(s, rel=1e-9))


def ids_of(coder, text):
    ids = coder.encode_ordinary(text or "")
    return len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(text or "")


@pytest.fixture(scope="module")
def coder():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def test_op2(spark, tables, docs, coder):
    assert rows_of(queries.op2_byte_bpe(spark, tables)) == Counter((i, *ids_of(coder, t)) for i, t in docs)


def test_op3(spark, tables, docs):
    items = planted()[2]
    got = {(r.doc_id, r.item_id, r.covered_words) for r in queries.op3_decontamination(spark, tables).collect()}
    near = [(i, t) for i, t in docs if t and "item" in t]
    assert got == slow_leaks(near, items) and len(got) >= 6


def test_op4(spark, tables, docs):
    got = queries.op4_token_counts(spark, tables)
    scores = tokencount.load_pieces(queries.tokenizer_file("piece_bpe_32k.model"))
    pieces = {w: count_brute("▁" + w, scores) for w in {w for _, t in docs for w in (t or "").split()}}
    words = [(i, (t or "").split()) for i, t in docs]
    assert rows_of(got.select("doc_id", "n_pretokens", "n_tokens")) == Counter((i, len(x), sum(map(pieces.__getitem__, x))) for i, x in words)


def test_op5(spark, tables, tmp_path, docs):
    """Against the SQL on rows of different doc_id, and against dictionaries on all."""
    spark.read.parquet(f"{tables}/documents.parquet").where("doc_id <> 11").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert rows_of(queries.op5_line_dedup(spark, str(tmp_path))) == Counter(con.execute(queries.OP5_SQL).fetchall())
    got = queries.op5_line_dedup(spark, tables)
    assert rows_of(got.select("doc_id", "kept_sha256")) == Counter((i, sha(t or "")) for i, t in slow_lines(docs))


def test_op6(spark, tables, docs):
    """Classes, copies and links of all rows, repeated rows and ids included."""
    rows = [(i, t) for i, t in docs if i is not None]
    found = near_brute([(k, t) for k, (_, t) in enumerate(rows)])
    least, copies = {}, Counter(shingles(t) for _, t in rows)
    for k, (i, _) in enumerate(rows):
        least[found[k][0]] = min(i, least.get(found[k][0], i))
    want = Counter((i, least[found[k][0]], copies[shingles(t)] if shingles(t) else 1, found[k][1]) for k, (i, t) in enumerate(rows))
    want += Counter((i, i, 1, 0) for i, _ in docs if i is None)
    assert rows_of(queries.op6_ngram_jaccard_join(spark, tables).select("doc_id", "class_id", "n_copies", "n_links")) == want
    assert max(n for _, _, n, _ in want) > 1 and max(n for *_, n in want) > 1


def test_op7(spark, tables, docs):
    kinds = ["email", "ip", "card", "phone"]
    want = Counter()
    for i, t in docs:
        base = sorted(pii_brute(t or ""), key=lambda x: (x[1], kinds.index(x[0])))
        want[(i, *(sum(k == x[0] for x in base) for k in kinds), sha(",".join(f"{k}:{a}:{b}" for k, a, b in base)))] += 1
    got = queries.op7_pii(spark, tables)
    assert rows_of(got.select("doc_id", *(f"n_{k}" for k in kinds), "base_sha256")) == want
    for r in got.collect():
        spans = [(int(a), k) for k, a, _ in (x.split(":") for x in r.spans.split(",") if x)]
        assert spans == sorted(spans, key=lambda x: (x[0], kinds.index(x[1])))


def test_op8(spark, tables):
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{tables}/embeddings.parquet").collect() if r.embedding}
    got = defaultdict(list)
    for r in queries.op8_inverted_multi_index(spark, tables).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    for q in (i for i in rows if i % 20 == 0):
        want = sorted(((i, dot(rows[q], v)) for i, v in rows.items() if i != q), key=lambda x: (-x[1], x[0]))[:20]
        assert [i for i, _ in got[q]] == [i for i, _ in want] and [s for _, s in got[q]] == pytest.approx([s for _, s in want])
    assert set(got) == {i for i in rows if i % 20 == 0}


def test_op9(spark, tables):
    turns = [tuple(r) for r in spark.read.parquet(f"{tables}/conversations.parquet").collect()]
    turns += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    got = queries.op9_chat_windows(spark, tables)
    assert got.columns[:6] == ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    want = {c: digest([r for r in turns if r[0] == c]) for c in {r[0] for r in turns}}
    assert {r.conv_id: tuple(r)[1:5] for r in got.collect()} == want


def test_op10(spark, tables, docs):
    marks = dict((i, y) for i, _, y in planted()[1])
    got = queries.op10_toxicity(spark, tables).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [(r.predicted, marks[r.doc_id]) for r in got if r.held_out and r.doc_id in marks]
    assert len(held) > 20 and sum(p == y for p, y in held) >= 0.95 * len(held)


def slow_lines(rows):
    """Line dedup by dictionaries; rows of one doc_id are one document."""
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(-1 if i is None else i)
    out = []
    for i, t in rows:
        kept = [x for x in (t or "").split("\n") if not (len(holders.get(key(x), ())) >= 3 and max(holders[key(x)]) != (-1 if i is None else i))]
        out.append((i, None if t is None else "\n".join(kept)))
    return out


def test_pipeline(spark, tables, docs, coder):
    """Each stage against a brute-force version on its own input, then run() as a whole."""
    df = spark.read.parquet(f"{tables}/documents.parquet")
    marks = {i: y for i, _, y in planted()[1]}
    model = toxicity.fit(df, spark.read.parquet(f"{tables}/labels.parquet"))
    scores = {t: s for t, s in zip([t for _, t in docs], model.scorer().scores([t or "" for _, t in docs]), strict=True)}
    want = [(i, t) for i, t in docs if scores[t] < 0.5]
    caught = {i for i, _ in docs} - {i for i, _ in want}
    assert {i for i, y in marks.items() if y} <= caught and not any(marks.get(i, 0) == 0 for i in caught if i in marks)
    items = planted()[2]
    for (name, stage), brute in zip(
        corpus_pipeline.STAGES,
        [
            lambda rows: want,
            slow_lines,
            lambda rows: [(i, t) for i, t in rows if i is None or near_brute([x for x in dict.fromkeys(rows) if x[0] is not None])[i][0] == i],
            lambda rows: [(i, t) for i, t in rows if i not in {d for d, _, _ in slow_leaks([x for x in rows if "item" in (x[1] or "")], items)}],
            lambda rows: [(i, *ids_of(coder, t)) for i, t in rows],
        ],
        strict=True,
    ):
        before = [(r.doc_id, r.text) for r in df.collect()]
        out = stage(spark, df, tables)
        if name != "byte_bpe":
            assert out.columns == df.columns and all(tuple(r)[5:] == tuple("abcdefgh") for r in out.collect()), name
            got = Counter((r.doc_id, r.text) for r in out.collect())
            df = spark.createDataFrame(out.collect(), out.schema)
        else:
            got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out.collect())
        assert got == Counter(brute(before)), name
    whole = corpus_pipeline.run(spark, tables)
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in whole.collect()) == got


def test_pipeline_on_empty_tables(spark, tmp_path, tables):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tables}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_names_are_registered():
    assert [re.match(r"op(\d+)_", n)[1] for n in queries.QUERIES] == [str(k) for k in range(1, 14)]
    assert os.path.exists(PATH) and linededup and nearjoin and decontam
