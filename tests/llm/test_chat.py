import hashlib
import random
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cuelake.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string, window string, loss string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


@given(st.text(alphabet="\\<>/s[]INST a", max_size=60))
def test_escape(text):
    assert chat.unescape(chat.escape(text)) == text
    assert chat.read_turns(f"<s>[INST]{chat.escape(text)}[/INST]{chat.escape(text)}</s>") == [(text, text)]


def corpus():
    rng = random.Random(8)
    rows = []
    for c in range(40):
        first = 0
        if c % 3 == 0:
            rows.append((c, 0, "system", "be " * rng.randrange(1, 40)))
            first = 1
        for k in range(first, first + rng.choice([0, 1, 2, 5, 60])):
            text = rng.choice([None, "", "</s>", "<s>[INST]\\", "w " * rng.randrange(300), "[/INST] ok \\\\", "é" * 7])
            rows.append((c, k, rng.choice(["user", "assistant", "assistant", None, "</s>"]), text))
    rows += [(100, 1, "assistant", "twice"), (100, 1, "assistant", "twice"), (100, 1, "assistant", "a"), (101, None, "user", "no turn"), (None, 0, "assistant", "no id")]
    return rows


def digest(rows):
    rows = sorted((n if n is not None else -(10**9), r or "", t or "") for _, n, r, t in rows)
    turns = "".join(f"{r}\n{t}\n" for _, r, t in rows)
    loss = "".join(t for _, r, t in rows if r == "assistant")
    return len(rows), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def count(role, text):
    return 4 + len(re.findall(r"\w+|[^\w\s]", role)) + len(re.findall(r"\w+|[^\w\s]", text))


@pytest.mark.parametrize(("budget", "history", "stretch"), [(512, 128, 1024), (60, 20, 1024), (1, 0, 1024), (60, 20, 8)])
def test_round_trip(spark, monkeypatch, budget, history, stretch):
    monkeypatch.setattr(chat, "STRETCH", stretch)
    rows = corpus()
    random.Random(1).shuffle(rows)
    windows = chat.format_windows(table(spark, rows), budget, history).collect()
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(chat.format_windows(table(spark, rows), budget, history)).collect()}
    assert got == {c: digest([r for r in rows if r[0] == c]) for c in {r[0] for r in rows}}
    system = {c: t for c, n, r, t in rows if r == "system"}
    for w in windows:
        turns = chat.read_turns(w.text)
        assert len(turns) == w.n_turns and w.n_tokens == sum(count(*t) for t in turns)
        new = w.n_turns - w.n_repeated
        assert w.n_tokens <= budget or new == 1
        if w.conv_id in system:
            assert turns[0] == ("system", system[w.conv_id])
    assert budget > 500 or any(w.n_repeated > 1 for w in windows) or history == 0


def test_long_conversation_is_shared(spark, monkeypatch):
    """A stretch begins with the system turn and the history before it, as if one task had formatted all."""
    monkeypatch.setattr(chat, "STRETCH", 50)
    rows = [(7, 0, "system", "be kind"), *((7, k, "user" if k % 2 else "assistant", f"turn {k}") for k in range(1, 400))]
    windows = chat.format_windows(table(spark, rows), 100, 30).orderBy("stretch", "window").collect()
    assert {w.stretch for w in windows} == set(range(4)) and all(w.n_tokens <= 100 for w in windows)
    new = [t for w in windows for t in chat.read_turns(w.text)[w.n_repeated :]]
    assert new == [(r, t) for _, _, r, t in rows]
    for w in windows[1:]:
        turns = chat.read_turns(w.text)
        assert turns[0] == ("system", "be kind") and 3 < w.n_repeated < w.n_turns
        first = int(turns[1][1].split()[1])
        assert [t for _, t in turns[1:]] == [f"turn {k}" for k in range(first, first + w.n_turns - 1)]
    own = table(spark, rows).drop("window").withColumnRenamed("loss", "size").withColumn("size", F.lit(30))
    assert all(w.n_turns <= 3 for w in chat.format_windows(own, 100, 0, tokens="size").collect())


def test_windows_follow_order_not_turn_numbers(spark, monkeypatch):
    """Turn numbers k, 1000 k and time stamps give the same windows, over many stretches and ranges."""
    monkeypatch.setattr(chat, "STRETCH", 64)
    texts = [f"turn {k} " + "w " * (k * 7 % 40) for k in range(700)]
    made = []
    for number in (lambda k: k, lambda k: 1000 * k, lambda k: 1_700_000_000_000 + 61_000 * k):
        rows = [(c, number(k), "system" if k == 0 else "user" if k % 2 else "assistant", texts[k]) for c, n in ((1, 700), (2, 20), (3, 300)) for k in range(n)]
        random.Random(3).shuffle(rows)
        windows = chat.format_windows(table(spark, rows).repartition(5), 200, 20)
        made.append(sorted((r.conv_id, r.stretch, r.window, r.n_repeated, r.text) for r in windows.collect()))
    assert made[0] == made[1] == made[2]
    # A stretch has 80 turns, four times the history.
    assert max(r[1] for r in made[0] if r[0] == 1) == 8 and {r[1] for r in made[0] if r[0] == 2} == {0}


def test_empty(spark):
    assert chat.read_back(chat.format_windows(table(spark, []))).count() == 0
