"""Toxicity by a subsequence string kernel, Nyström landmarks and a linear support vector machine.

Two words are compared by the gap-weighted subsequence kernel: all common
subsequences of ``ORDER`` characters, each weighted by ``DECAY`` to the power of
the span that it takes in either word. So an insult with inserted or left-out
characters stays near its plain form. Characters between letters of a token
("i.d.i.o.t") are removed, runs of spaced-out single characters are joined, and a
mark stands before each word's first character.

Landmarks are all word stems of labelled training texts that tell toxic from other
texts better than chance does: than the best stem under shuffled labels, the median
of ``SHUFFLES`` of them. Their number has no other bound; time grows with it. The
kernel of a sentence with a landmark is the largest of its words'; a text is
described by the largest, the mean and the dampened sum over its sentences. The
Nyström map, K_mm^(-1/2), turns each of these into coordinates in which a linear
machine with squared hinge loss is trained; a logistic curve turns its margin into
a probability.

Training reads at most ``TRAIN_ROWS`` labelled rows, those of the least hash of
doc_id. Of near copies with one label, by MinHash signatures, one row trains, since the
words of a text that was copied would stand out by chance otherwise. Tasks compute
signatures, count stems and compute features; the driver gets these for the rows, their
labels, and the stems over chance with the rows that hold them, never a text. Scoring is
a map over whole texts.

Edge cases: null and empty texts have no sentences and get the score of a text
without hits; rows with a null label do not train; labels of one class alone give
a constant score; repeated labels count as toxic if one is; equal training rows
count once; equal rows get equal scores; tokens of over ``PIECE`` characters are
read in overlapping pieces, all of them; a run of a script without spaces is one
token; single ASCII letters have no subsequence and no part; an empty table gives an
empty table; only doc_id and text are read, and only text is an input of the score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_remainder, drop_stored, release_held, slices, stored, texts, worker_held
from .nearjoin import grams, signature

ORDER = 3
DECAY = 0.7
#: Words whose kernel with every landmark is below this have no part.
ACTIVE = 0.55
#: Shuffles of the labels that show how far chance takes a stem.
SHUFFLES = 9
#: Entries of tables that have a column for each landmark.
CELLS = 12_000_000
TRAIN_ROWS = 6000
PIECE = 24
#: Entries of a worker's word cache.
CACHE = 300_000
MARK, PAD = "^", "$"
#: A coarse code of a character, for a table that finds most words without a landmark's subsequence at once.
LETTERS = 64
INNER = re.compile(r"[\W_]+")
SPACED = re.compile(r"(?<!\S)\w(?: \w){3,}(?!\S)")


def forms(token: str) -> list[str]:
    """The marked words that a lower-case token stands for."""
    if token.isalnum() and ORDER <= len(token) <= PIECE:
        return [MARK + token]
    parts = [x for x in INNER.split(token) if x]
    words = ["".join(parts), *parts] if len(parts) > 1 else parts
    out = []
    for w in words:
        if len(w) <= PIECE:
            out.append(MARK + w)
        else:
            out += [MARK + w[:PIECE], *(w[k : k + PIECE] for k in range(PIECE // 2, len(w), PIECE // 2))]
    # Short words of ASCII letters are no words of their own; others, such as one ideograph, are filled up.
    return [w if len(w) >= ORDER else w.ljust(ORDER, PAD) for w in out if len(w) >= ORDER or not w.isascii()]


def characters(words: list[str]) -> np.ndarray:
    """Code points of words of one length, one row a word."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64).reshape(len(words), -1)


def coarse(points: np.ndarray) -> np.ndarray:
    """Codes under ``LETTERS``: a to z, the mark, and classes of all other characters."""
    plain = (points >= 97) & (points <= 122)
    return np.where(plain, points - 97, np.where(points == ord(MARK), 26, 27 + points % (LETTERS - 27)))


@cache
def choices(width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all subsequences of ORDER characters of a word, and their weights."""
    places = np.array(list(combinations(range(width), ORDER)), np.int64).reshape(-1, ORDER)
    return places, (DECAY ** (places[:, -1] - places[:, 0] + 1)).astype(np.float32)


def keys_at(c: np.ndarray, places: np.ndarray, base: int) -> np.ndarray:
    """One number for each subsequence, exact if codes are below base."""
    key = c[:, places[:, 0]]
    for k in range(1, ORDER):
        key = key * base + c[:, places[:, k]]
    return key


POINTS = 1 << 21


def length_norm(words: list[str]) -> np.ndarray:
    """Root of each word's kernel with itself; words of one length."""
    places, weights = choices(len(words[0]))
    key = keys_at(characters(words), places, POINTS)
    order = np.argsort(key, axis=1, kind="stable")
    key, value = np.take_along_axis(key, order, 1), weights[order].astype(float)
    new = np.ones(key.shape, bool)
    new[:, 1:] = key[:, 1:] != key[:, :-1]
    runs = np.add.reduceat(value.ravel(), np.flatnonzero(new.ravel()))
    owner = np.repeat(np.arange(len(words)), new.sum(axis=1))
    return np.sqrt(np.bincount(owner, runs * runs, len(words)))


def by_length(words: list[str]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        out.setdefault(len(w), []).append(k)
    return out


class Landmarks:
    """Landmark words, a table of their subsequences, and the Nyström map."""

    def __init__(self, words: list[str]):
        self.words = words
        held: dict[int, np.ndarray] = {}
        self.norms = np.zeros(len(words))
        rough: set[int] = set()
        for k, w in enumerate(words):
            places, weights = choices(len(w))
            points = characters([w])
            for u, x in zip(keys_at(points, places, POINTS)[0].tolist(), weights.tolist(), strict=True):
                held.setdefault(u, np.zeros(len(words), np.float32))[k] += x
            rough.update(keys_at(coarse(points), places, LETTERS)[0].tolist())
            self.norms[k] = length_norm([w])[0]
        #: Whether a subsequence may be a landmark's, by coarse codes; then the exact ones, ascending, and their weights.
        self.maybe = np.zeros(LETTERS**ORDER, bool)
        self.maybe[list(rough)] = True
        self.exact = np.array(sorted(held), np.int64)
        self.weights = np.vstack([*(held[u] for u in self.exact.tolist()), np.zeros(len(words), np.float32)])
        values, vectors = np.linalg.eigh(self.similar(words, 0.0).astype(float))
        keep = values > 1e-6
        #: The Nyström map K_mm^(-1/2).
        self.map = vectors[:, keep] / np.sqrt(values[keep]) @ vectors[:, keep].T

    def similar(self, words: list[str], least: float = ACTIVE) -> np.ndarray:
        """Normalised kernel of each word with each landmark; 0 throughout where no value reaches least.

        A word's norm is at least that of its subsequences taken as all distinct,
        which is known from its length. Words that stay below least even with that
        norm need no exact one.
        """
        out = np.zeros((len(words), len(self.words)), np.float32)
        for width, ks in by_length(words).items():
            places, weights = choices(width)
            floor = math.sqrt(float((weights.astype(float) ** 2).sum()))
            chunk = max(1, min(500_000, CELLS // len(self.words)) // len(weights))
            for at in range(0, len(ks), chunk):
                some = np.array(ks[at : at + chunk])
                points = characters([words[k] for k in some])
                who, which = np.nonzero(self.maybe[keys_at(coarse(points), places, LETTERS)])
                raw = np.zeros((len(some), len(self.words)))
                if len(who):
                    key = points[who, places[which, 0]]
                    for k in range(1, ORDER):
                        key = key * POINTS + points[who, places[which, k]]
                    row = np.minimum(np.searchsorted(self.exact, key), len(self.exact) - 1)
                    row = np.where(self.exact[row] == key, row, len(self.exact))
                    starts = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
                    raw[who[starts]] = np.add.reduceat(self.weights[row] * weights[which][:, None], starts, axis=0)
                raw /= self.norms
                near = np.flatnonzero(raw.max(axis=1) >= least * floor * 0.999)
                if len(near):
                    found = raw[near] / length_norm([words[k] for k in some[near]])[:, None]
                    out[some[near]] = np.where(found.max(axis=1, keepdims=True) >= least, found, 0)
        return out


class Pooler:
    """Describes texts by the kernels of their words with the landmarks; keeps a cache of tokens."""

    def __init__(self, landmarks: Landmarks):
        self.landmarks = landmarks
        self.row_of: dict[str, int] = {}
        self.rows: list[np.ndarray] = [np.zeros(len(landmarks.words), np.float32)]

    def learn(self, tokens: set[str]) -> None:
        if len(self.row_of) + len(tokens) > CACHE or len(self.rows) * len(self.landmarks.words) > CELLS:
            self.row_of.clear()
            del self.rows[1:]
        new = [t for t in tokens if t not in self.row_of]
        words, owner = [], []
        for k, t in enumerate(new):
            for w in forms(t):
                words.append(w)
                owner.append(k)
        unique = {w: k for k, w in enumerate(dict.fromkeys(words))}
        active: dict[int, np.ndarray] = {}
        if unique:
            found = self.landmarks.similar(list(unique))
            hot = found.max(axis=1) > 0
            for w, k in zip(words, owner, strict=True):
                if hot[j := unique[w]]:
                    active[k] = np.maximum(active[k], found[j]) if k in active else found[j]
        for k, t in enumerate(new):
            if k in active:
                self.row_of[t] = len(self.rows)
                self.rows.append(active[k])
            else:
                self.row_of[t] = 0

    def pool(self, batch: list[str]) -> np.ndarray:
        """Features of each text."""
        lower = [t.lower() for t in batch]
        m = len(self.landmarks.words)
        out = np.zeros((len(batch), 3 * m))
        todo: list[int] = []
        tokens: set[str] = set()
        for k, t in enumerate(lower):  # the words of some texts at once, so that few kernels are computed one by one
            todo.append(k)
            tokens.update(t.split())
            tokens.update(x.replace(" ", "") for x in SPACED.findall(t))
            if len(tokens) > 50_000 or k == len(lower) - 1:
                self.learn(tokens)
                for j in todo:
                    self.describe(lower[j], out[j])
                todo, tokens = [], set()
        return out

    def describe(self, text: str, out: np.ndarray) -> None:
        m = len(self.landmarks.words)
        words = text.split()
        spaced = [x.replace(" ", "") for x in SPACED.findall(text)]
        row = self.row_of
        if not any(map(row.__getitem__, words)) and not any(map(row.__getitem__, spaced)):
            return
        n, sentences = 0, []
        for line in text.split("\n"):
            best, some = None, False
            for w in line.split():
                some = True
                if k := row[w]:
                    best = self.rows[k] if best is None else np.maximum(best, self.rows[k])
                if w[-1] in ".!?":
                    n, some = n + 1, False
                    if best is not None:
                        sentences.append(best)
                        best = None
            n += some
            if best is not None:
                sentences.append(best)
        sentences += [self.rows[row[x]] for x in spaced if row[x]]
        found = np.array(sentences, float)
        total = found.sum(axis=0)
        out[:m], out[m : 2 * m], out[2 * m :] = found.max(axis=0), total / max(1, n), np.log1p(total)


@dataclass
class ToxicityModel:
    landmarks: list[str]
    weights: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    bias: float
    curve: tuple[float, float]

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    def __init__(self, model: ToxicityModel):
        self.model = model
        self.pooler = Pooler(Landmarks(model.landmarks)) if model.landmarks else None

    def margins(self, features: np.ndarray) -> np.ndarray:
        """Row by row, so that equal texts get equal margins in any batch."""
        weights = (self.model.weights / self.model.scale).reshape(3, -1) @ self.pooler.landmarks.map.T
        shift = self.model.bias - float(self.model.centre / self.model.scale @ self.model.weights)
        return (features * weights.ravel()).sum(axis=1) + shift

    def scores(self, batch: list[str]) -> np.ndarray:
        a, b = self.model.curve
        margins = self.margins(self.pooler.pool(batch)) if self.pooler else np.zeros(len(batch))
        return 1 / (1 + np.exp(-np.clip(a * margins + b, -500, 500)))


def coordinates(features: np.ndarray, landmarks: Landmarks) -> np.ndarray:
    m = len(landmarks.words)
    return np.hstack([features[:, k * m : (k + 1) * m] @ landmarks.map for k in range(3)])


def stems_of(text: str) -> set[str]:
    """Marked words and their beginnings of five to eight characters, the mark counted."""
    out = set()
    for token in set(text.lower().split()):
        for w in forms(token):
            if w[0] == MARK and len(w) <= PIECE:
                out.update(w[:n] for n in range(5, min(len(w), 9)))
                out.add(w)
    return out


def count_stems(train: DataFrame, labels: np.ndarray) -> DataFrame:
    """stem, n, and m0, m1 ...: of the rows that hold it, how many each row of labels marks. train: n (place in labels), text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_held()
        packed = (labels.astype(np.int64) << np.arange(len(labels))[:, None]).sum(axis=0)
        for batch in slices(batches):
            held = [list(stems_of(t)) for t in batch.column("text").to_pylist()]
            bits = np.repeat(packed[batch.column("n").to_numpy()], [len(x) for x in held])
            yield pa.RecordBatch.from_arrays([pa.array([x for y in held for x in y], pa.string()), pa.array(bits)], ["stem", "bits"])

    rows = train.select("n", "text").mapInArrow(run, "stem string, bits bigint")
    marked = [F.sum(F.shiftright("bits", k).bitwiseAND(1)).alias(f"m{k}") for k in range(len(labels))]
    return rows.groupBy("stem").agg(F.count("*").alias("n"), *marked).where("n >= 3")


def deviation(marked: Column, share: float) -> Column:
    """How far a stem's count of toxic rows lies over the expected one, in deviations."""
    return (marked - share * F.col("n")) / F.sqrt(share * (1 - share) * F.col("n") + 1)


def choose_landmarks(train: DataFrame, y: np.ndarray) -> list[str]:
    """Stems that tell the labels apart better than chance, each found in at least three rows; near doubles are left out."""
    rng, share = np.random.default_rng(5), float(y.mean())
    counted = stored(count_stems(train, np.array([y, *(rng.permutation(y) for _ in range(SHUFFLES))])), "stems")
    tops = counted.agg(*(F.max(deviation(F.col(f"m{k}"), share)) for k in range(1, SHUFFLES + 1))).first()
    if tops[0] is None:
        return []
    found = counted.select("stem", deviation(F.col("m0"), share).alias("over")).where(F.col("over") > max(0.0, float(np.median(tops))))
    # Only stems over chance reach the driver, and then the rows that hold them.
    ranked = [r.stem for r in found.orderBy(F.desc("over"), F.desc(F.length("stem")), "stem").collect()]
    wanted = set(ranked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            pairs = [(x, n) for n, t in zip(batch.column("n").to_pylist(), batch.column("text").to_pylist(), strict=True) for x in stems_of(t) & wanted]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.string()), pa.array([n for _, n in pairs], pa.int64())], ["stem", "n"])

    by_stem = {r.stem: set(r.rows) for r in train.select("n", "text").mapInArrow(run, "stem string, n bigint").groupBy("stem").agg(F.collect_set("n").alias("rows")).collect()}
    drop_stored(counted)
    chosen: list[str] = []
    for x in ranked:
        if all(len(by_stem[x] & by_stem[c]) < 0.6 * len(by_stem[x] | by_stem[c]) and not x.startswith(c) for c in chosen):
            chosen.append(x)
    return chosen


def train_svm(x: np.ndarray, y: np.ndarray, cost: float = 0.01, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Newton's steps on half the squared norm plus cost times the squared hinge losses; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    sign = np.where(y > 0, 1.0, -1.0)
    w = np.zeros(x.shape[1])
    inside = np.ones(len(x), bool)
    for _ in range(rounds):
        near = x[inside]
        w = np.linalg.solve(np.eye(len(w)) + 2 * cost * near.T @ near, 2 * cost * near.T @ sign[inside])
        now = sign * (x @ w) < 1
        if (now == inside).all():
            break
        inside = now
    return w[:-1], float(w[-1])


def fit_curve(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic curve of the label over the margin, by Newton's steps on smoothed targets."""
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    design = np.column_stack([margins, np.ones(len(margins))])
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        hessian = design.T @ (design * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        w = w - np.linalg.solve(hessian, design.T @ (p - target) + 1e-3 * w)
    return float(w[0]), float(w[1])


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """text_id, toxic, text of at most max_rows labelled rows that are not held out; equal rows once."""
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc_remainder(F.col("doc_id"), 5) != 0))
    marked = marked.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    first = lambda rows, *more: rows.orderBy(F.xxhash64("doc_id"), "doc_id", *more).limit(max_rows)
    rows = texts(docs, F.xxhash64("text").alias("text_id"))
    # Both tables that are sent have max_rows narrow rows at most.
    narrow = rows.join(F.broadcast(first(marked)), "doc_id").select("doc_id", "text_id", "toxic").distinct()
    met = rows.join(F.broadcast(first(narrow, "text_id", "toxic")), ["doc_id", "text_id"])
    return met.select("text_id", "toxic", "text").dropDuplicates(["text_id", "toxic"])


def near_groups(signatures: np.ndarray, band: int = 4) -> np.ndarray:
    """The least row of each row's group: rows that share a band of their signatures, directly or through others."""
    root = np.arange(len(signatures))
    bands = [np.unique(signatures[:, k : k + band], axis=0, return_inverse=True)[1].ravel() for k in range(0, signatures.shape[1], band)]
    while True:
        before = root
        for b in bands:
            least = np.full(b.max(initial=0) + 1, len(root))
            np.minimum.at(least, b, root)
            root = least[b]
        if (root == before).all():
            return root


def training_ids(train: DataFrame) -> pa.Table:
    """text_id, toxic, n (0, 1 ...) of the training rows, one for each group of near copies and label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sig = pa.array([signature(grams(t)).tobytes() for t in batch.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("text_id"), batch.column("toxic"), sig], ["text_id", "toxic", "sig"])

    # At most TRAIN_ROWS rows of 512 bytes.
    rows = train.select("text_id", "toxic", "text").mapInArrow(run, "text_id bigint, toxic int, sig binary").toArrow().sort_by([("text_id", "ascending"), ("toxic", "ascending")])
    if not rows.num_rows:
        return rows.select(["text_id", "toxic"])
    sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint32).reshape(rows.num_rows, -1)
    _, first = np.unique(near_groups(sig) * 2 + rows.column("toxic").to_numpy(), return_index=True)
    return rows.select(["text_id", "toxic"]).take(pa.array(np.sort(first))).append_column("n", pa.array(np.arange(len(first))))


def features_of(train: DataFrame, landmarks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Place and features of each training row, computed in tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_held()
        pooler = Pooler(Landmarks(landmarks))
        for batch in slices(batches):
            found = pooler.pool(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("n"), pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), found.shape[1]).cast(pa.list_(pa.float64()))], ["n", "x"])

    out = train.select("n", "text").mapInArrow(run, "n bigint, x array<double>").toArrow()
    return out.column("n").to_numpy(), out.column("x").combine_chunks().flatten().to_numpy().reshape(out.num_rows, -1)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS) -> ToxicityModel:
    """Learns from the labelled rows whose doc_id isn't held out, max_rows of them at most."""
    train = stored(training_rows(docs, labels, max_rows), "toxicity-train")
    ids = training_ids(train)
    y = ids.column("toxic").to_numpy().astype(np.int64)
    none = np.zeros(0)
    rate = (y.sum() + 1) / (len(y) + 2)
    constant = ToxicityModel([], none, none, none, 0.0, (0.0, float(np.log(rate / (1 - rate)))))
    if not 0 < y.sum() < len(y):
        return constant
    places = docs.sparkSession.createDataFrame(ids)
    held = train
    train = held.join(F.broadcast(places), ["text_id", "toxic"])
    chosen = choose_landmarks(train, y)
    if not chosen:
        return constant
    n, found = features_of(train, chosen)
    drop_stored(held)
    x = coordinates(found[np.argsort(n)], Landmarks(chosen))
    centre, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    weights, bias = train_svm((x - centre) / scale, y)
    return ToxicityModel(chosen, weights, centre, scale, bias, fit_curve((x - centre) / scale @ weights + bias, y))


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id and score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = worker_scorer(model)
        for batch in slices(batches):
            found = scorer.scores(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], ["doc_id", "score"])

    return texts(docs).mapInArrow(run, "doc_id bigint, score double")


def reject(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose score is below the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = worker_scorer(model)
        for batch in slices(batches):
            found = scorer.scores([t or "" for t in batch.column("text").to_pylist()])
            yield batch.filter(pa.array(found < threshold))

    return docs.mapInArrow(run, docs.schema)


def worker_scorer(model: ToxicityModel) -> Scorer:
    """One scorer and cache for each Python worker and model."""
    return worker_held(("toxicity", *model.landmarks, model.weights.tobytes()), model.scorer)
