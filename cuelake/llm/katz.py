"""Katz back-off language model: Good-Turing discounts, exactly normalised back-off weights.

Tokens are the white-space separated words of a text, A-Z in lower case, and one
end token. P(w | h) is d_r * r / c(h) for an n-gram counted r > 0 times, where d_r
is Katz's Good-Turing discount for r up to ``K`` and 1 above; otherwise it is
a(h) * P(w | h'), with h' the history without its first word, down to the unigram
level, whose left-over mass goes to one class of unknown words. a(h) is the left-over
mass of h divided by what the lower level gives to words not seen after h, so each
P(. | h) sums to 1. A history none of whose counts is discounted gets one added to
its denominator, which leaves mass for new words.

How it runs. Documents are gathered in blocks of some million tokens, written once as
a table bucketed by block, with word ids local to the block. Each block counts its
distinct n-grams and sends hashes and counts, dealt by hash, to the count tables;
so a frequent n-gram is one entry a block, and hot histories are spread over all
parts, since parts go by the whole n-gram. The count tables (partitioned by order; a
row holds one part's n-grams) answer each block with the total counts of its n-grams and name one block
as the holder of each n-gram. Holders then send, for each history, sums over the
n-grams they hold, the history tables add them up and answer with a(h); and once a
block knows counts and weights of a level it evaluates that level, one below the
other, for each of its distinct n-grams, and adds up its documents. Messages hold
arrays, not single rows, for the sake of shuffle size; the orders send theirs one
after the other, and a step's shuffle files go when its result is stored. Only counts
of counts, a few numbers for each order, reach the driver.

Words and n-grams are known by 64-bit hashes: among a billion distinct ones some 0.03
pairs are expected to be taken for one. The end token has a key of its own and is no word.
Where the counts of counts of a small corpus give no Good-Turing discount between 0 and
1 for a count, half a count is taken off instead.

Edge cases: a null or empty text is the end token alone; a null doc_id counts as
the empty id when texts are split by crc32; rows of equal doc_id are scored one by
one; without training text every token has probability 1 (all unknown); an empty
table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_remainder, delete, drop_stored, mix64, shared_dir, stored, texts
from .nearjoin import runs

K = 5
BLOCK_TOKENS = 1_000_000
PART_TOKENS = 3_000_000
#: The key of the end token, and what keys of text beginnings come from.
END_HASH = np.uint64(0x0FEDCBA987654321)
BEGIN_HASH = np.uint64(0x1234567890ABCDEF)
STEP = np.uint64(0x9E3779B97F4A7C15)
BLOCK_ROW = "block bigint, doc_ids array<bigint>, held array<int>, sizes array<int>, tokens array<int>, words array<bigint>"
MESSAGE = "level int, part int, block bigint, keys binary, codes array<tinyint>, more array<bigint>"
COUNTED = "level int, part int, block bigint, keys binary, codes array<tinyint>, more array<bigint>, stats array<bigint>"
SUMS = "level int, part int, block bigint, keys binary, totals array<bigint>, discounted array<double>, lower array<double>"
WEIGHTS = "level int, part int, block bigint, divisors array<bigint>, weights array<double>"
SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    """Rows whose array fields are numpy arrays, under a schema in the form above."""
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "tinyint": pa.int8(), "binary": pa.binary()}
    names, arrays = [], []
    for (name, kind), column in zip((x.split() for x in schema.split(", ")), zip(*rows, strict=True), strict=True):
        names.append(name)
        if kind.startswith("array"):
            inner = kinds[kind[6:-1]]
            whole = np.concatenate([np.asarray(x, inner.to_pandas_dtype()) for x in column])
            arrays.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in column])], pa.int32()), pa.array(whole, inner)))
        else:
            arrays.append(pa.array(column, kinds[kind]))
    return pa.RecordBatch.from_arrays(arrays, names)


def lists(column: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    """The numpy views of an array column."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    out = []
    for c in chunks:
        offsets, values = c.offsets.to_numpy(), c.values.to_numpy(zero_copy_only=False)
        out += [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return out


def encode_blocks(docs: DataFrame) -> DataFrame:
    """Blocks of documents with word ids local to the block; id 0 is the end token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, number = TaskContext.get().partitionId() << 32, count()

        def start():
            ids = defaultdict(count(1).__next__)  # 0 is the end token
            return ids, [], [], [], []

        def flush():
            hashes = np.r_[END_HASH, np.fromiter((xxhash.xxh3_64_intdigest(w) for w in ids), np.uint64, len(ids))].view(np.int64)
            return batch(BLOCK_ROW, [(first + next(number), doc_ids, held, sizes, np.concatenate(tokens), hashes)])

        ids, doc_ids, held, sizes, tokens = start()
        total = 0
        for b in batches:
            for doc_id, out, text in zip(*(b.column(k).to_pylist() for k in ("doc_id", "held", "text")), strict=True):
                words = text.encode().lower().split()
                tokens.append(np.fromiter(map(ids.__getitem__, words), np.int32, len(words)))
                tokens.append(np.zeros(1, np.int32))
                sizes.append(len(words) + 1)
                held.append(int(out) + (2 if doc_id is None else 0))
                doc_ids.append(doc_id or 0)
                total += len(words) + 1
                if total >= BLOCK_TOKENS:
                    yield flush()
                    ids, doc_ids, held, sizes, tokens = start()
                    total = 0
        if doc_ids:
            yield flush()

    return texts(docs, (crc_remainder(F.col("doc_id"), 7) == 2).alias("held")).mapInArrow(run, BLOCK_ROW)


@dataclass
class Level:
    """The distinct n-grams of one order in a block."""

    place: np.ndarray  # of each token's n-gram
    first: np.ndarray  # a token that ends each n-gram
    keys: np.ndarray
    history: np.ndarray  # place of each n-gram's history
    history_keys: np.ndarray
    n_train: np.ndarray


def levels(tokens: np.ndarray, sizes: np.ndarray, held: np.ndarray, words: np.ndarray, order: int) -> list[Level]:
    train = np.repeat((held & 1) == 0, sizes)
    begins = np.zeros(len(tokens), bool)
    begins[np.r_[0, np.cumsum(sizes)[:-1]]] = True
    hashes = words.view(np.uint64)
    n = len(words)
    first = np.zeros(n, np.int64)
    first[tokens[::-1]] = np.arange(len(tokens))[::-1]
    none = np.zeros(n, np.int64)
    out = [Level(tokens, first, hashes, none, np.zeros(1, np.uint64), np.bincount(tokens[train], minlength=n))]
    for k in range(2, order + 1):
        below = out[-1]
        history = np.r_[0, below.place[:-1]].astype(np.int64)
        history[begins] = len(below.keys)
        history_keys = np.r_[below.keys, mix64(np.array([BEGIN_HASH + np.uint64(k)]))]
        pairs, first, place = np.unique(history * n + tokens, return_index=True, return_inverse=True)
        keys = mix64(history_keys[pairs // n] * STEP + hashes[pairs % n])
        out.append(Level(place, first, keys, pairs // n, history_keys, np.bincount(place[train], minlength=len(pairs))))
    return out


def bounds(parts: int) -> np.ndarray:
    """The least key of each part: equal ranges of the 64-bit hashes, which are uniform."""
    return np.array([(p << 64) // parts for p in range(parts)], np.uint64)


def dealt(keys: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """The places of the keys of each part, by ascending key."""
    order = np.argsort(keys)
    cuts = [*np.searchsorted(keys[order], bounds(parts)).tolist(), len(keys)]
    for p in range(parts):
        if cuts[p] < cuts[p + 1]:
            yield p, order[cuts[p] : cuts[p + 1]]


def pack_keys(keys: np.ndarray, part: int, parts: int) -> bytes:
    """Ascending keys of a part as differences, each of as many bytes as the largest needs."""
    steps = np.diff(keys, prepend=bounds(parts)[part])
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    return bytes([width]) + steps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_keys(packed: bytes, part: int, parts: int) -> np.ndarray:
    width = packed[0]
    steps = np.zeros(((len(packed) - 1) // width, 8), np.uint8)
    steps[:, :width] = np.frombuffer(packed, np.uint8, offset=1).reshape(-1, width)
    return np.cumsum(steps.view(np.uint64).ravel(), dtype=np.uint64) + bounds(parts)[part]


LARGE = 126


def pack_counts(counts: np.ndarray, marked: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Counts in a byte each, with the larger ones in a list of their own; marked ones as -1 - code."""
    codes = np.minimum(counts, LARGE).astype(np.int8)
    return codes if marked is None else np.where(marked, -1 - codes, codes).astype(np.int8), counts[counts >= LARGE]


def unpack_counts(codes: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts, and which are marked."""
    marked = codes < 0
    counts = np.where(marked, -1 - codes.astype(np.int64), codes)
    counts[counts == LARGE] = more
    return counts, marked


def block_levels(b: pa.RecordBatch, k: int, order: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, list[Level]]:
    row = b.slice(k, 1)
    doc_ids, held, sizes, tokens, words = (lists(row.column(c))[0] for c in ("doc_ids", "held", "sizes", "tokens", "words"))
    return row.column("block")[0].as_py(), doc_ids, held, sizes, levels(tokens.astype(np.int64), sizes, held, words, order)


def send_counts(blocks: DataFrame, level: int, parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                block, _, _, _, made = block_levels(b, k, level)
                x = made[-1]
                for p, at in dealt(x.keys, parts):
                    yield batch(MESSAGE, [(level, p, block, pack_keys(x.keys[at], p, parts), *pack_counts(x.n_train[at]))])

    return blocks.mapInArrow(run, MESSAGE)


def count_parts(messages: DataFrame, parts: int) -> DataFrame:
    """Count tables (block -1) and answers to the blocks.

    stats of a table: tokens, distinct n-grams, and how many have the counts 1 to K+1.
    """
    near = messages.repartition(parts, "level", "part").sortWithinPartitions("level", "part", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["level", "part"]):
            level, p = t.column("level")[0].as_py(), t.column("part")[0].as_py()
            keys = [unpack_keys(k, p, parts) for k in t.column("keys").to_pylist()]
            counts = [unpack_counts(c, m)[0] for c, m in zip(lists(t.column("codes")), lists(t.column("more")), strict=True)]
            distinct, first, place = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
            total = np.bincount(place, np.concatenate(counts), len(distinct)).astype(np.int64)
            seen = total > 0
            stats = np.r_[total.sum(), seen.sum(), [(total == r).sum() for r in range(1, K + 2)]]
            table = pack_keys(distinct[seen], p, parts) if seen.any() else b""
            yield batch(COUNTED, [(level, p, -1, table, *pack_counts(total[seen]), stats)])
            holder = np.zeros(len(place), bool)
            holder[first] = True
            at, empty = 0, np.empty(0, np.int64)
            for block, own in zip(t.column("block").to_pylist(), keys, strict=True):
                end = at + len(own)
                yield batch(COUNTED, [(level, p, block, None, *pack_counts(total[place[at:end]], holder[at:end]), empty)])
                at = end

    return near.mapInArrow(run, COUNTED)


@dataclass
class Discounts:
    """Discounts of one order, and the unigram level's shares."""

    tokens: int
    distinct: int
    factors: np.ndarray  # by count, up to K; 1 above

    @classmethod
    def of(cls, stats: list[int]) -> Discounts:
        n = [0, *stats[2:]]
        factors = np.ones(K + 2)
        common = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
        for r in range(1, K + 1):
            d = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common != 1 else -1.0
            # Counts of counts of small tables can be out of order; then half a count is taken off.
            factors[r] = d if 0 < d < 1 else (r - 0.5) / r
        return cls(stats[0], stats[1], factors)

    def mass(self, counts: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        return self.factors[np.minimum(counts, K + 1)] * counts

    def unknown(self, counts_of_counts: list[int]) -> tuple[float, float]:
        """Divisor of the unigram level and the share of unknown words."""
        left = sum(n * r * (1 - self.factors[r]) for r, n in enumerate(counts_of_counts[:K], 1))
        if left > 0:
            return float(self.tokens), left / self.tokens
        return self.tokens + 1.0, 1 / (self.tokens + 1.0)


@dataclass
class Known:
    """What a block has been told: counts and holders by level, divisors and weights by level."""

    counts: list[np.ndarray]
    holds: list[np.ndarray]
    divisors: dict[int, np.ndarray]
    weights: dict[int, np.ndarray]


def told(made: list[Level], parts: int, counted: list[dict], weighed: list[dict]) -> Known:
    counts = [np.zeros(len(x.keys), np.int64) for x in made]
    holds = [np.zeros(len(x.keys), bool) for x in made]
    by_part = {(r["level"], r["part"]): r for r in counted}
    for level, x in enumerate(made, 1):
        for p, at in dealt(x.keys, parts):
            r = by_part[level, p]
            counts[level - 1][at], holds[level - 1][at] = unpack_counts(r["codes"], r["more"])
    divisors, weights = {}, {}
    by_part = {(r["level"], r["part"]): r for r in weighed}
    for level in {r["level"] for r in weighed}:
        x = made[level - 1]
        divisors[level], weights[level] = np.zeros(len(x.history_keys), np.int64), np.zeros(len(x.history_keys))
        for p, at in dealt(x.history_keys, parts):
            r = by_part[level, p]
            divisors[level][at] = r["divisors"]
            weights[level][at] = r["weights"]
    return Known(counts, holds, divisors, weights)


def evaluate(made: list[Level], known: Known, discounts: list[Discounts], base: tuple[float, float], top: int) -> list[np.ndarray]:
    """The probability of each distinct n-gram at each level up to top, each from the level below."""
    divisor, unknown = base
    c = known.counts[0]
    out = [np.where(c > 0, discounts[0].mass(c) / divisor, unknown)]
    for level in range(2, top + 1):
        x, c = made[level - 1], known.counts[level - 1]
        lower = out[-1][made[level - 2].place[x.first]]
        per = np.maximum(known.divisors[level][x.history], 1)
        out.append(np.where(c > 0, discounts[level - 1].mass(c) / per, known.weights[level][x.history] * lower))
    return out


def answers_by_block(counted: DataFrame, weighed: DataFrame | None, buckets: int) -> DataFrame:
    """One row for each block with all that it has been told; dealt as the block table is."""
    none = lambda kind: F.array().cast(f"array<{kind}>")
    c = counted.where("block >= 0").select("block", F.struct("level", "part", "codes", "more", none("bigint").alias("divisors"), none("double").alias("weights")).alias("r"))
    if weighed is not None:
        c = c.unionByName(weighed.select("block", F.struct("level", "part", none("tinyint").alias("codes"), none("bigint").alias("more"), "divisors", "weights").alias("r")))
    return c.repartition(buckets, "block").groupBy("block").agg(F.collect_list("r").alias("told"))


def with_answers(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    return blocks.join(answers.hint("shuffle_hash"), "block")


def read_told(column: pa.Array, k: int) -> tuple[list[dict], list[dict]]:
    cell = column.slice(k, 1).flatten()
    fields = {cell.type.field(j).name: cell.field(j) for j in range(cell.type.num_fields)}
    level, part = fields["level"].to_pylist(), fields["part"].to_pylist()
    arrays = {name: lists(fields[name]) for name in ("codes", "more", "divisors", "weights")}
    rows = [{"level": level[j], "part": part[j]} | {name: a[j] for name, a in arrays.items()} for j in range(len(level))]
    return [r for r in rows if len(r["codes"])], [r for r in rows if len(r["divisors"])]


def send_sums(blocks: DataFrame, level: int, parts: int, discounts: list[Discounts], base: tuple[float, float]) -> DataFrame:
    """For each history of the level: sums over the n-grams that the block holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                block, _, _, _, made = block_levels(b, k, level)
                known = told(made, parts, *read_told(b.column("told"), k))
                below = evaluate(made, known, discounts, base, level - 1)[-1]
                x, n = made[level - 1], len(made[level - 1].history_keys)
                own = known.holds[level - 1] & (known.counts[level - 1] > 0)
                h, c = x.history[own], known.counts[level - 1][own]
                totals = np.bincount(h, c, n).astype(np.int64)
                mass = np.bincount(h, discounts[level - 1].mass(c), n)
                lower = np.bincount(h, below[made[level - 2].place[x.first[own]]], n)
                for p, at in dealt(x.history_keys, parts):
                    yield batch(SUMS, [(level, p, block, pack_keys(x.history_keys[at], p, parts), totals[at], mass[at], lower[at])])

    return blocks.mapInArrow(run, SUMS)


def weigh_parts(sums: DataFrame, parts: int) -> DataFrame:
    """Each history's divisor and back-off weight, as answers to the blocks."""
    near = sums.repartition(parts, "level", "part").sortWithinPartitions("level", "part", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["level", "part"]):
            p = t.column("part")[0].as_py()
            keys = [unpack_keys(k, p, parts) for k in t.column("keys").to_pylist()]
            _, place = np.unique(np.concatenate(keys), return_inverse=True)
            total, mass, lower = (np.bincount(place, np.concatenate(lists(t.column(c)))) for c in ("totals", "discounted", "lower"))
            divisor = np.where(total - mass > 1e-9 * np.maximum(total, 1), total, total + 1).astype(np.int64)
            left = 1 - mass / divisor
            weight = np.where(total > 0, left / np.maximum(1 - lower, 1e-300), 1.0)
            at = 0
            for level, part, block, own in zip(*(t.column(c).to_pylist() for c in ("level", "part", "block")), keys, strict=True):
                some = place[at : at + len(own)]
                yield batch(WEIGHTS, [(level, part, block, divisor[some], weight[some])])
                at += len(own)

    return near.mapInArrow(run, WEIGHTS)


def score_blocks(blocks: DataFrame, order: int, parts: int, discounts: list[Discounts], base: tuple[float, float]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                _, doc_ids, held, sizes, made = block_levels(b, k, order)
                known = told(made, parts, *read_told(b.column("told"), k))
                p = evaluate(made, known, discounts, base, order)[-1]
                starts = np.r_[0, np.cumsum(sizes)[:-1]]
                c = known.counts[0]
                plain = np.log10((c + 1) / (discounts[0].tokens + discounts[0].distinct + 1))
                add = lambda per_gram, level: np.add.reduceat(per_gram[made[level].place], starts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc_ids, pa.int64(), mask=held >= 2),
                        pa.array((held & 1) == 1),
                        pa.array(sizes, pa.int64()),
                        pa.array(add((c > 0).astype(np.int64), 0), pa.int64()),
                        pa.array(np.full(len(sizes), discounts[0].tokens), pa.int64()),
                        pa.array(add(plain, 0), pa.float64()),
                        pa.array(add(np.log10(p), order - 1), pa.float64()),
                    ],
                    [x.split()[0] for x in SCORES.split(", ")],
                )

    return blocks.mapInArrow(run, SCORES)


def katz_scores(docs: DataFrame, order: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row.

    Texts whose crc32(doc_id) mod 7 is 2 are held out; all others are learnt from.
    """
    spark = docs.sparkSession
    # As many buckets as a join would make parts, so that the block table is never shuffled.
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"katz_blocks_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    encode_blocks(docs).write.option("compression", "zstd").option("path", path).bucketBy(buckets, "block").saveAsTable(name)
    try:
        blocks = spark.table(name)
        total = blocks.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()[0]
        if not total:
            return spark.createDataFrame([], SCORES)
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_TOKENS))
        tables = [stored(count_parts(send_counts(blocks, level, parts), parts), f"katz-counts-{level}", ["level"]) for level in range(1, order + 1)]
        counted = reduce(DataFrame.unionByName, tables)
        sums = [F.sum(F.get("stats", k)).alias(f"s{k}") for k in range(K + 3)]
        stats = {r[0]: [int(x) for x in r[1:]] for r in counted.where("block = -1").groupBy("level").agg(*sums).collect()}
        discounts = [Discounts.of(stats[k]) for k in range(1, order + 1)]
        base = discounts[0].unknown(stats[1][2:])
        weighed = None
        for level in range(2, order + 1):
            known = with_answers(blocks, answers_by_block(counted.where(F.col("level") <= level), weighed, buckets))
            tables.append(stored(weigh_parts(send_sums(known, level, parts, discounts, base), parts), f"katz-weights-{level}"))
            weighed = tables[-1] if weighed is None else weighed.unionByName(tables[-1])
        scores = stored(score_blocks(with_answers(blocks, answers_by_block(counted, weighed, buckets)), order, parts, discounts, base), "katz-scores")
        drop_stored(*tables)
        return scores
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete(spark, path)
