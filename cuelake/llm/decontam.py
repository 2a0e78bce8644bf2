"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are cut to lower-case words; a character of a script
without spaces is a word of its own. Seeds are the hashes of the benchmark's word
n-grams of ``min_tile`` words. A filter with at least eight bits for each seed keeps
nearly all other n-grams of the documents where they are; what passes is stored and
counted by seed. A seed's count makes it common or rare, and each item may do without
its commonest seeds as long as the words under them are too few for the threshold: a
document that contains the item holds one of the others, the item's keys. So pairs are
met by a join on keys alone, in which rows of hot seeds are dealt over parts, and a phrase that
many documents and items share makes no pairs unless it is most of an item. Only these
pairs get all their shared seeds, by a join on document and seed. A run of words that
document and item have in common is a run of shared seeds at neighbouring places, so
the greedy tiling of a pair needs its shared seeds alone: it marks the longest runs
that don't overlap in either, found by running Karp-Rabin sums over the seeds, for
one length after the other from the longest down, until none of ``min_tile`` words is
left. Runs may stand in any order, so reordered passages are caught. An item whose
words are covered by tiles to ``threshold`` or more is contained in the document.

The benchmark may have any size: it is a table that is joined. Texts are read where
they are and never shuffled to find leaks.

Edge cases: null or empty texts hold nothing; an item of fewer than ``min_tile`` words,
null and empty ones among them, is never found, as its words stand in clean texts
too: ``short_items`` names these; equal items are found one by one; rows of equal
doc_id and text count once, and all of them go; rows of one doc_id with other texts
are documents of their own; a null item_id stays null; an empty documents or
benchmark table gives no pairs; other columns are not read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FILTER_BITS, HOT, MAP_BITS, drop_stored, mix64, slices, stored, text_key, texts, without
from .nearjoin import word_hashes

#: Ideographs, kana and syllables of Hangul are words of their own.
UNSPACED = "぀-ヿ㐀-鿿가-힯豈-﫿"
WORDS = re.compile(f"[{UNSPACED}]|[^\\W{UNSPACED}]+")
BASE = 0x9E3779B97F4A7C15
PAIRS = "doc_id bigint, text_id bigint, item_id bigint, item_words bigint, covered_words bigint, n_tiles bigint, coverage double"


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.lower())


class Sums:
    """Karp-Rabin sums of a sequence, modulo 2^64: the hash of any window in constant time."""

    def __init__(self, x: np.ndarray, top: int):
        """top: the length of the longest sequence whose windows are compared."""
        self.n, self.top = len(x), top
        powers = np.full(top + 1, BASE, np.uint64)
        powers[0] = 1
        self.powers = np.cumprod(powers, dtype=np.uint64)
        self.sums = np.r_[np.uint64(0), np.cumsum(mix64(x) * self.powers[: self.n], dtype=np.uint64)]

    def windows(self, size: int) -> np.ndarray:
        """A hash of the `size` elements from each place on: differences of sums, lifted to one common power."""
        if size > self.n:
            return np.empty(0, np.uint64)
        starts = np.arange(self.n - size + 1)
        return (self.sums[size:] - self.sums[: self.n - size + 1]) * self.powers[self.top - starts]


def seeds_of(text: str, size: int) -> tuple[int, np.ndarray]:
    """The number of words, and the hash of the n-gram from each place on."""
    found = words_of(text)
    if len(found) < size:
        return len(found), np.empty(0, np.uint64)
    m = mix64(word_hashes(found))
    h = m[: len(m) - size + 1].copy()
    for j in range(1, size):
        h = h * np.uint64(BASE) + m[j : len(m) - size + 1 + j]
    return len(found), mix64(h)


def tiles(item: np.ndarray, text: np.ndarray, places: np.ndarray, min_tile: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (word of item, word of text, words) of the runs marked, longest first.

    item: the seeds of an item at each place; text: seeds of a text at the given ascending places.
    """
    # Places of the text close up, with a gap of one element that matches nothing between stretches.
    gaps = np.r_[0, np.cumsum(np.diff(places) > 1)] if len(places) else np.empty(0, int)
    at = np.arange(len(places)) + gaps
    closed = np.zeros(int(at[-1]) + 1 if len(at) else 0, np.uint64)
    word = np.zeros(len(closed), np.int64)
    closed[at], word[at] = text, places
    is_seed = np.zeros(len(closed), bool)
    is_seed[at] = True
    free_i, used_t = np.ones(len(item) + min_tile - 1, bool), set()
    top = max(len(item), len(closed))
    sums_i, sums_t = Sums(item, top), Sums(closed, top)
    seeds_before = np.r_[0, np.cumsum(is_seed)]

    def common(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the item's windows; the text's windows of seeds alone, and their hashes."""
        if size > len(closed):
            return sums_i.windows(size), np.empty(0, np.int64), np.empty(0, np.uint64)
        some = np.flatnonzero(seeds_before[size:] - seeds_before[:-size] == size)
        return sums_i.windows(size), some, sums_t.windows(size)[some]

    # The longest common run, by bisection: a run of n seeds holds runs of every smaller length.
    low, high = 0, min(len(item), len(closed))
    while low < high:
        mid = (low + high + 1) // 2
        a, _, b = common(mid)
        low, high = (mid, high) if np.isin(a, b).any() else (low, mid - 1)
    out: list[tuple[int, int, int]] = []
    size = low
    while size > 0:
        length = size + min_tile - 1
        hash_i, some, hash_t = common(size)
        hit = np.isin(hash_t, hash_i)
        met: dict[int, list[int]] = defaultdict(list)
        for t, h in zip(some[hit].tolist(), hash_t[hit].tolist(), strict=True):
            met[h].append(t)
        for k in np.flatnonzero(np.isin(hash_i, hash_t)).tolist() if met else ():
            if not free_i[k : k + length].all():
                continue
            for t in met[int(hash_i[k])]:
                w = int(word[t])
                if used_t.isdisjoint(range(w, w + length)) and np.array_equal(item[k : k + size], closed[t : t + size]):
                    free_i[k : k + length] = False
                    used_t.update(range(w, w + length))
                    out.append((k, w, length))
                    break
        # No longer run than the free words of the item allow is left.
        edges = np.flatnonzero(np.diff(np.r_[0, free_i, 0]))
        size = min(size - 1, int(np.diff(edges)[::2].max(initial=0)) - min_tile + 1)
    return out


def item_seeds(benchmark: DataFrame, size: int) -> DataFrame:
    """item, item_id, n_words, seeds of each item of at least `size` words; item tells rows apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [seeds_of(t, size) for t in batch.column("text").to_pylist()]
            seeds = pa.array([s.view(np.int64) for _, s in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array([n for n, _ in found], pa.int64()), seeds], ["item_id", "n_words", "seeds"])

    rows = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "item_id bigint, n_words bigint, seeds array<bigint>").withColumn("item", F.monotonically_increasing_id())


def short_items(benchmark: DataFrame, min_tile: int = 5) -> DataFrame:
    """item_id, n_words of the items that are too short to be found."""
    return item_seeds(benchmark, min_tile).where(F.col("n_words") < min_tile).select("item_id", "n_words")


def document_seeds(docs: DataFrame, packed: bytes, size: int) -> DataFrame:
    """doc_id, text_id, seed, place of the n-grams whose bit of the filter is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(packed, np.uint8)
        last = np.uint64(8 * len(bits) - 1)
        for batch in slices(batches):
            row, place, seed = [], [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                _, h = seeds_of(text, size)
                bit = (h & last).astype(np.int64)
                at = np.flatnonzero(bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)
                row.append(np.full(len(at), k))
                place.append(at)
                seed.append(h[at].view(np.int64))
            who = pa.array(np.concatenate(row))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(who), batch.column("text_id").take(who), pa.array(np.concatenate(seed)), pa.array(np.concatenate(place))], ["doc_id", "text_id", "seed", "place"]
            )

    rows = texts(docs, text_key(F.col("doc_id"), F.col("text"))[1].alias("text_id"))
    return rows.mapInArrow(run, "doc_id bigint, text_id bigint, seed bigint, place bigint")


#: The filter has FILTER_BITS bits, more for a large benchmark, and so many at most: 16 MB.
MOST_BITS = 1 << 27


def filter_of(items: DataFrame) -> bytes:
    """Which values of the last bits of the items' seeds occur; eight bits a seed or more, up to MOST_BITS in all."""
    n = items.agg(F.coalesce(F.sum(F.size("seeds")), F.lit(0))).first()[0]
    size = FILTER_BITS
    while size < 8 * n and size < MOST_BITS:
        size *= 2
    seeds = items.select(F.explode("seeds").alias("seed")).select(F.col("seed").bitwiseAND(F.lit(size - 1)).alias("bit"))
    maps = seeds.groupBy(F.floor(F.col("bit") / MAP_BITS).cast("int").alias("map")).agg(F.bitmap_construct_agg(F.col("bit") % MAP_BITS).alias("bits"))
    found = {r["map"]: bytes(r["bits"]) for r in maps.collect()}  # 256 to 4,096 rows of 4 KB
    return b"".join(found.get(k, bytes(MAP_BITS // 8)) for k in range(size // MAP_BITS))


def item_keys(items: DataFrame, counts: DataFrame, min_tile: int, threshold: float) -> DataFrame:
    """item, seed: of the seeds that documents hold, those of which a document that contains the item must hold one.

    counts: seed, n. An item's seeds are left out from the commonest on while the words
    under those left out are fewer than the threshold asks for.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            item, seed = [], []
            for one, n_words, own, known in zip(*(b.column(c).to_pylist() for c in ("item", "n_words", "seeds", "known")), strict=True):
                places: dict[int, list[int]] = defaultdict(list)
                for k, h in enumerate(own):
                    places[h].append(k)
                bare = np.ones(n_words, bool)
                for x in sorted(known, key=lambda x: (-x["n"], x["seed"])):
                    under = [w for k in places[x["seed"]] for w in range(k, k + min_tile)]
                    before = bare[under]
                    bare[under] = False
                    if n_words - int(bare.sum()) >= threshold * n_words:
                        bare[under] = before
                        item.append(one)
                        seed.append(x["seed"])
            if item:
                yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(seed, pa.int64())], ["item", "seed"])

    own = items.select("item", F.explode(F.array_distinct("seeds")).alias("seed"))
    # As many rows in a group as the item has seeds.
    known = own.join(counts, "seed").groupBy("item").agg(F.collect_list(F.struct("seed", "n")).alias("known"))
    return items.join(known, "item").select("item", "n_words", "seeds", "known").mapInArrow(run, "item bigint, seed bigint")


def met_by_keys(near: DataFrame, keys: DataFrame, counts: DataFrame) -> DataFrame:
    """doc_id, text_id, item: the texts that hold a key of an item, once each.

    Rows of a seed with over one in ``HOT`` of all are dealt over parts, and its keys go to all parts.
    """
    parts = int(near.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.broadcast(counts.where(F.col("n") > total / HOT).select("seed", F.lit(parts).alias("parts")))  # under HOT rows
    dealt = near.join(hot, "seed", "left").withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id", "text_id"), F.lit(parts)).cast("int")))
    copied = keys.join(hot, "seed", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts") - 1, F.lit(0)))))
    return dealt.select("doc_id", "text_id", "seed", "part").distinct().join(copied.select("item", "seed", "part"), ["seed", "part"]).select("doc_id", "text_id", "item").distinct()


def shared_seeds(near: DataFrame, met: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, text_id, item, shared: all places of the text with a seed of the item, for each pair met."""
    own = items.select("item", F.explode(F.array_distinct("seeds")).alias("seed"))
    asked = met.withColumnsRenamed({"doc_id": "d", "text_id": "t"}).join(own, "item").withColumnRenamed("seed", "s")
    same = (F.col("t") == F.col("text_id")) & (F.col("s") == F.col("seed")) & F.col("d").eqNullSafe(F.col("doc_id"))
    return near.join(asked, same).groupBy("doc_id", "text_id", "item").agg(F.collect_set(F.struct("place", "seed")).alias("shared"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, min_tile: int = 5, threshold: float = 0.6) -> DataFrame:
    """One row for each document and benchmark item that it contains; text_id is a hash of the document's text."""
    items = stored(item_seeds(benchmark, min_tile).where(F.col("n_words") >= min_tile), "items")
    near = stored(document_seeds(docs, filter_of(items), min_tile), "seeds")
    counts = near.groupBy("seed").agg(F.count("*").alias("n"))
    met = met_by_keys(near, item_keys(items, counts, min_tile, threshold), counts)
    pairs = shared_seeds(near, met, items).join(items, "item")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got: list[tuple] = []
            for doc_id, text_id, item_id, n_words, shared, item in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text_id", "item_id", "n_words", "shared", "seeds")), strict=True):
                shared.sort(key=lambda x: x["place"])
                places, met = np.array([x["place"] for x in shared]), np.array([x["seed"] for x in shared], np.int64).view(np.uint64)
                own = np.array(item, np.int64).view(np.uint64)
                under = np.convolve(np.isin(own, met), np.ones(min_tile, int)) > 0
                if under.sum() < threshold * n_words:  # no tile lies outside
                    continue
                tiled = tiles(own, met, places, min_tile)
                covered = sum(x[2] for x in tiled)
                if covered >= threshold * n_words:
                    got.append((doc_id, text_id, item_id, n_words, covered, len(tiled), covered / n_words))
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True), [*[pa.int64()] * 6, pa.float64()], strict=True)], [x.split()[0] for x in PAIRS.split(", ")])

    out = stored(pairs.select("doc_id", "text_id", "item_id", "n_words", "shared", "seeds").mapInArrow(run, PAIRS), "leaks")
    drop_stored(items, near)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_tile: int = 5, threshold: float = 0.6) -> DataFrame:
    """The rows of docs, with all their columns, that contain no benchmark item."""
    return without(docs, find_leaks(docs, benchmark, min_tile, threshold))
