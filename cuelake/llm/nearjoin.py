"""n-gram Jaccard join by a MinHash LSH forest with exact verification.

Texts are sets of word five-grams (lower case, split at white space). Rows with
equal sets form a class, and one of each class goes on. A class has a MinHash
signature, cut into ``TREES`` keys of ``DEPTH`` values. A tree is the sorted list of
its keys, which is a prefix trie: neighbours that share a prefix of d values lie
under one node. The least prefix is the longest at which a pair at the threshold
meets in some tree with the target probability. Classes that share it with none in
a tree are done with that tree. Under a node the walk goes from the deepest prefixes,
which tie up near equal classes at once, and shortens the prefix only for what they
leave untied. Each key is read from its first value and from its middle one, so that there are twice as many chances to meet.
A node of over ``CHUNK`` classes is dealt by its deeper prefixes to
several tasks; a few heads of each tied group go on from there, each with its reach, the values in which the
farthest class that it stands for differs from it, and these meet under the shorter prefix, block against
block. Heads are tied if their reaches leave room for a candidate pair below them, so none is lost. No task holds a large node.

Classes under one node whose signatures agree well enough are candidates.
Candidates' connected groups come together with their sets, and the sets of a group
whose sizes allow the threshold are compared exactly, block against block, by
products of 0/1 matrices. A block pair returns a count of links and a linked class
for each class, never the pairs, so that output grows with the number of classes.

Edge cases: null or empty texts have no grams and link to nothing; a text of one
to four words is one gram; rows of one doc_id with several texts belong to the classes
of their texts, one by one; equal rows are copies of each other in counts; a row
without doc_id links to nothing and has a null class; an empty table gives an empty
table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, hot_join, maybe_in, mix64, slices, stored, text_key, texts, without, worker_held
from .components import components

GRAM = 5
TREES, DEPTH = 16, 8
#: Reads of the keys: those from TREES on begin at the middle value. Prefixes of half a key are then made of different values.
READS = 2 * TREES
#: Classes whose signatures agree in less than the threshold less this are no candidates: over five deviations.
SLACK = 0.2
#: Values of a signature in which a class may differ from the head that stands for it.
REACH = TREES * DEPTH // 10
#: Classes under one trie node that a task compares at once, and of one side of an exact comparison.
CHUNK, BLOCK = 2048, 1024
#: Entries of a worker's word cache.
CACHE = 500_000
_rng = np.random.default_rng(20)
FACTORS = _rng.integers(1, 2**32, TREES * DEPTH, dtype=np.uint32) | np.uint32(1)
SHIFTS = _rng.integers(0, 2**32, TREES * DEPTH, dtype=np.uint32)


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word.encode())
        return out


def word_hashes(words: list[str]) -> np.ndarray:
    known = worker_held(("word hashes",), WordHashes)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def grams(text: str) -> np.ndarray:
    """The sorted distinct gram hashes of a text."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    n = min(GRAM, len(h))
    out = h[: len(h) - n + 1] + np.uint64(n)
    for j in range(1, n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - n + 1 + j]
    return np.unique(mix64(out))


def signature(g: np.ndarray) -> np.ndarray:
    """The least value of each hash function over the grams, in 32-bit arithmetic."""
    out = np.full(len(FACTORS), 2**32 - 1, np.uint32)
    low = g.astype(np.uint32)
    for at in range(0, len(low), 256):  # stays in the CPU's cache
        values = low[at : at + 256, None] * FACTORS
        values += SHIFTS
        np.minimum(out, values.min(axis=0), out=out)
    return out


FINGERPRINT = ["n_grams", "f1", "f2"]


def fingerprints(sets: list[np.ndarray]) -> list[pa.Array]:
    """Size and two 64-bit sums of each set."""
    f1 = [int(g.sum(dtype=np.uint64).astype(np.int64)) for g in sets]
    f2 = [int(mix64(g ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64)) for g in sets]
    return [pa.array([len(g) for g in sets], pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64())]


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, text_id, n_grams, f1, f2 (128-bit fingerprint of the set), sig (packed big-endian, so that bytes sort as values)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [grams(t) for t in batch.column("text").to_pylist()]
            sig = pa.array([signature(g).astype(">u4").tobytes() if len(g) else None for g in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_id"), *fingerprints(sets), sig], ["doc_id", "text_id", *FINGERPRINT, "sig"])

    rows = texts(docs, text_key(F.col("doc_id"), F.col("text"))[1].alias("text_id"))
    return rows.mapInArrow(run, "doc_id bigint, text_id bigint, n_grams bigint, f1 bigint, f2 bigint, sig binary")


def prefix_length(threshold: float, recall: float, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix, of depth at most, at which some tree holds a pair at the threshold together with the target probability."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Stretches of rows with equal keys; the batches come sorted by them."""
    kept: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_pylist() for k in keys]
        row_keys = list(zip(*columns, strict=True))
        at = 0
        for k, key in enumerate(row_keys):
            if key != last:
                if k > at:
                    kept.append(batch.slice(at, k - at))
                if kept:
                    yield pa.Table.from_batches(kept)
                kept, at, last = [], k, key
        kept.append(batch.slice(at))
    if kept:
        yield pa.Table.from_batches(kept)


def key_of(tree: int) -> np.ndarray:
    """The places of a tree's values in a signature."""
    return tree % TREES * DEPTH + np.roll(np.arange(DEPTH), -(tree // TREES * (DEPTH // 2)))


def key_bytes(values: int) -> str:
    """SQL: the first so many values of the key of a tree in sig; half a key at least is one stretch of it."""
    first = f"tree % {TREES} * {4 * DEPTH} + CAST(tree >= {TREES} AS INT) * {2 * DEPTH} + 1"
    if values <= DEPTH // 2:
        return f"substring(sig, {first}, {4 * values})"
    rest = f"substring(sig, CAST(tree < {TREES} AS INT) * {2 * DEPTH} + tree % {TREES} * {4 * DEPTH} + 1, {4 * values - 2 * DEPTH})"
    return f"concat(substring(sig, {first}, {2 * DEPTH}), {rest})"


def heads(sig: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that stand for those of their tied group within REACH of them, and the values in which the farthest of these differs."""
    found, reach = [], []
    order = np.argsort(root, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(root[order])) + 1):
        while len(group):
            apart = (sig[group] != sig[group[0]]).sum(axis=1)
            near = apart <= REACH
            found.append(group[0])
            reach.append(apart[near].max())
            group = group[~near]
    return np.array(found, np.int64), np.array(reach, np.int32)


def tie(sig: np.ndarray, own: np.ndarray, depth: int, least: float, reach: np.ndarray | None = None) -> np.ndarray:
    """A root for each row: rows under one trie node whose signatures agree in a share of at least `least`.

    sig: all values; own: the sorted keys of this tree; reach: values in which what a row stands for may differ from
    it, by which less need agree. Goes from deep nodes to those at depth.
    """
    reach = np.zeros(len(sig), np.int64) if reach is None else reach.astype(np.int64)
    n = len(sig)
    root = np.arange(n)
    for d in range(own.shape[1], depth - 1, -1):
        new = np.r_[True, (own[1:, :d] != own[:-1, :d]).any(axis=1)]
        starts = np.flatnonzero(new)
        ends = np.r_[starts[1:], n]
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            if b - a < 2 or (root[a:b] == root[a]).all():
                continue
            left = np.arange(a, b)
            while len(left):
                # All rows that the first one's root has tied, and what agrees with any of them.
                group = left[root[left] == root[left[0]]]
                left = left[root[left] != root[left[0]]]
                head = root[group[0]]
                wave = list(group)
                while wave and len(left):
                    at = wave.pop()
                    agree = (sig[left] == sig[at]).mean(axis=1) >= least - (reach[left] + reach[at]) / sig.shape[1]
                    if agree.any():
                        met = np.isin(root[left], np.unique(root[left[agree]]))
                        wave += left[met].tolist()
                        root[np.isin(root, np.unique(root[left[agree]]))] = head
                        left = left[~met]
    return root


def pieces(batches: Iterator[pa.RecordBatch], keys: list[str], most: int | None) -> Iterator[pa.Table]:
    """Stretches of rows with equal keys, cut after every `most` rows, if that is given; the batches come sorted by the keys."""
    held: list[pa.RecordBatch] = []
    last, n = None, 0
    for batch in batches:
        at = 0
        for k, key in enumerate(zip(*(batch.column(c).to_pylist() for c in keys), strict=True)):
            if key != last or n == most:
                if k > at:
                    held.append(batch.slice(at, k - at))
                if held:
                    yield pa.Table.from_batches(held)
                held, at, last, n = [], k, key, 0
            n += 1
        if at < batch.num_rows:
            held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def tied(rows: DataFrame, keys: list[str], depth: int, least: float, most: int | None) -> DataFrame:
    """a, b: edges that join what is alike under a node; with tree, node and reach: the heads (a) that are left of a node in several parts.

    rows: rep, tree, node, sig, parts (tasks that the node is in), reach and keys.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in pieces(batches, keys, most):
            ids, tree, node = t.column("rep").to_numpy(), t.column("tree")[0].as_py(), t.column("node")[0].as_py()
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), ">u4").astype(np.uint32).reshape(len(ids), -1)
            root = tie(sig, sig[:, key_of(tree)], depth, least, t.column("reach").to_numpy())
            far = root != np.arange(len(ids))
            left, reach = heads(sig, root) if t.column("parts")[0].as_py() > 1 else (np.empty(0, np.int64), np.empty(0, np.int32))
            n, m = int(far.sum()), len(left)
            if n or m:
                place = [pa.array([None] * n + [x] * m, k) for x, k in ((tree, pa.int32()), (node, pa.int64()))]
                place.append(pa.array([None] * n + reach.tolist(), pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(np.r_[ids[far], ids[left]]), pa.array(np.r_[ids[root[far]], ids[left]]), *place], ["a", "b", "tree", "node", "reach"])

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, F.expr(key_bytes(DEPTH)))
    return dealt.select("rep", "tree", "node", "parts", "reach", "sig", *(k for k in keys if k not in ("tree", "node"))).mapInArrow(run, "a bigint, b bigint, tree int, node bigint, reach int")


def candidate_links(classes: DataFrame, threshold: float, recall: float) -> DataFrame:
    """a, b: edges that join the classes of each candidate group; at most a few for each class and tree."""
    depth, least = prefix_length(threshold, recall, READS, DEPTH // 2), threshold - SLACK
    trees = F.explode(F.sequence(F.lit(0), F.lit(READS - 1))).alias("tree")
    nodes = classes.select("rep", "sig", trees).select("rep", "tree", F.expr(f"xxhash64(tree, {key_bytes(depth)})").alias("node"))
    shared = nodes.groupBy("tree", "node").agg(F.count("*").alias("n")).where("n > 1")
    shared = shared.select("tree", "node", F.ceil(F.col("n") / CHUNK).cast("int").alias("parts"))
    sigs = classes.select("rep", "sig")
    under = nodes.join(shared, ["tree", "node"]).join(sigs, "rep").withColumn("reach", F.lit(0))
    # Classes of one full key stay together, unless these alone are too many.
    salt = F.when(F.col("parts") > 16, F.pmod(F.xxhash64("rep"), F.col("parts"))).otherwise(0)
    first = stored(tied(under.withColumn("part", F.pmod(F.xxhash64(F.expr(key_bytes(DEPTH)), salt), F.col("parts")).cast("int")), ["tree", "node", "part"], depth, least, CHUNK), "tied")
    left = first.where("node IS NOT NULL").select(F.col("a").alias("rep"), "tree", "node", "reach")
    blocks = left.groupBy("tree", "node").agg(F.ceil(F.count("*") / (CHUNK // 2)).cast("int").alias("n_blocks"))
    placed = left.join(blocks, ["tree", "node"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("n_blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    placed = placed.select("rep", "tree", "node", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), F.lit(1).alias("parts"), "reach")
    # A pair of blocks is never cut: their heads meet whole.
    second = tied(placed.join(sigs, "rep"), ["tree", "node", "low", "high"], depth, least, None)
    return first.where("node IS NULL").select("a", "b").union(second.select("a", "b"))


def compare(left: list[np.ndarray], right: list[np.ndarray], threshold: float) -> np.ndarray:
    """Whether each set of left and each of right have that Jaccard similarity, by 0/1 matrices over slices of the grams."""
    all_grams, place = np.unique(np.concatenate(left + right), return_inverse=True)
    sizes = np.array([len(x) for x in left + right])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    common = np.zeros((len(left), len(right)))
    step = max(256, 8_000_000 // len(sizes))
    for at in range(0, len(all_grams), step):
        a, b = np.searchsorted(place, [at, at + step])
        matrix = np.zeros((len(sizes), min(step, len(all_grams) - at)), np.float32)
        matrix[owner[a:b], place[a:b] - at] = 1
        common += matrix[: len(left)] @ matrix[len(left) :].T
    union = sizes[: len(left), None] + sizes[None, len(left) :] - common
    return common >= threshold * union - 1e-9


def verify(docs: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """rep, links, root: of each class and block pair, the rows it is linked with and the least class of its linked group.

    members: rep (the class), doc_id, n_grams, f1, f2, size, cluster. Classes of a group are put in bins by
    size of set, so that linked ones are in one bin or in neighbouring ones, and a bin of more than
    BLOCK classes is cut into blocks; each pair of blocks is compared in a task of its own.
    """
    bins = members.withColumn("bin", F.floor(F.log("n_grams") / np.log(1 / threshold) + 1e-9).cast("int"))
    blocks = stored(bins.groupBy("cluster", "bin").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n_blocks")), "blocks")
    up = blocks.select("cluster", (F.col("bin") - 1).alias("bin"), F.col("n_blocks").alias("n_up"))
    down = blocks.select("cluster", (F.col("bin") + 1).alias("bin"), F.col("n_blocks").alias("n_down"))
    counts = blocks.join(up, ["cluster", "bin"], "left").join(down, ["cluster", "bin"], "left").na.fill(0, ["n_up", "n_down"])
    placed = bins.join(counts, ["cluster", "bin"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("n_blocks")).cast("int"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [grams(t) for t in batch.column("text").to_pylist()]
            packed = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in found])], pa.int32()), pa.array(np.concatenate(found).view(np.int64) if found else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([*fingerprints(found), packed], [*FINGERPRINT, "grams"])

    # Only texts that may be a member's are read on; their grams meet the members in a join.
    rows = maybe_in(texts(docs), F.col("doc_id"), members, "doc_id", "maybe").where("maybe").select("text")
    gathered = rows.mapInArrow(sets, "n_grams bigint, f1 bigint, f2 bigint, grams array<bigint>").dropDuplicates(FINGERPRINT)
    place = lambda bin_, block: F.shiftleft(bin_.cast("bigint"), 32) + block
    others = lambda n, bin_: F.when(F.col(n) > 0, F.transform(F.sequence(F.lit(0), F.col(n) - 1), lambda k: place(bin_, k))).otherwise(F.array().cast("array<bigint>"))
    b = F.col("bin")
    met = gathered.join(placed, FINGERPRINT).withColumn("block", place(b, F.col("block")))
    met = met.withColumn("other", F.explode(F.concat(others("n_blocks", b), others("n_up", b + 1), others("n_down", b - 1))))
    met = met.select("rep", "size", "cluster", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "grams")
    dealt = met.repartition("cluster", "low", "high").sortWithinPartitions("cluster", "low", "high", "block", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["cluster", "low", "high"]):
            ids, size = t.column("rep").to_numpy(), t.column("size").to_numpy()
            block, low, high = t.column("block").to_numpy(), t.column("low")[0].as_py(), t.column("high")[0].as_py()
            lists = t.column("grams").combine_chunks()
            starts = lists.offsets.to_numpy()
            values = lists.values.to_numpy()
            held = [values[a:b].view(np.uint64) for a, b in zip(starts[:-1], starts[1:], strict=True)]
            n = len(ids)
            link = np.zeros((n, n), bool)
            a, b = np.flatnonzero(block == low), np.flatnonzero(block == high)
            if len(a) and len(b):
                near = compare([held[k] for k in a], [held[k] for k in b], threshold)
                link[np.ix_(a, b)] = near
                link[np.ix_(b, a)] |= near.T
            np.fill_diagonal(link, False)
            root = ids.copy()
            while True:
                least = np.minimum(root, np.where(link, root[None, :], np.iinfo(np.int64).max).min(axis=1))
                if (least == root).all():
                    break
                root = least
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(link @ size.astype(np.int64)), pa.array(root)], ["rep", "links", "root"])

    return dealt.mapInArrow(run, "rep bigint, links bigint, root bigint")


def near_duplicates(docs: DataFrame, threshold: float = 0.8, recall: float = 1 - 1e-7) -> DataFrame:
    """doc_id, copy_id, class_id, n_copies, n_links, text_id for each row of docs.

    copy_id: the least doc_id with the same grams; class_id: the least doc_id of the group that links join;
    n_copies: rows with the same grams; n_links: other rows of similarity threshold or more, copies included;
    text_id: a hash of the text, which tells apart rows of equal doc_id.
    """
    sketched = stored(sketches(docs), "sketches")
    full = sketched.where("n_grams > 0 AND doc_id IS NOT NULL")
    equal = full.groupBy(*FINGERPRINT).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("size"), F.min("sig").alias("sig"))
    classes = stored(equal.withColumn("rep", F.monotonically_increasing_id()), "classes")
    clusters = components(candidate_links(classes, threshold, recall))
    grouped = stored(classes.drop("sig").join(clusters.select(F.col("node").alias("rep"), F.col("label").alias("cluster")), "rep"), "grouped")
    found = stored(verify(docs, grouped, threshold), "links")
    joined = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links")).join(joined.select(F.col("node").alias("rep"), "label"), "rep")
    # Classes that nothing links are groups of their own.
    labelled = classes.select("rep", *FINGERPRINT, "doc_id", "size").join(counts, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    labelled = stored(labelled, "labelled")
    least = stored(labelled.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n")), "groups")
    named = hot_join(labelled, least, ["label"], "n", ["rep"])
    named = stored(named.select(*FINGERPRINT, F.col("doc_id").alias("copy_id"), "class_id", "size", F.coalesce("links", F.lit(0)).alias("links")), "named")
    linked = hot_join(full.select("doc_id", "text_id", *FINGERPRINT), named, FINGERPRINT, "size", ["doc_id", "text_id"])
    one = F.col("doc_id")
    out = linked.select("doc_id", "copy_id", "class_id", F.col("size").alias("n_copies"), (F.col("size") - 1 + F.col("links")).alias("n_links"), "text_id")
    none = sketched.where("n_grams = 0 OR doc_id IS NULL").select("doc_id", one.alias("copy_id"), one.alias("class_id"), F.lit(1).cast("bigint").alias("n_copies"), F.lit(0).cast("bigint").alias("n_links"), "text_id")
    result = stored(out.unionByName(none), "near")
    drop_stored(sketched, classes, grouped, found, labelled, least, named)
    return result


def keep_one(docs: DataFrame, threshold: float = 0.8, recall: float = 1 - 1e-7) -> DataFrame:
    """The rows of docs, all columns, without those of a group's other documents; the least doc_id stays.

    Rows of that doc_id are one document, so all of them stay, near copies of each other too.
    """
    gone = near_duplicates(docs, threshold, recall).where("doc_id <> class_id").select("doc_id", "text_id")
    return without(docs, gone)
