"""Token counts under a unigram vocabulary, by dynamic programming over a shared trie.

A text is cut at white space; each pre-token begins with the word mark. The best
segmentation of a pre-token has the largest sum of its pieces' scores; among equal
sums the one of fewer pieces counts. The distinct pre-tokens of a batch go into a
trie. Each trie node holds the best forward score and piece count of its prefix, so
a prefix that many pre-tokens share is solved once, and the node where a pre-token
ends gives its count. Characters in no piece are one unknown piece each.

The vocabulary file names pieces by rank, without probabilities; a piece of rank r
scores -log(r + 1), as under Zipf's law. Tokenizers are not trained here.

A Python worker keeps its trie and starts a new one when it has ``NODES`` nodes. Only
the first ``SHARED`` characters of a pre-token go into the trie; beyond them the same
recurrence goes on with the last few scores, as many as the longest piece has
characters. So memory is bounded for any pre-token. Nothing is shuffled.

Edge cases: null and empty texts, and texts of white space alone, have no tokens;
long pre-tokens are solved whole; equal rows give equal counts; an empty table gives
an empty table; other columns are not read.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, texts, worker_held

MARK = "▁"
NODES = 1_500_000
#: Characters of a pre-token that go into the trie.
SHARED = 256
POINTS = 0x110000
#: An unknown character's score, below that of any piece.
UNKNOWN = -20.0


def load_pieces(path: str) -> dict[str, float]:
    """Scores of a vocabulary's plain pieces by rank; control and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(k) for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k))]
    return {p: -math.log(k + 1) for k, p in enumerate(pieces, 1)}


class Trie:
    """Prefixes of pre-tokens with their best forward scores."""

    def __init__(self, scores: dict[str, float]):
        self.scores, self.longest = scores, max(map(len, scores), default=1)
        self.clear()

    def clear(self) -> None:
        #: The node below a node by a character, as node * POINTS + code point; node 0 is the root.
        self.below: dict[int, int] = {}
        #: Of each node: forward score and pieces. Of each pre-token that ends at a node of its own: pieces.
        self.forward, self.pieces = array("d", [0.0]), array("q", [0])
        self.ends: dict[str, int] = {}

    def best(self, token: str, k: int, forward: Sequence[float], pieces: Sequence[int]) -> tuple[float, int]:
        """Score and pieces of token[: k + 1]; forward and pieces end with those of its beginnings of up to k characters."""
        score, last = self.scores.get, len(forward)
        best, count = forward[last - 1] + UNKNOWN, pieces[last - 1] + 1
        for width in range(1, min(self.longest, k + 1) + 1):
            s = score(token[k + 1 - width : k + 1])
            if s is not None:
                value, n = forward[last - width] + s, pieces[last - width] + 1
                if value > best or value == best and n < count:
                    best, count = value, n
        return best, count

    def insert(self, token: str) -> int:
        """The number of pieces of a pre-token."""
        below, all_forward, all_pieces = self.below, self.forward, self.pieces
        forward, pieces, node = [0.0], [0], 0
        for k, char in enumerate(token[:SHARED]):
            edge = node * POINTS + ord(char)
            node = below.get(edge)
            if node is None:
                node = below[edge] = len(all_forward)
                best, count = self.best(token, k, forward, pieces)
                all_forward.append(best)
                all_pieces.append(count)
            forward.append(all_forward[node])
            pieces.append(all_pieces[node])
        for k in range(SHARED, len(token)):
            del forward[: -self.longest], pieces[: -self.longest]
            best, count = self.best(token, k, forward, pieces)
            forward.append(best)
            pieces.append(count)
        return pieces[-1]

    def count(self, token: str) -> int:
        found = self.ends.get(token)
        if found is None:
            if len(self.forward) > NODES:
                self.clear()
            found = self.insert(MARK + token)
            if len(token) < SHARED:
                self.ends[token] = found
        return found


def trie(path: str) -> Trie:
    """One trie for each Python worker and vocabulary."""
    return worker_held(("trie", path), lambda: Trie(load_pieces(path)))


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_pretokens, n_tokens of each whole text. vocabulary: a file that every executor can open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = trie(vocabulary)
        for batch in slices(batches):
            words, counts = [], []
            for text in batch.column("text").to_pylist():
                found = Counter(text.split())
                words.append(found.total())
                counts.append(sum(n * t.count(w) for w, n in found.items()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(counts, pa.int64())], ["doc_id", "n_pretokens", "n_tokens"])

    return texts(docs).mapInArrow(run, "doc_id bigint, n_pretokens bigint, n_tokens bigint")
