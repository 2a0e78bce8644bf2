"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier decides.

Four strict patterns (email, ip, card, phone) find base spans, which always stay.
Candidates of the same kinds are what the strict ones miss: wider patterns (spelled-out,
bracketed and spaced forms, international prefixes), the strict and the wider patterns over
the text with full-width characters, odd dashes and odd spaces made plain, one for one, and
the parts of matches that the strict patterns reject for being too long, where two
numbers stand side by side. What an account number with a right check sum holds is no candidate. Each
candidate gets votes (yes, no or none) from labelers: shape, plausible parts,
check sum or mark, cue words near it, the characters around it, words that speak against it, and
gazetteers of mail providers, top-level domains, address ranges, issuers and prefixes.
Vote patterns are counted over all documents, with a few coarse features of the span:
its length, how many of its characters differ, and whether a base span of the kind is in
the same text. Expectation-maximisation over the votes estimates, for each kind, how
often each labeler is right, and the posterior of each pattern. A logistic classifier is
trained on votes and span features against these posteriors, and adds the candidates
that it finds likelier than not and that no base span touches.

Counts of patterns are bounded by the number of possible patterns, 3^LABELERS times
``FEATURES``, not by the text. The text is read twice: for counts, then for spans;
nothing is shuffled but the counts.

Edge cases: null and empty texts have no spans; equal rows get equal spans; long
texts are read whole; without candidates only base spans are found; an empty table
gives an empty table; other columns are not read.
"""

from __future__ import annotations

import bisect
import ipaddress
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts

KINDS = ("email", "ip", "card", "phone")
#: The strict patterns (a start within a run of digits finds nothing that the run's start doesn't). LOCAL is what may stand before an email's @.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Candidates beyond the strict patterns. Repeats that can be long are possessive or bounded.
_LOCAL, _LABEL = r"[A-Za-z0-9._%+-]++", r"[A-Za-z0-9-]++"
_DOT = r"(?: ?(?:\(dot\)|\[dot\]|\{dot\}|\[\.\]|\(\.\)|\.) ?| dot )"
WIDE = {
    "email": [
        re.compile(rf"(?<![A-Za-z0-9._%+-]){_LOCAL}(?:{_DOT}{_LOCAL}){{0,3}}? ?(?:\(at\)|\[at\]|\{{at\}}| at ) ?{_LABEL}(?:{_DOT}{_LABEL})++", re.IGNORECASE),
        re.compile(rf"(?<![A-Za-z0-9._%+-]){_LOCAL}(?: @ ?| ?@ |\(@\)|\[@\]){_LABEL}(?:(?:\.|\[\.\]|\(\.\)){_LABEL})++"),
    ],
    "ip": [
        re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:])"),
        re.compile(r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:(?: ?(?:\[\.\]|\(\.\)|\{\.\}|\[dot\]|\(dot\)|\{dot\}) ?| dot )[0-9]{1,3}){3}(?![0-9A-Za-z])", re.IGNORECASE),
    ],
    "card": [re.compile(r"(?<![0-9.])[0-9]{4}(?:[./_][0-9]{4}){3}(?![0-9])")],
    "phone": [
        re.compile(r"(?<![0-9+])(?:\+|00)[1-9][0-9]{0,3}+(?:(?: ?/ ?|[ .-])?+(?:\([0-9]{1,5}\)|[0-9]++)){1,6}+"),
        re.compile(r"(?<![0-9+])(?:\([0-9]{2,5}\)[ -]?|0[0-9]{1,4}[ /-]|[0-9]{3}[ .-](?=[0-9]{3}[ .-]))[0-9]{3,4}(?:[ .-]?[0-9]{2,4}){1,3}(?![0-9])"),
    ],
}
#: Full-width ASCII, dashes and spaces, each with the plain character that stands for it.
PLAIN = {k: k - 0xFEE0 for k in range(0xFF01, 0xFF5F)} | dict.fromkeys(range(0x2010, 0x2016), "-") | {0x2212: "-", 0xA0: " ", 0x202F: " ", 0x2009: " ", 0x3000: " "}
ODD = re.compile(f"[{''.join(map(chr, PLAIN))}]")
ACCOUNT = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
#: Cue words near a span of each kind.
CUES = {
    "email": ("email", "e-mail", "mail", "contact", "correo", "courriel", "kontakt"),
    "ip": ("ip", "host", "server", "address", "adresse", "client"),
    "card": ("card", "visa", "credit", "carte", "karte", "tarjeta", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "teléfono", "téléphone", "dial"),
}
CUE = {k: re.compile(rf"\b(?:{'|'.join(map(re.escape, w))})\b") for k, w in CUES.items()}
#: Words near what only looks like one of the kinds.
AGAINST = re.compile(r"\b(?:isbn|issn|version|v\d|order|invoice|page|chapter|figure|ref|sku|serial|build|ratio|score|verse)\b")
#: Gazetteers: mail providers, top-level domains, first bytes of addresses that are in use, card issuers, phone prefixes.
PROVIDERS = re.compile(r"(?:gmail|googlemail|yahoo|hotmail|outlook|live|icloud|proton|protonmail|gmx|aol|mail|web|orange|free|posteo|example)\b", re.IGNORECASE)
DOMAINS = re.compile(r"\b(?:com|org|net|edu|gov|io|info|biz|de|fr|es|it|uk|eu|ch|at|nl|be|pt|us|ca|mx|ar|br|in|jp|cn|ru|test|example)$", re.IGNORECASE)
RANGES = re.compile(r"(?:2[0-9a-f]{3}|3[0-9a-f]{3}|fe[89ab][0-9a-f]|f[cd][0-9a-f]{2}|::1$|::ffff)", re.IGNORECASE)
ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|6011|65|35")
PREFIXES = re.compile(r"\+[1-9]|\(?0|\([2-9]|[2-9][0-9]{2}[ .-]")
#: How the digits of a card are grouped.
CARD_GROUPS = {(16,), (4, 4, 4, 4), (15,), (4, 6, 5), (14,), (4, 6, 4), (19,), (4, 4, 4, 4, 3)}
LABELERS = 7
#: Values of the coarse features: length, distinct characters, a base span of the kind in the text.
FEATURES = (4, 3, 2)
REACH = 30


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, @ and dotted domain, found from each @ outwards."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            free = found.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", *x) for x in emails(text)] if "@" in text else []
    if re.search("[0-9]", text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append(("ip", m.start(), m.end()))
        for m in CARD.finditer(text):
            d = digits_of(m[0])
            if 14 <= len(d) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 10 <= len(digits_of(m[0])) <= 15]
    return out


def votes(kind: str, text: str, start: int, end: int) -> tuple[int, ...]:
    """Of each labeler: 1 yes, 0 no, 2 no vote."""
    span, d = text[start:end], digits_of(text[start:end])
    around = f"{text[max(0, start - REACH) : start]} {text[end : end + REACH]}".lower()
    before, after = text[start - 1 : start], text[end : end + 1]
    if kind == "email":
        shape = int(bool(re.search(r"(?:[.]|dot)\W*[A-Za-z]{2,8}$", span, re.IGNORECASE)))
        parts = int(bool(re.search(r"[A-Za-z]{2,}$", span)))
        check = int(bool(re.search(r"[@(\[{]", span)))
    elif kind == "ip" and ":" not in span:
        numbers = re.findall(r"[0-9]+", span)
        shape = int(len(numbers) == 4)
        parts = int(all(n == str(int(n)) for n in numbers if len(n) < 4))
        check = int(bool(re.search(r"[.(\[{]", span)))
    elif kind == "ip":
        shape = int(len(set(span)) > 2)
        parts = int(sum(map(len, span.split(":"))) >= 4)
        check = 2
    elif kind == "card":
        shape = int(tuple(map(len, re.findall(r"[0-9]+", span))) in CARD_GROUPS)
        parts = int(d[:1] in "3456")
        check = int(luhn(d))
    else:
        shape = int(9 <= len(d) <= 14)
        parts = int(len(set(d)) > 3)
        check = 1 if span.startswith(("(", "0", "+")) else 2
    if kind == "email":
        known = 1 if PROVIDERS.search(span) or DOMAINS.search(span) else 0
    elif kind == "ip" and ":" not in span:
        known = int(0 < int(d[:1] or 0) and len(numbers[0]) < 4 and int(numbers[0]) < 224)
    else:
        known = 1 if {"ip": RANGES, "card": ISSUERS, "phone": PREFIXES}[kind].match(d if kind == "card" else span) else 0
    cue = 1 if CUE[kind].search(around) else 2
    against = 0 if AGAINST.search(around) else 2
    edges = 1 if (not before or before.isspace() or before in "<([\"':;,") and (not after or after.isspace() or after in ">)]\"':;,.!?") else 0
    return shape, parts, check, cue, edges, against, known


def span_features(kind: str, text: str, start: int, end: int, base: list[tuple[str, int, int]]) -> tuple[int, ...]:
    """Coarse features of a span, below FEATURES."""
    span = text[start:end]
    return min(3, len(span) // 10), min(2, len(set(span)) // 5), int(any(k == kind and (a, b) != (start, end) for k, a, b in base))


def is_ipv6(text: str) -> bool:
    try:
        return ipaddress.IPv6Address(text).version == 6 and any(c.isalnum() for c in text)
    except ValueError:
        return False


def is_account(text: str) -> bool:
    """Whether the check digits of an international account number are right."""
    code = text.replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def phone_part(text: str, start: int, end: int) -> tuple[int, int] | None:
    """The shortest start of a number too long for a phone that ends with a group of digits and holds 10 to 15."""
    held = 0
    for m in re.finditer(r"[0-9]+", text[start:end]):
        held += len(m[0])
        if held - 2 * text.startswith("00", start) >= 10:
            return (start, start + m.end()) if held - 2 * text.startswith("00", start) <= 15 else None
    return None


def card_parts(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Whole groups of digits, side by side, that make a card: leftmost, longest first."""
    groups, k = [(start + m.start(), start + m.end()) for m in re.finditer(r"[0-9]+", text[start:end])], 0
    while k < len(groups):
        found, held = None, ""
        for j in range(k, min(len(groups), k + 19)):
            held += text[groups[j][0] : groups[j][1]]
            if len(held) > 19:
                break
            if len(held) >= 14 and luhn(held):
                found = j
        if found is None:
            k += 1
        else:
            yield groups[k][0], groups[found][1]
            k = found + 1


def rejected_parts(text: str, base: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int]]:
    """Parts of strict matches that hold too many digits, cut where a base span of another kind starts."""
    others = sorted(a for k, a, _ in base if k != "phone")
    for m in PHONE.finditer(text) if "+" in text else ():
        if len(digits_of(m[0])) > 15:
            at = bisect.bisect_right(others, m.start())
            part = phone_part(text, m.start(), min([m.end(), *others[at : at + 1]]))
            if part:
                yield ("phone", *part)
    for m in CARD.finditer(text):
        if len(m[0]) > 14 and len(digits_of(m[0])) > 14:
            yield from (("card", *x) for x in card_parts(text, *m.span()))


def wide_spans(text: str) -> Iterator[tuple[str, int, int]]:
    lower = text.lower() if "@" in text or "at" in text or "AT" in text or "At" in text else ""
    digits = bool(re.search("[0-9]", text))
    for m in WIDE["email"][0].finditer(text) if any(x in lower for x in ("(at)", "[at]", "{at}")) or " at " in lower and " dot " in lower else ():
        if re.search(r"[(\[{]at|\bdot\b", m[0], re.IGNORECASE):
            yield ("email", *m.span())
    for m in WIDE["email"][1].finditer(text) if re.search(r"[ (\[]@|@[ )\]]", text) else ():
        yield ("email", *m.span())
    if not digits:
        return
    for m in WIDE["ip"][0].finditer(text) if "::" in text or text.count(":") > 2 else ():
        if is_ipv6(m[0]):
            yield ("ip", *m.span())
    for m in WIDE["ip"][1].finditer(text):
        if all(int(x) <= 255 for x in re.findall("[0-9]+", m[0])):
            yield ("ip", *m.span())
    for m in WIDE["card"][0].finditer(text):
        yield ("card", *m.span())
    for m in WIDE["phone"][0].finditer(text):
        part = phone_part(text, *m.span())
        # An unbroken run of 16 digits has the form of a card, not of a phone.
        if part and not (part[1] - part[0] > 15 and text[slice(*part)].isdecimal()):
            yield ("phone", *part)
    for m in WIDE["phone"][1].finditer(text):
        yield ("phone", *m.span())


def plain(text: str) -> str:
    """The text with full-width characters, dashes and spaces made plain, at the same places."""
    return text.translate(PLAIN) if ODD.search(text) else text


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans beyond the base ones, none of which they touch, nor each other; by kind as listed, then by where they are found."""
    even = plain(text)
    has_digits = bool(re.search("[0-9]", even))
    taken = Spans((a, b) for _, a, b in base)
    if has_digits:
        for m in ACCOUNT.finditer(even):
            if is_account(m[0]):
                taken.add(*m.span())
    found = [*(base_spans(even) if even is not text else ()), *(rejected_parts(even, base) if has_digits else ()), *wide_spans(even)]
    found.sort(key=lambda x: KINDS.index(x[0]))  # stable: strict forms first, then parts, then wide ones
    out = []
    for kind, a, b in found:
        if taken.free(a, b):
            taken.add(a, b)
            out.append((kind, a, b))
    return out


class Spans:
    """Spans that don't lie in one another, by start; base spans of several kinds may overlap and are merged."""

    def __init__(self, spans: Iterator[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(b, self.ends[-1])
            else:
                self.starts.append(a)
                self.ends.append(b)

    def free(self, a: int, b: int) -> bool:
        k = bisect.bisect_left(self.starts, b)
        return k == 0 or self.ends[k - 1] <= a

    def add(self, a: int, b: int) -> None:
        """Adds a span; one that overlaps others takes their place with theirs."""
        k = bisect.bisect_left(self.starts, b)
        first = k
        while first > 0 and self.ends[first - 1] > a:
            first -= 1
        a, b = min([a, *self.starts[first:k]]), max([b, *self.ends[first:k]])
        self.starts[first:k], self.ends[first:k] = [a], [b]


def reliabilities(patterns: dict[tuple[int, ...], int], rounds: int = 60) -> tuple[float, np.ndarray, dict[tuple[int, ...], float]]:
    """EM over counted vote patterns of one kind: share of true spans, each labeler's chance of a yes by truth, posteriors."""
    rows = list(patterns)
    if not rows:
        return 0.5, np.full((LABELERS, 2), 0.5), {}
    v, n = np.array(rows), np.array([patterns[r] for r in rows], float)
    yes, given = v == 1, v != 2
    share, chance = 0.5, np.tile([0.3, 0.7], (LABELERS, 1))
    for _ in range(rounds):
        weigh = [np.prod(np.where(given, np.where(yes, chance[:, k], 1 - chance[:, k]), 1), axis=1) for k in (0, 1)]
        true = share * weigh[1] / (share * weigh[1] + (1 - share) * weigh[0])
        share = float((n @ true + 1) / (n.sum() + 2))
        for k, p in ((0, 1 - true), (1, true)):
            # Pseudo-counts keep every labeler better than chance where votes are few.
            chance[:, k] = ((n * p) @ yes + (3 if k else 1)) / ((n * p) @ given + 4)
    return share, chance, dict(zip(rows, true.tolist(), strict=True))


def features(pattern: tuple[int, ...]) -> np.ndarray:
    """A classifier's inputs: yes and no of each labeler, and each value of the coarse features."""
    votes_, spans = pattern[:LABELERS], pattern[LABELERS:]
    return np.array([1.0, *(x == 1 for x in votes_), *(x == 0 for x in votes_), *(x == k for x, n in zip(spans, FEATURES, strict=True) for k in range(1, n))])


def train(patterns: dict[tuple[int, ...], int], posterior: dict[tuple[int, ...], float], steps: int = 400) -> np.ndarray:
    """Logistic regression of the votes' posteriors on votes and span features, each pattern weighted by its count."""
    if not patterns:
        return np.zeros(len(features((2,) * LABELERS + (0,) * len(FEATURES))))
    x = np.array([features(p) for p in patterns])
    n = np.array([patterns[p] for p in patterns], float)
    n /= n.sum()
    target = np.array([posterior[p[:LABELERS]] for p in patterns])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        w -= 2.0 * (x.T @ (n * (1 / (1 + np.exp(-x @ w)) - target)) + 1e-3 * w)
    return w


def pattern_of(kind: str, text: str, start: int, end: int, base: list[tuple[str, int, int]]) -> tuple[int, ...]:
    return votes(kind, text, start, end) + span_features(kind, text, start, end, base)


def vote_patterns(docs: DataFrame) -> DataFrame:
    """kind, pattern, n over all candidates and base spans of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                base = base_spans(text)
                even = plain(text)
                for kind, a, b in [*base, *candidates(text, base)]:
                    found[kind, "".join(map(str, pattern_of(kind, even, a, b, base)))] += 1
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found]), pa.array([p for _, p in found]), pa.array(list(found.values()), pa.int64())], ["kind", "pattern", "n"])

    return texts(docs).select("text").mapInArrow(run, "kind string, pattern string, n bigint").groupBy("kind", "pattern").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame) -> dict[str, np.ndarray]:
    """A classifier for each kind. The patterns that reach the driver are bounded, see above."""
    by_kind: dict[str, dict[tuple[int, ...], int]] = {k: {} for k in KINDS}
    for r in vote_patterns(docs).orderBy("kind", "pattern").collect():
        by_kind[r.kind][tuple(map(int, r.pattern))] = r.n
    models = {}
    for kind, patterns in by_kind.items():
        by_votes: Counter = Counter()
        for p, n in patterns.items():
            by_votes[p[:LABELERS]] += n
        models[kind] = train(patterns, reliabilities(by_votes)[2])
    return models


def added_spans(text: str, base: list[tuple[str, int, int]], model: dict[str, np.ndarray]) -> list[tuple[str, int, int]]:
    even = plain(text)
    return [(k, a, b) for k, a, b in candidates(text, base) if features(pattern_of(k, even, a, b, base)) @ model[k] > 0]


def find_spans(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, base, added: spans (kind, start, end) in code points, by start, then kind."""
    order = {k: n for n, k in enumerate(KINDS)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in slices(batches):
            base, added = [], []
            for text in batch.column("text").to_pylist():
                found = base_spans(text)
                more = added_spans(text, found, model)
                for spans, out in ((found, base), (more, added)):
                    spans.sort(key=lambda x: (x[1], order[x[0]]))
                    out.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base, kind), pa.array(added, kind)], ["doc_id", "base", "added"])

    span = "array<struct<kind: string, start: int, end: int>>"
    return texts(docs).mapInArrow(run, f"doc_id bigint, base {span}, added {span}")
