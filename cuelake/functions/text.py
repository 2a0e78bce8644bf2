"""Text measures and transformations as column expressions; all run inside the JVM but for replacements by large glossaries."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ranges of characters that count as CJK, and the narrower range of the script guard.
CJK = "　-ヿ㐀-鿿豈-﫿"
CJK_STRICT = "㐀-鿿"
#: Marks that end a sentence; the default chooser leaves out the semicolons.
SENTENCE_MARKS = "。！？.!?;；"
CHOOSER_MARKS = "。！？.!?"
#: Marks before which and after which no space is put.
CLOSING = "，。！？；：、,.!?;:)]}」』"
OPENING = "([{「『"
#: Patterns of breaks, numbers, words, URLs, code and e-mail that decide what a check finds.
BREAKS = r"\s,.;:!?，。；：！？、"
NUMBER = r"(?U)\d+(?:[.,:/-]\d+)*%?"
LATIN_WORD = "[A-Za-z]+(?:'[A-Za-z]+)?"
URL = r"https?://[^\s]+"
CODE = r"`[^`]+`"
EMAIL = r"(?U)[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}"
WORD_EMAIL = r"(?U)\b[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}\b"
WORD_NUMBER = r"(?U)\b\d+(?:[.,:/-]\d+)*%?\b"
#: Language codes and their names.
LANGUAGES = {
    "ar": "Arabic", "cs": "Czech", "da": "Danish", "de": "German", "el": "Greek", "en": "English", "es": "Spanish",
    "fa": "Persian", "fi": "Finnish", "fil": "Filipino", "fr": "French", "hi": "Hindi", "hu": "Hungarian",
    "id": "Indonesian", "it": "Italian", "ja": "Japanese", "ko": "Korean", "ms": "Malay", "nl": "Dutch", "pl": "Polish",
    "pt": "Portuguese", "ro": "Romanian", "ru": "Russian", "sv": "Swedish", "th": "Thai", "tr": "Turkish",
    "vi": "Vietnamese", "yue": "Cantonese", "zh": "Chinese",
}


def squeeze(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.regexp_replace(strip(text), r"(?U)\s+", " ")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_blank(text: Column) -> Column:
    return F.length(strip(text)) == 0


def cjk_count(text: Column) -> Column:
    """The pattern is only tried on texts that aren't plain ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lit(0)).otherwise(F.length(F.regexp_replace(text, f"[^{CJK}]", "")))


def visible_length(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"(?U)\s", ""))


def cjk_ratio(text: Column) -> Column:
    """Share of CJK among the characters that aren't white space; 0 without any."""
    return F.when(visible_length(text) == 0, F.lit(0.0)).otherwise(F.length(F.regexp_replace(text, f"(?U)[^{CJK}]|\\s", "")) / visible_length(text))


def has_cjk_strict(text: Column) -> Column:
    return text.rlike(f"[{CJK_STRICT}]")


def latin_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(LATIN_WORD))


def chars_per_second(characters: Column, duration_ms: Column) -> Column:
    """The cutter's reading speed; durations count as a millisecond at least."""
    return characters / F.greatest(duration_ms / 1000.0, F.lit(0.001))


def ends_sentence(text: Column, marks: str = SENTENCE_MARKS) -> Column:
    return text.rlike(f"(?U)[{marks}]\\s*$")


def number_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))


def protected_spans(text: Column, corrections: bool = True) -> Column:
    """Spans that must survive: URLs, e-mails, code spans and, for corrections, numbers."""
    patterns = (URL, WORD_EMAIL, CODE, WORD_NUMBER) if corrections else (URL, CODE, EMAIL)
    return F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in patterns))


def fold(text: Column) -> Column:
    """Lower case with sharp s as ss; Spark has no full case folding."""
    return F.lower(F.regexp_replace(text, "[ßẞ]", "ss"))


def comparable_text(text: Column) -> Column:
    return fold(F.regexp_replace(text, r"(?U)[\W_]+", ""))


def change_ratio(old: Column, new: Column) -> Column:
    """Edit distance over the longer length, both without white space and folded."""
    a, b = (fold(F.regexp_replace(x, r"(?U)\s+", "")) for x in (old, new))
    return F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


#: Edits that are looked for before a wider band is; most corrections have fewer.
FEW_EDITS = 16


def changed_at_most(old: Column, new: Column, ratio: float) -> Column:
    """Whether change_ratio() is at most ratio; the edit distance is only followed up to there, in a band as wide as that.

    Equal texts have no band, and texts that differ little a narrow one.
    """

    def near_enough(x: Column) -> Column:
        a, b = x["a"], x["b"]
        size = F.greatest(F.length(a), F.length(b), F.lit(1))
        # Past the limit the distance is -1. The limit is rounded up a little, since the quotient decides.
        limit = F.floor(size * F.lit(float(ratio)) + F.lit(1e-6)).cast("int")
        edits = lambda most: F.call_function("levenshtein", a, b, most)
        near = F.coalesce(F.when(a == b, F.lit(0)), F.nullif(edits(F.lit(FEW_EDITS)), F.lit(-1)), edits(limit))
        return (near >= 0) & (near / size <= ratio)

    a, b = (fold(F.regexp_replace(x, r"(?U)\s+", "")) for x in (old, new))
    return let(F.struct(a.alias("a"), b.alias("b")), near_enough)


def split_lines(text: Column) -> Column:
    return F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n", -1)


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), where value is computed once for each row; an expression that is named several times may be computed as often."""
    return F.transform(F.array(value), of)[0]


def wrap_text(text: Column, limit: int, max_lines: int) -> Column:
    """At most max_lines lines of the squeezed text, as an array.

    Each cut but the last is after the last break within limit + 1 characters, else
    at limit; the last line holds all that is left and may be longer.
    """

    def lines(rest: Column, more: int) -> Column:
        if more <= 0:
            return F.array(rest)

        def split(cut: Column) -> Column:
            line = F.regexp_replace(F.substr(rest, F.lit(1), cut), r"(?U)\s+$", "")
            after = let(F.regexp_replace(F.substr(rest, cut + 1), r"(?U)^\s+", ""), lambda r: lines(r, more - 1))
            return F.when(cut >= F.length(rest), F.array(rest)).otherwise(F.concat(F.array(line), after))

        head = F.length(F.regexp_extract(F.substring(rest, 1, limit + 1), f"(?Us)^.*[{BREAKS}]", 0))
        return let(head, lambda n: let(F.when(F.length(rest) <= limit, F.length(rest)).when(n > 0, n).otherwise(F.lit(limit)), split))

    return F.array_compact(let(squeeze(text), lambda rest: lines(rest, max_lines - 1)))


def display_lines(text: Column, limit: int, max_lines: int) -> Column:
    """A text with line breaks is split there, any other is wrapped."""
    return F.when(text.rlike("[\r\n]"), split_lines(text)).otherwise(wrap_text(text, limit, max_lines))


def best_text(corrected: Column, source: Column) -> Column:
    return F.coalesce(F.nullif(corrected, F.lit("")), source)


def language_name(code: Column) -> Column:
    """The name of a language code; other values with a capital first letter; auto is null."""
    c = strip(code)
    names = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    other = F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substr(c, F.lit(2))))
    return F.when(F.lower(c) != "auto", F.coalesce(F.get(F.map_values(F.map_filter(names, lambda k, _: k == F.lower(c))), F.lit(0)), other))


def safe_stem(stem: Column, index: Column) -> Column:
    kept = F.regexp_replace(F.regexp_replace(stem, r"[^\p{L}\p{N}_-]", "_"), "^_+|_+$", "")
    return F.format_string("%03d-%s", index.cast("bigint"), F.coalesce(F.nullif(kept, F.lit("")), F.lit("input")))


def redact(text: Column, secrets: Sequence[str]) -> Column:
    for secret in secrets:
        if secret:
            text = F.replace(text, F.lit(secret), F.lit("*" * 10))
    return text


#: More pairs than this are looked up by an automaton instead of one after the other.
FOLDED = 32


def replace_all(text: Column, pairs: Sequence[tuple[str, str | None]]) -> Column:
    """Plain replacements in order, each over the text that the one before has left; a null target is skipped.

    Up to FOLDED pairs are a fold over one array. With more, an Aho-Corasick automaton over all sources
    says which occur at all, and only these are replaced; it looks again after a change, since a target may hold a
    later source. So the time depends on the pairs that occur.
    """
    used = [(a, b) for a, b in pairs if a and b is not None]
    if not used:
        return text
    if len(used) <= FOLDED:
        return F.aggregate(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in used)), text, lambda t, p: F.replace(t, p["a"], p["b"]))

    @F.pandas_udf("string")
    def replaced(texts: pd.Series) -> pd.Series:
        find = occurring([a for a, _ in used])

        def one(t: str) -> str:
            at = -1
            while some := [n for n in find(t) if n > at]:
                at = min(some)
                t = t.replace(*used[at])
            return t

        return texts.map(one, na_action="ignore")

    return replaced(text)


def occurring(terms: Sequence[str]) -> Callable[[str], set[int]]:
    """A function that tells which of the terms occur in a text, by their places; equal terms all count."""
    import ahocorasick

    places: dict[str, list[int]] = {}
    for n, term in enumerate(terms):
        places.setdefault(term, []).append(n)
    automaton = ahocorasick.Automaton()
    for term, own in places.items():
        automaton.add_word(term, own)
    automaton.make_automaton()
    return lambda text: {n for _, own in automaton.iter(text) for n in own}


def needs_space(left: Column, right: Column) -> Column:
    """Whether one space goes between two neighbouring parts of a text."""
    a, b = F.substring(left, -1, 1), F.substring(right, 1, 1)
    glue = b.rlike(f"(?U)[{_class(CLOSING)}\\s{CJK}]") | a.rlike(f"(?U)[{_class(OPENING)}\\s{CJK}]") | (F.length(left) == 0) | (F.length(right) == 0)
    return ~F.coalesce(glue, F.lit(True))


def _class(marks: str) -> str:
    return "".join("\\" + c if c in "[](){}.?^-\\" else c for c in marks)
