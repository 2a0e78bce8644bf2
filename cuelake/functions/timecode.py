"""Clock times and identifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _clock(ms: Column, mark: str) -> Column:
    parts = [F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1_000) % 60, ms % 1_000]
    shown = F.format_string(f"%02d:%02d:%02d{mark}%03d", *(p.cast("bigint") for p in parts))
    return F.when(ms < 0, F.raise_error(F.concat(F.lit("negative time: "), ms.cast("string")))).otherwise(shown)


def fmt_srt_ts(ms: Column) -> Column:
    """Milliseconds as HH:MM:SS,mmm; negative times raise."""
    return _clock(ms, ",")


def fmt_vtt_ts(ms: Column) -> Column:
    """Milliseconds as HH:MM:SS.mmm; negative times raise."""
    return _clock(ms, ".")


def parse_ts(text: Column) -> Column:
    """H..:MM:SS[,.]mmm as milliseconds; null for anything else."""
    pattern = r"^(\d{2,}):([0-5]\d):([0-5]\d)[,.](\d{3})$"
    part = lambda k: F.regexp_extract(text, pattern, k).cast("bigint")
    return F.when(text.rlike(pattern), part(1) * 3_600_000 + part(2) * 60_000 + part(3) * 1_000 + part(4))


def seconds_to_ms(seconds: Column) -> Column:
    """Half-even milliseconds; null for negative and non-finite seconds."""
    finite = ~F.isnan(seconds) & (seconds >= 0) & (seconds < float("inf"))
    return F.when(finite, F.rint(seconds * 1000).cast("bigint"))


def make_id(prefix: str, index: Column) -> Column:
    """The prefix and the index in six digits or more; up to six are padded, which is quicker than a format."""
    n = index.cast("bigint")
    return F.when(n.between(0, 999_999), F.concat(F.lit(prefix), F.lpad(n.cast("string"), 6, "0"))).otherwise(F.format_string(f"{prefix}%06d", n))


def make_cue_id(index: Column) -> Column:
    return make_id("cue", index)
