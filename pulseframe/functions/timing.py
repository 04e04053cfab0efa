"""Timestamps and periods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -------------------------------------------------------------
MISSING_TOKENS = ("", "nan", "None", "NaT")
EARLIEST_VALID = "1971-01-01 00:00:00+00:00"
FUTURE_MARGIN_DAYS = 1
ZONE_SUFFIX = r"([Zz]|[+-]\d{2}:?\d{2})$"
EVENT_WINDOW_WEEKS = 4
EVENT_HALF_LIFE_WEEKS = 3.0

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_MAX_EPOCH = 1.0e11


def is_missing(raw: Column) -> Column:
    """True when the source supplied nothing at all."""
    return raw.isNull() | F.trim(raw).isin(*MISSING_TOKENS)


def is_zone_naive(raw: Column) -> Column:
    """Text without any zone designator (blank text is not naive)."""
    text = F.trim(raw)
    return (text != "") & ~text.rlike(ZONE_SUFFIX)


def epoch_to_timestamp(seconds: Column) -> Column:
    """Positive epoch seconds; zero, negative and absurd values are null."""
    return F.when(
        (seconds > 0) & (seconds < _MAX_EPOCH), F.timestamp_seconds(seconds)
    )


def iso_to_timestamp(text: Column, formats: Sequence[str] = ()) -> Column:
    """ISO-8601 text (zone or ``Z``), null when unparsable."""
    cleaned = F.regexp_replace(F.trim(text), "[zZ]$", "Z")
    parsed = [F.try_to_timestamp(cleaned)]
    parsed += [F.try_to_timestamp(cleaned, F.lit(pattern)) for pattern in formats]
    return F.coalesce(*parsed)


def timestamp_outcome(
    raw: Column,
    now: Column | str | None = None,
    assume_utc: bool = False,
    formats: Sequence[str] = (),
) -> Column:
    """Struct ``(outcome, ts)``; outcome is valid, missing, naive, unparsed, epoch_zero or future."""
    now = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    text = F.trim(raw)
    numeric = text.rlike(_NUMBER)
    seconds = F.when(numeric, text.try_cast("double"))
    in_range = F.abs(seconds) < _MAX_EPOCH
    parsed = F.when(numeric, F.when(in_range, F.timestamp_seconds(seconds))).otherwise(
        iso_to_timestamp(raw, formats)
    )
    outcome = F.when(is_missing(raw), "missing")
    if not assume_utc:
        outcome = outcome.when(~numeric & is_zone_naive(raw), "naive")
    outcome = (
        outcome.when(numeric & ~in_range, "future")
        .when(parsed.isNull(), "unparsed")
        .when(parsed < F.lit(EARLIEST_VALID).cast("timestamp"), "epoch_zero")
        .when(parsed > now + F.expr(f"INTERVAL {FUTURE_MARGIN_DAYS} DAY"), "future")
        .otherwise("valid")
    )
    return F.struct(outcome.alias("outcome"), parsed.alias("ts"))


def parse_timestamp(
    raw: Column,
    now: Column | str | None = None,
    assume_utc: bool = False,
    formats: Sequence[str] = (),
) -> Column:
    """Usable UTC timestamp or null; nothing is repaired or guessed."""
    result = timestamp_outcome(raw, now, assume_utc, formats)
    return F.when(result.getField("outcome") == "valid", result.getField("ts"))


def timestamp_status(parsed: Column, raw: Column | None = None) -> Column:
    """Valid, missing (nothing supplied) or invalid (something unusable supplied)."""
    if raw is None:
        return F.when(parsed.isNull(), "missing").otherwise("valid")
    return (
        F.when(parsed.isNotNull(), "valid").when(is_missing(raw), "missing").otherwise("invalid")
    )


def serialise_timestamp(ts: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SS+00:00``; null becomes empty text. Needs a UTC session."""
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'"), F.lit(""))


def period_start(ts: Column, freq: str = "W-MON") -> Column:
    """Monday or midnight of the timestamp. Needs a UTC session."""
    return F.date_trunc(_unit(freq), ts)


def period_step(freq: str = "W-MON") -> str:
    """Interval text between two period starts."""
    return "INTERVAL 7 DAYS" if _unit(freq) == "week" else "INTERVAL 1 DAY"


def _unit(freq: str) -> str:
    if freq.upper().startswith("W"):
        return "week"
    if freq.upper().startswith("D"):
        return "day"
    raise ValueError(f"Unsupported frequency {freq!r}; use 'W-MON' or 'D'")


def days_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(8.64e10)


def event_decay(weeks: Column, half_life: float = EVENT_HALF_LIFE_WEEKS) -> Column:
    """Halves every ``half_life`` weeks; 0 when no event is known."""
    return F.coalesce(F.pow(F.lit(0.5), weeks / F.lit(float(half_life))), F.lit(0.0))


def event_active(weeks: Column, window: float = EVENT_WINDOW_WEEKS) -> Column:
    return F.when(weeks < window, 1).otherwise(0)
