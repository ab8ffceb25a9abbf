"""Time expressions. Epoch seconds (bigint, UTC) are the canonical time type."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlens.schemas import DAY, PROBE_VALIDITY


def parse_probe_time(value: Column) -> Column:
    """Epoch seconds of a probe time given as basic (``20170201T000000+0000``) or ISO text.

    A zone suffix (``+...`` or ``Z``) is cut off, the rest is read as UTC. Text that fits neither
    form gives NULL.
    """
    text = F.regexp_replace(F.split_part(value, F.lit("+"), F.lit(1)), "Z$", "")
    parsed = F.when(
        text.contains("-"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    ).otherwise(F.try_to_timestamp(text, F.lit("yyyyMMdd'T'HHmmss")))
    return F.unix_timestamp(parsed)


def epoch_millis(value: Column, kind: T.DataType) -> Column:
    """Epoch milliseconds of a time given as text, timestamp or epoch milliseconds."""
    if isinstance(kind, T.StringType):
        return parse_probe_time(value) * 1000
    return F.unix_millis(value) if isinstance(kind, T.TimestampType) else value.cast("bigint")


def epoch_seconds(value: Column, kind: T.DataType) -> Column:
    """Epoch seconds of the same forms."""
    if isinstance(kind, T.StringType):
        return parse_probe_time(value)
    return F.floor(epoch_millis(value, kind) / F.lit(1000.0))


def utc_stamp(value: Column) -> Column:
    """Epoch seconds of ISO text without a zone."""
    return F.unix_timestamp(value, "yyyy-MM-dd'T'HH:mm:ss")


def utc_date(seconds: Column) -> Column:
    """Timestamp of epoch seconds."""
    return F.timestamp_seconds(seconds)


def day_start(seconds: Column) -> Column:
    """Epoch seconds of the UTC midnight at or before ``seconds``."""
    return seconds - F.pmod(seconds, F.lit(DAY))


def touched_dates(day: Column, first: int, last: int) -> Column:
    """Dates from that of one epoch second to that of another, both included."""
    low, high = (F.timestamp_seconds(F.lit(t // DAY * DAY)).cast("date") for t in (first, last))
    return day.between(low, high)


def day_label(seconds: Column) -> Column:
    """``14-February-2017``."""
    return F.date_format(F.timestamp_seconds(seconds), "dd-MMMM-yyyy")


def probe_interval(ts: Column) -> tuple[Column, Column]:
    """A probe taken at ``ts`` speaks for the four hours before it."""
    return ts - F.lit(PROBE_VALIDITY), ts


def to_epoch(value: str | int) -> int:
    """Driver-side form of :func:`utc_stamp`, for period bounds given as text."""
    if isinstance(value, int):
        return value
    return int(datetime.fromisoformat(value).replace(tzinfo=timezone.utc).timestamp())


def to_period(period: tuple[str | int, str | int]) -> tuple[int, int]:
    return to_epoch(period[0]), to_epoch(period[1])
