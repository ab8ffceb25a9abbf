"""Text expressions: host names, group labels, page titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridlens.functions.times import day_label
from gridlens.schemas import EVENT_BUCKET, UNKNOWN_HOST


def slot_trim(host: Column) -> Column:
    """Host without its slot prefix: everything through the second ``@`` (or the only one) goes."""
    return F.regexp_replace(host, "^[^@]*@([^@]*@)?", "")


def host_default(host: Column) -> Column:
    """Trimmed host; ``Unknown`` when the job names none."""
    return F.coalesce(slot_trim(host), F.lit(UNKNOWN_HOST))


def pair_label(src: Column, dest: Column) -> Column:
    return F.concat(src, F.lit("TO"), dest)


def bucket_floor(events: Column, width: int = EVENT_BUCKET) -> Column:
    return (F.floor(events / F.lit(float(width))) * F.lit(width)).cast("bigint")


def bucket_label(events: Column, width: int = EVENT_BUCKET) -> Column:
    """``100 to 150``."""
    low = bucket_floor(events, width)
    return F.concat(low.cast("string"), F.lit(" to "), (low + F.lit(width)).cast("string"))


def page_title(src: Column, dest: Column, day: Column, slot: Column | None = None) -> Column:
    """``<src> to <dest>[ at <slot>] on <day>``."""
    parts = [src, F.lit(" to "), dest]
    if slot is not None:
        parts += [F.lit(" at "), slot]
    return F.concat(*parts, F.lit(" on "), day_label(day))


def task_title(task: Column, day: Column, site: Column) -> Column:
    """``<task> on <day> at <site>``."""
    return F.concat(task, F.lit(" on "), day_label(day), F.lit(" at "), site)
