"""Column functions on times and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what a time looks like in the file format.
TIME = r"^\s*(\d{1,4}):([0-5]?\d)(?:[.:](\d{1,3}))?\s*$"


def parse_time(text: Column) -> Column:
    """`m:s`, `m:s.f` or `m:s:f` as milliseconds; null for anything else."""
    part = lambda i: F.regexp_extract(text, TIME, i)
    ms = part(1).try_cast("bigint") * 60000 + part(2).try_cast("bigint") * 1000 + F.coalesce(F.rpad(part(3), 3, "0").try_cast("bigint"), F.lit(0))
    return F.when(text.rlike(TIME), ms)


def format_time(ms: Column, digits: int = 3) -> Column:
    """Milliseconds, not below zero, as mm:ss.fff, or rounded half up to mm:ss.ff; minutes grow beyond two digits."""
    unit = 10 ** (3 - digits)
    n = F.floor((F.greatest(F.lit(0), ms) + unit // 2) / unit).cast("bigint")
    per_second = 10**digits
    minutes = F.floor(n / (60 * per_second)).cast("bigint")
    rest = n - minutes * 60 * per_second
    text = minutes.cast("string")
    padded = F.lpad(text, F.greatest(F.lit(2), F.length(text)), F.lit("0"))  # lpad would cut what is longer
    return F.concat(padded, F.lit(":"), F.lpad(F.floor(rest / per_second).cast("string"), 2, "0"), F.lit("."), F.lpad((rest % per_second).cast("string"), digits, "0"))


def clamp01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def number(x: Column, fallback: Column) -> Column:
    """x as a finite double, else the fallback."""
    n = x.try_cast("double")
    return F.when(n.isNotNull() & ~F.isnan(n) & (F.abs(n) != float("inf")), n).otherwise(fallback)


def percent(x: Column) -> Column:
    return F.round(100 * x, 2)


def progress_step(p: Column) -> Column:
    """Which of the three steps a progress figure falls in; fixed limits 10, 30, 70, 95."""
    return F.when(p < 10, "waiting").when(p < 30, "step1").when(p < 70, "step2").when(p < 95, "step3").otherwise("done")
