"""Time codes, rounding and packing as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = 1_000_000


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a column of timestamps without zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})")


def code_of_centis(cs: Column | str) -> Column:
    """Centiseconds as H:MM:SS.cc; below 0 counts as 0, hours go on beyond 24."""
    c = F.greatest(_c(cs).cast("bigint"), F.lit(0))
    part = lambda unit, of: F.lpad((F.floor(c / unit) % of).cast("string"), 2, "0")
    return F.concat(F.floor(c / 360_000).cast("string"), F.lit(":"), part(6000, 60), F.lit(":"), part(100, 60), F.lit("."), part(1, 100))


def centis_of_code(x: Column | str) -> Column:
    """Centiseconds of H:MM:SS.cc; null for anything else."""
    pattern = r"^([0-9]{1,9}):([0-5][0-9]):([0-5][0-9])\.([0-9]{2})$"
    num = lambda k: F.nullif(F.regexp_extract(_c(x), pattern, k), F.lit("")).cast("bigint")
    return num(1) * 360_000 + num(2) * 6000 + num(3) * 100 + num(4)


def seconds_of_clock(x: Column | str) -> Column:
    """Seconds of MM:SS or H:MM:SS; null if a part is no number."""
    parts = F.transform(F.split(_c(x), ":"), lambda p: F.when(p.rlike("^[0-9]{1,9}$"), p.cast("bigint")))
    return F.when(_c(x).rlike("^[0-9]{1,9}(:[0-9]{1,9}){1,2}$"), F.aggregate(parts, F.lit(0).cast("bigint"), lambda s, p: s * 60 + p))


def clock_of_seconds(s: Column | str) -> Column:
    """Whole seconds as MM:SS, minutes beyond 59 going on."""
    c = F.greatest(F.floor(_c(s)), F.lit(0))
    minutes = F.floor(c / 60).cast("string")
    return F.concat(F.when(F.length(minutes) < 2, F.lpad(minutes, 2, "0")).otherwise(minutes), F.lit(":"), F.lpad((c % 60).cast("string"), 2, "0"))


def human_seconds(s: Column | str) -> Column:
    """'45 s', '3 min 05 s' or '2 h 07 min', rounded down."""
    c = F.floor(_c(s))
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return (
        F.when(c < 60, F.concat(c.cast("string"), F.lit(" s")))
        .when(c < 3600, F.concat(F.floor(c / 60).cast("string"), F.lit(" min "), two(c % 60), F.lit(" s")))
        .otherwise(F.concat(F.floor(c / 3600).cast("string"), F.lit(" h "), two(F.floor(c / 60) % 60), F.lit(" min")))
    )


def half_up(x: Column | str, step: float) -> Column:
    """Rounded half up to a multiple of step."""
    return F.floor(_c(x) / step + 0.5) * step


def packed(f1: Column, f2: Column, dt: Column) -> Column:
    """Three numbers clamped to ten bits each in one."""
    ten = lambda c: F.least(F.greatest(c, F.lit(0)), F.lit(1023)).cast("bigint")
    return F.shiftleft(ten(f1), 20).bitwiseOR(F.shiftleft(ten(f2), 10)).bitwiseOR(ten(dt))
