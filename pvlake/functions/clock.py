"""Wall-clock arithmetic on TIMESTAMP_NTZ that never depends on the session zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOT_MINUTES = 15
SLOT_US = SLOT_MINUTES * 60 * 1_000_000
HOUR_US = 3_600 * 1_000_000
DAY_US = 24 * HOUR_US
SLOTS_PER_DAY = 96


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970-01-01 00:00 on the same wall clock."""
    ts = col(ts)
    days = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long")
    seconds = F.extract(F.lit("SECOND"), ts)
    return (
        days * DAY_US
        + F.hour(ts).cast("long") * HOUR_US
        + F.minute(ts).cast("long") * (60 * 1_000_000)
        + (seconds * 1_000_000).cast("long")
    )


def from_micros(us: Column | str) -> Column:
    """Inverse of :func:`micros`."""
    us = col(us)
    inside = F.pmod(us, F.lit(DAY_US))
    day = ((us - inside) / F.lit(DAY_US)).cast("int")
    seconds = (inside.cast("decimal(12,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)")
    base = F.date_add(F.lit("1970-01-01").cast("date"), day).cast("timestamp_ntz")
    return base + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def floor_slot(ts: Column | str, minutes: int = SLOT_MINUTES) -> Column:
    """Start of the ``minutes``-wide slot (a divisor of 60) holding ``ts``."""
    ts = col(ts)
    return ts - F.make_dt_interval(
        F.lit(0), F.lit(0), F.pmod(F.minute(ts), F.lit(minutes)), F.extract(F.lit("SECOND"), ts)
    )


def floor_hour(ts: Column | str) -> Column:
    return floor_slot(ts, 60)


def floor_day(ts: Column | str) -> Column:
    return F.to_date(col(ts)).cast("timestamp_ntz")


def shift(ts: Column | str, *, days: int = 0, hours: int = 0, minutes: int = 0, seconds: int = 0) -> Column:
    return col(ts) + F.make_dt_interval(F.lit(days), F.lit(hours), F.lit(minutes), F.lit(seconds))


def month_key(ts: Column | str) -> Column:
    return F.date_format(col(ts), "yyyy-MM")


def slot_of_day(ts: Column | str) -> Column:
    """0 … 95."""
    ts = col(ts)
    return (F.hour(ts) * 4 + F.floor(F.minute(ts) / F.lit(15))).cast("int")


def fractional_hour(ts: Column | str) -> Column:
    ts = col(ts)
    return F.hour(ts) + F.minute(ts) / F.lit(60.0)


def slot_label(slot: Column | str) -> Column:
    """``HH:MM`` of a slot index."""
    slot = col(slot)
    return F.format_string("%02d:%02d", F.floor(slot / F.lit(4)).cast("int"), (F.pmod(slot, F.lit(4)) * 15).cast("int"))


def computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns through a one-element ``inline``.

    Optimizer rules that substitute expressions stop at a generator, which still is
    part of whole-stage code generation: use it for costly columns that are used
    many times over.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def add_utc(df: DataFrame, ts: str, zone: str, name: str = "utc") -> DataFrame:
    """Local wall clock to UTC wall clock under daylight-saving rules.

    A repeated hour gives null; a skipped local time moves to the first instant that
    exists, i.e. the whole hour after the jump. Both show in the distance to the
    image of the time one hour later: two hours at a repeat (the earlier reading is
    taken first), none at a jump. Zone look-ups are costly, so there are just two.
    """
    def to_utc(t: Column) -> Column:
        return F.convert_timezone(F.lit(zone), F.lit("UTC"), t)

    images = computed(df, {"_utc": to_utc(F.col(ts)), "_hour_later": to_utc(shift(ts, hours=1))})
    settled = (
        F.when(F.col("_hour_later") > shift("_utc", hours=1), F.lit(None).cast("timestamp_ntz"))
        .when(F.col("_hour_later") < shift("_utc", hours=1), to_utc(shift(floor_hour(ts), hours=1)))
        .otherwise(F.col("_utc"))
    )
    return computed(images, {name: settled}).drop("_utc", "_hour_later")
