"""Column expressions for cleaning, keys, encodings and normalised features."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_code(code: Column, width: int = 5) -> Column:
    """Trimmed and zero-filled on the left to ``width``; longer codes stay whole, blank ones become null."""
    c = F.trim(code.cast("string"))
    return F.when(c == "", None).when(F.length(c) < width, F.lpad(c, width, "0")).otherwise(c)


def parse_ts(text: Column, formats: Sequence[str]) -> Column:
    """The first of ``formats`` that parses; null if none does."""
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in formats))


def delay_minutes(actual: Column, scheduled: Column) -> Column:
    return F.timestamp_diff("SECOND", scheduled, actual) / 60.0


def rel_minutes(ts: Column, origin: Column) -> Column:
    """Minutes from the midnight of ``origin``; may exceed a day or be negative."""
    return F.timestamp_diff("SECOND", F.date_trunc("day", origin), ts) / 60.0


def fill_pair(arrival: Column, departure: Column) -> tuple[Column, Column]:
    return F.coalesce(arrival, departure), F.coalesce(departure, arrival)


def parse_pair(text: Column) -> Column:
    """``"A-B"`` as a struct (a, b), trimmed and upper case; null unless there are exactly two non-empty parts."""
    parts = F.transform(F.split(text, "-"), lambda p: F.upper(F.trim(p)))
    ok = (F.size(parts) == 2) & (F.element_at(parts, 1) != "") & (F.element_at(parts, 2) != "")
    return F.when(ok, F.struct(F.element_at(parts, 1).alias("a"), F.element_at(parts, 2).alias("b")))


def pair_key(a: Column, b: Column) -> Column:
    """A key that doesn't depend on the order of ``a`` and ``b``."""
    return F.concat_ws("|", F.least(a, b).cast("string"), F.greatest(a, b).cast("string"))


def cyclic_encode(minute: Column, weekday: Column) -> dict[str, Column]:
    """Sine and cosine of the time of day and of the week; Monday is 0."""
    day = F.pmod(minute, F.lit(1440)) * (2 * math.pi / 1440)
    week = weekday * (2 * math.pi / 7)
    return {"day_sin": F.sin(day), "day_cos": F.cos(day), "week_sin": F.sin(week), "week_cos": F.cos(week)}


def signed_log(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def signed_exp(y: Column) -> Column:
    """The inverse of ``signed_log``."""
    return F.signum(y) * F.expm1(F.abs(y))


def clamped_log(x: Column, top: float) -> Column:
    return F.log1p(F.least(F.greatest(x, F.lit(0.0)), F.lit(top))) / math.log1p(top)


def squash(x: Column, scale: float) -> Column:
    return F.tanh(x / F.lit(scale))


def unsquash(y: Column, scale: float) -> Column:
    """The inverse of ``squash`` inside (-1, 1)."""
    return F.atanh(y) * F.lit(scale)


def capped_ratio(x: Column, y: Column, top: float) -> Column:
    """``x / y`` no more than ``top``; 0 where ``y`` is 0 or null."""
    return F.coalesce(F.least(F.try_divide(x.cast("double"), y.cast("double")), F.lit(top)), F.lit(0.0))


def safe_number(value: Column, default: float) -> Column:
    """A number, or ``default`` for null, NaN and text that is none."""
    n = value.try_cast("double")
    return F.when(n.isNull() | F.isnan(n), F.lit(float(default))).otherwise(n)


def allowance_minutes(traffic_s: Column, engineering_s: Column) -> Column:
    return (safe_number(traffic_s, 0.0) + safe_number(engineering_s, 0.0)) / 60.0


def instance_key(code: Column, day: Column) -> Column:
    return F.concat_ws("_", code.cast("string"), day.cast("string"))


def severity(n: Column, base: float = 0.4, step: float = 0.1) -> Column:
    """Grows with the number of vehicles affected, up to 1; a missing number counts as none."""
    return F.least(F.lit(1.0), F.lit(base) + F.lit(step) * F.coalesce(n.cast("double"), F.lit(0.0)))


def speed_multiplier(speed: Column, reference: float = 100.0, top: float = 4.0) -> Column:
    """How much longer a section takes at ``speed``; null unless positive."""
    return F.when(speed > 0, F.least(F.lit(top), F.lit(reference) / speed))


def swap_day_month(ts: Column) -> Column:
    """The same moment with day and month exchanged, or null if that is no date."""
    return F.try_make_timestamp_ntz(F.year(ts), F.dayofmonth(ts), F.month(ts), F.hour(ts), F.minute(ts), F.second(ts).cast("decimal(16,6)"))


def stage_bucket(x: Column, edges: Sequence[float]) -> Column:
    """How many of the ascending ``edges`` are at or below ``x``; null stays null."""
    return F.when(x.isNotNull(), sum((F.when(x >= e, 1).otherwise(0) for e in edges), F.lit(0)))


def hhmm(minute: Column) -> Column:
    m = F.pmod(F.floor(minute), F.lit(1440)).cast("int")
    return F.format_string("%02d:%02d", F.floor(m / 60).cast("int"), m % 60)


def eligible(kind: Column, nominal: Sequence[str]) -> Column:
    """Nominal kinds act but are no targets; unknown kinds are targets."""
    return F.coalesce(~kind.isin(*nominal), F.lit(True))


def map_category(kind: Column, classes: dict[str, tuple], default: tuple, names: Sequence[str]) -> dict[str, Column]:
    """The attributes of a kind by a small table, or the default's."""
    out = {}
    for i, name in enumerate(names):
        picked = None
        for k, row in classes.items():
            picked = F.when(kind == k, F.lit(row[i])) if picked is None else picked.when(kind == k, F.lit(row[i]))
        out[name] = picked.otherwise(F.lit(default[i]))
    return out


def rounded_to(c: Column, digits: int) -> Column:
    """``round(c, digits)`` of a double, for columns of very many rows: only numbers near a tie, or large ones, take the way over decimal text."""
    scale = 10.0**digits
    near = F.rint(c * scale)
    plain = (F.abs(c) < 1e6) & (F.abs(c * scale - near) < 0.49)
    return F.when(plain, near / scale + 0.0).otherwise(F.round(c, digits))
