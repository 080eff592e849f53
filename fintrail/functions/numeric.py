"""Column helpers shared by the operators. All are JVM expressions."""

from __future__ import annotations

import math
from datetime import datetime

from pyspark.sql import Column, functions as F

DAY_MICROS = 86_400_000_000
LN2 = math.log(2.0)


def clip(c: Column, lo: float, hi: float) -> Column:
    """Clamp to [lo, hi]; null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.lit(float(lo)), F.least(c, F.lit(float(hi)))))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def ratio(num: Column, den: Column, default: float | None = 0.0) -> Column:
    """num / den where den > 0, else the default."""
    return F.when(den > 0, num / den).otherwise(F.lit(default))


def rnd(c: Column | str, places: int) -> Column:
    """Round half up. The nudge keeps exact halves from depending on summation order."""
    return F.round((F.col(c) if isinstance(c, str) else c) + 1e-9, places)


def zsum(c: Column) -> Column:
    """Sum that is 0.0 on an empty or all-null group."""
    return F.coalesce(F.sum(c), F.lit(0.0))


def ntz(t: datetime) -> Column:
    """Literal of a wall-clock time, whatever zone the driver or session is in."""
    return F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def age_days(ts: Column, ref: datetime | Column) -> Column:
    """Fractional days from ts up to ref, never negative."""
    ref_c = ref if isinstance(ref, Column) else ntz(ref)
    return F.greatest(F.lit(0.0), (micros(ref_c) - micros(ts)) / F.lit(float(DAY_MICROS)))


def decay(ts: Column, ref: datetime | Column, half_life: float) -> Column:
    return F.exp(F.lit(-LN2 / half_life) * age_days(ts, ref))


def day_number(c: Column) -> Column:
    """Days since 1970-01-01 as an int, usable in range frames."""
    return F.unix_date(F.to_date(c))


def month_index(c: Column) -> Column:
    return F.year(c) * 12 + F.month(c) - 1


def instalment(principal: Column, apr: Column, months: Column) -> Column:
    """Amortised monthly payment; apr in percent a year."""
    r = F.greatest(F.lit(0.0), apr / 12.0 / 100.0)
    growth = F.pow(1.0 + r, months.cast("double"))
    return (F.when(r <= 0, principal / months)
            .otherwise(principal * r * growth / F.greatest(growth - 1.0, F.lit(1e-9))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0.0 when either vector has no length."""
    na, nb = norm(a), norm(b)
    return F.when((na < 1e-9) | (nb < 1e-9), F.lit(0.0)).otherwise(dot(a, b) / (na * nb))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")),
        F.lit(0.0), lambda s, v: s + v * v))


def level(score: Column, *cuts: tuple[float, str], default: str) -> Column:
    """Label by the first cut the score reaches, cuts given from high to low."""
    out = None
    for bound, name in cuts:
        out = F.when(score >= bound, name) if out is None else out.when(score >= bound, name)
    return out.otherwise(default)
