"""Column expressions shared by the operators (all JVM-side, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankloom import config as C


def num(col: str | Column) -> Column:
    """Lenient numeric coercion: unparseable text becomes null (pandas `coerce`)."""
    c = F.col(col) if isinstance(col, str) else col
    return c.try_cast("double")


def clip(c: Column, lo: float | None = None, hi: float | None = None) -> Column:
    if lo is not None:
        c = F.greatest(c, F.lit(float(lo)))
    if hi is not None:
        c = F.least(c, F.lit(float(hi)))
    return c


def interaction_weight(columns: list[str]) -> Column:
    """1 + Σ flag·w (flags clipped to [0,1]) + 0.5·min(view/300, 1).

    Only signal columns present in ``columns`` contribute; unparseable values count as 0.
    """
    w = F.lit(1.0)
    for name, add in C.BEHAVIOR_FLAG_WEIGHTS.items():
        if name in columns:
            w = w + F.lit(add) * clip(F.coalesce(num(name), F.lit(0.0)), 0, 1)
    if C.VIEW_TIME_COL in columns:
        vt = clip(F.coalesce(num(C.VIEW_TIME_COL), F.lit(0.0)), lo=0)
        w = w + F.lit(C.VIEW_TIME_WEIGHT) * clip(vt / F.lit(C.VIEW_TIME_SATURATION), hi=1.0)
    return w


def confidence(weight_col: str | None = "interaction_weight") -> Column:
    """Interaction weight with null→1 and a floor of 0.1; 1 when absent."""
    if weight_col is None:
        return F.lit(1.0)
    return F.greatest(F.coalesce(F.col(weight_col), F.lit(1.0)), F.lit(0.1))


# ── time (UTC, independent of the session zone) ───────────────────────────────
def epoch_seconds_ntz(col: str) -> Column:
    """Unix seconds of a zone-less timestamp read as UTC."""
    c = F.col(col)
    return (F.unix_date(F.to_date(c)).cast("long") * 86400
            + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c).cast("long"))


def hour_of(ts: str | Column) -> Column:
    t = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.pmod(t, F.lit(86400)) / 3600).cast("int")


def weekday_of(ts: str | Column) -> Column:
    """Monday = 0 … Sunday = 6 (1970-01-01 was a Thursday)."""
    t = F.col(ts) if isinstance(ts, str) else ts
    return F.pmod(F.floor(t / 86400) + 3, F.lit(7)).cast("int")


def month0_of(ts: str | Column) -> Column:
    """January = 0."""
    t = F.col(ts) if isinstance(ts, str) else ts
    return (F.month(F.date_from_unix_date(F.floor(t / 86400).cast("int"))) - 1).cast("int")


def utc_datetime(ts: str | Column) -> Column:
    t = F.col(ts) if isinstance(ts, str) else ts
    return F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'") + F.make_dt_interval(
        secs=t.cast("decimal(18,6)"))


# ── engagement for single interactions (Q02/T02) ─────────────────────────────
def engagement_weight(flags: dict[str, Column], view_time: Column) -> Column:
    """Weight of one interaction from boolean flags and view time (Q02)."""
    w = F.lit(1.0)
    for name, add in C.BEHAVIOR_FLAG_WEIGHTS.items():
        if name in flags:
            w = w + F.when(F.coalesce(flags[name], F.lit(False)), F.lit(add)).otherwise(F.lit(0.0))
    vt = F.coalesce(view_time, F.lit(0.0))
    w = w + F.when(vt > 0, F.lit(C.VIEW_TIME_WEIGHT) * F.least(vt / F.lit(C.VIEW_TIME_SATURATION),
                                                                F.lit(1.0))).otherwise(F.lit(0.0))
    return w


def inferred_rating(weight: Column) -> Column:
    """3 + 2·min((w − 1)/max_extra, 1)."""
    return F.lit(3.0) + F.lit(2.0) * F.least((weight - F.lit(1.0)) / F.lit(C.MAX_EXTRA_ENGAGEMENT),
                                             F.lit(1.0))


# ── dense vectors stored as array<double> ─────────────────────────────────────
def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x))


def normalise(a: Column) -> Column:
    """Unit vector; a zero vector stays zero. The vector and its norm are worked out once, not per element."""
    def unit(v: Column) -> Column:
        scaled = F.transform(F.array(norm(v)), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v))
        return F.element_at(scaled, 1)

    return F.element_at(F.transform(F.array(a), unit), 1)


def ema_alpha(rating: Column, engagement: Column) -> Column:
    """B08 step size: min(0.6, 0.2·(rating/5)·max(engagement, 0.1))."""
    return F.least(F.lit(C.EMA_MAX_ALPHA),
                   F.lit(C.EMA_BASE) * (rating / F.lit(5.0)) * F.greatest(engagement, F.lit(0.1)))


def ema_step(profile: Column, item_vec: Column, alpha: Column) -> Column:
    """normalise((1 − α)·p + α·v)."""
    mixed = F.zip_with(profile, item_vec, lambda p, v: (F.lit(1.0) - alpha) * p + alpha * v)
    return normalise(mixed)


def round6(c: Column) -> Column:
    return F.round(c, 6)
