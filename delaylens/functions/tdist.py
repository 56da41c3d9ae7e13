"""Student t distribution: quantiles for confidence margins, tail areas for
Welch's test.

Spark SQL has no t distribution. Two-sided 95 % quantiles are needed for
integer degrees of freedom only (n - 1 of a sample), so they are served as a
literal lookup map for small dof and by the Cornish-Fisher expansion of the
t quantile in the normal quantile for large dof, where its error is far below
1e-9. The map is generated from the incomplete beta function below, not
typed in.
"""

from __future__ import annotations

import math
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

TABLE_MAX_DOF = 300          # map covers dof 1..TABLE_MAX_DOF
Z_975 = 1.959963984540054    # standard normal 0.975 quantile


def _betacf(a: float, b: float, x: float) -> float:
    """Continued fraction for the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c = 1.0
    d = 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        step = d * c
        h *= step
        if abs(step - 1.0) < 1e-16:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    log_front = (math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                 + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(log_front) * _betacf(a, b, x) / a
    return 1.0 - math.exp(log_front) * _betacf(b, a, 1.0 - x) / b


def t_sf(t: float, dof: float) -> float:
    """Upper tail P(T > t) for T ~ t(dof); dof may be fractional."""
    if t != t or dof != dof or dof <= 0:
        return float("nan")
    tail = 0.5 * betainc(dof / 2.0, 0.5, dof / (dof + t * t))
    return tail if t >= 0 else 1.0 - tail


def t_ppf(p: float, dof: float) -> float:
    """Quantile of t(dof) for 0.5 < p < 1 by bisection on the tail area."""
    target = 1.0 - p
    lo, hi = 0.0, 1.0
    while t_sf(hi, dof) > target:
        hi *= 2.0
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        if t_sf(mid, dof) > target:
            lo = mid
        else:
            hi = mid
        if hi - lo < 1e-15 * max(1.0, hi):
            break
    return 0.5 * (lo + hi)


def t975_expansion(dof: float, z: float = Z_975) -> float:
    """Cornish-Fisher expansion of the t quantile (four correction terms)."""
    g1 = (z ** 3 + z) / 4.0
    g2 = (5 * z ** 5 + 16 * z ** 3 + 3 * z) / 96.0
    g3 = (3 * z ** 7 + 19 * z ** 5 + 17 * z ** 3 - 15 * z) / 384.0
    g4 = (79 * z ** 9 + 776 * z ** 7 + 1482 * z ** 5 - 1920 * z ** 3 - 945 * z) / 92160.0
    return z + g1 / dof + g2 / dof ** 2 + g3 / dof ** 3 + g4 / dof ** 4


@lru_cache(maxsize=1)
def t975_table() -> tuple[tuple[int, float], ...]:
    """(dof, t_0.975) for dof 1..TABLE_MAX_DOF, computed once per process."""
    return tuple((v, t_ppf(0.975, float(v))) for v in range(1, TABLE_MAX_DOF + 1))


def _expansion_col(dof: Column) -> Column:
    z = Z_975
    v = dof.cast("double")
    g1 = (z ** 3 + z) / 4.0
    g2 = (5 * z ** 5 + 16 * z ** 3 + 3 * z) / 96.0
    g3 = (3 * z ** 7 + 19 * z ** 5 + 17 * z ** 3 - 15 * z) / 384.0
    g4 = (79 * z ** 9 + 776 * z ** 7 + 1482 * z ** 5 - 1920 * z ** 3 - 945 * z) / 92160.0
    return (F.lit(z) + F.lit(g1) / v + F.lit(g2) / (v * v) + F.lit(g3) / (v * v * v)
            + F.lit(g4) / (v * v * v * v))


@lru_cache(maxsize=1)
def _t975_map_sql() -> str:
    # one SQL map literal (parsed once on the JVM side, constant-folded by
    # the optimizer) instead of hundreds of separate literal columns
    return "map(" + ", ".join(f"{v}, {t!r}D" for v, t in t975_table()) + ")"


def t975(dof) -> Column:
    """Two-sided 95 % t quantile as a column of the integer dof column."""
    dof = F.col(dof) if isinstance(dof, str) else dof
    table = F.expr(_t975_map_sql())
    return (F.when(dof < 1, F.lit(None).cast("double"))
            .when(dof <= TABLE_MAX_DOF, F.element_at(table, dof.cast("int")))
            .otherwise(_expansion_col(dof)))


def t975_sql_values() -> str:
    """The same table as an SQL VALUES list ``(dof, t)`` for SQL engines."""
    return ", ".join(f"({v}, {t!r})" for v, t in t975_table())


def t975_sql_expansion(dof_sql: str) -> str:
    z = Z_975
    g1 = (z ** 3 + z) / 4.0
    g2 = (5 * z ** 5 + 16 * z ** 3 + 3 * z) / 96.0
    g3 = (3 * z ** 7 + 19 * z ** 5 + 17 * z ** 3 - 15 * z) / 384.0
    g4 = (79 * z ** 9 + 776 * z ** 7 + 1482 * z ** 5 - 1920 * z ** 3 - 945 * z) / 92160.0
    v = f"CAST({dof_sql} AS DOUBLE)"
    return (f"({z!r} + {g1!r}/{v} + {g2!r}/({v}*{v}) + {g3!r}/({v}*{v}*{v})"
            f" + {g4!r}/({v}*{v}*{v}*{v}))")


@F.pandas_udf(DoubleType())
def two_sided_p(t: pd.Series, dof: pd.Series) -> pd.Series:
    """Two-sided p-value 2 * P(T > |t|); used on aggregated rows only."""
    out = []
    for tv, dv in zip(t, dof):
        if tv is None or dv is None or pd.isna(tv) or pd.isna(dv):
            out.append(float("nan"))
        else:
            out.append(min(1.0, 2.0 * t_sf(abs(float(tv)), float(dv))))
    return pd.Series(out, dtype="float64")
