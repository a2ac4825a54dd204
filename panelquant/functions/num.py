"""Numeric helpers that keep IEEE results under ANSI mode.

ANSI Spark raises on x/0 and turns ln(0) into null.  The panel semantics need +-inf
there (it ranks above or below every finite value), and null for 0/0.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, functions as F



def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def let(x: Column, f) -> Column:
    """f(x) with x evaluated once: a Column used in several places is otherwise evaluated anew in each, inside lambdas even per element."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def fdiv(a, b) -> Column:
    """a / b with x/0 = +-inf and 0/0 = null."""
    a, b = _c(a).cast("double"), _c(b).cast("double")
    zero = F.when(a > 0, F.lit(math.inf)).when(a < 0, F.lit(-math.inf))
    return F.when(b == 0, zero).otherwise(a / F.nullif(b, F.lit(0.0)))


def fln(x) -> Column:
    """Natural log: -inf at zero, null below."""
    x = _c(x).cast("double")
    return F.when(x == 0, F.lit(-math.inf)).when(x > 0, F.ln(x))


def fpow(x, p: float) -> Column:
    """Fractional power, null for negative bases."""
    x = _c(x).cast("double")
    return F.when(x >= 0, F.pow(x, F.lit(p)))


def fsqrt(x) -> Column:
    x = _c(x).cast("double")
    return F.when(x >= 0, F.sqrt(x))


def null_if(x, cond) -> Column:
    """x, but null where cond is true (a null condition keeps x)."""
    return F.when(~F.coalesce(cond, F.lit(False)), _c(x))


def flag(cond) -> Column:
    """1.0 / 0.0 indicator; a comparison with a missing value is 0."""
    return F.coalesce(cond, F.lit(False)).cast("double")


def nz(x, v=0.0) -> Column:
    return F.coalesce(_c(x), F.lit(v))


def clean(x) -> Column:
    """NaN (inf-inf, 0*inf) becomes null."""
    x = _c(x)
    return F.when(~F.isnan(x), x)


def finite(x) -> Column:
    """NaN and infinities become null."""
    x = _c(x)
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(math.inf)), x)


def book_equity(seq="seq", ceq="ceq", pstk="pstk", pstkrv="pstkrv", pstkl="pstkl", at="at", lt="lt"):
    """Book equity: first non-missing of three definitions, net of preferred stock."""
    ps = F.coalesce(_c(pstkrv), _c(pstkl), _c(pstk))
    return F.coalesce(_c(seq) - nz(ps), _c(ceq) + _c(pstk) - ps, _c(at) - _c(lt) - nz(ps))


def dated_mean(x, date) -> Column:
    """Aggregate: mean of the non-null values, added up in date order.

    A sum of doubles depends on its order, and rows reach an aggregate in any: equal series get the same mean to the last bit only if the
    order is theirs.  Holds the values of the group, so groups must be bounded, as (id, month) is.
    """
    x = _c(x).cast("double")
    rows = F.sort_array(F.collect_list(F.when(x.isNotNull(), F.struct(_c(date).alias("d"), x.alias("x")))))
    return let(rows, lambda v: F.aggregate(v, F.lit(0.0), lambda s, y: s + y["x"]) / F.nullif(F.size(v), F.lit(0)))


def month_no(d) -> Column:
    """Months since year 0, so calendar-month arithmetic is integer arithmetic."""
    d = _c(d)
    return F.year(d) * 12 + F.month(d) - 1


def month_start(m) -> Column:
    m = _c(m)
    return F.make_date(F.floor(m / 12).cast("int"), (m % 12 + 1).cast("int"), F.lit(1))


def bucket_of(x) -> Column:
    """Order-preserving integer bucket of a double, computed row by row.

    1024 steps per power of two, so a hot group spreads over thousands of buckets and
    equal values always share one.  Being a pure function of the value it is the same in
    every evaluation of the plan, unlike sampled range boundaries.
    """
    x = _c(x)
    mag = F.least(F.greatest(F.floor(F.log2(F.abs(x)) * 1024), F.lit(-1200000)), F.lit(1200000)) + 1300000
    return (F.when(x == 0, F.lit(0)).when(x == math.inf, F.lit(3000000)).when(x == -math.inf, F.lit(-3000000))
            .when(x > 0, mag).otherwise(-mag)).cast("long")
