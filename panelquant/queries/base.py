"""Registration of queries and the shared output form of a query and its SQL twin."""
from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from panelquant.sources.adapters import CTE

REGISTRY: dict[str, Callable] = {}
SQL: dict[str, str] = {}
#: Per signal class the body of its twin, its own table expressions, key, columns, digits and observation gates: (body, ctes, key, columns, digits, min_obs).
CLASS_SQL: dict[str, tuple] = {}
_NUDGE = 0.0317  # moves exact decimal halves off the rounding edge, the same way in both engines


def out(df: DataFrame, keys, nums, digits: int = 6) -> DataFrame:
    """Keys as strings, measures rounded; -0.0 and NaN normalised so both engines print the same."""
    nums = nums if isinstance(nums, dict) else {c: digits for c in nums}
    n = lambda c, k: F.when(~F.isnan(F.col(c).cast("double")), F.round(F.col(c).cast("double") + F.lit(_NUDGE * 10.0 ** -k), k) + F.lit(0.0)).alias(c)
    return df.select(*[F.col(c).cast("string").alias(c) for c in keys], *[n(c, k) for c, k in nums.items()])


def sql_out(body: str, keys, nums, digits: int = 6, ctes=()) -> str:
    nums = nums if isinstance(nums, dict) else {c: digits for c in nums}
    q = lambda c: f'"{c}"'
    sel = [f"CAST({q(c)} AS VARCHAR) AS {q(c)}" for c in keys] + [
        f"CASE WHEN NOT isnan(CAST({q(c)} AS DOUBLE)) THEN CASE WHEN round(CAST({q(c)} AS DOUBLE) + {_NUDGE}e{-k}, {k}) = 0 THEN 0.0::DOUBLE "
        f"ELSE round(CAST({q(c)} AS DOUBLE) + {_NUDGE}e{-k}, {k}) END END AS {q(c)}" for c, k in nums.items()]
    text = f"{with_clause(ctes, body)} SELECT {', '.join(sel)} FROM _body"
    return re.sub(r'(?<!")\bat\b(?!")', '"at"', text)  # the item name is a reserved word there


def with_clause(ctes, body: str) -> str:
    seen: list[str] = []

    def add(n):
        deps, text = CTE[n]
        for x in deps:
            add(x)
        if text not in seen:
            seen.append(text)

    for c in ctes:
        add(c) if c in CTE else seen.append(c)
    return "WITH " + ",\n".join([*seen, f"_body AS ({body})"])


def query(name: str, keys, nums, sql: str | None = None, ctes=(), digits: int = 6):
    """Register fn(spark, dir) -> DataFrame; its result and the SQL body are put in the shared form."""
    def deco(fn):
        def run(spark, d):
            return out(fn(spark, d), keys, nums, digits)
        if name in REGISTRY:
            raise ValueError(name)
        REGISTRY[name] = run
        if sql is not None:
            SQL[name] = sql_out(sql, keys, nums, digits, ctes)
        return fn
    return deco


def grid_cte(start: str, end: str, step: str = "1 MONTH", name: str = "g") -> str:
    return f"{name} AS (SELECT CAST(x AS DATE) AS T FROM (SELECT unnest(generate_series(DATE '{start}', DATE '{end}', INTERVAL {step})) AS x))"
