"""Cleaning rules for daily panels: projections and bounded windows per security."""
from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, Window as W, functions as F

from panelquant.functions.num import fdiv, nz
from panelquant.functions.stage import stage
from panelquant.operators.series import running_product

c = F.col


def _w(key="DTID", date="date"):
    return W.partitionBy(key).orderBy(date)


def rename_columns(df: DataFrame, mapping: dict[str, str], pattern: str | None = None) -> DataFrame:
    """Rename by dictionary; with a pattern, each header is first reduced to its matching code."""
    code = (lambda n: (re.search(pattern, n) or [n])[0]) if pattern else (lambda n: n)
    return df.withColumnsRenamed({n: mapping.get(code(n), code(n)) for n in df.columns})


def rescale(df: DataFrame, cols, factor: float) -> DataFrame:
    return df.withColumns({x: c(x) * factor for x in cols})


def repair_values(df: DataFrame, id_col="DTID", price_cap=100_000.0, keep_ids=("982325",), floors=(("VOL", 0.0, 0.025), ("PRC", 0.0, 0.0001)),
                  index_floor=0.0001, hl_ratio=8.0, vol_share=0.25) -> DataFrame:
    """Row-level repairs: exact zeros to small values, index floor, absurd prices (one known id
    excepted), crossed or equal quotes, impossible high/low, volume capped by market value."""
    d = df
    for col, bad, good in floors:
        d = d.withColumn(col, F.when(c(col) == bad, F.lit(good)).otherwise(c(col)))
    d = d.withColumn("RI", F.when(c("RI") < index_floor, F.lit(index_floor)).otherwise(c("RI")))
    big = F.coalesce((c("PRC") > price_cap) & ~c(id_col).isin(*keep_ids), F.lit(False))
    d = d.withColumns({x: F.when(~big, c(x)) for x in ("PRC", "H", "L") if x in d.columns})
    if "BID" in d.columns:
        eq = F.coalesce(c("BID") == c("ASK"), F.lit(False))
        d = d.withColumns({x: F.when(~eq, c(x)) for x in ("BID", "ASK")})
    bad = F.coalesce((c("H") < c("L")) | (fdiv("H", "L") > hl_ratio), F.lit(False))
    d = d.withColumns({x: F.when(~bad, c(x)) for x in ("H", "L")})
    cap = c("MC") * vol_share * 1e6 / F.nullif(c("PRC"), F.lit(0.0))
    d = d.withColumn("VOL", F.when(c("PRC") * c("VOL") / 1e6 > c("MC") * vol_share, cap).otherwise(c("VOL")))
    num = [f.name for f in d.schema.fields if f.dataType.simpleString() == "double"]
    return d.withColumns({x: F.when(~F.isnan(x) & (F.abs(x) != math.inf), c(x)) for x in num})


def fill_after_first(df: DataFrame, col="VOL", value=0.0, key="DTID", date="date") -> DataFrame:
    """Missing values become `value` once a value was seen."""
    seen = F.max(c(col).isNotNull()).over(_w(key, date).rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn(col, F.when(c(col).isNull() & seen, F.lit(value)).otherwise(c(col)))


def drop_trailing_padding(df: DataFrame, col="PRC", longest=20, key="DTID", date="date") -> DataFrame:
    """Drop the final run of missing values of a security when it is longer than `longest` rows; rows without a key are dropped.

    The run is everything after the last non-missing date.  Both figures are taken over the series where it lies, beside the other
    windows per security: joined aggregates would evaluate what comes before three times and exchange its rows twice.
    """
    whole = W.partitionBy(key)
    t = df.filter(c(key).isNotNull()).withColumn("_last", F.max(F.when(c(col).isNotNull(), c(date))).over(whole))
    t = t.withColumn("_tail", F.coalesce(c("_last").isNull() | (c(date) > c("_last")), F.lit(False)))
    return t.withColumn("_n", F.count(F.when(c("_tail"), 1)).over(whole)).filter(~(c("_tail") & (c("_n") > longest))).drop("_last", "_tail", "_n")


def repair_padded_splits(df: DataFrame, up=1.5, down=0.5, reach=5, cols=("RI",), key="DTID", date="date") -> DataFrame:
    """Undo index jumps caused by a split on a day without trades.

    A row is marked when index and adjustment factor jump together, volume is zero and one of the
    next rows trades.  Each of `reach` passes extends the mark over following zero-volume rows,
    copies the previous index and blanks the price.  A pass reads the result of the one before.
    """
    w = _w(key, date)
    l, f = F.lag, F.lead
    ri, af = fdiv("RI", l("RI").over(w)), fdiv(f("AF").over(w), l("AF").over(w))
    trade = F.lit(False)
    for k in range(1, reach + 1):
        trade = trade | F.coalesce(f("VOL", k).over(w) != 0, F.lit(True))
    mark = F.coalesce((((ri > up) & (af > up)) | ((ri < down) & (af < down))) & (c("VOL") == 0) & trade, F.lit(False))
    d = df.withColumn("_m", mark)
    for _ in range(reach):
        d = d.withColumn("_m", c("_m") | F.coalesce((c("VOL") == 0) & l("_m").over(w), F.lit(False)))
        d = d.withColumns({x: F.when(c("_m"), l(x).over(w)).otherwise(c(x)) for x in cols})
    return d.withColumn("PRC", F.when(~c("_m"), c("PRC"))).drop("_m")


def repair_reversals(df: DataFrame, cols=("RI",), key="DTID", date="date") -> DataFrame:
    """One-day spikes and crashes that revert the next day become the mean of the neighbours.

    Spike: > 2x, then < 1.1x of the day before.  Crash: < 0.5x, then > 0.9x.  Neighbours are
    read once, before any repair; the second rule sees the index repaired by the first.
    """
    w = _w(key, date)
    d = df.withColumns({f"_l_{x}": F.lag(x).over(w) for x in cols} | {f"_f_{x}": F.lead(x).over(w) for x in cols})
    for hi, far, near, up in ((True, 2.0, 1.1, True), (False, 0.5, 0.9, False)):
        a, b = fdiv("RI", "_l_RI"), fdiv("_f_RI", "_l_RI")
        bad = ((a > far) & (b < near)) if hi else ((a < far) & (b > near))
        d = d.withColumn("_b", F.coalesce(bad, F.lit(False)))
        d = d.withColumns({x: F.when(c("_b"), (c(f"_f_{x}") + c(f"_l_{x}")) / 2).otherwise(c(x)) for x in cols})
    return d.drop("_b", *[f"_{s}_{x}" for s in "lf" for x in cols])


def null_outlier_returns(df: DataFrame, limit=6.0, cols=("RI",), key="DTID", date="date", ret="r") -> DataFrame:
    """Index values more than `limit` times the previous row become null; then the daily return."""
    w = _w(key, date)
    d = df.withColumn("_l", F.lag("RI").over(w))
    bad = F.coalesce(fdiv("RI", "_l") > limit, F.lit(False))
    d = d.withColumns({x: F.when(~bad, c(x)) for x in cols})
    return d.withColumn(ret, fdiv("RI", "_l") - 1).drop("_l")


def text_hits(texts: DataFrame, rules: DataFrame, text: str = "text") -> DataFrame:
    """(text, rule) for every distinct text that contains a rule's token; texts and tokens are compared as they are.

    A gram index: tokens are cut into grams of three letters (a shorter token is its own gram) and filed under the one that fewest texts
    hold; a text meets only the tokens filed under one of its grams, by an equi-join, and is then searched for the token.  Texts hold a bounded
    number of grams each; grams that no token has are dropped before anything is counted.
    """
    t = texts.select(c(text).alias("text")).where("text is not null").distinct()
    r = rules.where("token is not null and token <> ''").select("rule", "token").distinct()
    cut = lambda col, n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(col) - n + 1, F.lit(1))), lambda i: F.substr(c(col), i, F.lit(n)))
    grams = lambda df, col, sizes: df.withColumn("gram", F.explode(F.array_distinct(F.flatten(F.array(*[cut(col, n) for n in sizes])))))
    own = F.least(F.length("token"), F.lit(3))
    keyed = grams(r.withColumn("size", own), "token", (1, 2, 3)).where(F.length("gram") == c("size")).drop("size")
    sizes = [x["n"] for x in keyed.select(F.length("gram").alias("n")).distinct().collect()]  # of 1, 2 and 3
    if not sizes:
        return t.limit(0).select("text", F.lit(None).cast(rules.schema["rule"].dataType).alias("rule"))
    held = stage(grams(t, "text", sorted(sizes)).join(keyed.select("gram").distinct(), "gram"))
    count = held.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    filed = keyed.join(count, "gram", "left").groupBy("rule", "token").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("x")).select("rule", "token", "x.gram")
    return held.join(filed, "gram").where(F.contains("text", c("token"))).select("text", "rule").distinct()


def screen_rules(df: DataFrame, rules: DataFrame, columns: list[str], text: str = "NAME", id_col: str = "DTID", allow: DataFrame | None = None, deny: DataFrame | None = None) -> DataFrame:
    """Rows of df without those that a rule, and no entry of `allow`, or an entry of `deny` throws out.

    rules(rule, token, absent, inside, outside): a rule hits a text that contains token and none of `absent` (array), in rows where every column
    of `inside` (map of column -> values) holds one of its values and no column of `outside` holds one of its.  A null is never inside and
    always outside; a null map or array asks for nothing; a rule without token hits nothing.  `columns` lists the columns that maps may name.
    Texts are compared in upper case.  A rule is read once per distinct text and combination of these columns, whatever the number of rows.
    """
    up = df.select(F.upper(text).alias("text"), *columns).where("text is not null").distinct()
    hits = text_hits(up, rules, "text").join(rules.select("rule", "absent", "inside", "outside").dropDuplicates(["rule"]), "rule")
    bare = hits.where(~F.coalesce(F.exists("absent", lambda a: F.contains("text", a)), F.lit(False)))
    within = lambda m, col: F.array_contains(F.element_at(m, F.lit(col)), c(col))
    asked = lambda m, col: F.coalesce(F.map_contains_key(m, F.lit(col)), F.lit(False))
    ok = F.lit(True)
    for col in columns:
        ok = ok & (~asked("inside", col) | F.coalesce(within("inside", col), F.lit(False))) & ~(asked("outside", col) & F.coalesce(within("outside", col), F.lit(False)))
    bad = up.join(bare, "text").where(ok).select(c("text").alias("_t"), *[c(x).alias(f"_c_{x}") for x in columns]).distinct().withColumn("_bad", F.lit(True))
    on = F.upper(text) == c("_t")
    for x in columns:
        on = on & c(x).eqNullSafe(c(f"_c_{x}"))
    d = df.join(bad, on, "left").drop("_t", *[f"_c_{x}" for x in columns])
    if allow is not None:
        d = d.join(allow.select(id_col).distinct().withColumn("_ok", F.lit(True)), id_col, "left").withColumn("_bad", F.when(c("_ok").isNull(), c("_bad"))).drop("_ok")
    d = d.where(c("_bad").isNull()).drop("_bad").select(*df.columns)
    return d if deny is None else d.join(deny.select(id_col).distinct(), id_col, "left_anti").select(*df.columns)


def screen_text(df: DataFrame, rules: DataFrame, text="NAME", group="EXDSCD", allow: DataFrame | None = None, id_col="DTID") -> DataFrame:
    """Drop rows whose text contains a token; a rule may be limited to some exchanges.

    rules(token, exchanges array or null), of any number; an empty token hits nothing.  A null text or group is hit by nothing that needs it.
    `allow` ids are kept whatever their text says.  See `screen_rules`.
    """
    none = lambda kind: F.lit(None).cast(kind)
    r = rules.select(F.concat("token", F.lit("\x00"), F.coalesce(F.array_join("exchanges", "\x01"), F.lit("\x02"))).alias("rule"), "token", none("array<string>").alias("absent"),
                     F.when(c("exchanges").isNotNull(), F.create_map(F.lit(group), c("exchanges"))).alias("inside"), none("map<string,array<string>>").alias("outside"))
    return screen_rules(df, r, [group], text, id_col, allow)


def listed(df: DataFrame, keep: dict[str, list], exchanges: DataFrame, exchange: str = "EXDSCD") -> DataFrame:
    """Listings whose columns hold one of the given values (nulls only if None is among them), on the exchanges of a map, with its other columns."""
    for col, values in keep.items():
        known = [v for v in values if v is not None]
        df = df.where(F.coalesce(c(col).isin(known), F.lit(False)) | (c(col).isNull() if None in values else F.lit(False)))
    return df.join(exchanges, exchange)


def normalise_ticker(col):
    """Strip a leading "@:" or "@"."""
    return F.regexp_replace(col, "^@:?", "")


def share_factor(df: DataFrame, factor="DISFACSHR", out="AF", key="DTID", date="date") -> DataFrame:
    """Cumulative share adjustment: product of 1/(1 + previous factor), 1 at the last row."""
    w = _w(key, date)
    step = fdiv(F.lit(1.0), 1 + nz(F.lag(factor).over(w)))
    d = df.withColumn("_s", F.when(F.abs(step) != math.inf, step))
    d = d.withColumn("_a", F.when(c("_s").isNotNull(), running_product(c("_s"), w.rowsBetween(W.unboundedPreceding, 0))))
    last = F.last("_a", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return d.withColumn(out, fdiv("_a", nz(last, 1.0))).drop("_s", "_a")


def firm_market_value(df: DataFrame, firm="FTID", date="date", floor: float | None = None, cls="MCshare", out="MC") -> DataFrame:
    """Sum over the share classes of a firm and date; own class where the firm is unknown.

    The sum is an aggregate joined back, so rows without firm id never share a partition.  Not the rows but the sums are written: their
    size is known then, and where firms are few the rows stay where they lie.
    """
    g = stage(df.filter(c(firm).isNotNull()).groupBy(firm, date).agg(nz(F.sum(cls)).alias("_mc")))
    d = df.join(g, [firm, date], "left").withColumn(out, F.coalesce("_mc", cls)).drop("_mc")
    low = c(out) <= 0
    return d.withColumn(out, F.when(low, F.lit(floor).cast("double")).otherwise(c(out)))


def drop_holidays(df: DataFrame, holidays: DataFrame, cal_cols: dict[str, str], geo="GEOGN", date="date") -> DataFrame:
    """Remove rows on holidays of their market.

    holidays: one row per date, one 0/1 column per calendar (null before it is known).  The
    leading stretch of a calendar in which nothing but unknowns or ones appear is not treated as
    holidays.  cal_cols maps calendar columns to market names.
    """
    h = holidays.unpivot([date], list(cal_cols), "_cal", "hol")
    names = F.create_map(*[F.lit(x) for kv in cal_cols.items() for x in kv])
    h = h.withColumn(geo, F.element_at(names, c("_cal"))).withColumn("hol", nz(c("hol").cast("double"), 1.0))
    lead = F.min("hol").over(W.partitionBy("_cal").orderBy(date).rowsBetween(W.unboundedPreceding, 0))  # one row per calendar date
    h = h.withColumn("hol", F.when(lead == 1, 0.0).otherwise(c("hol"))).filter("hol = 1").select(date, geo).distinct()
    return df.join(h, [date, geo], "left_anti")
