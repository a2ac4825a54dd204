"""Sources, cleaning rules, sorts, set operations, small functions and raw-file pipelines."""
from pyspark.sql import Window as W, functions as F

from panelquant.functions.num import month_no, month_start
from panelquant.functions.stage import work_dir
from panelquant.operators import clean as C, xsection as X
from panelquant.operators.asof import Grid, snapshot
from panelquant.operators.distribution import repair
from panelquant.queries.base import grid_cte, query
from panelquant.queries.core import PM, monthly
from panelquant.sources import io as IO, pipelines as PL
from panelquant.sources.adapters import TAUS, analyst_sum, events_panel, link_intervals, panel_nation, panel_supplier, quantile_vectors, statements, table

c = F.col
K = ["DTID", "date"]


def _round_trip(spark, df, fmt, **kw):
    """Write a table to the session's work folder and read it back through the library."""
    import uuid

    path = f"{work_dir(spark)}/io-{uuid.uuid4().hex}"
    if fmt == "csv":
        IO.write_csv(df, path)
    else:
        IO.write_parquet(df, path, **kw)
    return path


_NP = "SELECT DTID, date, PRC, VOL FROM pn"


@query("s01_csv_scan", K, ["PRC"], "SELECT DTID, date, PRC FROM pn", ["pn"])
def _(spark, d):
    p = _round_trip(spark, panel_nation(spark, d).select("DTID", "date", "PRC", "VOL", "region"), "csv")
    return IO.read_csv(spark, p, "DTID string, date date, PRC double, VOL double, region string", ["DTID", "date", "PRC"])


@query("s02_filtered_scan", K, ["PRC"], "SELECT DTID, date, PRC FROM ps WHERE region = 'ASIA'", ["ps"])
def _(spark, d):
    ids = (table(spark, d, "supplier").join(table(spark, d, "nation"), c("s_nationkey") == c("n_nationkey")).join(table(spark, d, "region"), c("n_regionkey") == c("r_regionkey"))
           .filter("r_name = 'ASIA'").select(c("s_suppkey").cast("string").alias("DTID")))
    return IO.filtered_scan(panel_supplier(spark, d), ids, "DTID")


@query("s03_table_scan", ["o_orderkey", "o_orderstatus"], ["o_totalprice"], "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def _(spark, d):
    return IO.read_table(spark, f"{d}/orders.parquet", ["o_orderkey", "o_orderstatus", "o_totalprice"])


@query("s04_parquet_columns", ["l_orderkey", "l_linenumber"], ["l_quantity"], "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def _(spark, d):
    return IO.read_table(spark, f"{d}/lineitem.parquet", ["l_orderkey", "l_linenumber", "l_quantity"])


@query("s05_partitioned_parquet_sink", [*K, "region", "y"], ["PRC"], "SELECT DTID, date, region, year(date) AS y, PRC FROM ps", ["ps"])
def _(spark, d):
    p = _round_trip(spark, panel_supplier(spark, d).select("DTID", "date", "PRC", "region", F.year("date").alias("y")), "parquet", partition_by=["region", "y"])
    return IO.read_table(spark, p)


@query("s06_csv_sink", ["p_partkey", "p_name"], ["p_retailprice"], "SELECT p_partkey, p_name, p_retailprice FROM part")
def _(spark, d):
    p = _round_trip(spark, table(spark, d, "part").select("p_partkey", "p_name", "p_retailprice"), "csv")
    return IO.read_csv(spark, p, "p_partkey long, p_name string, p_retailprice double")


@query("s07_lookup_table", ["DTID", "INDM"], ["n"], "SELECT DTID, n_name AS INDM, count(*) AS n FROM ps JOIN nation ON FTID = CAST(n_nationkey AS VARCHAR) GROUP BY 1, 2", ["ps"])
def _(spark, d):
    look = table(spark, d, "nation").select(c("n_nationkey").cast("string").alias("FTID"), c("n_name").alias("INDM"))
    return panel_supplier(spark, d).join(look, "FTID", "left").groupBy("DTID", "INDM").agg(F.count(F.lit(1)).alias("n"))


@query("s08_date_formats", ["o_orderkey", "a", "b", "c", "e"], [], "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) AS b, CAST(o_orderdate AS DATE) AS c, CAST(date_trunc('month', o_orderdate) AS DATE) AS e FROM orders")
def _(spark, d):
    o = table(spark, d, "orders")
    t = lambda f: F.date_format("o_orderdate", f)
    return o.select("o_orderkey", IO.parse_date(t("dd/MM/yyyy"), "dd/MM/yyyy").alias("a"), IO.parse_date(t("yyyy-MM-dd"), "yyyy-MM-dd").alias("b"),
                    IO.parse_date(t("yyyyMMdd"), "yyyyMMdd").alias("c"), IO.parse_date(t("yyyyMM"), "yyyyMM").alias("e"))


@query("s09_numeric_coercion", ["o_orderkey"], ["x"], "SELECT o_orderkey, TRY_CAST(split_part(o_orderpriority, '-', CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 2 END) AS DOUBLE) AS x FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", IO.to_number(F.split_part("o_orderpriority", F.lit("-"), F.when(c("o_orderkey") % 2 == 0, 1).otherwise(2))).alias("x"))


# ------------------------------------------------------------------ projections and cleaning
@query("p01_rename_by_code", ["id", "date"], ["price", "turnover"], "SELECT DTID AS id, date, PRC AS price, VOL AS turnover FROM pn", ["pn"])
def _(spark, d):
    raw = panel_nation(spark, d).select(c("DTID").alias("id"), "date", c("PRC").alias("Item(WC01001)"), c("VOL").alias("WC01002#x"))
    return C.rename_columns(raw, {"WC01001": "price", "WC01002": "turnover"}, r"WC[0-9]+")


@query("p02_derived_items", ["FTID", "FinYearEnd"], {"debt": 2, "neg": 2, "gm": 2}, "SELECT FTID, FinYearEnd, dltt + coalesce(dlc, 0) AS debt, -xsga AS neg, sale - cogs AS gm FROM ft", ["ft"])
def _(spark, d):
    f = statements(spark, d, ["dltt", "dlc", "xsga", "sale", "cogs"], with_mc=False)
    return f.select("FTID", "FinYearEnd", (c("dltt") + F.coalesce("dlc", F.lit(0.0))).alias("debt"), (-c("xsga")).alias("neg"), (c("sale") - c("cogs")).alias("gm"))


@query("p03_unit_rescale", K, ["PRC", "VOL"], "SELECT DTID, date, PRC / 1000 AS PRC, VOL / 1000 AS VOL FROM pn", ["pn"])
def _(spark, d):
    return C.rescale(panel_nation(spark, d), ["PRC", "VOL"], 1 / 1000)


@query("p04_membership_filters", ["o_orderkey"], ["o_totalprice"], "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus IN ('O', 'F') AND o_orderpriority = '1-URGENT' AND o_orderdate >= DATE '1998-01-01'")
def _(spark, d):
    return table(spark, d, "orders").filter(c("o_orderstatus").isin("O", "F") & (c("o_orderpriority") == "1-URGENT") & (c("o_orderdate") >= "1998-01-01"))


@query("p05_value_repair", K, ["PRC", "H", "L", "VOL", "BID"], """SELECT DTID, date, CASE WHEN PRC > 6000 AND DTID <> '7' THEN NULL ELSE PRC END AS PRC, CASE WHEN (PRC > 6000 AND DTID <> '7') OR H / L > 8 THEN NULL ELSE H END AS H,
 CASE WHEN (PRC > 6000 AND DTID <> '7') OR H / L > 8 THEN NULL ELSE L END AS L, CASE WHEN CASE WHEN PRC > 6000 AND DTID <> '7' THEN NULL ELSE PRC END * VOL / 1e6 > MC / 1e9 * 0.25 THEN MC / 1e9 * 0.25 * 1e6 / PRC ELSE VOL END AS VOL, CASE WHEN H <> L THEN H END AS BID FROM ps""", ["ps"], digits=5)
def _(spark, d):
    p = panel_supplier(spark, d).withColumn("MC", c("MC") / 1e9).withColumn("BID", c("H")).withColumn("ASK", c("L"))
    return C.repair_values(p, price_cap=6000.0, keep_ids=("7",))


@query("p06_fill_after_first", K, ["v"], "SELECT DTID, date, CASE WHEN v IS NULL AND max(CASE WHEN v IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY DTID ORDER BY date) = 1 THEN 0 ELSE v END AS v FROM (SELECT DTID, date, CASE WHEN VOL > 40 THEN VOL END AS v FROM ps)", ["ps"])
def _(spark, d):
    return C.fill_after_first(panel_supplier(spark, d).withColumn("v", F.when(c("VOL") > 40, c("VOL"))), "v")


_P7 = "SELECT DTID, date, CASE WHEN date < DATE '2001-06-01' OR CAST(DTID AS BIGINT) % 2 = 0 THEN PRC END AS p FROM pn"


@query("p07_trailing_padding", K, ["p"], f"SELECT DTID, date, p FROM (SELECT *, sum(pad) OVER (PARTITION BY DTID) AS n FROM (SELECT *, min(CASE WHEN p IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY DTID ORDER BY date DESC) AS pad FROM ({_P7}))) WHERE NOT (pad = 1 AND n > 20)", ["pn"])
def _(spark, d):
    return C.drop_trailing_padding(panel_nation(spark, d).withColumn("p", F.when((c("date") < "2001-06-01") | (c("DTID").cast("long") % 2 == 0), c("PRC"))), "p")


_P8 = "p8 AS (SELECT DTID, date, RI, PRC, CASE WHEN VOL <= 30 THEN 0 ELSE VOL END AS VOL, 1 + floor(RI / 1000) AS AF FROM ps)"


def _pass8(src):
    return (f"(SELECT DTID, date, VOL, m, CASE WHEN m THEN lag(RI) OVER (PARTITION BY DTID ORDER BY date) ELSE RI END AS RI, PRC FROM (SELECT * REPLACE (m OR coalesce(VOL = 0 AND lag(m) OVER (PARTITION BY DTID ORDER BY date), false) AS m) FROM {src}))")


_M8 = """(SELECT DTID, date, VOL, RI, PRC, coalesce(((RI / lag(RI) OVER w > 1.5 AND lead(AF) OVER w / lag(AF) OVER w > 1.5) OR (RI / lag(RI) OVER w < 0.5 AND lead(AF) OVER w / lag(AF) OVER w < 0.5)) AND VOL = 0
 AND (coalesce(lead(VOL) OVER w <> 0, true) OR coalesce(lead(VOL, 2) OVER w <> 0, true) OR coalesce(lead(VOL, 3) OVER w <> 0, true) OR coalesce(lead(VOL, 4) OVER w <> 0, true) OR coalesce(lead(VOL, 5) OVER w <> 0, true)), false) AS m FROM p8 WINDOW w AS (PARTITION BY DTID ORDER BY date))"""
for _ in range(5):
    _M8 = _pass8(_M8)


@query("p08_padded_split_repair", K, ["RI", "p"], f"SELECT DTID, date, RI, CASE WHEN NOT m THEN PRC END AS p FROM {_M8}", ["ps", _P8])
def _(spark, d):
    p = panel_supplier(spark, d).select("DTID", "date", "RI", "PRC", F.when(c("VOL") <= 30, 0.0).otherwise(c("VOL")).alias("VOL"), (1 + F.floor(c("RI") / 1000)).cast("double").alias("AF"))
    return C.repair_padded_splits(p).withColumn("p", c("PRC"))


@query("p09_reversal_repair", K, ["RI"], """SELECT DTID, date, CASE WHEN x / l < 0.5 AND f / l > 0.9 THEN (f + l) / 2 ELSE x END AS RI FROM (SELECT *, CASE WHEN RI / l > 2 AND f / l < 1.1 THEN (f + l) / 2 ELSE RI END AS x FROM (
 SELECT DTID, date, RI, lag(RI) OVER w AS l, lead(RI) OVER w AS f FROM pn WINDOW w AS (PARTITION BY DTID ORDER BY date)))""", ["pn"])
def _(spark, d):
    return C.repair_reversals(panel_nation(spark, d))


@query("p10_return_outliers", K, ["RI", "r"], "SELECT DTID, date, CASE WHEN RI / l > 6 THEN NULL ELSE RI END AS RI, CASE WHEN RI / l > 6 THEN NULL ELSE RI / l - 1 END AS r FROM (SELECT DTID, date, RI, lag(RI) OVER (PARTITION BY DTID ORDER BY date) AS l FROM ps)", ["ps"])
def _(spark, d):
    return C.null_outlier_returns(panel_supplier(spark, d))


@query("p11_text_screening", ["p_partkey"], [], """SELECT p_partkey FROM part WHERE NOT ((contains(upper(p_name), 'RING') OR contains(upper(p_name), 'BOLT') OR (contains(upper(p_name), 'SMALL') AND p_type IN ('ECONOMY', 'PROMO'))) AND p_partkey % 10 <> 3)""")
def _(spark, d):
    rules = spark.createDataFrame([("RING", None), ("BOLT", None), ("SMALL", ["ECONOMY", "PROMO"])], "token string, exchanges array<string>")
    p = table(spark, d, "part")
    return C.screen_text(p, rules, "p_name", "p_type", p.filter("p_partkey % 10 = 3"), "p_partkey")


RULE = "rule int, token string, absent array<string>, inside map<string,array<string>>, outside map<string,array<string>>"
#: One rule of each kind: token; with exchanges; with a second column; with its negation; a token without another; short tokens.
SCREEN = [(1, "RING", None, None, None), (2, "BOLT", None, {"EXDSCD": ["SMALL", "PROMO"]}, None), (3, "SMALL", None, {"EXDSCD": ["ECONOMY"]}, {"MAJOR": ["Y"]}), (4, "HOT", None, None, {"ESTAT": ["ACT."]}),
          (5, "GEAR", ["RED ", "BLUE"], None, None), (6, "Z", None, {"ESTAT": ["DEAD"], "EXDSCD": ["MEDIUM", "STANDARD"]}, None), (7, "GI", None, {"EXDSCD": ["LARGE"]}, {"ESTAT": ["ACT."], "MAJOR": ["N"]}), (8, "ABSENT", None, None, None)]


@query("p11_universe_screening", ["p_partkey", "EXDSCD", "region"], [], """WITH x AS (SELECT p_partkey, p_type AS EXDSCD, CASE WHEN p_type IN ('SMALL', 'MEDIUM', 'LARGE') THEN 'A' ELSE 'B' END AS region, upper(p_name) AS t, CASE p_size % 3 WHEN 0 THEN 'Y' WHEN 1 THEN 'N' END AS m,
 CASE WHEN p_size % 4 = 0 THEN 'DEAD' ELSE 'ACT.' END AS e FROM part WHERE p_brand <> 'Brand#3' AND p_type <> 'PROMO')
 SELECT p_partkey, EXDSCD, region FROM x WHERE p_partkey % 23 <> 5 AND (p_partkey % 10 = 3 OR NOT (contains(t, 'RING') OR contains(t, 'BOLT') AND EXDSCD IN ('SMALL', 'PROMO') OR contains(t, 'SMALL') AND EXDSCD = 'ECONOMY' AND m IS DISTINCT FROM 'Y'
 OR contains(t, 'HOT') AND e <> 'ACT.' OR contains(t, 'GEAR') AND NOT contains(t, 'RED ') AND NOT contains(t, 'BLUE') OR contains(t, 'Z') AND e = 'DEAD' AND EXDSCD IN ('MEDIUM', 'STANDARD') OR contains(t, 'GI') AND EXDSCD = 'LARGE' AND e <> 'ACT.' AND m IS DISTINCT FROM 'N'))""")
def _(spark, d):
    p = table(spark, d, "part")
    p = p.withColumn("EXDSCD", c("p_type")).withColumn("MAJOR", F.when(c("p_size") % 3 == 0, "Y").when(c("p_size") % 3 == 1, "N")).withColumn("ESTAT", F.when(c("p_size") % 4 == 0, "DEAD").otherwise("ACT."))
    kinds = p.select("EXDSCD").distinct().where("EXDSCD <> 'PROMO'").withColumn("region", F.when(c("EXDSCD").isin("SMALL", "MEDIUM", "LARGE"), "A").otherwise("B"))
    brands = [f"Brand#{k}" for k in range(1, 100) if k != 3]
    p = C.listed(p, {"p_brand": brands}, kinds)
    return C.screen_rules(p, spark.createDataFrame(SCREEN, RULE), ["EXDSCD", "MAJOR", "ESTAT"], "p_name", "p_partkey", allow=p.where("p_partkey % 10 = 3"), deny=p.where("p_partkey % 23 = 5"))


@query("p12_ticker_normalisation", ["o_orderkey", "t"], [], "SELECT o_orderkey, CAST(o_custkey % 100 AS VARCHAR) || '@' AS t FROM orders")
def _(spark, d):
    raw = F.concat(F.when(c("o_orderkey") % 3 == 0, "@:").when(c("o_orderkey") % 3 == 1, "@").otherwise(""), (c("o_custkey") % 100).cast("string"), F.lit("@"))
    return table(spark, d, "orders").select("o_orderkey", C.normalise_ticker(raw).alias("t"))


@query("p13_share_factor", K, ["AF"], """SELECT DTID, date, a / last_value(a) OVER (PARTITION BY DTID ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS AF FROM (
 SELECT DTID, date, product(1 / (1 + coalesce(f, 0))) OVER (PARTITION BY DTID ORDER BY date) AS a FROM (SELECT DTID, date, lag(CASE WHEN PRC > 4000 THEN 0.0002 WHEN PRC < 1000 THEN -0.0002 END) OVER (PARTITION BY DTID ORDER BY date) AS f FROM pn))""", ["pn"])
def _(spark, d):
    p = panel_nation(spark, d).withColumn("DISFACSHR", F.when(c("PRC") > 4000, 0.0002).when(c("PRC") < 1000, -0.0002))
    return C.share_factor(p)


@query("p14_firm_market_value", K, {"MC": 3}, "SELECT DTID, date, CASE WHEN m <= 0 THEN NULL ELSE m END AS MC FROM (SELECT DTID, date, CASE WHEN f IS NULL THEN MC ELSE sum(MC) OVER (PARTITION BY f, date) END AS m FROM (SELECT *, CASE WHEN FTID <> '3' THEN FTID END AS f FROM ps))", ["ps"])
def _(spark, d):
    p = panel_supplier(spark, d).withColumn("FTID", F.when(c("FTID") != "3", c("FTID"))).withColumn("MCshare", c("MC")).drop("MC")
    return C.firm_market_value(p)


# ------------------------------------------------------------------ sort, set and reshape
@query("o01_multi_key_sort", [*K, "k"], [], "SELECT DTID, date, row_number() OVER (ORDER BY date, DTID) AS k FROM (SELECT DISTINCT date_trunc('month', date)::DATE AS date, DTID FROM pn)", ["pn"])
def _(spark, d):
    # positions of a global sort: ranges of the sort key, offsets per range
    p = panel_nation(spark, d).select("DTID", month_start(month_no("date")).alias("date")).distinct()
    return X.running_total(p, F.lit(1), [], ["date", "DTID"], "k").orderBy("date", "DTID")


@query("o03_one_record_per_fiscal_year", ["T", "FTID", "FinYearEnd"], [], "SELECT T, FTID, FinYearEnd FROM (SELECT T, FTID, FinYearEnd, row_number() OVER (PARTITION BY T, FTID, ceil(datediff('day', FinYearEnd, T) / 365.0) ORDER BY date DESC) AS k FROM ft JOIN g ON date >= T - INTERVAL 60 MONTH AND date < T) WHERE k = 1",
       ["ft", grid_cte("1996-07-01", "2002-12-01")])
def _(spark, d):
    from panelquant.signals.base import fiscal_snapshot

    return fiscal_snapshot(statements(spark, d, ["sale"], with_mc=False), None, Grid("1996-07-01", "2002-12-01"), -60, 0)


@query("o05_top_bottom_fraction", ["date", "DTID"], ["side"], "SELECT date, DTID, CASE WHEN v >= h THEN 1 ELSE -1 END AS side FROM (SELECT *, quantile_cont(v, 0.9) OVER w AS h, quantile_cont(v, 0.1) OVER w AS l FROM pm WINDOW w AS (PARTITION BY date, region)) WHERE v >= h OR v <= l", ["ps", PM])
def _(spark, d):
    q = X.with_quantiles(monthly(spark, d), ["date", "region"], {"h": ("v", 0.9), "l": ("v", 0.1)})
    return q.filter("v >= h or v <= l").withColumn("side", F.when(c("v") >= c("h"), 1).otherwise(-1))


@query("u01_union_by_name", ["k", "date", "region"], ["PRC"], "SELECT DTID AS k, date, region, PRC FROM pn UNION ALL SELECT DTID, date, NULL, RI FROM ev", ["pn", "ev"])
def _(spark, d):
    a = panel_nation(spark, d).select(c("DTID").alias("k"), "date", "region", "PRC")
    return a.unionByName(events_panel(spark, d).select("date", c("RI").alias("PRC"), c("DTID").alias("k")), allowMissingColumns=True)


@query("u02_union_distinct_keys", K, [], "SELECT DTID, date FROM pn WHERE PRC > 1500 UNION SELECT DTID, date FROM pn WHERE VOL > 50", ["pn"])
def _(spark, d):
    p = panel_nation(spark, d)
    return p.filter("PRC > 1500").select(*K).unionByName(p.filter("VOL > 50").select(*K)).dropDuplicates(K)


@query("u03_unpivot", ["date", "DTID", "var"], ["x"], "SELECT date, DTID, unnest(['v', 'p', 'MC']) AS var, unnest([v, p, MC]) AS x FROM pm", ["ps", PM], digits=3)
def _(spark, d):
    return monthly(spark, d).unpivot(["date", "DTID"], ["v", "p", "MC"], "var", "x")


@query("u04_pivot", ["date"], ["AFRICA", "ASIA", "EUROPE"], "SELECT date, sum(v) FILTER (WHERE region = 'AFRICA') AS \"AFRICA\", sum(v) FILTER (WHERE region = 'ASIA') AS \"ASIA\", sum(v) FILTER (WHERE region = 'EUROPE') AS \"EUROPE\" FROM pm GROUP BY 1", ["ps", PM])
def _(spark, d):
    return monthly(spark, d).groupBy("date").pivot("region", ["AFRICA", "ASIA", "EUROPE"]).agg(F.sum("v"))


@query("u05_replace_by_fallback", ["date", "DTID"], ["x"], "SELECT date, DTID, CASE WHEN v < 60 THEN p ELSE v END AS x FROM pm", ["ps", PM])
def _(spark, d):
    m = monthly(spark, d)
    bad = m.filter("v < 60").select("date", "DTID")
    ok = m.select("date", "DTID", c("v").alias("x")).join(bad, ["date", "DTID"], "left_anti")
    return ok.unionByName(m.select("date", "DTID", c("p").alias("x")).join(bad, ["date", "DTID"], "left_semi"))


@query("x05_array_operations", ["date", "DTID"], ["first", "last", "area", "n"], """SELECT date, DTID, greatest(q[1], -1) AS first, q[7] AS last, (SELECT sum((a + b) / 2) FROM (SELECT unnest(q[2:5]) AS a, unnest(q[3:6]) AS b)) AS area, 5 AS n FROM qv""", ["qv"])
def _(spark, d):
    q = quantile_vectors(spark, d)
    mid = F.slice("q", 2, 5)
    area = F.aggregate(F.zip_with(F.slice(mid, 1, 4), F.slice(mid, 2, 4), lambda a, b: (a + b) / 2), F.lit(0.0), lambda s, v: s + v)
    pts = F.transform(repair(F.col("q"), TAUS), lambda p: F.greatest(p["x"], F.lit(-1.0)))
    return q.select("date", "DTID", pts[0].alias("first"), F.element_at("q", -1).alias("last"), area.alias("area"), F.size(mid).alias("n"))


@query("e03_manifest_scan", ["T", "DTID"], ["n"], "SELECT T, DTID, count(*) AS n FROM pn JOIN g ON date >= T - INTERVAL 61 MONTH AND date < T GROUP BY 1, 2", ["pn", grid_cte("1995-02-01", "2001-12-01")])
def _(spark, d):
    from panelquant.signals import input_manifest

    m = input_manifest(["Mom", "CEI5Y", "TV3M"])["dt"]
    s = snapshot(panel_nation(spark, d), Grid("1995-02-01", "2001-12-01"), m["start"], m["end"], m["items"])
    return s.groupBy("T", "DTID").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ raw-file pipelines on driver tables
_CPI = "(SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, avg(o_totalprice) / 77.8 AS CPI FROM orders GROUP BY 1)"


def _cpi(spark, d):
    o = table(spark, d, "orders").groupBy(month_start(month_no("o_orderdate")).alias("m")).agg(F.avg("o_totalprice").alias("CPIAUCNS"))
    return PL.inflation(o.select(F.date_format("m", "dd/MM/yyyy").alias("DATE"), "CPIAUCNS"))


@query("a12_price_index_pipeline", ["date"], ["CPI"], f"SELECT * FROM {_CPI}", digits=5)
def _(spark, d):
    return _cpi(spark, d)


_RAW = """raw AS (SELECT FTID AS permco, CAST(DTID AS BIGINT) AS permno, date, -PRC AS dlyprc, SHROUT, greatest(least(r, 0.2), -0.2) AS dlyret, VOL, CASE WHEN day(date) = 15 THEN 0.1 END AS fac FROM ps)"""


def _crsp(spark, d):
    p = panel_supplier(spark, d)
    return p.select(c("FTID").alias("permco"), c("DTID").cast("long").alias("permno"), F.date_format("date", "yyyyMMdd").cast("int").alias("yyyymmdd"), (-c("PRC")).alias("dlyprc"), c("SHROUT").alias("shrout"),
                    F.greatest(F.least("r", F.lit(0.2)), F.lit(-0.2)).alias("dlyret"), c("VOL").alias("dlyvol"), F.when(F.dayofmonth("date") == 15, 0.1).alias("disfacshr"),
                    c("L").alias("dlybid"), c("H").alias("dlyask"), c("L").alias("dlylow"), c("H").alias("dlyhigh"))


@query("a12_daily_panel_pipeline", K, {"PRC": 6, "MC": 2, "AF": 6, "RI": 6}, """SELECT DTID, date, PRC, MC, AF, product(1 + coalesce(r, 0)) OVER (PARTITION BY DTID ORDER BY date) AS RI FROM (SELECT CAST(permno AS VARCHAR) AS DTID, date, -dlyprc AS PRC, dlyret AS r,
  sum(-dlyprc * SHROUT / 1000) OVER (PARTITION BY permco, date) AS MC, a / last_value(a) OVER (PARTITION BY permno ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS AF FROM (
  SELECT *, product(1 / (1 + coalesce(lf, 0))) OVER (PARTITION BY permno ORDER BY date) AS a FROM (SELECT *, lag(fac) OVER (PARTITION BY permno ORDER BY date) AS lf FROM raw)))
 WHERE CAST(DTID AS BIGINT) % 4 <> 0 AND date >= DATE '1997-01-01' AND date <= DATE '2000-12-31'""", ["ps", _RAW])
def _(spark, d):
    su = table(spark, d, "supplier")
    day = lambda s: F.lit(s).cast("date")
    issue = su.select(c("s_suppkey").alias("permno"), day("1997-01-01").alias("secinfostartdt"), day("2000-12-31").alias("secinfoenddt"), F.when(c("s_suppkey") % 4 == 0, "X").otherwise("N").alias("primaryexch"),
                      *[F.lit(v).alias(k) for k, v in {**PL.TRADING, **PL.SHARE}.items()])
    issuer = su.select(c("s_nationkey").cast("string").alias("permco"), day("1990-01-01").alias("issinfostartdt"), day("2010-12-31").alias("issinfoenddt"), F.lit("Y").alias("usincflg"), F.lit("CORP").alias("issuertype")).distinct()
    return PL.daily_panel(_crsp(spark, d), issue, issuer)


@query("a12_monthly_panel_pipeline", K, {"PRC": 6, "MC": 2}, """SELECT DTID, m AS date, PRC, sum(PRC * SHROUT / 1000) OVER (PARTITION BY FTID, m) AS MC FROM (SELECT DTID, FTID, last_day(date) AS m, arg_max(PRC, date) AS PRC, any_value(SHROUT) AS SHROUT FROM ps WHERE CAST(DTID AS BIGINT) % 4 <> 0 GROUP BY 1, 2, 3)""", ["ps"])
def _(spark, d):
    p = panel_supplier(spark, d).groupBy("DTID", "FTID", F.last_day("date").alias("mthcaldt")).agg(F.max_by("PRC", "date").alias("mthprc"), F.first("SHROUT").alias("shrout"))
    raw = p.select(c("FTID").alias("permco"), c("DTID").alias("permno"), "mthcaldt", "mthprc", F.lit(0.0).alias("mthret"), "shrout", F.lit("x").alias("issuernm"), F.when(c("DTID").cast("long") % 4 == 0, "X").otherwise("Q").alias("primaryexch"),
                   *[F.lit(v).alias(k) for k, v in {**PL.TRADING, **PL.SHARE}.items()], F.lit("Y").alias("usincflg"), F.lit("ACOR").alias("issuertype"))
    return PL.monthly_panel(raw)


@query("a12_international_panel_pipeline", K, {"PRC": 5, "RI": 5, "r": 5, "VOL": 4, "MC": 4})
def _(spark, d):
    p = panel_supplier(spark, d)
    px = p.select("DTID", "date", "PRC", "RI", c("RI").alias("RI_OC"), "H", "L", c("L").alias("BID"), c("H").alias("ASK"), "VOL", "SHROUT", "AF", c("PRC").alias("PRCunpadded"))
    su = table(spark, d, "supplier").join(table(spark, d, "nation"), c("s_nationkey") == c("n_nationkey")).join(table(spark, d, "region"), c("n_regionkey") == c("r_regionkey"))
    return PL.international_panel(px, su.select(c("s_suppkey").cast("string").alias("DTID"), c("s_nationkey").cast("string").alias("FTID"), c("r_name").alias("region")))


@query("a12_us_statement_pipeline", ["FTID", "DTID", "date", "FinYearEnd", "FirstObs", "INDM3"], {"sale": 2, "CPI": 5}, f"""SELECT FTID, CASE WHEN FinYearEnd <= DATE '1998-12-31' THEN FTID ELSE CAST(CAST(FTID AS BIGINT) + 1000 AS VARCHAR) END AS DTID, date, FinYearEnd, min(date) OVER (PARTITION BY FTID) AS "FirstObs",
  'I' || CAST(FTID AS BIGINT) % 7 AS INDM3, sale, p.CPI AS CPI FROM ft f ASOF LEFT JOIN (SELECT date AS cd, CPI FROM {_CPI}) p ON f.date >= p.cd""", ["ft"])
def _(spark, d):
    f = statements(spark, d, ["sale"], with_mc=False).select(c("FTID").cast("long").alias("gvkey"), c("FinYearEnd").alias("datadate"), "sale", F.lit("STD").alias("datafmt"), F.lit("INDL").alias("indfmt"), F.lit("C").alias("consol"))
    raw = f.unionByName(f.withColumn("datafmt", F.lit("SUMM")))
    su = table(spark, d, "supplier").select(c("s_suppkey").alias("gvkey"))
    day = lambda s: F.lit(s).cast("date")
    link = su.select("gvkey", day("1990-01-01").alias("linkdt"), day("1998-12-31").alias("linkenddt"), c("gvkey").alias("lpermno"), c("gvkey").alias("lpermco")).unionByName(
        su.select("gvkey", day("1995-06-01").alias("linkdt"), F.lit(None).cast("date").alias("linkenddt"), (c("gvkey") + 1000).alias("lpermno"), c("gvkey").alias("lpermco")))
    hist = su.filter("gvkey % 2 = 0").select("gvkey", day("1990-01-01").alias("hchgdt"), (c("gvkey") % 7).cast("int").alias("hsic"))
    head = su.select("gvkey", (c("gvkey") % 7).cast("int").alias("sic"))
    ind = table(spark, d, "nation").filter("n_nationkey < 7").select(c("n_nationkey").cast("int").alias("sic"), F.lit("x").alias("INDM"), F.concat(F.lit("I"), c("n_nationkey").cast("string")).alias("INDM3"))
    return PL.us_statements(raw, link, hist, head, ind, _cpi(spark, d), ["sale"])


@query("a12_international_statement_pipeline", ["FTID", "date"], {"sale": 4, "gm": 4}, "SELECT FTID, date, sale / 1000 AS sale, (sale - cogs) / 1000 AS gm FROM ft", ["ft"])
def _(spark, d):
    raw = statements(spark, d, ["sale", "cogs"], with_mc=False).select(c("DTID").alias("dscd"), c("FinYearEnd").alias("Item WC05350"), c("sale").alias("X(WC01001)"), c("cogs").alias("X(WC01051)"))
    st = table(spark, d, "supplier").select(c("s_suppkey").cast("string").alias("DTID"), c("s_suppkey").cast("string").alias("FTID"))
    return PL.international_statements(raw, {"WC05350": "FinYearEnd", "WC01001": "sale", "WC01051": "cogs"}, st, {"gm": "sale - cogs"})


_FX = "fx AS (SELECT CAST(o_custkey % 5 AS VARCHAR) AS cur, CAST(o_orderdate AS DATE) AS fd, avg(o_totalprice) / 1e5 AS rate FROM orders GROUP BY 1, 2)"


def _rates(spark, d):
    return table(spark, d, "orders").groupBy((c("o_custkey") % 5).cast("string").alias("curr"), F.to_date("o_orderdate").alias("anndats")).agg((F.avg("o_totalprice") / 1e5).alias("exrat"))


@query("a13_currency_conversion", ["DTID", "date", "cur"], ["PRC"], "SELECT DTID, p.date, p.cur, PRC / rate AS PRC FROM (SELECT *, CAST(CAST(DTID AS BIGINT) % 5 AS VARCHAR) AS cur FROM pn) p ASOF LEFT JOIN fx ON p.cur = fx.cur AND p.date >= fx.fd", ["pn", _FX], digits=4)
def _(spark, d):
    p = panel_nation(spark, d).withColumn("cur", (c("DTID").cast("long") % 5).cast("string"))
    r = _rates(spark, d).select(c("curr").alias("cur"), c("anndats").alias("date"), "exrat")
    return PL.convert_currency(p, r, ["PRC"], by="cur")


_AS = """SELECT a.TICKER, a.date, a.FPI, CASE WHEN l."end" IS NULL OR a.date <= l."end" THEN CAST(CAST(a.TICKER AS BIGINT) * 10000 + CAST(split_part(l.PERMNO, '-', 2) AS BIGINT) AS VARCHAR) END AS PERMNO"""


def _analyst_links(spark, d):
    l = link_intervals(spark, d)
    link = l.select(c("TICKER").alias("ticker"), (c("TICKER").cast("long") * 10000 + F.split_part("PERMNO", F.lit("-"), F.lit(2)).cast("long")).alias("permno"), c("start").alias("sdate"), c("end").alias("edate"))
    static = l.select(c("TICKER")).distinct().filter("cast(TICKER as long) % 2 = 0").select(F.concat(F.lit("D"), "TICKER").alias("DSCD"), F.concat(F.lit("@:"), "TICKER").alias("IBTKR"), F.lit("Europe").alias("region"))
    return link, static


@query("a12_analyst_summary_pipeline", ["TICKER", "date", "FPI", "PERMNO", "DTID"], ["MEANEST"], f"""{_AS}, CASE WHEN CAST(a.TICKER AS BIGINT) % 2 = 0 THEN 'D' || a.TICKER END AS DTID, MEANEST / rate AS MEANEST FROM (SELECT *, CAST(CAST(TICKER AS BIGINT) % 5 AS VARCHAR) AS cur FROM asum) a
 ASOF LEFT JOIN fx ON a.cur = fx.cur AND a.date >= fx.fd ASOF LEFT JOIN link l ON a.TICKER = l.TICKER AND a.date >= l.start""", ["asum", "link", _FX], digits=5)
def _(spark, d):
    a = analyst_sum(spark, d).select(c("TICKER").alias("ticker"), c("date").alias("statpers"), c("FPI").cast("string").alias("fpi"), F.lit("ANN").alias("fiscalp"), (c("TICKER").cast("long") % 5).cast("string").alias("curcode"),
                                     c("MEANEST").alias("meanest"), c("MEDEST").alias("medest"), c("STDEV").alias("stdev"))
    even = c("ticker").cast("long") % 2 == 0
    return PL.analyst_summary([a.filter(even), a.filter(~even)], _rates(spark, d), *_analyst_links(spark, d))


@query("a12_analyst_detail_pipeline", ["TICKER", "ESTIMID", "date", "PERMNO", "DTID"], ["seq"], f"""{_AS.replace(', a.FPI', ', a.ESTIMID')}, CASE WHEN CAST(a.TICKER AS BIGINT) % 2 = 0 THEN 'D' || a.TICKER END AS DTID, seq FROM adet a ASOF LEFT JOIN link l ON a.TICKER = l.TICKER AND a.date >= l.start""", ["adet", "link"])
def _(spark, d):
    from panelquant.sources.adapters import analyst_det

    raw = analyst_det(spark, d).select(c("TICKER").alias("ticker"), c("ESTIMID").alias("estimid"), c("ITEXT").alias("itext"), c("date").alias("actdats"), c("seq"))
    out = PL.analyst_detail(raw, *_analyst_links(spark, d))
    return out.withColumn("seq", c("SEQ"))


@query("a14_holiday_filter", ["DTID", "date", "GEOGN"], ["PRC"], """SELECT DTID, date, region AS GEOGN, PRC FROM pn WHERE NOT (region = 'ASIA' AND day(date) = 7 AND date >= DATE '1997-01-01') AND NOT (region = 'EUROPE' AND day(date) IN (1, 25))""", ["pn"])
def _(spark, d):
    p = panel_nation(spark, d).withColumnRenamed("region", "GEOGN")
    days = p.select("date").distinct()
    day = F.dayofmonth("date")
    hol = days.select("date", F.when(c("date") >= "1997-01-01", F.when(day == 7, 1.0).otherwise(0.0)).alias("HA"), F.when(day.isin(1, 25), 1.0).otherwise(0.0).alias("HE"))
    return C.drop_holidays(p, hol, {"HA": "ASIA", "HE": "EUROPE"})
