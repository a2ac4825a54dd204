"""Registry of signal classes and their joint evaluation over a date grid.

A class is either a window record (row expressions, window aggregates, final expressions) or
a function of the context.  Window records of all requested classes are merged into one
aggregation over one scan; statement projections share one statement snapshot.
"""
from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from panelquant.functions.num import clean, flag
from panelquant.functions.stage import stage
from panelquant.operators.asof import Agg, Grid, base_index, last_of, snapshot, win_agg
from panelquant.operators.xsection import group_quantiles


@dataclass
class WindowSpec:
    pre: dict[str, Column]
    aggs: dict[str, Agg]
    final: dict[str, Column]


@dataclass
class SignalClass:
    name: str
    outputs: list[str]
    inputs: dict[str, tuple[int, int, list[str]]] = field(default_factory=dict)
    depends: list[str] = field(default_factory=list)
    key: str = "DTID"
    min_obs: dict[str, int] = field(default_factory=dict)
    window: Callable | None = None       # (gate) -> WindowSpec
    project: Callable | None = None      # (statement columns with lags) -> {output: Column}
    build: Callable | None = None        # (context) -> DataFrame keyed (T, key)


CLASSES: dict[str, SignalClass] = {}


def register(cls: SignalClass) -> SignalClass:
    if cls.name in CLASSES:
        raise ValueError(f"duplicate signal class {cls.name}")
    CLASSES[cls.name] = cls
    return cls


def resolve(names=None) -> tuple[dict[str, list[str]], list[str]]:
    """Requested outputs per class, and every class needed including dependencies."""
    if names is None:
        want = {c.name: list(c.outputs) for c in CLASSES.values()}
    else:
        names = set(names)
        want = {c.name: [o for o in c.outputs if o in names] for c in CLASSES.values()}
        want = {k: v for k, v in want.items() if v}
        missing = names - {o for v in want.values() for o in v}
        if missing:
            raise ValueError(f"unknown signals: {sorted(missing)}")
    need, todo = [], list(want)
    while todo:
        c = todo.pop(0)
        if c not in need:
            need.append(c)
            todo += CLASSES[c].depends
    return want, need


def input_manifest(names=None) -> dict[str, dict]:
    """Union of columns, earliest start and latest end per source over all needed classes."""
    man: dict[str, dict] = {}
    for c in resolve(names)[1]:
        for src, (s, e, items) in CLASSES[c].inputs.items():
            m = man.setdefault(src, {"start": s, "end": e, "items": []})
            m["start"], m["end"] = min(m["start"], s), max(m["end"], e)
            m["items"] = sorted(set(m["items"]) | set(items))
    if "MC" in man.get("FT", {}).get("items", []):
        m = man.setdefault("dt", {"start": -1, "end": 0, "items": []})
        m["items"] = sorted(set(m["items"]) | {"MC"})
    return man


@dataclass
class SignalContext:
    sources: dict[str, DataFrame]
    grid: Grid
    min_obs: dict[str, int] = field(default_factory=dict)
    mc_start: int = -241
    _cache: dict = field(default_factory=dict)

    def gate(self, cls: str, name: str = "n") -> int:
        return self.min_obs.get(cls, CLASSES[cls].min_obs.get(name, 0)) if name == "n" else self.min_obs.get(f"{cls}.{name}", CLASSES[cls].min_obs[name])

    @property
    def dt(self) -> DataFrame:
        return self.sources["dt"]

    def cls(self, name: str) -> DataFrame:
        """Result of one class, (T, key, outputs); built once per context."""
        if name not in self._cache:
            c = CLASSES[name]
            if c.window:
                self._cache[name] = window_signals(self, [name])
            elif c.project:
                self._cache[name] = statement_signals(self, [name])
            else:
                self.together(c.depends)
                self._cache[name] = c.build(self)
        return self._cache[name]

    def together(self, names) -> None:
        """Builds several statement classes from one pass over the snapshot, written once for those who read them."""
        names = [n for n in names if CLASSES[n].project and n not in self._cache]
        if len(names) > 1:
            w = stage(statement_signals(self, names, presence=True))
            for n in names:
                self._cache[n] = w.filter(F.col(f"has__{n}") > 0).select("T", CLASSES[n].key, *CLASSES[n].outputs)

    def statements(self) -> DataFrame:
        """Statement snapshot over the widest window any class asks for, one row per fiscal year."""
        if "_ft" not in self._cache:
            self._cache["_ft"] = fiscal_snapshot(self.sources["FT"], self.sources.get("dt"), self.grid, -258, 0, mc_start=self.mc_start)
        return self._cache["_ft"]


# ------------------------------------------------------------------ market windows
def window_signals(ctx: SignalContext, names, presence: bool = False) -> DataFrame:
    """(T, DTID, outputs) for ids with at least one row in a class window; one aggregation for all.

    `presence` adds a `has__<class>` column, so dependents see exactly the ids of that class.
    """
    pre, aggs, final = {"one": F.lit(1)}, {}, []
    for n in names:
        s = CLASSES[n].window(lambda k="n", n=n: ctx.gate(n, k))
        tag = lambda c, n=n: f"{n}__{c}"
        own = {k: tag(k) for k in s.pre}
        pre.update({tag(k): v for k, v in s.pre.items()})
        aggs.update({tag(k): Agg(a.kind, own.get(a.col, a.col), a.start, a.end, a.lag) for k, a in s.aggs.items()})
        start, end, _ = CLASSES[n].inputs["dt"]
        aggs[f"has__{n}"] = Agg("n", "one", start, end)
        final.append((n, {k: F.col(tag(k)) for k in s.aggs}, s.final))
    used = {a.col for a in aggs.values()}
    base = [c for c in ctx.dt.columns if c in used or c in ("DTID", "date")]
    w = win_agg(ctx.dt.select(*base, *[e.alias(k) for k, e in pre.items() if k in used]), ctx.grid, aggs)
    has = [f"has__{n}" for n in names]
    w = w.filter(F.greatest(F.lit(0), *[F.col(h) for h in has]) > 0)
    outs = [clean(fn(cols)).alias(o) for _, cols, fs in final for o, fn in fs.items()]
    return w.select("T", "DTID", *outs, *([F.col(h) for h in has] if presence else []))


# ------------------------------------------------------------------ statements
def fiscal_snapshot(ft: DataFrame, dt: DataFrame | None, grid: Grid, start: int, end: int, mc_start: int = -1) -> DataFrame:
    """Statements inside the window at T, one per fiscal year, newest market value overlaid.

    `age` is the fiscal-year bucket as seen at T; the later row of a bucket wins.  Rows newer
    than T-12 months take the last market value of their security when there is one.  Market values
    meet the statements before these are copied to the dates, as one map per security from date to
    value, so no copy is moved; where nobody reads MC the optimiser drops the join.
    """
    mc = dt is not None and "MC" in ft.columns
    if mc:
        v = win_agg(dt.select("DTID", "date", "MC"), grid, {"MClast": Agg("last", "MC", mc_start, 0)}).filter("MClast is not null")
        ft = ft.join(v.groupBy("DTID").agg(F.map_from_entries(F.collect_list(F.struct("T", "MClast"))).alias("_mcs")), "DTID", "left")
        ft = ft.withColumn("_mcs", F.map_filter("_mcs", lambda t, _: (t > F.col("date")) & (F.add_months(t, -12) < F.col("date"))))
    s = snapshot(ft, grid, start, end, None, "FTID", "date").withColumn("age", F.ceil(F.datediff("T", "FinYearEnd") / 365))
    if mc:
        recent = F.col("date") > F.add_months("T", -12)
        s = s.withColumn("MC", F.coalesce(F.when(recent, F.try_element_at("_mcs", F.col("T"))), F.col("MC"))).drop("_mcs")
    w = W.partitionBy("FTID", "T", "age").orderBy(F.col("date").desc(), F.col("FinYearEnd").desc())
    return s.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")  # rows still lie by FTID


def fw():
    return W.partitionBy("FTID", "T").orderBy("date")


class Lags:
    """Distinct lags of several formulas as named columns, by depth: a lag of an expression with lags comes after those."""

    def __init__(self):
        self.known: dict[tuple, str] = {}
        self.depth: dict[str, int] = {}
        self.steps: list[dict[str, Column]] = []

    def named(self, x: Column, n: int) -> Column:
        text = str(x)
        if (text, n) not in self.known:
            name = f"_lag{len(self.known)}"
            self.known[text, n] = name
            self.depth[name] = d = max((self.depth[i] + 1 for i in re.findall(r"\b_lag\d+\b", text)), default=0)
            self.steps += [{} for _ in range(d + 1 - len(self.steps))]
            self.steps[d][name] = F.lag(x, n).over(fw())
        return F.col(self.known[text, n])

    def add(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            df = df.withColumns(step)
        return df


class Items:
    """Column access for statement formulas: f.at, f.L('at', 2) and lags of any expression.

    A formula sees only its own window [T+start, T).  Rows outside the window cannot be removed
    from the shared snapshot, so the lag of a row is blanked when the lagged row lies outside.
    With `lags` every distinct lag is named there once and formulas refer to its name: Spark
    evaluates a window expression anew at each place where it stands.
    """

    def __init__(self, start: int, lags: Lags | None = None):
        self.inside, self.lags = F.col("date") >= F.add_months("T", start), lags

    def __getattr__(self, name: str) -> Column:
        return F.col(name)

    def L(self, x, n: int = 1) -> Column:
        c = F.col(x) if isinstance(x, str) else x
        lag = self.lags.named if self.lags is not None else (lambda e, n: F.lag(e, n).over(fw()))
        return F.when(lag(self.inside, n), lag(c, n))

    def D(self, x) -> Column:
        c = F.col(x) if isinstance(x, str) else x
        return c - self.L(c)


def statement_signals(ctx: SignalContext, names, presence: bool = False) -> DataFrame:
    """Row formulas over the shared snapshot, then the last non-null value per firm.

    All lags share one window specification, so one exchange and one sort serve every class.
    """
    outs, exprs, lags = [], [], Lags()
    for n in names:
        it = Items(CLASSES[n].inputs["FT"][0], lags)
        for o, e in CLASSES[n].project(it).items():
            exprs.append(F.when(it.inside, clean(e)).alias(o))
            outs.append(o)
    has = {f"has__{n}": Items(CLASSES[n].inputs["FT"][0]).inside for n in names}
    rows = lags.add(ctx.statements()).select("T", "FTID", "date", *exprs, *[e.cast("int").alias(h) for h, e in has.items()])
    g = rows.groupBy("T", "FTID").agg(*[last_of(o).alias(o) for o in outs], *[F.max(h).alias(h) for h in has])
    g = g.filter(F.greatest(F.lit(0), *[F.col(h) for h in has]) > 0)
    return g if presence else g.drop(*has)


# ------------------------------------------------------------------ combinations
def double_quantile(df: DataFrame, a: str, b: str, out: str, by=("T",)) -> DataFrame:
    """1{a < q20 & b > q80} - 1{a > q80 & b < q20} within the group."""
    df = stage(df)
    q = group_quantiles(df, list(by), {"_a2": (a, 0.2), "_a8": (a, 0.8), "_b2": (b, 0.2), "_b8": (b, 0.8)})
    j = df.join(q, list(by), "left")
    A, B = F.col(a), F.col(b)
    up = flag((A < F.col("_a2")) & (B > F.col("_b8")))
    dn = flag((A > F.col("_a8")) & (B < F.col("_b2")))
    return j.withColumn(out, up - dn).drop("_a2", "_a8", "_b2", "_b8")


def compute_signals(sources: dict[str, DataFrame], grid: Grid, names=None, min_obs=None, extra: dict | None = None) -> DataFrame:
    """Wide table (T, DTID, FTID, signals) over the ids traded in the month before T.

    Window classes share one aggregation, statement formulas one snapshot.  Classes with their own logic are stacked under one another, one
    block of rows per class, and brought to one row per (T, key) by a single aggregate, whatever their number: a class gives at most one row
    per key, so the largest value is the value.  Written once is what several readers share: sources read more than twice, the statement
    snapshot of two or more classes, and results that other classes depend on.
    `extra` maps names to functions (context) -> (T, DTID|FTID, name).
    """
    want, need = resolve(names)
    win = [n for n in need if CLASSES[n].window]
    stm = [n for n in need if CLASSES[n].project]
    own = [n for n in need if n not in win and n not in stm]
    readers = lambda src: 1 + sum(src in CLASSES[n].inputs for n in own) + (src == "dt" and bool(win)) + (src == "FT" and bool(stm)) + (src == "dt" and "FT" in input_manifest(names))
    used = {d for n in need for d in CLASSES[n].depends}
    ctx = SignalContext({k: stage(v) if readers(k) > 2 else v for k, v in sources.items()}, grid, min_obs or {})
    sources = ctx.sources
    ctx.mc_start = input_manifest(names).get("dt", {"start": -1})["start"]
    out = base_index(sources["dt"], sources.get("FT"), grid)
    if "FTID" not in out.columns:
        out = out.withColumn("FTID", F.lit(None).cast("string"))
    if sum("FT" in CLASSES[n].inputs for n in need) > 1:
        ctx._cache["_ft"] = stage(ctx.statements())
    for kind, build, key in ((win, window_signals, "DTID"), (stm, statement_signals, "FTID")):
        if kind:
            w = build(ctx, kind, presence=True)
            w = stage(w) if used & set(kind) else w
            for n in kind:
                ctx._cache[n] = w.filter(F.col(f"has__{n}") > 0).select("T", key, *CLASSES[n].outputs)
            out = out.join(w.select("T", key, *[o for n in kind for o in want.get(n, [])]), ["T", key], "left")
    for n in reversed(own):  # dependencies come late in `need`; each is built once through the cache
        ctx._cache[n] = stage(ctx.cls(n)) if n in used else ctx.cls(n)
    for key in ("DTID", "FTID"):
        mine = [n for n in want if n in own and CLASSES[n].key == key]
        if mine:
            cols = [o for n in mine for o in want[n]]
            rows = [ctx.cls(n).selectExpr("T", key, *[f"cast({f'`{o}`' if o in want[n] else 'null'} as double) as `{o}`" for o in cols]) for n in mine]
            while len(rows) > 1:  # in pairs: a plan is analysed again with every union above it
                rows = [a.unionAll(b) for a, b in zip(rows[::2], rows[1::2])] + rows[len(rows) & ~1:]
            out = out.join(rows[0].groupBy("T", key).agg(*[F.max(o).alias(o) for o in cols]), ["T", key], "left")
    for name, fn in (extra or {}).items():
        df = fn(ctx)
        key = "DTID" if "DTID" in df.columns else "FTID"
        out = out.join(df.select("T", key, name), ["T", key], "left")
    return out.select("T", "DTID", "FTID", *[o for n in want for o in want[n]], *(extra or {}))
