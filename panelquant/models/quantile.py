"""Quantile regression trained as a data-parallel Spark job.

The driver holds weights only.  Every step broadcasts them, each partition returns one summed
gradient per ensemble member, partial sums are combined on the executors before a handful of
rows reach the driver.  Rows never move: a step is a scan of the cached training columns.
"""
from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F, types as T

from panelquant.functions.stage import stage

# ---------------------------------------------------------------- network maths (per batch)


def _act(z, kind):
    return {"leaky_relu": lambda: np.maximum(z, 0.01 * z), "relu": lambda: np.maximum(z, 0), "sigmoid": lambda: 1 / (1 + np.exp(-z))}[kind]()


def _act_grad(z, kind):
    if kind == "sigmoid":
        s = 1 / (1 + np.exp(-z))
        return s * (1 - s)
    return (z > 0) * 0.99 + 0.01 if kind == "leaky_relu" else (z > 0) * 1.0


def _forward(layers, X, act):
    """Outputs and the (input, pre-activation) pairs of every layer; the last layer is linear."""
    tape, h = [], X
    for i, (Wt, b) in enumerate(layers):
        z = h @ Wt + b
        tape.append((h, z))
        h = z if i == len(layers) - 1 else _act(z, act)
    return h, tape


def loss_terms(e, taus, kind="pinball", delta=1.0):
    """Summed loss and its derivative with respect to the prediction; e = target - prediction."""
    if kind == "pinball":
        return np.where(e > 0, taus * e, (taus - 1) * e), np.where(e > 0, -taus, 1 - taus)
    if kind == "mse":
        return 0.5 * e * e, -e
    small = np.abs(e) <= delta
    base = np.where(small, 0.5 * e * e, delta * (np.abs(e) - 0.5 * delta))
    slope = -np.where(small, e, delta * np.sign(e))
    if kind == "huber":
        return base, slope
    if kind == "huber_pinball":
        w = np.where(e > 0, taus, 1 - taus)
        return w * base, w * slope
    raise ValueError(f"unknown loss {kind!r}")


@dataclass
class Spec:
    xs: list
    y: str
    taus: tuple
    stage2: list | None = None
    y2: str | None = None
    scale: str | None = None
    hidden: tuple = ()
    hidden2: tuple = ()
    act: str = "leaky_relu"
    loss: str = "pinball"
    heads: int = 1                      # 2 = two-stage, 3 = adds a mean head on the quantiles
    loss_weights: tuple = (1.0, 1.0, 0.05)
    holdout: float = 0.2

    @property
    def outputs(self):
        return len(self.taus)


def init_params(spec: Spec, seed: int) -> dict:
    rng = np.random.default_rng(seed)

    def net(sizes, last_zero=False):
        out = []
        for i in range(len(sizes) - 1):
            lim = 1 / np.sqrt(max(sizes[i], 1))
            Wt, b = rng.uniform(-lim, lim, (sizes[i], sizes[i + 1])), rng.uniform(-lim, lim, sizes[i + 1])
            if i == len(sizes) - 2 and (last_zero or len(sizes) == 2):
                Wt, b = np.zeros_like(Wt), np.ones_like(b) if last_zero else np.zeros_like(b)
            out.append([Wt, b])
        return out

    p = {"net1": net([len(spec.xs), *spec.hidden, spec.outputs])}
    if spec.heads >= 2:
        p["net2"] = net([len(spec.stage2), *spec.hidden2, 1], last_zero=True)
    if spec.heads == 3:
        p["net3"] = [[np.zeros((spec.outputs, 1)), np.zeros(1)]]
    return p


def _flat(p):
    return np.concatenate([a.ravel() for k in sorted(p) for layer in p[k] for a in layer])


def _unflat(v, like):
    out, i = {}, 0
    for k in sorted(like):
        out[k] = []
        for layer in like[k]:
            row = []
            for a in layer:
                row.append(v[i:i + a.size].reshape(a.shape))
                i += a.size
            out[k].append(row)
    return out


def _terms(e, taus, kind):
    """loss_terms with a cheaper pinball: the loss is minus the derivative times e.  Returns row sums over levels and the derivative."""
    if kind == "pinball":
        D = (e <= 0) - taus
        return -np.einsum("kn,kn->n", D, e), D
    L, D = loss_terms(e, taus, kind)
    return L.sum(axis=0), D * np.ones_like(e)


def evaluate_batch(p, spec: Spec, X1, y1, X2=None, y2=None, scale=None, grad=True, keep=None):
    """Per-row mean loss over levels and, if asked, the gradient of the summed loss (of the rows weighted by `keep`).

    Inside, arrays lie level by level, as the blocks do, so every pass runs along the rows.
    """
    taus = np.asarray(spec.taus)[:, None]
    k = spec.outputs
    w1, w2, w3 = spec.loss_weights
    T_ = lambda layers: [(np.ascontiguousarray(Wt.T), b[:, None]) for Wt, b in layers]
    net1 = T_(p["net1"])
    q, tape1 = _forward_levels(net1, X1.T, spec.act)
    wt = 1.0 if keep is None else keep
    if spec.heads == 1:
        L, D = _terms(y1 - q, taus, spec.loss)
        rows = L * (w1 / k)
        if not grad:
            return rows, None
        D *= w1 / k * wt
        return rows, {"net1": _backward_levels(net1, tape1, D, spec.act)}
    raw = q * scale
    clip1 = raw < -1
    q1 = np.where(clip1, -1 / scale, q) if clip1.any() else q
    net2 = T_(p["net2"])
    m, tape2 = _forward_levels(net2, X2.T, spec.act)
    q2 = raw * m
    clip2 = q2 < -1
    np.maximum(q2, -1.0, out=q2)
    L1, D1 = _terms(y1 - q1, taus, spec.loss)
    L2, D2 = _terms(y2 - q2, taus, spec.loss)
    rows = L1 * (w1 / k) + L2 * (w2 / k)
    g = {}
    if spec.heads == 3:
        net3 = T_(p["net3"])
        f, tape3 = _forward_levels(net3, q2, spec.act)
        e3 = y2 - f[0]
        rows = rows + w3 * 0.5 * e3 * e3
    if not grad:
        return rows, None
    D2 *= w2 / k * wt
    if spec.heads == 3:
        dout = (-w3 * e3 * wt)[None, :]
        g["net3"] = _backward_levels(net3, tape3, dout, spec.act)
        D2 += net3[0][0].T @ dout
    if clip2.any():
        D2[clip2] = 0.0
    D1 *= w1 / k * wt
    if clip1.any():
        D1[clip1] = 0.0
    g["net2"] = _backward_levels(net2, tape2, np.einsum("kn,kn->n", D2, raw)[None, :], spec.act)
    D2 *= scale * m
    D1 += D2
    g["net1"] = _backward_levels(net1, tape1, D1, spec.act)
    return rows, g


def _forward_levels(layers, h, act):
    """_forward on (features, rows) arrays and transposed weights, with the (input, pre-activation) pairs of every layer."""
    tape = []
    for i, (Wt, b) in enumerate(layers):
        z = Wt @ h
        z += b
        tape.append((h, z))
        h = z if i == len(layers) - 1 else _act(z, act)
    return h, tape


def _backward_levels(layers, tape, d, act):
    grads = [None] * len(layers)
    for i in reversed(range(len(layers))):
        h, z = tape[i]
        if i < len(layers) - 1:
            d = d * _act_grad(z, act)
        grads[i] = (h @ d.T, d.sum(axis=1))
        d = layers[i][0].T @ d if i else None
    return grads


# ---------------------------------------------------------------- training


@dataclass
class QuantileModel:
    spec: Spec
    members: list = field(default_factory=list)      # flat weight vectors kept by the drop rule
    losses: list = field(default_factory=list)       # best hold-out loss of each kept member
    history: list = field(default_factory=list)      # training loss per step, mean over members


def _mix(h: np.ndarray, seed: int) -> np.ndarray:
    """Uniform [0, 1) per row and member from one row hash."""
    add, m1, m2 = ((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF), 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
    z = h.astype(np.uint64) + np.uint64(add)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(m1)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(m2)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2 ** 53


def _columns(df: DataFrame, spec: Spec, key) -> DataFrame:
    num = lambda c, n: F.col(c).cast("double").alias(n)
    cols = [num(c, f"x1_{i}") for i, c in enumerate(spec.xs)] + [num(spec.y, "y1"), F.xxhash64(*key).alias("h")]
    if spec.heads >= 2:
        cols += [num(c, f"x2_{i}") for i, c in enumerate(spec.stage2)] + [num(spec.y2, "y2"), num(spec.scale, "s")]
    return df.select(*cols).dropna()


def _blocks(spec: Spec):
    """mapInPandas function: rows packed as little-endian doubles, one binary value per batch, so a step unpacks nothing row by row."""
    import pandas as pd

    names = _block_names(spec)

    def run(batches):
        for pdf in batches:
            if len(pdf):
                m = np.stack([pdf[c].to_numpy(dtype=np.float64, na_value=np.nan) for c in names])
                yield pd.DataFrame({"n": [len(pdf)], "h": [pdf["h"].to_numpy(dtype=np.int64).tobytes()], "v": [m.tobytes()]})

    return run


def _block_names(spec: Spec):
    x1 = [f"x1_{i}" for i in range(len(spec.xs))]
    return [*x1, "y1"] + ([*[f"x2_{i}" for i in range(len(spec.stage2))], "y2", "s"] if spec.heads >= 2 else [])


def _unpack(spec: Spec, n: int, h: bytes, v: bytes):
    """X1, y1, h, (X2, y2, s) of one block."""
    m, k = np.frombuffer(v, dtype=np.float64).reshape(-1, n), len(spec.xs)
    two = (m[k + 1:-2].T, m[-2], m[-1]) if spec.heads >= 2 else (None, None, None)
    return m[:k].T, m[k], np.frombuffer(h, dtype=np.int64), two


_BLOCK = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("h", T.BinaryType()), T.StructField("v", T.BinaryType())])
_STEP = T.StructType([T.StructField("m", T.IntegerType()), T.StructField("g", T.ArrayType(T.DoubleType())), T.StructField("st", T.ArrayType(T.DoubleType()))])


def _gradients(spec: Spec, vectors, like, seeds, holdout):
    """mapInPandas function: one row per member and partition (gradient sum, loss sums, counts).

    Training and hold-out rows of a member take one pass together: hold-out rows have weight 0 in the gradient, nothing is copied apart.
    """
    import pandas as pd

    def run(batches):
        acc = [np.zeros_like(v) for v in vectors]
        st = np.zeros((len(vectors), 4))
        nets = [_unflat(v, like) for v in vectors]
        for pdf in batches:
            for n, hb, vb in zip(pdf["n"], pdf["h"], pdf["v"]):
                X1, y1, h, two = _unpack(spec, n, hb, vb)
                for i, p in enumerate(nets):
                    tr = (_mix(h, seeds[i]) >= holdout).astype(np.float64)
                    rows, g = evaluate_batch(p, spec, X1, y1, *two, keep=tr)
                    acc[i] += _flat(g)
                    kept, loss = tr.sum(), rows @ tr
                    st[i] += (loss, kept, rows @ (1 - tr), n - kept)
        yield pd.DataFrame({"m": np.arange(len(vectors), dtype=np.int32), "g": list(acc), "st": list(st)})

    return run


def _combine(batches):
    import pandas as pd

    acc: dict = {}
    for pdf in batches:
        for m, g, st in zip(pdf["m"], pdf["g"], pdf["st"]):
            a = acc.get(m)
            acc[m] = (g, st) if a is None else (a[0] + g, a[1] + st)
    yield pd.DataFrame({"m": np.array(list(acc), dtype=np.int32), "g": [v[0] for v in acc.values()], "st": [v[1] for v in acc.values()]})


def fit_quantile(df: DataFrame, xs, y: str, taus, stage2=None, y2=None, scale=None, hidden=(), hidden2=(), act="leaky_relu", loss="pinball", heads=None,
                 members: int = 1, steps: int = 150, lr: float = 0.05, l1: float = 0.0, l1_stage2: float = 0.0, patience: int = 30, holdout: float = 0.2, seed: int = 1,
                 key=("date", "DTID"), start: QuantileModel | None = None, decay: float = 0.01, fan_in: int = 16, loss_weights=(1.0, 1.0, 0.05)) -> QuantileModel:
    """Full-batch proximal Adam; all members share each pass over the data.

    Hold-outs are hash splits per member.  Training stops when no member improved for `patience`
    steps, each member keeps its best weights, members with a loss above median + mean absolute
    deviation are dropped.  `start` continues from an earlier model.
    """
    heads = heads or (2 if stage2 else 1)
    spec = Spec(list(xs), y, tuple(taus), list(stage2) if stage2 else None, y2, scale, tuple(hidden), tuple(hidden2), act, loss, heads, loss_weights, holdout)
    data = _columns(stage(df), spec, key).mapInPandas(_blocks(spec), _BLOCK).persist(StorageLevel.MEMORY_AND_DISK)
    like = init_params(spec, seed)
    vec = [start.members[i % len(start.members)].copy() if start else _flat(init_params(spec, seed + i)) for i in range(members)]
    seeds = [seed + 1 + i for i in range(members)]
    pen = _penalty(like, l1, l1_stage2)
    mom, sq = [np.zeros_like(v) for v in vec], [np.zeros_like(v) for v in vec]
    best, best_v, wait, history = [np.inf] * members, [v.copy() for v in vec], 0, []
    parts = data.rdd.getNumPartitions()
    try:
        for t in range(1, steps + 1):
            g = data.mapInPandas(_gradients(spec, vec, like, seeds, holdout), _STEP)
            if parts > fan_in:
                g = g.repartition(fan_in).mapInPandas(_combine, _STEP)
            tot: dict = {}
            for r in g.collect():  # at most fan_in rows per member, weights only
                a, b = np.asarray(r["g"]), np.asarray(r["st"])
                tot[r["m"]] = (a, b) if r["m"] not in tot else (tot[r["m"]][0] + a, tot[r["m"]][1] + b)
            improved = False
            rate = lr / (1 + decay * t)
            for i in range(members):
                grad, st = tot[i]
                if st[1] == 0:
                    raise ValueError("no complete training rows")
                ref = st[2] / st[3] if st[3] > 0 else st[0] / st[1]
                if ref + 1e-5 < best[i]:
                    best[i], best_v[i], improved = ref, vec[i].copy(), True
                grad = grad / st[1]
                mom[i] = 0.9 * mom[i] + 0.1 * grad
                sq[i] = 0.999 * sq[i] + 0.001 * grad * grad
                d = np.sqrt(sq[i] / (1 - 0.999 ** t)) + 1e-8
                v = vec[i] - rate * (mom[i] / (1 - 0.9 ** t)) / d
                vec[i] = np.sign(v) * np.maximum(np.abs(v) - rate * pen, 0) if pen.any() else v
            history.append(float(np.mean([tot[i][1][0] / tot[i][1][1] for i in range(members)])))
            wait = 0 if improved else wait + 1
            if wait >= patience:
                break
    finally:
        data.unpersist()
    b = np.array(best)
    keep = np.where(b <= np.median(b) + np.abs(b - np.median(b)).mean() + 1e-12)[0]
    return QuantileModel(spec, [best_v[i] for i in keep], [float(b[i]) for i in keep], history)


def _penalty(like, l1, l1_stage2):
    """First-layer L1 weights in the order of the flat vector."""
    pen = {k: [[np.zeros_like(a) for a in layer] for layer in v] for k, v in like.items()}
    pen["net1"][0][0] += l1
    if "net2" in pen:
        pen["net2"][0][0] += l1_stage2
    return _flat(pen)


# ---------------------------------------------------------------- scoring


def predict(model: QuantileModel, df: DataFrame, bottleneck: bool = False) -> DataFrame:
    """Append q (stage 1), q_raw (stage 2), mean_head and bottleneck outputs, means over members.

    Stateless per batch: weights travel in the task closure, rows stay where they are.
    """
    spec, vectors = model.spec, model.members
    like = init_params(spec, 0)
    names = list(dict.fromkeys([*spec.xs, *(spec.stage2 or []), *([spec.scale] if spec.scale else [])]))
    extra = [T.StructField("q", T.ArrayType(T.DoubleType()))]
    if spec.heads >= 2:
        extra.append(T.StructField("q_raw", T.ArrayType(T.DoubleType())))
    if spec.heads == 3:
        extra.append(T.StructField("mean_head", T.DoubleType()))
    if bottleneck:
        extra.append(T.StructField("bottleneck", T.ArrayType(T.DoubleType())))
    schema = T.StructType([*df.schema.fields, *extra])

    def run(batches):
        for pdf in batches:
            num = {c: pdf[c].to_numpy(dtype=float, na_value=np.nan) for c in names}
            X1 = np.column_stack([num[c] for c in spec.xs])
            qs, q2s, f3, bots = [], [], [], []
            for v in vectors:
                p = _unflat(v, like)
                q, tape = _forward(p["net1"], X1, spec.act)
                if bottleneck:
                    bots.append(tape[-1][0])
                if spec.heads >= 2:
                    s = num[spec.scale][:, None]
                    m, _ = _forward(p["net2"], np.column_stack([num[c] for c in spec.stage2]), spec.act)
                    q2 = np.maximum(q * s * m, -1.0)
                    q2s.append(q2)
                    q = np.where(q * s < -1, -1 / s, q)
                    if spec.heads == 3:
                        f3.append(_forward(p["net3"], q2, spec.act)[0][:, 0])
                qs.append(q)
            out = pdf.copy()
            out["q"] = list(np.mean(qs, axis=0))
            if q2s:
                out["q_raw"] = list(np.mean(q2s, axis=0))
            if f3:
                out["mean_head"] = np.mean(f3, axis=0)
            if bottleneck:
                out["bottleneck"] = list(np.mean(bots, axis=0))
            yield out

    return df.mapInPandas(run, schema)


def linear_quantiles(df: DataFrame, xs, weights, bias, out: str = "q") -> DataFrame:
    """Linear scoring as an expression: q[k] = bias[k] + sum_i weights[i][k] * x_i.  No Python on the path."""
    def one(k) -> Column:
        e = F.lit(float(bias[k]))
        for i, x in enumerate(xs):
            e = e + F.lit(float(weights[i][k])) * F.col(x)
        return e

    return df.withColumn(out, F.array(*[one(k) for k in range(len(bias))]))


def head_weights(model: QuantileModel, spark, window: str = "") -> DataFrame:
    """Mean-head weights per member and level (one small row each)."""
    like = init_params(model.spec, 0)
    rows = []
    for m, v in enumerate(model.members):
        Wt, b = _unflat(v, like)["net3"][0]
        rows += [(window, m, float(t), float(w)) for t, w in zip(model.spec.taus, Wt[:, 0])] + [(window, m, None, float(b[0]))]
    return spark.createDataFrame(rows, "window string, member int, tau double, weight double")


def first_layer_weights(model: QuantileModel) -> np.ndarray:
    like = init_params(model.spec, 0)
    return np.mean([_unflat(v, like)["net1"][0][0] for v in model.members], axis=0)


def walk_forward_forecasts(df: DataFrame, splits: DataFrame, fit: dict, fine_tune: bool = False, steps_next: int | None = None, date: str = "date") -> DataFrame:
    """Train on each window, score its validation block, union the forecasts.

    The split table has one row per year; windows are sequential only when a model continues
    from the previous one (`fine_tune`).
    """
    out, model = None, None
    df = stage(df)
    for s in splits.orderBy("valid_start").collect():
        kw = dict(fit)
        if fine_tune and model is not None:
            kw.update(start=model, **({"steps": steps_next} if steps_next else {}))
        model = fit_quantile(df.filter(F.col(date).between(F.lit(s["train_start"]), F.lit(s["train_end"]))), **kw)
        f = predict(model, df.filter(F.col(date).between(F.lit(s["valid_start"]), F.lit(s["valid_end"]))))
        f = f.withColumn("valid_start", F.lit(s["valid_start"]))
        out = f if out is None else out.unionByName(f)
    return out


def compare_settings(train: DataFrame, valid: DataFrame, settings: dict[str, dict], y: str, taus) -> DataFrame:
    """Hold-out loss per setting: (setting, loss)."""
    from panelquant.operators.evaluate import mean_pinball

    out, train, valid = None, stage(train), stage(valid)
    for name, kw in settings.items():
        m = fit_quantile(train, y=y, taus=taus, **kw)
        r = mean_pinball(predict(m, valid), taus, y).withColumn("setting", F.lit(name))
        out = r if out is None else out.unionByName(r)
    return out


def fit_mean(df: DataFrame, xs, y: str, reg: float = 0.0, elastic: float = 0.0):
    """Mean-regression baseline: (weights, intercept) of a regularised linear model."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    d = VectorAssembler(inputCols=list(xs), outputCol="_x", handleInvalid="skip").transform(df.select(*xs, y).dropna())
    m = LinearRegression(featuresCol="_x", labelCol=y, regParam=reg, elasticNetParam=elastic, solver="normal" if reg == 0 else "auto").fit(d)
    return [float(v) for v in m.coefficients], float(m.intercept)
