"""Raked margins and calibrated budgets; the lookup table against a plain fill; the pipeline against its stages done by hand."""
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from panelquant.llm import mixing as M, sharding as S


def docs(spark, n=400):
    rng = random.Random(3)
    rows = [(k, " ".join("w%d" % rng.randint(0, 9) for _ in range(rng.randint(0, 60))) + rng.choice(["", " | | |" * 9, "\n" * 20]), rng.choice(["en"] * 6 + ["de", None]), rng.choice(["s0"] * 8 + ["s1", "s2", None]), 0.5) for k in range(n)]
    rows += [(n, None, "en", "s0", 0.1), (n + 1, "", "fr", "s9", 0.1), (None, "null id", "en", "s1", 0.1), (3, "same id", "de", "s1", 0.2), (3, "same id", "de", "s1", 0.2)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, p double"), rows


def test_margins_meet_targets(spark):
    d, _ = docs(spark)
    cells = d.groupBy(F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), F.lit("t").alias("topic")).agg(F.sum(M.token_count(F.col("text"))).alias("n"))
    targets = {"source": M.flattened(cells, "source", 0.5), "lang": spark.createDataFrame([("en", 3.0), ("de", 1.0), ("absent", 9.0)], "lang string, target double")}
    w = M.rake(cells, targets, 30).collect()
    total = sum(r["w"] for r in w)
    by = Counter()
    for r in w:
        by[r["lang"]] += r["w"] / total
    assert abs(by["en"] - 0.75) < 1e-6 and abs(by["de"] - 0.25) < 1e-6 and by[""] == 0
    src = Counter()
    for r in w:
        src[r["source"]] += r["w"]
    assert src["s0"] / total < 0.6  # flattened from about three quarters


@pytest.mark.parametrize("budget", [0.0, 0.3, 0.9, 1.0, 5.0])
def test_calibration_meets_budget(spark, budget):
    cells = spark.createDataFrame([("a", 100, 50.0), ("b", 10, 40.0), ("c", 1000, 10.0), ("d", 0, 0.0)], "source string, n long, w double")
    r = M.calibrate(cells, budget).collect()
    assert all(0 <= x["p"] <= 1 for x in r)
    assert abs(sum(x["n"] * x["p"] for x in r) - min(budget, 1) * 1110) < 1e-6


def test_budget_with_halving_weights(spark):
    """Each cell is capped long before the next: no number of fixed rounds would do."""
    rows = [(f"s{k}", 1000, 2.0 ** -k) for k in range(60)]
    for budget in (0.1, 0.5, 0.9, 0.999):
        r = M.calibrate(spark.createDataFrame(rows, "source string, n long, w double"), budget).collect()
        assert abs(sum(x["n"] * x["p"] for x in r) / 60_000 - budget) < 1e-9
        s = {round(x["p"] * x["n"] / x["w"], 3) for x in r if x["p"] < 1}
        assert max(s) / min(s) - 1 < 1e-9


def test_contradicting_targets_end_with_a_gap(spark):
    cells = spark.createDataFrame([("a", "x", 100), ("b", "y", 100)], "source string, lang string, n long")
    targets = {"source": spark.createDataFrame([("a", 1.0), ("b", 1.0)], "source string, target double"), "lang": spark.createDataFrame([("x", 3.0), ("y", 1.0)], "lang string, target double")}
    r = M.rake(cells, targets).collect()
    assert min(x["gap"] for x in r) > 0.1 and abs(sum(x["w"] for x in r) - 1) < 1e-9
    ok = M.rake(cells, {"source": targets["source"]}).collect()
    assert max(x["gap"] for x in ok) <= 1e-12


def test_mix_rows_and_sample(spark):
    d, rows = docs(spark)
    m = M.mix(d, {"en": 0.5, "de": 0.5}, budget=0.4)
    got = m.collect()
    assert len(got) == len(rows) and {r["sampled"] for r in got} == {True, False}
    tokens = sum(r["n_tokens"] for r in got)
    assert abs(sum(r["n_tokens"] * r["p"] for r in got) - 0.4 * tokens) < 1e-6 * tokens
    assert all(r["n_tokens"] == 0 for r in got if r["doc_id"] in (400, 401))
    kept = M.sample(d, {"en": 0.5, "de": 0.5}, budget=0.4)
    assert kept.columns == d.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in got if r["sampled"])
    assert M.mix(d.where("false")).count() == 0 and M.sample(d.where("false")).count() == 0


def test_null_and_unnamed_languages_are_drawn(spark):
    """Languages without a target keep their flattened share; the named ones divide the rest as given."""
    rows = [(k, "w " * 20, l, f"s{k % 2}") for k, l in enumerate(["en"] * 200 + ["de"] * 100 + [None] * 50 + ["it"] * 50)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = M.mix(d, corpus_pipeline.LANGUAGES, budget=0.3, sweeps=20).collect()
    assert all(r["p"] > 0 for r in got)
    assert {r["lang"] for r in got if r["sampled"]} == {"en", "de", "", "it"}
    by = Counter()
    for r in got:
        by[r["lang"]] += r["n_tokens"] * r["p"]
    flat = {"en": 200 ** 0.5, "de": 100 ** 0.5, "": 50 ** 0.5, "it": 50 ** 0.5}
    rest = (flat[""] + flat["it"]) / sum(flat.values())
    want = {"en": (1 - rest) * 2 / 3, "de": (1 - rest) / 3, "": rest / 2, "it": rest / 2}
    assert all(abs(by[l] / sum(by.values()) - w) < 1e-6 for l, w in want.items())
    kept = M.sample(d, corpus_pipeline.LANGUAGES, budget=0.3, sweeps=20)
    assert kept.where("lang is null").count() == sum(r["sampled"] for r in got if r["lang"] == "") > 0


def plain_table(names, slots):
    owner, at = {}, {n: 0 for n in names}
    perm = {n: [(a + k * b) % slots for k in range(slots)] for n in names for a, b in [S.preferences(n, slots)]}
    while len(owner) < slots:
        for n in names:
            while at[n] < slots and perm[n][at[n]] in owner:
                at[n] += 1
            if len(owner) < slots:
                owner[perm[n][at[n]]] = n
    return [names.index(owner[k]) for k in range(slots)]


def test_lookup_table():
    for names, slots in ((["a"], 7), (["a", "b", "c"], 13), ([f"s{k}" for k in range(20)], 211)):
        t = S.lookup_table(names, slots)
        assert t == plain_table(names, slots)
        c = Counter(t)
        assert max(c.values()) - min(c.values()) <= 1
    a, b = S.lookup_table([f"s{k}" for k in range(32)]), S.lookup_table([f"s{k}" for k in range(31)])
    moved = sum(x != y for x, y in zip(a, b) if x != 31) / len(a)
    assert moved < 0.1
    for bad in ([], ["a", "a"], ["x"] * 8):
        with pytest.raises(ValueError):
            S.lookup_table(bad, 7)
    with pytest.raises(ValueError):
        S.lookup_table(["a"], 8)


def test_place_and_write(spark):
    d = spark.createDataFrame([(k, "t", "old") for k in range(3000)] + [(None, "n", "old"), (None, "m", "old"), (5, "again", "old")], "doc_id long, text string, shard string")
    names = [f"s{k}" for k in range(7)]
    p = S.place(d, names, slot="slot")
    rows = p.collect()
    t = S.lookup_table(names)
    assert len(rows) == 3003 and all(r["shard"] == names[t[r["slot"]]] for r in rows)
    assert len({r["shard"] for r in rows if r["doc_id"] is None}) == 1 and len({r["shard"] for r in rows if r["doc_id"] == 5}) == 1
    assert min(Counter(r["shard"] for r in rows).values()) > 300
    back = spark.read.parquet(S.write_shards(d, names))
    assert sorted(map(str, back.select("doc_id", "text", "shard").collect())) == sorted(map(str, p.select("doc_id", "text", "shard").collect()))
    assert S.place(d.where("false"), names).count() == 0


def test_place_with_clashing_names(spark):
    d = spark.createDataFrame([(1, "a", "b", "c", "d")], "doc_id long, _shard string, _slot string, row string, `x.y` string")
    r = S.place(d, ["p", "q"], slot="slot")
    assert r.columns == [*d.columns, "shard", "slot"]
    assert tuple(r.first())[:5] == (1, "a", "b", "c", "d")
    assert S.place(r, ["p"], slot="slot").columns == r.columns


def test_pipeline_equals_stages_by_hand(spark):
    """Every decision of the pipeline, taken again from the operators' tested brute-force forms on what the stage before kept."""
    from test_decontaminate import brute as windows
    from test_ngram_join import brute as groups

    from panelquant.llm import language_id

    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = {r["doc_id"]: r for r in table.collect()}
    model = language_id.train(table.where(language_id.in_training(F.col("doc_id"))))
    ids = list(rows)
    lang, score, _ = language_id.decide(model, model.tables(), [rows[i]["text"] for i in ids])
    kept = [i for i, l, s in zip(ids, lang, score) if l != "und" and s >= corpus_pipeline.LEAST_SCORE]
    lowest = {d: c for d, _, c in groups([(i, rows[i]["text"]) for i in kept])}
    kept = [i for i in kept if lowest[i] == i]
    hit = {d for d, _, n, _, _ in windows([(i, rows[i]["text"]) for i in kept], items) if n}
    kept = [i for i in kept if i not in hit]
    m = M.mix(spark.createDataFrame([rows[i] for i in kept], table.schema), corpus_pipeline.LANGUAGES, budget=corpus_pipeline.BUDGET, sweeps=corpus_pipeline.SWEEPS)
    kept = sorted(r["doc_id"] for r in m.where("sampled").collect())
    got = corpus_pipeline.run(spark, sf).collect()
    assert sorted(r["doc_id"] for r in got) == kept and 0 < len(kept) < len(rows)
    t = S.lookup_table(corpus_pipeline.SHARDS)
    assert all(r["shard"] == corpus_pipeline.SHARDS[t[r["slot"]]] and r["text"] == rows[r["doc_id"]]["text"] for r in got)
    assert len(corpus_pipeline.STAGES) == 5
