"""Code lengths against context trees walked symbol by symbol; held-out accuracy; odd rows."""
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np

from panelquant.llm import language_id as L, queries


def brute_bits(model, texts, text):
    """Bits of a text under trees grown from the texts of one language."""
    a = int(model.symbol.max()) + 1
    trees = [defaultdict(Counter) for _ in range(4)]
    for t in texts:
        s = [int(model.symbol[b]) for b in L.PAD + t.encode()]
        for i in range(3, len(s)):
            for k in range(4):
                trees[k][tuple(s[i - k:i])][s[i]] += 1
    raw = L.PAD + text.encode()
    s, bits = [int(model.symbol[b]) for b in raw], 0.0
    for i in range(3, len(s)):
        gone: set = set()
        for k in (3, 2, 1, 0):
            seen = trees[k].get(tuple(s[i - k:i]))
            if not seen:
                continue
            left = {x: n for x, n in seen.items() if x not in gone}
            total, q = sum(left.values()), len(left)
            if s[i] in left:
                bits += math.log2((total + q) / left[s[i]])
                break
            if q:
                bits += math.log2((total + q) / q)
            gone |= set(seen)
        else:
            bits += math.log2(a - len(gone))
        if s[i] == a - 1:
            bits += math.log2(max(model.others, 1))
    return bits


def trained(spark, corpus):
    docs = spark.createDataFrame([(k, t, l) for k, (l, t) in enumerate((l, t) for l, ts in corpus.items() for t in ts)], "doc_id long, text string, lang string")
    return L.train(docs), docs


def test_code_lengths_equal_walked_trees(spark):
    rng = random.Random(1)
    gen = lambda sy: " ".join("".join(rng.choice(sy) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 30)))
    corpus = {"aa": [gen(["ba", "lo", "tu", "é"]) for _ in range(8)], "bb": [gen(["ba", "ki", "ß", "rr"]) for _ in range(8)], "cc": [gen(["zz", "x"]) for _ in range(3)]}
    model, _ = trained(spark, corpus)
    texts = [gen(["ba", "lo", "ki", "Q", "zz", "漢"]) for _ in range(12)] + ["b", "zz", "never seen: @~|"]
    got = L.code_lengths(model, model.tables(), [t.encode() for t in texts])
    for t, row in zip(texts, got):
        for name, bits in zip(model.languages, row):
            assert abs(bits - brute_bits(model, corpus[name], t)) < 1e-3 * (1 + bits), (t, name)


def test_odd_rows_and_extra_columns(spark):
    model, docs = trained(spark, {"de": ["der und die das ist nicht ein wort"] * 3, "en": ["the and of to in is that it was"] * 3})
    rows = [(1, None), (2, ""), (3, "12 34 !"), (4, "the the of"), (5, "der die und"), (6, "é"), (None, "is that"), (8, "the and of to " * 200_000), (8, "the and of to " * 200_000), (9, "漢字"), (10, "the of\x00\x00 and")]
    d = spark.createDataFrame([(*r, "zz", 0.0) for r in rows], "doc_id long, text string, lang string, score double")
    got = L.predict(d, model).collect()
    by = {(r["doc_id"]): r for r in got}
    assert len(got) == len(rows)
    assert [by[k]["lang_pred"] for k in (1, 2, 3)] == ["und"] * 3 and [by[k]["score"] for k in (1, 2, 3)] == [0.0] * 3
    assert (by[4]["lang_pred"], by[5]["lang_pred"], by[8]["lang_pred"], by[None]["lang_pred"]) == ("en", "de", "en", "en")
    assert all(0 <= r["score"] <= 1 for r in got) and by[6]["lang_pred"] in ("de", "en")
    assert L.predict(d, None).where("lang_pred <> 'und'").count() == 0 and L.predict(d.where("false"), model).count() == 0
    kept = L.accepted(d, model)
    assert kept.columns == d.columns and {1, 2, 3}.isdisjoint({r["doc_id"] for r in kept.collect()}) and kept.where("doc_id = 8").count() == 2
    assert L.train(docs.where("false")) is None and L.train(docs.selectExpr("doc_id", "text", "cast(null as string) lang")) is None
    tie = L.decide(model, model.tables(), ["@"])[0]
    assert tie == ["und"]


def test_held_out_accuracy_on_given_table(spark):
    got = {r["doc_id"]: r for r in queries.op3(spark, "/root/testdata/sf0.01").collect()}
    rows = duckdb.sql("select doc_id, text, lang from '/root/testdata/sf0.01/documents.parquet'").fetchall()
    right = n = 0
    for i, t, lang in rows:
        held = zlib.crc32(str(i).encode()) % 4 == 2
        assert got[i]["held_out"] == held
        if held and lang and t and any(c.isalpha() for c in t):
            n += 1
            right += got[i]["lang_pred"] == lang
    assert n > 150 and right / n > 0.97, (right, n)


def test_model_bounds(monkeypatch):
    monkeypatch.setattr(L, "CONTEXTS", 5)
    g = np.unique(np.random.default_rng(0).integers(0, 1 << 32, 500))
    m = L.build(["a"], np.zeros(len(g), np.int64), g, np.ones(len(g)))
    assert len(m.ids) == 5 and np.isfinite(m.rows).all()
    assert int(m.symbol.max()) <= L.SYMBOLS


def test_minority_scripts_keep_their_bytes_and_contexts(spark):
    """Bytes and contexts of two small languages in scripts of their own, beside large ones that fill the old bounds."""
    rng = random.Random(5)
    word = lambda chars: "".join(rng.choice(chars) for _ in range(rng.randint(2, 7)))
    gen = lambda chars, n: " ".join(word(chars) for _ in range(n))
    latin = [chr(c) for c in range(33, 127)]
    corpus = {f"l{k}": [gen(latin, 400) for _ in range(25)] for k in range(2)}
    scripts = {"ka": [chr(c) for c in range(0x10D0, 0x10F1)], "hy": [chr(c) for c in range(0x561, 0x587)]}
    corpus |= {x: [gen(c, 25) for _ in range(3)] for x, c in scripts.items()}
    model, _ = trained(spark, corpus)
    assert len(model.ids) > 16384 and int(model.symbol.max()) > 95
    assert {chr(c).encode()[k] for cs in scripts.values() for c in map(ord, cs) for k in range(len(chr(c).encode()))} <= set(np.flatnonzero(model.symbol < 256 - model.others))
    texts = [gen(c, 6) for c in scripts.values() for _ in range(10)]
    got = L.code_lengths(model, model.tables(), [t.encode() for t in texts])
    for t, row in zip(texts[::5], got[::5]):
        for name, bits in zip(model.languages, row):
            assert abs(bits - brute_bits(model, corpus[name], t)) < 1e-3 * (1 + bits), (t, name)
    assert [model.languages[k] for k in got.argmin(1)] == ["ka"] * 10 + ["hy"] * 10


def test_any_number_of_labels(spark):
    """Dirty labels are languages of their own and stop nothing."""
    corpus = {f"x{k:03d}": [f"w{k}q " * 9] for k in range(90)} | {"en": ["the and of to in is that it was"] * 3}
    model, docs = trained(spark, corpus)
    assert model.languages == sorted(corpus)
    got = {r["doc_id"]: r["lang_pred"] for r in L.predict(docs, model).collect()}
    assert all(got[r["doc_id"]] == r["lang"] for r in docs.collect())


def test_long_texts_are_scored_in_pieces(spark, monkeypatch):
    model, _ = trained(spark, {"de": ["der und die das ist nicht ein wort"] * 3, "en": ["the and of to in is that it was"] * 3})
    texts = [b"the und of " * 40, b"", b"is", b"das it \xc3\xa9" * 30]
    whole = L.code_lengths(model, model.tables(), texts)
    monkeypatch.setattr(L, "PIECE", 37)
    assert np.allclose(L.code_lengths(model, model.tables(), texts), whole) and not whole[1].any()
