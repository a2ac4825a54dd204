"""License scan against a scan of every start."""
import random
import re

import pytest
from pyspark.sql import functions as F

from panelquant.llm import licenses as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute(docs, templates):
    out = []
    for i, t in docs:
        w = WORD.findall(low(t))
        found = []
        for x in templates:
            tw = [y.decode() for y in x.words]
            for s in range(-len(tw), len(w)):
                here = [0 <= s + p < len(w) and w[s + p] == y for p, y in enumerate(tw)]
                if all(here[p] for p in x.must) and sum(here) * x.least[1] >= len(tw) * x.least[0]:
                    found.append((x.label, s, sum(here), sum(here) / len(tw), x.base))
        out.append((i, len(w), sorted(found)))
    return sorted(out, key=str)


TOY = [L.Template("ab", "a b", base=True), L.Template("aba", "a b a", base=True), L.Template("long", "x y a b z a q", ("a b z",), (4, 7)), L.Template("long", "z z a", (), (1, 3)), L.Template("é", "é b é c", ("b", "c"), (1, 2))]


def data(seed):
    rng = random.Random(seed)
    vocab = ["a", "A", "b", "x", "y", "z", "q", "é", "c", "w1", "É"]
    docs = [(k, "".join(rng.choice(vocab) + rng.choice([" ", ", ", "\n", "-"]) for _ in range(rng.randint(0, 60)))) for k in range(150)]
    return docs + [(200, None), (201, ""), (202, "..."), (None, "a b"), (5, "A-B a"), (5, "A-B a"), (203, "a b z"), (204, "b z a q")]


@pytest.mark.parametrize("piece", [1 << 20, 7])
def test_equals_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(L, "PIECE", piece)
    cut = L.pieces
    monkeypatch.setattr(L, "pieces", lambda t, size=None: cut(t, piece))
    docs = data(3)
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, n_words int, places string").repartition(3)
    got = sorted(((r["doc_id"], r["n_words"], sorted(tuple(p) for p in r["places"])) for r in L.scan(d, TOY).collect()), key=str)
    assert got == brute(docs, TOY)


def test_pieces_end_between_words():
    t = b"aa bbb  c " + b"d" * 30 + b" e"
    for size in (1, 3, 10, 100):
        assert [w for p in L.pieces(t, size) for w in p.split()] == t.split()
    assert list(L.pieces(b"")) == []


def test_notices_and_summary(spark):
    docs = [(1, "Intro.\nLicensed under CC BY-NC 4.0.\nAll rights reserved. ALL RIGHTS RESERVED"), (2, "Use of the Apache License, version 2.0"), (3, "licensed under the Apache license"), (4, "GNU General Public License, Version 3"),
            (5, "released under the MIT License"), (6, None), (7, "word " * 300_000 + "cc by")]
    got = {r["doc_id"]: r for r in L.summary(L.scan(spark.createDataFrame(docs, "doc_id long, text string"))).collect()}
    assert got[1]["labels"] == "cc-by,cc-by-nc-4.0,reserved" and got[1]["base_labels"] == "cc-by,reserved"
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["score"]) == (3, 3, 11, 1.0)
    assert got[2]["labels"] == "apache-2.0" and got[2]["n_base"] == 0 and got[2]["first_word"] is None and 0.7 < got[2]["score"] < 1
    assert got[3]["labels"] == "" and got[3]["score"] == 0.0
    assert got[4]["labels"] == "gpl,gpl-3.0" and got[5]["labels"] == "mit"
    assert (got[6]["n_words"], got[6]["labels"]) == (0, "")
    assert (got[7]["n_words"], got[7]["first_word"], got[7]["labels"]) == (300_002, 300_000, "cc-by")


def test_empty_table_and_bad_template(spark):
    d = spark.createDataFrame([(1, "cc by")], "doc_id long, text string")
    assert L.scan(d.where("false")).count() == 0
    assert L.scan(d.select(F.col("text"), F.lit("k").alias("doc_id"))).first()["doc_id"] == "k"
    with pytest.raises(ValueError):
        L.scan(d, [L.Template("x", "a b", ("b a",))])


def test_rare_words_come_from_the_corpus():
    words = L.vocabulary(TOY)
    df = {words.index(b"a"): 90, words.index(b"b"): 50, words.index(b"z"): 3}
    assert L.rare_words(TOY, words, df)[2] == [(words.index(b"z"), 4), (words.index(b"b"), 3), (words.index(b"a"), 2)]
