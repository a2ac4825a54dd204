"""Benchmark windows against brute force; offsets in the original; split automata."""
import random
import re

import pytest

from panelquant.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute(docs, items, k=10):
    out = []
    for i, t in docs:
        at = [(m[0], m.span()) for m in WORD.finditer(low(t))]
        w, hit, own = [x for x, _ in at], set(), set()
        for item, text in items:
            b = WORD.findall(low(text))
            for s in range(max(len(b) - k, 0) + 1 if b else 0):
                win = b[s:s + k]
                for p in range(len(w) - len(win) + 1):
                    if w[p:p + len(win)] == win:
                        hit |= set(range(p, p + len(win)))
                        own.add("" if item is None else str(item))
        spans = []
        for p in sorted(hit):
            if spans and spans[-1][2] == p - 1:
                spans[-1] = (spans[-1][0], at[p][1][1], p)
            else:
                spans.append((*at[p][1], p))
        out.append((i, len(w), len(hit), sorted(own), [(a, b) for a, b, _ in spans]))
    return sorted(out, key=str)


def data(seed):
    rng = random.Random(seed)
    vocab = ["a", "b", "C", "dé", "é", "X1", "9", "zz"]
    text = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", ", ", "\n", "-", " \x7f"]) for _ in range(n))
    items = [(k, text(rng.choice([3, 9, 10, 11, 25]))) for k in range(12)] + [(50, None), (51, ""), (52, "..!"), (None, "only é here"), (3, text(14)), (100, "q")]
    docs = []
    for i in range(60):
        t = text(rng.randint(0, 40))
        for _ in range(rng.randint(0, 2)):
            t += (rng.choice(items)[1] or "").upper().replace("É", "é") + text(rng.randint(0, 5))
        docs.append((i, t))
    return docs + [(100, None), (101, ""), (None, items[2][1]), (5, items[4][1]), (5, items[4][1]), (102, "ONLY é, HERE!"), (103, "Only É here"), (104, "x " * 300_000 + items[5][1])], items


@pytest.mark.parametrize("limit", [1 << 21, 120])
def test_equals_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(D, "AUTOMATON_BYTES", limit)
    docs, items = data(4)
    d = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, item_id int, n_hit int")
    b = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, doc_id string")
    got = [(r["doc_id"], r["n_words"], r["n_hit"], list(r["items"]), [(s["start"], s["end"]) for s in r["spans"]]) for r in D.scan(d, b).collect()]
    assert sorted(got, key=str) == brute(docs, items)
    kept = D.clean(d, b)
    assert kept.columns == d.columns
    assert sorted(((r[0], r[1]) for r in kept.collect()), key=str) == sorted(((i, t) for i, t in docs if not brute([(i, t)], items)[0][2]), key=str)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    b = spark.createDataFrame([("7", "a b")], "item_id string, text string")
    assert D.scan(d.where("false"), b).count() == 0
    r = D.scan(d, b.where("false")).first()
    assert (r["n_words"], r["n_hit"], r["items"]) == (3, 0, [])
    assert D.clean(d, b.where("false")).count() == 1 and D.clean(d, b).count() == 0
