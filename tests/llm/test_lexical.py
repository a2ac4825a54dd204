"""Lexical search against scoring every document."""
import math
import random
import re

import numpy as np
import pytest

from panelquant.llm import lexical as S

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
terms = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in TERM.findall(t or "")]


def brute(docs, items, k=10):
    d = [(i, terms(t)) for i, t in docs]
    d = [(i, w) for i, w in d if w]
    n_docs, whole = len(d), sum(len(w) for _, w in d)
    df = {}
    for _, w in d:
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, t in items:
        best = []
        for i, w in d:
            m = 10 + 90 * len(w) * n_docs // whole
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (10 ** 9 * w.count(x) // (1000 * w.count(x) + 8 * m)) for x in set(terms(t)) if x in w)
            if s > 0:
                best.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(best)[:k])]
    return sorted(out, key=str)


def data(seed, n=220):
    rng = random.Random(seed)
    vocab = [f"w{int(40 * rng.random() ** 3)}" for _ in range(60)] + ["É", "é", "ÀB", "9"]
    text = lambda k: "".join(rng.choice([str.lower, str.upper])(rng.choice(vocab)) + rng.choice([" ", ", ", "\n", "-", "_"]) for _ in range(k))
    docs = [(k, text(rng.choice([0, 1, 5, 30]))) for k in range(n)]
    same = text(12)
    docs += [(1000 + rng.randint(0, 500), same) for _ in range(40)] + [(3, docs[3][1])] * 3 + [(None, same), (2000, None), (2001, ""), (2002, "!?"), (2003, "long " * 200_000 + docs[5][1])]
    items = [(k, text(rng.choice([1, 4, 15]))) for k in range(12)] + [(50, None), (51, ""), (52, "--"), (3, "w0 w0 W0"), (None, same), (53, same), (54, "nothing here")]
    return docs, items


def got(r):
    return sorted((tuple(x) for x in r.collect()), key=str)


@pytest.mark.parametrize("leaf,postings,block,seed", [(256, 1 << 20, 1 << 20, 20_000), (2, 100, 300, 20)])
def test_equals_brute_force(spark, monkeypatch, leaf, postings, block, seed):
    monkeypatch.setattr(S.Tree.__init__, "__defaults__", (leaf,))
    monkeypatch.setattr(S, "POSTINGS", postings)
    docs, items = data(leaf)
    d = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, n int, score int").repartition(4)
    b = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, doc_id string")
    assert got(S.search(d, b, block_bytes=block, seed_docs=seed)) == brute(docs, items)


def test_empty_tables_and_other_ids(spark):
    d = spark.createDataFrame([("a", "x y"), ("b", "y")], "doc_id string, text string")
    b = spark.createDataFrame([("q", "Y")], "item_id string, text string")
    assert [tuple(r)[:3] for r in S.search(d, b).orderBy("rank").collect()] == [("q", 1, "b"), ("q", 2, "a")]
    assert S.search(d.where("false"), b).count() == 0 and S.search(d, b.where("false")).count() == 0
    assert S.search(d, b).columns == S.search(d, b.where("false")).columns


def test_tree_bounds():
    """Bounds fall on the way down, shared paths leave far fewer nodes than documents, and pruning keeps the best documents."""
    rng = np.random.default_rng(5)
    items = S.Items([(0, "t1 t2 t300"), (1, "t5 t6")])
    vocab = {w: k for k, w in enumerate(items.terms)}
    docs = [sorted(vocab[w] for w in items.terms if rng.random() < {b"t300": 0.002}.get(w, 0.5)) for _ in range(4000)]
    df = {k: sum(k in x for x in docs) for k in range(len(vocab))}
    items.weigh(df, len(docs))
    at = np.concatenate([[0], np.cumsum([len(x) for x in docs])]).astype(np.int64)
    term = np.array([t for x in docs for t in x], np.int64)
    tree = S.Tree(items, [(False, k) for k in range(len(docs))], at, term, np.ones(len(term), np.int64), np.full(len(docs), 100), leaf=16)
    nodes, stack = [], [tree.root]
    while stack:
        nodes.append(stack.pop())
        stack += nodes[-1].kids
    assert len(nodes) < 1200 and sum(n.hi - n.lo for n in nodes if not n.kids) == len(docs)
    for n in nodes:
        for kid in n.kids:
            assert (kid.bound <= n.bound).all() and n.lo <= kid.lo and kid.hi <= n.hi
    best = []
    tree.search(0, best, 10, 0)
    full = sorted((-sum(int(S.contribution(items.weight[items.rank[t]], np.int64(1), 100)) for t in x if items.rank[t] in items.of_item[0]), (False, k)) for k, x in enumerate(docs))[:10]
    assert best == full


def test_norms_beyond_64_bits():
    n = np.array([1 << 40, 3], np.int64)
    assert S.norms(n, 1 << 30, 1 << 50).tolist() == [10 + 90 * (1 << 70) // (1 << 50), 10 + 90 * 3 * (1 << 30) // (1 << 50)]
