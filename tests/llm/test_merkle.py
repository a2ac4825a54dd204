"""Merkle manifest against a plain tree."""
import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from panelquant.llm import merkle as M

H = lambda s: hashlib.sha256(s.encode()).hexdigest()
low = lambda t: None if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def leaf(row):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def grow(hs, fanout):
    """Root, and per leaf its steps."""
    steps, where = [[] for _ in hs], list(range(len(hs)))
    while len(hs) > 1:
        for k in range(len(steps)):
            w = where[k]
            run = hs[w // fanout * fanout:][:fanout]
            steps[k].append((run[:w % fanout], run[w % fanout + 1:]))
            where[k] = w // fanout
        hs = [H("".join(hs[i:i + fanout])) for i in range(0, len(hs), fanout)]
    return hs[0], steps


def brute(rows, fanout, tampered):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append((r[0], leaf(r), leaf((*r[:4], low(r[4]))) if tampered(r[0]) else leaf(r)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for v in groups.values():
        v.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    own = {g: grow([x[1] for x in groups[g]], fanout) for g in names}
    root, crown = grow([own[g][0] for g in names], fanout) if names else (None, [])
    out = []
    for g, up in zip(names, crown):
        for (i, h, now), steps in zip(groups[g], own[g][1]):
            proof = ""
            for a, b in steps + up:
                proof += "".join(a + b)
                now = H("".join(a) + now + "".join(b))
            out.append((i, h, own[g][0], root, H(proof), now, now == root))
    return sorted(out, key=str)


def rows_of(seed, n):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "B", "é", "Zz", "", "1|2", "ß\n"])
    rows = [(rng.randint(0, 10 ** 6), rng.choice(["hot", "hot", "hot", "é", "b", "", None]), rng.choice(["en", None]), rng.choice([None, 5, 77]), " ".join(word() for _ in range(rng.randint(0, 6)))) for _ in range(n)]
    rows += [(None, "hot", "x", 1, "No Key"), (None, None, None, None, None), (4, "hot", "en", 3, None), (5, "alone", "en", 3, "A"), (6, "b", "en", 3, "X" * 300_000), (6, "b", "en", 2, "Ba")]
    return rows + rows[:5] * 2 + [rows[0]] * 30


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
OUT = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def run(df, fanout, hit):
    now = F.when(hit, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))
    return sorted((tuple(r[c] for c in OUT) for r in M.manifest(df, {"text": now}, fanout=fanout).collect()), key=str)


@pytest.mark.parametrize("fanout,n", [(16, 600), (3, 100), (2, 9)])
def test_equals_plain_tree(spark, fanout, n):
    rows = rows_of(fanout, n)
    df = spark.createDataFrame([(*r, 0, "x", 1) for r in rows], SCHEMA + ", pos int, g string, steps int").repartition(5)
    assert run(df, fanout, F.col("doc_id") % 3 == 0) == brute(rows, fanout, lambda i: i is not None and i % 3 == 0)


def test_small_and_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert run(empty, 16, F.lit(True)) == []
    for rows in ([(1, "a", None, 2, "Text")], [(1, "a", None, 2, "Text"), (1, None, None, 2, "t")], [(k, "a", "en", 1, "T") for k in range(17)]):
        assert run(spark.createDataFrame(rows, SCHEMA), 16, F.col("doc_id") > 0) == brute(rows, 16, lambda i: i > 0)


def test_ranges_without_broadcast_and_no_change(spark, monkeypatch):
    monkeypatch.setattr(M, "SMALL_RANGES", 0)
    rows = rows_of(9, 80)
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted((tuple(r[c] for c in OUT) for r in M.manifest(df).collect()), key=str) == brute(rows, 16, lambda i: False)
    assert M.manifest(df).where("not verified").count() == 0


def test_steps_prove_membership(spark):
    """The steps of one row alone lead from its leaf to the root."""
    rows = rows_of(2, 50)
    for r in M.manifest(spark.createDataFrame(rows, SCHEMA), fanout=4).collect():
        h = r["leaf"]
        for s in r["steps"]:
            at = 64 * s["slot"]
            h = H(s["sib"][:at] + h + s["sib"][at:])
        assert h == r["root"]
