"""Passage removal against brute force over all 50-byte strings."""
import hashlib
import random

import numpy as np
import pytest

from panelquant.llm import suffix_dedup as S
from panelquant.llm.suffix_dedup import LENGTH


def brute(rows):
    first: dict[bytes, int] = {}
    raw = [(S.NOBODY if i is None else i, (t or "").encode()) for i, t in rows]
    for i, b in raw:
        for k in range(len(b) - LENGTH + 1):
            w = b[k:k + LENGTH]
            first[w] = min(i, first.get(w, i))
    out = []
    for (d, _), (i, b) in zip(rows, raw):
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - LENGTH + 1):
            if first[b[k:k + LENGTH]] < i:
                gone[k:k + LENGTH] = True
        left = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdéü \x00") for _ in range(rng.randint(1, 7)))
    text = lambda k: " ".join(word() for _ in range(k))
    shared = [text(rng.randint(8, 60)) for _ in range(6)]
    rows = []
    for i in rng.sample(range(1000), n):
        kind = rng.random()
        if kind < 0.3 and rows:
            t = rng.choice(rows)[1] or ""
            if kind < 0.2 and len(t) > 10:  # an edited copy
                for _ in range(rng.randint(1, 4)):
                    k = rng.randrange(len(t))
                    t = t[:k] + rng.choice(["X", "", "qq"]) + t[k + 1:]
        else:
            t = text(rng.randint(0, 60)) + "".join(rng.choice(shared)[rng.randint(0, 20):] + text(rng.randint(0, 9)) for _ in range(rng.randint(0, 3)))
        rows.append((i, t))
    return rows + [(2000, None), (2001, ""), (2002, "a" * 49), (2003, "a" * 50), (2004, "a" * 300), (2005, "ab" * 200), (None, shared[0]), (None, "a" * 80), (2003, "a" * 60), (2003, "ab" * 40), (1, "\x00" * 120), (2, "\x00" * 90 + "x")]


@pytest.mark.parametrize("seed,block", [(1, 700), (2, 5000), (3, 1 << 20), (4, 300)])
def test_equals_brute_force(spark, seed, block):
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, "p") for i, t in rows], "doc_id long, text string, path string")
    got = S.dedup_passages(docs, block_bytes=block)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_empty_table_and_kept_bytes(spark):
    docs = spark.createDataFrame([(1, "u" * 60), (2, "head " + "u" * 60 + " tail"), (3, "short")], "doc_id long, text string")
    assert S.dedup_passages(docs.where("false")).count() == 0
    got = {r["doc_id"]: bytes(r["kept"]) for r in S.dedup_passages(docs, with_text=True).collect()}
    assert got == {1: b"u" * 60, 2: b"head  tail", 3: b"short"}


def test_long_text_over_pieces():
    """Runs of a text longer than a piece cover each window once, with the anchor inside the window."""
    rng = np.random.default_rng(0)
    b = S.Block.__new__(S.Block)
    texts = [rng.integers(97, 101, S.PIECE + 777, dtype=np.uint8).tobytes(), b"", rng.integers(97, 101, 60, dtype=np.uint8).tobytes()]
    b.ids, b.sizes, b.data = [1, 2, 3], np.array([len(t) for t in texts]), b"".join(texts)
    b.at, b.order = np.concatenate([[0], np.cumsum(b.sizes)]), np.array([1, 2, 3])
    seen = []
    for key, p, first, last, doc in b.runs():
        assert (first <= p).all() and (p - last >= 0).all() and (p + S.K <= first + LENGTH).all() and (p - first <= S.BEFORE).all()
        seen.append(np.concatenate([np.arange(i, j + 1) for i, j in zip(first, last)]))
    assert sorted(np.concatenate(seen)) == [*range(len(texts[0]) - 49), *range(len(texts[0]), len(texts[0]) + 11)]


def test_front_coding_and_merge():
    rng = random.Random(5)
    runs, every = [], []
    for _ in range(7):
        x = sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 12))).ljust(LENGTH, b"\0") for _ in range(rng.randint(0, 30)))
        lcp = S.common(np.frombuffer(b"".join(x), np.uint8).reshape(-1, LENGTH)).tolist()
        runs.append((x, lcp))
        every += x
    runs = [r for r in runs if r[0]]
    order, lcps, _ = S.merge(runs)
    at = [0] * len(runs)
    out = []
    for r in order:
        out.append(runs[r][0][at[r]])
        at[r] += 1
    assert out == sorted(every)
    assert lcps == S.common(np.frombuffer(b"".join(out), np.uint8).reshape(-1, LENGTH)).tolist()
