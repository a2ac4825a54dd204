"""Near-copy components against brute force over all pairs."""
import random
import re

import pytest

from panelquant.llm import ngram_join as N


def sets_of(t, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows):
    s = [sets_of(t) for _, t in rows]
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            o = len(s[i] & s[j])
            if s[i] and 100 * o >= 80 * len(s[i] | s[j]):
                comp[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root(i)] = min(d, low.get(root(i), d))
    return sorted(((d, len(s[i]), low.get(root(i), d) if s[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed, n=150):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5))) for _ in range(300)]
    text = lambda k: [rng.choice(vocab) for _ in range(k)]
    base, shared, rows = [text(rng.randint(4, 120)) for _ in range(5)], text(60), []
    for i in rng.sample(range(5000), n):
        kind = rng.random()
        w = text(rng.randint(0, 60)) if kind < 0.3 else list(rng.choice(base)) if kind < 0.8 else shared + text(rng.randint(0, 30))
        if kind < 0.75:
            for _ in range(rng.randint(0, 3)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocab)
        t = "".join(x.upper() if rng.random() < 0.1 and x.isascii() else x for x in (y + rng.choice([" ", " ", "\n", "\t ", "\x0b", "\x1f "]) for y in w))
        rows.append((i, t))
    one = "w1 w2 w3 w4"
    return rows + [(6000, None), (6001, ""), (6002, " \n"), (6003, one), (6004, one.upper()), (6005, "w1 w2 w3"), (6006, "w1 w2 w3 w4 w5"), (6007, "É a b c d e"), (6008, "é a b c d e"), (None, one), (None, "lonely null text of six"),
                   (6009, "a b " * 3000), (6010, "a b " * 3000 + "c"), (6003, "other text with the same id"), (6011, "\x00 a\x00 b c d e f"), (6012, " x y z q r s t")]


@pytest.mark.parametrize("seed,block", [(1, 3000), (2, 1 << 20), (3, 400)])
def test_equals_brute_force(spark, seed, block):
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n long")
    got = N.near_duplicates(docs, block_bytes=block).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_large_group_of_near_copies(spark):
    """Members that link to few others are found through pivots and the last round alike."""
    rng = random.Random(9)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for i in range(400):
        w = list(base)
        for k in range(rng.choice([0, 1, 2, 3, 4, 6, 9])):
            w[rng.randrange(len(w))] = f"x{i}_{k}"
        rows.append((i * 3 % 1000, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, N.near_duplicates(docs, block_bytes=50_000).select("doc_id", "n_shingles", "component_id").collect()), key=str) == brute(rows)


def test_words_that_collide_in_polynomials(spark):
    """Thue-Morse words and their complements agree in every polynomial modulo 2^64; here they are different words."""
    x = "".join("ab"[bin(k).count("1") % 2] for k in range(2048))
    y = x.translate(str.maketrans("ab", "ba"))
    for n in (1, 7, 8, 9, 16, 255, 256, 257, 2048):
        h = N.word_hashes(f"{x[:n]} {y[:n]} {x[:n]}".encode())
        assert h[0] == h[2] != h[1]
    rows = [(1, f"w1 w2 w3 w4 {x}"), (2, f"w1 w2 w3 w4 {y}"), (3, f"w1 w2 w3 w4 {x} "), (4, f"w1 w2 w3 w4 {x[:200]}"), (5, f"w1 w2 w3 w4 {y[:200]}")]
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == brute(rows) == [(1, 1, 1), (2, 1, 2), (3, 1, 1), (4, 1, 4), (5, 1, 5)]


def test_word_hashes_do_not_depend_on_place():
    words = [b"a", b"ab", b"abcdefgh", b"abcdefghi", b"x" * 300, b"\xc3\xa9", b"a\x00", b"a"]
    h = N.word_hashes(b"  ".join(words) + b" ")
    assert h[0] == h[7] and len(set(h.tolist())) == 7
    for w, v in zip(words, h):
        assert N.word_hashes(w)[0] == N.word_hashes(b"zz " + w)[1] == v
    assert len(N.word_hashes(b"")) == len(N.word_hashes(b"   ")) == 0


def test_all_links(spark):
    rng, base = random.Random(4), [f"v{k}" for k in range(120)]
    rows = [r for r in corpus(4, 60) if r[0] is not None] + [(7000 + k, " ".join(base[rng.randint(0, 6):120 - rng.randint(0, 6)])) for k in range(50)]
    s = [sets_of(t) for _, t in rows]
    linked = lambda i, j: bool(s[i]) and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j])
    low = {}
    for (d, _), x in zip(rows, s):
        low[frozenset(x)] = min(d, low.get(frozenset(x), d))
    cls = [low[frozenset(x)] if x else d for (d, _), x in zip(rows, s)]
    want = sorted((d, cls[i], sum(linked(i, j) for j in range(len(rows)) if j != i)) for i, (d, _) in enumerate(rows))
    pairs = sorted({(min(cls[i], cls[j]), max(cls[i], cls[j])) for i in range(len(rows)) for j in range(i) if linked(i, j) and s[i] != s[j]})
    got, links = N.links(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, sig long"), block_bytes=3000)
    assert sorted(map(tuple, got.collect())) == want and len(pairs) > 200
    assert sorted(map(tuple, links.collect())) == pairs


def test_shingles_and_thresholds():
    got = list(N.shingle_sets([b"a b c d e f", b"", b"a b", b"A  b\tC d e f", b"b a"]))
    assert [len(x) for x in got] == [2, 0, 1, 2, 1]
    assert (got[0] == got[3]).all() and got[2][0] != got[4][0]
    for n in range(1, 200):
        p = N.prefix_length(n, 4, 5)
        assert p == n - -(-4 * n // 5) + 1
    long = list(N.shingle_sets([b"x y z w v " * 300_000, b"q r s t u"]))
    assert [len(x) for x in long] == [5, 1]


def test_filter_keeps_one_of_each_group(spark):
    docs = spark.createDataFrame([(5, "a b c d e f g", "x"), (3, "a b c d e f g", "y"), (4, "p q r s t", "z"), (None, "a b c d e f g", "n"), (7, None, "q"), (8, None, "q")], "doc_id long, text string, component_id string")
    kept = N.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["component_id"]) for r in kept.collect()) == [("3", "y"), ("4", "z"), ("7", "q"), ("8", "q"), ("None", "n")]
    assert N.near_duplicates(docs.where("false")).count() == 0
