"""Self-join of documents on the Jaccard similarity of their word n-grams.

Rare-first prefix filtering: documents with equal sets form one class; the n-grams of a class are ordered by the number of documents that
hold them, rarest first.  Two classes with similarity t or more share an n-gram among the first n - ceil(t n) + 1 of each.  N-grams that
only one document holds can't be shared, so they take up places but send nothing: most documents drop out here.

Candidates come from an equi-join on prefix n-grams under the length filter (sizes), the positional filter (what may still follow the shared
places) and the suffix filter (overlap bound from counts per hash range), and are verified once per pair on the whole sets.  `links` returns
all links; `near_duplicates` and `one_of_each` need only those that connect.

A prefix n-gram of a large group of near copies would pair all its members.  So classes are first joined to one pivot per n-gram, the one
with the fewest rare n-grams; what this links is contracted to components, and only pairs of different components are looked at later,
with the members of a group's main component on one side only.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from panelquant.llm.common import components, parallelism, written
from panelquant.llm.repeats import known, look_up, merged_counts, mix, per_block, read_block, repeated_keys, short, write_blocks

FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))
PARTS = 32  # hash ranges of the suffix filter
_SIZE = 1 << 18  # bytes of text hashed at once
LONG_WORD = 256  # bytes; longer words are hashed one by one
_ODD = np.uint64(0xD6E8FEB86659FD93)


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words of a folded text: eight bytes at a time, scrambled after each step, all words of a length together.

    Long words go through BLAKE2.  Memory is a few times the number of words, not of bytes.
    """
    a = np.frombuffer(text + b" " * 8, np.uint8)
    w = np.concatenate([[False], a != 32, [False]])
    edge = np.nonzero(w[1:] != w[:-1])[0]
    start, end = edge[::2], edge[1::2]
    size = end - start
    eight = np.ndarray((len(text) + 1,), "<u8", a, strides=(1,))  # the eight bytes from each position on
    h = mix(size.astype(np.uint64) * _ODD)
    own, done = np.flatnonzero(size <= LONG_WORD), 0
    while len(own):
        left = np.minimum(size[own] - done, 8).astype(np.uint64)
        block = eight[start[own] + done] & (~np.uint64(0) >> (np.uint64(64) - np.uint64(8) * left))
        h[own] = mix((h[own] ^ block) * _ODD)
        done += 8
        own = own[size[own] > done]
    for k in np.flatnonzero(size > LONG_WORD).tolist():
        h[k] = int.from_bytes(hashlib.blake2b(text[start[k]:end[k]], digest_size=8).digest(), "little")
    return h


def shingle_sets(texts: list[bytes], words: int = 5) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's word n-grams; a text of fewer words is one n-gram, one without words has none."""
    odd = [np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3), np.uint64(0x589965CC75374CC3), np.uint64(0x1D8E4E27C47D124F)]
    factor = [odd[k % 5] + np.uint64(2 * (k // 5)) for k in range(words)]
    group: list[bytes] = []
    size = 0

    def flush():
        folded = b" ".join(group).translate(FOLD)
        h = word_hashes(folded)
        a = np.frombuffer(folded, np.uint8) != 32
        begins = np.nonzero(a & np.concatenate([[True], ~a[:-1]]))[0] if len(a) else np.zeros(0, np.int64)
        at = np.cumsum([0, *[len(t) + 1 for t in group]])
        cut = np.searchsorted(begins, at)
        grams = np.zeros(0, np.uint64)
        if len(h) >= words:
            grams = np.zeros(len(h) - words + 1, np.uint64)
            for k in range(words):
                grams += h[k:len(h) - words + 1 + k] * factor[k]
            grams = mix(grams)
        for i, j in zip(cut[:-1].tolist(), cut[1:].tolist()):
            if j - i >= words:
                yield np.unique(grams[i:j - words + 1])
            elif j > i:
                s = np.uint64(j - i)
                for k in range(i, j):
                    s = mix(h[k:k + 1] * factor[k - i] + s)[0]
                yield np.array([s], np.uint64)
            else:
                yield np.zeros(0, np.uint64)

    for t in texts:
        if group and size + len(t) > _SIZE:
            yield from flush()
            group, size = [], 0
        group.append(t)
        size += len(t) + 1
    if group:
        yield from flush()


def describe(words: int):
    """Set size and a 128-bit digest of the set, per text."""
    def run(texts: list[bytes]) -> tuple[list[int], list[bytes]]:
        sets = list(shingle_sets(texts, words))
        return [len(s) for s in sets], [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
    return run


def _chosen(row: dict, words: int) -> Iterator[np.ndarray]:
    texts = read_block(row["path"])[1]
    return shingle_sets([texts[i] for i in row["idx"]], words)


def prefix_length(n: np.ndarray | int, num: int, den: int):
    """n - ceil(t n) + 1 for t = num / den."""
    return n - (num * n + den - 1) // den + 1


def prefixes(blocks: DataFrame, words: int, num: int, den: int, count: int) -> DataFrame:
    """sig, n, rare, parts, grams, prefix (gram, pos) of the classes that share prefix n-grams with another document; written."""
    def keys_of(row: dict) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        held, size = [], 0
        for s in _chosen(row, words):
            held.append(s)
            size += len(s)
            if size > 1 << 18:
                yield np.unique(np.concatenate(held), return_counts=True)
                held, size = [], 0
        if held:
            yield np.unique(np.concatenate(held), return_counts=True)

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("gram", pa.int64()), ("pos", pa.int32())]))
        for b in batches:
            for row in b.to_pylist():
                table, out = known(row["payloads"]), []
                for sig, s in zip(row["sigs"], _chosen(row, words) if row["payloads"] else ()):
                    key = short(s, count)
                    df = look_up(key, table)
                    p = prefix_length(len(s), num, den)
                    rare = int((df < 2).sum())
                    if rare >= p:
                        continue
                    many = np.nonzero(df > 1)[0]
                    many = many[np.lexsort((key[many], df[many]))][:p - rare]
                    parts = np.bincount((s >> np.uint64(59)).astype(np.int64), minlength=PARTS)
                    out.append((sig, len(s), rare, parts, s.view(np.int64), [{"gram": g, "pos": rare + k} for k, g in enumerate(key[many].view(np.int64).tolist())]))
                    if len(out) == 200:
                        yield batch(out, kind, pa)
                        out = []
                if out:
                    yield batch(out, kind, pa)

    def batch(out, kind, pa):
        sig, n, rare, parts, grams, prefix = zip(*out)
        return pa.RecordBatch.from_arrays([pa.array(sig, pa.binary()), pa.array(n, pa.int64()), pa.array(rare, pa.int64()), pa.array(parts, pa.list_(pa.int32())), pa.array(grams, pa.list_(pa.int64())), pa.array(prefix, kind)],
                                          names=["sig", "n", "rare", "parts", "grams", "prefix"])

    keys = repeated_keys(blocks, keys_of, count)
    return written(per_block(blocks, payloads=keys).mapInArrow(run, "sig binary, n bigint, rare bigint, parts array<int>, grams array<bigint>, prefix array<struct<gram:bigint,pos:int>>"), "prefixes")


def needed(n: Column, m: Column, num: int, den: int) -> Column:
    """Least overlap of two sets at similarity num / den, times (num + den)."""
    return (n + m) * num


def may_link(num: int, den: int) -> Column:
    """Length and positional filter between the sides a and b of a join on a prefix n-gram."""
    n, m, i, j = (F.col(c) for c in ("a.n", "b.n", "a.pos", "b.pos"))
    lengths = (n * den >= m * num) & (m * den >= n * num)
    return lengths & (F.least(n - i, m - j) * (num + den) >= needed(n, m, num, den))


def verified(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """(src, dst) of the pairs (a, b of sig) that link: suffix filter on the counts per hash range, then the whole sets."""
    p = pairs.join(classes.select(F.col("sig").alias("a"), F.col("n").alias("na"), F.col("parts").alias("pa")), "a").join(
        classes.select(F.col("sig").alias("b"), F.col("n").alias("nb"), F.col("parts").alias("pb")), "b")
    bound = F.aggregate(F.zip_with("pa", "pb", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    p = p.where(bound * (num + den) >= needed(F.col("na"), F.col("nb"), num, den)).select("a", "b", "na", "nb")
    p = p.join(classes.select(F.col("sig").alias("a"), F.col("grams").alias("ga")), "a").join(classes.select(F.col("sig").alias("b"), F.col("grams").alias("gb")), "b")
    return p.where(F.size(F.array_intersect("ga", "gb")) * (num + den) >= needed(F.col("na"), F.col("nb"), num, den)).select(F.col("a").alias("src"), F.col("b").alias("dst"))


def _labelled(postings: DataFrame, links: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """Postings with their component so far; n-grams whose postings lie in one component are left out."""
    if links is None:
        p = postings.withColumn("comp", F.col("sig"))
    else:
        comp = written(components(links), "components")
        p = postings.join(comp.withColumnRenamed("node", "sig"), "sig", "left").withColumn("comp", F.coalesce("component", "sig")).drop("component")
    live = p.groupBy("gram").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("gram")
    return p.join(live, "gram")


def class_links(classes: DataFrame, num: int, den: int, rounds: int = 1) -> DataFrame:
    """(src, dst) links between classes that connect whatever any link connects; with rounds = 0, all links.  No pair is verified twice."""
    postings = written(classes.select("sig", "n", "rare", F.explode("prefix").alias("x")).select("sig", "n", "rare", "x.gram", "x.pos"), "postings")
    links = tried = None
    for k in range(rounds + 1):
        p = written(_labelled(postings, links), "live")
        if p.isEmpty():
            break
        if k < rounds:  # everyone against the n-gram's pivot: the fewest rare n-grams, then by a hash that changes with the round
            order = F.struct(F.col("rare") if k == 0 else F.lit(0).alias("rare"), F.xxhash64("sig", F.lit(k)).alias("h"), "sig", "n", "pos", "comp")
            right = p.groupBy("gram").agg(F.min(order).alias("z")).select("gram", "z.sig", "z.n", "z.pos", "z.comp")
            left = p
        else:  # what is left: members outside the n-gram's main component against all
            main = p.groupBy("gram", "comp").count().groupBy("gram").agg(F.max_by("comp", F.struct("count", "comp")).alias("main"))
            left, right = p.join(main, "gram").where("comp <> main").drop("main"), p
        pairs = left.alias("a").join(right.alias("b"), (F.col("a.gram") == F.col("b.gram")) & (F.col("a.comp") != F.col("b.comp")) & may_link(num, den))
        pairs = pairs.select(F.least("a.sig", "b.sig").alias("a"), F.greatest("a.sig", "b.sig").alias("b")).distinct()
        pairs = written(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        tried = pairs if tried is None else tried.unionByName(pairs)
        new = written(verified(pairs, classes, num, den), "links")
        links = new if links is None else links.unionByName(new)
    return links if links is not None else classes.select(F.col("sig").alias("src"), F.col("sig").alias("dst")).where("false")


def _classes(docs: DataFrame, words: int, num: int, den: int, doc_id: str, text: str, block_bytes: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, n, sig), classes (sig, class_id), and the classes that may link, with their sets."""
    count = min(2 * parallelism(docs.sparkSession), 65536)
    blocks = write_blocks(docs, describe(words), doc_id, text, **({"block_bytes": block_bytes} if block_bytes else {}))
    d = blocks.select("path", F.explode("docs").alias("x")).select("path", "x.doc_id", "x.idx", "x.n", "x.sig")
    each = written(d.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("members"), F.min(F.struct("path", "idx")).alias("home")), "classes")
    homes = each.groupBy("home.path").agg(F.array_sort(F.collect_list(F.struct("home.idx", "sig"))).alias("x")).select("path", F.col("x.idx").alias("idx"), F.col("x.sig").alias("sigs"))
    return d.select("doc_id", "n", "sig"), each.select("sig", "class_id", "members"), prefixes(written(homes, "homes"), words, num, den, count)


def links(docs: DataFrame, words: int = 5, threshold: tuple[int, int] = (4, 5), doc_id: str = "doc_id", text: str = "text", block_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The whole join: (doc_id, class_id, n_links) for every row, and (a, b), every pair of linked classes once, a < b, by class_id.

    class_id is the smallest doc_id with the same set; n_links counts the other rows that a row links to, those of its own class too.  So
    copies are not expanded into pairs, and no link between different texts is lost; the number of pairs is that of linked different sets.
    Rows without words have no links and their own doc_id as class_id.  Classes all of whose ids are null have a null class_id.
    """
    num, den = threshold
    d, each, sets = _classes(docs, words, num, den, doc_id, text, block_bytes)
    pairs = written(class_links(sets, num, den, rounds=0), "links")
    both = pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    n = both.join(each.select(F.col("sig").alias("dst"), "members"), "dst").groupBy("src").agg(F.sum("members").alias("others")).withColumnRenamed("src", "sig")
    per = each.join(n, "sig", "left").select("sig", "class_id", (F.col("members") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    rows = d.join(per, "sig", "left").select("doc_id", F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    name = lambda side: each.select(F.col("sig").alias(side), F.col("class_id").alias(f"{side}_id"))
    named = pairs.join(name("src"), "src").join(name("dst"), "dst")
    return rows, named.select(F.least("src_id", "dst_id").alias("a"), F.greatest("src_id", "dst_id").alias("b"))


def near_duplicates(docs: DataFrame, words: int = 5, threshold: tuple[int, int] = (4, 5), doc_id: str = "doc_id", text: str = "text", block_bytes: int | None = None) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id for every row of docs.

    class_id: smallest doc_id with the same set; component_id: smallest doc_id reachable over links of similarity threshold or more.  Null
    texts and texts without words have no n-grams, their own doc_id as both and no links.  Rows with the same doc_id are separate; null
    ids count only where no other id is there.  Empty tables give no rows.
    """
    num, den = threshold
    d, each, classes = _classes(docs, words, num, den, doc_id, text, block_bytes)
    links = class_links(classes, num, den)
    comp = components(links).withColumnRenamed("node", "sig")
    labelled = each.join(comp, "sig", "left").select("sig", "class_id", F.coalesce("component", "sig").alias("component"))
    lowest = labelled.groupBy("component").agg(F.min("class_id").alias("component_id"))
    labelled = labelled.join(lowest, "component").select("sig", "class_id", "component_id")
    return d.join(labelled, "sig", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, words: int = 5, threshold: tuple[int, int] = (4, 5), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows whose component holds a smaller doc_id; all columns stay as they are.

    Documents are told apart by doc_id: rows that repeat an id stay or go together, rows without an id stay.
    """
    found = near_duplicates(docs, words, threshold, doc_id, text)
    gone = written(found.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct(), "copies")
    return docs.join(gone, docs[f"`{doc_id}`"] == gone["_gone"], "left_anti")
