"""Ranked lexical search over document FP-trees.

Query items are taken in blocks of bounded size.  For a block, one pass over the texts restricts every document to the terms of its items
(term numbers and frequencies); document frequencies and lengths are counted over all documents.  Each task then builds FP-trees over bounded
runs of documents: restricted vectors in order of falling document frequency, sorted, so that documents which share their first terms
share a path, with paths that do not branch drawn together and nodes of few documents kept as leaves.  Every node carries, per term, the
largest frequency, and the smallest length norm, of its subtree; a score grows with the one and falls with the other, so they bound it.
Each item goes down depth first, best child first, and leaves out subtrees that cannot enter its best documents.

The best documents of a small sample give every item a score that its result must reach; all tasks start from it, which changes nothing
but the number of nodes that are looked at.
"""
from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from panelquant.llm.common import only, parallelism, small_batches, typed, written
from panelquant.llm.decontaminate import FOLD, words_of
from panelquant.llm.licenses import pieces

BLOCK_BYTES = 1 << 20  # text of the items searched in one pass; a longer single item forms a block
LEAF = 256  # documents of a node that is not split
POSTINGS = 1 << 20  # restricted terms per tree
SEED_DOCS = 20_000  # documents of the sample whose best scores start the search
_SCALE = 1_000_000_000


class Items:
    """Items of a block: their distinct terms, as numbers in order of falling document frequency once `rank` is known."""

    def __init__(self, rows: list[tuple]):
        self.ids = [i for i, _ in rows]
        sets = [sorted(set(words_of(t))) for _, t in rows]
        self.terms = sorted({w for s in sets for w in s})
        number = {w: k for k, w in enumerate(self.terms)}
        self.sets = [[number[w] for w in s] for s in sets]

    def weigh(self, df: dict[int, int], n_docs: int) -> None:
        """Ranks and weights of terms, the terms of each item and the items of each term."""
        count = np.array([df.get(k, 0) for k in range(len(self.terms))], np.int64)
        order = np.lexsort((np.arange(len(count)), -count))
        self.rank = np.empty(len(count), np.int64)
        self.rank[order] = np.arange(len(count))
        self.weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * c + 1))) for c in count[order].tolist()], np.int64)
        self.of_item = [np.sort(self.rank[s]) if s else np.zeros(0, np.int64) for s in self.sets]
        pairs = sorted((int(t), k) for k, s in enumerate(self.of_item) for t in s)
        self.owner = np.array([k for _, k in pairs], np.int64)
        self.first = np.searchsorted(np.array([t for t, _ in pairs], np.int64), np.arange(len(count) + 1))


def contribution(weight: np.ndarray, tf: np.ndarray, m) -> np.ndarray:
    return weight * (_SCALE * tf // (1000 * tf + 8 * m))


def norms(n: np.ndarray, n_docs: int, all_terms: int) -> np.ndarray:
    if int(n.max(initial=0)) * 90 * n_docs < 1 << 63:
        return 10 + 90 * n * n_docs // max(all_terms, 1)
    return np.array([10 + 90 * int(x) * n_docs // all_terms for x in n], np.int64)


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All numbers of the ranges [first, first + count), one range after the other."""
    ends = np.cumsum(count)
    return np.repeat(first - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)


class Node:
    """A subtree: documents lo..hi of the sorted run, largest frequency per term, smallest norm and id, bound per item."""

    __slots__ = ("lo", "hi", "kids", "terms", "most", "m", "low", "bound", "at", "doc", "part")

    def limit(self, items: Items) -> None:
        c = contribution(items.weight[self.terms], self.most, self.m)
        count = items.first[self.terms + 1] - items.first[self.terms]
        self.bound = np.zeros(len(items.ids), np.int64)
        np.add.at(self.bound, items.owner[spread(items.first[self.terms], count)], np.repeat(c, count))


class Tree:
    """The FP-tree of a run of documents: keys orders them among equal scores, at/term/tf are their restricted vectors."""

    def __init__(self, items: Items, keys: list, at: np.ndarray, term: np.ndarray, tf: np.ndarray, m: np.ndarray, leaf: int = LEAF):
        self.items, self.leaf = items, leaf
        size = np.diff(at)
        rank = items.rank[term]
        order = np.lexsort((rank, np.repeat(np.arange(len(size)), size)))
        rank, tf = rank[order], tf[order].astype(np.int64)
        raw = rank.astype(">u4").tobytes()
        docs = sorted(range(len(size)), key=lambda i: raw[4 * at[i]:4 * at[i + 1]])
        own = spread(at[docs], size[docs])
        self.keys, self.m = [keys[i] for i in docs], m[docs]
        self.size, self.term, self.tf = size[docs], rank[own], tf[own]
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        self.root = self.grow(0, len(docs), 0)

    def shared(self, lo: int, hi: int, depth: int) -> int:
        """Terms that all documents of a sorted range start with."""
        a, b = (self.term[self.at[i] + depth:self.at[i + 1]] for i in (lo, hi - 1))
        n = min(len(a), len(b))
        other = np.flatnonzero(a[:n] != b[:n])
        return depth + (int(other[0]) if len(other) else n)

    def grow(self, lo: int, hi: int, depth: int) -> Node:
        node = Node()
        node.lo, node.hi, node.kids = lo, hi, []
        if hi - lo > self.leaf:
            depth = self.shared(lo, hi, depth)
            here = np.full(hi - lo, -1, np.int64)
            more = self.size[lo:hi] > depth
            here[more] = self.term[self.at[lo:hi][more] + depth]
            cuts = [0, *(np.flatnonzero(here[1:] != here[:-1]) + 1).tolist(), hi - lo]
            if len(cuts) == 2:  # equal vectors
                cuts = [*range(0, hi - lo, self.leaf), hi - lo]
            start = 0
            for a, b in zip(cuts[:-1], cuts[1:]):  # neighbours of few documents share a leaf
                if b - start > self.leaf and a > start:
                    node.kids.append(self.grow(lo + start, lo + a, depth))
                    start = a
                if b - start > self.leaf or b == hi - lo:
                    node.kids.append(self.grow(lo + start, lo + b, depth))
                    start = b
        if node.kids:
            t, most = np.concatenate([k.terms for k in node.kids]), np.concatenate([k.most for k in node.kids])
        else:
            own = slice(self.at[lo], self.at[hi])
            t, most = self.term[own], self.tf[own]
        order = np.argsort(t, kind="stable")
        t, most = t[order], most[order]
        first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if len(t) else np.zeros(0, np.int64)
        node.terms, node.most = t[first], np.maximum.reduceat(most, first) if len(t) else most
        node.m, node.low = int(self.m[lo:hi].min(initial=1 << 62)), min(self.keys[lo:hi], default=None)
        if not node.kids:
            doc = np.repeat(np.arange(hi - lo), self.size[lo:hi])[order]
            node.at, node.doc = np.append(first, len(t)), doc
            node.part = contribution(self.items.weight[t], most, self.m[lo:hi][doc])
        node.limit(self.items)
        return node

    def search(self, item: int, best: list, k: int, least: int) -> None:
        """Puts documents into `best`, a sorted list of (-score, key) of at most k; none below `least` is needed."""
        want, stack = self.items.of_item[item], [self.root]
        while stack:
            node = stack.pop()
            bound = int(node.bound[item])
            if bound < max(least, 1) or len(best) == k and (-bound, node.low) >= best[-1]:
                continue
            if node.kids:
                stack += sorted(node.kids, key=lambda x: x.bound[item])
                continue
            i = np.searchsorted(node.terms, want)
            i = i[(i < len(node.terms)) & (node.terms[np.minimum(i, len(node.terms) - 1)] == want)]
            own = spread(node.at[i], node.at[i + 1] - node.at[i])
            score = np.zeros(node.hi - node.lo, np.int64)
            np.add.at(score, node.doc[own], node.part[own])
            floor = max(least, 1, -best[-1][0] if len(best) == k else 0)
            best += [(-int(score[d]), self.keys[node.lo + d]) for d in np.flatnonzero(score >= floor).tolist()]
            best.sort()
            del best[k:]


def vectors(docs: DataFrame, terms: list[bytes], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n (terms with repeats), term, tf of the rows that have a term at all; texts are cut piece by piece."""
    d = small_batches(only(docs, doc_id=doc_id, text=text))
    kind, arrow = typed(d, "doc_id")
    number = {w: k for k, w in enumerate(terms)}

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows, counts, term, tf, at = [], [], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [0]
            for r, t in enumerate(b.column("text")):
                n, found = 0, []
                for p in pieces(t.as_py().encode().translate(FOLD) if t.is_valid else b""):
                    w = p.split()
                    code = np.fromiter(map(number.get, w, [-1] * len(w)), np.int32, len(w))
                    found.append(np.unique(code[code >= 0], return_counts=True))
                    n += len(w)
                if not n:
                    continue
                k, c = found[0] if len(found) == 1 else (np.concatenate([x[i] for x in found]) for i in (0, 1))
                if len(found) > 1:
                    k, inverse = np.unique(k, return_inverse=True)
                    c = np.bincount(inverse, c, len(k))
                rows.append(r), counts.append(n), term.append(k.astype(np.int32)), tf.append(c.astype(np.int32)), at.append(at[-1] + len(k))
            at = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(rows, pa.int32())).cast(arrow), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(at, pa.array(np.concatenate(term))),
                                              pa.ListArray.from_arrays(at, pa.array(np.concatenate(tf)))], names=["doc_id", "n", "term", "tf"])

    return d.mapInArrow(run, f"doc_id {kind}, n bigint, term array<int>, tf array<int>")


def _best(vecs: DataFrame, items: Items, n_docs: int, all_terms: int, k: int, least: list[int]) -> DataFrame:
    """(item, doc_id, score): the best k of every item; item is its number in the block."""
    kind, arrow = typed(vecs, "doc_id")

    def run(batches):
        import pyarrow as pa

        best: list[list] = [[] for _ in items.ids]

        def search(held):
            n = np.concatenate([b.column("n").to_numpy(zero_copy_only=False) for b in held])
            size = np.concatenate([b.column("term").value_lengths().to_numpy(zero_copy_only=False) for b in held])
            keys = [(x is None, 0 if x is None else x) for b in held for x in b.column("doc_id").to_pylist()]
            flat = lambda c: np.concatenate([b.column(c).flatten().to_numpy(zero_copy_only=False) for b in held]).astype(np.int64)
            tree = Tree(items, keys, np.concatenate([[0], np.cumsum(size)]).astype(np.int64), flat("term"), flat("tf"), norms(n, n_docs, all_terms))
            for i in range(len(items.ids)):
                tree.search(i, best[i], k, least[i])

        held, size = [], 0
        for b in batches:
            held.append(b)
            size += len(b.column("term").flatten())
            if size >= POSTINGS:
                search(held)
                held, size = [], 0
        if size:
            search(held)
        out = [(i, None if null else x, -s) for i, own in enumerate(best) for s, (null, x) in own]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], arrow), pa.array([r[2] for r in out], pa.int64())], names=["item", "doc_id", "score"])

    found = vecs.mapInArrow(run, f"item int, doc_id {kind}, score bigint")
    # k rows of an item from each task; in two steps, so that no task gets all of them
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    found = found.withColumn("salt", F.spark_partition_id() % int(math.sqrt(parallelism(vecs.sparkSession)) + 1))
    found = found.withColumn("r", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).where(F.col("r") <= k)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order)).cast("int")).where(F.col("rank") <= k).select("item", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES, seed_docs: int = SEED_DOCS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents with a score above 0 of every row of items; equal scores by ascending doc_id.

    Null and empty texts have no terms: such documents are never found and don't count, such items find nothing.  Repeated documents are
    ranked one by one; a null doc_id comes last among equal scores.  Rows of items that repeat an id (or have none) are searched one by one and
    their results stand side by side.  doc_id is any type that Python orders.  An empty table on either side gives no rows.  Items are
    searched in blocks whose text is bounded by `block_bytes`, each with one pass over all documents; a block is what tasks are sent.
    """
    spark = docs.sparkSession
    q = only(items, item_id=item_id, text=item_text).where("octet_length(text) > 0")
    kind = q.schema["item_id"].dataType.simpleString()
    whole, largest = q.agg(F.sum(F.octet_length("text").cast("long")), F.max(F.octet_length("text"))).first()
    blocks = -(-2 * (whole or 0) // block_bytes)
    number = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(blocks, 1)))
    if blocks > 1:  # hashed blocks hold half of the bound on average
        q = written(q.withColumn("block", number), "items")
        over = q.groupBy("block").agg(F.sum(F.octet_length("text").cast("long")).alias("s")).agg(F.max("s")).first()[0]
        if over > block_bytes + largest:
            raise ValueError(f"a block of items holds {over} bytes; give a larger block_bytes")
    else:
        q = q.withColumn("block", F.lit(0))
    out = None
    for b in range(blocks):
        part = Items([(r["item_id"], r["text"]) for r in q.where(F.col("block") == b).collect()])
        vecs = written(vectors(docs, part.terms, doc_id, text), "vectors")
        n_docs, all_terms = vecs.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not n_docs or not part.terms:
            continue
        df = {r["t"]: r["n"] for r in vecs.select(F.explode("term").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per term of the block
        part.weigh(df, n_docs)
        least = [0] * len(part.ids)
        if n_docs > 2 * seed_docs:
            sample = vecs.where(F.pmod(F.xxhash64("doc_id", "n"), F.lit(n_docs // seed_docs)) == 0)
            for r in _best(sample, part, n_docs, all_terms, k, least).where(F.col("rank") == k).collect():
                least[r["item"]] = r["score"]
        names = spark.createDataFrame(list(enumerate(part.ids)), f"item int, item_id {kind}")
        r = written(_best(vecs, part, n_docs, all_terms, k, least), "found").join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = r if out is None else out.unionByName(r)
    if out is None:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id {only(docs, doc_id=doc_id).schema['doc_id'].dataType.simpleString()}, score bigint")
    return out
