"""Benchmark decontamination: one Aho-Corasick automaton over the word windows of normalised questions and answers.

Texts are folded byte by byte (A-Z to a-z, everything but 0-9, a-z and non-ASCII bytes to a space), so byte offsets never move and hits map
back to the original text.  The automaton works on word numbers, one node per window word; a document is scanned once.  Benchmarks
beyond `AUTOMATON_BYTES` are split by item into several automata that scan in turn and add up their hits.
"""
from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from panelquant.llm.common import only, slices, small_batches, typed

#: Text bytes of a benchmark per automaton: about 300,000 windows, 3 million nodes.
AUTOMATON_BYTES = 2 << 20
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


class Matcher:
    """Word windows of items and their automaton."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        import ahocorasick

        self.number: dict[bytes, int] = {}
        owners: dict[tuple, set] = {}
        for item, text in items:
            w = [self.number.setdefault(x, len(self.number) + 1) for x in words_of(text)]
            for i in range(max(len(w) - window, 0) + 1 if w else 0):
                owners.setdefault(tuple(w[i:i + window]), set()).add(item)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for k, own in owners.items():
            self.automaton.add_word(k, (len(k), own))
        self.filled = bool(owners)
        if self.filled:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged runs [first, last) of hit words, and the items hit."""
        runs, items = [], set()
        if not self.filled or not words:
            return runs, items
        get = self.number.get
        for end, (n, own) in self.automaton.iter(tuple([get(w, 0) for w in words])):
            items |= own
            runs.append((end + 1 - n, end + 1))
        return merge(runs), items


def merge(runs: list) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(map(tuple, runs)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def spans_of(text: str, runs: list[tuple[int, int]]) -> list[dict]:
    """Character offsets in the original text of runs of words."""
    raw = text.encode()
    at = [m.span() for m in _WORD.finditer(raw.translate(FOLD))]
    chars = lambda i: len(raw[:i].decode())
    return [{"start": chars(at[a][0]), "end": chars(at[b - 1][1])} for a, b in runs]


_cache: dict = {}


def _matcher(shared, name: str, window: int) -> Matcher:
    """The automaton of a broadcast part, built once per worker; name tells parts apart."""
    if name not in _cache:
        _cache.clear()
        _cache[name] = Matcher(shared.value, window)
    return _cache[name]


def chunks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[str, str]]]:
    """Items in lists of about AUTOMATON_BYTES, each collected by itself."""
    b = only(benchmark, item_id=item_id, text=text).where("text is not null").select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    n = -(-(b.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // AUTOMATON_BYTES) or 1
    for k in range(n):
        yield [tuple(r) for r in (b if n == 1 else b.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k)).collect()]


def scan(docs: DataFrame, benchmark: DataFrame, window: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted array of ids as strings), spans (start, end in characters of the original) per row of docs.

    Null and empty texts have no words; an item of fewer than `window` words is one window, one without words none.  Repeated rows give
    repeated results; items with a null id share the empty id.  Empty tables give no rows, an empty benchmark no hits.
    """
    d = small_batches(only(docs, doc_id=doc_id, text=text))
    kind, arrow = typed(d, "doc_id")
    fields = f"doc_id {kind}, text string, runs array<bigint>, items array<string>"
    d = d.select("doc_id", "text", F.array().cast("array<bigint>").alias("runs"), F.array().cast("array<string>").alias("items"))
    import pyarrow as pa

    parts = list(chunks(benchmark, item_id, item_text))
    for part in parts:
        shared = d.sparkSession.sparkContext.broadcast(part)

        def step(batches, shared=shared, name=uuid.uuid4().hex):
            m = _matcher(shared, name, window)
            for ids, texts, runs, items in slices(batches, ["doc_id", "text", "runs", "items"]):
                new_runs, new_items = [], []
                for t, r, i in zip(texts, runs, items):
                    found, own = m.scan(words_of(t))
                    new_runs.append([x for p in (merge([*zip(r[::2], r[1::2]), *found]) if r else found) for x in p])
                    new_items.append(sorted(own | set(i)) if i else sorted(own))
                yield pa.RecordBatch.from_arrays([pa.array(ids, arrow), pa.array(texts, pa.string()), pa.array(new_runs, pa.list_(pa.int64())), pa.array(new_items, pa.list_(pa.string()))],
                                                 names=["doc_id", "text", "runs", "items"])

        d = d.mapInArrow(step, fields)

    def finish(batches):
        for ids, texts, runs, items in slices(batches, ["doc_id", "text", "runs", "items"]):
            pairs = [list(zip(r[::2], r[1::2])) for r in runs]
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, arrow), pa.array([len(words_of(t)) for t in texts], pa.int64()), pa.array([sum(b - a for a, b in p) for p in pairs], pa.int64()), pa.array(items, pa.list_(pa.string())),
                pa.array([spans_of(t, p) if p else [] for t, p in zip(texts, pairs)], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["doc_id", "n_words", "n_hit", "items", "spans"])

    return d.mapInArrow(finish, f"doc_id {kind}, n_words bigint, n_hit bigint, items array<string>, spans array<struct<start:bigint,end:bigint>>")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Rows of docs that hold no window of any item; all columns stay as they are."""
    import pyarrow as pa

    for part in chunks(benchmark, item_id, item_text):
        shared = small_batches(docs).sparkSession.sparkContext.broadcast(part)

        def step(batches, shared=shared, name=uuid.uuid4().hex):
            m = _matcher(shared, name, window)
            for b in batches:
                yield b.filter(pa.array([not m.scan(words_of(t.as_py()))[0] for t in b.column(text)], pa.bool_()))

        docs = docs.mapInArrow(step, docs.schema)
    return docs
