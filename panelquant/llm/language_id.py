"""Language identification by prediction by partial matching.

Each language has a byte context tree of variable order (contexts of 0 to 3 bytes) with symbol counts.  A byte is coded in the longest
context that the tree holds; an unseen byte costs an escape (escape method C: as many escape counts as different symbols) and is tried
one byte shorter, with the symbols of the longer context excluded, down to a uniform code.  Statistics are frozen after training, so the
cost of a byte in a context is a number, and a text's exact code length is a sum of look-ups.  The shortest code names the language.

Every byte and every context of the sample is kept, in sorted tables per language: a language's share of the model follows from its own
sample alone.  What a longer context has seen its shorter one has seen too, so the exclusion needs two numbers a context and no
(context, byte) table.  Look-ups are made once per different 4-byte string of a block of text, language by language.

Training reads a hash-chosen sample of at most about `per_language` labelled documents of each language; prediction reads every text whole.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from panelquant.llm.common import only, slices, small_batches, typed, written
from panelquant.llm.mixing import draw

ORDER = 3
PAD = b" " * ORDER  # the context before a text
#: Different bytes with a code of their own, and an optional bound on the contexts of the full order: None keeps all that the sample has.
SYMBOLS, CONTEXTS = 256, None
SMALL_LABELS = 200_000  # labels that may be sent to all tasks
PIECE = 1 << 18  # bytes of text scored at once


@dataclass
class Model:
    languages: list[str]
    symbol: np.ndarray  # byte -> symbol number; the last number stands for the bytes that no sampled text holds
    others: int  # bytes behind the last symbol
    ids: np.ndarray  # contexts of the full order, over all languages
    cuts: list  # per language and order: the grams' and the contexts' part of the flat arrays
    keys: np.ndarray  # grams (context and byte), sorted in each part
    logs: np.ndarray  # log2 of a gram's count
    contexts: np.ndarray  # contexts, sorted in each part
    rows: np.ndarray  # (contexts, 4) bits: denominator, escape, and both in the next shorter context without the symbols seen here

    def tables(self) -> list:
        """The tree of each language: (keys, logs, contexts, rows) of every order."""
        return [[(self.keys[g], self.logs[g], self.contexts[c], self.rows[c]) for g, c in orders] for orders in self.cuts]


def grams(data: bytes) -> np.ndarray:
    """32-bit numbers of every byte with the three before it; the first ORDER bytes of data are context only."""
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    return (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]


def count_grams(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", per_language: int = 2000) -> DataFrame:
    """(lang, gram, n) over the sample of labelled documents."""
    d = small_batches(only(docs, doc_id=doc_id, text=text, lang=lang)).where("text is not null and lang is not null")
    sizes = written(d.groupBy("lang").agg((F.lit(float(per_language)) / F.count("*")).alias("share")), "labels")
    few = sizes.count() <= SMALL_LABELS
    sample = d.join(F.broadcast(sizes) if few else sizes, "lang").where(draw(F.col("doc_id")) < F.col("share")).select("lang", "text")

    def tally(batches):
        import pyarrow as pa

        kept: dict[str, tuple] = {}
        for langs, texts in slices(batches, ["lang", "text"], 1 << 20):
            for g in set(langs):
                k, n = np.unique(np.concatenate([grams(PAD + t.encode()) for l, t in zip(langs, texts) if l == g]), return_counts=True)
                if g in kept:
                    k, at = np.unique(np.concatenate([kept[g][0], k]), return_inverse=True)
                    n = np.bincount(at, np.concatenate([kept[g][1], n])).astype(np.int64)
                kept[g] = k, n
        for g, (k, n) in kept.items():
            yield pa.RecordBatch.from_arrays([pa.array([g] * len(k), pa.string()), pa.array(k.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    return sample.mapInArrow(tally, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def build(languages: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray) -> Model:
    """Trees of all languages; (lang number, gram, n) are the counts."""
    byte_n = np.bincount(gram & 255, n, 256)
    own = np.flatnonzero(byte_n > 0)
    symbol = np.full(256, len(own), np.int16)
    symbol[own] = np.arange(len(own))
    ids, at = np.unique(gram >> 8, return_inverse=True)
    if CONTEXTS is not None and len(ids) > CONTEXTS:
        ids = np.sort(ids[np.argsort(-np.bincount(at, n), kind="stable")[:CONTEXTS]])
    order = np.argsort(lang, kind="stable")
    ends = np.searchsorted(lang[order], np.arange(len(languages) + 1))
    parts: tuple = ([], [], [], [])
    cuts, grams_at, contexts_at = [], 0, 0
    for g in range(len(languages)):
        mine = order[ends[g]:ends[g + 1]]
        cuts.append([])
        for part in tree(gram[mine], n[mine], int(symbol.max()) + 1, None if CONTEXTS is None else ids):
            cuts[-1].append((slice(grams_at, grams_at := grams_at + len(part[0])), slice(contexts_at, contexts_at := contexts_at + len(part[2]))))
            for all_, one in zip(parts, part):
                all_.append(one)
    return Model(languages, symbol, 256 - len(own), ids, cuts, *[np.concatenate(x) for x in parts])


def tree(gram: np.ndarray, n: np.ndarray, symbols: int, kept: np.ndarray | None) -> list[tuple]:
    """(keys, logs, contexts, rows) of the orders 0 to ORDER of one language."""
    out: list[tuple] = []
    for k in range(ORDER + 1):
        use = slice(None) if k < ORDER or kept is None else np.isin(gram >> 8, kept)
        keys, at = np.unique(gram[use] & ((1 << 8 * k + 8) - 1), return_inverse=True)
        m = np.bincount(at, n[use], len(keys))
        contexts, of = np.unique(keys >> 8, return_inverse=True)
        total, q = np.bincount(of, m, len(contexts)), np.bincount(of, minlength=len(contexts))
        if k:  # what is left of the shorter context
            up = np.searchsorted(last_keys, keys & ((1 << 8 * k) - 1))
            above = np.searchsorted(last_contexts, contexts & ((1 << 8 * k - 8) - 1))
            left, left_q = last_total[above] - np.bincount(of, last_m[up], len(contexts)), last_q[above] - q
        else:  # uniform below order 0
            left, left_q = symbols - q, np.zeros(len(q), np.int64)
        lower = np.log2(np.maximum(left + left_q, 1))
        rows = np.stack([np.log2(total + q), np.log2(total + q) - np.log2(q), lower, np.where(left_q > 0, lower - np.log2(np.maximum(left_q, 1)), 0)], 1)
        out.append((keys.astype(np.uint32), np.log2(m).astype(np.float32), contexts.astype(np.uint32), rows.astype(np.float32)))
        last_keys, last_m, last_contexts, last_total, last_q = keys, m, contexts, total, q
    return out


def find(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the wanted numbers in a sorted table, and whether they are there."""
    if not len(table):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
    return at, table[at] == wanted


def gram_bits(orders: list[tuple], gram: np.ndarray) -> np.ndarray:
    """Bits of the last byte of each gram after the three before it, in one language's tree."""
    bits = np.zeros(len(gram))
    left = np.arange(len(gram))  # not coded yet
    inside = np.zeros(len(gram), bool)  # escaped from a longer context
    lower = escape = np.zeros(len(gram))
    for k in range(ORDER, -1, -1):
        keys, logs, contexts, rows = orders[k]
        g = gram[left] & np.uint32((1 << 8 * k + 8) - 1)
        at, seen = find(contexts, g >> np.uint32(8))
        row = rows[at] if len(rows) else np.zeros((len(g), 4), np.float32)
        at, hit = find(keys, g)
        miss = np.where(inside, escape, np.where(seen, row[:, 1], 0))
        bits[left] += miss
        bits[left[hit]] += np.where(inside, lower, row[:, 0])[hit] - logs[at[hit]] - miss[hit]
        rest = ~hit
        left, inside, lower, escape = left[rest], (inside | seen)[rest], row[rest, 2], row[rest, 3]
    bits[left] += lower
    return bits


def train(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", per_language: int = 2000) -> Model | None:
    """Model of all languages in docs; None without a labelled text.  Its size is bounded by the sample."""
    t = count_grams(docs, text, lang, doc_id, per_language).toArrow()
    if not t.num_rows:
        return None
    names = sorted(set(t.column("lang").unique().to_pylist()))
    number = {x: k for k, x in enumerate(names)}
    enc = t.column("lang").combine_chunks().dictionary_encode()
    codes = np.array([number[x] for x in enc.dictionary.to_pylist()])[enc.indices.to_numpy()]
    return build(names, codes, t.column("gram").to_numpy().astype(np.int64), t.column("n").to_numpy().astype(np.float64))


def has_letter(raw: bytes) -> bool:
    return raw.upper() != raw.lower() or any(c.isalpha() for c in raw.decode())


def code_lengths(model: Model, tables: list, texts: list[bytes]) -> np.ndarray:
    """(texts, languages) bits of whole texts."""
    out = np.zeros((len(texts), len(model.languages)))
    data = PAD + PAD.join(texts)
    n = np.full(max(2 * len(texts) - 1, 0), ORDER)  # texts and the spaces between them
    n[::2] = [len(t) for t in texts]
    owner = np.full(len(n), len(texts))
    owner[::2] = np.arange(len(texts))
    owner = np.repeat(owner, n)
    unknown = np.where(model.symbol == 256 - model.others, np.log2(max(model.others, 1)), 0.0)
    for start in range(0, len(owner), PIECE):
        gram, at = np.unique(grams(data[start:start + PIECE + ORDER]), return_inverse=True)
        mine, more = owner[start:start + PIECE], unknown[gram & np.uint32(255)]
        for k, orders in enumerate(tables):
            out[:, k] += np.bincount(mine, (gram_bits(orders, gram) + more)[at], len(texts) + 1)[:-1]
    return out


def _loaded(shared) -> tuple:
    """The model and its tables; loaded per task and not kept, so that the workers of later stages do not hold them."""
    m = shared.value
    return m, m.tables() if m else None


def decide(model: Model | None, tables, texts: list) -> tuple[list, list, list]:
    """Language, score (posterior of the best under equal priors) and bits a byte of each text."""
    raw = [(t or "").encode() for t in texts]
    use = [i for i, r in enumerate(raw) if model and r and has_letter(r)]
    lang, score, rate = ["und"] * len(raw), [0.0] * len(raw), [None] * len(raw)
    if use:
        bits = code_lengths(model, tables, [raw[i] for i in use])
        best = bits.argmin(1)
        low = bits.min(1)
        p = 1 / np.exp2(-np.minimum(bits - low[:, None], 1000)).sum(1)
        for i, b, q, l in zip(use, best, p, low):
            lang[i], score[i], rate[i] = model.languages[b], float(q), float(l / len(raw[i]))
    return lang, score, rate


def predict(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, bits_per_byte for every row of docs; only the text is looked at.

    Null texts and texts without letters are `und` with score 0 and no bits; so is every text without a model.  Ties go to the language
    first in alphabetical order.
    """
    d = small_batches(only(docs, doc_id=doc_id, text=text))
    shared = d.sparkSession.sparkContext.broadcast(model)
    kind, arrow = typed(d, "doc_id")

    def run(batches):
        import pyarrow as pa

        m, tables = _loaded(shared)
        for ids, texts in slices(batches, ["doc_id", "text"], PIECE):
            lang, score, rate = decide(m, tables, texts)
            yield pa.RecordBatch.from_arrays([pa.array(ids, arrow), pa.array(lang), pa.array(score, pa.float64()), pa.array(rate, pa.float64())], names=["doc_id", "lang_pred", "score", "bits_per_byte"])

    return d.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, bits_per_byte double")


def accepted(docs: DataFrame, model: Model | None, least: float = 0.5, text: str = "text") -> DataFrame:
    """Rows of docs whose language is told with at least that score; all columns stay as they are."""
    shared = small_batches(docs).sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        m, tables = _loaded(shared)
        for b in batches:
            keep: list[bool] = []
            for (texts,) in slices([b], [text], PIECE, text):
                lang, score, _ = decide(m, tables, texts)
                keep += [l != "und" and s >= least for l, s in zip(lang, score)]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def in_training(doc_id: Column) -> Column:
    """The fold that may be learnt from: crc32 of the id as text, modulo 4, is not 2; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2, F.lit(False))
