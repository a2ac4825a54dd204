"""Token ids in wavelet-matrix shards.

A shard file holds the ids of consecutive documents as one bit-plane per id bit, most significant first, each plane stably split into
zeros and ones for the next; ones are counted up every 512 bits.  From the one file, `Shard` answers token access, counts in a range
(rank) and the place of the k-th occurrence (select), and decodes documents.

Documents are tokenised where they are read, and their ids dealt to ranges of doc_id and sorted there; each range is written as files of
about `FILE_TOKENS` ids.
"""
from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from panelquant.llm.common import fresh_path, only, parallelism, slices, small_batches, typed, written
from panelquant.llm.files import get, put

MAGIC, STEP = b"WVLT0001", 512
FILE_TOKENS = 4 << 20
#: Words, in all their forms, whose ids a worker remembers.
REMEMBERED = 1_800_000


class Shard:
    """A wavelet matrix over one sequence of token ids, with its documents."""

    def __init__(self, n: int, bits: int, planes: list[np.ndarray], zeros: list[int], ones: list[np.ndarray], doc_ids: list, starts: np.ndarray):
        self.n, self.bits, self.planes, self.zeros, self.ones, self.doc_ids, self.starts = n, bits, planes, zeros, ones, doc_ids, starts

    @classmethod
    def build(cls, ids: np.ndarray, doc_ids: list, starts) -> "Shard":
        bits = max(int(ids.max()).bit_length(), 1) if len(ids) else 1
        cur = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        planes, zeros, ones = [], [], []
        for b in range(bits - 1, -1, -1):
            bit = (cur & cur.dtype.type(1 << b)) != 0
            packed = np.packbits(bit, bitorder="little")
            packed = np.concatenate([packed, np.zeros(-len(packed) % (STEP // 8), np.uint8)])
            planes.append(packed)
            per = np.bitwise_count(packed.view(np.uint64)).reshape(-1, STEP // 64).sum(1) if len(packed) else np.zeros(0, np.int64)
            ones.append(np.concatenate([[0], np.cumsum(per)]).astype(np.uint32))
            low, new = np.flatnonzero(~bit), np.empty_like(cur)
            zeros.append(len(low))
            np.take(cur, low, out=new[:len(low)])
            np.take(cur, np.flatnonzero(bit), out=new[len(low):])
            cur = new
        return cls(len(ids), bits, planes, zeros, ones, list(doc_ids), np.asarray(starts, np.int64))

    def parts(self) -> Iterator[bytes]:
        """The file: magic, header length, JSON header, then document starts, counts and planes."""
        head = json.dumps({"n": self.n, "bits": self.bits, "zeros": self.zeros, "docs": self.doc_ids}).encode()
        yield MAGIC + len(head).to_bytes(8, "little") + head
        yield self.starts.astype("<i8").tobytes()
        for o, p in zip(self.ones, self.planes):
            yield o.astype("<u4").tobytes()
            yield p.tobytes()

    @classmethod
    def parse(cls, raw: bytes) -> "Shard":
        if raw[:8] != MAGIC:
            raise ValueError("not a token shard")
        at = 16 + int.from_bytes(raw[8:16], "little")
        h = json.loads(raw[16:at])
        take = lambda kind, n: np.frombuffer(raw, kind, n, at)
        starts = take("<i8", len(h["docs"]) + 1)
        at += starts.nbytes
        blocks = -(-h["n"] // STEP)
        planes, ones = [], []
        for _ in range(h["bits"]):
            ones.append(take("<u4", blocks + 1))
            at += 4 * (blocks + 1)
            planes.append(take(np.uint8, blocks * STEP // 8))
            at += blocks * STEP // 8
        return cls(h["n"], h["bits"], planes, h["zeros"], ones, h["docs"], starts)

    def _rank1(self, level: int, i: int) -> int:
        """Ones before i in a plane."""
        b, r = divmod(i, STEP)
        own = self.planes[level][b * STEP // 8:b * STEP // 8 + -(-r // 8)]
        n = int(np.bitwise_count(own).sum())
        if r % 8:
            n -= (int(own[-1]) >> r % 8).bit_count()
        return int(self.ones[level][b]) + n

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3]) >> (i & 7) & 1

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        v = 0
        for k in range(self.bits):
            bit, ones = self._bit(k, i), self._rank1(k, i)
            v = v << 1 | bit
            i = self.zeros[k] + ones if bit else i - ones
        return v

    def _range(self, token: int, i: int, j: int) -> tuple[int, int]:
        for k in range(self.bits):
            a, b = self._rank1(k, i), self._rank1(k, j)
            i, j = (self.zeros[k] + a, self.zeros[k] + b) if token >> (self.bits - 1 - k) & 1 else (i - a, j - b)
        return i, j

    def count(self, token: int, i: int = 0, j: int | None = None) -> int:
        """Occurrences of a token in positions [i, j)."""
        if token < 0 or token.bit_length() > self.bits:
            return 0
        a, b = self._range(token, max(i, 0), self.n if j is None else min(j, self.n))
        return max(b - a, 0)

    def select(self, token: int, k: int) -> int:
        """Position of the k-th occurrence (from 0) of a token."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        i = self._range(token, 0, self.n)[0] + k
        for level in range(self.bits - 1, -1, -1):
            one = token >> (self.bits - 1 - level) & 1
            rank = i - self.zeros[level] if one else i
            low, high = 0, self.n  # the position of the rank-th bit of this kind
            while high - low > 1:
                mid = (low + high) // 2
                r = self._rank1(level, mid)
                low, high = (mid, high) if (r if one else mid - r) <= rank else (low, mid)
            i = low
        return i

    def decode(self) -> np.ndarray:
        """All ids, by undoing the splits from the last plane up."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        cur = np.zeros(self.n, kind)
        for b in range(self.bits):
            k = self.bits - 1 - b
            bit = np.unpackbits(self.planes[k], count=self.n, bitorder="little").view(bool)
            up = np.empty(self.n, kind)
            up[np.flatnonzero(~bit)] = cur[:self.zeros[k]]
            up[np.flatnonzero(bit)] = cur[self.zeros[k]:] | kind(1 << b)
            cur = up
        return cur


#: The normaliser and pre-tokeniser under which a text's ids are those of its words.
WORDWISE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}
#: A run of letters whose lower case is one letter each, and closing marks; an apostrophe would cut otherwise.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


def visible_bytes() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for letters from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {**{b: chr(b) for b in shown}, **{b: chr(256 + k) for k, b in enumerate(hidden)}}


class Words:
    """Ids of texts through the library, each word encoded once while remembered.

    With the normaliser and pre-tokeniser of `WORDWISE`, which drop white space and never join what it separates, a text's ids are those of its
    words in turn; letters are lowered and cut from closing marks, so such forms share the ids of the plain word, which the model encodes
    directly.  Any other tokeniser encodes whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            own = json.load(f)
        t = Tokenizer.from_file(path)
        self.wordwise = all(own.get(k) == v for k, v in WORDWISE.items()) and own["model"]["type"] == "BPE" and all(x["content"].startswith("<|") for x in own["added_tokens"])
        self.encode, self.model, self.visible = getattr(t, "encode_batch_fast", t.encode_batch), t.model, visible_bytes()
        self.code = "H" if t.get_vocab_size() <= 1 << 16 else "I"  # two bytes an id if all ids allow
        self.kind = np.dtype("<u2" if self.code == "H" else "<u4")
        self.known: dict[str, bytes] = {}

    @staticmethod
    def parts(w: str) -> tuple[str, str] | None:
        """The plain word and its closing marks, or None for any other form."""
        m = PLAIN.fullmatch(w)
        return (m[1].lower(), m[2]) if m else None

    def whole(self, texts: list[str]) -> Iterator[bytes]:
        for k in range(0, len(texts), 10_000):
            yield from (array(self.code, e.ids).tobytes() for e in self.encode(texts[k:k + 10_000], add_special_tokens=False))

    def ids(self, texts: list[str | None], end: int) -> list[bytes]:
        tail = array(self.code, [end]).tobytes()
        if not self.wordwise:
            return [x + tail for x in self.whole([t or "" for t in texts])]
        words = [(t or "").replace("\n", " ").split(" ") for t in texts]
        known, found = self.known, {}
        new = {w: self.parts(w) for w in {w for w in chain.from_iterable(words) if w not in known}}
        pieces = {x for p in new.values() if p for x in p}.difference(known)
        other = [*(w for w, p in new.items() if p is None), *(x for x in pieces if x and not x[0].isalpha())]
        found.update(zip(other, self.whole(other)))
        model, visible, code = self.model.tokenize, self.visible, self.code
        for x in pieces:
            if x and x[0].isalpha():
                found[x] = array(code, [y.id for y in model(x if x.isascii() else x.encode().decode("latin1").translate(visible))]).tobytes()
        at = lambda x: found[x] if x in found else known[x]
        for w, p in new.items():
            if p:
                found[w] = at(p[0]) + at(p[1]) if p[1] else at(p[0])
        if len(known) < REMEMBERED:
            known.update(found)
            at = known.__getitem__
        return [b"".join(map(at, ws)) + tail for ws in words]


_words: dict[str, Words] = {}


def tokenize(docs: DataFrame, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (little-endian, two bytes each if the vocabulary allows, else four), wide (boolean), n_tokens; null text has the end id only."""
    d = small_batches(only(docs, doc_id=doc_id, text=text))
    kind, arrow = typed(d, "doc_id")

    def run(batches):
        import pyarrow as pa

        w = _words.get(tokenizer) or _words.setdefault(tokenizer, Words(tokenizer))
        for ids, texts in slices(batches, ["doc_id", "text"], 1 << 20):
            raw, size = w.ids(texts, end_id), w.kind.itemsize
            yield pa.RecordBatch.from_arrays([pa.array(ids, arrow), pa.array(raw, pa.binary()), pa.array([size == 4] * len(raw)), pa.array([len(x) // size for x in raw], pa.int64())],
                                             names=["doc_id", "ids", "wide", "n_tokens"])

    return d.mapInArrow(run, f"doc_id {kind}, ids binary, wide boolean, n_tokens bigint")


def write(docs: DataFrame, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text", file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Writes shards in ascending order of the (integer) doc_id; (path, bucket, seq, n_docs, n_tokens, start) per file, the list written.

    Null ids come first; rows with the same id stand in order of their ids' bytes.  An empty table has no file.
    """
    spark, out, n = docs.sparkSession, fresh_path(docs.sparkSession, "tokens"), parallelism(docs.sparkSession)
    if "://" not in out:
        out = f"file://{out}"
    cuts = docs.select(F.percentile_approx(docs[f"`{doc_id}`"], [k / n for k in range(1, n)] or [0.5], 100 * n)).first()[0] or []
    cuts = sorted(set(cuts))
    d = tokenize(docs, tokenizer, end_id, doc_id, text)
    # the number of cuts below an id, found by halving
    def below(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col("doc_id") >= cuts[mid], below(mid + 1, hi)).otherwise(below(lo, mid))
    dealt = d.withColumn("bucket", below(0, len(cuts)).cast("int")).repartitionById(len(cuts) + 1, F.col("bucket")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")

    def run(batches):
        import pyarrow as pa

        seq, held, size, bucket = 0, [], 0, None

        def flush():
            ids = np.concatenate([np.frombuffer(x, "<u4" if wide else "<u2") for _, x, wide in held])
            starts = np.concatenate([[0], np.cumsum([len(x) // (4 if wide else 2) for _, x, wide in held])])
            path = f"{out}/{bucket:06d}-{seq:04d}.wvlt"
            put(path, Shard.build(ids, [i for i, _, _ in held], starts).parts())
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([bucket], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(held)], pa.int64()), pa.array([len(ids)], pa.int64())],
                                              names=["path", "bucket", "seq", "n_docs", "n_tokens"])

        for b in batches:
            for i, x, wide, k, t in zip(*[b.column(c).to_pylist() for c in ("doc_id", "ids", "wide", "bucket", "n_tokens")]):
                bucket = k
                if held and size + t > file_tokens:
                    yield flush()
                    seq, held, size = seq + 1, [], 0
                held.append((i, x, wide))
                size += t
        if held:
            yield flush()

    files = written(dealt.mapInArrow(run, "path string, bucket int, seq int, n_docs bigint, n_tokens bigint"), "shardlist")
    # offsets in two steps: of the buckets, whose number is bounded by the partitions, and inside each bucket
    per = files.groupBy("bucket").agg(F.sum("n_tokens").alias("all"))
    before = per.select("bucket", (F.sum("all").over(Window.orderBy("bucket")) - F.col("all")).alias("base"))
    inside = F.sum("n_tokens").over(Window.partitionBy("bucket").orderBy("seq")) - F.col("n_tokens")
    return written(files.withColumn("inside", inside).join(before, "bucket").select("path", "bucket", "seq", "n_docs", "n_tokens", (F.col("base") + F.col("inside")).alias("start")), "shardlist")


def read(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of the shards, all ids decoded from the planes."""
    def run(batches):
        import pyarrow as pa

        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist()):
                s = Shard.parse(get(path))
                ids = memoryview(np.ascontiguousarray(s.decode(), "<u4")).cast("B")
                at = s.starts
                crc = [zlib.crc32(ids[4 * i:4 * j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(s.doc_ids, pa.int64()), pa.array(at[:-1] + start), pa.array(np.diff(at)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = 4 * parallelism(files.sparkSession)
    return files.repartition(n, "path").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
