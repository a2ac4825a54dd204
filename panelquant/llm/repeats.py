"""Texts in written blocks, and 64-bit keys that repeat between documents.

Documents are written once as compressed blocks of some megabytes; later passes read blocks by path, so texts are never shuffled.  Each
block sends its distinct keys, with the number of its documents that hold them, to key ranges; a range adds the numbers up and sends back
to each block those of its keys that at least two documents hold.  A key that very many documents share costs one entry per block.
"""
from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from panelquant.llm.common import fresh_path, only, parallelism, slices, small_batches, written
from panelquant.llm.files import get, put

BLOCK_BYTES = 4 << 20
_LOW = np.uint64((1 << 48) - 1)
MOST = 65535  # documents per key are counted up to here; more share the last rank


def write_blocks(docs: DataFrame, describe: Callable | None = None, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(path, docs) per block, the list written; docs holds doc_id, n and sig per document if `describe(texts) -> (ns, sigs)` is given."""
    d, out = small_batches(only(docs, doc_id=doc_id, text=text)), fresh_path(docs.sparkSession, "blocks")
    if "://" not in out:
        out = f"file://{out}"

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("idx", pa.int32()), ("n", pa.int64()), ("sig", pa.binary())]))
        for ids, texts in slices(batches, ["doc_id", "text"], block_bytes):
            path = f"{out}/{uuid.uuid4().hex}"
            sink = pa.BufferOutputStream()
            t = pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array([(x or "").encode() for x in texts], pa.large_binary())})
            with pa.ipc.new_file(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(t)
            put(path, [sink.getvalue()])
            about = [{"doc_id": i, "idx": k, "n": n, "sig": s} for k, (i, n, s) in enumerate(zip(ids, *describe([(x or "").encode() for x in texts])))] if describe else []
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([about], kind)], names=["path", "docs"])

    return written(d.mapInArrow(run, "path string, docs array<struct<doc_id:bigint,idx:int,n:bigint,sig:binary>>"), "blocklist")


def read_block(path: str) -> tuple[list, list[bytes]]:
    """Ids and texts of a block."""
    import pyarrow as pa

    t = pa.ipc.open_file(pa.py_buffer(get(path))).read_all()
    return t.column("doc_id").to_pylist(), t.column("text").to_pylist()


def ranges(keys: np.ndarray, count: int) -> np.ndarray:
    return ((keys >> np.uint64(48)) % np.uint64(count)).astype(np.int64)


def merged_counts(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sum of their counts."""
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    k, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return k, np.bincount(at, np.concatenate([p[1] for p in parts]), len(k)).astype(np.int64)


def pack(r: int, low: np.ndarray, n: np.ndarray) -> bytes:
    low = low & _LOW
    return b"".join([int(r).to_bytes(4, "little"), low.astype("<u4").tobytes(), (low >> np.uint64(32)).astype("<u2").tobytes(), np.minimum(n, MOST).astype("<u2").tobytes()])


def unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Keys as (range, low 48 bits), and counts."""
    n = (len(raw) - 4) // 8
    low = np.frombuffer(raw, "<u4", n, 4).astype(np.uint64) | np.frombuffer(raw, "<u2", n, 4 + 4 * n).astype(np.uint64) << np.uint64(32)
    return low | np.uint64(int.from_bytes(raw[:4], "little") << 48), np.frombuffer(raw, "<u2", n, 4 + 6 * n)


def short(keys: np.ndarray, count: int) -> np.ndarray:
    """Keys as the exchange names them: range and low 48 bits."""
    return keys & _LOW | ranges(keys, count).astype(np.uint64) << np.uint64(48)


def repeated_keys(tasks: DataFrame, keys_of: Callable[[dict], Iterator[tuple[np.ndarray, np.ndarray]]], count: int) -> DataFrame:
    """(path, payload) rows with the repeated keys of each block; keys_of(row) yields (keys, documents) of a block, keys distinct in each yield.

    Ranges and their memory follow from `count`, the number of partitions.
    """
    columns = tasks.columns

    def send(batches):
        import pyarrow as pa

        for b in batches:
            for row in b.to_pylist():
                keys, n = merged_counts(list(keys_of(row)))
                r = ranges(keys, count)
                order = np.argsort(r, kind="stable")
                cuts = np.searchsorted(r[order], np.arange(count + 1))
                out = [(k, pack(k, keys[order[i:j]], n[order[i:j]])) for k, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])) if j > i]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), pa.array([row["path"]] * len(out)), pa.array([p for _, p in out], pa.binary())], names=["r", "path", "payload"])

    def add(batches):
        import pyarrow as pa

        paths, rs, keys, ns = [], [], [], []
        for b in batches:
            for r, path, raw in zip(*[b.column(c).to_pylist() for c in ("r", "path", "payload")]):
                k, n = unpack(raw)
                paths.append(path), rs.append(r), keys.append(k), ns.append(n)
        if not paths:
            return
        at = np.cumsum([0, *map(len, keys)])
        k = np.concatenate(keys)
        del keys
        order = np.argsort(k, kind="stable")
        first = np.nonzero(np.concatenate([[True], k[order[1:]] != k[order[:-1]]]))[0]
        total = np.minimum(np.add.reduceat(np.concatenate(ns)[order], first, dtype=np.int64), MOST).astype(np.uint16)
        del ns
        n = np.empty(len(k), np.uint16)
        n[order] = np.repeat(total, np.diff(np.append(first, len(k))))
        for i, (path, r) in enumerate(zip(paths, rs)):
            own, many = k[at[i]:at[i + 1]], n[at[i]:at[i + 1]]
            if (many > 1).any():
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([pack(r, own[many > 1], many[many > 1])], pa.binary())], names=["path", "payload"])

    assert "path" in columns
    sent = tasks.repartition(4 * parallelism(tasks.sparkSession), "path").mapInArrow(send, "r int, path string, payload binary")
    return sent.repartitionById(count, F.col("r")).mapInArrow(add, "path string, payload binary")


def per_block(tasks: DataFrame, **rows: DataFrame) -> DataFrame:
    """tasks (path, ...) with one list per name: the rows (path, payload) of that name that belong to the block.  One shuffle, one row per block."""
    own = [c for c in tasks.columns if c != "path"]
    every = tasks.select("path", F.struct(*own).alias("own") if own else F.lit(True).alias("own"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("binary").alias("payload"))
    kind = every.schema["own"].dataType
    for name, df in rows.items():
        every = every.unionByName(df.select("path", F.lit(None).cast(kind).alias("own"), F.lit(name).alias("name"), "payload"))
    lists = [F.collect_list(F.when(F.col("name") == n, F.col("payload"))).alias(n) for n in rows]
    g = every.repartition(4 * parallelism(tasks.sparkSession), "path").groupBy("path").agg(F.max("own").alias("own") if not own else F.first("own", ignorenulls=True).alias("own"), *lists)
    return g.where("own is not null").select("path", *[F.col(f"own.{c}").alias(c) for c in own], *rows)


def known(payloads: list[bytes] | None) -> tuple[np.ndarray, np.ndarray]:
    """Repeated keys of a block in order, with their counts."""
    parts = [unpack(p) for p in payloads or []]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    k, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(k, kind="stable")
    return k[order], n[order]


def look_up(keys: np.ndarray, table: tuple[np.ndarray, np.ndarray], missing: int = 1) -> np.ndarray:
    """Count of each key in a sorted table."""
    k, n = table
    if not len(k):
        return np.full(len(keys), missing, np.int64)
    at = np.minimum(np.searchsorted(k, keys), len(k) - 1)
    return np.where(k[at] == keys, n[at], missing)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
