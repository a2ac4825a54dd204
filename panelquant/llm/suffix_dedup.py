"""Repeated passages across documents, by a distributed merge sort of suffixes that uses common prefixes.

Every string of LENGTH bytes has one anchor: the place of its smallest K-byte hash.  Equal strings have equal anchors, so it is enough to
sort suffixes at anchors, together with the bytes in front of them.

1. Blocks of documents exchange anchor keys; anchors whose key only one document holds drop out.
2. Each block forms its distinct suffixes (at most LENGTH bytes behind an anchor, and the context before it) with the smallest doc_id that
   holds them, sorts them and sends them as front-coded runs, dealt by anchor key.
3. A receiver merges its runs with a loser tree that carries common-prefix lengths: characters known to be equal are never compared again.
   The lengths that come out of the merge cut the sorted order into groups of equal strings; the smallest doc_id of a group owns its string.
4. Owners go back to the blocks, which remove every byte covered by a string that a smaller doc_id owns.

A passage that a third of the documents share is one suffix per block and anchor, whatever the number of documents.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from panelquant.llm.common import parallelism, written
from panelquant.llm.repeats import known, look_up, mix, per_block, ranges, read_block, repeated_keys, short, write_blocks

LENGTH, K = 50, 20
BEFORE = LENGTH - K  # most bytes in front of an anchor
WINDOW = BEFORE + 1
PIECE = 1 << 19  # window starts handled at once
NOBODY = np.iinfo(np.int64).max  # stands for a null doc_id: larger than any


class Block:
    """Bytes of a block's documents in a row, and its runs of windows with the same anchor."""

    def __init__(self, path: str):
        self.ids, texts = read_block(path)
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.sizes)])
        self.data = b"".join(texts)
        self.order = np.array([NOBODY if i is None else i for i in self.ids], np.int64)

    def runs(self) -> Iterator[tuple[np.ndarray, ...]]:
        """(key, anchor, first window, last window, document) of a piece, as arrays."""
        raw = np.frombuffer(self.data + bytes(LENGTH + 8), np.uint8)
        n = len(self.data)
        edge = np.zeros(n + 1, np.int32)
        fit = self.sizes >= LENGTH
        np.add.at(edge, self.at[:-1][fit], 1)
        np.add.at(edge, self.at[:-1][fit] + self.sizes[fit] - LENGTH + 1, -1)
        valid = np.cumsum(edge[:-1], dtype=np.int32) > 0
        for a in range(0, n, PIECE):
            ok = valid[a:a + PIECE]
            if not ok.any():
                continue
            key = hashes(raw[a:a + len(ok) + LENGTH + 8], len(ok) + BEFORE)
            # the smallest hash of a window, the leftmost of equals: rank in the high bits, place in the low ones
            m = key & np.uint64(~((1 << 20) - 1) & (1 << 64) - 1) | np.arange(len(key), dtype=np.uint64)
            for step in (1, 2, 4, 8):
                m = np.minimum(m[:-step], m[step:])
            m = np.minimum(m[:len(ok)], m[WINDOW - 16:WINDOW - 16 + len(ok)])
            anchor = (m & np.uint64((1 << 20) - 1)).astype(np.int64)
            new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | ~ok[:-1]]) & ok
            first = np.nonzero(new)[0]
            stop = np.concatenate([[True], ~ok[1:] | new[1:]])  # the window before a change ends its run
            last = np.nonzero(np.concatenate([stop[1:], [True]]) & ok)[0]
            p = anchor[first]
            yield key[p], p + a, first + a, last + a, np.searchsorted(self.at, p + a, side="right") - 1


def hashes(raw: np.ndarray, n: int) -> np.ndarray:
    """Hash of the K bytes from each of the first n places; raw has room behind."""
    word = lambda o: np.ndarray((n,), "<u8", raw, o, (1,)).astype(np.uint64)
    x = word(0) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
    x = mix(x ^ word(8)) * np.uint64(0xD6E8FEB86659FD93)
    return mix(x ^ (word(16) & np.uint64(0xFFFFFFFF)))


def block_keys(row: dict) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct anchor keys of a block and the number of documents that hold them."""
    parts = [(k, d) for k, _, _, _, d in Block(row["path"]).runs()]
    if parts:
        k, d = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.lexsort((d, k))
        k, d = k[order], d[order]
        once = np.concatenate([[True], (k[1:] != k[:-1]) | (d[1:] != d[:-1])])
        yield np.unique(k[once], return_counts=True)


class Suffixes:
    """Distinct suffixes of a block at repeated anchors, in the order of (range, bytes)."""

    def __init__(self, block: Block, payloads: list[bytes] | None, count: int):
        table = known(payloads)
        parts = []
        for key, p, first, last, doc in block.runs():
            hot = look_up(short(key, count), table) > 1
            parts.append((ranges(key[hot], count), p[hot], first[hot], last[hot], doc[hot]))
        self.r, self.p, first, last, self.doc = (np.concatenate(x) if parts else np.zeros(0, np.int64) for x in (zip(*parts) if parts else [()] * 5))
        m = len(self.p)
        raw = np.frombuffer(bytes(BEFORE) + block.data + bytes(LENGTH), np.uint8)
        before, behind = self.p - first, last + LENGTH - self.p
        rows = np.zeros((m, LENGTH + BEFORE + 4), np.uint8)
        for i in range(0, m, 1 << 16):
            s = slice(i, i + (1 << 16))
            c = np.arange(LENGTH)
            rows[s, 2:2 + LENGTH] = np.where(c < behind[s, None], raw[self.p[s, None] + BEFORE + c], 0)
            c = np.arange(1, BEFORE + 1)  # the byte before the anchor comes first
            rows[s, 3 + LENGTH:-1] = np.where(c <= before[s, None], raw[self.p[s, None] + BEFORE - c], 0)
        rows[:, 0], rows[:, 1] = self.r >> 8, self.r & 255
        rows[:, 2 + LENGTH], rows[:, -1] = behind, before + 1
        flat, self.entry = np.unique(np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel(), return_inverse=True)
        self.rows = np.frombuffer(flat.tobytes(), np.uint8).reshape(-1, rows.shape[1])
        self.owner = np.full(len(flat), NOBODY, np.int64)
        np.minimum.at(self.owner, self.entry, block.order[self.doc])
        self.range = self.rows[:, 0].astype(np.int64) << 8 | self.rows[:, 1]
        self.suffix, self.behind = self.rows[:, 2:2 + LENGTH], self.rows[:, 2 + LENGTH]
        self.context, self.before = self.rows[:, 3 + LENGTH:-1], self.rows[:, -1].astype(np.int64) - 1


def common(a: np.ndarray) -> np.ndarray:
    """Common-prefix length of each row with the row before; 0 for the first."""
    out = np.zeros(len(a), np.uint8)
    if len(a) > 1:
        differ = a[1:] != a[:-1]
        out[1:] = np.where(differ.any(1), differ.argmax(1), a.shape[1])
    return out


def front_coded(s: Suffixes, i: int, j: int) -> bytes:
    """Rows [i, j) as a run: prefix lengths, then only the bytes behind the common prefix."""
    x = s.suffix[i:j]
    lcp = common(x)
    c = np.arange(LENGTH)
    tail = x[(c >= lcp[:, None]) & (c < s.behind[i:j, None])]
    left = s.context[i:j][np.arange(BEFORE) < s.before[i:j, None]]
    return b"".join([(j - i).to_bytes(4, "little"), lcp.tobytes(), s.behind[i:j].tobytes(), s.before[i:j].astype(np.uint8).tobytes(), s.owner[i:j].astype("<i8").tobytes(), tail.tobytes(), left.tobytes()])


def decoded(raw: bytes) -> tuple[np.ndarray, ...]:
    """A run as arrays: prefix lengths, suffixes, their lengths, contexts, their lengths, smallest ids."""
    m, at = int.from_bytes(raw[:4], "little"), 4
    take = lambda kind, n: np.frombuffer(raw, kind, n, at)
    lcp, behind, before = (np.frombuffer(raw, np.uint8, m, 4 + k * m) for k in range(3))
    at += 3 * m
    owner = take("<i8", m).astype(np.int64)
    at += 8 * m
    c = np.arange(LENGTH)
    x = np.zeros((m, LENGTH), np.uint8)
    own = (c >= lcp[:, None]) & (c < behind[:, None])
    x[own] = take(np.uint8, int(own.sum()))
    at += int(own.sum())
    # a column is inherited from the last row whose prefix length is not beyond it
    src = np.where(lcp[:, None] <= c, np.arange(m)[:, None], 0)
    x = x[np.maximum.accumulate(src, axis=0), c]
    left = np.zeros((m, BEFORE), np.uint8)
    mask = np.arange(BEFORE) < before[:, None]
    left[mask] = take(np.uint8, int(mask.sum()))
    return lcp, x, behind, left, before, owner


def merge(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[int], list[int], list[int]]:
    """Loser tree over sorted runs of equally long strings with prefix lengths: run numbers in merged order, and prefix lengths between neighbours.

    A node keeps the loser of its last match and how many characters it shares with the winner that went by.  The next string of the
    winning run shares a known number of characters with the string just put out; on its way up the longer shared prefix wins without a
    look at the characters, and equal ones are compared behind it only.
    """
    k = 1
    while k < len(runs):
        k *= 2
    heads = [r[0][0] if r[0] else None for r in runs] + [None] * (k - len(runs))
    place = [0] * k
    loser, shared = [0] * k, [0] * k

    def play(a: int, b: int, c: int) -> tuple[int, int, int]:
        """Winner, loser and their shared prefix, c characters being known as equal; ended runs lose."""
        x, y = heads[a], heads[b]
        if y is None:
            return a, b, 0
        if x is None:
            return b, a, 0
        u, v = x[c:], y[c:]
        if u == v:
            return (a, b, LENGTH) if a < b else (b, a, LENGTH)
        d = len(x) - ((int.from_bytes(u, "big") ^ int.from_bytes(v, "big")).bit_length() + 7) // 8
        return (a, b, d) if u < v else (b, a, d)

    win = [*([0] * k), *range(k)]
    for node in range(k - 1, 0, -1):
        win[node], loser[node], shared[node] = play(win[2 * node], win[2 * node + 1], 0)
    cur = win[1] if k > 1 else 0
    order, lcps, out = [], [], 0
    while heads[cur] is not None:
        order.append(cur)
        lcps.append(out)
        strings, own = runs[cur]
        i = place[cur] = place[cur] + 1
        if i < len(strings):
            heads[cur], c = strings[i], own[i]
        else:
            heads[cur], c = None, -1
        node = (cur + k) >> 1
        while node:
            s = shared[node]
            other = loser[node]
            if heads[other] is None:
                s = -1
            if c < s:
                cur, loser[node] = other, cur
                shared[node], c = max(c, 0), s
            elif c == s and c >= 0:
                w, l, d = play(cur, other, c)
                loser[node], shared[node] = l, d
                cur = w
            node >>= 1
        out = max(c, 0)
    return order, lcps, place


def owners(lcp: np.ndarray, behind: np.ndarray, left: np.ndarray, before: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """(rows, WINDOW) smallest id that holds the string starting o bytes before the anchor; NOBODY where the row has no such string."""
    res = np.full((len(doc), WINDOW), NOBODY, np.int64)
    left_hash = np.full(len(doc), 0x243F6A8885A308D3, np.uint64)
    for o in range(WINDOW):
        if o:
            left_hash = mix(left_hash + left[:, o - 1].astype(np.uint64) + np.uint64(1))
        has = np.nonzero((before >= o) & (behind >= LENGTH - o))[0]
        if not len(has):
            continue
        group = mix(np.cumsum(lcp < LENGTH - o)[has].astype(np.uint64)) + left_hash[has]
        order = np.argsort(group, kind="stable")
        first = np.nonzero(np.concatenate([[True], group[order[1:]] != group[order[:-1]]]))[0]
        low = np.minimum.reduceat(doc[has][order], first)
        res[has[order], o] = np.repeat(low, np.diff(np.append(first, len(has))))
    return res


def segments(owner: np.ndarray, behind: np.ndarray, before: np.ndarray, doc: np.ndarray) -> bytes:
    """Per row the stretches [from, to] of offsets whose strings have an owner below the row's own id."""
    c = np.arange(WINDOW)
    live = (owner < doc[:, None]) & (c >= LENGTH - behind.astype(np.int64)[:, None]) & (c <= before[:, None])
    same = np.zeros_like(live)
    same[:, 1:] = live[:, 1:] & live[:, :-1]
    row, start = np.nonzero(live & ~same)
    ends = np.zeros_like(live)
    ends[:, :-1] = live[:, :-1] & ~same[:, 1:]
    ends[:, -1] = live[:, -1]
    return b"".join([len(row).to_bytes(4, "little"), row.astype("<u4").tobytes(), start.astype(np.uint8).tobytes(), np.nonzero(ends)[1].astype(np.uint8).tobytes()])


def exchange_runs(blocks: DataFrame, count: int) -> DataFrame:
    """(path, payload): a range's segments of each block's suffixes; a segment gives an owner below the block's own smallest id."""
    def send(batches):
        import pyarrow as pa

        for b in batches:
            for path, payloads in zip(b.column("path").to_pylist(), b.column("payloads").to_pylist()):
                s = Suffixes(Block(path), payloads, count)
                cuts = np.searchsorted(s.range, np.arange(count + 1))
                out = [(r, front_coded(s, i, j)) for r, (i, j) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())) if j > i]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in out], pa.int32()), pa.array([path] * len(out)), pa.array([x for _, x in out], pa.binary())], names=["r", "path", "payload"])

    def receive(batches):
        import pyarrow as pa

        held: dict[int, list] = {}
        for b in batches:
            for r, path, raw in zip(*[b.column(c).to_pylist() for c in ("r", "path", "payload")]):
                held.setdefault(r, []).append((path, raw))
        for r in sorted(held):
            paths = [p for p, _ in held[r]]
            runs = [decoded(x) for _, x in held.pop(r)]
            cut = lambda x: [x[i:i + LENGTH] for i in range(0, len(x), LENGTH)]
            order, lcps, _ = merge([(cut(x[1].tobytes()), x[0].tolist()) for x in runs])
            order = np.array(order, np.int64)
            starts = np.cumsum([0, *[len(x[0]) for x in runs]])
            # the i-th time a run comes up it gives its i-th row
            at = np.empty(len(order), np.int64)
            by_run = np.argsort(order, kind="stable")
            at[by_run] = np.arange(len(order))
            lcp = np.array(lcps, np.int64)
            behind, left, before, doc = (np.concatenate([x[k] for x in runs])[at] for k in (2, 3, 4, 5))
            who = np.empty((len(order), WINDOW), np.int64)
            who[at] = owners(lcp, behind, left, before, doc)
            for i, (path, x) in enumerate(zip(paths, runs)):
                seg = segments(who[starts[i]:starts[i + 1]], x[2], x[4], x[5])
                if len(seg) > 4:
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([r.to_bytes(4, "little") + seg], pa.binary())], names=["path", "payload"])

    return blocks.mapInArrow(send, "r int, path string, payload binary").repartitionById(count, F.col("r")).mapInArrow(receive, "path string, payload binary")


def removed(block: Block, payloads: list[bytes] | None, answers: list[bytes] | None, count: int) -> np.ndarray:
    """Mask of the block's bytes to remove."""
    edge = np.zeros(len(block.data) + 1, np.int32)
    if payloads:
        s = Suffixes(block, payloads, count)
        mine = block.order[s.doc]
        # a smaller id in the same block holds all strings of the suffix
        at = np.nonzero(s.owner[s.entry] < mine)[0]
        np.add.at(edge, s.p[at] - s.before[s.entry[at]], 1)
        np.add.at(edge, s.p[at] + s.behind[s.entry[at]], -1)
        # for the smallest id of the block, the strings that other blocks own
        starts = np.searchsorted(s.range, np.arange(count))
        row, a, b = [], [], []
        for raw in answers or []:
            r, m = int.from_bytes(raw[:4], "little"), int.from_bytes(raw[4:8], "little")
            row.append(np.frombuffer(raw, "<u4", m, 8).astype(np.int64) + starts[r])
            a.append(np.frombuffer(raw, np.uint8, m, 8 + 4 * m).astype(np.int64))
            b.append(np.frombuffer(raw, np.uint8, m, 8 + 5 * m).astype(np.int64))
        if row:
            row, a, b = map(np.concatenate, (row, a, b))
            order = np.argsort(row, kind="stable")
            row, a, b = row[order], a[order], b[order]
            low, high = np.searchsorted(row, s.entry), np.searchsorted(row, s.entry, side="right")
            for k in range(int((high - low).max(initial=0))):
                at = np.nonzero(low + k < high)[0]
                seg = low[at] + k
                np.add.at(edge, s.p[at] - b[seg], 1)
                np.add.at(edge, s.p[at] - a[seg] + LENGTH, -1)
    return np.cumsum(edge[:-1], dtype=np.int32) > 0


def dedup_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_bytes: int | None = None, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept bytes) for every row of docs.

    Removed is each byte covered by a 50-byte string that also starts in a document with a smaller (integer) doc_id.  Null and empty texts
    have no bytes.  A null doc_id is larger than any other; rows with the same doc_id do not remove from each other.  Empty tables give no
    rows.
    """
    spark = docs.sparkSession
    count = min(2 * parallelism(spark), 65536)
    blocks = write_blocks(docs, None, doc_id, text, **({"block_bytes": block_bytes} if block_bytes else {})).select("path")
    keys = written(repeated_keys(blocks, block_keys, count), "anchors", "uncompressed")
    back = exchange_runs(per_block(blocks, payloads=keys), count)
    whole = per_block(blocks, payloads=keys, answers=back)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for row in b.to_pylist():
                block = Block(row["path"])
                mask = removed(block, row["payloads"], row["answers"], count)
                raw = np.frombuffer(block.data, np.uint8)
                n, spans, sha, kept = [], [], [], []
                for i, j in zip(block.at[:-1], block.at[1:]):
                    m = mask[i:j]
                    k = int(m.sum())
                    n.append(k)
                    spans.append(int((m[1:] & ~m[:-1]).sum()) + bool(k and m[0]))
                    left = (raw[i:j][~m] if k else raw[i:j]).tobytes()
                    sha.append(hashlib.sha256(left).hexdigest())
                    kept.append(left if with_text else None)
                yield pa.RecordBatch.from_arrays([pa.array(block.ids, pa.int64()), pa.array(block.sizes), pa.array(n, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())] + [pa.array(kept, pa.binary())] * with_text,
                                                 names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text)

    return whole.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * with_text)
