"""Media columns holding MPEG transport streams.

`mux` stores a byte payload as one program: program association and map tables, then packetised elementary stream packets with
timestamps, random-access points and clock references, continuity counters throughout.  `demux` parses stored streams: it follows the
tables to the elementary stream, checks sync bytes and counters, reassembles the packets and returns payload, timestamps and
random-access points.  Packets are handled as arrays.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from panelquant.llm.common import only, slices, small_batches, typed, written

#: Fixed values of the format.
PACKET, SYNC, PRIVATE_STREAM, PRIVATE_PES = 188, 0x47, 0xBD, 0x06
PMT_PID, ES_PID, PROGRAM = 0x1000, 0x0100, 1
#: Bytes of an access unit, ticks (of 1/90000 s) between units, the first timestamp, and units between random-access points.
UNIT, TICKS, FIRST, RANDOM_EVERY = 8192, 3600, 90000, 8
BLOCK = 64


def crc_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c ^= b << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7) & 0xFFFFFFFF if c & 0x80000000 else c << 1
    return c


def section(table_id: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 4).to_bytes(2, "big")
    return head + body + crc_mpeg(head + body).to_bytes(4, "big")


def table_packet(pid: int, sec: bytes) -> bytes:
    return (bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + sec).ljust(PACKET, b"\xff")


PAT = table_packet(0, section(0, bytes([0, 1, 0xC1, 0, 0]) + PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")))
PMT = table_packet(PMT_PID, section(2, PROGRAM.to_bytes(2, "big") + bytes([0xC1, 0, 0]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00"
                                    + bytes([PRIVATE_PES]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00"))


def stamp(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 255, pts >> 14 & 0xFE | 1, pts >> 7 & 255, pts << 1 & 0xFE | 1])


def mux_one(payload: bytes) -> bytes:
    """The payload as a transport stream; an empty payload gives the tables only."""
    out, cc = [PAT, PMT], 0
    for k, at in enumerate(range(0, len(payload), UNIT)):
        pts = (FIRST + k * TICKS) & (1 << 33) - 1
        chunk = payload[at:at + UNIT]
        data = b"\x00\x00\x01" + bytes([PRIVATE_STREAM]) + (len(chunk) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + stamp(pts) + chunk
        field = b""
        if k % RANDOM_EVERY == 0:  # random access, with a clock reference
            field = b"\x50" + (pts << 15 | 0x7E00).to_bytes(6, "big")
        room = PACKET - 4 - (len(field) + 1 if field else 0)
        n = 1 + -(-max(len(data) - room, 0) // 184)
        block = np.full((n, PACKET), 255, np.uint8)
        block[:, 0], block[:, 1], block[:, 2] = SYNC, ES_PID >> 8, ES_PID & 255
        block[0, 1] |= 0x40
        block[:, 3] = 0x10 | (np.arange(cc, cc + n) & 15)
        cc += n
        short = room + (n - 1) * 184 - len(data)  # stuffing, in the last packet
        if n > 2:
            block[1:-1, 4:] = np.frombuffer(data, np.uint8, (n - 2) * 184, room).reshape(-1, 184)
        for i, own in ((0, field), (n - 1, b"" if n > 1 else field)):
            stuff = short if i == n - 1 else 0
            if own or stuff:
                block[i, 3] |= 0x20
                full = (len(own) + 1 if own else 0) + stuff
                block[i, 4] = full - 1
                if full > 1:
                    block[i, 5:5 + max(len(own), 1)] = np.frombuffer(own or b"\x00", np.uint8)
                start = 4 + full
            else:
                start = 4
            part = data[:PACKET - start] if i == 0 else data[room + (n - 2) * 184:]
            block[i, start:] = np.frombuffer(part, np.uint8)
            if n == 1:
                break
        out.append(block.tobytes())
    return b"".join(out)


def demux_one(media: bytes | None) -> dict:
    """Parsed stream: payload, pts list, random-access points (pts, packet), packets, errors.  Odd input is counted in errors, never raised."""
    res = {"payload": b"", "pts": [], "random": [], "packets": 0, "units": 0, "pid": None, "errors": 0}
    media = media or b""
    p = np.frombuffer(media, np.uint8, len(media) // PACKET * PACKET).reshape(-1, PACKET)
    res["errors"] += bool(len(media) % PACKET) + int((p[:, 0] != SYNC).sum())
    p = p[p[:, 0] == SYNC]
    res["packets"] = len(p)
    pid = (p[:, 1] & 0x1F).astype(np.int32) << 8 | p[:, 2]
    pmt = _table(p[pid == 0], 0)
    pmt_pid = (pmt[7 + 3] & 0x1F) << 8 | pmt[7 + 4] if pmt and len(pmt) >= 12 else None
    streams = _table(p[pid == pmt_pid], 2) if pmt_pid is not None else None
    if not streams or len(streams) < 17:
        res["errors"] += bool(len(media))
        return res
    at = 12 + ((streams[10] & 0x0F) << 8 | streams[11])
    if at + 2 >= len(streams):
        res["errors"] += 1
        return res
    res["pid"] = es = (streams[at + 1] & 0x1F) << 8 | streams[at + 2]
    where = np.nonzero(pid == es)[0]
    q = p[where]
    if not len(q):
        return res
    has_field, has_data = (q[:, 3] & 0x20) > 0, (q[:, 3] & 0x10) > 0
    cc = q[has_data, 3] & 15
    res["errors"] += int(((np.diff(cc.astype(np.int16)) & 15) != 1).sum())
    begin = np.where(has_data, 4 + np.where(has_field, 1 + q[:, 4].astype(np.int32), 0), PACKET)
    begin = np.minimum(begin, PACKET)
    stream = q[np.arange(PACKET) >= begin[:, None]].tobytes()
    offset = np.concatenate([[0], np.cumsum(PACKET - begin)])
    starts = np.nonzero((q[:, 1] & 0x40) > 0)[0]
    random = has_field & (q[:, 4] > 0) & ((q[:, 5] & 0x40) > 0)
    parts = []
    for a, b in zip(starts, [*starts[1:], len(q)]):
        pes = stream[offset[a]:offset[b]]
        if pes[:3] != b"\x00\x00\x01" or len(pes) < 9:
            res["errors"] += 1
            continue
        size = int.from_bytes(pes[4:6], "big")
        data = pes[9 + pes[8]:6 + size] if size else pes[9 + pes[8]:]
        res["errors"] += bool(size and len(pes) < 6 + size)
        pts = None
        if pes[7] & 0x80 and pes[8] >= 5:
            s = pes[9:14]
            pts = (s[0] & 0x0E) << 29 | s[1] << 22 | (s[2] & 0xFE) << 14 | s[3] << 7 | s[4] >> 1
        res["pts"].append(pts)
        if random[a]:
            res["random"].append({"pts": pts, "packet": int(where[a])})
        parts.append(data)
    res["payload"], res["units"] = b"".join(parts), len(parts)
    return res


def _table(p: np.ndarray, table_id: int) -> bytes | None:
    """The first whole section of a table that has a right checksum."""
    for r in p:
        raw = r.tobytes()[4:]
        sec = raw[1 + raw[0]:] if raw[0] < 180 else b""
        if len(sec) >= 3 and sec[0] == table_id:
            sec = sec[:3 + ((sec[1] & 0x0F) << 8 | sec[2])]
            if crc_mpeg(sec) == 0:
                return sec
    return None


def padded(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + b"\x00" * (-len(raw) % BLOCK if raw else BLOCK)


def mux(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, media for every row: the text's UTF-8 bytes (null: none) padded with zero bytes to a positive multiple of 64."""
    d = small_batches(only(docs, doc_id=doc_id, text=text))
    kind, arrow = typed(d, "doc_id")

    def run(batches):
        import pyarrow as pa

        for ids, texts in slices(batches, ["doc_id", "text"]):
            yield pa.RecordBatch.from_arrays([pa.array(ids, arrow), pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array([mux_one(padded(t)) for t in texts], pa.binary())],
                                             names=["doc_id", "n_bytes", "media"])

    return d.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, media binary")


def demux(media: DataFrame, doc_id: str = "doc_id", column: str = "media") -> DataFrame:
    """doc_id, payload, pts, random_access (pts, packet), pid, packets, units, errors for every row; a null or odd stream has an empty payload and, if not empty, errors."""
    m = only(media, doc_id=doc_id, media=column)
    kind, arrow = typed(m, "doc_id")

    def run(batches):
        import pyarrow as pa

        for ids, raw in slices(batches, ["doc_id", "media"], sized="media"):
            r = [demux_one(x) for x in raw]
            col = lambda k, t: pa.array([x[k] for x in r], t)
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, arrow), col("payload", pa.binary()), col("pts", pa.list_(pa.int64())), col("random", pa.list_(pa.struct([("pts", pa.int64()), ("packet", pa.int64())]))),
                col("pid", pa.int64()), col("packets", pa.int64()), col("units", pa.int64()), col("errors", pa.int64())], names=["doc_id", "payload", "pts", "random_access", "pid", "packets", "units", "errors"])

    return m.mapInArrow(run, f"doc_id {kind}, payload binary, pts array<bigint>, random_access array<struct<pts:bigint,packet:bigint>>, pid bigint, packets bigint, units bigint, errors bigint")


def stored_digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The contract's columns: streams are written as a media column, read again and parsed; digests are of what was read."""
    stored = written(mux(docs, doc_id, text), "media")
    kind, arrow = typed(stored, "doc_id")

    # parse and hash in one pass, so payloads do not travel
    def run(batches):
        import hashlib
        import zlib

        import pyarrow as pa

        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        for ids, n, raw in slices(batches, ["doc_id", "n_bytes", "media"], sized="media"):
            r = [demux_one(x) for x in raw]
            feature = [f"pid={x['pid']};packets={x['packets']};units={x['units']};first={x['pts'][0] if x['pts'] else ''};last={x['pts'][-1] if x['pts'] else ''};random={len(x['random'])};errors={x['errors']}" for x in r]
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, arrow), pa.array(n, pa.int64()), pa.array([len(x["payload"]) for x in r], pa.int64()), pa.array([hashlib.sha256(x["payload"]).hexdigest() for x in r]),
                pa.array([zlib.crc32(x["payload"][-BLOCK:]) for x in r], pa.int64()), pa.array([len(x) for x in raw], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in raw]), pa.array(feature)], names=names)

    return stored.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
