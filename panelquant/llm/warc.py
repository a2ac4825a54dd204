"""WARC archives: a writer with revisit records and a splittable reader.

Every record is a gzip member.  Reader tasks take byte ranges: they look for the gzip magic, accept a candidate when its first bytes decode
to a WARC header, then go from member to member and own the records that start inside their range; the last one may end beyond it.
"""
from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

from pyspark.sql import DataFrame, functions as F

from panelquant.llm.common import fresh_path, only, parallelism, slices, written
from panelquant.llm.files import Reader, put

#: Fixed values of the format.
MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1."
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
RANGE = 8 << 20  # bytes of a split
_ID = "<urn:x-page:{}>"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(raw: bytes) -> bytes:
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    return c.compress(raw) + c.flush()


def record(page_id, url: str | None, payload: bytes, refers_to=None) -> bytes:
    """One gzip member; control characters of the URL are percent-encoded.  A revisit keeps the HTTP header, without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_ID.format('' if page_id is None else page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}",
            f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if refers_to is not None:
        head[4:4] = [f"WARC-Refers-To: {_ID.format(refers_to)}", f"WARC-Profile: {PROFILE}"]
    return member(b"WARC/1.1\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")


def parse(raw: bytes) -> dict | None:
    """Fields of a decoded record; None for records that hold no page (such as warcinfo) or can't be read."""
    head, _, block = raw.partition(b"\r\n\r\n")
    f = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    if f.get("warc-type") not in ("response", "revisit"):
        return None
    http, _, payload = block[:int(f.get("content-length") or 0)].partition(b"\r\n\r\n")
    digest, number = f.get("warc-payload-digest", "").rpartition(":")[2], re.compile(r"urn:x-page:(-?\d+)>")
    ident = lambda k: int(m[1]) if (m := number.search(f.get(k, ""))) else None
    size = re.search(rb"(?im)^content-length:\s*(\d+)", http)
    revisit = f["warc-type"] == "revisit"
    return {"page_id": ident("warc-record-id"), "url": f.get("warc-target-uri"), "record_type": f["warc-type"], "refers_to": ident("warc-refers-to") if revisit else None,
            "payload": None if revisit else payload, "payload_bytes": int(size[1]) if revisit and size else len(payload), "payload_digest": digest if revisit else payload_digest(payload),
            "intact": revisit or digest == payload_digest(payload)}


def records(src: Reader, start: int, end: int, size: int, piece: int = 1 << 20):
    """Decoded records that start in [start, end) of a file of gzip members.

    Bytes are kept from the current member on; a candidate that is no record or breaks off is skipped and the search goes on behind it.
    """
    buf, base, pos = b"", start, start

    def fill(to: int) -> None:
        nonlocal buf
        while base + len(buf) < min(to, size):
            more = src.read(base + len(buf), min(piece, size - base - len(buf)))
            if not more:
                break
            buf += more

    while pos < end:
        if pos - base > piece:
            buf, base = buf[pos - base:], pos
        fill(pos + piece)
        at = buf.find(MAGIC, pos - base)
        if at < 0:
            pos = max(base + len(buf) - len(MAGIC) + 1, pos + 1)
            if base + len(buf) >= size:
                return
            continue
        pos = base + at
        if pos >= end:
            return
        d, out, used = zlib.decompressobj(31), [], at
        try:
            fill(pos + 512)
            if not zlib.decompressobj(31).decompress(buf[at:at + 512], len(VERSION)).startswith(VERSION):
                raise zlib.error("not a record")
            while not d.eof:
                if used >= len(buf):
                    before = len(buf)
                    fill(base + len(buf) + piece)
                    if len(buf) == before:
                        raise zlib.error("cut off")
                take = buf[used:used + piece]
                out.append(d.decompress(take))
                used += len(take)
        except zlib.error:
            pos += 1
            continue
        pos = base + used - len(d.unused_data)
        yield b"".join(out)


def with_types(pages: DataFrame, least: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, html, refers_to: the smallest page_id with an equal payload of at least `least` bytes, null for the response itself."""
    p = only(pages, page_id=page_id, url=url, html=html).withColumn("html", F.coalesce("html", F.lit("")))
    p = p.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("size", F.octet_length("html"))
    twins = p.where(F.col("size") >= least).groupBy("digest", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("k")).where("k > 1 and first is not null").drop("k")
    return p.join(twins, ["digest", "size"], "left").select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write(pages: DataFrame, least: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html", file_bytes: int = 256 << 20) -> DataFrame:
    """Writes archives to the shared folder; (path, size, records) per file, the list itself written.

    Rows with the smallest page_id of a payload are responses, repeated rows too; rows with a null page_id revisit it.  Null html is an
    empty payload.
    """
    spark, out = pages.sparkSession, fresh_path(pages.sparkSession, "warc")
    if "://" not in out:
        out = f"file://{out}"

    def run(batches):
        import pyarrow as pa

        rows = (r for cols in slices(batches, ["page_id", "url", "html", "refers_to"], 8 << 20, "html") for r in zip(*cols))
        r = next(rows, None)
        while r is not None:
            count = size = 0

            def parts():
                nonlocal r, count, size
                yield member(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:%s>\r\nWARC-Date: %s\r\nContent-Length: 0\r\n\r\n\r\n\r\n" % (str(uuid.uuid4()).encode(), DATE.encode()))
                while r is not None and size < file_bytes:
                    m = record(r[0], r[1], r[2].encode(), r[3])
                    size, count = size + len(m), count + 1
                    yield m
                    r = next(rows, None)

            path = f"{out}/{uuid.uuid4().hex}.warc.gz"
            total = put(path, parts())
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([total], pa.int64()), pa.array([count], pa.int64())], names=["path", "size", "records"])

    return written(with_types(pages, least, page_id, url, html).mapInArrow(run, "path string, size bigint, records bigint"), "warclist")


def read(spark_files: DataFrame, range_bytes: int = RANGE, payloads: bool = True) -> DataFrame:
    """Records of archives: (path, size) rows -> page_id, url, record_type, refers_to, payload_bytes, payload_digest, intact, path (and payload).

    One task reads one byte range of one file.  Digests of responses are computed from the payload, those of revisits taken from the header.
    An empty list gives no rows.
    """
    ranges = spark_files.where("size > 0").select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    ranges = ranges.repartition(4 * parallelism(spark_files.sparkSession), "path", "start")

    def run(batches):
        import pyarrow as pa

        kinds = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("intact", pa.bool_())] + [("payload", pa.binary())] * payloads
        for b in batches:
            for path, size, start in zip(*[b.column(c).to_pylist() for c in ("path", "size", "start")]):
                with Reader(path) as src:
                    held: list[dict] = []
                    weight = 0
                    for raw in records(src, start, start + range_bytes, size):
                        if r := parse(raw):
                            held.append(r)
                            weight += len(raw) if payloads else 256
                        if weight > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in held], t) for k, t in kinds] + [pa.array([path] * len(held), pa.string())], names=[k for k, _ in kinds] + ["path"])
                            held, weight = [], 0
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in held], t) for k, t in kinds] + [pa.array([path] * len(held), pa.string())], names=[k for k, _ in kinds] + ["path"])

    return ranges.mapInArrow(run, "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, intact boolean, " + "payload binary, " * payloads + "path string")
