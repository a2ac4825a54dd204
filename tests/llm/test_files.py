"""Archives, token shards and media streams: exact round trips."""
import gzip
import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from panelquant.llm import queries, transport, warc, wavelet
from panelquant.llm.files import Reader, get, put

DIR = "/root/testdata/sf0.01"
ODD = [None, "", " ", "a", "x" * 63, "x" * 64, "x" * 65, "äöü 漢字 🎉́ é", "A b\tc\nd  e f <|endoftext|> don't I'LL", "lorem ipsum " * 3000, "\x1f\x8b", "'s 't\r\n\x0b 12 ß İ Σ"]


def test_transport_round_trip_one():
    for n in (0, 64, 128, 162, 163, 170, 176, 8192, 8192 + 64, 70_016, 8192 * 9 + 64):
        data = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes()
        m = transport.mux_one(data)
        r = transport.demux_one(m)
        assert len(m) % 188 == 0 and r["payload"] == data and not r["errors"]
        units = -(-n // transport.UNIT)
        assert r["pts"] == [90000 + 3600 * k for k in range(units)]
        assert [x["pts"] for x in r["random"]] == r["pts"][::transport.RANDOM_EVERY]
        assert all(m[188 * x["packet"] + 5] & 0x40 for x in r["random"])


def test_transport_every_length():
    for n in range(1, 600):
        data = bytes(k % 251 for k in range(n))
        r = transport.demux_one(transport.mux_one(data))
        assert r["payload"] == data and not r["errors"], n


def test_transport_faults_are_counted():
    m = transport.mux_one(bytes(5000))
    assert transport.demux_one(m[:188 * 4] + m[188 * 5:])["errors"] > 0  # a lost packet
    assert transport.demux_one(b"\x00" * 1000)["errors"] > 0
    assert transport.demux_one(m[:-7])["errors"] > 0
    assert transport.demux_one(None) == transport.demux_one(b"") and transport.demux_one(b"")["errors"] == 0


def test_transport_query_columns(spark):
    docs = spark.createDataFrame([(k, t, "n") for k, t in enumerate(ODD)], "doc_id long, text string, media string")
    got = {r["doc_id"]: r for r in transport.stored_digest(docs).collect()}
    for k, t in enumerate(ODD):
        raw = (t or "").encode()
        pad = raw + bytes(-len(raw) % 64 if raw else 64)
        r = got[k]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]))
        assert r["media_sha256"] == hashlib.sha256(transport.mux_one(pad)).hexdigest() and "errors=0" in r["feature"]
    full = transport.demux(transport.mux(docs)).where("doc_id = 9").first()
    assert bytes(full["payload"]) == transport.padded(ODD[9]) and len(full["pts"]) == full["units"] and full["random_access"][0]["pts"] == 90000
    assert transport.stored_digest(docs.where("false")).count() == 0


def _brute_warc(rows):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    out = []
    for i, _, h in rows:
        f = first.get(h or "")
        rev = f is not None and i != f
        out.append((i, len((h or "").encode()), warc.payload_digest((h or "").encode()), "revisit" if rev else "response", f if rev else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("step", [1, 97, 4096, 1 << 23])
def test_warc_reads_each_record_once_at_any_range(tmp_path, step):
    rng = np.random.default_rng(1)
    raw = [warc.record(k, f"http://x/{k}", rng.bytes(int(n)), None) for k, n in enumerate([0, 5, 3000, 70_000, 1, 2_500_000, 10])]
    size = put(f"file://{tmp_path}/a.gz", [warc.member(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n\r\n\r\n\r\n"), *raw])
    assert size == len(get(f"file://{tmp_path}/a.gz")) and gzip.decompress(get(f"file://{tmp_path}/a.gz")).count(b"WARC/1.1\r\n") >= 8
    ranges = [(0, size)] if step > size else [(a, a + step) for a in range(0, size, step)]
    if step == 1:  # only around the starts
        near = {a for s in np.cumsum([0, *map(len, raw)]) for a in range(max(int(s) - 40, 0), min(int(s) + 200, size))}
        ranges = [(a, a + 1) for a in sorted(near)]
    with Reader(f"file://{tmp_path}/a.gz") as src:
        got = [p for a, b in ranges for r in warc.records(src, a, b, size) if (p := warc.parse(r))]
    assert [p["page_id"] for p in got] == list(range(7)) and all(p["intact"] for p in got)


def test_warc_false_magic_and_broken_members(tmp_path):
    good = warc.record(1, "u", b"body", None)
    raw = b"\x1f\x8b\x08junk" + gzip.compress(b"no record") + good[:-9] + good + good[:20]
    put(f"file://{tmp_path}/b.gz", [raw])
    with Reader(f"file://{tmp_path}/b.gz") as src:
        got = [warc.parse(r) for r in warc.records(src, 0, len(raw), len(raw))]
    assert [g["payload"] for g in got if g] == [b"body"]


def test_warc_query_rows(spark):
    rows = [(3, "http://a/ x\n", "same"), (1, None, "same"), (2, "u", None), (5, "u", ""), (4, "u", "x" * 100_000), (4, "u", "x" * 100_000), (None, "u", "same"), (None, "v", "alone"), (9, "v", "ä\x1f"), (8, "w", "y" * 9_000_000)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    for step in (1 << 12, warc.RANGE):
        files = warc.write(pages, file_bytes=300)
        got = warc.read(files, step, payloads=False)
        assert sorted(map(tuple, got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str) == _brute_warc(rows)
    assert files.count() > 1
    least = warc.with_types(pages, 5).where("refers_to is not null").count()
    assert least == 0  # repeats of short payloads are responses
    assert warc.read(warc.write(pages.where("false"))).count() == 0


def test_wavelet_matrix_against_arrays():
    rng = np.random.default_rng(3)
    for n, top in ((0, 1), (1, 1), (7, 3), (511, 9), (512, 70_000), (5000, 49_408)):
        ids = rng.integers(0, top, n).astype(np.uint32)
        s = wavelet.Shard.parse(b"".join(wavelet.Shard.build(ids, [4, None], [0, n // 2, n]).parts()))
        assert (s.decode() == ids).all() and s.doc_ids == [4, None] and s.starts.tolist() == [0, n // 2, n]
        for i in rng.integers(0, n, min(n, 30)).tolist():
            v = int(ids[i])
            assert s.access(i) == v
            a, b = sorted(rng.integers(0, n + 1, 2).tolist())
            assert s.count(v, a, b) == int((ids[a:b] == v).sum())
            places = np.nonzero(ids == v)[0]
            assert [s.select(v, k) for k in range(min(len(places), 3))] == places[:3].tolist()
        assert s.count(1 << 20) == 0 and s.count(top + 5) == 0


def test_wavelet_query_rows(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    rows = [(k * 7 % 12, x) for k, x in enumerate(ODD)] + [(None, "null id"), (100, "twin"), (100, "twin"), (100, "other")]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, bucket string")
    ids = lambda x: [*t.encode(x or "", add_special_tokens=False).ids, 2]
    want, at = [], 0
    size = lambda x: np.array(ids(x), "<u2").tobytes()
    for i, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, size(r[1]))):
        raw = np.array(ids(x), "<u4")
        want.append((i, at, len(raw), zlib.crc32(raw.tobytes())))
        at += len(raw)
    for limit in (50, wavelet.FILE_TOKENS):
        files = wavelet.write(docs, queries.tokenizer_path(), 2, file_tokens=limit)
        assert sorted(map(tuple, wavelet.read(files).collect()), key=lambda r: r[1]) == want
    assert wavelet.read(wavelet.write(docs.where("false"), queries.tokenizer_path(), 2)).count() == 0


def test_wavelet_query_equals_library_on_given_table(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    rows = duckdb.sql("select doc_id, text from '/root/testdata/sf0.001/documents.parquet' order by doc_id").fetchall()
    at, want = 0, []
    for (i, _), e in zip(rows, t.encode_batch([x or "" for _, x in rows], add_special_tokens=False)):
        raw = np.array([*e.ids, 2], "<u4")
        want.append((i, at, len(raw), zlib.crc32(raw.tobytes())))
        at += len(raw)
    got = queries.op9(spark, "/root/testdata/sf0.001").orderBy("start")
    assert list(map(tuple, got.collect())) == want


def test_other_tokenizers_encode_whole_texts():
    """White space and case count in a byte-level vocabulary; words by themselves would get other ids."""
    from tokenizers import Tokenizer

    rng = random.Random(6)
    texts = ["".join(rng.choice("abZé ÉßŸÇ·ªº×,.'sd$&!-_12 \n\t  İıΩσς<|endoftext|>") for _ in range(rng.randint(0, 25))) for _ in range(4000)] + [None, ""]
    for name, wordwise in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)):
        w, t = wavelet.Words(queries.tokenizer_path(name)), Tokenizer.from_file(queries.tokenizer_path(name))
        assert w.wordwise is wordwise
        for part in (texts[:1000], texts):
            got = [np.frombuffer(x, w.kind).tolist() for x in w.ids(part, 7)]
            assert got == [e.ids + [7] for e in t.encode_batch([x or "" for x in part], add_special_tokens=False)]
