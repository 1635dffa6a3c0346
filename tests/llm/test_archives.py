"""Seekable archives: round trips, the layout of frames and seek tables, roles of equal payloads, odd rows."""

import base64
import hashlib
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from quern.llm import warc_zstd as W

SCHEMA = "page_id long, url string, html string, data string, index int"
PAGES = [
    (1, "http://a/x", "<p>same</p>", "clash", 1), (2, "http://b/ü y\r\nX: 1", "<p>same</p>", "clash", 1), (3, None, "", "clash", 1), (4, "http://c", None, "clash", 1),
    (5, "http://d", "other \x00 \r\n\r\nWARC/1.1\r\n ünïcode", "clash", 1), (5, "http://d", "other \x00 \r\n\r\nWARC/1.1\r\n ünïcode", "clash", 1), (6, "http://e", "long " * 200_000, "clash", 1),
    (None, "http://f", "nobody's", "clash", 1), (None, "http://f", "nobody's", "clash", 1), (None, "http://f", "<p>same</p>", "clash", 1),
]


def plain(rows, least=0):
    """(id, payload bytes, digest, type, refers) by a loop."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2] or "", []).append(r[0])
    out = []
    for payload, ids in groups.items():
        data = payload.encode()
        fact = (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        most = max((i for i in ids if i is not None), default=None)
        spare = ids.index(most)
        for k, i in enumerate(ids):
            response = k == spare or len(data) < least
            out.append((i, *fact, "response" if response else "revisit", None if response else most))
    return sorted(out, key=str)


def read(bundles):
    rows = W.read_back(bundles).collect()
    number = lambda v: None if v is None else int(v)
    return sorted(((number(r.id), r.payload_bytes, r.payload_digest, r.record_type, number(r.refers_to)) for r in rows), key=str)


@pytest.mark.parametrize("least", [0, 1, 12, 10**9])
def test_odd_rows(spark, least):
    assert read(W.write(spark.createDataFrame(PAGES, SCHEMA), least=least)) == plain(PAGES, least)


def test_empty_table(spark):
    bundles = W.write(spark.createDataFrame([], SCHEMA))
    assert read(bundles) == [] and W.index(bundles).count() == 0


def test_index_leads_to_every_payload(spark):
    pages = spark.createDataFrame(PAGES, SCHEMA)
    bundles = W.write(pages, least=10**9)
    got = {(r.record, bytes(r.payload).decode()) for r in W.fetch(bundles, W.index(bundles)).collect()}
    keys = {}
    for p in PAGES:
        key = "" if p[0] is None else f"={p[0]}"
        keys.setdefault((key, p[2] or ""), 0)
    assert {t for _, t in got} == {t for _, t in keys} and len(W.index(bundles).collect()) == len(PAGES)


def test_frames_stand_alone_and_seek_table_is_a_frame(spark, monkeypatch):
    bundle = W.Bundle(3)
    records = [W.record("response", W.identifier(f"={i}", 0), "http://x", W.base32_sha1(b"a" * i), i, b"a" * i, None) for i in range(0, 300_000, 30_000)]
    for i, r in enumerate(records):
        bundle.add(str(i), r)
    data = bundle.data()
    table = W.read_seek_table(data)
    assert len(table) > 3 and sum(plain for _, _, plain in table) == sum(map(len, records))
    assert struct.unpack("<I", data[-4:])[0] == 0x8F92EAB1
    for name, frame, offset, length in bundle.index:
        assert W.read_frame(data, frame)[offset : offset + length] == records[int(name)]
    whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    assert whole == b"".join(records)  # a reader that knows no seek table skips it


def test_small_bundles_and_files(spark, monkeypatch, tmp_path):
    from quern.llm.queries import op11_seekable_warc
    from tests.llm.conftest import DATA

    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    bundles = W.write(pages)
    paths = [r.path for r in W.save(bundles, str(tmp_path / "archives")).collect()]
    held = {r.bundle: bytes(r.data) for r in bundles.collect()}
    assert {open(p, "rb").read() for p in paths} == set(held.values())
    where = W.index(bundles).filter(F.col("frame") > 0).first()
    if where is not None:
        head, _, _, _ = W.parse(W.read_frame(held[where.bundle], where.frame), where.offset)
        assert head["WARC-Record-ID"] == f"<{where.record}>"
    assert op11_seekable_warc(spark, DATA).count() == pages.count()
