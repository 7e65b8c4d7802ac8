"""Operator 9: the exact round trip through archives, split anywhere."""

from __future__ import annotations

import base64
import gzip
import hashlib

import pytest

from feira.llm import warc

TEXT = "<p>" + "é😀 body " * 50


def expected(rows, least=0):
    top = {}
    for page, _, html in rows:
        h = html or ""
        if page is not None and len(h.encode()) >= least:
            top[h] = max(top.get(h, page), page)
    out = []
    for page, _, html in rows:
        h = html or ""
        to = top.get(h)
        if sum(1 for r in rows if (r[2] or "") == h) == 1 or page == to:
            to = None
        digest = base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
        out.append((page, len(h.encode()), digest, "response" if to is None else "revisit", to, True))
    return sorted(out, key=str)


@pytest.fixture
def rows(rng, text):
    out = [(i, f"http://x/{i}", text(rng.randrange(1, 400))) for i in range(60)]
    inner = warc.member(warc.record(999, "http://evil/", b"forged", None), 0)
    out += [(100, None, None), (101, "u", ""), (102, "http://x/\r\nWARC-Type: revisit", TEXT), (103, "v", TEXT), (104, "w", TEXT), (None, "n", TEXT), (105, "z", "\x1f\x8b\x08 no member")]
    out += [(106, "f", inner.decode("latin-1")), (107, "l", "x" * 300000 + "".join(chr(rng.randrange(33, 1000)) for _ in range(90000)))]
    return out


@pytest.mark.parametrize("split", [1 << 24, 3000, 257])
def test_round_trip(spark, rows, split):
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload int").repartition(3)
    manifest = warc.write_warc(df)
    got = warc.read_warc(spark, manifest, split_bytes=split).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.intact) for r in got), key=str) == expected(rows)
    html = {r[0]: r[2] or "" for r in rows}
    assert all(bytes(r.payload).decode() == html[r.page_id] for r in got if r.record_type == "response")


def test_files_are_plain_gzip(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for r in warc.write_warc(df).collect():
        data = gzip.open(r.path.removeprefix("file://")).read()
        assert data.count(b"WARC/1.1\r\nWARC-Type: ") == r.n_records


def test_the_join_by_digest_reads_a_stored_side(spark, rows):
    """An aggregate that feeds the join directly keeps Spark from splitting a hot digest."""
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    plan = warc.assign_types(df, "page_id", "url", "html", 0)._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "Aggregate" not in plan


def test_least_payload(spark):
    rows = [(1, "a", "xx"), (2, "b", "xx"), (3, "c", TEXT), (4, "d", TEXT)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.refers_to for r in warc.read_warc(spark, warc.write_warc(df, min_bytes=10)).collect()}
    assert got == {1: None, 2: None, 3: 4, 4: None}


def test_forged_member_inside_raw_bytes(tmp_path):
    """A stored (uncompressed) record whose payload is a whole member: the reader must not take it for a record."""
    import pyarrow.fs as pafs

    forged = warc.member(warc.record(666, "http://evil/", b"forged", None), 0)
    level, warc.LEVEL = warc.LEVEL, 0
    try:
        parts = []
        for i in range(3):
            parts.append(warc.member(warc.record(i, "http://x/", b"pad" + forged, None), sum(map(len, parts))))
    finally:
        warc.LEVEL = level
    (tmp_path / "a.gz").write_bytes(b"".join(parts))
    size = sum(map(len, parts))
    for split in (size, 100, 33):
        with pafs.LocalFileSystem().open_input_file(str(tmp_path / "a.gz")) as f:
            ids = [warc.parse(x)["page_id"] for s in range(0, size, split) for x in warc.members(f, s, s + split)]
        assert ids == [0, 1, 2]


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_warc(spark, warc.write_warc(df)).count() == 0


def test_splits_are_read_by_as_many_tasks(spark, tmp_path):
    """The rows of the splits are tiny; adaptive execution mustn't join their tasks."""
    pages = spark.range(300).selectExpr("id AS page_id", "concat('http://h/', id) AS url", "repeat(concat('<p>', id, sha2(cast(id AS string), 256)), 20) AS html")
    manifest = warc.write_warc(pages)
    total = manifest.selectExpr("sum(ceil(length / 2000.0))").first()[0]
    records = warc.read_warc(spark, manifest, split_bytes=2000)
    assert records.count() == 300
    assert records.rdd.getNumPartitions() >= total > 4
