import base64
import gzip
import hashlib
import io
import zlib

import pytest

from heronq.llm import queries, storage, warc
from heronq.llm.common import shared_dir

PAGES = [
    (1, "http://a/x", "<p>same</p>"),
    (2, "http://a/y z\r\nX-Evil: 1", "<p>same</p>"),
    (3, None, None),
    (4, "", ""),
    (5, "http://é/ü", "naïve \r\n\r\nWARC/1.1 inside"),
    (6, "u", "x" * 700_000),
    (7, "u", "x" * 700_000),
    (0, "late", "<p>same</p>"),
    (8, "twice", "two rows"),
    (8, "twice", "two rows"),
]


def want(rows, min_bytes=0):
    first = {}
    for page, _, html in rows:
        raw = (html or "").encode()
        first[raw] = min(page, first.get(raw, page))
    out = []
    for page, _, html in rows:
        raw = (html or "").encode()
        revisit = first[raw] != page and len(raw) >= min_bytes
        out.append((page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", first[raw] if revisit else None))
    return sorted(out, key=str)


def table(df):
    return sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()], key=str)


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "extra", 1) for r in rows], "page_id long, url string, html string, payload string, offset int")


@pytest.mark.parametrize("min_bytes", [0, 5, 100])
def test_round_trip(spark, min_bytes):
    assert table(warc.archive_pages(pages(spark), min_bytes)) == want(PAGES, min_bytes)


def test_empty_and_null_ids(spark):
    assert warc.archive_pages(pages(spark, [(1, "u", "x")]).limit(0)).count() == 0
    got = {(r.page_id, r.record_type, r.refers_to) for r in warc.archive_pages(pages(spark, [(None, "u", "x"), (4, "u", "x"), (None, "u", "y")])).collect()}
    assert got == {(None, "revisit", 4), (4, "response", None), (None, "response", None)}


def test_op10_query(spark, sf_dir):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    assert table(queries.op10_warc(spark, sf_dir)) == want(rows)


def test_members_and_index(spark):
    single = shared_dir(spark) + "/m"
    whole = warc.write_archives(warc.plan_records(pages(spark)).coalesce(1), shared_dir(spark) + "/w")
    made = warc.normalise(whole, single).collect()
    assert [r.n_records for r in made] == [len(PAGES)]
    with storage.open_in(made[0].path) as f:
        raw = f.read()
    with storage.open_in(whole.first().path) as f:
        assert gzip.decompress(f.read()) == gzip.decompress(raw)  # the same records, each a member of its own
    starts = [i for i in range(len(raw) - 2) if raw[i : i + 3] == b"\x1f\x8b\x08"]
    index = [r.offset for r in warc.read_records(warc.normalise(whole, single)).collect()]
    assert len(index) == len(PAGES) and set(sorted(index)) <= set(starts)


@pytest.mark.parametrize("chunk", [1, 7, 1 << 16])
def test_normaliser_takes_members_padding_and_small_reads(monkeypatch, chunk):
    monkeypatch.setattr(warc, "CHUNK", chunk)
    records = [warc.record(i, "u", b"z" * (i * 50), None, "1970-01-01T00:00:00Z") for i in range(6)]
    source = io.BytesIO(gzip.compress(b"".join(records[:4])) + gzip.compress(records[4]) + gzip.compress(records[5]) + b"\0" * 9)
    out = io.BytesIO()
    index = warc.normalise_stream(source, out)
    assert [zlib.decompress(out.getvalue()[a : a + n], 31) for a, n, _, _ in index] == records


def test_cut_streams_are_refused():
    raw = gzip.compress(warc.record(1, "u", b"payload" * 50, None, "1970-01-01T00:00:00Z"))
    with pytest.raises((EOFError, zlib.error)):
        warc.normalise_stream(io.BytesIO(raw[: len(raw) // 2]), io.BytesIO())


def test_one_payload_in_most_pages(spark):
    """A payload of most rows: one response, all others refer to it."""
    rows = [(i, f"http://h/{i}", "same" if i % 8 else f"own {i}") for i in range(5, 165)]
    pages = spark.createDataFrame(rows[::-1], "page_id long, url string, html string").repartition(5)
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.archive_pages(pages).collect()}
    assert got == {i: ("response", None) if i == 5 or i % 8 == 0 else ("revisit", 5) for i, _, _ in rows}
