"""WARC archives: round trips, revisits, oversized payloads in chunks."""

import gzip
import hashlib
import io

from pyspark.sql import functions as F

from lumenframe.llm import warc
from lumenframe.session import settle, shared_folder

SCHEMA = "page_id long, url string, html string"


def round_trip(spark, rows, name, chunk=64, extra=None):
    pages = spark.createDataFrame(rows, SCHEMA)
    pages = pages.withColumn("payload", F.lit(1)) if extra else pages
    records = warc.mark_revisits(pages, "page_id", F.col("html"), F.col("url"))
    folder = f"{shared_folder(spark)}/{name}"
    files = settle(warc.write_archives(warc.chunk_payloads(records, chunk), folder))
    return folder, files, warc.read_archives(files, chunk)


def test_payloads_come_back_whole_in_chunks(spark):
    long = "żółć " * 40_000
    rows = [(1, "http://a/\r\nx", "short"), (2, None, long), (3, "u", None), (4, "u", ""), (5, "u", long), (None, "u", "WARC/1.1\r\n\r\n"), (7, "u", "x" * 99), (8, "u", "x" * 99)]
    folder, files, chunks = round_trip(spark, rows, "warc-trip", chunk=1000, extra=True)
    chunks = settle(chunks)
    got = {}
    for r in chunks.orderBy("record_id", "chunk_no").collect():
        got.setdefault(r["record_id"], []).append(r)
    assert max(len(r["data"]) for rs in got.values() for r in rs) <= 1000
    for page, _, html in rows:
        rs = got[f"urn:record:{'' if page is None else page}"]
        body = b"".join(bytes(r["data"]) for r in rs)
        assert [r["chunk_no"] for r in rs] == list(range(len(rs))) and [r["last"] for r in rs] == [False] * (len(rs) - 1) + [True]
        for i, r in enumerate(rs):  # every chunk carries the digest so far
            so_far = b"".join(bytes(x["data"]) for x in rs[: i + 1])
            assert r["digest_so_far"] == hashlib.sha256(so_far).hexdigest() and r["bytes_so_far"] == len(so_far)
        if page == 5:
            assert rs[0]["record_type"] == "revisit" and rs[0]["refers_to_record"] == "urn:record:2" and body == b""
        else:
            assert rs[0]["record_type"] == "response" and body == (html or "").encode()
    out = {r["page_id"]: r for r in warc.summarize(chunks).collect()}
    for page, _, html in rows:
        assert out[page]["payload_digest"] == hashlib.sha256((html or "").encode()).hexdigest()
        assert out[page]["payload_bytes"] == len((html or "").encode())
    assert out[5]["refers_to"] == 2 and out[8]["refers_to"] is None and out[2]["record_type"] == "response"
    assert files.agg(F.sum("records")).first()[0] == len(rows)
    assert warc.list_archives(spark, folder).count() == files.count()


def test_files_are_gzip_per_record(spark):
    _, files, _ = round_trip(spark, [(i, "u", f"page {i}") for i in range(3)], "warc-members")
    data = b""
    for f in files.collect():
        data += open(f["file"].removeprefix("file:"), "rb").read()
    assert data.count(b"\x1f\x8b\x08") >= 3
    text = gzip.decompress(data)
    assert text.count(b"WARC/1.1\r\nWARC-Type: response\r\n") == 3 and text.endswith(b"page 2\r\n\r\n")


def test_smallest_id_is_the_response_and_repeats(spark):
    same = "y" * 100
    _, _, chunks = round_trip(spark, [(9, "u", same), (3, "u", same), (3, "u", same), (None, "u", same)], "warc-ties")
    out = sorted(((r["page_id"] or -1), r["record_type"], r["refers_to"]) for r in warc.summarize(chunks).collect())
    assert out == [(-1, "revisit", 3), (3, "response", None), (3, "response", None), (9, "revisit", 3)]


def test_empty_table(spark):
    _, files, chunks = round_trip(spark, [], "warc-empty")
    assert files.count() == 0 and warc.summarize(chunks).count() == 0


def test_foreign_records_and_broken_files():
    block = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:1>\r\nX-Long: a\r\n b\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    rows = list(warc._records(io.BytesIO(block * 2), "f", 2))
    assert [r[5] for r in rows[:3]] == [b"he", b"ll", b"o"] and len(rows) == 6 and rows[0][1] == "warcinfo"
    try:
        list(warc._records(io.BytesIO(block[:-6]), "f", 2))
    except ValueError:
        pass
    else:
        raise AssertionError("a cut file was read without complaint")
