"""Archives written and read back: payloads that hold records, equal payloads, several stretches of a file."""

import base64
import hashlib

from quire.llm import warc_chain as wc
from quire.llm.common import shared_path

INNER = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:999>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"


def brute(rows):
    best = {}
    for page, _, html in rows:
        best[html or ""] = max(best.get(html or "", -1), page)
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        first = best[html or ""] == page
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if first else "revisit", None if first else best[html or ""]))
    return sorted(out)


def pages():
    rows = [(i, f"http://x/{i}", f"<p>{i}</p>" + "é" * (37 * i % 900)) for i in range(60)]
    rows += [(60, "u", None), (61, None, ""), (62, "u\r\nX: y", INNER), (63, "u", "a" + INNER * 40 + "WARC/1.1\r\n"), (64, "u", "WARC/1.1\r\n"), (65, "u", INNER), (66, "u", "\r\n\r\n"), (67, "u", "big" * 40000)]
    rows += [(100 + i, "u", "same page") for i in range(50)]
    return rows


def test_round_trip(spark):
    rows = pages()
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")  # many stretches of each file
    try:
        got = wc.archived(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert all(r.digest_ok for r in got)
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == brute(rows)


def test_files_hold_whole_records(spark):
    path = shared_path(spark, "warc-test")
    wc.write_archives(spark.createDataFrame([(1, "http://a", "one"), (2, None, "one")], "page_id long, url string, html string").coalesce(1), path)
    data = b"".join(bytes(r.content) for r in spark.read.format("binaryFile").load(path).collect())
    assert data.count(b"WARC/1.1\r\n") == 2 and data.count(b"Content-Length: 3\r\n") == 1 and b"WARC-Refers-To: <urn:x-page:2>" in data and data.endswith(b"\r\n\r\n")
    assert b"WARC-Target-URI: http://a\r\n" in data and data.count(b"WARC-Target-URI") == 1


def test_edge_rows(spark):
    assert wc.archived(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
    rows = [(None, "u", "x", 1), (5, "u", "y", 1), (5, "u", "y", 1)]
    got = sorted(((r.page_id, r.record_type, r.refers_to) for r in wc.archived(spark.createDataFrame(rows, "page_id long, url string, html string, digest int")).collect()), key=repr)
    assert got == [(5, "response", None), (5, "response", None), (None, "response", None)]
