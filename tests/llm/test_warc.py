import hashlib

from pyspark.sql import functions as F

from skyledger.llm import warc
from skyledger.session import run_dir

PAGES = "page_id long, url string, html string, digest string, original long, value string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 9, "y") for r in rows], PAGES)


def brute(rows):
    first = {}
    for page_id, _, html in rows:
        raw = (html or "").encode()
        if len(raw) >= 100 and page_id is not None:
            first[raw] = min(first.get(raw, page_id), page_id)
    out = []
    for page_id, _, html in rows:
        raw = (html or "").encode()
        original = first.get(raw)
        again = original is not None and page_id != original
        out.append((page_id, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", original if again else None))
    return sorted(out, key=repr)


ROWS = [
    (5, "http://a/5", "<p>" + "é" * 60),
    (2, "http://a/2", "<p>" + "é" * 60),
    (2, "http://a/2", "<p>" + "é" * 60),
    (9, None, "<p>" + "é" * 60),
    (None, "http://a/none", "<p>" + "é" * 60),
    (11, "http://a/11", None),
    (12, "http://a/12", ""),
    (13, "http://a/\r\nWARC-Type: x", "y" * 99),
    (14, "http://a/14", "y" * 99),
    (15, "http://a/15", "z\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" + "q" * 100),
    (16, "http://a/16", "z\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" + "q" * 100),
    (17, "http://a/17", "long " * 30_000),
]


def test_round_trip_matches_brute_force(spark):
    path = run_dir(spark, "warc-test")
    warc.write_archives(pages(spark, ROWS), path, archive_bytes=500)
    got = warc.read_archives(spark, path).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(ROWS)


def test_archives_are_whole_records_in_bounded_files(spark):
    path = run_dir(spark, "warc-test")
    rows = [(i, f"http://h/{i}", f"page {i % 7} " * 50) for i in range(200)]
    warc.write_archives(pages(spark, rows).coalesce(1), path, archive_bytes=10_000)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(path).collect()
    assert len(files) > 5
    parsed = [x for f in files for x in warc.parse(f.content)]
    assert len(parsed) == 200
    assert sum(h["WARC-Type"] == "response" for h, _ in parsed) == 7
    for headers, payload in parsed:
        assert headers["WARC-Type"] == "response" or payload == b""


def test_empty_table(spark):
    path = run_dir(spark, "warc-test")
    warc.write_archives(pages(spark, ROWS).where(F.lit(False)), path)
    assert warc.read_archives(spark, path).count() == 0
