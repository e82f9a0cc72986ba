import gzip
import hashlib
import os
from collections import Counter

from ridgeline.llm import warc
from ridgeline.llm.common import new_folder


def brute(rows):
    payload = [(p, (h or "").encode()) for p, _, h in rows]
    first = {}
    for p, b in payload:
        if p is not None and len(b) >= 100:
            first[b] = min(p, first.get(b, p))
    out = Counter()
    for p, b in payload:
        to = first.get(b)
        again = to is not None and p is not None and p != to
        out[(p, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", to if again else None)] += 1
    return out


def check(spark, df):
    rows = [(r.page_id, r.url, r.html) for r in df.select("page_id", "url", "html").collect()]
    got = warc.archive(spark, df).collect()
    assert all(r.payload_ok for r in got)
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == brute(rows)
    return got


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    copies = pages.where("page_id % 3 = 0").selectExpr("page_id + 1000000 AS page_id", "url", "html")
    got = check(spark, pages.union(copies))
    assert sum(r.record_type == "revisit" for r in got) >= copies.count()


def test_edges(spark):
    big = "<p>é</p>" * 200_000
    data = [
        (5, "http://a/ü\r\nWARC-Type: x", "y" * 100), (3, None, "y" * 100), (9, "", "y" * 100), (1, "u", "y" * 99), (2, "u", "y" * 99), (4, None, None), (6, None, ""),
        (None, "u", "y" * 100), (7, "u", big), (8, "u", big), (3, "again", "y" * 100), (9, "", "y" * 100), (10, "u", "é" * 50), (11, "u", "é" * 50), (12, "u", "a\r\n\r\nWARC/1.1\r\n" * 20),
    ]
    df = spark.createDataFrame([(*d, "x", 1, 2) for d in data], "page_id long, url string, html string, digest string, payload int, refers_to int").repartition(3)
    got = check(spark, df)
    assert {r.url for r in got if r.page_id == 5} == {"http://a/%C3%BC%0D%0AWARC-Type:%20x"}
    assert warc.archive(spark, df.limit(0)).collect() == []


def test_archives_are_plain_gzip_and_rotate(spark):
    folder = new_folder(spark, "warc-test")
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    files = warc.write_archives(warc.resolve(pages), folder, file_bytes=20_000).collect()
    assert len(files) > 3 and sum(f.records for f in files) == pages.count()
    path = files[0].path.removeprefix("file://")
    text = gzip.open(path).read()
    assert text.count(b"WARC/1.1\r\nWARC-Type: ") == files[0].records
    assert {f for f in os.listdir(os.path.dirname(path)) if not f.startswith(".")} == {os.path.basename(f.path) for f in files}
