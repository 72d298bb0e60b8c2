import gzip
import hashlib
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from waymark.llm import queries, warc

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 8, 13])
def test_loser_tree_merges(k):
    rng = random.Random(k)
    runs = [sorted((rng.randrange(9), i) for _ in range(rng.randrange(12))) for i in range(k)]
    assert list(warc.merged(runs)) == sorted(x for r in runs for x in r)


def test_url_keys():
    assert warc.url_key("https://WWW.Example.com:443/A?b#c") == "com,example,www)/a?b"
    assert [warc.url_key(u) for u in (None, "", "no url", "http://[bad", "http://a.b:99999/")] == ["", "", "no url", "http://[bad", "http://a.b:99999/"]


def brute(pages):
    first = {}
    for p, html in pages:
        body = (html or "").encode()
        if len(body) >= 100 and p is not None:
            first[body] = min(first.get(body, p), p)
    out = []
    for p, html in pages:
        body = (html or "").encode()
        f = first.get(body)
        revisit = f is not None and f != p
        out.append((p, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", f if revisit else None))
    return sorted(out, key=str)


def test_query_against_brute_force(spark):
    pages = [(r.page_id, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    got = sorted((tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in queries.op5_warc(spark, SF).collect()), key=str)
    assert got == brute(pages)


def test_odd_pages_and_index_order(spark, tmp_path):
    same, other = "x" * 100, "é" * 60
    rows = [(1, "http://b.org/", same), (5, "http://a.org/z", same), (3, None, same), (2, "http://a.org/\r\nX: y", "x" * 99), (4, "http://a.org/", "x" * 99)]
    rows += [(None, "http://a.org/", same), (None, "?", None), (7, "http://c.org", ""), (8, "u", other), (9, "u", other), (9, "u", other)]
    rows += [(100 + i, f"http://h{i % 7}.com/{i % 3}", f"page {i % 40} " * 20) for i in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5).selectExpr("*", "1 as digest", "2 as ts")
    index, root = warc.archive_pages(df, F.lit("20240101000000"), root=str(tmp_path / "w"))
    read = warc.with_position(warc.read_archives(index, root), index).collect()
    got = sorted((tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in read), key=str)
    assert sorted(r.position for r in read) == list(range(len(rows)))
    assert got == brute([(p, h) for p, _, h in rows])
    order = index.orderBy("part", "pos").select("url_key", "ts", "order_id").collect()
    assert order == sorted(order) and len(order) == len(rows)
    files = {r.file for r in index.collect()}
    assert sum(gzip.decompress(Path(root, f).read_bytes()).count(b"WARC/1.1\r\n") for f in files) == len(rows)
    empty, root = warc.archive_pages(df.where("false"), F.lit("20240101000000"), root=str(tmp_path / "e"))
    assert warc.read_archives(empty, root).count() == 0


def test_files_roll(spark, tmp_path):
    df = spark.range(50).selectExpr("id as page_id", "concat('http://x.org/', id) as url", "repeat(cast(id as string), 200) as html").coalesce(1)
    decided = warc.decide(df, "page_id", "url", "html", F.lit("20240101000000"), 100)
    runs = warc.write_archives(decided, str(tmp_path), roll_bytes=1000)
    assert runs.select("run").distinct().count() > 3
    assert warc.merge_index(runs, range_rows=10).count() == 50
