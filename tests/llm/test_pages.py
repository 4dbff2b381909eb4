"""URL filter, archives and vector search against brute force and round trips."""

import base64
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import topk, urlfilter, warc
from tests.conftest import rows

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "", "block"), ("a.com", "", "allow"), ("a.com", "", "block"), (None, "/", "block"), ("", "/", "block")]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    ends = [rest.find(c) for c in "/?#" if c in rest]
    host, rest = (rest[: min(ends)], rest[min(ends) :]) if ends else (rest, "")
    ends = [rest.find(c) for c in "?#" if c in rest]
    return "".join(c.lower() if c.isascii() else c for c in host), rest[: min(ends)] if ends else rest


def test_urls_are_judged_by_the_longest_rule(spark):
    urls = ["http://Example.ORG/es/1", "http://x.example.org/en/12?q=/es/", "https://example.org", "http://org/", "http://notexample.org/es/", "x", None, "",
            "http://a.com", "http://b.a.com/x#y", "http://a.com.net/", "ftp://com?x://org/", "http:///es/", "http://É.com/p", "http://example.org/es/1"]
    pages = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(urls)], "page_id long, url string, key string, from int")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    want = []
    for i, u in enumerate(urls):
        host, path = split(u)
        fits = [(len(h + p), h + p, v) for h, p, v in RULES if h and host and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        want.append((i, host, path, best and best[1], best[2] if best else "allow", "h"))
    assert sorted(rows(urlfilter.judge(pages, rules), "page_id", "host", "path", "rule", "verdict", "key")) == want
    assert {r.verdict for r in urlfilter.judge(pages, rules.limit(0)).collect()} == {"allow"}
    assert urlfilter.judge(pages.limit(0), rules).count() == 0


@pytest.fixture(scope="module")
def pages(spark):
    html = ["<p>a</p>", "<p>a</p>", None, "", "é\r\n\r\nx", "<p>a</p>", "big " * 5000]
    data = [(10 - i, f"http://h{i % 3}.example.org/p{i}?q={i}#f", h, "x") for i, h in enumerate(html)] + [(None, None, "<p>a</p>", "x"), (99, "bad\r\nurl", "own", "x")]
    return spark.createDataFrame(data, "page_id long, url string, html string, file string")


def test_archives_give_back_every_page(spark, pages):
    folder = warc.archive_folder(pages)
    index = warc.write_archives(pages, folder)
    got = warc.read_archives(index, folder).collect()
    given = [(r.page_id, r.html or "") for r in pages.collect()]
    first = {}
    for page, html in given:
        if page is not None:
            first[html] = min(first.get(html, page), page)
    want = []
    for page, html in given:
        raw = html.encode()
        refers = None if first.get(html) in (None, page) else first[html]
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        want.append((page, len(raw), digest, "response" if refers is None else "revisit", refers, raw if refers is None else None))
    mine = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload and bytes(r.payload) if r.payload else (b"" if r.payload is not None else None)) for r in got]
    assert sorted(mine, key=repr) == sorted(want, key=repr)
    through = warc.lookup(index, folder, pages)  # every page by its URL
    key = lambda r: repr(tuple(r))
    assert sorted(map(key, through.collect())) == sorted(map(key, got))
    none = warc.write_archives(pages.limit(0), folder)
    assert warc.lookup(none, folder, pages).count() == 0 and warc.lookup(index, folder, pages.limit(0)).count() == 0
    assert none.count() == 0 and warc.read_archives(none, folder).count() == 0


def test_lookup_reads_single_records(spark, pages):
    asked = lambda *urls: spark.createDataFrame([(u, 1) for u in urls], "url string, key int")
    folder = warc.archive_folder(pages)
    index = warc.write_archives(pages, folder)
    found = warc.lookup(index, folder, asked("http://h1.example.org/p1?q=1", "http://nobody.example/", "http://h1.example.org/p1?q=1"))
    assert [(r.page_id, r.url) for r in found.collect()] == [(9, "http://h1.example.org/p1?q=1#f")]
    assert [r.page_id for r in warc.lookup(index, folder, asked(None)).collect()] == [None]


def test_captures_of_one_url_span_blocks_and_tasks(spark):
    hot = [(i, "http://hot.example/x", f"<p>{i}</p>") for i in range(2500)]
    rest = [(9000 + i, f"http://h{i}.example/", "long " * 50_000 if i == 7 else "rest") for i in range(600)]
    pages = spark.createDataFrame(hot + rest, "page_id long, url string, html string").repartition(8)
    folder = warc.archive_folder(pages)
    index = warc.write_archives(pages, folder)
    assert index.selectExpr("sum(lines)", "sum(blocks) >= 4").first() == (3100, True)
    found = warc.lookup(index, folder, spark.createDataFrame([("http://hot.example/x#top",), ("http://h7.example/",)], "url string"))
    assert sorted(r.page_id for r in found.select("page_id").collect()) == [*range(2500), 9007]
    assert found.select("page_id").groupBy(F.spark_partition_id()).count().count() > 1  # not one task for the key
    every = warc.lookup(index, folder, pages)
    assert sorted(r.page_id for r in every.select("page_id").collect()) == sorted(p for p, _, _ in hot + rest)


def test_top_k_equals_brute_force(spark):
    rnd = np.random.default_rng(1)
    vectors = [(int(i), [float(x) for x in v]) for i, v in enumerate(rnd.normal(size=(400, 8)).round(2))]
    vectors[30] = (30, vectors[7][1])  # ties
    vectors += [(7, vectors[7][1]), (500, None), (501, [1.0, None] + [0.0] * 6), (502, [float("nan")] * 8), (503, [float("inf")] * 8), (504, [0.5] * 3), (None, [0.5] * 8)]
    data = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(5)
    asked = data.where("vec_id % 20 = 0 or vec_id in (504, 501)")
    fine = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in vectors if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    want = []
    for qid, q in fine:
        if qid % 20 == 0 or qid in (504, 501):
            scored = sorted(((-int(x @ q), i) for i, x in fine if i != qid and len(x) == len(q)))[:5]
            want += [(qid, rank, i, -s) for rank, (s, i) in enumerate(scored, 1)]
    assert sorted(rows(topk.top_k(data, asked, seeds=20), "query_id", "rank", "vec_id", "score")) == sorted(want)
    assert topk.top_k(data.limit(0), asked.limit(0)).count() == 0


def test_bounds_spare_most_rows():
    rnd = np.random.default_rng(2)
    centres = rnd.normal(size=(40, 16)) * 4
    x = np.floor(256 * (centres[rnd.integers(0, 40, 4000)] + 0.1 * rnd.normal(size=(4000, 16)))).astype(np.int64)
    import pyarrow as pa

    block = lambda n: pa.table({"id": pa.array(range(n)), "v": pa.array(list(x[:n]), pa.list_(pa.int64()))})
    group = topk._prepare(block(20), block(500), 5, 24)[0]
    best = topk.Best(20, 5)
    evaluated = topk.search_block(np.arange(4000), x, group, best)
    assert evaluated < 0.3 * 20 * 4000
    for i in range(20):
        scores = x @ x[i]
        order = [j for j in np.lexsort((np.arange(4000), -scores)) if j != i][:5]
        assert best.ids[i].tolist() == order
