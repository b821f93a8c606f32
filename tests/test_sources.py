"""Search and pages over HTTP from a server of its own, result folders with diagnostics, vectors from Arrow."""

import http.server
import json
import threading
import urllib.parse

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from claimweave.operators import concepts
from claimweave.sources import blocks, search


class Pages(http.server.BaseHTTPRequestHandler):
    def do_GET(self):
        at = urllib.parse.urlparse(self.path)
        query = urllib.parse.parse_qs(at.query).get("q", [""])[0]
        status, body = 200, ""
        if at.path == "/search":
            body = json.dumps([query, ["One", "Two", "None"], ["first", "second", "x"], [f"http://site.org/{query}/1", "http://site.org/2", ""]])
        elif at.path == "/broken":
            body = "{not json"
        elif at.path == "/page":
            body = "<body><nav>menu</nav><article><p>Grüße &amp; text</p></article></body>"
        else:
            status = 404
        self.send_response(status)
        self.end_headers()
        self.wfile.write(body.encode())

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def site():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_search_source_reads_hits_and_tells_failures(spark, site):
    spark.dataSource.register(search.SearchSource)
    read = lambda endpoint, queries: spark.read.format("claim_search").option("queries", json.dumps(queries)).option("endpoint", endpoint).load().collect()
    rows = read(f"{site}/search?q={{query}}", ["rent control", "é&x"])
    assert sorted((r["query"], r["ord"], r["title"], r["url"]) for r in rows) == sorted((q, i, t, u) for q in ("rent control", "é&x") for i, (t, u) in enumerate([("One", f"http://site.org/{q}/1"), ("Two", "http://site.org/2")]))
    assert [(r["query"], r["url"], r["error"].split(":")[0]) for r in read(f"{site}/broken?q={{query}}", ["a"])] == [("a", None, "no hits in the answer")]
    assert [(r["query"], r["error"].split(":")[0]) for r in read(f"{site}/gone?q={{query}}", ["a"])] == [("a", "HTTPError")]
    assert read(f"{site}/search?q={{query}}", []) == []


def test_hits_of_two_providers_fill_a_short_page(spark, site):
    """S3: where the first provider's page is short, the second's hits follow, each URL once."""
    spark.dataSource.register(search.SearchSource)
    one = spark.read.format("claim_search").option("queries", json.dumps(["q"])).option("endpoint", f"{site}/search?q={{query}}").load().where("error is null")
    two = spark.createDataFrame([("q", 0, "Two again", "http://site.org/2", "s"), ("q", 1, "Three", "http://site.org/3", "s")], "query string, ord int, title string, url string, snippet string")
    merged = blocks.merged_hits(one.drop("error"), two, limit=3)
    assert [r["url"] for r in merged.orderBy("place").collect()] == ["http://site.org/q/1", "http://site.org/2", "http://site.org/3"]
    failed = spark.read.format("claim_search").option("queries", json.dumps(["q"])).option("endpoint", f"{site}/gone?q={{query}}").load().where("error is null")
    assert [r["url"] for r in blocks.merged_hits(failed.drop("error"), two).orderBy("place").collect()] == ["http://site.org/2", "http://site.org/3"]


def test_pages_come_over_http(spark, site):
    hits = spark.createDataFrame([(0, f"{site}/page"), (1, f"{site}/none"), (2, None), (3, "ftp://x")], "page_id int, url string")
    rows = search.fetched_pages(hits)
    got = {r["page_id"]: (r["html"], r["error"]) for r in rows.collect()}
    assert got[1][0] is None and got[1][1].startswith("HTTPError") and got[2] == (None, None) and got[3][1]
    assert {r["page_id"]: r["text"] for r in blocks.main_segments(rows).collect()} == {0: "Grüße & text", 1: "", 2: "", 3: ""}


def test_results_keep_targets_and_diagnostics(spark, tmp_path):
    e = spark.createDataFrame([("a", "is", "b", "s", 0.5)], "s string, rel string, o string, source string, utility double")
    pairs = spark.createDataFrame([("x", "y", 1, True), ("x", "z", 2, False)], "a string, b string, place int, selected boolean").withColumn("rank", F.struct(F.lit(1.5).alias("r0")))
    walks = spark.createDataFrame([("x", "y", ["x", "y"], "endpoint"), ("x", "y", ["x"], "dead")], "seed string, goal string, path array<string>, reason string")
    root = f"{tmp_path}/results"
    blocks.write_results("old", e, e, f"{root}/r1")
    assert [(r["name"], r["target_a"]) for r in blocks.read_results(spark, root).collect()] == [("r1", None)]
    blocks.write_results("new", e, e, f"{root}/r2", ("rent control", "urban sprawl"), pairs, walks)
    assert [(r["name"], r["report"].strip(), r["target_a"], r["target_b"]) for r in blocks.read_results(spark, root).collect()] == [("r2", "new", "rent control", "urban sprawl"), ("r1", "old", None, None)]
    assert [r["value"] for r in spark.read.text(f"{root}/r2/pairs").collect()] == ['* x <-> y rank={"r0":1.5}', '  x <-> z rank={"r0":1.5}']
    assert sorted(json.loads(r["value"])["reason"] for r in spark.read.text(f"{root}/r2/walks").collect()) == ["dead", "endpoint"]


def test_vectors_are_read_alike_from_arrow():
    for rows in ([[3.0, 4.0], [0.0, 0.0]], [[1.0], [1.0, 2.0]], [None, [1.0, 1.0]], [[1.0, None], [2.0, 2.0]], [], [[]]):
        column = pa.array(rows, pa.list_(pa.float64()))
        assert np.array_equal(concepts.arrow_rows(column), concepts.unit_rows(rows))
        assert np.array_equal(concepts.arrow_rows(column.slice(1)), concepts.unit_rows(rows[1:]))
