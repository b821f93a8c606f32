"""Search hits and pages over HTTP, for clusters with a network: a Python data source, and a page fetch.

spark.dataSource.register(SearchSource); spark.read.format("claim_search").option("queries", json list)
.option("endpoint", URL with {query}).load(). Any JSON endpoint that answers [query, titles,
snippets, urls] (the OpenSearch form) will do. What fails gives a row with the reason in error and
nothing else but its query or URL, so no result is incomplete without a word.
"""

from __future__ import annotations

import json
import urllib.parse
import urllib.request
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "query string, ord int, title string, url string, snippet string, error string"


def parse_hits(query: str, body: str) -> list[tuple]:
    """Hits of an OpenSearch answer; anything else gives one row with an error."""
    try:
        _, titles, snippets, urls = json.loads(body)[:4]
        return [(query, i, str(t), str(u), str(s), None) for i, (t, s, u) in enumerate(zip(titles, snippets, urls, strict=False)) if u]
    except (ValueError, TypeError, LookupError) as error:
        return [(query, None, None, None, None, f"no hits in the answer: {error}")]


def over_http(url: str, timeout: float) -> str:
    with urllib.request.urlopen(url, timeout=timeout) as answer:
        return answer.read().decode("utf-8", "replace")


def fetched_pages(hits: DataFrame, fetch: Callable[[str, float], str] = over_http, timeout: float = 3.0) -> DataFrame:
    """Hits (with url) with html and error: each page fetched once a task, failures as text in error.

    Null and empty URLs are not fetched: null html, no error. fetch(url, timeout) gives the page.
    """
    schema = StructType([*hits.schema.fields, StructField("html", StringType()), StructField("error", StringType())])
    at = hits.columns.index("url")

    def run(batches):
        for batch in batches:
            pages, errors = [], []
            for url in batch.column(at).to_pylist():
                page = error = None
                if url:
                    try:
                        page = fetch(url, timeout)
                    except Exception as e:  # whatever a page does must not end the crawl; it is told in its row
                        error = f"{type(e).__name__}: {e}"
                pages.append(page)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pages, pa.string()), pa.array(errors, pa.string())], names=schema.names)

    return hits.mapInArrow(run, schema)


class SearchSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "claim_search"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return SearchReader(self.options)


class SearchReader(DataSourceReader):
    def __init__(self, options):
        self.queries, self.endpoint = json.loads(options.get("queries", "[]")), options.get("endpoint", "")
        self.timeout = float(options.get("timeout", "5"))

    def partitions(self):
        return [InputPartition(q) for q in self.queries]

    def read(self, partition):
        if partition is None:  # no queries
            return
        try:
            body = over_http(self.endpoint.format(query=urllib.parse.quote(partition.value)), self.timeout)
        except (OSError, ValueError) as error:
            yield partition.value, None, None, None, None, f"{type(error).__name__}: {error}"
            return
        yield from parse_hits(partition.value, body)
