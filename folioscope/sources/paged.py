"""A paged HTTP API as a Spark source: each page is a partition, read by an executor."""

from __future__ import annotations

import importlib
import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def fetch_json(url: str, tries: int = 3) -> dict:
    """One page over HTTP; busy answers (429, 5xx) are asked for again."""
    for k in range(tries):
        try:
            with urllib.request.urlopen(url, timeout=60) as answer:
                return json.loads(answer.read())
        except urllib.error.HTTPError as e:
            if k + 1 == tries or not (e.code == 429 or e.code >= 500):
                raise
            time.sleep(2**k)
    raise AssertionError("not reached")


class PagedApi(DataSource):
    """Options: url (with {page}), first, last (page numbers), rows (the key of a page's list; "data"), fetch
    ("module:function" that takes an address and gives the page; HTTP by default). A schema must be given."""

    @classmethod
    def name(cls) -> str:
        return "paged_api"

    def schema(self) -> str:
        raise ValueError("paged_api needs a schema")

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options, schema)


class PagedReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.url, self.rows = options["url"], options.get("rows", "data")
        self.pages = range(int(options.get("first", 1)), int(options["last"]) + 1)
        self.fetch, self.names = options.get("fetch"), schema.names

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.pages]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        get = fetch_json
        if self.fetch:
            module, _, function = self.fetch.partition(":")
            get = getattr(importlib.import_module(module), function)
        for row in get(self.url.replace("{page}", str(partition.value))).get(self.rows) or []:
            yield tuple(row.get(n) for n in self.names)


def register_paged_api(spark: SparkSession) -> None:
    spark.dataSource.register(PagedApi)
