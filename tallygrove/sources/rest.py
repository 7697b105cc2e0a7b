"""A paged REST interface as a Spark data source; each page is read in a task of its own, with retries."""

from __future__ import annotations

import json
import time
import urllib.request

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _Page(InputPartition):
    def __init__(self, offset: int):
        self.offset = offset


class PagedReader(DataSourceReader):
    def __init__(self, options):
        self.url = options["url"]
        self.step, self.total = int(options.get("limit", 100)), int(options.get("total", 100))
        self.tries, self.pause = int(options.get("retries", 3)), float(options.get("pause", 1.0))

    def partitions(self):
        return [_Page(i) for i in range(0, self.total, self.step)]

    def read(self, page):
        url = self.url.format(offset=page.offset, limit=self.step)
        for attempt in range(self.tries):
            try:
                with urllib.request.urlopen(url, timeout=60) as answer:  # noqa: S310
                    text = answer.read().decode("utf-8", "replace")
                json.loads(text)
                yield page.offset, url, text
                return
            except (OSError, ValueError):
                if attempt + 1 == self.tries:
                    raise
                time.sleep(self.pause * 2**attempt)


class PagedSource(DataSource):
    """spark.read.format("paged_rest").options(url=".../bugs?offset={offset}&limit={limit}", total=1000).load()"""

    @classmethod
    def name(cls):
        return "paged_rest"

    def schema(self):
        return "offset long, url string, json string"

    def reader(self, schema):
        return PagedReader(self.options)


def register(spark) -> None:
    spark.dataSource.register(PagedSource)
