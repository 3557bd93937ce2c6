"""A Python Data Source for paged external feeds.

`ReplaySource` reads recorded pages (JSON lines of query, page, body) from a folder all executors share,
one partition a (query, page); a live source overrides `fetch` and keeps the rest: partitions, deadline and
the empty scan of a source without its key."""

from __future__ import annotations

import io
import json
import time
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "query string, page int, body string, error string"


class Page(InputPartition):
    def __init__(self, query: str, page: int):
        super().__init__(f"{query}|{page}")
        self.query, self.page = query, page


class ReplayReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.deadline = float(options.get("deadline_seconds", "12"))

    def partitions(self) -> list[Page]:
        if self.options.get("enabled", "true") != "true":
            return [Page("", 0)]
        queries = json.loads(self.options.get("queries", "[]"))
        return [Page(q, p) for q in queries for p in range(1, int(self.options.get("pages", "1")) + 1)] or [Page("", 0)]

    def fetch(self, query: str, page: int, until: float) -> str | None:
        """The page's body, or TimeoutError once the monotonic clock is past `until`."""
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(self.options["path"])
        with files.open_input_stream(base) as f:
            for line in io.BufferedReader(f):  # line by line, only as far as the page
                if time.monotonic() >= until:
                    raise TimeoutError
                row = json.loads(line)
                if row["query"] == query and row["page"] == page:
                    return row["body"]
        return None

    def read(self, partition: Page) -> Iterator[tuple]:
        """The page's body, or its error as a row: a failed or late page costs its rows, not the scan."""
        if not partition.page:
            return
        try:
            body = self.fetch(partition.query, partition.page, time.monotonic() + self.deadline)
        except TimeoutError:
            yield partition.query, partition.page, None, "deadline"
            return
        except (OSError, ValueError) as e:
            yield partition.query, partition.page, None, type(e).__name__
            return
        if body is not None:
            yield partition.query, partition.page, body, None


class ReplaySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sieveline_replay"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ReplayReader:
        return ReplayReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ReplaySource)
