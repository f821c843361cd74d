"""Paged sources as a Spark format: each page is a partition, read by a task that tries again.

An injected ``fetch`` gives the rows of a page by its number and may fail; a page that fails is tried again, ``attempts``
times in all, and begins anew each time, so no row of a broken read is given out twice. A lost task reads its page again. As a
stream, pages are taken in order; the next page's number is the offset, so a query that starts again goes on behind the last
page that it has committed.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

Fetch = Callable[[int], Iterable[tuple]]


class Page(InputPartition):
    def __init__(self, number: int):
        super().__init__(number)
        self.number = number


def whole_page(fetch: Fetch, number: int, attempts: int, wait: float) -> list[tuple]:
    """All rows of a page; waits twice as long after each failure."""
    for k in range(attempts):
        try:
            return list(fetch(number))
        except Exception:
            if k + 1 == attempts:
                raise
            time.sleep(wait * 2**k)
    raise ValueError("a page is tried once at least")


def source(name_: str, schema_: str, fetch: Fetch, pages: Callable[[], int], attempts: int = 3, wait: float = 0.1, most: int = 16) -> type[DataSource]:
    """A format of this name; ``pages`` tells how many pages there are now, and a stream takes ``most`` of them at a time."""

    class Reader(DataSourceReader):
        def partitions(self) -> list[Page]:
            return [Page(i) for i in range(pages())]

        def read(self, partition: Page) -> Iterator[tuple]:
            yield from whole_page(fetch, partition.number, attempts, wait)

    class Stream(DataSourceStreamReader):
        def __init__(self) -> None:
            self.at = 0

        def initialOffset(self) -> dict:  # noqa: N802
            return {"page": 0}

        def latestOffset(self) -> dict:  # noqa: N802
            self.at = min(pages(), self.at + most)
            return {"page": self.at}

        def partitions(self, start: dict, end: dict) -> list[Page]:
            self.at = max(self.at, end["page"])
            return [Page(i) for i in range(start["page"], end["page"])]

        def read(self, partition: Page) -> Iterator[tuple]:
            yield from whole_page(fetch, partition.number, attempts, wait)

        def commit(self, end: dict) -> None:
            self.at = max(self.at, end["page"])

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name_

        def schema(self) -> str:
            return schema_

        def reader(self, schema: object) -> DataSourceReader:
            return Reader()

        def streamReader(self, schema: object) -> DataSourceStreamReader:  # noqa: N802
            return Stream()

    return Source


def read(spark: SparkSession, format_: type[DataSource]) -> DataFrame:
    spark.dataSource.register(format_)
    return spark.read.format(format_.name()).load()


def stream(spark: SparkSession, format_: type[DataSource]) -> DataFrame:
    spark.dataSource.register(format_)
    return spark.readStream.format(format_.name()).load()


def part_files(uri: str, columns: tuple[str, ...]) -> Fetch:
    """Pages of JSON lines in folders ``page=0``, ``page=1`` and so on, in any store that pyarrow opens; a page without a
    folder has no rows."""

    def fetch(number: int) -> Iterator[tuple]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(f"{uri}/page={number}")
        for info in sorted(store.get_file_info(fs.FileSelector(path, allow_not_found=True)), key=lambda f: f.path):
            if not info.base_name.startswith(("_", ".")):
                with store.open_input_stream(info.path) as f:
                    for line in f.read().decode().split("\n"):
                        if line.strip():
                            row = json.loads(line)
                            yield tuple(row.get(c) for c in columns)

    return fetch
