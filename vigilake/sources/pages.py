"""Paged feeds as a Python data source: the page number is the cursor (SRC-01, SRC-03).

A feed's answers lie in a folder, `page=0`, `page=1`, ... of Parquet files, as a
downloader leaves them. A stream reads each page once, a task for each page or run of
pages, and its checkpoint holds the cursor; nothing is fetched in the driver, and a page that was read
is never opened again. `lay_out` cuts a table of records into such pages in one pass.

    spark.dataSource.register(PagedFeed)
    spark.readStream.format("paged_feed").option("path", folder).load()
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from vigilake.operators.order import running
from vigilake.session import ship

#: About as many tasks as a batch of a stream has; each then reads a run of pages.
TASKS = 256
SCHEMA = "page long, place long, record_id string, payload string, modified_at timestamp_ntz"


def _folder(path: str):
    """The file system of a folder and the folder's own path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def pages_of(path: str) -> list[int]:
    """Numbers of the pages that are there, in order."""
    from pyarrow import fs

    system, root = _folder(path)
    found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted(int(f.base_name.removeprefix("page=")) for f in found if f.base_name.startswith("page="))


@dataclass
class Page(InputPartition):
    """Pages from `number` and before `upto`; one page where `upto` is not given."""

    number: int
    upto: int | None = None


class _Pages:
    """Reads one page as Arrow batches; a page that is gone is an error, not an empty one."""

    def __init__(self, path: str):
        self.path = path

    def read(self, partition: Page | None) -> Iterator:
        if partition is None:  # how Spark reads a source that has no partitions
            return
        import pyarrow as pa
        from pyarrow import fs
        from pyarrow import parquet

        system, root = _folder(self.path)
        kinds = [("place", pa.int64()), ("record_id", pa.string()), ("payload", pa.string()), ("modified_at", pa.timestamp("us"))]
        for number in range(partition.number, partition.upto or partition.number + 1):
            files = [f.path for f in system.get_file_info(fs.FileSelector(f"{root}/page={number}")) if f.base_name.endswith(".parquet")]
            for file in sorted(files):
                with system.open_input_file(file) as f:
                    rows = parquet.ParquetFile(f).read(columns=[name for name, _ in kinds])
                columns = [pa.array([number] * len(rows), pa.int64()), *[rows[name].cast(kind) for name, kind in kinds]]
                yield from pa.table(columns, names=["page", *[name for name, _ in kinds]]).to_batches()


class PageReader(_Pages, DataSourceReader):
    def partitions(self) -> Sequence[Page]:
        return [Page(n) for n in pages_of(self.path)]


class PageStreamReader(_Pages, DataSourceStreamReader):
    """Offsets are {"page": n}, the first page that is not read yet."""

    def initialOffset(self) -> dict:
        return {"page": 0}

    def latestOffset(self) -> dict:
        upto = 0
        for n in pages_of(self.path):
            if n != upto:  # a page is missing: later ones wait for it
                break
            upto = n + 1
        return {"page": upto}

    def partitions(self, start: dict, end: dict) -> Sequence[Page]:
        first, last = start["page"], end["page"]
        run = max(1, (last - first) // TASKS)
        return [Page(n, min(n + run, last)) for n in range(first, last, run)]

    def commit(self, end: dict) -> None:
        """Pages stay where they are; the checkpoint alone says what is read."""


class PagedFeed(DataSource):
    """Option `path`: the folder of pages. An empty or missing folder has no rows."""

    @classmethod
    def name(cls) -> str:
        return "paged_feed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return PageReader(self.options["path"])

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return PageStreamReader(self.options["path"])


def lay_out(records: DataFrame, order: list[str], size: int, path: str, first: int = 0) -> int:
    """Writes (record_id, payload, modified_at) as pages of `size` records in `order`,
    whose last column is unique; pages begin at `first`, and so do places at
    first * size. Returns the number of the page after the last. One sort by ranges,
    however many pages; a page is written by one task."""
    placed = running(records.withColumn("one_", F.lit(1)), order, {"place": "one_"})
    rows = placed.select((F.floor(F.col("place") / size) + first).alias("page"), (F.col("place") + first * size).alias("place"), "record_id", "payload", "modified_at")
    rows.repartition("page").sortWithinPartitions("page", "place").write.mode("append").partitionBy("page").parquet(path)
    return len(pages_of(path))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    ship(spark)
    spark.dataSource.register(PagedFeed)
    return spark.read.format("paged_feed").option("path", path).load()


def stream_pages(spark: SparkSession, path: str) -> DataFrame:
    ship(spark)
    spark.dataSource.register(PagedFeed)
    return spark.readStream.format("paged_feed").option("path", path).load()
