"""A source whose partitions are the pages of a list: each page is fetched by the task that reads it, with retries, up to the list's end."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from talus.operators import rank

#: Rows of a page and pages of a list, at most, where options don't say.
PER_PAGE, MOST = 200, 100


class Page(InputPartition):
    def __init__(self, number: int):
        super().__init__(number)
        self.number = number


class PagedReader(DataSourceReader):
    """Reads pages 1, 2 and so on of a list: as many as its length asks for, most at most."""

    def __init__(self, source: PagedSource):
        self.source, self.each = source, int(source.options.get("per_page", PER_PAGE))
        self.most, self.tries, self.wait = int(source.options.get("most", MOST)), int(source.options.get("tries", 3)), float(source.options.get("wait", 0.2))

    def partitions(self) -> list[InputPartition]:
        n = self.fetched(lambda: self.source.length())
        return [Page(k) for k in range(1, min(self.most, -(-n // self.each)) + 1)]

    def fetched(self, get):
        """What get gives; an error is met by waiting longer each time, and the last one is raised."""
        for k in range(self.tries):
            try:
                return get()
            except OSError:
                if k + 1 == self.tries:
                    raise
                time.sleep(self.wait * 2**k)

    def read(self, partition: InputPartition | None) -> Iterator[tuple]:
        if partition is None:  # an empty list has no pages
            return
        names = self.source.schema().fieldNames()
        # an empty page is the end of the list, even where its length said otherwise
        for row in self.fetched(lambda: self.source.page(partition.number)):
            yield tuple(row.get(c) for c in names)


class PagedSource(DataSource):
    """Format talus_pages: options path, fields (a schema as JSON), per_page, most, tries, wait.

    A page is a folder page=k of JSON lines below path, and count.json there says how long the list is. A source that asks a
    service overrides length and page.
    """

    @classmethod
    def name(cls) -> str:
        return "talus_pages"

    def schema(self) -> StructType:
        return StructType.fromJson(json.loads(self.options["fields"]))

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagedReader(self)

    def _at(self, name: str):
        files, path = fs.FileSystem.from_uri(self.options["path"])
        return files, f"{path}/{name}"

    def _lines(self, name: str) -> Iterator[dict]:
        files, at = self._at(name)
        for info in files.get_file_info(fs.FileSelector(at, allow_not_found=True)):
            if info.base_name.endswith(".json"):
                with files.open_input_stream(info.path) as f:
                    yield from (json.loads(line) for line in f.read().decode().splitlines() if line)

    def length(self) -> int:
        return sum(x["n"] for x in self._lines("count"))

    def page(self, number: int) -> list[dict]:
        return list(self._lines(f"page={number}"))


def write_pages(rows: DataFrame, path: str, each: int, *order) -> None:
    """Writes rows as the pages of a list in an order, and how many there are."""
    placed = rank.places(rows, "_place", *order)
    paged = placed.withColumn("page", F.floor((F.col("_place") - 1) / each) + 1).drop("_place")
    paged.repartition("page").write.partitionBy("page").json(path)
    rows.agg(F.count("*").alias("n")).write.json(f"{path}/count")


def read_pages(spark: SparkSession, path: str, fields: str, each: int = PER_PAGE, most: int = MOST, source: type[PagedSource] = PagedSource) -> DataFrame:
    """The rows of all pages of the list at path; fields as DDL."""
    spark.dataSource.register(source)
    return spark.read.format(source.name()).option("path", path).option("fields", StructType.fromDDL(fields).json()).option("per_page", str(each)).option("most", str(most)).load()
