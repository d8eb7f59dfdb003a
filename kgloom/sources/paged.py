"""Saved answers of a paged interface as a Spark data source.

A folder holds one folder for each owner, `owner=...`, and in it one for each page, `page=0`, `page=1` and so on, with files of one JSON
object a line: {"items": [...], "next": number of the next page or null}. An owner is one partition, as its pages lead from one to
the next; owners are read side by side. Filters on the owner keep others from being opened.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.window import Window

NAME = "saved_pages"
SCHEMA = "owner string, page int, position int, item string"
#: Fixed value: items on a page.
PAGE_ITEMS = 100


class Owner(InputPartition):
    def __init__(self, owner: str, path: str):
        super().__init__(path)
        self.owner, self.path = owner, path


class Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.owners = path, None

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("owner",):
                named = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.owners = named if self.owners is None else self.owners & named
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        where, root = fs.FileSystem.from_uri(self.path)
        found = [(d.base_name.removeprefix("owner="), d.path) for d in where.get_file_info(fs.FileSelector(root)) if d.base_name.startswith("owner=")]
        return [Owner(name, path) for name, path in sorted(found) if self.owners is None or name in self.owners]

    def read(self, partition: Owner) -> Iterator[pa.RecordBatch]:
        where, _ = fs.FileSystem.from_uri(self.path)
        page = 0
        while page is not None:
            folder = f"{partition.path}/page={page}"
            files = [f.path for f in where.get_file_info(fs.FileSelector(folder)) if f.is_file and not f.base_name.startswith(("_", "."))]
            lines = [line for f in sorted(files) for line in where.open_input_file(f).read().decode().splitlines() if line]
            if len(lines) != 1:
                raise ValueError(f"{folder}: {len(lines)} answers")
            answer = json.loads(lines[0])
            items = answer["items"]
            n = len(items)
            yield pa.RecordBatch.from_arrays(
                [pa.array([partition.owner] * n, pa.string()), pa.array([page] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array([json.dumps(x, ensure_ascii=False) for x in items], pa.string())],
                ["owner", "page", "position", "item"],
            )
            page = answer["next"]


class SavedPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return Reader(self.options["path"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """owner, page, position and item (JSON) of all saved pages. A missing page that another one leads to is an error."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SavedPages)
    return spark.read.format(NAME).option("path", path).load()


def save(items: DataFrame, path: str, page_items: int = PAGE_ITEMS) -> None:
    """Writes items (owner, ord, item as JSON) as saved pages."""
    place = F.row_number().over(Window.partitionBy("owner").orderBy("ord")) - 1
    placed = items.withColumn("_at", place).withColumn("page", F.floor(F.col("_at") / page_items).cast("int"))
    pages = placed.groupBy("owner", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_at", "item"))), lambda x: x["item"]), ",").alias("items"))
    more = F.lead("page").over(Window.partitionBy("owner").orderBy("page"))
    line = F.concat(F.lit('{"items":['), "items", F.lit('],"next":'), F.coalesce(more.cast("string"), F.lit("null")), F.lit("}"))
    pages.select("owner", "page", line.alias("value")).write.partitionBy("owner", "page").text(path)
