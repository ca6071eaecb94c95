"""A source of pages: landed answers of a paged service, one partition per page, and offsets for streams.

A page is a folder ``page=<k>`` of JSON lines, as ``land_pages`` and any Spark writer with ``partitionBy("page")`` leave it. As a batch all
pages are read in parallel; the first page that is short (fewer than ``size`` records) or missing ends them, as with the
service itself. As a stream the offset is the page and the records read of it, so a restart repeats nothing, and a short
page that is landed again with more records goes on where it was left.

    spark.dataSource.register(PagedSource)
    spark.read.format("lodestar-pages").option("path", folder).option("size", 1000).schema("id long, name string").load()
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType


def land_pages(df: DataFrame, place: Column, size: int, folder: str) -> None:
    """Write rows as pages; ``place``: the row's number from 0 in the order of the service."""
    df.withColumn("page", F.floor(place / size)).withColumn("_p", place % size).repartition("page").sortWithinPartitions("page", "_p").drop("_p").write.mode("overwrite").partitionBy("page").json(folder)


def _open(path: str):
    """The file system of a path, and the path on it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _lines(folder: str, page: int) -> list[str] | None:
    """The records of a page in the order of its files; ``None`` where it isn't landed."""
    from pyarrow import fs

    system, root = _open(folder.replace("file:///", "/").replace("file:/", "/"))
    found = system.get_file_info(fs.FileSelector(f"{root}/page={page}", allow_not_found=True))
    files = sorted(f.path for f in found if f.is_file and f.base_name.endswith(".json"))
    if not files:
        return None
    return [line for f in files for line in system.open_input_stream(f).read().decode().split("\n") if line.strip()]


class Page(InputPartition):
    """Records of one page from one on, up to another (``None``: all)."""

    def __init__(self, page: int, first: int = 0, last: int | None = None):
        self.page, self.first, self.last = page, first, last


class _Pages:
    def __init__(self, options: dict, schema: StructType):
        if "path" not in options or "size" not in options:
            raise ValueError("pages need the options path and size")
        self.folder, self.size, self.fields = options["path"], int(options["size"]), [(f.name, f.dataType.typeName()) for f in schema]

    def landed(self, first: int = 0) -> list[int]:
        """Records of the pages from ``first`` on, up to the first short one."""
        counts: list[int] = []
        while (lines := _lines(self.folder, first + len(counts))) is not None:
            counts.append(len(lines))
            if len(lines) < self.size:
                break
        return counts

    def read(self, partition: Page) -> Iterator[tuple]:
        for line in (_lines(self.folder, partition.page) or [])[partition.first : partition.last]:
            record = json.loads(line)
            yield tuple(_typed(record.get(n), t) for n, t in self.fields)


def _typed(value, kind: str):
    if value is None:
        return None
    if kind in ("double", "float"):
        return float(value)
    if kind in ("long", "integer", "short", "byte"):
        return int(value)
    if kind == "string":
        return value if isinstance(value, str) else json.dumps(value)
    return value


class PagedReader(_Pages, DataSourceReader):
    def partitions(self) -> list[Page]:
        return [Page(k) for k in range(len(self.landed()))] or [Page(0)]


class PagedStreamReader(_Pages, DataSourceStreamReader):
    """Offsets: ``page`` and the ``records`` of it that were read."""

    def __init__(self, options: dict, schema: StructType):
        super().__init__(options, schema)
        self.at = (0, 0)

    def initialOffset(self) -> dict:
        return {"page": 0, "records": 0}

    def latestOffset(self) -> dict:
        counts = self.landed(self.at[0])
        if counts:
            self.at = (self.at[0] + len(counts) - 1, counts[-1])
        return {"page": self.at[0], "records": self.at[1]}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        out = []
        for k in range(start["page"], end["page"] + 1):
            first, last = start["records"] if k == start["page"] else 0, end["records"] if k == end["page"] else None
            if last is None or last > first:
                out.append(Page(k, first, last))
        return out

    def commit(self, end: dict) -> None:
        self.at = max(self.at, (end["page"], end["records"]))


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lodestar-pages"

    def schema(self) -> str:
        raise ValueError("give the schema of the records")

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagedReader(self.options, schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return PagedStreamReader(self.options, schema)
