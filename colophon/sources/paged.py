"""A paged search interface as a Spark data source, over recorded answers.

    register(spark)
    spark.read.format("paged_works").option("folder", f).option("top_k", 70).option("year_min", 2000).load()

Answers are text files of JSON works below ``folder/query=<n>/``.  Each query is a partition, whose
task asks page after page, each of ``top_k`` works or 50 at most, until it has enough or a page is
short.  Without ``top_k`` all pages are read, and then filters on ``year`` go to the
interface itself; with it they do not, since a filter behind the best k is not the best k of a filter.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

# Fixed values of the interface: works on a page, and the years where one side of a range is not given.
PAGE, FIRST_YEAR, LAST_YEAR = 50, 1991, 2030
SCHEMA = "query long, page int, place int, id string, title string, year int, cited long, total long"
_ARROW = pa.schema([("query", pa.int64()), ("page", pa.int32()), ("place", pa.int32()), ("id", pa.string()), ("title", pa.string()), ("year", pa.int32()), ("cited", pa.int64()), ("total", pa.int64())])


class Recorded:
    """The interface's side: one query's works in their order, by page and years."""

    def __init__(self, folder: str):
        where, path = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        lines = []
        for f in where.get_file_info(fs.FileSelector(path)):
            if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")):
                with where.open_input_stream(f.path, compression=None) as stream:
                    lines += stream.read().decode().splitlines()
        self.works = sorted((json.loads(x) for x in lines if x), key=lambda w: w["rank"])

    def answer(self, page: int, size: int, years: tuple[int, int] | None) -> dict:
        found = [w for w in self.works if years is None or years[0] <= (w.get("publication_year") or 0) <= years[1]]
        return {"meta": {"count": len(found)}, "results": found[(page - 1) * size : page * size]}


def asked(source: Recorded, top_k: int | None, start: int, years: tuple[int, int] | None) -> Iterator[tuple[int, int, dict, int]]:
    """(page, place, work, total): the pages from ``start`` on, until there are ``top_k`` works or no more.

    Works that are no objects, or have no title, count as delivered and are left out.
    """
    size = min(top_k or PAGE, PAGE)
    page, place, need = start // size + 1, 0, top_k
    while need is None or need > 0:
        answer = source.answer(page, size, years)
        works = answer["results"]
        for work in works if need is None else works[:need]:
            place += 1
            if isinstance(work, dict) and (work.get("title") or "").strip():
                yield page, place, work, int(answer["meta"]["count"])
        if len(works) < size:
            break
        need = None if need is None else need - len(works)
        page += 1


class _Query(InputPartition):
    def __init__(self, number: int, folder: str):
        super().__init__(number)
        self.number, self.folder = number, folder


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.start = options["folder"], int(options.get("start", 0))
        self.top_k = int(options["top_k"]) if "top_k" in options else None
        low, high = options.get("year_min"), options.get("year_max")
        self.years = (int(low or FIRST_YEAR), int(high or LAST_YEAR)) if low or high else None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if self.top_k is not None or getattr(f, "attribute", None) != ("year",) or not isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                yield f
                continue
            low, high = self.years or (1, 9999)  # a work without a year passes no filter on it
            if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                low = max(low, f.value + isinstance(f, GreaterThan))
            if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                high = min(high, f.value - isinstance(f, LessThan))
            self.years = low, high

    def partitions(self) -> list[InputPartition]:
        where, path = fs.FileSystem.from_uri(self.folder) if "://" in self.folder or self.folder.startswith("file:") else (fs.LocalFileSystem(), self.folder)
        names = [f.base_name for f in where.get_file_info(fs.FileSelector(path)) if f.type == fs.FileType.Directory]
        return [_Query(int(n.partition("=")[2]), f"{self.folder}/{n}") for n in sorted(names) if n.startswith("query=")]

    def read(self, partition: _Query) -> Iterator[pa.RecordBatch]:
        rows = [(partition.number, page, place, w.get("id"), w["title"].strip(), w.get("publication_year"), w.get("cited_by_count"), total) for page, place, w, total in asked(Recorded(partition.folder), self.top_k, self.start, self.years)]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(_ARROW), _ARROW, strict=True)], schema=_ARROW)


class PagedWorks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_works"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the source known to the session, and lets it take filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedWorks)
