"""PDFs as a Spark data source: spark.read.format(NAME), partitions of files and page ranges, filters on pages and files pushed to the parser."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from leafmark.sources.pdf import PARSED

NAME = "leafmark_pdf"
COLUMNS = ("doc_id", "page", "width", "height", "runs", "ops", "error")
RUN_FIELDS, OP_FIELDS = ("text", "a", "b", "c", "d", "e", "f", "width"), ("name", "w", "h")


@dataclass
class Pages(InputPartition):
    """Pages first to last of a file; last None: to its end."""

    path: str
    first: int
    last: int | None
    only: frozenset[int] | None


def _files(path: str) -> list[str]:
    from pyarrow import fs

    if "://" not in path:
        import os

        path = os.path.abspath(path)
    system, at = fs.FileSystem.from_uri(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.File:
        return [path]
    if info.type != fs.FileType.Directory:
        raise FileNotFoundError(path)
    base = path.removesuffix(at) if path.endswith(at) else ""
    found = system.get_file_info(fs.FileSelector(at, recursive=True))
    return sorted(base + f.path for f in found if f.type == fs.FileType.File and f.base_name.lower().endswith(".pdf"))


class _Reader(DataSourceReader):
    def __init__(self, options: dict, parse: Callable[[bytes, int, int | None], Iterable[dict]]):
        if "path" not in options:
            raise ValueError("a path is needed")
        self.path, self.parse, self.step = options["path"], parse, int(options.get("pages_per_task", "64"))
        self.first, self.last, self.only, self.files, self.of_pages = 1, None, None, None, False

    def _narrow(self, first: int | None = None, last: int | None = None, only: set | None = None) -> None:
        self.of_pages = True
        self.first = max(self.first, first) if first is not None else self.first
        self.last = last if self.last is None else self.last if last is None else min(self.last, last)
        if only is not None:
            self.only = frozenset(only) if self.only is None else self.only & only

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802 Spark's name
        for f in filters:
            if f.attribute == ("page",) and isinstance(f, EqualTo):
                self._narrow(only={f.value})
            elif f.attribute == ("page",) and isinstance(f, In):
                self._narrow(only=set(f.value))
            elif f.attribute == ("page",) and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self._narrow(first=f.value + isinstance(f, GreaterThan))
            elif f.attribute == ("page",) and isinstance(f, (LessThan, LessThanOrEqual)):
                self._narrow(last=f.value - isinstance(f, LessThan))
            elif f.attribute == ("doc_id",) and isinstance(f, (EqualTo, In)):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.files = asked if self.files is None else self.files & asked
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        files = [f for f in _files(self.path) if self.files is None or f in self.files]
        first, last = self.first, self.last
        if self.only is not None:
            pages = sorted(p for p in self.only if p is not None and p >= first and (last is None or p <= last))
            if not pages:
                return []
            first, last = pages[0], pages[-1]
        if last is None:
            return [Pages(f, first, None, None) for f in files]
        return [Pages(f, a, min(last, a + self.step - 1), self.only) for f in files for a in range(first, last + 1, self.step) if self.only is None or any(a <= p < a + self.step for p in self.only)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        from pyarrow import fs

        try:
            system, at = fs.FileSystem.from_uri(partition.path)
            with system.open_input_file(at) as file:
                content = file.read()
            for page in self.parse(content, partition.first, partition.last):
                if partition.only is None or page["page"] in partition.only:
                    runs, ops = ([tuple(x.get(c) for c in names) for x in page.get(what) or ()] for what, names in (("runs", RUN_FIELDS), ("ops", OP_FIELDS)))
                    yield tuple({"error": None, **page, "doc_id": partition.path, "runs": runs, "ops": ops}.get(c) for c in COLUMNS)
        except Exception as e:  # noqa: BLE001 a broken file is a row, not the end of the job
            if not self.of_pages:  # a filter on pages is one on pages that there are
                yield (partition.path, None, None, None, None, None, f"PDF_OPEN: {e}")


def register(spark: SparkSession, parse: Callable[[bytes, int, int | None], Iterable[dict]], name: str = NAME) -> None:
    """Registers the source `name`: spark.read.format(name).option("pages_per_task", 64).load(path), columns as of pdf.read_pdfs.

    parse(content, first, last) gives a dictionary for each page of a file from first to last (None: to its end) that
    the file has, as pdf.read_pdfs describes it. A file is a partition; with an upper bound of pages, from a filter, a
    range of `pages_per_task` pages of a file is one. Filters on page and doc_id are pushed to the parser and the list
    of files. A file that can't be parsed has one row with its error and a null page, which a filter on pages leaves
    out. Files are opened by tasks through pyarrow; for stores that only Spark can read there is pdf.read_pdfs.
    """

    class Pdf(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return PARSED

        def reader(self, schema) -> DataSourceReader:
            return _Reader(self.options, parse)

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Pdf)
