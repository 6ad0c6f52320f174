"""An archive of vendor files as a Python data source that opens only the files whose names match.

A file's name says its symbol and day. The source has a row per line of each file, with both as columns; filters on them are pushed into the reader, which
lists the archive's names, leaves out those that can't match and deals the others to partitions by size. What is left out is never opened. The
archive may be in any file system that Arrow reads (a path, file://, s3://, gs://, hdfs://).

    archive_lines(spark, root, "spot").where("symbol = 'BTCUSDT' and day >= date'2024-01-01'")
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from marlstone.shipping import ship_package

#: Name patterns of the kinds of files. Their groups are the symbol and the day.
NAMES = {
    "spot": r"spot-klines-([A-Z0-9]+)-1h-(\d{4}-\d{2}-\d{2})\.csv$",
    "derivative": r"coinm-klines-([A-Z0-9_]+)-1h-(\d{4}-\d{2}-\d{2})\.csv$",
    "metrics": r"coinm-metrics-([A-Z0-9_]+)-(\d{4}-\d{2}-\d{2})\.csv$",
}
#: A partition's most bytes and files.
PARTITION_BYTES, PARTITION_FILES = 64 << 20, 1000
SCHEMA = "symbol string, day date, source_path string, head string, pos int, line string"
_ARROW = pa.schema([("symbol", pa.string()), ("day", pa.date32()), ("source_path", pa.string()), ("head", pa.string()), ("pos", pa.int32()), ("line", pa.string())])
_ORDER = {GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b}


class Files(InputPartition):
    """(symbol, day, path) of each file of a partition."""

    def __init__(self, files: list[tuple[str, datetime.date, str]]) -> None:
        super().__init__(files)
        self.files = files


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.pattern = options["path"], NAMES[options["kind"]]
        self.most = int(options.get("filesPerPartition", PARTITION_FILES))
        self.tests: list[tuple[int, Any]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes comparisons of the symbol or the day with values, which names decide; what else there is stays Spark's."""
        for f in filters:
            column = {("symbol",): 0, ("day",): 1}.get(getattr(f, "attribute", None))
            if column is None:
                yield f
            elif isinstance(f, IsNotNull):  # both always are
                continue
            elif isinstance(f, EqualTo) and f.value is not None:
                self.tests.append((column, _One(frozenset([f.value]))))
            elif isinstance(f, In):
                self.tests.append((column, _One(frozenset(v for v in f.value if v is not None))))
            elif type(f) in _ORDER and f.value is not None:
                self.tests.append((column, _Side(type(f), f.value)))
            else:
                yield f

    def _store(self) -> tuple[fs.FileSystem, str, str]:
        """(file system, root in it, what comes before its paths in addresses)."""
        if ":/" not in self.root:
            return fs.LocalFileSystem(), self.root, "file:"
        store, root = fs.FileSystem.from_uri(self.root)
        prefix = self.root[: self.root.index(root.rstrip("/"))]
        return store, root, "file:" if prefix == "file://" else prefix  # as Spark writes local paths

    def matching(self) -> list[tuple[str, datetime.date, str, int]]:
        """(symbol, day, path, bytes) of the files whose names match, in order of their path."""
        store, root, _ = self._store()
        out = []
        for info in store.get_file_info(fs.FileSelector(root, recursive=True)):
            if info.type == fs.FileType.File and (m := re.match(self.pattern, info.base_name)):
                try:
                    key = (m[1], datetime.date.fromisoformat(m[2]))
                except ValueError:  # no such day: the name is no file's of this kind
                    continue
                if all(test(key[column]) for column, test in self.tests):
                    out.append((*key, info.path, info.size))
        return sorted(out, key=lambda x: x[2].split("/"))

    def partitions(self) -> list[InputPartition]:
        parts: list[list] = [[]]
        held = 0
        for symbol, day, path, size in self.matching():
            if parts[-1] and (held + size > PARTITION_BYTES or len(parts[-1]) >= self.most):
                parts.append([])
                held = 0
            parts[-1].append((symbol, day, path))
            held += size
        return [Files(p) for p in parts]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _, prefix = self._store()
        for symbol, day, path in partition.files:
            with store.open_input_stream(path) as f:
                text = f.read().decode().strip()
            if not text:
                continue
            lines = re.split(r"\r?\n", text)
            n = len(lines)
            columns = [[symbol] * n, [day] * n, [prefix + path] * n, [lines[0]] * n, list(range(n)), lines]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


class _One:
    def __init__(self, values: frozenset) -> None:
        self.values = values

    def __call__(self, value: Any) -> bool:
        return value in self.values


class _Side:
    def __init__(self, kind: type, value: Any) -> None:
        self.kind, self.value = kind, value

    def __call__(self, value: Any) -> bool:
        return _ORDER[self.kind](value, self.value)


class Archive(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vendor_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> ArchiveReader:
        return ArchiveReader(self.options)


def archive_lines(spark: SparkSession, root: str, kind: str, **options: Any) -> DataFrame:
    """(symbol, day, source_path, head, pos, line) of each line of the archive's files of one kind; head is the file's first line. A file of
    white space alone has no rows. Turns Spark's pushing of filters into Python data sources on for the session, without which filters hold all
    the same but every file is opened."""
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Archive)
    return spark.read.format("vendor_archive").options(path=root, kind=kind, **{k: str(v) for k, v in options.items()}).load()
