"""The profiler's SQLite files as a Spark data source.

One Spark partition per file and row range, so one large file is read by many
tasks. Files are opened read-only by the tasks; the driver only lists them.
Comparisons on columns are passed on to SQLite.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
)

from tracewise.schemas import SCHEMAS, SQLITE_TABLES

# About 64 MB of rows per partition by default.
BYTES_PER_PARTITION = 64 << 20
ROWS_PER_BATCH = 10_000


@dataclass
class FileSlice(InputPartition):
    """Part ``index`` of ``count`` of a file, or of fixed-size row ranges."""

    path: str
    index: int
    count: int


_COMPARISONS = {
    EqualTo: "=",
    GreaterThan: ">",
    GreaterThanOrEqual: ">=",
    LessThan: "<",
    LessThanOrEqual: "<=",
}


class SqliteTraceSource(DataSource):
    """``format("sqlite_trace")`` with options ``path`` and ``table``."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_trace"

    def schema(self):
        return SCHEMAS[self.options["table"]]

    def reader(self, schema):
        return SqliteTraceReader(schema, self.options)


class SqliteTraceReader(DataSourceReader):
    def __init__(self, schema, options):
        self.schema = schema
        # SQLite reads through the file system, so the folder is mounted everywhere.
        self.root = options["path"].removeprefix("file://").removeprefix("file:")
        self.table = SQLITE_TABLES[options["table"]]
        self.rows_per_partition = int(options.get("rowsPerPartition", 0))
        self.conditions: list[tuple[str, list]] = []
        self.runs: set[str] | None = None  # null: all

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        names = {f.name for f in self.schema.fields} - {"run_id"}
        for f in filters:
            column = getattr(f, "attribute", ())
            if column == ("run_id",) and isinstance(f, (EqualTo, In)):  # files of other runs are not opened
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.runs = wanted if self.runs is None else self.runs & wanted
            elif len(column) != 1 or column[0] not in names:
                yield f
            elif isinstance(f, IsNotNull):
                self.conditions.append((f'"{column[0]}" IS NOT NULL', []))
            elif type(f) in _COMPARISONS and isinstance(f.value, (int, str)):
                self.conditions.append((f'"{column[0]}" {_COMPARISONS[type(f)]} ?', [f.value]))
            else:
                yield f

    def partitions(self):
        slices, seen = [], False
        for folder, _, files in sorted(os.walk(self.root)):
            for file in sorted(files):
                if not file.endswith(".sqlite"):
                    continue
                path, seen = os.path.join(folder, file), True
                if self.runs is not None and file.removesuffix(".sqlite") not in self.runs:
                    continue
                if self.rows_per_partition:
                    count = self._row_ranges(path)
                else:
                    count = max(1, -(-os.path.getsize(path) // BYTES_PER_PARTITION))
                slices += [FileSlice(path, i, count) for i in range(count)]
        if not seen:
            raise ValueError(f"no .sqlite files under {self.root}")
        return slices

    def _row_ranges(self, path: str) -> int:
        low, high = _row_bounds(path, self.table)
        return max(1, -(-(high - low + 1) // self.rows_per_partition))

    def read(self, partition: FileSlice) -> Iterator:
        import sqlite3

        import pyarrow as pa

        if partition is None:  # no file is left
            return
        low, high = _row_bounds(partition.path, self.table)
        size = -(-(high - low + 1) // partition.count)
        first = low + partition.index * size
        columns = [f for f in self.schema.fields if f.name != "run_id"]
        selected = ", ".join(f'"{f.name}"' for f in columns)
        where = "".join(f" AND {condition}" for condition, _ in self.conditions)
        values = [v for _, vs in self.conditions for v in vs]
        types = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
        arrow_schema = pa.schema(
            [(f.name, types[f.dataType.simpleString()]) for f in self.schema.fields]
        )
        run_id = os.path.basename(partition.path)[: -len(".sqlite")]

        with sqlite3.connect(_read_only(partition.path), uri=True) as connection:
            cursor = connection.execute(
                f"SELECT {selected} FROM {self.table} WHERE rowid >= ? AND rowid < ?{where}",
                [first, first + size, *values],
            )
            while rows := cursor.fetchmany(ROWS_PER_BATCH):
                by_column = [[run_id] * len(rows), *map(list, zip(*rows, strict=True))]
                arrays = [pa.array(v, t.type) for v, t in zip(by_column, arrow_schema, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow_schema)


def _read_only(path: str) -> str:
    return f"file:{quote(path)}?mode=ro"


def _row_bounds(path: str, table: str) -> tuple[int, int]:
    """Lowest and highest row number; both are found at the ends of the table's tree."""
    import sqlite3

    with sqlite3.connect(_read_only(path), uri=True) as connection:
        low, high = connection.execute(
            f"SELECT (SELECT min(rowid) FROM {table}), (SELECT max(rowid) FROM {table})"
        ).fetchone()
    return (0, -1) if low is None else (low, high)
