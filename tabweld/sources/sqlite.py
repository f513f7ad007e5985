"""SQLite files as a Spark data source.

A table is a file, or a folder of files that each hold a part of it, as Parquet folders
do: every task writes a file of its own, and is read back in ranges of rows. No row goes
through the driver, and a failed or repeated task leaves no trace in the result.
"""

from __future__ import annotations

import os
import sqlite3
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from tabweld.operators.columns import export_casts

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Declared types and the Spark types they are read as.
DECLARED = {"INTEGER": "bigint", "REAL": "double", "TEXT": "string", "BLOB": "binary"}
ROWS_PER_TASK = 500_000
_ROWS_PER_BATCH = 10_000


def _quote(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _files(path: str) -> list[str]:
    if os.path.isdir(path):
        return sorted(os.path.join(path, f) for f in os.listdir(path) if f.endswith(".db"))
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    return [path]


def _open(file: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{file}?mode=ro", uri=True)


def _spark_type(declared: str) -> str:
    """Spark type of a declared type, by SQLite's affinity rules."""
    declared = declared.upper()
    if "INT" in declared or "BOOL" in declared:
        return DECLARED["INTEGER"]
    if any(t in declared for t in ("CHAR", "CLOB", "TEXT", "DATE", "TIME")):
        return DECLARED["TEXT"]
    if "BLOB" in declared:
        return DECLARED["BLOB"]
    if declared:
        return DECLARED["REAL"]
    return DECLARED["TEXT"]


def list_sqlite_tables(path: str) -> list[str]:
    with _open(_files(path)[0]) as db:
        return [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY name")]


def sqlite_column_types(path: str, table: str) -> dict[str, str]:
    """Declared type of each column."""
    with _open(_files(path)[0]) as db:
        return {r[1]: r[2] for r in db.execute(f"PRAGMA table_info({_quote(table)})")}


@dataclass
class RowRange(InputPartition):
    file: str
    first: int
    last: int


class SqliteReader(DataSourceReader):
    def __init__(self, schema: T.StructType, path: str, table: str, rows_per_task: int):
        self.names = schema.names
        self.types = [f.dataType.simpleString() for f in schema]
        self.path, self.table, self.rows_per_task = path, table, rows_per_task

    def partitions(self) -> list[RowRange]:
        ranges = []
        for file in _files(self.path):
            with _open(file) as db:
                low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quote(self.table)}").fetchone()
            if low is not None:
                step = self.rows_per_task
                ranges += [RowRange(file, at, min(at + step - 1, high)) for at in range(low, high + 1, step)]
        return ranges or [RowRange("", 0, -1)]

    def read(self, partition: RowRange) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        convert = [{"bigint": int, "double": float, "string": str, "binary": bytes}[t] for t in self.types]
        arrow = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}
        schema = pa.schema([(n, arrow[t]) for n, t in zip(self.names, self.types)])
        columns = ", ".join(map(_quote, self.names))
        with _open(partition.file) as db:
            rows = db.execute(
                f"SELECT {columns} FROM {_quote(self.table)} WHERE rowid BETWEEN ? AND ?",
                (partition.first, partition.last),
            )
            while batch := rows.fetchmany(_ROWS_PER_BATCH):
                # Any value may be of any type in SQLite, whatever the column declares.
                columns = [[None if v is None else to(v) for v in c] for c, to in zip(zip(*batch), convert)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


class SqliteCounter(DataSourceReader):
    """The number of rows of each file, one task per file; no row leaves SQLite."""

    def __init__(self, path: str, table: str):
        self.path, self.table = path, table

    def partitions(self) -> list[RowRange]:
        return [RowRange(file, 0, 0) for file in _files(self.path)] or [RowRange("", 0, 0)]

    def read(self, partition: RowRange) -> Iterator[tuple]:
        if partition.file:
            with _open(partition.file) as db:
                yield db.execute(f"SELECT count(*) FROM {_quote(self.table)}").fetchone()


@dataclass
class WrittenFile(WriterCommitMessage):
    file: str
    rows: int


class SqliteWriter(DataSourceArrowWriter):
    """Each task writes its own file under a temporary name; the commit publishes them."""

    def __init__(self, schema: T.StructType, path: str, table: str, overwrite: bool):
        self.names = schema.names
        declared = {v: k for k, v in DECLARED.items()} | {"int": "INTEGER", "smallint": "INTEGER", "tinyint": "INTEGER", "float": "REAL"}
        self.columns = ", ".join(f"{_quote(f.name)} {declared[f.dataType.simpleString()]}" for f in schema)
        self.path, self.table, self.overwrite = path, table, overwrite
        os.makedirs(path, exist_ok=True)

    def write(self, batches: Iterator[pa.RecordBatch]) -> WrittenFile:
        file = os.path.join(self.path, f".{uuid.uuid4().hex}.part")
        marks = ", ".join("?" * len(self.names))
        insert = f"INSERT INTO {_quote(self.table)} VALUES ({marks})"
        total = 0
        db = sqlite3.connect(file, isolation_level=None)
        try:
            db.execute("PRAGMA journal_mode = OFF")
            db.execute(f"CREATE TABLE {_quote(self.table)} ({self.columns})")
            db.execute("BEGIN")
            for batch in batches:
                db.executemany(insert, zip(*[c.to_pylist() for c in batch.columns]))
                total += batch.num_rows
            db.execute("COMMIT")
        finally:
            db.close()
        return WrittenFile(file, total)

    def commit(self, messages: list[WrittenFile | None]) -> None:
        old = _files(self.path) if self.overwrite else []
        for m in messages:
            if m is not None:
                os.rename(m.file, os.path.join(self.path, f"part-{uuid.uuid4().hex}.db"))
        for file in old:
            os.remove(file)

    def abort(self, messages: list[WrittenFile | None]) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.file):
                os.remove(m.file)


class SqliteSource(DataSource):
    """``format("sqlite")`` with options ``path``, ``table`` and ``rows_per_task``.

    With ``counts`` it reads as the column ``rows``, the number of rows of each file.
    """

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        if "counts" in self.options:
            return "rows bigint"
        types = sqlite_column_types(self.options["path"], self.options["table"])
        if not types:
            raise ValueError(f"no table {self.options['table']} in {self.options['path']}")
        return ", ".join(f"`{c}` {_spark_type(t)}" for c, t in types.items())

    def reader(self, schema: T.StructType) -> DataSourceReader:
        if "counts" in self.options:
            return SqliteCounter(self.options["path"], self.options["table"])
        rows = int(self.options.get("rows_per_task", ROWS_PER_TASK))
        return SqliteReader(schema, self.options["path"], self.options["table"], rows)

    def writer(self, schema: T.StructType, overwrite: bool) -> SqliteWriter:
        return SqliteWriter(schema, self.options["path"], self.options["table"], overwrite)


def _local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


def read_sqlite(spark: SparkSession, path: str, table: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """A SQLite table; the file or folder must be readable on every node."""
    spark.dataSource.register(SqliteSource)
    reader = spark.read.format("sqlite").option("path", _local(path)).option("table", table)
    return reader.option("rows_per_task", rows_per_task).load()


def count_sqlite(spark: SparkSession, path: str, table: str) -> int:
    """Rows of a SQLite table, counted by SQLite itself."""
    spark.dataSource.register(SqliteSource)
    reader = spark.read.format("sqlite").option("path", _local(path)).option("table", table)
    return reader.option("counts", True).load().agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]


def export_to_sqlite(df: DataFrame, path: str, table: str = "merged_data") -> int:
    """Write a table as a folder of SQLite files, check the row count, return it.

    The folder must be writable on every node. For one file, pass ``df.coalesce(1)``.
    """
    spark = df.sparkSession
    spark.dataSource.register(SqliteSource)
    seen = Observation()
    ready = export_casts(df).observe(seen, F.count(F.lit(1)).alias("rows"))
    writer = ready.write.format("sqlite").mode("overwrite").option("path", _local(path)).option("table", table)
    writer.save()
    written, expected = count_sqlite(spark, path, table), seen.get["rows"]
    if written != expected:
        raise RuntimeError(f"{written} rows in {path}, expected {expected}")
    return written
