"""Column names and column lists: cleaning, adding, dropping, casting, previewing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def clean_column_names(df: DataFrame) -> DataFrame:
    """Lower-case names without outer spaces; inner spaces and hyphens become underscores."""
    names = [c.strip().translate(str.maketrans(" -", "__")).lower() for c in df.columns]
    clashes = sorted({n for n in names if names.count(n) > 1})
    if clashes:
        raise ValueError(f"cleaned column names clash: {clashes}")
    return df.toDF(*names)


def add_text_column(df: DataFrame, name: str) -> DataFrame:
    """Add an empty (null) text column."""
    if name in df.columns:
        raise ValueError(f"column exists already: {name}")
    return df.withColumn(name, F.lit(None).cast("string"))


def drop_column(df: DataFrame, name: str) -> DataFrame:
    if name not in df.columns:
        raise ValueError(f"no such column: {name}")
    return df.drop(name)


def drop_column_into(spark: SparkSession, table: str, name: str) -> str:
    """Store ``table`` without a column as ``{table}_modified``; return that name."""
    target = f"{table}_modified"
    drop_column(spark.table(table), name).write.saveAsTable(target)
    return target


def export_casts(df: DataFrame) -> DataFrame:
    """Types a plain table file can hold: booleans as 0/1, times and dates as text."""
    as_text = (T.DateType, T.TimestampType, T.TimestampNTZType)

    def cast(field: T.StructField):
        if isinstance(field.dataType, T.BooleanType):
            return F.col(field.name).cast("int")
        return F.col(field.name).cast("string") if isinstance(field.dataType, as_text) else F.col(field.name)

    return df.select(*[cast(f).alias(f.name) for f in df.schema])


def preview(df: DataFrame, order_by: str | list[str], n: int = 5) -> DataFrame:
    """First ``n`` rows in the given order (Spark keeps only n rows per task)."""
    return df.orderBy(order_by).limit(n)


def list_tables(spark: SparkSession) -> DataFrame:
    """Names of the session's tables and views."""
    names = [(t.name,) for t in spark.catalog.listTables()]
    return spark.createDataFrame(names, "table_name string")


def column_types(df: DataFrame) -> DataFrame:
    """One row per column: position, name and type."""
    rows = [(i, name, dtype) for i, (name, dtype) in enumerate(df.dtypes)]
    return df.sparkSession.createDataFrame(rows, "position int, column_name string, data_type string")


def validate_schema_compatibility(left: DataFrame, right: DataFrame) -> bool:
    """Whether the two tables share at least one column name."""
    return not set(left.columns).isdisjoint(right.columns)
