"""CSV, JSON and Excel files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Cell texts that mean a missing value, as pandas reads them.
MISSING = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
EXCEL_SUFFIXES = (".xlsx", ".xlsm", ".xls")


# How numbers are written; casts alone would also take the endings d and f of codes like 1D.
WHOLE = r"^\s*[+-]?[0-9]+\s*$"
FRACTION = r"^\s*[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:inf|infinity))\s*$"


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | None = None, multi_line: bool = False
) -> DataFrame:
    """CSV with a header; texts that mean missing become null.

    Without a schema every cell is read as text, missing ones become null, and each
    column gets the narrowest type that holds all its values: one aggregate pass, which
    a given schema saves. Files are split between tasks; ``multi_line`` reads cells with
    line breaks, one task per file.
    """
    names = schema.names if schema else None
    options = dict(header=True, multiLine=multi_line, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    if names:
        raw = spark.read.csv(path, schema=T.StructType([T.StructField(n, T.StringType()) for n in names]), **options)
    else:
        raw = spark.read.csv(path, inferSchema=False, **options)
    text = raw.select(*[F.when(~F.col(f"`{c}`").isin(MISSING), F.col(f"`{c}`")).alias(c) for c in raw.columns])
    types = {f.name: f.dataType for f in schema} if schema else _infer(text)
    return text.select(*[F.col(f"`{c}`").cast(types[c]).alias(c) for c in text.columns])


def _infer(text: DataFrame) -> dict[str, T.DataType]:
    candidates = [("bigint", T.LongType()), ("double", T.DoubleType()), ("boolean", T.BooleanType())]
    checks = []
    for i, c in enumerate(text.columns):
        column = F.col(f"`{c}`")
        checks.append(F.count(column).alias(f"n{i}"))
        fits = {
            "bigint": column.rlike(WHOLE) & column.try_cast("bigint").isNotNull(),
            "double": column.rlike(FRACTION) & column.try_cast("double").isNotNull(),
            "boolean": F.lower(column).isin("true", "false"),
        }
        checks += [F.count_if(fits[name]).alias(f"{name}{i}") for name, _ in candidates]
    row = text.agg(*checks).first()
    types = {}
    for i, c in enumerate(text.columns):
        fits = [dtype for name, dtype in candidates if row[f"n{i}"] and row[f"{name}{i}"] == row[f"n{i}"]]
        types[c] = fits[0] if fits else T.StringType()
    return types


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(
        path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_excel(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Excel workbooks, first sheet, one task per file."""
    try:
        import openpyxl  # noqa: F401
    except ImportError as e:
        raise ImportError("reading Excel files needs the openpyxl package on every node") from e
    types = schema.jsonValue()

    def parse(batches):
        import io

        import pandas as pd

        names = [f["name"] for f in types["fields"]]
        for batch in batches:
            for content in batch["content"]:
                yield pd.read_excel(io.BytesIO(content))[names]

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, schema)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Read a CSV or Excel file, told apart by the file name's ending."""
    if path.lower().endswith(EXCEL_SUFFIXES):
        if schema is None:
            raise ValueError("reading Excel files needs a schema")
        return read_excel(spark, path, schema)
    return read_csv(spark, path, schema)
