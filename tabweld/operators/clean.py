"""Cleaning: exact duplicates, string standardisation, NaN as null."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweld.functions.text import is_fractional, is_text, standardize


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN and null are one notion of missing."""
    return df.select(
        *[
            F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name) if is_fractional(f.dataType) else F.col(f.name)
            for f in df.schema
        ]
    )


def drop_exact_duplicates(df: DataFrame, row_id: str | None = None) -> DataFrame:
    """One row per distinct content; with ``row_id``, the copy with the lowest one.

    Grouping combines copies map-side, so a large group of copies shuffles as one row
    per task.
    """
    if row_id is None:
        return df.dropDuplicates()
    data = [c for c in df.columns if c != row_id]
    return df.groupBy(*data).agg(F.min(row_id).alias(row_id)).select(*df.columns)


def standardize_strings(df: DataFrame) -> DataFrame:
    return df.select(
        *[standardize(F.col(f.name)).alias(f.name) if is_text(f.dataType) else F.col(f.name) for f in df.schema]
    )


def clean_data(df: DataFrame, row_id: str | None = None) -> DataFrame:
    """Drop exact copies, then trim and lower-case text (so case variants survive)."""
    return standardize_strings(drop_exact_duplicates(nan_to_null(df), row_id))
