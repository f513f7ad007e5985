"""Tables as Parquet folders, written and checked."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def export_table(df: DataFrame, path: str) -> int:
    """Write ``df`` and read it back; returns its rows, or raises if rows were lost or changed.

    The rows are counted and hashed while they are written, so that the table is computed
    once; the hashes are summed, whatever the order of the rows.
    """
    seen = Observation()
    hashed = F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("hashes")
    df.observe(seen, F.count(F.lit(1)).alias("rows"), hashed).write.mode("overwrite").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    found = back.agg(F.count(F.lit(1)).alias("rows"), hashed).first()
    if (found.rows, found.hashes) != (seen.get["rows"], seen.get["hashes"]):
        raise OSError(f"{path}: {seen.get['rows']} rows were written, {found.rows} read, or their values differ")
    return found.rows
