"""Session helpers: the shared work folder and intermediate tables in it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables, taken from ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; on a cluster
    a folder of one machine would be lost with that machine, so there it is an error.
    """
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="tabweld-"))
    return sc.getCheckpointDir()


def side_by_side(*steps: Callable) -> list:
    """Results of independent steps whose jobs share the cluster instead of queueing."""
    keep_context = inheritable_thread_target(SparkSession.active())
    with ThreadPoolExecutor(len(steps)) as pool:
        running = [pool.submit(keep_context(step)) for step in steps]
        return [r.result() for r in running]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage, survives the loss of executors, and gives later plans real
    sizes and column pruning, which ``DataFrame.checkpoint`` does not.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
