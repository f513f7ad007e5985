"""Dense text embedding with a model supplied by the caller."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabweld.session import materialize

BATCH_SIZE = 32


def embedder(load_model: Callable[[], Callable[[list[str]], np.ndarray]], batch_size: int = BATCH_SIZE) -> Callable[[Column], Column]:
    """Column function from text to vector.

    ``load_model`` runs once in each Python worker and returns a function from a batch
    of texts to a matrix with one row per text.
    """

    def make_predict():
        encode = load_model()
        return lambda texts: np.asarray(encode([str(t) for t in texts]), dtype=np.float32)

    return predict_batch_udf(make_predict, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)


def embed_distinct(df: DataFrame, column: str, embed: Callable[[Column], Column], name: str = "vector") -> DataFrame:
    """``df`` with the vectors of a text column, each distinct text embedded once; null has no vector.

    The distinct texts and their vectors are written, then joined back; the join is free to split a
    text that very many rows have.
    """
    text = df.select(F.col(column).alias("_text")).where(F.col("_text").isNotNull()).distinct()
    vectors = materialize(text.select("_text", embed(F.col("_text")).alias(name)), "text-vectors")
    return df.join(vectors, F.col(column) == F.col("_text"), "left").drop("_text")
