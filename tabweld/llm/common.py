"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import sys
from types import ModuleType

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII white space: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = "[ \\t-\\r]+"


def ship_by_value(module_name: str) -> ModuleType:
    """Send the module's functions to the executors with the plan; they need not have this package."""
    module = sys.modules[module_name]
    cloudpickle.register_pickle_by_value(module)
    return module


def whole_text(text: Column) -> Column:
    """The text, null as the empty text."""
    return F.coalesce(text.cast("string"), F.lit(""))


def longs(values: list[int]) -> Column:
    """A constant array of whole numbers, folded into one literal."""
    if not values:
        return F.expr("cast(array() as array<bigint>)")
    return F.from_json(F.lit("[" + ",".join(map(str, values)) + "]"), "array<bigint>")


def count_not_above(bounds: list[int], key: Column) -> Column:
    """How many of the ascending ``bounds`` are at most ``key``: binary search without a join."""
    n = len(bounds)
    if not n:
        return F.lit(0)
    table = longs(bounds)
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(n.bit_length()))))
    return F.aggregate(
        steps,
        F.lit(0),
        lambda low, step: F.when((low + step <= n) & (F.get(table, low + step - 1) <= key), low + step).otherwise(low),
    )


def with_row(docs: DataFrame, **more: Column) -> DataFrame:
    """All columns packed into ``row``, so that no column name of the input can clash with ours."""
    return docs.select(F.struct("*").alias("row"), *(c.alias(name) for name, c in more.items()))


def replaced(docs: DataFrame, **new: Column) -> list[Column]:
    """Columns of a ``row`` in their order, the named ones replaced."""
    quoted = {c: F.col(f"row.`{c.replace('`', '``')}`") for c in docs.columns}
    return [new.get(c, quoted[c]).alias(c) for c in docs.columns]
