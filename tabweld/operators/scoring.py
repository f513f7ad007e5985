"""The similarity of two rows as one expression, compiled from the matched columns."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabweld.functions.embed import embed_distinct
from tabweld.functions.similarity import bigram_cosine, jaro_winkler, numeric_closeness, vector_cosine
from tabweld.functions.text import id_text, is_id_name, is_integral, is_numeric, row_text, value_text

# Weights of the row score and of the kinds of field.
EMBEDDING_WEIGHT = 0.3
FIELD_WEIGHT = 0.7
ID_WEIGHT = 5.0
NUMBER_WEIGHT = 2.0
TEXT_WEIGHT = 1.0

# Scores are compared at this many decimals; see schema_match.
SCORE_DIGITS = 9
_SLACK = 1e-8


@dataclass(frozen=True)
class Field:
    """A matched pair of columns and how the two values are compared."""

    left: str
    right: str
    kind: str  # "id", "number" or "text"

    @property
    def weight(self) -> float:
        return {"id": ID_WEIGHT, "number": NUMBER_WEIGHT, "text": TEXT_WEIGHT}[self.kind]


@dataclass(frozen=True)
class RowScore:
    """The fields in order, the threshold a pair must reach, and an optional embedder.

    A prepared side (``prepare``) holds the row's position ``left_id`` or ``right_id``,
    field i as ``l{i}`` or ``r{i}`` in the form it is compared in, and the row's text or
    vector: all that is the same for every pair of a row is computed once per row.
    """

    fields: tuple[Field, ...]
    threshold: float
    embed: Callable[[Column], Column] | None = None
    most_cosine: float = 1.0  # no two row texts have a higher one

    def indexes(self, kind: str) -> list[int]:
        return [i for i, f in enumerate(self.fields) if f.kind == kind]

    @property
    def least_field_score(self) -> float:
        """The field score below which no cosine lifts a pair to the threshold."""
        return (self.threshold - EMBEDDING_WEIGHT * self.most_cosine) / FIELD_WEIGHT - _SLACK

    def weight(self, kinds: tuple[str, ...]) -> float:
        return sum(f.weight for f in self.fields if f.kind in kinds)

    def equal_ids_needed(self, ids: int | None = None) -> int:
        """How many of the identifier fields must be equal for a pair to pass.

        With e of k identifiers equal the field score is at most (5e + W) / (5k + W),
        where W is the weight of the other fields.
        """
        ids = len(self.indexes("id")) if ids is None else ids
        others = self.weight(("number", "text"))
        needed = (self.least_field_score * (ID_WEIGHT * ids + others) - others) / ID_WEIGHT
        return max(0, math.ceil(needed))

    def prepare(self, df: DataFrame, row_id: str, side: str) -> DataFrame:
        """Project a cleaned, imputed table to what its rows are compared by."""
        types = {f.name: f.dataType for f in df.schema}
        columns, parts = [], []
        for i, f in enumerate(self.fields):
            name = f.left if side == "left" else f.right
            value, dtype = F.col(name), types[name]
            form = {"id": id_text, "text": value_text, "number": lambda v, _: v.cast("double")}[f.kind]
            columns.append(form(value, dtype).alias(f"{side[0]}{i}"))
            parts.append((name, value, dtype))
        rows = df.select(F.col(row_id).alias(f"{side}_id"), *columns, row_text(parts).alias(f"{side}_text"))
        if not self.embed:
            return rows
        return embed_distinct(rows, f"{side}_text", self.embed, f"{side}_vector").drop(f"{side}_text")

    def _terms(self, kinds: tuple[str, ...], ids_equal: bool = False) -> list[tuple[Column, Column]]:
        """(weight times similarity, weight) of each field of the given kinds; 0 if unknown."""
        terms = []
        for i, f in enumerate(self.fields):
            if f.kind not in kinds:
                continue
            weight = F.lit(f.weight)
            if f.kind == "id" and ids_equal:
                terms.append((weight, weight))
                continue
            a, b = F.col(f"l{i}"), F.col(f"r{i}")
            known = a.isNotNull() & b.isNotNull()
            if f.kind == "id":
                same = F.when(a == b, 1.0).otherwise(0.0)
            elif f.kind == "number":
                same = numeric_closeness(a, b)
            else:
                same = F.col(f"j{i}")
            terms.append((F.when(known, same * weight).otherwise(0.0), F.when(known, weight).otherwise(0.0)))
        return terms

    def _within_reach(self, texts_known: bool, ids_equal: bool) -> Column:
        """Whether a pair could still pass if its cosine, and texts not yet known, were 1."""
        terms = self._terms(("id", "number"), ids_equal)
        texts = self._terms(("text",))
        terms += texts if texts_known else [(weight, weight) for _, weight in texts]
        return _total([s for s, _ in terms]) >= _total([w for _, w in terms]) * self.least_field_score

    def _with_spelling(self, pairs: DataFrame) -> DataFrame:
        """Add the text similarities; one projection, so that one Arrow exchange serves them."""
        texts = self.indexes("text")
        return pairs.withColumns({f"j{i}": jaro_winkler(F.col(f"l{i}"), F.col(f"r{i}")) for i in texts}) if texts else pairs

    def _with_mix(self, pairs: DataFrame, ids_equal: bool) -> DataFrame:
        if self.embed:
            cosine = vector_cosine(F.col("left_vector"), F.col("right_vector"))
        else:
            cosine = bigram_cosine(F.col("left_text"), F.col("right_text"))
        terms = self._terms(("id", "number", "text"), ids_equal)
        total = _total([w for _, w in terms])
        field = F.when(total > 0, _total([s for s, _ in terms]) / total).otherwise(0.0)
        return self.mixed(pairs.withColumns({"cosine": cosine, "field_score": field}))

    def mixed(self, pairs: DataFrame) -> DataFrame:
        """Add ``score``, the mix of ``cosine`` and ``field_score``."""
        score = F.col("cosine") * EMBEDDING_WEIGHT + F.col("field_score") * FIELD_WEIGHT
        return pairs.withColumn("score", F.round(score, SCORE_DIGITS))

    def with_score(self, pairs: DataFrame) -> DataFrame:
        """Add ``field_score``, the weighted field similarity, and ``score``, its mix with
        the cosine of the row texts."""
        return self._with_mix(self._with_spelling(pairs), False)

    def passing(self, pairs: DataFrame, ids_equal: bool = False) -> DataFrame:
        """Pairs that reach the threshold; those with an equal identifier then score 1.

        Pairs out of reach are dropped before each costlier measure: numbers and
        identifiers in generated code, then spelling, then the cosine of the row texts.
        ``ids_equal`` says that all identifiers of every pair are known to be equal.
        """
        near = pairs.filter(self._within_reach(False, ids_equal))
        if self.indexes("text"):
            near = self._with_spelling(near).filter(self._within_reach(True, ids_equal))
        passed = self._with_mix(near, ids_equal).filter(F.col("score") >= self.threshold)
        if ids_equal:
            return passed.withColumn("score", F.lit(1.0))
        any_equal = F.lit(False)
        for i in self.indexes("id"):
            any_equal = any_equal | F.coalesce(F.col(f"l{i}") == F.col(f"r{i}"), F.lit(False))
        return passed.withColumn("score", F.when(any_equal, 1.0).otherwise(F.col("score")))


def _total(columns: list[Column]) -> Column:
    total = F.lit(0.0)
    for c in columns:
        total = total + c
    return total


def plan_fields(
    left: T.StructType,
    right: T.StructType,
    matches: dict[str, str],
    id_columns: list[str] | None = None,
    int_as_text: bool = False,
) -> tuple[Field, ...]:
    """Decide from names and types how each matched pair of columns is compared.

    ``id_columns`` names the left identifier columns; by default they are told by name.
    ``int_as_text`` compares whole numbers as text, as row-at-a-time access to a table of
    mixed types does.
    """

    def counts_as_number(dtype: T.DataType) -> bool:
        return is_numeric(dtype) and not (int_as_text and is_integral(dtype))

    fields = []
    for a, b in matches.items():
        ta, tb = left[a].dataType, right[b].dataType
        if (a in id_columns) if id_columns is not None else is_id_name(a):
            kind = "id"
        elif counts_as_number(ta) and counts_as_number(tb):
            kind = "number"
        else:
            kind = "text"
        fields.append(Field(a, b, kind))
    return tuple(fields)
