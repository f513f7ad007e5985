"""Merging two tables whose schemas do not line up.

Plan: clean and impute both sides, match columns by name, match rows one to one, union
the original tables on the aligned schema, mark the matched rows, impute what is missing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabweld.functions.text import is_decimal, is_integral, is_numeric, is_scalar, is_text
from tabweld.operators.assign import EDGES, greedy_assignment
from tabweld.operators.candidates import id_subset_pairs, value_pairs
from tabweld.operators.clean import nan_to_null, standardize_strings
from tabweld.operators.content_match import match_by_content
from tabweld.operators.copies import assign_classes, classes, members
from tabweld.operators.id_groups import match_by_ids
from tabweld.operators.impute import apply_fills, assert_no_nulls, fill, fill_values, null_counts
from tabweld.operators.levels import many_pairs, match_by_levels
from tabweld.operators.row_index import with_content_index, with_row_index
from tabweld.operators.schema_match import match_schemas
from tabweld.operators.scoring import RowScore, plan_fields
from tabweld.session import materialize, side_by_side

# Fixed value: the score a pair of rows must reach by default.
ROW_THRESHOLD = 0.85

IS_MATCHED = "is_matched"
MATCH_SCORE = "match_score"
ROW_ID = "_row_id"
_RESERVED = {IS_MATCHED, MATCH_SCORE, ROW_ID}


@dataclass
class Side:
    """One input table: its data columns, its row positions and its missing values."""

    raw: DataFrame  # data columns and ROW_ID, NaN as null
    columns: list[str]
    clean: DataFrame  # the same without exact copies, text standardised
    rows: int
    nulls: dict[str, int]
    fills: dict[str, object]

    @property
    def imputed(self) -> DataFrame:
        return apply_fills(self.clean, self.fills)


def check_key(df: DataFrame, key: str) -> None:
    """Raise unless the column is a whole number or a text that no two rows share and none lacks."""
    dtype = df.schema[key].dataType
    if not (is_integral(dtype) or is_text(dtype)):
        raise ValueError(f"key {key!r} must hold whole numbers or texts, not {dtype.simpleString()}")
    bad = df.groupBy(key).count().where((F.col("count") > 1) | F.col(key).isNull())
    found = bad.agg(F.count_if(F.col(key).isNull()).alias("nulls"), F.count(key).alias("repeated")).first()
    if found.nulls or found.repeated:
        raise ValueError(f"key {key!r} is not unique: nulls {'found' if found.nulls else 'none'}, repeated values {found.repeated}")


def _side(df: DataFrame, key: str | None) -> Side:
    clash = _RESERVED.intersection(df.columns)
    if clash:
        raise ValueError(f"reserved column names: {sorted(clash)}")
    columns = df.columns
    scalars = [f.name for f in df.schema if is_scalar(f.dataType)]
    if key is not None:
        # The key is one of the columns and unique, so no row has an exact copy.
        check_key(df, key)
        whole = is_integral(df.schema[key].dataType)
        raw = nan_to_null(df).withColumn(ROW_ID, F.col(key).cast("bigint")) if whole else with_row_index(nan_to_null(df), ROW_ID, [key])
        clean = standardize_strings(raw)
    else:
        raw, distinct = with_content_index(nan_to_null(df), ROW_ID)
        clean = standardize_strings(distinct)
    rows, nulls = null_counts(raw, scalars)
    clean_rows, clean_nulls = (rows, nulls) if key is not None else null_counts(clean, scalars)
    fills = fill_values(clean, clean_rows, clean_nulls)
    return Side(raw, columns, clean, rows, nulls, fills)


def preprocess_datasets(
    left: DataFrame, right: DataFrame, embed: Callable[[Column], Column] | None = None
) -> tuple[DataFrame, DataFrame, dict[str, str]]:
    """Both tables cleaned and imputed, and the matched columns."""
    a, b, matches = side_by_side(
        lambda: _side(left, None), lambda: _side(right, None), lambda: match_schemas(left, right, embed)
    )
    return a.imputed.select(*a.columns), b.imputed.select(*b.columns), matches


def match_rows(
    row_score: RowScore,
    left: DataFrame,
    right: DataFrame,
    ids_may_be_null: bool = False,
    max_pairs: int | None = None,
) -> DataFrame:
    """One-to-one matches ``(left_id, right_id, score)`` of two prepared sides."""
    ids = row_score.indexes("id")
    needed = row_score.equal_ids_needed(1 if ids_may_be_null and ids else None) if ids else 0
    if needed > len(ids):
        return left.select("left_id", F.lit(None).cast("bigint").alias("right_id"), F.lit(1.0).alias("score")).limit(0)
    if needed == len(ids) and ids and not ids_may_be_null:
        return match_by_ids(row_score, left, right)
    forms = side_by_side(
        lambda: materialize(classes(left, "left_id"), "forms"), lambda: materialize(classes(right, "right_id"), "forms")
    )
    copies = any(f.count() != side.count() for f, side in zip(forms, (left, right)))
    rows = (members(left, forms[0], "left_id"), members(right, forms[1], "right_id")) if copies else None
    if not needed and max_pairs is None and many_pairs(row_score, *forms):
        return match_by_levels(row_score, *forms, rows)
    if needed:
        pairs = id_subset_pairs(row_score, *forms, needed, max_pairs)
        if ids_may_be_null:
            for more in _pairs_without_ids(row_score, *forms, max_pairs):
                pairs = pairs.unionByName(more)
    else:
        pairs = value_pairs(row_score, *forms, max_pairs)
    edges = row_score.passing(pairs)
    return greedy_assignment(edges) if rows is None else assign_classes(edges, *rows)


def _pairs_without_ids(row_score: RowScore, left: DataFrame, right: DataFrame, max_pairs: int | None) -> list[DataFrame]:
    """Pairs where each identifier is null on one side or the other."""
    ids = row_score.indexes("id")
    left_gap, right_gap, unknown = F.lit(False), F.lit(False), F.lit(True)
    for i in ids:
        a, b = F.col(f"l{i}").isNull(), F.col(f"r{i}").isNull()
        left_gap, right_gap, unknown = left_gap | a, right_gap | b, unknown & (a | b)
    branches = []
    for a, b in ((left.filter(left_gap), right), (left.filter(~left_gap), right.filter(right_gap))):
        if not a.isEmpty() and not b.isEmpty():
            branches.append(value_pairs(row_score, a, b, max_pairs, ids_known=False).filter(unknown))
    return branches


def find_matches(
    left: Side,
    right: Side,
    matches: dict[str, str],
    threshold: float,
    id_columns: list[str] | None = None,
    int_as_text: bool = False,
    impute_ids: bool = True,
    embed: Callable[[Column], Column] | None = None,
    max_pairs: int | None = None,
) -> DataFrame:
    """Match the rows of two cleaned sides; only matched columns are read."""
    usable = {
        a: b
        for a, b in matches.items()
        if _has_values(left, a) and _has_values(right, b)
    }
    fields = plan_fields(left.raw.schema, right.raw.schema, usable, id_columns, int_as_text)
    if not fields:
        return left.raw.select(
            F.col(ROW_ID).alias("left_id"), F.col(ROW_ID).alias("right_id"), F.lit(0.0).alias("score")
        ).limit(0)
    row_score = RowScore(fields, threshold, embed)

    def prepared(side: Side, name: str) -> DataFrame:
        fills = side.fills
        if not impute_ids:
            kept = {getattr(f, name) for f in fields if f.kind == "id"}
            fills = {c: v for c, v in fills.items() if c not in kept}
        return materialize(row_score.prepare(apply_fills(side.clean, fills), ROW_ID, name), name)

    sides = side_by_side(lambda: prepared(left, "left"), lambda: prepared(right, "right"))
    gaps = any(left.nulls[f.left] or right.nulls[f.right] for f in fields if f.kind == "id")
    return match_rows(row_score, *sides, ids_may_be_null=gaps and not impute_ids, max_pairs=max_pairs)


def _has_values(side: Side, column: str) -> bool:
    """Whether a column can be compared: of a scalar type, and not all null."""
    return column in side.nulls and (side.nulls[column] < side.rows or side.fills.get(column) is not None)


def align(
    left: DataFrame, right: DataFrame, matches: dict[str, str], align_both: bool = False
) -> DataFrame:
    """Union on the left names, right-only columns after them, missing ones null.

    Mapped right columns keep their own name as well. ``align_both`` copies left values
    into those names too. Columns whose types do not go together become text.
    """
    own = {b: a for a, b in matches.items() if b not in left.columns} if align_both else {}
    names = [*left.columns, *[c for c in right.columns if c not in left.columns]]
    from_left = {c: c for c in left.columns} | own
    from_right = {c: c for c in right.columns} | {a: b for a, b in matches.items() if b in right.columns}
    columns: list[tuple[Column, Column]] = []
    for n in names:
        a, b = from_left.get(n), from_right.get(n)
        types = [df.schema[c].dataType for df, c in ((left, a), (right, b)) if c]
        dtype = common_type(*types)
        columns.append(
            tuple(
                (F.col(c) if c else F.lit(None)).cast(dtype).alias(n) for c in (a, b)
            )
        )
    return left.select(*[a for a, _ in columns]).unionByName(right.select(*[b for _, b in columns]))


def common_type(a: T.DataType, b: T.DataType | None = None) -> T.DataType:
    """Type of a unioned column: equal types stay, numbers widen, anything else is text."""
    if b is None or a == b:
        return a
    if is_numeric(a) and is_numeric(b):
        whole = [T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType()]
        if a in whole and b in whole:
            return max(a, b, key=whole.index)
        if all(is_decimal(t) or t in whole for t in (a, b)):
            digits = {T.ByteType(): 3, T.ShortType(): 5, T.IntegerType(): 10, T.LongType(): 19}
            forms = [(t.precision - t.scale, t.scale) if is_decimal(t) else (digits[t], 0) for t in (a, b)]
            before, after = (max(f[k] for f in forms) for k in (0, 1))
            if before + after <= 38:
                return T.DecimalType(before + after, after)
        return T.DoubleType()
    return T.StringType()


def mark_matches(df: DataFrame, pairs: DataFrame, side: str) -> DataFrame:
    """Add ``is_matched`` and, on the right side, ``match_score`` to a table with ROW_ID."""
    hits = pairs.select(
        F.col(f"{side}_id").alias(ROW_ID),
        F.lit(True).alias("_hit"),
        (F.col("score") if side == "right" else F.lit(None).cast("double")).alias(MATCH_SCORE),
    )
    marked = df.join(hits, ROW_ID, "left")
    return marked.withColumn(IS_MATCHED, F.coalesce("_hit", F.lit(False))).drop("_hit", ROW_ID)


def merge_datasets(
    left: DataFrame,
    right: DataFrame,
    similarity_threshold: float = ROW_THRESHOLD,
    *,
    left_key: str | None = None,
    right_key: str | None = None,
    schema_matches: dict[str, str] | None = None,
    id_columns: list[str] | None = None,
    int_as_text: bool = False,
    impute_ids: bool = True,
    align_both: bool = False,
    embed: Callable[[Column], Column] | None = None,
    max_pairs: int | None = None,
    match_content: float | None = None,
    verify: bool = False,
) -> tuple[DataFrame, dict]:
    """Merge two tables; returns the merged table and the match statistics.

    ``left_key`` and ``right_key`` name unique whole-number columns that serve as row
    positions, or unique texts whose order gives the positions; null or repeated keys are an
    error. Without keys positions follow what the rows hold, so that the same rows in other files give
    the same matches. ``match_content`` is the share of
    values from which columns without a match by name are matched by content. ``verify`` scans
    the result for nulls, which the imputation rules out by construction.
    """
    a, b, stats = _matched(
        left, right, similarity_threshold, left_key, right_key, schema_matches, id_columns, int_as_text, impute_ids, embed, max_pairs, match_content
    )
    merged = _fuse(a, b, stats["schema_matches"], stats["matched_pairs"], align_both)
    if verify:
        assert_no_nulls(merged)
    return merged, stats


def match_datasets(
    left: DataFrame,
    right: DataFrame,
    similarity_threshold: float = ROW_THRESHOLD,
    *,
    left_key: str | None = None,
    right_key: str | None = None,
    schema_matches: dict[str, str] | None = None,
    id_columns: list[str] | None = None,
    int_as_text: bool = False,
    impute_ids: bool = True,
    embed: Callable[[Column], Column] | None = None,
    max_pairs: int | None = None,
    match_content: float | None = None,
) -> dict:
    """The match statistics of ``merge_datasets`` without the merged table: nothing is fused or imputed for it."""
    return _matched(
        left, right, similarity_threshold, left_key, right_key, schema_matches, id_columns, int_as_text, impute_ids, embed, max_pairs, match_content
    )[2]


def _matched(
    left: DataFrame,
    right: DataFrame,
    threshold: float,
    left_key: str | None,
    right_key: str | None,
    schema_matches: dict[str, str] | None,
    id_columns: list[str] | None,
    int_as_text: bool,
    impute_ids: bool,
    embed: Callable[[Column], Column] | None,
    max_pairs: int | None,
    match_content: float | None,
) -> tuple[Side, Side, dict]:
    """Both sides and the match statistics."""

    def columns() -> dict[str, str]:
        named = match_schemas(left, right, embed) if schema_matches is None else schema_matches
        return named if match_content is None else match_by_content(left, right, named, match_content)

    a, b, matches = side_by_side(lambda: _side(left, left_key), lambda: _side(right, right_key), columns)
    pairs = find_matches(a, b, matches, threshold, id_columns, int_as_text, impute_ids, embed, max_pairs)
    total = pairs.count()
    return a, b, {
        "total_matches": total,
        "schema_matches": matches,
        "matched_pairs": pairs,
        "unmatched_df1": a.rows - total,
        "unmatched_df2": b.rows - total,
    }


def _fuse(a: Side, b: Side, matches: dict[str, str], pairs: DataFrame, align_both: bool) -> DataFrame:
    """Union of the original tables, marked and with nothing missing."""
    data = align(a.raw.select(*a.columns), b.raw.select(*b.columns), matches, align_both)
    types = {f.name: f.dataType for f in data.schema}
    filled_right = {x: y for x, y in matches.items() if y in b.columns}
    nulls = {}
    for c, dtype in types.items():
        if not is_scalar(dtype):
            continue
        source_left = c if c in a.columns else ({y: x for x, y in matches.items()}.get(c) if align_both else None)
        source_right = filled_right.get(c, c if c in b.columns else None)
        nulls[c] = (a.nulls.get(source_left, 0) if source_left else a.rows) + (
            b.nulls.get(source_right, 0) if source_right else b.rows
        )
    fills = fill_values(data, a.rows + b.rows, nulls, number_default=0.0)
    marked = align(
        mark_matches(a.raw, pairs, "left"), mark_matches(b.raw, pairs, "right"), matches, align_both
    )
    return marked.select(
        *[fill(F.col(c), dtype, fills.get(c)).alias(c) for c, dtype in types.items()], IS_MATCHED, MATCH_SCORE
    )
