"""Line dedup: lines that many sites share are boilerplate and are removed everywhere.

Each document gives each of its different lines once, with its site. Per line hash a HyperLogLog
sketch of the sites merges by aggregation; lines whose estimate is near the threshold get an exact
count instead. Lines on at least ``min_sites`` sites are shared lines.

A shared line is boilerplate if different pages carry it: half of ``min_sites`` different
signatures or more, counted exactly. This number does not grow with the documents, so copies of
one page, however many, never hide a line that other pages carry.

The signature is the document's two longest lines, and the two longest of those that are not
shared. Copies agree in both, so a page that was copied to many sites does not make its own content
boilerplate; long boilerplate does not make short pages alike. Copies that were edited on their
sites, each in another way, count as different pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabweld.llm.common import replaced, whole_text, with_row
from tabweld.session import materialize

MIN_SITES = 10
#: log2 of the sketches' registers, and the relative distance from a threshold that counts as near.
SKETCH_BITS = 12
NEAR = 0.25

BLANK = " \t\r\x0b\f"


def lines_of(text: Column) -> Column:
    """The text's lines without white space at their ends; blank ones are empty."""
    return F.transform(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(BLANK)))


def line_table(docs: DataFrame, text_column: str = "text", site_column: str = "site") -> DataFrame:
    """``site``, ``code`` (of the text) and ``lines`` of each document: hashes of its different lines, longest first."""
    text = F.col(f"`{text_column}`")
    lines = docs.select(
        F.coalesce(F.col(f"`{site_column}`").cast("string"), F.lit("")).alias("site"),
        F.xxhash64(text).alias("code"),
        F.array_remove(F.array_distinct(lines_of(whole_text(text))), "").alias("lines"),
    )
    ranked = F.sort_array(F.transform("lines", lambda line: F.struct(F.length(line).alias("n"), F.xxhash64(line).alias("line"))), asc=False)
    return lines.select("site", "code", ranked["line"].alias("lines"))


def shared_lines(table: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``line`` of each line on at least ``min_sites`` sites."""
    table = table.select("site", F.explode("lines").alias("line"))
    spread = table.groupBy("line").agg(F.count("*").alias("docs"), F.hll_sketch_agg("site", SKETCH_BITS).alias("site_sketch"))
    # Fewer documents than sites asked for settle most lines before any estimate.
    spread = spread.where(F.col("docs") >= min_sites).select("line", F.hll_sketch_estimate("site_sketch").alias("sites"))
    spread = materialize(spread, "line-spread")
    clear = spread.where(F.col("sites") >= min_sites * (1 + NEAR)).select("line")
    near = spread.where((F.col("sites") >= min_sites * (1 - NEAR)) & (F.col("sites") < min_sites * (1 + NEAR))).select("line")
    exact = table.join(near, "line", "left_semi").distinct().groupBy("line").agg(F.count("*").alias("sites"))
    return clear.unionByName(exact.where(F.col("sites") >= min_sites).select("line"))


def boilerplate_lines(table: DataFrame, hits: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``line`` of each shared line that different pages carry; ``hits`` holds ``code`` and ``line`` of shared lines."""
    pages = table.select("code", "lines").distinct()
    shared = hits.groupBy("code").agg(F.collect_set("line").alias("shared"))
    rest = F.array_except("lines", "shared")
    signed = pages.join(shared, "code").select("shared", F.xxhash64(F.slice("lines", 1, 2), F.slice(rest, 1, 2)).alias("signature"))
    carried = signed.select("signature", F.explode("shared").alias("line")).distinct().groupBy("line").agg(F.count("*").alias("signatures"))
    return carried.where(2 * F.col("signatures") >= min_sites).select("line")


def without_boilerplate(
    docs: DataFrame,
    min_sites: int = MIN_SITES,
    id_column: str = "doc_id",
    text_column: str = "text",
    site_column: str = "source",
    length_column: str = "n_chars",
) -> DataFrame:
    """``row`` (all columns, text and length without boilerplate), ``n_lines`` and ``n_removed``.

    All documents stay, also those that lose all their lines; texts that lose none, null ones
    among them, are unchanged. Blank lines are never boilerplate. Null sites count as one site.
    Documents are told apart by id and text, so repeated rows lose the same lines.
    """
    identity = [F.col(f"`{id_column}`").alias("id"), F.xxhash64(F.col(f"`{text_column}`")).alias("code")]
    table = materialize(line_table(docs, text_column, site_column), "lines")
    shared = materialize(shared_lines(table, min_sites), "shared-lines")

    places = docs.select(*identity, F.posexplode(F.transform(lines_of(whole_text(F.col(f"`{text_column}`"))), lambda x: F.xxhash64(x))).alias("place", "line"))
    hits = materialize(places.join(shared, "line"), "shared-places")
    bad = materialize(boilerplate_lines(table, hits, min_sites), "boilerplate")
    hits = hits.join(bad, "line").groupBy("id", "code").agg(F.sort_array(F.collect_set("place")).alias("places"))
    whole = with_row(docs, id=identity[0], code=identity[1], text=F.col(f"`{text_column}`").cast("string"))
    joined = whole.join(
        hits.withColumnsRenamed({"id": "hit_id", "code": "hit_code"}),
        F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("code") == F.col("hit_code")),
        "left",
    )
    cut = joined.withColumn("text", F.when(F.col("places").isNull(), F.col("text")).otherwise(without_places(F.col("text"), F.col("places"))))
    text, length = F.col("text"), F.col(f"row.`{length_column}`") if length_column in docs.columns else None
    new = {text_column: text}
    if length is not None:
        new[length_column] = F.when(F.col("places").isNull(), length).otherwise(F.length(text)).cast(docs.schema[length_column].dataType)
    return cut.select(
        F.struct(*replaced(docs, **new)).alias("row"),
        F.coalesce(F.size(F.split(F.col(f"row.`{text_column}`").cast("string"), "\n")), F.lit(0)).alias("n_lines"),
        F.coalesce(F.size("places"), F.lit(0)).alias("n_removed"),
    )


def without_places(text: Column, places: Column) -> Column:
    """The text without the lines at the ascending ``places``: slices between them, in linear time."""
    lines = F.split(text, "\n")
    starts = F.concat(F.array(F.lit(-1)), places)
    ends = F.concat(places, F.array(F.size(lines)))
    kept = F.zip_with(starts, ends, lambda a, b: F.slice(lines, a + 2, b - a - 1))
    return F.array_join(F.flatten(kept), "\n")
