import os
import sqlite3

import pytest
from pyspark.sql import functions as F

from tabweld.session import materialize, work_dir
from tabweld.sources.files import read_csv, read_json, read_table, write_csv, write_json
from tabweld.sources.sqlite import count_sqlite, export_to_sqlite, list_sqlite_tables, read_sqlite, sqlite_column_types
from tabweld.sources.tables import export_table


def test_csv_types_and_missing_values(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('id,x,name,ok,none\n1,1.5, a ,true,NA\n2,NaN,"say ""hi"", you",False,\n3,2,n/a,true,null\n')
    df = read_csv(spark, str(path))
    assert df.dtypes == [("id", "bigint"), ("x", "double"), ("name", "string"), ("ok", "boolean"), ("none", "string")]
    assert sorted(map(tuple, df.collect())) == [
        (1, 1.5, " a ", True, None), (2, None, 'say "hi", you', False, None), (3, 2.0, None, True, None),
    ]


@pytest.mark.parametrize("kind", ["csv", "json"])
def test_round_trips(spark, tmp_path, kind):
    df = spark.createDataFrame([(1, " a,\"b\" ", 0.5), (2, None, None)], "i long, s string, x double")
    path = str(tmp_path / kind)
    if kind == "csv":
        write_csv(df, path)
        back = read_table(spark, path)
    else:
        write_json(df, path)
        back = read_json(spark, path, df.schema)
    assert back.schema.simpleString() == df.schema.simpleString()
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_sqlite_file_is_read_in_ranges(spark, tmp_path):
    path = str(tmp_path / "one.db")
    with sqlite3.connect(path) as db:
        db.execute('CREATE TABLE people (id INTEGER, name VARCHAR(20), "the score" REAL, born DATE)')
        db.executemany("INSERT INTO people VALUES (?, ?, ?, ?)", [(i, None if i % 7 == 0 else f"p{i}", i / 2, "2020-01-01") for i in range(1000)])
        db.execute("CREATE TABLE empty (a TEXT)")
    assert list_sqlite_tables(path) == ["empty", "people"]
    assert sqlite_column_types(path, "people") == {"id": "INTEGER", "name": "VARCHAR(20)", "the score": "REAL", "born": "DATE"}
    df = read_sqlite(spark, path, "people", rows_per_task=300)
    assert df.dtypes == [("id", "bigint"), ("name", "string"), ("the score", "double"), ("born", "string")]
    parts = df.withColumn("part", F.spark_partition_id())
    row = parts.agg(F.count("*"), F.count("name"), F.sum("the score"), F.count_distinct("part")).first()
    assert tuple(row) == (1000, 857, 249750.0, 4)
    assert read_sqlite(spark, path, "empty").count() == 0
    assert (count_sqlite(spark, path, "people"), count_sqlite(spark, path, "empty")) == (1000, 0)


def test_sqlite_export(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.range(0, 500, 1, 3).select("id", (F.col("id") % 2 == 0).alias("even"), F.lit(None).cast("string").alias("note"))
    assert export_to_sqlite(df, path, "rows") == 500
    files = [f for f in os.listdir(path)]
    assert len(files) == 3 and all(f.endswith(".db") for f in files)
    back = read_sqlite(spark, path, "rows")
    assert back.dtypes == [("id", "bigint"), ("even", "bigint"), ("note", "string")]
    assert tuple(back.agg(F.sum("even"), F.count("note")).first()) == (250, 0)
    # Writing again replaces the table.
    assert export_to_sqlite(df.limit(10).coalesce(1), path, "rows") == 10


def test_excel_says_what_is_missing(spark):
    with pytest.raises(ValueError, match="schema"):
        read_table(spark, "x.xlsx")
    try:
        import openpyxl  # noqa: F401
    except ImportError:
        with pytest.raises(ImportError, match="openpyxl"):
            read_table(spark, "x.xlsx", spark.range(1).schema)


def test_intermediate_tables_lie_in_the_shared_folder(spark):
    df = materialize(spark.range(10), "numbers")
    assert df.count() == 10 and all(work_dir(spark).removeprefix("file:") in f for f in df.inputFiles())


def test_codes_that_look_like_numbers_stay_text(spark, tmp_path):
    path = tmp_path / "codes.csv"
    path.write_text("code,number,whole,more\n1D,1.5,1,inf\n2F,-2e3,-22,1\n30d,.5,+3,-.5\n")
    df = read_csv(spark, str(path))
    assert dict(df.dtypes) == {"code": "string", "number": "double", "whole": "bigint", "more": "double"}
    assert [r.code for r in df.collect()] == ["1D", "2F", "30d"]


def test_cells_with_line_breaks(spark, tmp_path):
    path = tmp_path / "breaks.csv"
    path.write_text('id,text\n1,"a\nb"\n2,c\n')
    assert [r.text for r in read_csv(spark, str(path), multi_line=True).collect()] == ["a\nb", "c"]


def test_checked_export(spark, tmp_path):
    df = spark.range(1000).selectExpr("id", "if(id % 7 = 0, null, concat('t', id)) AS t").repartition(5)
    assert export_table(df, str(tmp_path / "table")) == 1000
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "table")).collect()), key=lambda r: r[0]) == sorted(map(tuple, df.collect()), key=lambda r: r[0])
    with pytest.raises(OSError, match="differ"):
        _changed(df, tmp_path)
    assert export_table(df.limit(0), str(tmp_path / "empty")) == 0


def _changed(df, tmp_path):
    """An export that another writer overwrites before it is read."""
    from unittest import mock

    path = str(tmp_path / "changed")
    write = type(df.write).parquet

    def twice(self, target, **options):
        write(self, target, **options)
        write(df.selectExpr("id + 1 AS id", "t").write.mode("overwrite"), target)

    with mock.patch.object(type(df.write), "parquet", twice):
        export_table(df, path)
