"""Round trips of sources and sinks."""
import json
import os
import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equiscope.session import ensure_checkpoint_dir
from equiscope.sources import documents as DOC
from equiscope.sources import io as IO
from equiscope.sources.sampling import hash_sample, hash_split


def _p(spark, k):
    return os.path.join(ensure_checkpoint_dir(spark), f"{k}-{uuid.uuid4().hex}")


def test_csv_nan_and_empty_become_null(spark):
    # The file is written by Spark into the shared scratch folder (no local I/O).
    path = _p(spark, "csv")
    lines = ["years_experience,education_level,skills_count,job_role,previous_salary,interview_score,"
             "location,company_size,gender,age,salary",
             "3.5,Master,,Data Scientist,NaN,7.5,Remote,Small (51-200),Female,30,120000"]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    r = IO.read_candidates(spark, path).first()
    assert r["skills_count"] is None and r["previous_salary"] is None and r["salary"] == 120000


def test_report_roundtrip_and_missing(spark):
    df = spark.createDataFrame([("gender", 0.05)], "attribute string, dp double")
    path = _p(spark, "rep")
    IO.write_report(df, path)
    assert IO.read_report(spark, path, "attribute string, dp double").collect() == df.collect()
    assert IO.read_report(spark, _p(spark, "missing"), "a string") is None


def test_refresh_append_load_if_empty(spark):
    path = _p(spark, "tbl")
    a = spark.createDataFrame([(1,), (2,)], "id int")
    assert IO.load_if_empty(spark, a, path) is True
    assert IO.load_if_empty(spark, a, path) is False
    IO.append_rows(spark.createDataFrame([(3,)], "id int"), path, source="real")
    assert spark.read.parquet(path).count() == 3
    IO.refresh_table(a, path)
    assert spark.read.parquet(path).count() == 2


def test_hash_sample_and_split_are_deterministic(spark):
    df = spark.range(5000).withColumn("v", F.col("id") * 3)
    s1 = [r.id for r in hash_sample(df, ["id"], 100, seed=7).collect()]
    s2 = [r.id for r in hash_sample(df.repartition(7), ["id"], 100, seed=7).collect()]
    assert len(s1) == 100 and sorted(s1) == sorted(s2)
    sp = hash_split(df, ["id"], [0.6, 0.2, 0.2], names=["train", "calibration", "test"])
    counts = {r["split"]: r["count"] for r in sp.groupBy("split").count().collect()}
    assert sum(counts.values()) == 5000 and abs(counts["train"] - 3000) < 200


def test_int_key_hash_equals_its_sql_text(spark):
    """The portable hash gives the same value in Spark and in DuckDB, also for
    keys far beyond 2^31 (no overflow in either engine)."""
    import duckdb

    from equiscope.sources.sampling import int_key_hash, int_key_hash_sql
    keys = [(1, 1), (7, 3), (2**40 + 5, 7), (9_000_000_000_000, 2), (123456789, 0)]
    df = spark.createDataFrame(keys, "a long, b long")
    got = {(r["a"], r["b"]): r["h"] for r in df.select("a", "b", int_key_hash(["a", "b"], 123).alias("h")).collect()}
    rel = duckdb.sql("SELECT a, b, " + int_key_hash_sql(["a", "b"], 123) + " AS h FROM (VALUES "
                     + ", ".join(f"({a}::BIGINT, {b}::BIGINT)" for a, b in keys) + ") t(a, b)")
    want = {(a, b): h for a, b, h in rel.fetchall()}
    assert got == want and len(set(got.values())) == len(keys)


def _csv(spark, *files):
    path = _p(spark, "csvs")
    for lines in files:
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(path)
    return path


def test_csv_files_of_one_folder_have_one_header(spark):
    schema = T.StructType([T.StructField("age", T.IntegerType()), T.StructField("salary", T.LongType())])
    same = _csv(spark, ["salary,age", "100,40"], ["salary,age", "200,30.0", "9007199254740993,30.5"])
    assert {(r["age"], r["salary"]) for r in IO.read_candidates(spark, same, schema).collect()} == {(40, 100), (30, 200), (None, 9007199254740993)}
    with pytest.raises(Exception, match="(?i)header"):
        IO.read_candidates(spark, _csv(spark, ["age,salary", "40,100"], ["salary,age", "200,30"]), schema).collect()


def test_documents(spark):
    texts = ['{"k": 1, "tags": ["a", null], "of": {"x": 1.5}}', '{"of": {"x": 2}, "other": 3}', "{}", '{"k": "many"}', '{"k": 1', "no json", "", "  ", None, '{"k": 5, "k": 6}']
    df = spark.createDataFrame([(i, t, "given") for i, t in enumerate(texts)], "i int, t string, document string")
    schema = "k bigint, tags array<string>, of struct<x: double>"
    rows = DOC.parse_documents(df, "t", schema).withColumn("text", DOC.format_document("document")).orderBy("i").collect()
    assert [r["malformed"] for r in rows] == [False] * 3 + [True] * 3 + [False] * 4
    assert [r["document"] is None for r in rows] == [False] * 3 + [True] * 6 + [False]
    assert rows[0]["document"]["tags"] == ["a", None] and rows[0]["document"]["of"]["x"] == 1.5 and rows[1]["document"]["k"] is None and rows[9]["document"]["k"] == 6
    assert json.loads(rows[1]["text"]) == {"k": None, "tags": None, "of": {"x": 2.0}} and rows[3]["text"] is None
    again = DOC.parse_documents(spark.createDataFrame(rows, "i int, t string, document struct<k: bigint, tags: array<string>, of: struct<x: double>>, malformed boolean, text string"),
                                "text", schema, "again").orderBy("i").collect()
    assert [r["again"] for r in again] == [r["document"] for r in rows]
    assert DOC.parse_documents(df.where("false"), "t", schema).count() == 0
