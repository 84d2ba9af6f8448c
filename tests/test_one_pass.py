"""Coding tables and made-up logits at size: what is shuffled, and how often rows are parsed or mixed."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.functions import draws
from tarmac.operators import coding_tables as ct
from tarmac.plans import coding_queries as cq

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_are_not_shuffled_by_file(spark):
    """The join with the places of columns stays a broadcast where tables are too large to be sent unasked."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(10).select((F.col("id") % 2).cast("string").alias("path"), F.col("id").alias("row"), F.array(F.lit("x")).alias("cells"))
        top = plan(ct.parse(rows, cq._schema(spark))).split("BroadcastExchange")[0]
        assert "BroadcastHashJoin" in top and "Exchange" not in top
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_reports_read_rows_once(spark, tmp_path):
    """The file report reads the parsed rows once, the attribute report once and once for the kept rows."""
    cq._parsed(spark, SF).write.parquet(str(tmp_path / "parsed"))
    parsed, schema = spark.read.parquet(str(tmp_path / "parsed")), cq._schema(spark)
    sheets = spark.createDataFrame([("f", 0, ["Section"])], "path string, row long, cells array<string>")

    def reads(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count(" Relation [")

    assert reads(ct.file_report(sheets, schema, parsed)) == 1
    assert reads(ct.attribute_report(schema, parsed, ct.kept_rows(parsed))) == 2


def test_normals_are_those_of_their_keys(spark):
    ids = spark.range(-3, 60).withColumn("id", F.col("id") * 987_654_321_987)
    made = ids.select(draws.normals(draws.bits(F.lit(4), F.col("id")), range(3)).alias("n"), F.array(*[draws.normal(F.lit(4), F.col("id"), F.lit(k)) for k in range(3)]).alias("each"))
    assert all(r.n == r.each for r in made.collect())
