"""Queries of coding tables: ``orders`` stand for the rows of sheets, one file per priority, with headers and cells of many kinds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.operators import coding_tables as ct

_WORDS = [("Surface", 0, 0), ("Surface", 0, 1), ("Surface", 0, 2), ("Surface", 0, 3), ("Lanes", 1, 1), ("Lanes", 1, 2), (ct.VOLUME[0], 2, 1), ("Slope", 3, 0), ("Slope", 3, 1)]
_NAMES = ["Surface", "Lanes", ct.VOLUME[0], "Slope"]


def _schema(spark):
    return ct.attribute_schema(spark.createDataFrame(_WORDS, "attribute string, place int, code int"), renames={ct.VOLUME[0]: "traffic"})


def _sheets(spark, sf_dir):
    """A file per priority: one has other names, one no section, one lacks a column, one an offset."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("path", F.col("o_orderpriority"))
    k, c, first = F.col("o_orderkey"), F.col("o_custkey"), F.substring("path", 1, 1)
    plain = ["Section", "Distance", "Length", "Latitude start", "Longitude start", "Image Reference FPZ", "Comments", *_NAMES]
    heads = F.array(*map(F.lit, plain))
    other = F.array(*map(F.lit, [" section", "DISTANCE", *plain[2:9], "Traffic ", "slope"]))
    head = F.when(first == "1", F.concat(heads, F.array(F.lit("Offset_Distance_m")))).when(first == "2", other).when(first == "3", F.array(F.lit("Remarks"), F.lit("Lanes"))).when(first == "4", F.array_remove(heads, F.lit("Length"))).otherwise(heads)
    padding = k % 29 == 0
    text = k.cast("string")
    cells = F.array(
        F.when(~padding & (k % 17 != 0), F.concat(F.lit(" "), F.col("o_orderstatus"))),
        F.when(~padding, F.col("o_totalprice").cast("string")),
        F.when(~padding, F.when(k % 11 == 0, "0.03").when(k % 11 == 1, "0.0200001").otherwise("0.02")),
        F.when(~padding, F.when(k % 23 != 0, F.lit("10.5"))),
        F.when(~padding, F.lit("106")),
        F.when(~padding, F.when(k % 13 == 0, "frame 12").when(k % 13 == 1, F.concat(F.lit("x "), (c + 100000).cast("string"))).otherwise(F.concat(F.lit("Seg. No. 00"), c.cast("string")))),
        F.when(~padding & (k % 3 == 0), text),
        F.when(k % 5 != 0, F.concat((c % 5).cast("string"), F.lit(".0"))),
        F.when((k % 4 != 0) & (first != "5"), F.concat((c % 2 + 1).cast("string"), F.lit(" both"))),
        F.when(k % 7 != 0, (c * 37).cast("string")),
        F.when(k % 5 != 0, F.when(k % 6 != 0, (k % 2).cast("string")).otherwise("?")),
        F.when(k % 19 == 0, "7.5"),
    )
    body = o.select("path", (k + 1).alias("row"), cells.alias("cells"))
    return o.select("path", F.lit(0).cast("long").alias("row"), head.alias("cells")).distinct().unionByName(body)


def _parsed(spark, sf_dir):
    return ct.parse(_sheets(spark, sf_dir), _schema(spark))


def _codes(values="codes"):
    return F.array_join(F.transform(F.array(*map(F.lit, _NAMES)), lambda n: F.element_at(values, n).cast("string")), ",")


def coding_rows(spark, sf_dir):
    """Every row of the processed sheets with the reason that drops it, its segment and its codes."""
    return _parsed(spark, sf_dir).select("file", "row", "drop_reason", "section", "distance", "length", "lat", "segment", "comments", _codes().alias("codes"), "filled", F.array_join("given", ",").alias("given"), "bad_attribute", "bad_code")


def coding_kept(spark, sf_dir):
    """One row of each segment, that with most codes."""
    return ct.kept_rows(_parsed(spark, sf_dir)).select("segment", "file", "row", "section", _codes().alias("codes"), "copies")


def coding_duplicates(spark, sf_dir):
    return ct.duplicates(_parsed(spark, sf_dir))


def coding_conflicts(spark, sf_dir):
    return ct.conflicts(_parsed(spark, sf_dir)).select("segment", "attribute", F.array_join("codes", ",").alias("codes"))


def coding_file_states(spark, sf_dir):
    """Which sheets are coding tables, and what the others lack."""
    return ct.file_states(_sheets(spark, sf_dir), _schema(spark)).select("file", "status", F.array_join("missing", ",").alias("missing"))


def coding_file_report(spark, sf_dir):
    made = ct.file_report(_sheets(spark, sf_dir), _schema(spark), _parsed(spark, sf_dir))

    def told(name):
        return F.array_join(F.transform(F.map_entries(name), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias(name)

    return made.select("file", "status", "rows_non_empty", "rows_kept", "rows_with_missing", told("dropped"), F.array_join("empty", ",").alias("empty"), told("missing_values"))


def coding_attribute_report(spark, sf_dir):
    parsed = _parsed(spark, sf_dir)
    return ct.attribute_report(_schema(spark), parsed, ct.kept_rows(parsed))


def coding_drops(spark, sf_dir):
    """Dropped rows by file and reason, with totals over files."""
    return ct.drops(_parsed(spark, sf_dir))


_SQL = """WITH o AS (SELECT o_orderpriority AS file, o_orderpriority[1] AS f, o_orderkey AS k, o_custkey AS c, o_orderstatus AS st, o_totalprice AS price, o_orderkey % 29 = 0 AS pad FROM orders WHERE o_orderpriority[1] IN ('1', '2', '5')),
    x AS (SELECT *, k + 1 AS row, CASE WHEN NOT pad AND k % 17 <> 0 THEN st END AS section, CASE WHEN NOT pad THEN price::DOUBLE END AS distance,
            CASE WHEN NOT pad THEN CASE k % 11 WHEN 0 THEN 0.03 WHEN 1 THEN 0.0200001 ELSE 0.02 END END::DOUBLE AS length, CASE WHEN NOT pad AND k % 23 <> 0 THEN 10.5::DOUBLE END AS lat,
            CASE WHEN pad OR k % 13 = 0 THEN NULL WHEN k % 13 = 1 THEN (c + 100000)::VARCHAR ELSE c::VARCHAR END AS segment, CASE WHEN NOT pad AND k % 3 = 0 THEN k::VARCHAR ELSE '' END AS comments,
            CASE WHEN k % 5 <> 0 THEN c % 5 END AS a0, CASE WHEN k % 4 <> 0 AND f <> '5' THEN c % 2 + 1 END AS a1,
            CASE WHEN k % 7 <> 0 THEN CASE WHEN c * 37 >= 15000 THEN 1 WHEN c * 37 >= 10000 THEN 2 WHEN c * 37 >= 5000 THEN 3 WHEN c * 37 >= 1000 THEN 4 WHEN c * 37 >= 100 THEN 5 WHEN c * 37 >= 1 THEN 6 ELSE 7 END END AS a2,
            CASE WHEN k % 5 <> 0 AND k % 6 <> 0 THEN k % 2 END AS a3 FROM o),
    p AS (SELECT file, row, section, distance, length, lat, segment, comments, [a0, a1, a2, a3] AS a,
            CASE WHEN pad THEN 'padding' WHEN f = '1' AND k % 19 = 0 THEN 'annot_loc_offset_too_far' WHEN k % 11 = 0 THEN 'length_mismatch' WHEN section IS NULL OR lat IS NULL THEN 'missing_scalar'
                 WHEN segment IS NULL THEN 'bad_seg_id' WHEN a0 = 4 THEN 'unknown_code' WHEN coalesce(a0, a1, a2, a3) IS NULL THEN 'no_attributes' END AS drop_reason,
            array_to_string([coalesce(v, -1) FOR v IN [a0, a1, a2, a3]], ',') AS codes, (a0 IS NOT NULL)::INT + (a1 IS NOT NULL)::INT + (a2 IS NOT NULL)::INT + (a3 IS NOT NULL)::INT AS filled,
            concat_ws(',', CASE WHEN k % 5 <> 0 THEN 'Surface' END, CASE WHEN k % 4 <> 0 AND f <> '5' THEN 'Lanes' END, CASE WHEN k % 7 <> 0 THEN 'Intersecting road volume' END, CASE WHEN k % 5 <> 0 THEN 'Slope' END) AS given FROM x),
    g AS (SELECT * FROM p WHERE drop_reason IS NULL),
    w AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY filled DESC, file, row) AS rn, count(*) OVER (PARTITION BY segment) AS copies, lead(filled) OVER (PARTITION BY segment ORDER BY filled DESC, file, row) AS runner_up FROM g),
    names AS (SELECT unnest(['Surface', 'Lanes', 'Intersecting road volume', 'Slope']) AS attribute, unnest([1, 2, 3, 4]) AS i),
    gone AS (SELECT file, drop_reason, count(*) AS n FROM p WHERE drop_reason <> 'padding' GROUP BY GROUPING SETS ((file, drop_reason), (drop_reason))),
    empty AS (SELECT DISTINCT p.file, attribute FROM p, names WHERE (p.file, attribute) NOT IN (SELECT (file, unnest(string_split(given, ','))) FROM p)),
    lost AS (SELECT file, attribute, count(*) AS n FROM g, names WHERE a[i] IS NULL GROUP BY ALL)"""

QUERIES = {
    "coding_rows": (coding_rows, _SQL + " SELECT file, row, drop_reason, section, distance, length, lat, segment, comments, codes, filled, given, CASE WHEN drop_reason = 'unknown_code' THEN 'Surface' END AS bad_attribute, CASE WHEN drop_reason = 'unknown_code' THEN 4 END AS bad_code FROM p"),
    "coding_kept": (coding_kept, _SQL + " SELECT segment, file, row, section, codes, copies FROM w WHERE rn = 1"),
    "coding_duplicates": (coding_duplicates, _SQL + " SELECT segment, copies, file, row, filled, runner_up, CASE WHEN filled > runner_up THEN 'most filled' ELSE 'first' END AS why FROM w WHERE rn = 1 AND copies > 1"),
    "coding_conflicts": (coding_conflicts, _SQL + " SELECT segment, attribute, array_to_string(list_sort(list(DISTINCT a[i])), ',') AS codes FROM g, names WHERE a[i] IS NOT NULL GROUP BY segment, attribute HAVING count(DISTINCT a[i]) > 1"),
    "coding_file_states": (coding_file_states, """SELECT DISTINCT o_orderpriority AS file, CASE o_orderpriority[1] WHEN '3' THEN 'skipped' WHEN '4' THEN 'columns' ELSE 'processed' END AS status,
        CASE o_orderpriority[1] WHEN '4' THEN 'Length' ELSE '' END AS missing FROM orders"""),
    "coding_file_report": (coding_file_report, _SQL + """ SELECT s.file, CASE s.file[1] WHEN '3' THEN 'skipped' WHEN '4' THEN 'columns' ELSE 'processed' END AS status,
        (SELECT count(*) FROM p WHERE p.file = s.file AND given <> '' HAVING count(*) > 0) AS rows_non_empty, (SELECT count(*) FROM g WHERE g.file = s.file HAVING count(*) > 0) AS rows_kept,
        (SELECT count(*) FROM g WHERE g.file = s.file AND filled < 4 HAVING count(*) > 0) AS rows_with_missing,
        (SELECT string_agg(drop_reason || '=' || n, ',' ORDER BY drop_reason) FROM gone WHERE gone.file = s.file) AS dropped,
        (SELECT string_agg(attribute, ',' ORDER BY attribute) FROM empty WHERE empty.file = s.file) AS empty,
        (SELECT string_agg(attribute || '=' || n, ',' ORDER BY attribute) FROM lost WHERE lost.file = s.file) AS missing_values FROM (SELECT DISTINCT o_orderpriority AS file FROM orders) s"""),
    "coding_attribute_report": (coding_attribute_report, _SQL + """ SELECT attribute, (SELECT count(*) FROM empty e WHERE e.attribute = names.attribute) AS files_empty,
        (SELECT count(*) FROM w WHERE rn = 1 AND a[i] IS NULL) AS rows_missing, CASE attribute WHEN 'Surface' THEN (SELECT count(DISTINCT a[1]) FROM p WHERE drop_reason = 'unknown_code') ELSE 0 END AS unknown_codes FROM names"""),
    "coding_drops": (coding_drops, _SQL + " SELECT * FROM gone"),
}
