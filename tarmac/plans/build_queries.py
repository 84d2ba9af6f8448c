"""Queries of headers and builds: brands of ``part`` stand for files whose headers were typed by hand, priorities for files of a build."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.operators import tables


def _headers(spark, sf_dir):
    """Headers are types of parts: some as they are, some in capitals, some renamed, some misspelt, some with spaces."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_brand", "p_type", "p_partkey")
    kind = F.col("p_partkey") % 5
    header = (
        F.when(kind == 0, F.col("p_type"))
        .when(kind == 1, F.lower("p_type"))
        .when(kind == 2, F.concat(F.lit("New "), "p_type"))
        .when(kind == 3, F.concat(F.substring("p_type", 1, 3), F.col("p_type").substr(F.lit(5), F.length("p_type"))))
        .otherwise(F.concat(F.lit("  "), "p_type", F.lit(" ")))
    )
    return part.select(F.col("p_brand").alias("file"), header.alias("header"), F.col("p_type").alias("name"))


def _resolved(spark, sf_dir):
    rows = _headers(spark, sf_dir)
    names = rows.select("name").distinct()
    return tables.resolve_columns(rows, names, names.select("name", F.concat(F.lit("new "), F.lower("name")).alias("header")))


def resolved_columns(spark, sf_dir):
    """How each brand's headers stand for the types of all parts, with suggestions for those that are missing."""
    return _resolved(spark, sf_dir)


def coding_tables(spark, sf_dir):
    """Whether a brand has a header for the type of the first part and one of the second part's, whatever the case."""
    rows = _headers(spark, sf_dir)
    types = [r.name for r in rows.select("name").distinct().orderBy("name").limit(2).collect()]
    return tables.coding_tables(rows, spark.createDataFrame([(types[1],)], "name string"), types[0].lower())


def _builds(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderpriority").alias("file"), F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("value"), "o_custkey")
    old = orders.where("file <> '5-LOW'")
    changed = F.when((F.col("file") == "1-URGENT") & (F.col("key") % 5 == 0), F.lit(None).cast("string")).otherwise(F.col("value"))
    new = orders.where("file <> '4-NOT SPECIFIED' and not (file = '2-HIGH' and key % 7 = 0)").withColumn("value", changed)
    extra = orders.where("file = '2-HIGH' and o_custkey % 3 = 0").withColumn("key", -F.col("key"))
    keep = ["file", "key", "value"]
    return old.select(*keep), new.unionByName(extra).select(*keep)


def build_comparison(spark, sf_dir):
    """Two builds of orders by priority: one file is equal, two are changed, two are of one build only."""
    return tables.compare_builds(*_builds(spark, sf_dir))


_HEADERS = """WITH h AS (SELECT p_brand AS file, p_type AS name, trim(regexp_replace(CASE p_partkey % 5 WHEN 0 THEN p_type WHEN 1 THEN lower(p_type) WHEN 2 THEN 'New ' || p_type
        WHEN 3 THEN substring(p_type, 1, 3) || substring(p_type, 5) ELSE '  ' || p_type || ' ' END, '\\s+', ' ', 'g')) AS header FROM part)"""

QUERIES = {
    "resolved_columns": (resolved_columns, _HEADERS + """,
        d AS (SELECT DISTINCT file, header FROM h), n AS (SELECT DISTINCT name, 'new ' || lower(name) AS renamed FROM h),
        m AS (SELECT f.file, n.name,
                     (SELECT min(header) FROM d WHERE d.file = f.file AND header = name) AS e, (SELECT min(header) FROM d WHERE d.file = f.file AND lower(header) = lower(name)) AS c,
                     (SELECT min(header) FROM d WHERE d.file = f.file AND header = renamed) AS re, (SELECT min(header) FROM d WHERE d.file = f.file AND lower(header) = lower(renamed)) AS rc
              FROM (SELECT DISTINCT file FROM h) f, n),
        r AS (SELECT file, name, coalesce(e, c, re, rc) AS header, CASE WHEN e IS NOT NULL THEN 'exact' WHEN c IS NOT NULL THEN 'case' WHEN coalesce(re, rc) IS NOT NULL THEN 'rename' ELSE 'missing' END AS how FROM m),
        u AS (SELECT * FROM d WHERE (file, header) NOT IN (SELECT (file, header) FROM r WHERE header IS NOT NULL)),
        s AS (SELECT r.file, r.name, u.header, levenshtein(lower(name), lower(u.header)) / greatest(length(name), length(u.header)) AS far FROM r JOIN u ON r.file = u.file AND how = 'missing'),
        b AS (SELECT file, name, arg_min(header, (far, header)) AS suggestion FROM s WHERE 1 - far >= 0.6 GROUP BY ALL)
        SELECT r.*, suggestion FROM r LEFT JOIN b USING (file, name)"""),
    "coding_tables": (coding_tables, _HEADERS + """, t AS (SELECT lower(name) AS name, row_number() OVER (ORDER BY name) AS k FROM (SELECT DISTINCT name FROM h))
        SELECT file, bool_or(lower(header) = (SELECT name FROM t WHERE k = 1)) AND bool_or(lower(header) = (SELECT name FROM t WHERE k = 2)) AS is_table FROM h GROUP BY file"""),
    "build_comparison": (build_comparison, """WITH o AS (SELECT o_orderpriority AS file, o_orderkey AS key, o_orderstatus AS value, o_custkey FROM orders),
        a AS (SELECT file, key, value FROM o WHERE file <> '5-LOW'),
        b AS (SELECT file, key, CASE WHEN file = '1-URGENT' AND key % 5 = 0 THEN NULL ELSE value END AS value FROM o WHERE file <> '4-NOT SPECIFIED' AND NOT (file = '2-HIGH' AND key % 7 = 0)
              UNION ALL SELECT file, -key, value FROM o WHERE file = '2-HIGH' AND o_custkey % 3 = 0),
        j AS (SELECT coalesce(a.file, b.file) AS file, a.key IS NOT NULL AS x, b.key IS NOT NULL AS y, a.value IS DISTINCT FROM b.value AS differs FROM a FULL JOIN b ON a.file = b.file AND a.key = b.key)
        SELECT file, CASE WHEN NOT bool_or(x) THEN 'new only' WHEN NOT bool_or(y) THEN 'old only' WHEN bool_and(x AND y AND NOT differs) THEN 'identical' ELSE 'different' END AS state,
               count(*) FILTER (x AND NOT y) AS only_old, count(*) FILTER (y AND NOT x) AS only_new, count(*) FILTER (x AND y AND differs) AS changed FROM j GROUP BY file"""),
}
