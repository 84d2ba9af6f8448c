"""GPS tracks as files: GPX and JSON in, GPX, JSON, GeoJSON and SQL out, and lists of cuts.

A table of points has ``track``, ``t`` (seconds), ``lat``, ``lon`` and for GPX ``ele``. Readers take any number of files
of any store that Spark reads; a track is a file, named by its path's last part. Writers make one file of each track from
its ordered lines, so no track is ever held in one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarmac.functions import codes, geo

_ZONE = r"(Z|[+-]\d\d:?\d\d)$"


def _track() -> Column:
    return F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("track")


def iso_seconds(text: Column) -> Column:
    """Seconds since 1970 of an ISO time, taken as UTC if it names no zone; null for other texts."""
    text = F.trim(text)
    return F.unix_micros(F.try_to_timestamp(F.when(text.rlike(_ZONE), text).otherwise(F.concat(text, F.lit("Z"))))) / 1e6


def read_gpx(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(track, t, lat, lon, ele): points with a time; of points of equal time the greatest by (lat, lon, ele) is kept."""
    found = spark.read.format("xml").option("rowTag", "trkpt").schema("_lat double, _lon double, ele double, time string").load(path)
    points = found.select(_track(), iso_seconds(F.col("time")).alias("t"), F.struct(F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), "ele").alias("p"))
    return points.where("t is not null").groupBy("track", "t").agg(F.max("p").alias("p")).select("track", "t", "p.*")


def read_webgis(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(track, timeoffset, t, lat, lon): points of JSON lists; the offset stands in an element of its own, 0 if there is none."""
    found = spark.read.schema("timeoffset double, time double, coordinates array<double>").json(path, multiLine=True)
    rows = found.select(_track(), "*")
    offsets = rows.where("timeoffset is not null").groupBy("track").agg(F.max("timeoffset").alias("timeoffset"))
    points = rows.where("timeoffset is null and time is not null and size(coordinates) = 2").drop("timeoffset")
    joined = points.join(offsets, "track", "left")
    return joined.select("track", F.coalesce("timeoffset", F.lit(0.0)).alias("timeoffset"), F.col("time").alias("t"), F.get("coordinates", F.lit(1)).alias("lat"), F.get("coordinates", F.lit(0)).alias("lon"))


#: A quoted text, whose own quotes are doubled; a value is one, a call with texts in it, or a word.
_QUOTED = r"'[^']*+(?:''[^']*+)*+'"
_VALUE = rf"{_QUOTED}|\w++\s*+\((?:{_QUOTED}|[^()'])*+\)|[^\s,()']++"


def read_insert(spark: SparkSession, path: str | list[str], default_table: str) -> DataFrame:
    """(track, table, filename, recording_start, uploaded_by, gis_map_id): fields of INSERT statements, null where a text has none.

    Values belong to the statement's columns by their places, in whatever order and case these stand; a statement without
    columns has the four in the order above. Doubled quotes stand for one.
    """
    fields = ["filename", "recording_start", "uploaded_by", "gis_map_id"]
    text = spark.read.text(path, wholetext=True).select(_track(), F.col("value").alias("sql"))
    keyword = F.regexp_instr("sql", F.lit(r"(?i)\bvalues\s*\("))
    before = F.when(keyword > 0, F.col("sql").substr(F.lit(1), keyword - 1)).otherwise(F.col("sql"))
    after = F.when(keyword > 0, F.col("sql").substr(keyword, F.length("sql"))).otherwise(F.lit(""))
    target = F.regexp_replace(before, r"(?is)^.*?\binto\s+", "")
    named = F.trim(F.substring_index(target, "(", 1))
    table = F.when(before.rlike(r"(?i)\binto\s") & (F.instr(target, "(") > 0) & (named != ""), named)
    listed = F.lower(F.regexp_replace(F.substring_index(F.substring_index(target, ")", 1), "(", -1), r'[\s"]', ""))
    columns = F.when(F.instr(target, "(") > 0, F.split(listed, ",")).otherwise(F.array(*[F.lit(f) for f in fields]))
    values = F.regexp_extract_all(F.regexp_replace(after, r"(?i)^values\s*\(", ""), F.lit(f"({_VALUE})"), F.lit(1))
    parsed = text.select("track", table.alias("table"), columns.alias("columns"), values.alias("values"))
    at = {f: F.array_position("columns", F.lit(f)) for f in fields}
    out = parsed.select("track", F.coalesce("table", F.lit(default_table)).alias("table"), *[F.when(at[f] > 0, F.get("values", (at[f] - 1).cast("int"))).alias(f) for f in fields])
    for f in fields:
        raw = F.col(f)
        quoted = F.replace(raw.substr(F.lit(2), F.length(raw) - 2), F.lit("''"), F.lit("'"))
        out = out.withColumn(f, F.when(raw.startswith("'"), quoted).when(F.lower(raw) != "null", raw))
    return out


def cut_list(lines: DataFrame, line: str = "value") -> DataFrame:
    """(stem, cuts, bad) of lines ``stem time time ...``: distinct cut times in order, over all lines of a stem, and the bad tokens.

    Lines are typed by hand, so a stem has few. A stem without a time has no cuts and is left to the caller.
    """
    words = lines.select(F.filter(F.split(F.trim(F.col(line)), r"\s+"), lambda w: w != "").alias("w")).where("size(w) > 0")
    tokens = words.select(F.col("w")[0].alias("stem"), F.explode_outer(F.slice("w", F.lit(2), F.size("w"))).alias("token"))
    timed = tokens.withColumn("at", codes.timecode(F.col("token")))
    return timed.groupBy("stem").agg(F.array_sort(F.collect_set("at")).alias("cuts"), F.array_sort(F.collect_set(F.when(F.col("at").isNull(), F.col("token")))).alias("bad"))


def _lines(points: DataFrame, head: Column, line: Column, foot: Column, keep: list[str], between: str = "") -> DataFrame:
    """(track, part, t, value): a head, a line for each point in order of time, and a foot; ``between`` ends all points but the last."""
    ends = points.groupBy("track").agg(F.count(F.lit(1)).alias("n"), *[F.max(c).alias(c) for c in keep])
    if between:
        last = F.lead("t").over(Window.partitionBy("track").orderBy("t")).isNull()
        line = F.concat(line, F.when(last, F.lit("")).otherwise(F.lit(between)))
    body = points.select("track", F.lit(1).alias("part"), F.col("t").cast("double").alias("t"), line.alias("value"))
    outer = ends.select("track", F.explode(F.array(F.struct(F.lit(0).alias("part"), head.alias("value")), F.struct(F.lit(2).alias("part"), foot.alias("value")))).alias("e"))
    return body.unionByName(outer.select("track", "e.part", F.lit(None).cast("double").alias("t"), "e.value"))


def _millis(t: Column) -> Column:
    return F.date_format(F.timestamp_micros(F.floor(t * 1000).cast("long") * 1000), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def gpx_lines(points: DataFrame, creator: str = "tarmac") -> DataFrame:
    """Lines of GPX 1.1: coordinates with 7 decimals, elevation with 3, times in milliseconds (of a UTC session)."""
    line = F.concat(
        F.format_string('      <trkpt lat="%.7f" lon="%.7f">', F.col("lat").cast("double"), F.col("lon").cast("double")),
        F.when(F.col("ele").isNotNull(), F.format_string("<ele>%.3f</ele>", F.col("ele").cast("double"))).otherwise("") if "ele" in points.columns else F.lit(""),
        F.lit("<time>"), _millis(F.col("t")), F.lit("</time></trkpt>"),
    )
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<gpx xmlns="http://www.topografix.com/GPX/1/1" version="1.1" creator="{creator}">\n  <trk>\n    <trkseg>'
    return _lines(points, F.lit(head), line, F.lit("    </trkseg>\n  </trk>\n</gpx>"), [])


def webgis_lines(points: DataFrame) -> DataFrame:
    """Lines of a JSON list: the time offset (column ``timeoffset``), then times with (lon, lat)."""
    line = F.to_json(F.struct(F.col("t").alias("time"), F.array("lon", "lat").alias("coordinates")))
    return _lines(points, F.concat(F.lit("["), F.to_json(F.struct("timeoffset")), F.lit(",")), line, F.lit("]"), ["timeoffset"], ",")


def geojson_lines(points: DataFrame, extension: str = ".mp4") -> DataFrame:
    """Lines of a feature collection with one line string; the file's name is a property."""
    name = F.to_json(F.struct(F.concat("track", F.lit(extension)).alias("FILENAME")))
    head = F.concat(F.lit('{"type":"FeatureCollection","features":[{"type":"Feature","properties":'), name, F.lit(',"geometry":{"type":"LineString","coordinates":['))
    return _lines(points, head, F.to_json(F.array("lon", "lat")), F.lit("]}}]}"), [], ",")


def insert_lines(points: DataFrame, table: str) -> DataFrame:
    """Lines of an INSERT statement with the projected line; ``points`` also has recording_start, uploaded_by and gis_map_id."""
    names = ["recording_start", "uploaded_by", "gis_map_id"]

    def quoted(c):
        return F.concat(F.lit("'"), F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("'"), F.lit("''")), F.lit("'"))

    head = F.concat(F.lit(f"INSERT INTO {table}(filename,recording_start,uploaded_by,gis_map_id,the_geom) VALUES ("), F.concat_ws(",", *[quoted(c) for c in ["track", *names]]), F.lit(",ST_GeomFromText('LINESTRING("))
    line = F.concat_ws(" ", geo.mercator_x(F.col("lon")).cast("string"), geo.mercator_y(F.col("lat")).cast("string"))
    return _lines(points, head, line, F.lit(")',3857));"), names, ",")


def write_lines(lines: DataFrame, path: str) -> None:
    """One text file for each track, below ``path/track=<track>``; the lines are sorted within tasks and streamed out."""
    lines.repartition("track").sortWithinPartitions("track", "part", "t").select("track", "value").write.partitionBy("track").text(path)
