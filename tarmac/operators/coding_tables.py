"""Coding tables: sheets of coded road segments become normal rows, with the reason of every row that is dropped, and reports.

Sheets are (path, row, cells): arrays of texts whose row 0 holds the headers, as ``sources.spreadsheets`` reads them. Headers
are asked for several times, so sheets should be a written table, from which they are read alone; ``write_parse`` writes one.
A schema is (attribute, place, codes, renamed) with a row for each attribute, so it is small and is sent to all tasks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.functions import codes
from tarmac.operators import tables

# The headers every coding table has, the header of the optional offset, the code of a missing value, and the
# least vehicles a day of each code of the attribute that is given as a volume.
SCALARS = ("Section", "Distance", "Length", "Latitude start", "Longitude start", "Image Reference FPZ", "Comments")
OFFSET = "offset_distance_m"
MISSING = -1
VOLUME = ("Intersecting road volume", (15000, 10000, 5000, 1000, 100, 1))

#: A row that is blank in all of ``SCALARS``; it stands in the rows but is counted nowhere.
PADDING = "padding"


@dataclass(frozen=True)
class Rules:
    """What a row must meet; ``classified`` gives the limits of attributes whose cells hold amounts in place of codes."""

    length: float = 0.02
    tolerance: float = 1e-6
    offset: float = 5.0
    drop_missing: bool = False
    classified: Mapping[str, Sequence[float]] = field(default_factory=lambda: dict([VOLUME]))


def attribute_schema(vocabulary: DataFrame, ignored: Sequence[str] = (), renames: Mapping[str, str] | None = None) -> DataFrame:
    """(attribute, place, codes, renamed) from a vocabulary's (attribute, place, code): the valid codes of each attribute.

    Attributes that are ignored are left out; ``renames`` gives the header under which a table may hold an attribute.
    """
    other = F.lit(None).cast("string")
    for name, header in (renames or {}).items():
        other = F.when(F.col("attribute") == name, header).otherwise(other)
    each = vocabulary.groupBy("attribute").agg(F.min("place").alias("place"), F.array_sort(F.collect_set("code")).alias("codes"))
    return each.where(~F.col("attribute").isin(list(ignored))).withColumn("renamed", other)


def _headers(sheets: DataFrame) -> DataFrame:
    head = sheets.where("row = 0").select(F.col("path").alias("file"), F.posexplode("cells").alias("at", "header"))
    return head.withColumn("header", tables.trimmed(F.col("header"))).where("header <> ''")


def _asked(sheets: DataFrame, schema: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Headers, required names and renames, as ``tables`` takes them."""
    names = schema.select(F.col("attribute").alias("name"))
    wanted = names.unionByName(sheets.sparkSession.createDataFrame([(s,) for s in SCALARS], "name string"))
    renames = schema.where("renamed is not null").select(F.col("attribute").alias("name"), F.col("renamed").alias("header"))
    return _headers(sheets).select("file", "header"), wanted, renames


def resolved(sheets: DataFrame, schema: DataFrame) -> DataFrame:
    """(file, name, header, how, suggestion) of the required names of every file; see ``tables.resolve_columns``."""
    return tables.resolve_columns(*_asked(sheets, schema))


def file_states(sheets: DataFrame, schema: DataFrame) -> DataFrame:
    """(file, status, missing): ``skipped`` without a section column or any attribute, ``columns`` if required names are missing, else ``processed``.

    ``missing`` lists the names that no header stands for, in order, with the most similar header that is left behind an
    arrow. A file without any header is ``skipped``.
    """
    is_table = tables.coding_tables(_headers(sheets), schema.select(F.col("attribute").alias("name")))
    told = F.concat(F.col("name"), F.coalesce(F.concat(F.lit(" -> "), F.col("suggestion")), F.lit("")))
    lacks = resolved(sheets, schema).where("how = 'missing'").groupBy("file").agg(F.array_sort(F.collect_list(told)).alias("missing"))
    files = sheets.select(F.col("path").alias("file")).distinct().join(is_table, "file", "left").join(lacks, "file", "left")
    status = F.when(~F.coalesce("is_table", F.lit(False)), "skipped").when(F.col("missing").isNotNull(), "columns").otherwise("processed")
    return files.select("file", status.alias("status"), F.when(status == "columns", F.col("missing")).otherwise(F.array().cast("array<string>")).alias("missing"))


def _places(sheets: DataFrame, schema: DataFrame) -> DataFrame:
    """(file, places): the place of every required name in the cells of a processed file, and of the offset if it is there.

    A file that lacks no name has the section's column and those of all attributes, so it is a coding table.
    """
    heads = _headers(sheets).groupBy("file", "header").agg(F.min("at").alias("at"))
    met = tables.met_columns(*_asked(sheets, schema)).join(heads, ["file", "header"], "left").select("file", "name", "at")
    offset = heads.where(F.lower("header") == OFFSET).groupBy("file").agg(F.lit(OFFSET).alias("name"), F.min("at").alias("at"))
    each = met.unionByName(offset.select("file", "name", "at")).groupBy("file")
    return each.agg(F.map_from_entries(F.collect_list(F.struct("name", "at"))).alias("places"), F.count_if(F.col("at").isNull()).alias("lacking")).where("lacking = 0").drop("lacking")


def segment_number(cell: Column) -> Column:
    """The number behind ``seg no`` in any case, with or without points, else the first whole number of four or more digits, without leading zeros."""
    named = F.nullif(F.regexp_extract(cell, r"(?i)seg\.?\s*no\.?\s*(\d+)", 1), F.lit(""))
    found = F.coalesce(named, F.nullif(F.regexp_extract(cell, r"\b(\d{4,})\b", 1), F.lit("")))
    return F.regexp_replace(found, r"^0+(?=\d)", "")


def _code(name: Column, cell: Column, classified: Mapping[str, Sequence[float]]) -> Column:
    out = codes.lenient_int(cell)
    for attribute, limits in classified.items():
        out = F.when(name == attribute, codes.bucket(codes.lenient_float(cell), list(limits))).otherwise(out)
    return out


def parse(sheets: DataFrame, schema: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per row of the processed files below the headers, in normal form and with its ``drop_reason`` (null: kept).

    Columns: file, row, drop_reason, section, distance, length, lat, lon, segment, comments, codes (attribute to code, -1
    where the cell gives none), filled (number of given codes), given (attributes whose cells aren't blank), bad_attribute and
    bad_code (what dropped the row, the first attribute in order). Reasons, the first that holds: ``padding``,
    ``annot_loc_offset_too_far``, ``length_mismatch``, ``missing_scalar``, ``bad_seg_id``, ``missing_attribute`` (only with
    ``drop_missing``) or ``unknown_code``, ``no_attributes``. Files that aren't processed give no rows; ``file_states``
    says why.

    All cells of a row are resolved in the row, so rows are only joined with the places of their file's columns: a short map
    for each file, sent to all tasks, as files are few and long, and a shuffle by file would make each one task's rows.
    """
    ordered = schema.agg(F.array_sort(F.collect_list(F.struct("place", "attribute", "codes"))).alias("attributes"))
    body = sheets.where("row > 0").withColumnRenamed("path", "file").join(F.broadcast(_places(sheets, schema)), "file")
    body = body.crossJoin(F.broadcast(ordered))  # one row of the size of the schema

    def cell(name: Column | str) -> Column:
        at = F.element_at("places", F.lit(name) if isinstance(name, str) else name)
        return F.when(at.isNotNull(), F.get("cells", at))

    amounts = F.array(*[F.lit(n) for n in rules.classified]) if rules.classified else F.array().cast("array<string>")
    raw = F.transform("attributes", lambda a: F.struct(a["attribute"].alias("attribute"), a["codes"].alias("valid"), cell(a["attribute"]).alias("cell")))
    body = body.withColumn("raw", raw)
    read = F.transform("raw", lambda a: F.struct(a["attribute"].alias("attribute"), a["valid"].alias("valid"), _code(a["attribute"], a["cell"], rules.classified).alias("code")))
    body = body.withColumn("read", read)

    def unknown(a: Column) -> Column:
        return a["code"].isNotNull() & ~F.array_contains(a["valid"], a["code"]) & ~F.array_contains(amounts, a["attribute"])

    def bad(a: Column) -> Column:
        return unknown(a) | a["code"].isNull() if rules.drop_missing else unknown(a)

    body = body.withColumn("bad", F.get(F.filter("read", bad), F.lit(0))).withColumn("filled", F.size(F.filter("read", lambda a: a["code"].isNotNull())))
    values = {n: codes.lenient_float(cell(n)) for n in ("Distance", "Length", "Latitude start", "Longitude start")}
    section, image = cell("Section"), cell("Image Reference FPZ")
    blank = F.lit(True)
    for name in SCALARS:
        blank = blank & codes.is_blank(cell(name))
    length = values["Length"]
    lacks = codes.is_blank(section) | values["Distance"].isNull() | values["Latitude start"].isNull() | values["Longitude start"].isNull()
    reason = codes.first_reason([
        (PADDING, blank),
        ("annot_loc_offset_too_far", codes.lenient_float(cell(OFFSET)) > rules.offset),
        ("length_mismatch", length.isNull() | (F.abs(length - rules.length) > rules.tolerance)),
        ("missing_scalar", lacks),
        ("bad_seg_id", segment_number(image).isNull()),
        ("missing_attribute", F.col("bad").isNotNull() & F.col("bad.code").isNull()),
        ("unknown_code", F.col("bad").isNotNull()),
        ("no_attributes", F.col("filled") == 0),
    ])
    return body.withColumn("drop_reason", reason).select(
        "file",
        "row",
        "drop_reason",
        F.trim(section).alias("section"),
        values["Distance"].alias("distance"),
        length.alias("length"),
        values["Latitude start"].alias("lat"),
        values["Longitude start"].alias("lon"),
        segment_number(image).alias("segment"),
        F.when(codes.is_blank(cell("Comments")), "").otherwise(cell("Comments")).alias("comments"),
        F.map_from_entries(F.transform("read", lambda a: F.struct(a["attribute"], F.coalesce(a["code"], F.lit(MISSING))))).alias("codes"),
        "filled",
        F.transform(F.filter("raw", lambda a: ~codes.is_blank(a["cell"])), lambda a: a["attribute"]).alias("given"),
        F.when(F.col("drop_reason").isin("missing_attribute", "unknown_code"), F.col("bad.attribute")).alias("bad_attribute"),
        F.when(F.col("drop_reason") == "unknown_code", F.col("bad.code")).alias("bad_code"),
    )


def kept_rows(parsed: DataFrame) -> DataFrame:
    """The rows without a reason, one per segment: that with most codes, the first by file and row among equals; ``copies`` counts all.

    Rows are reduced before they are shuffled, so a segment of very many copies is no matter.
    """
    good = parsed.where("drop_reason is null").drop("drop_reason", "given", "bad_attribute", "bad_code")
    rest = [c for c in good.columns if c != "segment"]
    best = F.min_by(F.struct(*rest), F.struct(-F.col("filled"), F.col("file"), F.col("row")))
    return good.groupBy("segment").agg(best.alias("r"), F.count(F.lit(1)).alias("copies")).select("segment", "r.*", "copies")


def duplicates(parsed: DataFrame) -> DataFrame:
    """(segment, copies, file, row, filled, runner_up, why) of segments with several rows: the row that stays and its codes against the next one's.

    ``why`` is ``most filled`` or ``first``, where the next has as many codes.
    """
    good = parsed.where("drop_reason is null")
    counts = good.groupBy("segment", "filled").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("file", "row")).alias("at"))
    # A segment has at most as many lines here as there are numbers of codes.
    lines = F.reverse(F.array_sort(F.collect_list(F.struct("filled", "n", "at"))))
    each = counts.groupBy("segment").agg(lines.alias("l"), F.sum("n").alias("copies")).where("copies > 1")
    best = F.col("l")[0]
    runner = F.when(best["n"] > 1, best["filled"]).otherwise(F.get("l", F.lit(1))["filled"])
    return each.select("segment", "copies", best["at"]["file"].alias("file"), best["at"]["row"].alias("row"), best["filled"].alias("filled"), runner.alias("runner_up"), F.when(best["filled"] > runner, "most filled").otherwise("first").alias("why"))


def conflicts(parsed: DataFrame) -> DataFrame:
    """(segment, attribute, codes): attributes to which rows of one segment give different codes, in order."""
    each = parsed.where("drop_reason is null").select("segment", F.explode("codes").alias("attribute", "code")).where(F.col("code") != MISSING)
    return each.groupBy("segment", "attribute").agg(F.array_sort(F.collect_set("code")).alias("codes")).where(F.size("codes") > 1)


def drops(parsed: DataFrame) -> DataFrame:
    """(file, drop_reason, n): dropped rows by file and reason, with a line of all files whose ``file`` is null."""
    gone = parsed.where(F.col("drop_reason").isNotNull() & (F.col("drop_reason") != PADDING))
    return gone.groupingSets([["file", "drop_reason"], ["drop_reason"]], "file", "drop_reason").agg(F.count(F.lit(1)).alias("n"))


def missing_values(parsed: DataFrame) -> DataFrame:
    """(file, attribute, n): rows without a reason whose code is missing, before copies are resolved."""
    each = parsed.where("drop_reason is null").select("file", F.explode("codes").alias("attribute", "code")).where(F.col("code") == MISSING)
    return each.groupBy("file", "attribute").agg(F.count(F.lit(1)).alias("n"))


def empty_attributes(parsed: DataFrame, schema: DataFrame) -> DataFrame:
    """(file, attribute): attributes of which a processed file with rows has no value at all."""
    files = parsed.select("file").distinct()
    every = files.join(F.broadcast(schema.select("attribute")), how="cross")  # files times the schema's attributes
    return every.join(parsed.select("file", F.explode("given").alias("attribute")).distinct(), ["file", "attribute"], "left_anti")


def file_report(sheets: DataFrame, schema: DataFrame, parsed: DataFrame) -> DataFrame:
    """A row for each file: status, missing names, rows_non_empty, rows_kept, rows_with_missing, dropped, empty and missing_values.

    ``dropped`` and ``missing_values`` map reasons and attributes to numbers of rows; ``empty`` lists attributes without any
    value in the file. Rows are counted before copies are resolved. Files that aren't processed have no counts.
    """
    good = F.col("drop_reason").isNull()
    lacking = F.map_keys(F.map_filter("codes", lambda _, c: c == MISSING))

    def each(kind: str, names: Column, condition: Column) -> Column:
        return F.when(condition, F.transform(names, lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name")))).otherwise(F.array().cast("array<struct<kind:string,name:string>>"))

    # One pass: a row tells of what it counts for, and is counted before it is shuffled.
    no_name = F.array(F.lit(None).cast("string"))
    told = F.flatten(F.array(
        each("row", no_name, F.lit(True)), each("non-empty", no_name, F.size("given") > 0), each("kept", no_name, good), each("lacks", no_name, good & (F.size(lacking) > 0)),
        each("dropped", F.array("drop_reason"), ~good & (F.col("drop_reason") != PADDING)), each("given", F.col("given"), F.lit(True)), each("missing", lacking, good),
    ))
    tally = parsed.select("file", F.explode(told).alias("t")).groupBy("file", "t").agg(F.count(F.lit(1)).alias("n"))

    def count(kind: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("t.kind") == kind, F.col("n"))), F.lit(0))

    def lists(kind: str) -> Column:
        found = F.array_sort(F.collect_list(F.when(F.col("t.kind") == kind, F.struct("t.name", "n"))))
        return F.when(F.size(found) > 0, F.map_from_entries(found))

    every = schema.agg(F.array_sort(F.collect_list("attribute")).alias("every"))
    counts = tally.groupBy("file").agg(
        count("non-empty").alias("rows_non_empty"), count("kept").alias("rows_kept"), count("lacks").alias("rows_with_missing"),
        lists("dropped").alias("dropped"), F.collect_set(F.when(F.col("t.kind") == "given", F.col("t.name"))).alias("given"), lists("missing").alias("missing_values"),
    )
    empty = F.array_except("every", "given")
    counts = counts.crossJoin(F.broadcast(every)).withColumn("empty", F.when(F.size(empty) > 0, empty))  # one row of the size of the schema
    return file_states(sheets, schema).join(counts.select("file", "rows_non_empty", "rows_kept", "rows_with_missing", "dropped", "empty", "missing_values"), "file", "left")


def attribute_report(schema: DataFrame, parsed: DataFrame, kept: DataFrame) -> DataFrame:
    """(attribute, files_empty, rows_missing, unknown_codes): files without a value, rows of ``kept_rows`` without one, distinct codes outside the vocabulary."""
    none = F.array().cast("array<struct<kind:string,file:string,attribute:string,code:bigint>>")

    def fact(kind: str, file: Column, attribute: Column, code: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), file.alias("file"), attribute.cast("string").alias("attribute"), code.cast("long").alias("code"))

    # One pass over the rows: files, their attributes with a value, and unknown codes, each once.
    null, file = F.lit(None).cast("string"), F.col("file").cast("string")
    given = F.transform("given", lambda a: fact("given", file, a, null))
    bad = F.when(F.col("bad_code").isNotNull(), F.array(fact("bad", null, F.col("bad_attribute"), F.col("bad_code")))).otherwise(none)
    facts = parsed.select(F.explode(F.concat(F.array(fact("file", file, null, null)), given, bad)).alias("f")).distinct()
    count = {kind: F.count_if(F.col("f.kind") == kind).alias(kind) for kind in ("file", "given", "bad")}
    told = facts.groupBy("f.attribute").agg(*count.values())  # a line for each attribute, and one for the files
    met = F.map_from_entries(F.collect_list(F.when(F.col("attribute").isNotNull(), F.struct("attribute", F.struct("given", "bad")))))
    told = told.agg(F.coalesce(F.sum("file"), F.lit(0)).alias("files"), met.alias("met"))
    missing = kept.select(F.explode("codes").alias("attribute", "code")).groupBy("attribute").agg(F.count_if(F.col("code") == MISSING).alias("rows_missing"))
    out = schema.select("attribute").crossJoin(F.broadcast(told)).join(missing, "attribute", "left")  # one row of the size of the schema
    own = F.element_at("met", F.col("attribute"))
    out = out.select("attribute", (F.col("files") - F.coalesce(own["given"], F.lit(0))).alias("files_empty"), "rows_missing", own["bad"].alias("unknown_codes"))
    return out.fillna(0, ["files_empty", "rows_missing", "unknown_codes"])


def summary(states: DataFrame, parsed: DataFrame, kept: DataFrame) -> DataFrame:
    """One row: files by status, rows kept, with a missing value, dropped and dropped as copies, and sections."""
    files = states.agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("status") == "processed").alias("files_processed"), F.count_if(F.col("status") == "skipped").alias("files_skipped"))
    gone = parsed.agg(F.count_if(F.col("drop_reason").isNotNull() & (F.col("drop_reason") != PADDING)).alias("rows_dropped"))
    lacks = F.exists(F.map_values("codes"), lambda c: c == MISSING)
    rows = kept.agg(F.count(F.lit(1)).alias("rows_kept"), F.count_if(lacks).alias("rows_with_missing"), F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("dropped_copies"), F.count_distinct("section").alias("sections"))
    return files.crossJoin(gone).crossJoin(rows)  # one row each


def write_parse(sheets: DataFrame, schema: DataFrame, path: str, rules: Rules = Rules()) -> None:
    """Writes ``rows`` (Parquet, a column per attribute) and ``report/files``, ``report/attributes`` and ``report/summary`` (JSON lines) below ``path``.

    The sheets are read once and written, their rows are parsed once and written; everything else is read from these two
    tables (``sheets`` and ``parsed``), so losing executors costs no second reading. Files whose required columns are missing
    give an error before a row is parsed.
    """
    sheets.write.mode("overwrite").parquet(f"{path}/sheets")
    sheets = sheets.sparkSession.read.parquet(f"{path}/sheets")
    states = file_states(sheets, schema)
    wrong = states.where("status = 'columns'").orderBy("file").limit(5).collect()
    if wrong:
        raise ValueError("columns are missing: " + "; ".join(f"{r.file}: {', '.join(r.missing)}" for r in wrong))
    spark = sheets.sparkSession
    parse(sheets, schema, rules).write.mode("overwrite").parquet(f"{path}/parsed")
    parsed = spark.read.parquet(f"{path}/parsed")
    names = [r.attribute for r in schema.orderBy("place").select("attribute").collect()]
    kept_rows(parsed).select("segment", "section", "distance", "length", "lat", "lon", "comments", F.col("file").alias("source_file"), "copies", "row", *[F.element_at("codes", F.lit(n)).alias(n) for n in names]).write.mode("overwrite").parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    kept = rows.select("section", "copies", F.create_map(*[x for n in names for x in (F.lit(n), F.col(f"`{n}`"))]).alias("codes"))
    for name, report in (("files", file_report(sheets, schema, parsed)), ("attributes", attribute_report(schema, parsed, kept)), ("summary", summary(states, parsed, kept))):
        report.write.mode("overwrite").json(f"{path}/report/{name}")
