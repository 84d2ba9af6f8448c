"""Headers of tables that were named by hand, and comparison of two builds of files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least similarity of a suggestion: one minus the edit distance over the longer name's length.
SIMILAR = 0.6


def trimmed(header):
    """A header without white space at its ends, and with single spaces inside."""
    return F.trim(F.regexp_replace(header, r"\s+", " "))


def resolve_columns(headers: DataFrame, required: DataFrame, renames: DataFrame) -> DataFrame:
    """(file, name, header, how, suggestion): the header of each file that stands for each required name.

    ``headers`` has file and header, ``required`` name, ``renames`` name and header. A name is met by the header that is
    equal (``exact``), else by the first that is equal but for case (``case``), else by the renamed header in the same two
    ways (``rename``), else it is ``missing``. The suggestion for a missing name is the most similar header of the file
    that no name has taken, if it is similar enough; ties go to the first in order.

    Only names and headers that share two letters in a row are compared. That loses none: an edit spoils two of the
    n + 1 pairs of a name of n letters and its ends, and at most 0.4 n edits are allowed.
    """
    named = _named(headers)
    met = met_columns(headers, required, renames)
    return met.join(suggestions(met.where("how = 'missing'").select("file", "name"), unused(named, met)), ["file", "name"], "left")


def _named(headers: DataFrame) -> DataFrame:
    return headers.select("file", trimmed(F.col("header")).alias("header")).where("header <> ''").distinct()


def met_columns(headers: DataFrame, required: DataFrame, renames: DataFrame) -> DataFrame:
    """(file, name, header, how) as ``resolve_columns`` gives them, without looking for suggestions."""
    named = _named(headers)
    files = named.select("file").distinct()
    first = named.groupBy("file", F.lower("header").alias("low")).agg(F.min("header").alias("cased"))
    wanted = required.select("name").distinct().join(renames.groupBy("name").agg(F.min(trimmed(F.col("header"))).alias("renamed")), "name", "left")
    # Files and names are both read from small metadata; each file asks for each name.
    names = wanted.agg(F.collect_list(F.struct("name", "renamed")).alias("names"))
    asked = files.join(F.broadcast(names), how="cross").select("file", F.explode("names").alias("x")).select("file", "x.*")
    for column, key in (("own", "name"), ("other", "renamed")):
        exact = named.select("file", F.col("header").alias(key), F.col("header").alias(f"{column}_exact"))
        case = first.select("file", F.col("low").alias(f"{key}_low"), F.col("cased").alias(f"{column}_case"))
        asked = asked.join(exact, ["file", key], "left").withColumn(f"{key}_low", F.lower(key)).join(case, ["file", f"{key}_low"], "left")
    found = F.coalesce("own_exact", "own_case", "other_exact", "other_case")
    how = F.when(F.col("own_exact").isNotNull(), "exact").when(F.col("own_case").isNotNull(), "case").when(found.isNotNull(), "rename").otherwise("missing")
    return asked.select("file", "name", found.alias("header"), how.alias("how"))


def unused(named: DataFrame, met: DataFrame) -> DataFrame:
    """(file, header) of headers that no name has taken."""
    return named.join(met.where("header is not null").select("file", "header"), ["file", "header"], "left_anti")


def _pairs(text):
    padded = F.concat(F.lit("\x02"), F.lower(text), F.lit("\x03"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 1), lambda i: padded.substr(i, F.lit(2))))


def suggestions(missing: DataFrame, headers: DataFrame) -> DataFrame:
    """(file, name, suggestion): for missing names the most similar header of the same file."""
    left = missing.select("file", "name", F.explode(_pairs(F.col("name"))).alias("pair"))
    right = headers.select("file", "header", F.explode(_pairs(F.col("header"))).alias("pair"))
    shared = left.join(right, ["file", "pair"]).select("file", "name", "header").distinct()
    distance = F.levenshtein(F.lower("name"), F.lower("header"))
    longer = F.greatest(F.length("name"), F.length("header"))
    close = shared.withColumn("distance", distance / longer).where((F.lit(1) - F.col("distance")) >= SIMILAR)
    return close.groupBy("file", "name").agg(F.min(F.struct("distance", "header")).alias("b")).select("file", "name", F.col("b.header").alias("suggestion"))


def coding_tables(headers: DataFrame, attributes: DataFrame, section: str = "section") -> DataFrame:
    """(file, is_table): whether a file has the section column and one attribute's at least, whatever the case."""
    low = headers.select("file", F.lower(trimmed(F.col("header"))).alias("low"))
    wanted = attributes.select(F.lower("name").alias("low"), F.lit(True).alias("attribute")).distinct()
    sides = low.join(wanted, "low", "left").groupBy("file").agg(F.max(F.col("low") == section).alias("s"), F.max(F.coalesce("attribute", F.lit(False))).alias("a"))
    return sides.select("file", (F.col("s") & F.col("a")).alias("is_table"))


def table_digests(build: DataFrame, values: Sequence[str]) -> DataFrame:
    """(file, rows, digest): sums of hashes of a file's rows, so order and partitions don't count but repeats do.

    Two hashes of 64 bits are summed in full; rows are added up before they are shuffled.
    """
    hashes = [F.xxhash64(F.lit(seed), *[F.struct(F.col(v).isNull(), F.col(v)) for v in values]).cast("decimal(20,0)") for seed in (1, 2)]
    return build.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), F.struct(*[F.sum(h) for h in hashes]).alias("digest"))


def compare_builds(old: DataFrame, new: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """(file, state, only_old, only_new, changed): a row for each file of two builds, whose rows are (file, key, value).

    ``identical`` files, told by their digests, are not compared further. A ``different`` one counts keys of one build
    only and keys whose values differ; a key with several values differs if its lists of values, in order, do. Files of
    one build are ``old only`` or ``new only`` and count their keys. Null keys and values are values like others.
    """
    digests = [table_digests(b, [key, value]).withColumnsRenamed({"rows": f"rows{i}", "digest": f"digest{i}"}) for i, b in enumerate((old, new))]
    both = digests[0].join(digests[1], "file", "full")
    same = F.col("rows0").eqNullSafe(F.col("rows1")) & F.col("digest0").eqNullSafe(F.col("digest1"))
    states = both.select("file", F.when(F.col("rows0").isNull(), "new only").when(F.col("rows1").isNull(), "old only").when(same, "identical").otherwise("different").alias("state"))
    open_ = states.where("state <> 'identical'").select("file")
    sides = [b.join(open_, "file", "left_semi").select("file", F.col(key).alias("key"), F.struct(F.col(value).alias("v")).alias("v"), F.lit(i).alias("side")) for i, b in enumerate((old, new))]
    lists = [F.array_sort(F.collect_list(F.when(F.col("side") == i, F.col("v")))) for i in (0, 1)]
    keys = sides[0].unionByName(sides[1]).groupBy("file", "key").agg(lists[0].alias("a"), lists[1].alias("b"))
    counts = keys.groupBy("file").agg(F.count_if(F.size("b") == 0).alias("only_old"), F.count_if(F.size("a") == 0).alias("only_new"), F.count_if((F.size("a") > 0) & (F.size("b") > 0) & (F.col("a") != F.col("b"))).alias("changed"))
    return states.join(counts, "file", "left").fillna(0, ["only_old", "only_new", "changed"])
