"""Merkle manifest of a table: every row gets its digest, the roots above it and the siblings that prove it.

Rows are leaves; each group's leaves, in order of a key, are the lowest level of its tree, and every ``ARITY`` nodes in a
row have one parent. An aligned block of ``BLOCK`` nodes keeps each of its levels as one string of hex digests, so a
parent is the digest of a fixed-width substring and the siblings of a node are the substrings to its left and right.
Block roots are the leaves of the next round; the roots of the groups are those of one last tree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.llm.common import written

#: Nodes under one parent, levels of a block and hex digits of a digest.
ARITY, LEVELS, HEX = 3, 5, 64
#: Nodes of a block: its lowest level is a string of 15,552 characters.
BLOCK = ARITY**LEVELS
RUN = ARITY * HEX
PATH = "array<struct<left:string,right:string>>"


def digest(values: Sequence[Column]) -> Column:
    """SHA-256 in lowercase hex of all values: ``-`` for a null, else the number of UTF-8 bytes, a colon and the value as text."""
    told = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in told]), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf's digest and the siblings on its path."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def _ceil(n: Column, by: int) -> Column:
    return F.floor((n + (by - 1)) / by) if by > 1 else n


def _numbered(nodes: DataFrame, order: Sequence[str]) -> DataFrame:
    """``nodes`` (with a group ``g``) with ``i``, the place in the group's order from 0, and ``n``, the group's size.

    Rows are dealt out by ranges of group and order and numbered within a range, so no task sees a whole group; places
    follow from the sums over the ranges' counts. Rows equal in all of the order are interchangeable and are told apart
    by a random number, so that many of them spread over ranges.
    """
    spark = nodes.sparkSession
    keys = ["g", *order, "tie"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = nodes.withColumn("tie", F.rand(7)).repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("tie")
    ranged = written(ranged.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    counts = ranged.groupBy("g", "part").agg(F.count(F.lit(1)).alias("rows"), F.min("at").alias("first"))
    group = Window.partitionBy("g")
    before = F.coalesce(F.sum("rows").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("g", "part", (before - F.col("first")).alias("shift"), F.sum("rows").over(group).alias("n"))
    return ranged.join(offsets, ["g", "part"]).withColumn("i", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def _parents(level: Column) -> Column:
    runs = F.sequence(F.lit(0), F.floor((F.length(level) - 1) / RUN).cast("int"))
    return F.array_join(F.transform(runs, lambda r: F.sha2(level.substr(r * RUN + F.lit(1), F.lit(RUN)), 256)), "")


def _blocks(nodes: DataFrame) -> DataFrame:
    """One row for each block of a group: the strings of its levels, its members in order and its root.

    A level has parents only while the whole group has several nodes there, so a lone node is its own root, but a last
    run of one node is hashed.
    """
    members = [c for c in nodes.columns if c not in ("g", "n", "i")]
    grouped = nodes.groupBy("g", F.floor(F.col("i") / BLOCK).alias("block")).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", *members))).alias("members"))
    made = grouped.withColumn("level0", F.array_join("members.node", ""))
    for k in range(LEVELS):
        level = F.col(f"level{k}")
        made = made.withColumn(f"level{k + 1}", F.when(_ceil(F.col("n"), ARITY**k) > 1, _parents(level)).otherwise(level))
    return written(made.withColumnRenamed(f"level{LEVELS}", "root"))


def _climbed(nodes: DataFrame) -> list[DataFrame]:
    """Blocks of every round, until each group is one block; the last round's roots are those of the groups."""
    rounds = [_blocks(nodes)]
    while (rounds[-1].agg(F.max("n")).first()[0] or 0) > BLOCK:
        below = rounds[-1]
        rounds.append(_blocks(below.select("g", F.col("block").alias("i"), _ceil(F.col("n"), BLOCK).alias("n"), F.col("root").alias("node"))))
    return rounds


def _segments(place: Column) -> Column:
    """Siblings of the node at a place of its block, for each level that has parents."""
    made = []
    for k in range(LEVELS):
        node = F.floor(place / ARITY**k).cast("int")
        first, own = F.floor(node / ARITY).cast("int") * RUN, node % ARITY
        level = F.col(f"level{k}")
        left = level.substr(first + F.lit(1), own * HEX)
        right = level.substr(first + (own + 1) * HEX + F.lit(1), (F.lit(ARITY - 1) - own) * HEX)
        made.append(F.when(_ceil(F.col("n"), ARITY**k) > 1, F.struct(left.alias("left"), right.alias("right"))))
    return F.filter(F.array(*made), lambda s: s.isNotNull())


def _descended(rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """All nodes of the first round with their paths to the root; ``tops`` has the groups' own paths and what they carry on."""
    carried = [c for c in tops.columns if c not in ("g", "path")]
    above = tops.withColumn("block", F.lit(0).cast("long"))
    for blocks in reversed(rounds):
        met = blocks.drop("root").join(above, ["g", "block"])
        nodes = F.transform("members", lambda m, k: F.struct(m.alias("member"), F.concat(_segments(k), F.col("path")).alias("path")))
        each = met.select("g", *carried, F.explode(nodes).alias("x")).select("g", *carried, "x.member", "x.path")
        above = each.select("g", F.col("member.i").alias("block"), "path", *carried)
    return each


def manifest(
    docs: DataFrame,
    columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    group_col: str = "source",
    id_col: str = "doc_id",
    altered: dict[str, Column] | None = None,
    keep: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """Per row: ``row`` (its ``keep`` columns), leaf, subroot, root, path and altered_leaf.

    A leaf is the ``digest`` of ``columns``; ``altered_leaf`` that of the row with the columns in ``altered`` replaced, as
    a copy found elsewhere may have them. ``path`` has the siblings, a left and a right string for each level from the
    leaf to the root: ``fold(leaf, path)`` is the root.

    Within a group rows ascend by id (a null first), then by digest. The null group comes first, the others follow in the
    order of their UTF-8 bytes. A group of one row has its leaf as subroot, a table of one group its subroot as root.
    Repeated rows are leaves of their own. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    values = {c: F.col(f"`{c}`") for c in columns}
    changed = values | (altered or {})
    kept = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(1).alias("_"))
    # A null group comes first, as "-" stands before "=".
    group = F.coalesce(F.concat(F.lit("="), F.col(f"`{group_col}`").cast("string")), F.lit("-"))
    leaves = written(docs.select(group.alias("g"), F.col(f"`{id_col}`").alias("id"), digest(list(values.values())).alias("node"), digest(list(changed.values())).alias("altered"), kept.alias("row")))
    low = _climbed(_numbered(leaves, ["id", "node"]).select("g", "i", "n", "node", "altered", "row"))
    subroots = low[-1].select(F.lit("").alias("g"), F.col("g").alias("name"), F.col("root").alias("node"))
    high = _climbed(_numbered(subroots, ["name"]).select("g", "i", "n", "node", "name"))
    top = high[-1].select("g", F.array().cast(PATH).alias("path"), "root")
    groups = _descended(high, top).select(F.col("member.name").alias("g"), "path", F.col("member.node").alias("subroot"), "root")
    done = _descended(low, groups)
    return done.select(F.col("member.row").alias("row"), F.col("member.node").alias("leaf"), "subroot", "root", "path", F.col("member.altered").alias("altered_leaf"))
