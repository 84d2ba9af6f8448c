"""N-gram Jaccard join: sets that share a PartEnum signature are compared, which finds all with a similarity of 0.75 or more."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.llm.common import add_columns, add_rows, discard, mix, run_hashes, utf8_of, words_of, written
from tarmac.llm.components import connect

#: Words of a shingle.
SHINGLE = 5
#: Two sets link when 100 x intersection >= PERCENT x union; the bounds below are derived for 75.
PERCENT = 75
#: Lower limits of the size bands: sets of one band are partitioned alike.
BANDS = np.array([1, 2, 4, 8, 16, 32, *[64 * 8**i for i in range(8)]])
#: Bands below this size enumerate subsets of second-level parts; larger sets have parts enough for subsets of one.
ENUMERATED = 64
#: Parts of a large band, by its upper size limit.
PARTS = 0.6

#: Bits of a signature: two that are equal by chance put sets together that the comparison parts again.
SIG_BITS = 48
#: Turns that merge groups of copies before all open pairs are compared, one signature in how many a turn looks at, and
#: sets of a signature that one block of the comparison has.
MERGES, LOOKED_AT, BLOCK = 3, 4, 1000
#: 64-bit words of the parities by which pairs are ruled out before their sets are compared.
WORDS = 8


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every row; with fewer words, the whole sequence as one; empty without words."""
    _, _, hashes, rows = words_of(data, offsets)
    runs = run_hashes(hashes, size)
    out = []
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        out.append(np.unique(runs[a : b - size + 1]) if b - a >= size else run_hashes(hashes[a:b], b - a) if b > a else runs[:0])
    return out


def parities(x: np.ndarray) -> np.ndarray:
    """Parities of a set's features in ``64 * WORDS`` cells, as integers: two sets differ in at least as many features as in parities."""
    cells = np.bincount((mix(x ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(64 * WORDS)).astype(np.int64), minlength=64 * WORDS)
    return np.packbits((cells & 1).astype(np.uint8)).view(np.int64)


def set_id(x: np.ndarray) -> int:
    """A 64-bit name of a set: equal sets have equal names."""
    total = int(mix(x ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
    h = int(mix(np.array([(total + len(x) * 0x14057B7EF767814F) % (1 << 64)], np.uint64))[0])
    return h - (1 << 64) if h >= 1 << 63 else h


def _projections(h: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Part numbers that hold features, ascending, and a hash of the features of each."""
    part = (h >> np.uint64(16)) % np.uint64(parts)
    order = np.argsort(part)
    part = part[order]
    starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    return part[starts].astype(np.int64), np.add.reduceat(h[order], starts)


def signatures(x: np.ndarray) -> tuple[np.ndarray, int]:
    """Signatures of a set, and how many of them it shares with any set of Jaccard similarity 0.75 or more at least.

    Sets of sizes r <= s link only if s <= 4r/3 and their symmetric difference is at most (r + s) / 7, hence at most
    r / 3 and 2s / 7. A set is partitioned for its own size band and, if smaller partners may stand in the band below,
    for that one too, so linked sets meet in a band.

    Large bands: the domain is cut into parts; as every difference spoils one part, of any k + 1 non-empty parts of a
    set at most k differ. A set gives the projections on its first k + 1 + n/10 non-empty parts: of the set whose
    parts end first, at least n/10 + 1 agree and are given by both. Small bands: the parts come in groups of three and
    every subset of two is a signature; a group is spoilt by two differences only, so with more than k / 2 groups that
    hold features in two parts, one subset agrees. Sets too sparse for these counts also give single features, the
    prefix n - ceil(0.75 n) + 1 in hash order, which settles pairs in which both are sparse; those, and sets that may
    have partners in small bands, are sure to share one. Others share the count of their smallest possible partner.
    """
    n = len(x)
    if n == 0:
        return x.view(np.int64), 1
    band = int(np.searchsorted(BANDS, n, side="right")) - 1
    out, sparse = [], False
    for b in (band, band - 1) if band and -(-3 * n // 4) < BANDS[band] else (band,):
        k = n // 3 if b == band else 2 * n // 7
        h = mix(x ^ np.uint64(b * 7919 + 1))
        high = int(BANDS[b + 1])
        if high <= ENUMERATED:
            groups = (high // 3 // 2 + 1) * 4 // 3 + 1
            part, proj = _projections(h, 3 * groups)
            table = np.zeros((groups, 3), np.uint64)
            table[part // 3, part % 3] = proj
            full = table != 0
            sparse |= int((full.sum(axis=1) >= 2).sum()) < k // 2 + 1
            for i, j in ((0, 1), (0, 2), (1, 2)):
                some = np.flatnonzero(full[:, i] | full[:, j])
                out.append(mix(table[some, i] * np.uint64(3) + table[some, j] * np.uint64(5) + (some * 9 + i * 3 + j).astype(np.uint64)))
        else:
            part, proj = _projections(h, int(PARTS * high))
            first = k + 1 + n // 10
            sparse |= len(part) < first
            out.append(mix(proj[:first] + part[:first].astype(np.uint64)))
    if sparse:
        out.append(mix(np.sort(mix(x))[: n - -(-3 * n // 4) + 1] + np.uint64(0xABCD)))
    least = 1 if sparse or n < 2 * ENUMERATED else -(-3 * n // 4) // 10 + 1
    return np.unique(np.concatenate(out) >> np.uint64(64 - SIG_BITS)).view(np.int64), least


def _sets_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, tk, n, node) of all rows: text key, set size and set name."""

    def compute(texts):
        sets = shingle_sets(*utf8_of(texts))
        return [[len(x) for x in sets], [set_id(x) if len(x) else None for x in sets]]

    keyed = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).withColumn("tk", F.xxhash64("text"))
    made = add_columns(keyed, ["text"], compute, [T.StructField("n", T.LongType()), T.StructField("node", T.LongType())], ["id", "tk"])
    return written(made.select("row.id", "row.tk", "n", "node"))


def _shared_signatures(docs: DataFrame, text_col: str) -> DataFrame:
    """(sig, node, n): of every set that may link at all, the rarest signatures that it shares with other sets.

    A set shares with any partner at least ``least`` of its signatures, so it needs that many shared ones to take part,
    and the ``least - 1`` most frequent of them can be left out: of what two partners share, the rarest stays with both.
    """

    def compute(texts):
        nodes, sigs, sizes, least, seen = [], [], [], [], set()
        for x in shingle_sets(*utf8_of(texts)):
            node = set_id(x) if len(x) else None
            if node is None or node in seen:  # copies within the batch give none
                continue
            seen.add(node)
            own, needed = signatures(x)
            sigs.append(own)
            for values, v, kind in ((nodes, node, np.int64), (sizes, len(x), np.int64), (least, needed, np.int32)):
                values.append(np.full(len(own), v, kind))
        if not nodes:
            return [], [], [], [], []
        made = np.concatenate(nodes)
        return np.zeros(len(made), np.int64), np.concatenate(sigs), made, np.concatenate(sizes), np.concatenate(least)

    fields = [T.StructField("sig", T.LongType()), T.StructField("node", T.LongType()), T.StructField("n", T.LongType()), T.StructField("least", T.IntegerType())]
    rows = add_rows(docs.select(F.col(f"`{text_col}`").alias("text")), "text", compute, fields, [])
    same, own = Window.partitionBy("sig"), Window.partitionBy("node")
    met = rows.withColumn("lo", F.min("node").over(same)).withColumn("hi", F.max("node").over(same)).withColumn("df", F.count(F.lit(1)).over(same))
    live = met.where("lo < hi").select("sig", "node", "n", "least", "df").distinct()
    ranked = live.withColumn("shared", F.count(F.lit(1)).over(own)).where("shared >= least")
    return ranked.withColumn("r", F.row_number().over(own.orderBy("df", "sig"))).where("r <= shared - least + 1").select("sig", "node", "n")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_shingles and component_id, the smallest id reachable by links.

    Words are runs of other bytes than space and 0x09-0x0D, with A-Z in lower case. Rows with equal sets link; null texts
    and texts without words have no shingles and stand alone (their component is their own id, null for a null id).
    Sets and shingles are named by 64-bit hashes. Steps, each distributed: sets and their names; PartEnum signatures,
    of which those that no other set has are dropped, and with them sets that share too few; a few turns that compare
    each set with one other of its signatures' groups, which merge groups of copies at one comparison for each; and the
    comparison of all pairs of sets that share a signature and are not yet in one component, so that no pair that may
    link goes unseen.
    """
    whole = labelled_rows(docs, id_col, text_col)
    least = whole.where("label is not null").groupBy("label").agg(F.min("id").alias("least"))
    out = whole.join(least.withColumnRenamed("label", "l2"), F.col("label") == F.col("l2"), "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("label").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id"))


def labelled_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tk, n, label) of every row of ``docs``: text key, set size and the name of its component, null without shingles."""
    table = _sets_table(docs, id_col, text_col)
    shared = written(_shared_signatures(docs, text_col))
    reps = table.where("node is not null").groupBy("node").agg(F.min(F.struct("id", "tk")).alias("at"), F.first("n").alias("n"))
    reps = written(reps.join(shared.select("node").distinct(), "node").select("node", "n", F.col("at.id").alias("rid"), F.col("at.tk").alias("rtk")))
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).withColumn("tk", F.xxhash64("text"))
    texts = texts.join(reps, (F.col("tk") == F.col("rtk")) & F.col("id").eqNullSafe(F.col("rid"))).select("node", "n", "text")

    def compute(column):
        sets = shingle_sets(*utf8_of(column))
        return [[x.view(np.int64) for x in sets], [parities(x) for x in sets]]

    longs = T.ArrayType(T.LongType(), False)
    sets = add_columns(texts, ["text"], compute, [T.StructField("fs", longs), T.StructField("bits", longs)], ["node", "n"])
    sets = written(sets.select("row.node", "row.n", "fs", "bits").dropDuplicates(["node"]))
    labels = written(reps.select("node", F.col("node").alias("label")))
    for turn in range(MERGES):
        labels = connect(labels, _linked(_centre_pairs(shared, labels, sets, turn + 1), sets))
    labels = connect(labels, _linked(_open_pairs(shared, labels, sets), sets))
    discard(shared, reps, sets)
    named = table.join(labels.select(F.col("node").alias("lnode"), "label"), F.col("node") == F.col("lnode"), "left")
    return named.select("id", "tk", "n", F.coalesce("label", "node").alias("label"))


def _unequal() -> Column:
    """In how many parities sets a and b differ."""
    return sum((F.bit_count(F.get("bits_a", F.lit(i)).bitwiseXOR(F.get("bits_b", F.lit(i)))) for i in range(WORDS)), F.lit(0))


def _may_link() -> Column:
    """Whether sets a and b of different components may link, by their sizes and parities."""
    n = F.col("n_a") + F.col("n_b")
    return (F.col("label_a") != F.col("label_b")) & (100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b")) & (7 * _unequal() <= n)


def _side(df: DataFrame, name: str, *more: str) -> DataFrame:
    return df.select(*more, *[F.col(c).alias(f"{c}_{name}") for c in ("node", "n", "label", "bits")])


def _centre_pairs(shared: DataFrame, labels: DataFrame, sets: DataFrame, turn: int) -> DataFrame:
    """At most one pair (a, b) for each set: it and a centre of one of its signatures, of another component, that may link.

    Of these centres it is the one whose parities differ in the least share of both sizes. A signature's centre is found
    by partial aggregates, and so is a set's choice; the centre hangs on the turn, as does the share of signatures that
    is looked at. A turn only merges what it can, and leaves the rest to ``_open_pairs``.
    """
    rows = shared.where(F.pmod(F.xxhash64("sig", F.lit(turn)), F.lit(LOOKED_AT)) == 0).select("sig", "node").join(labels, "node")
    key = F.xxhash64("sig", F.lit(-turn))  # least of the names after an exclusive or: another set for each signature
    centres = rows.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min(F.col("node").bitwiseXOR(key)).alias("least")).where("lo < hi")
    centres = centres.select("sig", F.col("least").bitwiseXOR(key).alias("centre"))
    met = rows.join(centres, "sig").select("node", "centre").where("node <> centre").distinct()
    known = sets.select("node", "n", "bits").join(labels, "node")
    met = met.join(_side(known, "a"), F.col("node") == F.col("node_a")).select("centre", "node_a", "n_a", "label_a", "bits_a").join(_side(known, "b"), F.col("centre") == F.col("node_b"))
    seed = F.xxhash64(F.lit(turn))
    order = F.struct((_unequal() / (F.col("n_a") + F.col("n_b"))).alias("share"), F.col("node_b").bitwiseXOR(seed).alias("mixed"))
    return met.where(_may_link()).groupBy(F.col("node_a").alias("a")).agg(F.min(order).alias("least")).select("a", F.col("least.mixed").bitwiseXOR(seed).alias("b"))


def _groups(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """(group, size, node, label): groups of sets, so that open pairs that share a signature share a group.

    Near copies share a hundred signatures with nearly the same sets each, and would meet as often. Signatures with
    the same sets are one group. Those of one least set are one group of all their sets, unless that has more pairs
    than they have apart. So no pair is lost, and pairs of a group never outnumber those of its signatures.
    """
    rows = shared.select("sig", "node").join(labels, "node")
    ends = [F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("node").alias("first")]
    mixed = rows.groupBy("sig").agg(*ends, F.count(F.lit(1)).alias("own"), F.bit_xor(F.xxhash64("node")).alias("nodes")).where("lo < hi")
    mixed = written(mixed.select("sig", "first", "own", F.xxhash64("first", "own", "nodes").alias("same")))
    met = written(rows.join(mixed, "sig").select("first", "same", "node", "label").distinct())
    apart = mixed.select("first", "same", "own").distinct()
    pairs = apart.groupBy("first").agg(F.sum(F.col("own") * F.col("own")).alias("pairs"))
    whole = met.select("first", "node").distinct().groupBy("first").agg(F.count(F.lit(1)).alias("all"))
    whole = whole.join(pairs, "first").where(F.col("all") * F.col("all") <= F.col("pairs")).select(F.col("first").alias("group"), "all")
    put = apart.join(whole, F.col("first") == F.col("group"), "left").select("same", F.coalesce("group", "same").alias("group"), F.coalesce("all", "own").alias("size"))
    return written(met.join(put, "same").select("group", "size", "node", "label").distinct())


def _open_pairs(shared: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """All pairs (a, b) that share a signature, are of two components and may link by their sizes and parities.

    Within a group, one side is split into blocks of about ``BLOCK`` sets, each of which meets the whole other side,
    so a large group is many tasks' work. Pairs that can't link are ruled out in the join and never written.
    """
    live = _groups(shared, labels).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    known = live.join(sets.select("node", "n", "bits"), "node")
    mine = _side(known.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "a", "group", "block").alias("m")
    others = _side(known.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))), "b", "group", "block").alias("o")
    met = others.join(mine, (F.col("o.group") == F.col("m.group")) & (F.col("o.block") == F.col("m.block")) & (F.col("node_a") < F.col("node_b")) & _may_link())
    return met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets have the similarity."""
    half = pairs.join(sets.select(F.col("node").alias("b"), F.col("fs").alias("fb")), "b")
    full = half.join(sets.select(F.col("node").alias("a"), F.col("fs").alias("fa")), "a")
    same = full.select("a", "b", F.size(F.array_intersect("fa", "fb")).alias("common"), (F.size("fa") + F.size("fb")).alias("both"))
    return same.where(100 * F.col("common") >= PERCENT * (F.col("both") - F.col("common"))).select("a", "b")
