"""Hard negatives by pruning of coordinates: for anchors and their positives, rows of other labels that score nearly as high.

The table lies in buckets of vectors of similar length. Of a bucket every coordinate has a sorted list; a score of at
least ``t`` confines the coordinate of a partner, so for the few largest coordinates of an anchor the feasible ranges of
the lists are looked up, their rows are intersected, and only these candidates are scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.llm.common import discard, shared_dir, written

#: Vectors of a bucket, anchors that are scored together, and coordinates of an anchor whose ranges are looked up.
BUCKET, GROUP, FOCUS = 4096, 256, 4
#: Bytes of a block of anchors (their components as 64-bit integers), which is broadcast, and of a partition of the table.
BLOCK_BYTES, PART_BYTES = 16 << 20, 128 << 20
#: A row's squared length stays below this, so that every score fits into 64 bits.
MOST_SQUARE = float(1 << 62)
LEAST = np.iinfo(np.int64).min


def prepared(vectors: DataFrame, anchors: Column, id_col: str, label_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, label, x, length, anchor): integer components of all rows that take part, in order of length, longest first."""
    vector = F.col(f"`{vector_col}`")
    inf = float("inf")
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != inf))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(F.col(f"`{label_col}`")).alias("label"), vector.cast("array<double>").alias("v"), anchors.alias("anchor"), (F.col(f"`{label_col}`").isNotNull() & vector.isNotNull() & finite).alias("whole"))
    scaled = F.transform("v", lambda v: F.floor(v * F.lit(float(scale))))
    rows = rows.where("whole and id is not null").withColumn("square", F.aggregate("v", F.lit(0.0), lambda s, v: s + F.pow(F.abs(v) * scale + 1, F.lit(2))))
    rows = rows.where(F.col("square") < MOST_SQUARE).select("id", "label", scaled.alias("x"), F.coalesce("anchor", F.lit(False)).alias("anchor"))
    # Rows that share an id count as one, the least of them.
    rows = rows.groupBy("id").agg(F.min(F.struct("label", "x", "anchor")).alias("r")).select("id", "r.*")
    rows = written(rows.withColumn("length", F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))))
    size = rows.agg(F.sum(F.size("x") * 8 + 32)).first()[0] or 0
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-size // PART_BYTES))
    keys = [F.desc("length"), F.col("id")]
    ordered = written(rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys))
    discard(rows)
    return ordered


class Vectors:
    """Rows of the prepared table as arrays; shorter vectors are filled up with zeros."""

    def __init__(self, table: pa.Table, width: int = 0):
        lists = table.column("x").combine_chunks()
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        sizes = np.diff(lists.offsets.to_numpy())
        self.width = max(int(sizes.max()) if len(sizes) else 0, width)
        self.x = np.zeros((len(sizes), self.width), np.int64)
        self.x[np.arange(self.width) < sizes[:, None]] = lists.flatten().to_numpy()
        self.id = table.column("id").to_numpy()
        self.label = table.column("label").to_numpy()
        self.length = table.column("length").to_numpy()

    def __len__(self) -> int:
        return len(self.id)

    def widened(self, width: int) -> np.ndarray:
        return np.pad(self.x, ((0, 0), (0, width - self.width))) if width > self.width else self.x

    def unit(self, width: int) -> np.ndarray:
        return self.widened(width) / np.maximum(self.length, 1e-300)[:, None]


def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[Vectors]:
    """Runs of ``BUCKET`` rows, in the order in which they come, hence of similar lengths."""
    kept, n = [], 0
    for batch in batches:
        while batch.num_rows:
            piece = batch.slice(0, BUCKET - n)
            kept.append(piece)
            n += piece.num_rows
            batch = batch.slice(piece.num_rows)
            if n == BUCKET:
                yield Vectors(pa.Table.from_batches(kept))
                kept, n = [], 0
    if kept:
        yield Vectors(pa.Table.from_batches(kept))


def feasible(q: np.ndarray, cosine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Range of a coordinate of unit vectors whose cosine with a unit vector of coordinate ``q`` is ``cosine`` or more.

    The angle between partner and axis differs from that between vector and axis by the angle of the cosine at most.
    """
    turn, own = np.arccos(np.clip(cosine, -1, 1)), np.arccos(np.clip(q, -1, 1))
    return np.cos(np.minimum(np.pi, own + turn)) - 1e-9, np.cos(np.maximum(0, own - turn)) + 1e-9


def candidates(bucket_unit: np.ndarray, longest: float, unit: np.ndarray, length: np.ndarray, floor: np.ndarray) -> np.ndarray:
    """For each anchor (unit vector and length) the bucket's rows whose score may reach its floor, as a table of booleans.

    A floor of zero or less confines nothing; one above the product of the lengths leaves no row.
    """
    n, found = len(bucket_unit), np.zeros((len(unit), len(bucket_unit)), bool)
    bound = floor > 0
    cosine = np.where(bound, floor / np.maximum(length * longest, 1e-300), -1.0)
    open_ = cosine <= 1 + 1e-9
    found[open_] = True
    confined = np.flatnonzero(bound & open_)
    focus = np.argsort(-np.abs(unit[confined]), axis=1, kind="stable")[:, :FOCUS]
    seen = np.zeros((len(unit), n), np.uint8)
    needed = np.zeros(len(unit), np.uint8)
    for f in np.unique(focus):
        order = np.argsort(bucket_unit[:, f], kind="stable")
        values = bucket_unit[order, f]
        own = confined[(focus == f).any(axis=1)]
        low, high = feasible(unit[own, f], cosine[own])
        starts, ends = np.searchsorted(values, low, "left"), np.searchsorted(values, high, "right")
        for a, s, e in zip(own.tolist(), starts.tolist(), ends.tolist(), strict=True):
            if e - s < n:  # a range of all rows excludes none
                needed[a] += 1
                seen[a, order[s:e]] += 1
    found[confined] &= seen[confined] == needed[confined, None]
    return found


class Best:
    """The first ``k`` rows of each slot by score, then id, kept while buckets pass."""

    def __init__(self, slots: int, k: int):
        self.k, self.slot, self.id, self.score = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.least = np.full(slots, LEAST)

    def add(self, slot: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        if not len(slot):
            return
        slot, ids, scores = (np.concatenate(x) for x in ((self.slot, slot), (self.id, ids), (self.score, scores)))
        order = np.lexsort((ids, -scores, slot))
        slot = slot[order]
        starts = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
        place = np.arange(len(slot)) - np.repeat(starts, np.diff(np.append(starts, len(slot))))
        kept = order[place < self.k]
        full = place == self.k - 1
        self.least[slot[full]] = scores[order[full]]
        self.slot, self.id, self.score = slot[place < self.k], ids[kept], scores[kept]


def _scores(anchors: np.ndarray, rows: np.ndarray, most: float) -> np.ndarray:
    """Integer inner products; in floating point, which is faster, only where every sum is exact."""
    return (anchors.astype(float) @ rows.astype(float).T).astype(np.int64) if most < 2**53 else anchors @ rows.T


def searched(rows: DataFrame, shared, k: int, negatives: bool) -> DataFrame:
    """(anchor, slot, id, score): the first ``k`` rows of each slot of the broadcast anchors in each partition of the table.

    A slot takes rows of the anchor's label, but not itself, or for negatives rows of other labels, with scores from
    ``low`` to ``high``.
    """

    def run(batches):
        block = shared.value
        anchors, low, high = block["anchors"], block["low"], block["high"]
        slots = low.shape[1]
        units = anchors.unit(anchors.width)
        parts = [np.arange(i, min(i + GROUP, len(anchors))) for i in range(0, len(anchors), GROUP)]
        best = [Best(len(p) * slots, k) for p in parts]
        for bucket in buckets(batches):
            width = max(bucket.width, anchors.width)
            x, unit, longest = bucket.widened(width), bucket.unit(width), float(bucket.length.max())
            for part, kept in zip(parts, best, strict=True):
                floors = np.maximum(low[part], kept.least.reshape(len(part), slots))
                used = floors <= high[part]
                floor = np.where(used, floors, np.iinfo(np.int64).max).min(axis=1)
                alive = used.any(axis=1)
                own = np.pad(units[part], ((0, 0), (0, width - anchors.width)))
                found = candidates(unit, longest, own, anchors.length[part], floor.astype(float)) & alive[:, None]
                same = anchors.label[part][:, None] == bucket.label
                found &= ~same if negatives else same & (anchors.id[part][:, None] != bucket.id)
                mine, theirs = np.flatnonzero(found.any(axis=1)), np.flatnonzero(found.any(axis=0))
                if not len(mine):
                    continue
                found = found[np.ix_(mine, theirs)]
                q = np.pad(anchors.x[part[mine]], ((0, 0), (0, width - anchors.width)))
                scores = _scores(q, x[theirs], longest * float(anchors.length.max()))
                for s in range(slots):
                    least = floors[mine, s]
                    if negatives is False and (least == LEAST).any() and len(theirs) > k:
                        # Without a floor yet, that of the bucket's own k-th score serves.
                        open_ = np.where(found, scores, LEAST)
                        least = np.maximum(least, np.partition(open_, len(theirs) - k, axis=1)[:, len(theirs) - k])
                    hit = found & (scores >= least[:, None]) & (scores <= high[part[mine], s][:, None])
                    a, r = np.nonzero(hit)
                    kept.add(mine[a] * slots + s, bucket.id[theirs[r]], scores[a, r])
        for part, kept in zip(parts, best, strict=True):
            if len(kept.slot):
                yield pa.RecordBatch.from_arrays([pa.array(anchors.id[part[kept.slot // slots]]), pa.array((kept.slot % slots).astype(np.int32)), pa.array(kept.id), pa.array(kept.score)], names=["anchor", "slot", "id", "score"])

    return rows.select("id", "label", "x", "length").mapInArrow(run, "anchor long, slot int, id long, score long")


def _first(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def _share(score: int, percent: int, up: bool) -> int:
    """``percent`` hundredths of a score, rounded up or down."""
    return -(-score * percent // 100) if up else score * percent // 100


def hard_negatives(
    vectors: DataFrame,
    anchors: Column,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    scale: int = 256,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows chosen by ``anchors``.

    A component x becomes floor(scale * x); a score is the integer inner product with the anchor, higher scores come
    first, then smaller ids. An anchor's positives are its first ``positives`` other rows of its label; for each, the
    first ``negatives`` rows of other labels whose score lies between ``low`` and ``high`` percent of the positive's are
    returned, all if there are fewer; a positive without any gives no row, as does one with a negative score.

    Rows with a null id, label or vector, or a null or infinite component or NaN take no part, nor do those whose
    squared length reaches 2**62, whose scores leave 64 bits. Rows that share an id count as one, the least by the
    hash of the label, then vector. Vectors of different lengths are compared as if zeros followed the shorter one. Other
    columns are ignored, whatever their names. An empty table gives no rows.

    The anchors are broadcast in blocks of ``BLOCK_BYTES``, chosen by a hash of the id; the table is read twice for each
    block, first for the positives, which give the windows of scores, then for the negatives.
    """
    rows = prepared(vectors, anchors, id_col, label_col, vector_col, scale)
    spark = rows.sparkSession
    chosen = rows.where("anchor").drop("anchor")
    size = chosen.agg(F.sum(F.size("x") * 8 + 64)).first()[0] or 0
    # Half of the bytes as a mean leaves room for uneven hashes.
    blocks = max(1, -(-2 * size // BLOCK_BYTES))
    target = shared_dir(spark)
    none = None
    for i in range(blocks):
        # At most one block's bytes come to the driver.
        block = Vectors(chosen.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i).toArrow())
        n = len(block)
        free = {"anchors": block, "low": np.full((n, 1), LEAST), "high": np.full((n, 1), np.iinfo(np.int64).max)}
        shared = spark.sparkContext.broadcast(free)
        met = _first(searched(rows, shared, positives, False), positives).select("anchor", "place", "id", "score")
        at = {a: k for k, a in enumerate(block.id.tolist())}
        score = np.zeros((n, positives), np.int64)
        bounds = {"anchors": block, "low": np.ones((n, positives), np.int64), "high": np.zeros((n, positives), np.int64)}
        ids = np.zeros((n, positives), np.int64)
        for r in met.collect() if n else []:  # a few rows for each anchor of the block
            k, s = at[r["anchor"]], r["place"] - 1
            ids[k, s], score[k, s] = r["id"], r["score"]
            if r["score"] >= 0:
                bounds["low"][k, s], bounds["high"][k, s] = _share(r["score"], low, True), _share(r["score"], high, False)
        shared.destroy()
        second = spark.sparkContext.broadcast(bounds)
        found = _first(searched(rows, second, negatives, True), negatives)
        k, s = np.nonzero(bounds["low"] <= bounds["high"])
        known = spark.createDataFrame(pa.table({"anchor": block.id[k], "slot": s.astype(np.int32), "positive": ids[k, s], "of": score[k, s]}))
        done = found.join(known, ["anchor", "slot"]).select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), F.col("place").alias("rank"), F.col("id").alias("negative_id"), F.col("of").alias("positive_score"), F.col("score").alias("negative_score"))
        done.write.mode("append").parquet(target)
        none = done.schema
        second.destroy()
    return spark.read.schema(none).parquet(target)
