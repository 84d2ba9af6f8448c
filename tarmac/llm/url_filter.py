"""URL filters: a blocked Bloom filter of the listed keys passes possible hits to an exact hash join."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.llm.common import add_columns, add_rows

#: 64-byte blocks of the filter at most: 16 MB, whatever the length of the list (more entries only pass more false hits on).
MAX_BLOCKS = 1 << 18
#: Entries a block is made for, and bits set for each entry.
PER_BLOCK, BITS = 32, 8
#: Rules up to this number are broadcast to the exact join; more are joined by a shuffle.
BROADCAST_RULES = 50_000
#: Labels of a rule's host and characters of its path that a key holds at most; the exact join compares the rest.
KEY_LABELS, KEY_CHARS = 32, 2048


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://`` or for null."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _positions(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each hash, and the bit numbers (0 to 511) that it sets there."""
    h = hashes.astype(np.uint64)
    bits = np.empty((len(h), BITS), np.int64)
    x = h
    for i in range(BITS):
        x = x * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
        bits[:, i] = (x >> np.uint64(55)).astype(np.int64)
    return ((h >> np.uint64(20)) % np.uint64(blocks)).astype(np.int64), bits


def build_filter(keys: DataFrame, key_col: str = "key") -> np.ndarray:
    """The filter over all distinct keys, as rows of 64 bytes. Tasks set the bits of their keys and merge them block by
    block; the driver gets the blocks alone, at most ``MAX_BLOCKS``."""
    hashed = keys.select(F.xxhash64(key_col).alias("h")).distinct()
    blocks = int(min(MAX_BLOCKS, max(1, -(-hashed.count() // PER_BLOCK))))

    def compute(column):
        at, bits = _positions(column.to_numpy(zero_copy_only=False), blocks)
        own, place = np.unique(at, return_inverse=True)
        words = np.zeros((len(own), 8), np.uint64)
        for i in range(BITS):
            np.bitwise_or.at(words, (place, bits[:, i] >> 6), np.uint64(1) << (bits[:, i] & 63).astype(np.uint64))
        return np.zeros(len(own), np.int64), own, *words.view(np.int64).T

    words = [f"w{i}" for i in range(8)]
    made = add_rows(hashed, "h", compute, [T.StructField(c, T.LongType()) for c in ("block", *words)], [], batch_rows=10_000)
    rows = made.groupBy("block").agg(*[F.bit_or(w).alias(w) for w in words]).toPandas()
    out = np.zeros((blocks, 8), np.int64)
    out[rows["block"].to_numpy(np.int64)] = rows[words].to_numpy(np.int64)
    return out.view(np.uint8).reshape(blocks, 64)


def probe(filter_: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the filter may hold each hash; never false for one it holds."""
    at, bits = _positions(hashes, len(filter_))
    return ((filter_[at[:, None], bits >> 3] >> (bits & 7)) & 1).all(axis=1)


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", keep: tuple[str, ...] = ("page_id",), otherwise: str = "allow") -> DataFrame:
    """Per row of ``pages``: ``row`` (its ``keep`` columns), host, path, rule and verdict.

    ``rules`` has host, path and verdict, one row for each (host, path). A rule fits its host and all subdomains if the
    page's path starts with the rule's path; the rule with the most characters (host and path) wins, the first in order
    among equals. Pages without a rule get ``otherwise``. A rule with a null host or path fits nothing. A null url, or one without ``://``, has an empty host and path.
    A page's keys are its host's last labels with its path's first characters, for the numbers of labels and characters
    that occur in the list; rules of more than ``KEY_LABELS`` labels or ``KEY_CHARS`` characters have the key of their last
    labels and first characters, and the exact join compares the whole host and path. Distinct (host, path) pairs are judged
    once, so a hot host or repeated page costs one probe, and those that pass the filter go to the exact join. Without
    rules all pages get ``otherwise``.
    """
    spark = pages.sparkSession
    labels, chars = F.least(F.size(F.split("host", r"\.")), F.lit(KEY_LABELS)), F.least(F.char_length("path"), F.lit(KEY_CHARS))
    rules = rules.select("host", "path", "verdict", labels.alias("labels"), chars.alias("chars"))
    rules = rules.withColumn("key", F.concat(F.expr("substring_index(host, '.', -labels)"), F.lit(" "), F.expr("substring(path, 1, chars)")))
    bloom = build_filter(rules)
    # The kinds of keys come to the driver: at most KEY_LABELS numbers of labels with at most KEY_CHARS + 1 lengths each.
    kinds = [(r["labels"], sorted(r["chars"])) for r in rules.groupBy("labels").agg(F.collect_set("chars").alias("chars")).collect()]
    shared = spark.sparkContext.broadcast(bloom)
    judged = pages.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), host_of(F.col(f"`{url_col}`")).alias("host"), path_of(F.col(f"`{url_col}`")).alias("path"))
    urls = judged.where(F.col("host") != "").select("host", "path").distinct()
    known = F.from_json(F.lit(json.dumps([{"labels": n, "chars": c} for n, c in kinds])), "array<struct<labels:int,chars:array<int>>>")
    asked = urls.withColumn("dots", F.char_length("host") - F.char_length(F.replace("host", F.lit("."), F.lit("")))).withColumn("known", known)
    asked = asked.withColumn(
        "keys",
        F.expr(
            "flatten(transform(filter(known, k -> k.labels <= dots + 1), k -> transform(filter(k.chars, n -> n <= char_length(path)), "
            "n -> concat(substring_index(host, '.', -k.labels), ' ', substring(path, 1, n)))))"
        ),
    )
    asked = asked.select("host", "path", "keys", F.transform("keys", lambda k: F.xxhash64(k)).alias("hashes"))

    def compute(keys, hashes):
        flat = hashes.flatten().to_numpy(zero_copy_only=False)
        sizes = [0 if k is None else k for k in hashes.value_lengths().to_pylist()]
        hit = probe(shared.value, flat) if len(flat) else np.zeros(0, bool)
        out, at = [], 0
        for own, n in zip(keys.to_pylist(), sizes, strict=True):
            out.append([k for k, h in zip(own or (), hit[at : at + n], strict=True) if h])
            at += n
        return [out]

    possible = add_columns(asked, ["keys", "hashes"], compute, [T.StructField("possible", T.ArrayType(T.StringType()))], ["host", "path"], batch_rows=5000)
    possible = possible.select("row.host", "row.path", F.explode("possible").alias("key"))
    listed = rules.select("key", F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict"))
    few = rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    within = (F.col("host") == F.col("rule_host")) | F.endswith(F.col("host"), F.concat(F.lit("."), F.col("rule_host")))
    exact = possible.join(F.broadcast(listed) if few else listed.hint("shuffle_hash"), "key").where(within & F.startswith(F.col("path"), F.col("rule_path")))
    rank = F.struct(F.char_length(F.concat("rule_host", "rule_path")).alias("n"), F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_verdict").alias("verdict"))
    best = exact.groupBy("host", "path").agg(F.max(rank).alias("best"))
    return judged.join(best, ["host", "path"], "left").select("row", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"))
