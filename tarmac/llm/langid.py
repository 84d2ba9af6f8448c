"""Language identification: multinomial naive Bayes over hashed character n-grams, scored in sparse numpy batches."""

from __future__ import annotations

import math
import sys
import unicodedata

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.llm.common import add_columns, mix, texts_of, written

#: Hash buckets of the n-grams: matrices of (languages x 65,536) 32-bit values are all that is broadcast.
BUCKETS = 1 << 16
#: Lengths of the n-grams.
GRAMS = (1, 2, 3)
#: Expected number of labelled rows of each language that a model is fitted on, at most: the bound of the training sample.
TRAIN_ROWS = 5000
#: Languages of a matrix (64 MB): with more, texts are scored against one matrix after the other.
BLOCK_LANGUAGES = 256
#: Languages whose counts come to the driver at once.
FETCH_LANGUAGES = 16
#: Additive smoothing.
ALPHA = 0.5
#: Characters handled at once.
BLOCK_CHARS = 500_000

_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """For each code point its lower-case form if it is a letter or a mark inside a word, else 32 (a space)."""
    if not _letters:
        table = np.full(sys.maxunicode + 1, 32, np.uint32)
        for c in range(sys.maxunicode + 1):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                table[c] = ord(low) if len(low) == 1 else c
            elif unicodedata.category(s)[0] == "M":
                table[c] = c
        _letters.append(table)
    return _letters[0]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the texts, the number of n-grams of each text, and whether it has a letter.

    Texts are lower-cased letters with single spaces between and around words; n-grams of spaces alone don't count.
    The n-grams of a text stand together, in one order, so that equal texts have equal scores.
    """
    buckets, sizes, lettered = [], np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
    for i, text in enumerate(texts):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        made = []
        for at in range(0, len(points), BLOCK_CHARS):  # a block keeps two characters of the one before
            block = _letter_table()[points[max(0, at - 2) : at + BLOCK_CHARS]]
            made.append((block, min(2, at)))
        for part, (block, old) in enumerate(made):
            row = np.concatenate(([32] if part == 0 else [], block, [32] if part == len(made) - 1 else [])).astype(np.uint64)
            lettered[i] |= bool((block != 32).any())
            spaces = row == 32
            for n in GRAMS:
                if len(row) < n:
                    continue
                h = row[: len(row) - n + 1].copy()
                blank = spaces[: len(row) - n + 1].copy()
                double = np.zeros(len(h), bool)
                for k in range(1, n):
                    h = h * np.uint64(0x100000001B3) + row[k : len(row) - n + 1 + k]
                    blank &= spaces[k : len(row) - n + 1 + k]
                    double |= spaces[k - 1 : len(row) - n + k] & spaces[k : len(row) - n + 1 + k]
                keep = ~(blank | double)
                if part:  # n-grams that end within the characters of the block before are counted there
                    keep[: max(0, old - n + 1)] = False
                got = (mix(h[keep] * np.uint64(8) + np.uint64(n)) >> np.uint64(48)).astype(np.int64)
                buckets.append(got)
                sizes[i] += len(got)
    return (np.concatenate(buckets) if buckets else np.zeros(0, np.int64)), sizes, lettered


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "lang", rows: int = TRAIN_ROWS) -> dict:
    """A model of the labels of ``labelled`` (rows with a null label are left out): labels, log priors and a table of counts.

    All labels are kept; priors count all labelled rows. N-grams are counted over about ``rows`` rows of each label, all
    if it has fewer, drawn by a hash of the text; counting is distributed and pre-aggregated. The driver holds each
    label's name and number of rows, and of the counts a block of labels at a time. Ties of labels go to the first in order.
    """
    label = F.col(f"`{label_col}`").cast("string")
    counts = labelled.where(label.isNotNull()).groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))
    counts = written(counts)
    found = sorted(tuple(r) for r in counts.collect())
    labels = [x for x, _ in found]
    if not labels:
        return {"labels": [], "prior": np.zeros(0), "counts": None}
    shares = counts.select("label", F.least(F.lit(1.0), rows / F.col("n")).alias("share"))
    draw = F.pmod(F.xxhash64(F.col("text"), F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    sample = labelled.select(label.alias("label"), F.col(f"`{text_col}`").alias("text")).where(label.isNotNull() & F.col("text").isNotNull())
    sample = sample.withColumn("draw", draw).join(F.broadcast(shares), "label").where(F.col("draw") < F.col("share")).select("label", "text")

    def count(names, texts):
        names, out = names.to_pylist(), []
        flat, sizes, _ = grams(texts_of(texts))
        ends = np.cumsum(sizes)
        total = {}
        for name, a, b in zip(names, ends - sizes, ends, strict=True):
            total.setdefault(name, np.zeros(BUCKETS, np.int64))
            total[name] += np.bincount(flat[a:b], minlength=BUCKETS)
        for k in range(len(names)):  # a batch's counts stand in the row of a label's first text
            c = total.pop(names[k], None)
            at = np.flatnonzero(c) if c is not None else ()
            out.append([{"bucket": int(i), "n": int(c[i])} for i in at])
        return [out]

    pairs = T.ArrayType(T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("n", T.LongType())]))
    made = add_columns(sample, ["label", "text"], count, [T.StructField("counts", pairs)], ["label"])
    sums = made.select(F.col("row.label").alias("label"), F.explode("counts").alias("c")).groupBy("label", F.col("c.bucket").alias("bucket")).agg(F.sum("c.n").alias("n"))
    by_label = sums.groupBy("label").agg(F.collect_list("bucket").alias("buckets"), F.collect_list("n").alias("ns"))
    n = np.array([n for _, n in found], float)
    return {"labels": labels, "prior": np.log(n / n.sum()), "counts": written(by_label)}


def _weights(model: dict, labels: list[str]) -> np.ndarray:
    """Log probabilities of all buckets for some labels of a model."""
    weights = np.full((BUCKETS, len(labels)), -math.log(BUCKETS), np.float32)
    at = {x: i for i, x in enumerate(labels)}
    for k in range(0, len(labels), FETCH_LANGUAGES):
        for r in model["counts"].where(F.col("label").isin(labels[k : k + FETCH_LANGUAGES])).collect():  # of at most BUCKETS values each
            seen = np.zeros(BUCKETS)
            seen[np.array(r["buckets"], np.int64)] = r["ns"]
            weights[:, at[r["label"]]] = np.log(seen + ALPHA) - np.log(seen.sum() + ALPHA * BUCKETS)
    return weights


def predict(docs: DataFrame, model: dict, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), block: int = BLOCK_LANGUAGES) -> DataFrame:
    """Per row: ``row`` (its ``keep`` columns), lang_pred and score, the posterior probability of the language.

    A text that is null or has no letter is ``und`` with score 0, as is every text if the model has no label. Texts meet
    ``block`` labels at a time; the best label and the log of the sum of all labels' likelihoods are carried on.
    """
    labels = model["labels"]
    blocks = [labels[i : i + block] for i in range(0, len(labels), block)] or [[]]
    carried = [T.StructField("lang_pred", T.StringType()), T.StructField("best", T.DoubleType()), T.StructField("log_sum", T.DoubleType())]
    kept = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(1).alias("_"))
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in carried]
    rows = docs.select(kept.alias("kept"), F.col(f"`{text_col}`").alias("text"), *none)
    for i, names in enumerate(blocks):
        own = {"labels": names, "prior": model["prior"][i * block : (i + 1) * block], "weights": _weights(model, names) if names else None}
        shared = docs.sparkSession.sparkContext.broadcast(own)
        last = i == len(blocks) - 1
        made = add_columns(rows, ["text", *[f.name for f in carried]], _scorer(shared), carried, ["kept"] if last else ["kept", "text"])
        if not last:  # written, so that no worker holds two blocks
            rows = written(made.select("row.kept", "row.text", *[f.name for f in carried]))
            shared.destroy()
    score = F.when(F.col("best").isNull(), 0.0).otherwise(F.round(F.exp(F.col("best") - F.col("log_sum")), 6))
    return made.select(F.col("row.kept").alias("row"), "lang_pred", score.alias("score"))


def _scorer(shared):
    def compute(texts, langs, bests, log_sums):
        known, texts = shared.value, texts_of(texts)
        labels, out = known["labels"], [[], [], []]
        flat, sizes, lettered = grams(texts)
        ends = np.cumsum(sizes)
        before = zip(langs.to_pylist(), bests.to_pylist(), log_sums.to_pylist(), strict=True)
        for a, b, has, (lang, top, log_sum) in zip((ends - sizes).tolist(), ends.tolist(), lettered.tolist(), before, strict=True):
            if not has or not labels:
                lang, top, log_sum = "und", None, None
            else:
                total = known["prior"].copy()
                for at in range(a, b, BLOCK_CHARS):
                    total += known["weights"][flat[at : min(b, at + BLOCK_CHARS)]].sum(axis=0, dtype=np.float64)
                best = int(total.argmax())
                own = float(total[best])
                own_sum = own + math.log(float(np.exp(total - own).sum()))
                log_sum = own_sum if top is None else float(np.logaddexp(log_sum, own_sum))
                if top is None or own > top:
                    lang, top = labels[best], own
            for o, v in zip(out, (lang, top, log_sum), strict=True):
                o.append(v)
        return out

    return compute


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept from training: crc32 of its id as text leaves 2 when divided by 4 (a null id is kept from it)."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 4 == 2, F.lit(True))
