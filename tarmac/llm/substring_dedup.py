"""Substring dedup: every run of several consecutive sentences is hashed, joined globally, and non-first repeats are removed."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.llm.common import _MULT, add_columns, add_rows, discard, mix, utf8_of, words_of, written

#: Sentences and words that a run has at least: a run of very short sentences takes in more of them.
RUN, MIN_WORDS = 3, 12
#: Of as many words in a row, one at least ends a sentence or is cut after: the one of least hash, alike wherever they stand.
WINDOW = 8

# Bytes that end a sentence, and closing marks that may follow them.
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True
_CLOSING = np.zeros(256, bool)
_CLOSING[list(b"\"')]}|")] = True

_INVERSE = np.uint64(pow(int(_MULT), -1, 1 << 64))


def sentences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sentences of all rows: first word of each (and an end), row bounds among sentences, words' start bytes, hashes.

    A sentence ends with a word that ends in ``.``, ``!`` or ``?`` (before closing marks), at a line's end, and at the
    end of its text. Where ``WINDOW`` words in a row end none, a cut follows the one of least hash (the last of equals).
    So cuts hang on fewer than ``WINDOW`` words to either side: in a passage that stands in two texts they are the same
    but for those near its ends, and one of 47 words or more has three whole sentences of twelve words in both.
    """
    starts, ends, hashes, rows = words_of(data, offsets, lower=False)
    n = len(starts)
    if n == 0:
        return np.zeros(1, np.int64), np.zeros(len(offsets), np.int64), starts, hashes, rows
    lasts = data[ends - 1]
    before = data[np.maximum(ends - 2, starts)]
    stop = _STOP[lasts] | (_CLOSING[lasts] & _STOP[before])
    lines = np.cumsum(data == 10)
    stop[:-1] |= lines[starts[1:]] > lines[ends[:-1] - 1]
    stop[rows[1:][rows[1:] > 0] - 1] = True
    first = np.concatenate(([True], stop[:-1]))
    if n >= WINDOW:
        order = np.where(stop, np.uint64(0), mix(hashes) | np.uint64(1))
        windows = n - WINDOW + 1
        least, at = order[:windows].copy(), np.arange(windows)
        for k in range(1, WINDOW):
            own = order[k : k + windows]
            take = own <= least
            least[take] = own[take]
            at[take] = np.flatnonzero(take) + k
        text = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
        cut = at[(text[:windows] == text[WINDOW - 1 :]) & (least > 0)]
        first[cut + 1] = True
    begin = np.append(np.flatnonzero(first), n)
    return begin, np.searchsorted(begin[:-1], rows), starts, hashes, rows


def run_spans(data: np.ndarray, offsets: np.ndarray, run: int = RUN, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the run that begins with each sentence: row, hash, first sentence and the one after it in the row, and whether it is new there.

    A run is the shortest with ``run`` sentences and ``min_words`` words; where the text ends before that, there is none.
    """
    begin, bounds, _, hashes, _ = sentences(data, offsets)
    count = len(begin) - 1
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = np.arange(count)
    to = np.maximum(at + run, np.searchsorted(begin, begin[:-1] + min_words))
    whole = to <= bounds[row + 1]
    at, to, row = at[whole], to[whole], row[whole]
    a, b = begin[at], begin[to]
    # Polynomial hash of the words a..b-1 from prefix sums, made independent of the place by the inverse power.
    power, back = (np.full(len(hashes) + 1, x, np.uint64) for x in (_MULT, _INVERSE))
    power[0] = back[0] = 1
    power, back = np.cumprod(power, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * power[:-1], dtype=np.uint64, out=sums[1:])
    spans = mix((sums[b] - sums[a]) * back[a] + (b - a).astype(np.uint64))
    # A run is new unless it stands before in the same row.
    order = np.lexsort((spans, row))
    new = np.ones(len(spans), bool)
    new[order[1:]] = (spans[order[1:]] != spans[order[:-1]]) | (row[order[1:]] != row[order[:-1]])
    return row, spans.view(np.int64), (at - bounds[row]).astype(np.int32), (to - bounds[row]).astype(np.int32), new


def _text_key(text):
    return F.xxhash64(F.coalesce(text, F.lit("")))


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, tk, places) of the texts that hold runs that are not the first of their kind, in the order of ids and places.

    ``places`` are the runs' first sentences and the ones after them. They are written, so the shuffles of runs, which are
    larger than the texts, are gone from disk before these are shuffled.
    """
    keyed = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).withColumn("tk", _text_key(F.col("text")))
    fields = [T.StructField("span", T.LongType()), T.StructField("place", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("new", T.BooleanType())]
    runs = add_rows(keyed, "text", lambda texts: run_spans(*utf8_of(texts), run, min_words), fields, ["id", "tk"])
    # The counts are pre-aggregated where the runs are made, so a run that a third of all texts share costs one row a task.
    least, nulls = F.min("id"), F.max(F.col("id").isNull())
    firsts = runs.where("new").groupBy("span").agg(least.alias("first"), F.max("id").alias("last"), nulls.alias("nulls")).where((F.col("first") < F.col("last")) | (F.col("nulls") & F.col("first").isNotNull()))
    # Written, so that both sides of the join are plain shuffles, whose large partitions Spark splits.
    firsts = written(firsts.select("span", F.when(~F.col("nulls"), F.col("first")).alias("first"), F.lit(True).alias("known")))
    later = F.col("known") & F.col("id").isNotNull() & (F.col("first").isNull() | (F.col("id") > F.col("first")))
    found = runs.join(firsts, "span", "left").where(~F.col("new") | later)
    places = written(found.groupBy("id", "tk").agg(F.collect_set(F.struct("place", "stop")).alias("places")))
    discard(firsts)
    return places


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), run: int = RUN, min_words: int = MIN_WORDS
) -> DataFrame:
    """Per row: ``row`` (its ``keep`` columns), text without the sentences of non-first repeated runs, n_sentences and n_removed.

    The first occurrence, by id and place, keeps its sentences; later ones lose them, within a text too. Rows of one id
    count as one document and don't remove each other's; so do rows with a null id, which come first. Texts without a repeat stay
    as they are, byte by byte; null stays null; a text all of whose sentences are repeats becomes empty.
    """
    by_doc = repeated_runs(docs, id_col, text_col, run, min_words)
    left = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).withColumn("tk", _text_key(F.col("text")))
    right = by_doc.select(F.col("id").alias("id2"), F.col("tk").alias("tk2"), "places")
    joined = left.join(right, (F.col("tk") == F.col("tk2")) & F.col("id").eqNullSafe(F.col("id2")), "left").select("kept", "text", "places")

    def compute(texts, places):
        data, offsets = utf8_of(texts)
        begin, bounds, starts, _, _ = sentences(data, offsets)
        raw = data.tobytes()
        out: list[list] = [[], [], []]
        for i, (text, own) in enumerate(zip(texts.to_pylist(), places.to_pylist(), strict=True)):
            n = int(bounds[i + 1] - bounds[i])
            gone = np.zeros(n, bool)
            for p in own or ():
                gone[p["place"] : p["stop"]] = True
            if gone.any():
                edges = np.append(starts[begin[bounds[i] : bounds[i + 1]]], offsets[i + 1])
                edges[0] = offsets[i]
                text = b"".join(raw[edges[k] : edges[k + 1]] for k in np.flatnonzero(~gone).tolist()).decode("utf-8").strip()
            out[0].append(text)
            out[1].append(n)
            out[2].append(int(gone.sum()))
        return out

    fields = [T.StructField("text", T.StringType()), T.StructField("n_sentences", T.LongType()), T.StructField("n_removed", T.LongType())]
    return add_columns(joined, ["text", "places"], compute, fields, ["kept"]).select(F.col("row.kept").alias("row"), "text", "n_sentences", "n_removed")
