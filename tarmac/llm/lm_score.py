"""Scores of texts by an n-gram model of the corpus, kept in Elias-Fano tries.

Texts are tokenised in batches. An n-gram that a batch has is sent once, with its number in training texts, to the shard
that its context belongs to. The shard adds up the batches' counts, smooths them, builds one level of the trie in mapped
memory, looks up what each batch asked for and answers with codes of two bytes. Order follows order: words first, then
the n-grams of each higher order, whose contexts and lower probabilities the batches know by then.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tarmac.llm.common import discard, mix, utf8_of, words_of, written
from tarmac.llm.elias_fano import EliasFano, Mapped, TrieLevel

#: N-grams of the model, weight of the lower order's probability (as if seen so often), and of an unseen word.
ORDER, LOWER, UNSEEN = 2, 20.0, 0.1
#: A code is a logarithm to base 10 in these steps; the last code is that of an n-gram that isn't there.
STEP, NONE = 1 / 3000, 65535
#: Bytes of text of a batch, tokens of a shard, and occurrences of a context beyond which its words are dealt out to several shards.
BATCH_BYTES, SHARD_TOKENS, HOT = 6 << 20, 1_500_000, 200_000
#: Hash of the end of a text, and id of its beginning; ids of words and n-grams follow.
END, BEGIN = np.uint64(0x2D358DCCAA6C78A5), 1


def pack(values: np.ndarray, ascending: bool = False) -> bytes:
    """Unsigned integers, or the steps between ascending ones, in the fewest bytes that hold the largest, compressed byte by byte."""
    values = np.diff(values, prepend=values.dtype.type(0)) if ascending else values
    top = int(values.max()) if len(values) else 0
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(k).max)
    raw = np.ascontiguousarray(values.astype(kind).view(np.uint8).reshape(len(values), -1).T).tobytes() if len(values) else b""
    head = np.array([np.dtype(kind).itemsize, len(values)], np.uint32).tobytes()
    packed = pa.compress(raw, "zstd", asbytes=True) if len(raw) > 256 else raw
    return head + (packed if len(packed) < len(raw) else raw)


def unpack(data: bytes, ascending: bool = False) -> np.ndarray:
    size, n = (int(x) for x in np.frombuffer(data, np.uint32, 2))
    raw = data[8:] if len(data) - 8 == size * n else pa.decompress(data[8:], size * n, "zstd", asbytes=True)
    values = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).reshape(-1).view(f"<u{size}") if n else np.zeros(0, f"<u{size}")
    return np.cumsum(values.astype(np.uint64), dtype=np.uint64) if ascending else values


def quantised(log10: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-log10 / STEP), 0, NONE - 1).astype(np.uint16)


def _tokens(docs: DataFrame, text_col: str, held_out: Column, keep: tuple[str, ...]) -> DataFrame:
    """One row for each batch: its documents, the place of every token in the list of words, the words and their counts in training texts."""
    kept = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(1).alias("_"))
    picked = docs.select(kept.alias("row"), F.coalesce(held_out, F.lit(True)).alias("held_out"), F.col(f"`{text_col}`").alias("text"))
    doc = T.StructType([picked.schema["row"], picked.schema["held_out"], T.StructField("n", T.LongType())])
    schema = T.StructType([T.StructField("b", T.LongType()), T.StructField("docs", T.ArrayType(doc)), *[T.StructField(c, T.BinaryType()) for c in ("tokens", "words", "counts")], T.StructField("train", T.LongType()), T.StructField("train_docs", T.LongType())])
    arrow = to_arrow_schema(schema)

    def batch_of(b: int, rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        data, offsets = utf8_of(rows.column("text").combine_chunks() if rows.num_rows else pa.array([], pa.string()))
        _, _, hashes, firsts = words_of(data, offsets)
        n = np.diff(firsts) + 1
        flat = np.insert(hashes, firsts[1:], END)
        words, place = np.unique(flat, return_inverse=True)
        train = ~rows.column("held_out").to_numpy()
        counts = np.bincount(place[np.repeat(train, n)], minlength=len(words))
        held = [rows.column("row").combine_chunks(), rows.column("held_out").combine_chunks(), pa.array(n, pa.int64())]
        structs = pa.StructArray.from_arrays(held, fields=list(arrow.field("docs").type.value_type))
        column = pa.ListArray.from_arrays(pa.array([0, len(structs)], pa.int32()), structs).cast(arrow.field("docs").type)
        values = [[b], column, [pack(place)], [pack(words, True)], [pack(counts)], [int(n[train].sum())], [int(train.sum())]]
        return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, f.type) for v, f in zip(values, arrow, strict=True)], schema=arrow)

    def run(batches):
        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            lengths = np.diff(utf8_of(batch.column(2))[1])
            sums = np.cumsum(lengths)
            at = 0
            while at < batch.num_rows:
                before = int(sums[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(sums, before + BATCH_BYTES - size, "right")))
                held.append(batch.slice(at, to - at))
                size += int(sums[to - 1]) - before
                at = to
                if size >= BATCH_BYTES or at < batch.num_rows:
                    yield batch_of((part << 33) + seq, pa.Table.from_batches(held))
                    held, size, seq = [], 0, seq + 1
        if held:
            yield batch_of((part << 33) + seq, pa.Table.from_batches(held))

    return picked.mapInArrow(run, schema)


def _split(shard: np.ndarray):
    """Numbers of shards that occur, and the places that go to each, in order."""
    order = np.argsort(shard, kind="stable")
    found, starts = np.unique(shard[order], return_index=True)
    return zip(found.tolist(), np.split(order, starts[1:]), strict=True)


def _word_shards(words: np.ndarray, shards: int) -> np.ndarray:
    return (mix(words) % np.uint64(shards)).astype(np.int64)


def _vocabulary(state: DataFrame, shards: int) -> DataFrame:
    """(b, s, ids, counts, fresh): for each batch and shard the ids of its words (0: not in training) and their counts in training."""

    def asked(batches):
        for batch in batches:
            for b, words, counts in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                words, counts = unpack(words, True), unpack(counts)
                parts = list(_split(_word_shards(words, shards)))
                yield pa.RecordBatch.from_pydict({"b": [b] * len(parts), "s": [s for s, _ in parts], "words": [pack(words[at], True) for _, at in parts], "counts": [pack(counts[at]) for _, at in parts]})

    def answered(table: pa.Table) -> pa.Table:
        s = table.column("s")[0].as_py()
        asked_for = [unpack(w, True) for w in table.column("words").to_pylist()]
        words, place = np.unique(np.concatenate(asked_for), return_inverse=True)
        counts = np.zeros(len(words), np.int64)
        np.add.at(counts, place, np.concatenate([unpack(c) for c in table.column("counts").to_pylist()]).astype(np.int64))
        words, counts = words[counts > 0], counts[counts > 0]
        level = Mapped({f"words.{k}": v for k, v in EliasFano.parts(words).items()} | {"counts": counts})
        known = EliasFano(level.part("words."))
        out = {"b": table.column("b"), "s": table.column("s"), "ids": [], "counts": [], "fresh": np.zeros(len(asked_for), np.int64)}
        out["fresh"][0] = len(words)
        for w in asked_for:
            at = known.index(w)
            out["ids"].append(pack(np.where(at >= 0, at * shards + (s + BEGIN + 1), 0)))
            out["counts"].append(pack(np.where(at >= 0, level.arrays["counts"][np.maximum(at, 0)], 0) if len(words) else np.zeros(len(w), np.int64)))
        return pa.table(out)

    sent = state.select("b", "words", "counts").mapInArrow(asked, "b long, s long, words binary, counts binary")
    return sent.groupBy("s").applyInArrow(answered, "b long, s long, ids binary, counts binary, fresh long")


def _gathered(state: DataFrame, answers: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``state`` with ``got``, all answers to a batch in order of the shards."""
    got = answers.groupBy("b").agg(F.array_sort(F.collect_list(F.struct("s", *columns))).alias("got"))
    return state.join(got, "b", "left")


def _with_ids(state: DataFrame, shards: int) -> DataFrame:
    """``state`` with the ids and counts of its words, and for each batch the number of words that a shard first counted with it."""
    joined = _gathered(state.select("b", "docs", "tokens", "words"), _vocabulary(state, shards), ("ids", "counts", "fresh"))
    schema = T.StructType([state.schema["b"], state.schema["docs"], state.schema["tokens"], *[T.StructField(c, T.BinaryType()) for c in ("ids", "ns")], T.StructField("fresh", T.LongType())])

    def run(batches):
        for batch in batches:
            ids, ns, fresh = [], [], []
            for words, got in zip(batch.column("words").to_pylist(), batch.column("got").to_pylist(), strict=True):
                words, got = unpack(words, True), got or []
                own = [np.zeros(len(words), np.int64) for _ in range(2)]
                for (_, at), x in zip(_split(_word_shards(words, shards)), got, strict=True):
                    own[0][at], own[1][at] = unpack(x["ids"]), unpack(x["counts"])
                ids.append(pack(own[0]))
                ns.append(pack(own[1]))
                fresh.append(sum(x["fresh"] for x in got))
            yield pa.RecordBatch.from_arrays([batch.column("b"), batch.column("docs"), batch.column("tokens"), pa.array(ids, pa.binary()), pa.array(ns, pa.binary()), pa.array(fresh, pa.int64())], names=schema.names)

    return joined.mapInArrow(run, schema)


class Batch:
    """A batch's n-grams of one order: ``of`` has each token's place in the lists ``ids``, ``ns`` and ``logs``."""

    def __init__(self, tokens: np.ndarray, sizes: np.ndarray, held_out: np.ndarray, ids: np.ndarray, ns: np.ndarray, totals: dict):
        self.word, self.word_ids, self.totals = tokens.astype(np.int64), ids.astype(np.int64), totals
        self.firsts = np.cumsum(sizes) - sizes
        self.train = np.repeat(~held_out, sizes)
        self.of, self.ids, self.ns = self.word, self.word_ids, ns.astype(np.int64)
        self.logs = np.log10((self.ns + UNSEEN) / (totals["tokens"] + UNSEEN * (totals["words"] + 1)))

    def higher(self, shards: int) -> None:
        """Pairs of each token's context, the n-gram before it, and its word; those that training may have seen get a shard."""
        begin = len(self.ids)
        context = np.empty_like(self.of)
        context[1:] = self.of[:-1]
        context[self.firsts] = begin
        pairs, first, self.pair_of = np.unique(context * len(self.word_ids) + self.word, return_index=True, return_inverse=True)
        own = pairs // max(1, len(self.word_ids))
        self.context_n = np.append(self.ns, self.totals["docs"])[own]
        self.lower = self.logs[self.of[first]]
        self.context_id = np.append(self.ids, BEGIN)[own]
        self.pair_word = self.word_ids[self.word[first]]
        self.counts = np.bincount(self.pair_of[self.train], minlength=len(pairs))
        # The words of a context that comes often are dealt out to several shards.
        salt = mix(self.pair_word.astype(np.uint64)) % (self.context_n // HOT + 1).astype(np.uint64)
        self.shard = (mix(mix(self.context_id.astype(np.uint64)) + salt) % np.uint64(shards)).astype(np.int64)
        self.shard[(self.context_id == 0) | (self.pair_word == 0) | (self.context_n == 0)] = -1

    def asked(self):
        """For each shard its number and, by context and word, the pairs that go there."""
        order = np.lexsort((self.pair_word, self.context_id))
        for s, at in _split(self.shard[order]):
            if s >= 0:
                yield s, order[at]

    def answer(self, got: list[dict]) -> None:
        """Goes on to the pairs, as the n-grams of the next order, with what the shards have answered."""
        logs = self.lower + np.log10(LOWER / (self.context_n + LOWER))
        ids, ns = np.zeros(len(logs), np.int64), np.zeros(len(logs), np.int64)
        for (_, at), x in zip(self.asked(), got, strict=True):
            codes = unpack(x["codes"])
            logs[at] = np.where(codes == NONE, logs[at], -STEP * codes.astype(float))
            if x["ids"] is not None:  # of the highest order only the codes matter
                ids[at], ns[at] = unpack(x["ids"]), unpack(x["counts"])
        self.of, self.ids, self.ns, self.logs = self.pair_of, ids, ns, logs


def _batches(batch: pa.RecordBatch, totals: dict):
    """A ``Batch`` for each row, carried to the order whose answers the row has."""
    for b, docs, tokens, ids, ns in zip(batch.column("b").to_pylist(), batch.column("docs"), *[batch.column(c).to_pylist() for c in ("tokens", "ids", "ns")], strict=True):
        structs = docs.values
        held, sizes = structs.field("held_out").to_numpy(zero_copy_only=False), structs.field("n").to_numpy(zero_copy_only=False)
        yield b, structs, Batch(unpack(tokens), sizes, held, unpack(ids), unpack(ns), totals)


def _level(state: DataFrame, totals: dict, done: int, shards: int, last: bool) -> DataFrame:
    """(b, s, codes, ids, counts): for each batch and shard the codes of its n-grams of the next order."""

    def asked(batches):
        for batch in batches:
            gots = batch.column("gots").to_pylist() if done else [[]] * batch.num_rows
            for (b, _, x), got in zip(_batches(batch, totals), gots, strict=True):
                for answers in got:
                    x.higher(shards)
                    x.answer(answers or [])
                x.higher(shards)
                for s, at in x.asked():
                    context = x.context_id[at]
                    fresh = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
                    lengths = np.diff(np.append(fresh, len(at)))
                    values = (context[fresh], lengths, x.context_n[at][fresh], x.pair_word[at], x.counts[at], quantised(x.lower[at]))
                    yield pa.RecordBatch.from_pydict({"b": [b], "s": [s]} | {c: [pack(v, c == "contexts")] for c, v in zip(_SENT, values, strict=True)})

    def answered(table: pa.Table) -> pa.Table:
        s = table.column("s")[0].as_py()
        rows = [{c: unpack(v, c == "contexts") for c, v in zip(_SENT, r, strict=True)} for r in zip(*[table.column(c).to_pylist() for c in _SENT], strict=True)]
        asked_for = [(np.repeat(r["contexts"], r["lengths"]).astype(np.int64), r["followers"].astype(np.int64)) for r in rows]
        context, word = (np.concatenate([x[i] for x in asked_for]) for i in range(2))
        count = np.concatenate([r["counts"] for r in rows]).astype(np.int64)
        of = np.concatenate([np.repeat(r["contexts_n"], r["lengths"]) for r in rows]).astype(np.int64)
        lower = np.concatenate([r["lower"] for r in rows])
        order = np.lexsort((word, context))
        fresh = np.flatnonzero(np.append(True, (np.diff(context[order]) != 0) | (np.diff(word[order]) != 0)))
        sums, first = np.add.reduceat(count[order], fresh), order[fresh]
        first, sums = first[sums > 0], sums[sums > 0]
        chance = (sums + LOWER * 10 ** (-STEP * lower[first].astype(float))) / (of[first] + LOWER)
        trie = TrieLevel(context[first], word[first], quantised(np.log10(chance)), sums)
        out = {"b": table.column("b"), "s": table.column("s"), "codes": [], "ids": [], "counts": []}
        for c, w in asked_for:
            at = trie.find(c, w)
            there = at >= 0
            codes, counts = np.full(len(at), NONE, np.uint16), np.zeros(len(at), np.int64)
            codes[there], counts[there] = trie.codes[at[there]], trie.counts[at[there]]
            out["codes"].append(pack(codes))
            out["ids"].append(None if last else pack(np.where(there, at * shards + (s + BEGIN + 1), 0)))
            out["counts"].append(None if last else pack(counts))
        return pa.table(out, schema=pa.schema([("b", pa.int64()), ("s", pa.int64()), *[(c, pa.binary()) for c in ("codes", "ids", "counts")]]))

    sent = state.select("b", "docs", "tokens", "ids", "ns", *(["gots"] if done else [])).mapInArrow(asked, "b long, s long, " + ", ".join(f"{c} binary" for c in _SENT))
    return sent.groupBy("s").applyInArrow(answered, _ANSWER)


_SENT = ("contexts", "lengths", "contexts_n", "followers", "counts", "lower")
_ANSWER = "b long, s long, codes binary, ids binary, counts binary"


def score_texts(docs: DataFrame, held_out: Column, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), order: int = ORDER) -> DataFrame:
    """Per row: ``row`` (its ``keep`` columns), held_out, n_tokens, n_known, train_tokens, base_score and score.

    Tokens are the white-space words of the text, A-Z in lower case, and one end. The model learns from all texts but those
    held out (a null ``held_out`` holds out) and scores every whole text; ``score`` is the sum of its logarithms to base 10.
    The probability of a word after n - 1 others, of which the first follow the text's beginning, is
    (count + LOWER * p) / (count of the context + LOWER) with p that of the order below; that of a single word
    (count + UNSEEN) / (tokens + UNSEEN * (words + 1)), whose sum over the text is ``base_score``. They add up to one over
    all words and one that was never seen; codes are exact to half a ``STEP``.

    A null text is an empty one: its end is its only token. Repeated rows are texts of their own and count as often.
    Without training texts every token has the probability one. An empty table gives no rows. Other columns are ignored,
    whatever their names. N-grams, not texts, are shuffled; a batch is a row of a few bytes for each token.
    """
    if order < 1:
        raise ValueError("order must be 1 or more")
    first = written(_tokens(docs, text_col, held_out, keep))
    sums = first.agg(F.sum("train").alias("tokens"), F.sum("train_docs").alias("docs"), F.sum(F.octet_length("words")).alias("bytes"), F.sum(F.aggregate("docs", F.lit(0).cast("long"), lambda a, d: a + d["n"])).alias("all")).first()
    least = docs.sparkSession.sparkContext.defaultParallelism
    state = written(_with_ids(first, max(least, (sums["bytes"] or 0) // (4 * SHARD_TOKENS) + 1)))
    discard(first)
    fresh = state.agg(F.sum("fresh")).first()[0] or 0
    totals = {"tokens": sums["tokens"] or 0, "docs": sums["docs"] or 0, "words": fresh}
    shards = max(least, (sums["all"] or 0) // SHARD_TOKENS + 1)
    for done in range(order - 1):
        answers = _level(state, totals, done, shards, done == order - 2)
        before = F.col("gots") if done else F.array().cast("array<array<struct<s:bigint,codes:binary,ids:binary,counts:binary>>>")
        joined = _gathered(state, answers, ("codes", "ids", "counts")).withColumn("gots", F.concat(before, F.array(F.coalesce("got", F.array())))).drop("got")
        if done < order - 2:
            below, state = state, written(joined)
            discard(below)
        else:
            state = joined
    doc = state.schema["docs"].dataType.elementType
    results = [T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known", "train_tokens")] + [T.StructField(n, T.DoubleType()) for n in ("base_score", "score")]
    schema = T.StructType([doc["row"], doc["held_out"], *results])

    def run(batches):
        for batch in batches:
            gots = batch.column("gots").to_pylist() if order > 1 else [[]] * batch.num_rows
            for (_, structs, x), got in zip(_batches(batch, totals), gots, strict=True):
                base, known = x.logs[x.of], x.ns[x.of] > 0
                for answers in got:
                    x.higher(shards)
                    x.answer(answers or [])
                each = (np.add.reduceat(v, x.firsts) for v in (base, x.logs[x.of]))
                n = len(structs)
                yield pa.RecordBatch.from_arrays([structs.field("row"), structs.field("held_out"), structs.field("n"), pa.array(np.add.reduceat(known.astype(np.int64), x.firsts)), pa.array(np.full(n, totals["tokens"])), *[pa.array(v) for v in each]], names=schema.names)

    columns = ["b", "docs", "tokens", "ids", "ns", *(["gots"] if order > 1 else [])]
    return state.select(*columns).mapInArrow(run, schema)


def perplexity(log10: float, tokens: int) -> float:
    """Of texts with so many tokens and that sum of logarithms."""
    return math.pow(10, -log10 / tokens)
