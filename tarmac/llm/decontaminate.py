"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark items scans every text once.

A word is a number of three digits, which are characters of the automaton. Items are cut into pieces of about half a window,
so any window holds a whole piece; a hit of a piece is extended word by word in both directions. So a benchmark word costs
the automaton three nodes at most, not several for each window that it stands in.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.llm.common import add_columns

#: Words of one window.
WINDOW = 10
#: Bytes of normalised items in one automaton (measured: about 55 bytes of a worker's memory each, at most a million distinct
#: words); more text makes more blocks, and every block scans the texts.
BLOCK_BYTES = 2_000_000
#: Digits of a word's number and their base: a state of the automaton has at most so many next ones, which are searched in a row.
DIGITS, BASE = 3, 128

#: Byte map of the normal form: digits, a-z and bytes above 0x7F stay, A-Z become lower case, all others separate words.
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def normal_words(text: str) -> list[bytes]:
    """Words of the normal form, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_NORMAL).split()


def benchmark_items(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct (item, words) of all items that have words, in normal form with single spaces."""

    def compute(texts):
        return [[b" ".join(normal_words(t)).decode("utf-8", "surrogatepass") if t else "" for t in texts.to_pylist()]]

    made = add_columns(benchmark, [text_col], compute, [T.StructField("words", T.StringType())], [id_col])
    return made.select(F.col(f"row.`{id_col}`").cast("string").alias("item"), "words").where("words <> ''").distinct()


def _digits(number: int) -> str:
    """The characters of a word's number; each place has its own, so no hit begins within a word."""
    return "".join(chr(1 + k * BASE + number // BASE**k % BASE) for k in range(DIGITS))


class Scanner:
    """An automaton of pieces of items, and what is needed to extend a hit to windows."""

    def __init__(self, items: list[tuple[str | None, str]], size: int = WINDOW):
        self.size, self.piece = size, (size + 1) // 2
        self.word: dict[bytes, str] = {}
        # Of each piece: the words beside it, as far as a window may reach, and the items that have it so.
        at: dict[str, dict[tuple[str, str] | None, set]] = {}
        for name, words in items:
            text = "".join([self.word.setdefault(w, _digits(len(self.word))) for w in words.encode("utf-8", "surrogatepass").split(b" ")])
            if len(text) < size * DIGITS:
                at.setdefault(text, {}).setdefault(None, set()).add(name)
                continue
            reach, long = (size - self.piece) * DIGITS, self.piece * DIGITS
            for s in range(0, len(text) - long + 1, long):
                e = s + long
                at.setdefault(text[s:e], {}).setdefault((text[max(0, s - reach) : s], text[e : e + reach]), set()).add(name)
        self.machine = ahocorasick.Automaton()
        for piece, places in at.items():
            self.machine.add_word(piece, (len(piece), [(beside, tuple(names - {None})) for beside, names in places.items()]))
        self.machine.make_automaton()

    def hits(self, words: list[bytes]) -> Iterator[tuple[int, int, tuple[str, ...]]]:
        """(first word, word after the last, items) of runs that are covered by windows of items; runs may overlap."""
        if not len(self.machine):
            return
        get = self.word.get
        text = "".join([get(w, "\0" * DIGITS) for w in words])
        reach = (self.size - self.piece) * DIGITS
        for last, (n, places) in self.machine.iter(text):
            start, end = last + 1 - n, last + 1
            left, right = text[max(0, start - reach) : start], text[end : end + reach]
            for beside, names in places:
                if beside is None:
                    yield start // DIGITS, end // DIGITS, names
                    continue
                a, b = _common(beside[0][::-1], left[::-1]) // DIGITS, _common(beside[1], right) // DIGITS
                if a + n // DIGITS + b >= self.size:
                    yield start // DIGITS - a, end // DIGITS + b, names


def _common(a: str, b: str) -> int:
    """Length of the common beginning."""
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


_built: dict[str, Scanner] = {}


def _scanner(shared) -> Scanner:
    """The block's automaton, built once in each Python worker."""
    if shared.value["block"] not in _built:
        _built.clear()
        _built[shared.value["block"]] = Scanner(shared.value["items"], shared.value["size"])
    return _built[shared.value["block"]]


def _char_spans(text: str, ranges: list[tuple[int, int]]) -> list[dict]:
    """Character offsets in the original text of ranges of its words."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    inside = np.frombuffer(raw.tobytes().translate(_NORMAL), np.uint8) != 32
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    chars = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    return [{"start": int(chars[starts[a]]), "end": int(chars[ends[b - 1]])} for a, b in ranges]


def _merged(ranges: set[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_RANGES = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    item_id: str = "item_id",
    item_text: str = "text",
    size: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Per row of ``docs``: ``row`` (its ``keep`` columns), n_words, n_hit, items and spans of benchmark text in it.

    ``items`` are the sorted distinct ids, as strings, of items with an occurring window; ``spans`` are merged character
    ranges of the original text. Null and empty texts have no words. Items with a null id mark words, but are not
    listed; repeated items count once. An item of fewer words than a window, but not none, is one window. Items are
    collected in blocks of about ``block_bytes``, an item in one block, and every block scans the text once in a worker
    of its own, so what is broadcast never grows with the benchmark; up to ``block_bytes`` there is one block.
    """
    spark = docs.sparkSession
    pairs = benchmark_items(benchmark, item_id, item_text)
    total = pairs.agg(F.sum(F.octet_length("words") + 1)).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    call = uuid.uuid4().hex  # workers outlive a call, and keep automata by name
    current, inputs = docs, [text_col]
    keep_all = list(dict.fromkeys([*keep, text_col])) if blocks > 1 else list(keep)
    for block in range(blocks):
        # A block holds about block_bytes, so the driver and a worker never see more than that at once.
        mine = pairs if blocks == 1 else pairs.where(F.pmod(F.xxhash64("words", "item"), F.lit(blocks)) == block)
        shared = spark.sparkContext.broadcast({"block": f"{call}-{block}", "size": size, "items": [tuple(r) for r in mine.collect()]})

        def compute(texts, found=None, seen=None, shared=shared):
            scanner = _scanner(shared)
            out: list[list] = [[], [], []]
            found = found.to_pylist() if found is not None else [None] * len(texts)
            seen = seen.to_pylist() if seen is not None else [None] * len(texts)
            for text, old, old_items in zip(texts.to_pylist(), found, seen, strict=True):
                words = normal_words(text) if text else []
                ranges, ids = {(r["start"], r["end"]) for r in old or ()}, set(old_items or ())
                for a, b, names in scanner.hits(words):
                    ranges.add((a, b))
                    ids.update(names)
                out[0].append(len(words))
                out[1].append([{"start": a, "end": b} for a, b in _merged(ranges)])
                out[2].append(sorted(ids))
            return out

        fields = [T.StructField("n_words", T.LongType()), T.StructField("found", _RANGES), T.StructField("items", T.ArrayType(T.StringType()))]
        last = block == blocks - 1
        if last:

            def finish(texts, found=None, seen=None, scan=compute):
                n, found, items = scan(texts, found, seen)
                spans = [_char_spans(t, [(r["start"], r["end"]) for r in f]) if f else [] for t, f in zip(texts.to_pylist(), found, strict=True)]
                return [n, [sum(r["end"] - r["start"] for r in f) for f in found], items, spans]

            fields = [fields[0], T.StructField("n_hit", T.LongType()), fields[2], T.StructField("spans", _RANGES)]
            return add_columns(current, inputs, finish, fields, list(keep) if blocks == 1 else ["row"]).select(
                "row" if blocks == 1 else F.struct(*[F.col(f"row.row.`{c}`").alias(c) for c in keep]).alias("row"), *[f.name for f in fields]
            )
        current = add_columns(current, inputs, compute, fields, keep_all if block == 0 else ["row"])
        current = current.select("row" if block == 0 else F.col("row.row").alias("row"), "found", "items").withColumn("scan_text", F.col(f"row.`{text_col}`"))
        inputs = ["scan_text", "found", "items"]
    raise AssertionError("unreachable")
