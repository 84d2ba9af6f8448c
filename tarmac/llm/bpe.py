"""BPE encoding and decoding: batched numpy merge rounds over the symbols of many words at once."""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tarmac.llm.common import add_columns, texts_of

#: Words that a Python worker remembers; beyond it the memory starts anew, which changes no result.
WORD_MEMORY = 400_000
#: Words of more bytes are merged by a queue of their pairs, whose time grows with n log n, not in rounds.
LONG_WORD = 1000

# Fixed values. Letters and digits that Unicode 17 added, as ranges: the vocabulary's library, which follows Unicode 16,
# takes them for marks.
_ADDED = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A "
    "11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 "
    "18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED "
    "1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
# Lower-case forms that Unicode 16 and 17 added: first, last and distance.
_LOWER = "1C89 1C89 1, A7CB A7CB -A567, A7CC A7CC 1, A7CE A7CE 1, A7D2 A7D2 1, A7D4 A7D4 1, A7DA A7DA 1, A7DC A7DC -A641, 10D50 10D65 20, 16EA0 16EB8 1B"

# Combining marks that Unicode 10 and later added, and a vowel that then first composed: the library neither orders nor composes them.
_UNORDERED = (
    "7FD 898-89F 8CA-8D3 9FE C3C D3B-D3C EBA 1715 1ABF-1ACE 1DF6-1DFA A82C 10D24-10D27 10EAB-10EAC 10EFD-10EFF 10F46-10F50 10F82-10F85 11070 1133B 1145E "
    "11839-1183A 11930 1193D-1193E 11943 119E0 11A34 11A47 11A99 11D42 11D44-11D45 11D97 11F41-11F42 16FF0-16FF1 1E08F 1E130-1E136 1E2AE 1E2EC-1E2EF 1E4EC-1E4EF"
)


def _ranges(text: str) -> str:
    """Ranges of hexadecimal code points as the inside of a character class."""
    return "".join("-".join(f"\\U{int(x, 16):08x}" for x in part.split("-")) for part in text.split())


def _members(text: str) -> frozenset[str]:
    """The characters of such ranges."""
    ends = [[int(x, 16) for x in part.split("-")] for part in text.split()]
    return frozenset(chr(c) for e in ends for c in range(e[0], e[-1] + 1))


_NEW = _ranges(_ADDED)
_NEW_LOWER = {c: c + int(by, 16) for a, b, by in (x.split() for x in _LOWER.split(",")) for c in range(int(a, 16), int(b, 16) + 1)}


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class WordBpe:
    """A byte-level BPE with word ends, read from a vocabulary file; ids equal those of the public tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = regex.compile(split)
        # The same pattern with the added letters among the marks, for texts that hold one of them.
        self.added, self.marks = _members(_ADDED), _members(_UNORDERED)
        self.upper = frozenset(map(chr, _NEW_LOWER))
        marks = split.replace(r"[^\s\p{L}\p{N}]", f"[[^\\s\\p{{L}}\\p{{N}}]||[{_NEW}]]").replace(r"[\p{L}]", f"[\\p{{L}}--[{_NEW}]]").replace(r"[\p{N}]", f"[\\p{{N}}--[{_NEW}]]")
        self.unordered = regex.compile(f"([{_ranges(_UNORDERED)}])")
        self.exact_pattern = regex.compile(marks, regex.V1)
        self.inner = np.array([self.vocab[c] for c in letters], np.int64)
        self.final = np.array([self.vocab[c + self.suffix] for c in letters], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([self.vocab[a] for a, _ in merges], np.uint64)
        right = np.array([self.vocab[b] for _, b in merges], np.uint64)
        made = np.array([self.vocab[a + b] for a, b in merges], np.int64)
        keys = (left << np.uint64(32)) | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.pieces = [names.get(i, "").encode("utf-8") for i in range(max(names) + 1)]
        self.memory: dict[str, bytes] = {}

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as unsigned 32-bit integers. Every round merges, in all words at once, the leftmost pair of lowest rank of each word."""
        lengths = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.inner[data]
        symbols[np.cumsum(lengths) - 1] = self.final[data[np.cumsum(lengths) - 1]]
        word = np.repeat(np.arange(len(words)), lengths)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        long = lengths > LONG_WORD
        if long.any():
            for i in np.flatnonzero(long).tolist():
                ids = self._merge_long(symbols[word == i])
                done.append((np.full(len(ids), i), ids))
            symbols, word = symbols[~long[word]], word[~long[word]]
        none = np.int64(1 << 40)
        while len(symbols):
            pair = (symbols[:-1].astype(np.uint64) << np.uint64(32)) | symbols[1:].astype(np.uint64)
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            known = (self.keys[at] == pair) & (word[:-1] == word[1:])
            rank = np.where(known, self.ranks[at], none)
            starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            best = np.minimum.reduceat(np.append(rank, none), starts)
            best_of = np.repeat(best, np.diff(np.append(starts, len(symbols))))
            open_word = best_of < none
            if not open_word.all():
                done.append((word[~open_word], symbols[~open_word]))
            if not open_word.any():
                break
            chosen = np.append(rank, none) == best_of
            chosen &= open_word
            # All disjoint pairs of the word's lowest rank merge in one round, the leftmost of overlapping ones first.
            places = np.flatnonzero(chosen)
            if len(places) > 1:
                run_start = np.concatenate(([True], np.diff(places) != 1))
                first = np.maximum.accumulate(np.where(run_start, np.arange(len(places)), 0))
                places = places[(np.arange(len(places)) - first) % 2 == 0]
            symbols = symbols.copy()
            symbols[places] = self.made[at[places]]
            open_word[places + 1] = False
            symbols, word = symbols[open_word], word[open_word]
        owner, ids = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
        order = np.argsort(owner, kind="stable")
        flat = ids[order].astype("<u4").tobytes()
        ends = 4 * np.cumsum(np.bincount(owner, minlength=len(words)))
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def _merge_long(self, symbols: np.ndarray) -> np.ndarray:
        """Ids of one long word: its pairs wait in a queue by rank and place; pairs found by binary search, as in the rounds."""

        def rank_of(a: int, b: int) -> tuple[int, int] | None:
            at = int(np.searchsorted(self.keys, np.uint64(a << 32 | b)))
            return (int(self.ranks[at]), int(self.made[at])) if at < len(self.keys) and int(self.keys[at]) == a << 32 | b else None

        known: dict[tuple[int, int], tuple[int, int] | None] = {}
        value, n = symbols.tolist(), len(symbols)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        queue: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i] if i >= 0 else -1
            if j >= 0:
                pair = (value[i], value[j])
                if pair not in known:
                    known[pair] = rank_of(*pair)
                if known[pair] is not None:
                    heapq.heappush(queue, (known[pair][0], i, *pair))

        for i in range(n):
            offer(i)
        while queue:
            _, i, a, b = heapq.heappop(queue)
            j = after[i]
            if value[i] != a or j < 0 or value[j] != b:  # one of the two was merged before
                continue
            value[i], value[j] = known[(a, b)][1], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return np.array([v for v in value if v >= 0], np.int64)

    def normal(self, text: str) -> str:
        """NFC, each run of white space one space, lower case letter by letter (a final sigma has no form of its own)."""
        if text.isascii():
            return text.lower()
        parts = [text] if self.marks.isdisjoint(text) else self.unordered.split(text)
        text = "".join(unicodedata.normalize("NFC", part) for part in parts).replace("Σ", "σ").lower()
        return text if self.upper.isdisjoint(text) else text.translate(_NEW_LOWER)

    def words(self, text: str) -> list[str]:
        """Words in order; a special token stands as itself behind a zero character."""
        out: list[str] = []
        for i, part in enumerate(self.special_pattern.split(text)):
            if i % 2:
                out.append("\0" + part)
            elif part:
                lower = self.normal(part)
                out.extend((self.pattern if lower.isascii() or self.added.isdisjoint(lower) else self.exact_pattern).findall(lower))
        return out

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every whole text, as unsigned 32-bit integers."""
        split = [self.words(t) for t in texts]
        if len(self.memory) > WORD_MEMORY:
            self.memory.clear()
        new = list(set().union(*split).difference(self.memory))
        for w in [w for w in new if w[0] == "\0" and w[1:] in self.special]:
            self.memory[w] = np.array([self.special[w[1:]]], "<u4").tobytes()
        new = [w for w in new if w not in self.memory]
        at = 0
        while at < len(new):  # blocks of about a million letters
            to, size = at, 0
            while to < len(new) and (to == at or size < 1_000_000):
                size += len(new[to])
                to += 1
            for w, ids in zip(new[at:to], self.merge([w.encode("utf-8", "replace") for w in new[at:to]]), strict=True):
                self.memory[w] = ids
            at = to
        get = self.memory.__getitem__
        return [np.frombuffer(b"".join(map(get, words)), "<u4") for words in split]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: the tokens' strings joined by spaces, as the file names no decoder."""
        return b" ".join(map(self.pieces.__getitem__, ids.tolist())).decode("utf-8", "replace")


_loaded: dict[str, WordBpe] = {}


def bpe(path: str) -> WordBpe:
    """The tokenizer of a file, loaded once in each Python worker."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row: ``row`` (its ``keep`` columns) and ``ids``, the token ids of the whole text (null: no ids)."""

    def compute(texts):
        return [[ids.astype(np.int32) for ids in bpe(path).encode_batch(texts_of(texts))]]

    return add_columns(docs, [text_col], compute, [T.StructField("ids", T.ArrayType(T.IntegerType(), False))], list(keep))


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row: ``row`` (its ``keep`` columns) and ``decoded``, the text of the ids (null: empty)."""

    def compute(ids):
        return [[bpe(path).decode(np.asarray(x, np.int64)) if x else "" for x in ids.to_pylist()]]

    return add_columns(encoded, [ids_col], compute, [T.StructField("decoded", T.StringType())], list(keep))


def round_trip(docs: DataFrame, path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """Encodes and decodes every whole text in one pass: n_tokens, ids_sha256 and decoded_sha256, and the ids if asked for.

    A null text counts as empty, a text without tokens has an empty list and an empty decoded text; equal texts give
    equal values.
    """

    def compute(texts):
        tool = bpe(path)
        encoded = tool.encode_batch(texts_of(texts))
        out = [
            [len(ids) for ids in encoded],
            [hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest() for ids in encoded],
            [hashlib.sha256(tool.decode(ids).encode("utf-8")).hexdigest() for ids in encoded],
        ]
        return [*out, [ids.astype(np.int32) for ids in encoded]] if with_ids else out

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType(), False)))
    return add_columns(docs, [text_col], compute, fields, list(keep))
