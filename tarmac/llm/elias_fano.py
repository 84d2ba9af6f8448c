"""Monotone sequences of integers in few bits, and one level of an n-gram trie made of them, in mapped memory."""

from __future__ import annotations

import tempfile

import numpy as np

_U = np.uint64
#: Bits of a block of the unary part whose number of ones is kept.
_BLOCK_WORDS = 8


def _fields(values: np.ndarray, bits: int) -> np.ndarray:
    """Values of ``bits`` bits each, one after the other in 64-bit words."""
    if not bits or not len(values):
        return np.zeros(1, np.uint64)
    at = np.arange(len(values), dtype=np.uint64) * _U(bits)
    word, shift = (at >> _U(6)).astype(np.int64), at & _U(63)
    out = np.zeros(int(word[-1]) + 2, np.uint64)
    np.bitwise_or.at(out, word, values << shift)
    over = shift + _U(bits) > _U(64)
    np.bitwise_or.at(out, word[over] + 1, values[over] >> (_U(64) - shift[over]))
    return out


class EliasFano:
    """A sequence that never falls: the low bits of every value as they are, the high bits in unary.

    ``parts`` are plain arrays, so that they can be written and mapped; ``find`` and ``get`` work on many values at once.
    """

    def __init__(self, parts: dict[str, np.ndarray]):
        self.low, self.high, self.ones = parts["low"], parts["high"], parts["ones"]
        self.n, self.bits = (int(x) for x in parts["head"])
        self.zeros = np.arange(len(self.ones), dtype=np.int64) * (64 * _BLOCK_WORDS) - self.ones

    @staticmethod
    def parts(values: np.ndarray) -> dict[str, np.ndarray]:
        values = values.astype(np.uint64)
        n = len(values)
        bits = max(0, ((int(values[-1]) + 1) // n).bit_length() - 1) if n else 0
        high = (values >> _U(bits)).astype(np.int64) + np.arange(n)
        size = (int(high[-1]) + 2 if n else 1) + 64 * _BLOCK_WORDS
        flags = np.zeros(-(-size // (64 * _BLOCK_WORDS)) * 64 * _BLOCK_WORDS, np.uint8)
        flags[high] = 1
        words = np.packbits(flags, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(words).reshape(-1, _BLOCK_WORDS).sum(axis=1, dtype=np.int64)
        return {"low": _fields(values & _U((1 << bits) - 1), bits), "high": words, "ones": np.concatenate(([0], np.cumsum(counts)[:-1])), "head": np.array([n, bits])}

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """Position of the k-th one or zero of the unary part, counted from 0."""
        sums = self.ones if ones else self.zeros
        block = np.searchsorted(sums, k, "right") - 1
        rest, word = k - sums[block], block * _BLOCK_WORDS
        for _ in range(_BLOCK_WORDS - 1):  # skip whole words
            have = np.bitwise_count(self.high[word]).astype(np.int64)
            have = have if ones else 64 - have
            skip = rest >= have
            rest, word = rest - have * skip, word + skip
        bits = self.high[word] if ones else ~self.high[word]
        at = np.zeros(len(k), np.int64)
        for step in (32, 16, 8, 4, 2, 1):  # then halves of the word
            have = np.bitwise_count(bits & _U((1 << step) - 1)).astype(np.int64)
            skip = rest >= have
            rest, at = rest - have * skip, at + step * skip
            bits = np.where(skip, bits >> _U(step), bits)
        return word * 64 + at

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * _U(self.bits)
        word, shift = (at >> _U(6)).astype(np.int64), at & _U(63)
        rest = np.where(shift > 0, self.low[word + 1] << ((_U(64) - shift) & _U(63)), _U(0))
        return ((self.low[word] >> shift) | rest) & _U((1 << self.bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at places below the length."""
        return ((self._select(i, True) - i).astype(np.uint64) << _U(self.bits)) | self._low(i)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Place of the first value that is ``x`` or more (the length if there is none)."""
        x = x.astype(np.uint64)
        if not self.n:
            return np.zeros(len(x), np.int64)
        last = int(self.get(np.array([self.n - 1]))[0])
        inside = x <= _U(last)
        high = np.where(inside, x >> _U(self.bits), _U(0)).astype(np.int64)
        # Values with these high bits lie between two zeros of the unary part; the low bits are searched by halves.
        low = np.where(high > 0, self._select(np.maximum(high - 1, 0), False) + 1 - high, 0)
        end = self._select(high, False) - high
        want = x & _U((1 << self.bits) - 1)
        while (open_ := np.flatnonzero(low < end)).size:
            middle = (low[open_] + end[open_]) // 2
            less = self._low(middle) < want[open_]
            low[open_[less]] = middle[less] + 1
            end[open_[~less]] = middle[~less]
        return np.where(inside, low, self.n)

    def index(self, x: np.ndarray) -> np.ndarray:
        """Place of the value ``x``, -1 if it isn't there."""
        if not self.n:
            return np.full(len(x), -1)
        at = self.find(x)
        return np.where((at < self.n) & (self.get(np.minimum(at, self.n - 1)) == x.astype(np.uint64)), at, -1)


class Mapped:
    """Arrays in one file of the task that has no name and goes with it, mapped into memory."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.file = tempfile.TemporaryFile()
        places, at = {}, 0
        for name, a in arrays.items():
            data = np.ascontiguousarray(a)
            self.file.write(data.tobytes() + bytes(-data.nbytes % 8))
            places[name] = (at, data.nbytes, data.dtype)
            at += data.nbytes + -data.nbytes % 8
        self.file.write(bytes(8))
        self.file.flush()
        memory = np.memmap(self.file, np.uint8, "r")
        self.arrays = {name: memory[a : a + n].view(kind) for name, (a, n, kind) in places.items()}
        self.bytes = at

    def part(self, prefix: str) -> dict[str, np.ndarray]:
        return {k.removeprefix(prefix): v for k, v in self.arrays.items() if k.startswith(prefix)}


class TrieLevel:
    """N-grams of one order: for every context the words that follow it, with a code and a count each.

    Contexts and words are monotone sequences of ids. A context's words stand in a row, from one pointer to the next, by
    their places in the list of words; each context's places are added to the last value of the one before, so the whole
    level is monotone, and a word is found by the successor of its place relative to its context.
    """

    def __init__(self, context: np.ndarray, word: np.ndarray, codes: np.ndarray, counts: np.ndarray):
        """``context`` and ``word``: ids of distinct n-grams in order; ``codes`` and ``counts``: theirs."""
        fresh = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(context) else np.zeros(0, np.int64)
        words, place = np.unique(word, return_inverse=True)
        ends = np.append(fresh[1:], len(context)) - 1
        spans = place[ends] + 1 if len(fresh) else fresh
        base = np.concatenate(([0], np.cumsum(spans)[:-1])) if len(fresh) else fresh
        follow = place + np.repeat(base, np.diff(np.append(fresh, len(context)))) if len(fresh) else fresh
        made = {"contexts": context[fresh], "words": words, "pointers": np.append(fresh, len(context)), "follow": follow}
        arrays = {f"{k}.{name}": a for k, v in made.items() for name, a in EliasFano.parts(v).items()}
        self.mapped = Mapped(arrays | {"codes": codes, "counts": counts})
        self.contexts, self.words, self.pointers, self.follow = (EliasFano(self.mapped.part(f"{k}.")) for k in made)
        self.codes, self.counts = self.mapped.arrays["codes"], self.mapped.arrays["counts"]

    def find(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Places of n-grams, -1 for those that aren't there."""
        if not self.follow.n:
            return np.full(len(context), -1)
        c, w = self.contexts.index(context), self.words.index(word)
        known = np.flatnonzero((c >= 0) & (w >= 0))
        out = np.full(len(context), -1)
        start, end = (self.pointers.get(c[known] + k).astype(np.int64) for k in (0, 1))
        base = np.where(start > 0, self.follow.get(np.maximum(start - 1, 0)) + _U(1), _U(0))
        target = base + w[known].astype(np.uint64)
        at = self.follow.find(target)
        there = (at < end) & (self.follow.get(np.minimum(at, self.follow.n - 1)) == target)
        out[known] = np.where(there, at, -1)
        return out
