"""BPE over bytes without word ends: the merge rounds of ``WordBpe`` with the words of a byte-level vocabulary."""

from __future__ import annotations

import json

import numpy as np
import regex

from tarmac.llm.bpe import _ADDED, WordBpe, _members, _ranges, byte_letters

# Fixed value: how byte-level vocabularies of this kind split a text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteBpe(WordBpe):
    """A byte-level BPE read from a vocabulary file; special tokens in a text are ordinary text, and letters keep their case."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.vocab = model["vocab"]
        self.special = {}
        self.inner = np.array([self.vocab[c] for c in byte_letters()], np.int64)
        self.final = self.inner
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = (np.array([self.vocab[m[i]] for m in merges], np.uint64) for i in (0, 1))
        keys = (left << np.uint64(32)) | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([self.vocab[a + b] for a, b in merges], np.int64)[order]
        self.added, new = _members(_ADDED), _ranges(_ADDED)
        self.pattern = regex.compile(PATTERN)
        exact = PATTERN.replace(r"[^\s\p{L}\p{N}]", f"[[^\\s\\p{{L}}\\p{{N}}]||[{new}]]")
        for kind in "LN":
            exact = exact.replace(rf" ?\p{{{kind}}}+", f" ?[\\p{{{kind}}}--[{new}]]+")
        self.exact_pattern = regex.compile(exact, regex.V1)
        bytes_of = {c: b for b, c in enumerate(byte_letters())}
        self.pieces = [b""] * (max(self.vocab.values()) + 1)
        for token, i in self.vocab.items():
            self.pieces[i] = bytes(bytes_of[c] for c in token)
        self.memory = {}

    def normal(self, text: str) -> str:
        return text

    def words(self, text: str) -> list[str]:
        """Words in order; together they are the whole text."""
        return (self.pattern if text.isascii() or self.added.isdisjoint(text) else self.exact_pattern).findall(text)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: their bytes in a row."""
        return b"".join(map(self.pieces.__getitem__, ids.tolist())).decode("utf-8", "replace")
