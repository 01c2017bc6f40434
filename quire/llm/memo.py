"""Chunks of texts and a bounded memory of what a tokenizer makes of each distinct chunk.

Words repeat far more often than documents do, and a vocabulary file's merges never cross certain borders in a text.
The operators that tokenize cut a text at such borders, look each chunk up and run the tokenizer on new ones only.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import chain

import numpy as np

#: A worker forgets all chunks when it has more than this many.
MEMO_CHUNKS = 500_000
#: Chunks of white space and the word after it. In each of the vocabularies here no token goes from a character
#: that isn't white space to one that is.
CHUNK = re.compile(r"\s*\S+|\s+")
#: Python's white space that Unicode's property White_Space doesn't have: such a text is one chunk.
ODD = re.compile("[\x1c-\x1f]")


def chunks(text: str) -> list[str]:
    return CHUNK.findall(text) if not ODD.search(text) else [text]


class IdMemo:
    """Ids of chunks, in one growing array. encode(new chunks) -> the chunks in an order of its own, all their ids one
    after the other, and how many each chunk has."""

    def __init__(self, encode: Callable[[list[str]], tuple[list[str], np.ndarray, np.ndarray]], limit: int = MEMO_CHUNKS):
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.starts, self.ids, self.n_ids = np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.int32), 0

    def _add(self, new: list[str]) -> None:
        keys, flat, lengths = self.encode(new)
        n, end = len(self.at), self.n_ids + len(flat)
        if n + len(keys) + 1 > len(self.starts):
            self.starts = np.resize(self.starts, 2 * (n + len(keys) + 1))
        if end > len(self.ids):
            self.ids = np.resize(self.ids, 2 * end)
        self.ids[self.n_ids : end] = flat
        self.starts[n + 1 : n + 1 + len(keys)] = self.n_ids + np.cumsum(lengths)
        self.n_ids = end
        self.at.update(zip(keys, range(n, n + len(keys))))

    def rows(self, lists: list[list[str]]) -> np.ndarray:
        """The place of each chunk of all lists, one after the other; valid until the next call."""
        new = set().union(*lists) - self.at.keys()
        if new:
            if len(self.at) > self.limit:
                self.clear()
                new = set().union(*lists)
            self._add(list(new))
        return np.fromiter(map(self.at.__getitem__, chain.from_iterable(lists)), np.int64)

    def ids_at(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the chunks at these places, and how many each has."""
        start = self.starts[rows]
        length = self.starts[rows + 1] - start
        take = np.repeat(start - (np.cumsum(length) - length), length)
        take += np.arange(len(take))
        return self.ids[take], length

    def ids_of(self, lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all the lists of chunks, one after the other, and how many each list has."""
        ids, length = self.ids_at(self.rows(lists))
        return ids, sums(length, np.fromiter(map(len, lists), np.int64, len(lists)))


def sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of values with these lengths, some of which may be 0."""
    ends = np.concatenate([[0], np.cumsum(values)])[np.concatenate([[0], np.cumsum(lengths)])]
    return ends[1:] - ends[:-1]
