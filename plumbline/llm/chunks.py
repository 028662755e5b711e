"""Whitespace chunks of a text and a bounded pool of what each chunk encodes to.

A single space or newline between two non-space characters always begins a new
match of the public pattern (PATTERN), whatever stands around it.  So a text can
be cut there and every distinct chunk encoded once a process.  Texts with other
white space (runs of it, tabs, no-break spaces ...) are encoded as a whole.
"""

from __future__ import annotations

import re
from collections import defaultdict, deque
from collections.abc import Callable
from itertools import chain, compress, count, islice

import numpy as np

#: Bytes of distinct chunks that a process remembers, and that it keeps from one task to the next; beyond that those go that the fewest texts had.
POOL_BYTES, KEPT_BYTES = 96 << 20, 48 << 20
#: What a chunk takes besides its letters and ids: a string, a number, a slot of the index.
CHUNK_BYTES = 200
#: In the place of a chunk's size: its texts must be encoded as a whole.
_ODD = -1
_INNER_SPACE = re.compile(r".\s", re.S).search
_OTHER_SPACE = re.compile(r"[^\S\n ]").search


def flattened(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all lists in a row, and the lists' sizes."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int32, int(sizes.sum())), sizes


def _taken(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` from ``starts`` on, in a row."""
    ends = np.cumsum(sizes)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, np.int32)
    return flat[np.arange(ends[-1]) + np.repeat(starts - (ends - sizes), sizes)]


class ChunkPool:
    """Encodes texts, once a distinct chunk.

    ``encode`` takes whole texts and gives a list of ids of each; ``encode_chunks`` takes chunks (a word after a space, a
    newline or nothing) and gives the ids in a row with the sizes.  A text that holds one of the strings ``whole`` is not cut.
    """

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], encode_chunks: Callable[[list[str]], tuple[np.ndarray, np.ndarray]] | None = None, limit: int = POOL_BYTES, whole: list[str] | None = None):
        self.encode, self.limit = encode, limit
        self.whole = re.compile("|".join(map(re.escape, whole))).search if whole else None
        self.encode_chunks = encode_chunks or (lambda chunks: flattened(encode(chunks)))
        self._reset()

    def _reset(self) -> None:
        #: Chunks by the number that each gets when it is first looked up; "" stands for none.
        self.index: defaultdict[str, int] = defaultdict(count().__next__)
        self.count = self.index[""] + 1
        self.sizes = np.full(1 << 12, _ODD)
        self.starts = np.zeros(1 << 12, np.int64)
        self.hits = np.zeros(1 << 12, np.int64)
        self.flat = np.zeros(1 << 14, np.int32)
        self.used = 0
        self.letters = 0

    @property
    def held(self) -> int:
        """Bytes held, about."""
        return self.letters + CHUNK_BYTES * self.count + 4 * self.used

    def rest(self) -> None:
        """At the end of a task: let go of what few texts had in a large pool."""
        if self.held > KEPT_BYTES:
            self._shrink(KEPT_BYTES)

    def _shrink(self, to: int) -> None:
        """Keep the chunks that the most texts had, of more than one, in at most ``to`` bytes."""
        keys, hits, sizes, starts, flat = list(self.index), self.hits[: self.count], self.sizes[: self.count], self.starts[: self.count], self.flat
        order = np.argsort(-hits, kind="stable")
        each = CHUNK_BYTES + 4 * sizes + np.fromiter(map(len, keys), np.int64, len(keys))
        stay = np.sort(order[(np.cumsum(each[order]) <= to) & (hits[order] > 1) & (sizes[order] != _ODD)])
        hits = (hits[stay] + 1) // 2  # what is no longer met goes in time
        self._reset()
        known = [keys[k] for k in stay.tolist()]
        first = self.count
        deque(map(self.index.__getitem__, known), 0)
        self._add(known, _taken(flat, starts[stay], sizes[stay]), sizes[stay])
        self.hits[first : self.count] = hits

    def _add(self, keys: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Enter what the last chunks of the index encode to; _ODD is the size of those that need their whole text."""
        total, n = len(ids), len(keys)
        while self.count + n > len(self.sizes):
            self.sizes, self.starts, self.hits = (np.concatenate([c, c * 0]) for c in (self.sizes, self.starts, self.hits))
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, self.flat * 0])
        taken = np.where(sizes == _ODD, 0, sizes)
        self.sizes[self.count : self.count + n] = sizes
        self.starts[self.count : self.count + n] = self.used + np.cumsum(taken) - taken
        self.flat[self.used : self.used + total] = ids
        self.count += n
        self.used += total
        self.letters += sum(map(len, keys))

    def _learn(self, fresh: list[str]) -> None:
        sizes = np.full(len(fresh), _ODD)
        # without other white space, a chunk has none but a newline at its start
        if _OTHER_SPACE("".join(fresh)):
            good = np.array([not self._odd(x[1:] if x[:1] == "\0" else x) for x in fresh], bool)
        else:
            good = np.ones(len(fresh), bool)
        ids = np.zeros(0, np.int32)
        if good.any():
            ids, sizes[good] = self.encode_chunks([x[1:] if x[0] == "\0" else x if x[0] == "\n" else " " + x for x in compress(fresh, good.tolist())])
        self._add(fresh, ids, sizes)

    @staticmethod
    def _odd(part: str) -> bool:
        """Whether a chunk holds white space besides one leading newline."""
        return _INNER_SPACE(part) is not None or part[0] != "\n" and part[0].isspace()

    def _parts(self, text: str) -> list[str] | None:
        """Keys of the text's chunks, or None if the text must be encoded as a whole.  A key without newline stands for a chunk with one leading space, except at the text's start: there a NUL marks it."""
        if self.whole and self.whole(text):
            return None
        if "\n\n\n" in text or "\n\n " in text or text.endswith("\n\n") or "\0" in text:
            return None
        parts = text.replace("\n", " \n").split(" ")
        if parts[0] == "":
            if len(parts) == 1:
                return []
            if parts[1][:1] != "\n":
                return None
            del parts[0]  # the text begins with a newline
        else:
            parts[0] = "\0" + parts[0]
        return parts

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of every text."""
        if self.held > self.limit:
            self._shrink(self.limit // 2)
        number = self.index.__getitem__
        cut = [None if p is None else np.fromiter(map(number, p), np.int64, len(p)) for p in map(self._parts, texts)]
        if new := len(self.index) - self.count:
            self._learn(list(islice(reversed(self.index), new))[::-1])
        out: list[np.ndarray] = []
        whole: list[int] = []
        for k, at in enumerate(cut):
            sizes = None if at is None else self.sizes[at]
            if sizes is None or _ODD in sizes:
                whole.append(k)
                out.append(np.zeros(0, np.int32))
            else:
                self.hits[at] += 1
                out.append(_taken(self.flat, self.starts[at], sizes))
        if whole:
            for k, ids in zip(whole, self.encode([texts[k] for k in whole]), strict=True):
                out[k] = np.array(ids, np.int32)
        return out
