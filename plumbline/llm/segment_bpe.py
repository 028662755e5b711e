"""Byte-level BPE by a segment tree over byte positions.

Leaf ``i`` holds the rank of the pair that begins at live position ``i``, together
with ``i``; every inner node holds the least of its two children.  So the root names
the leftmost of the lowest-ranked pairs.  A merge changes three leaves at most (the
merged position, its live left neighbour, the vanished right neighbour), each a
logarithmic update.  Many short pieces are merged at once, a row each, in numpy;
long ones one at a time.

The published library looks a whole piece up first; so does this.  Ranks must hold all 256 bytes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import common
from plumbline.llm.chunks import ChunkPool

_NONE = 1 << 40  # rank of a pair that cannot merge
_ROW_WIDTH = 64  # pieces up to so many bytes are merged many at once


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class SegmentBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.tokens = {v: k for k, v in ranks.items()}
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.shift = max(self.tokens).bit_length()
        pairs = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs[a << self.shift | b] = rank
        self.pairs = pairs
        # open addressing: the table of all pairs that merge
        self.bits = (len(pairs) * 2).bit_length()
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, _NONE, np.int64)
        left = np.array(sorted(pairs), np.int64)
        rank = np.array([pairs[int(x)] for x in left], np.int64)
        slot = self._slot(left)
        self.probes = 0
        while len(left):
            self.probes += 1
            free = self.keys[slot] == -1
            first = np.unique(slot[free], return_index=True)[1]
            take = np.flatnonzero(free)[first]
            self.keys[slot[take]], self.values[slot[take]] = left[take], rank[take]
            rest = np.ones(len(left), bool)
            rest[take] = False
            left, rank, slot = left[rest], rank[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids; _NONE if it does not merge or an id is negative."""
        key = np.where((a >= 0) & (b >= 0), a << self.shift | b, -2)
        slot = self._slot(key)
        out = np.full(key.shape, _NONE, np.int64)
        todo = np.arange(len(key))
        for _ in range(self.probes + 1):
            held = self.keys[slot[todo]]
            hit = held == key[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (held != -1)]
            if not len(todo):
                break
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
        return out

    def merge_rows(self, pieces: list[bytes], width: int) -> list[list[int]]:
        """Merge many pieces of at most ``width`` (a power of two) bytes."""
        n = len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, n)
        ids = np.full((n, width + 2), -1, np.int64)  # ids[:, i + 1] is position i; the borders stay -1
        flat = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        mask = np.arange(width)[None, :] < sizes[:, None]
        ids[:, 1:-1][mask] = flat
        place = np.arange(width)
        tree = np.full((n, 2 * width), _NONE * width, np.int64)
        tree[:, width:] = self._ranks(ids[:, 1:-1].ravel(), ids[:, 2:].ravel()).reshape(n, width) * width + place
        for k in range(width - 1, 0, -1):
            tree[:, k] = np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1])
        after = np.tile(np.arange(1, width + 3), (n, 1))
        before = np.tile(np.arange(-1, width + 1), (n, 1))
        rows = np.arange(n)
        while len(rows := rows[tree[rows, 1] < _NONE * width]):
            top = tree[rows, 1]
            at = top % width + 1
            gone = after[rows, at]
            beyond = after[rows, gone]
            ids[rows, at] = top // width
            ids[rows, gone] = -1
            after[rows, at] = beyond
            before[rows, np.minimum(beyond, width + 1)] = at
            prior = before[rows, at]
            self._point(tree, rows, gone - 1, np.full(len(rows), _NONE), width)
            self._point(tree, rows, at - 1, self._ranks(ids[rows, at], ids[rows, np.minimum(beyond, width + 1)]), width)
            has = prior >= 1
            r, p = rows[has], prior[has]
            self._point(tree, r, p - 1, self._ranks(ids[r, p], ids[r, at[has]]), width)
        live = ids >= 0
        flat, ends = ids[live].tolist(), np.cumsum(live.sum(axis=1)).tolist()
        return [flat[s:e] for s, e in zip([0, *ends], ends, strict=False)]

    @staticmethod
    def _point(tree: np.ndarray, rows: np.ndarray, at: np.ndarray, rank: np.ndarray, width: int) -> None:
        node = at + width
        tree[rows, node] = np.where(rank < _NONE, rank * width + at, _NONE * width)
        node = node >> 1
        for _ in range(width.bit_length() - 1):
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            node = node >> 1

    def merge_long(self, piece: bytes) -> list[int]:
        """Merge one piece of any length: the same tree in Python lists."""
        n = len(piece)
        width = 1 << max(1, (n - 1).bit_length())
        none, get, shift = _NONE * width, self.pairs.get, self.shift
        ids = self.byte[np.frombuffer(piece, np.uint8)]
        first = self._ranks(ids[:-1], ids[1:])
        grid = np.full(2 * width, none, np.int64)
        grid[width : width + n - 1] = np.where(first < _NONE, first * width + np.arange(n - 1), none)
        level = width
        while level > 1:
            grid[level // 2 : level] = grid[level : 2 * level].reshape(-1, 2).min(axis=1)
            level //= 2
        tree, ids = grid.tolist(), ids.tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n))

        def point(at: int, key: int) -> None:
            node = at + width
            tree[node] = key
            while node > 1:
                node >>= 1
                a, b = tree[2 * node], tree[2 * node + 1]
                least = a if a < b else b
                if tree[node] == least:
                    break
                tree[node] = least

        while (top := tree[1]) < none:
            at = top % width
            gone = after[at]
            beyond = after[gone]
            ids[at], ids[gone], after[at] = top // width, -1, beyond
            point(gone, none)
            rank = none
            if beyond < n:
                before[beyond] = at
                rank = get(ids[at] << shift | ids[beyond])
                rank = none if rank is None else rank * width + at
            point(at, rank)
            prior = before[at]
            if prior >= 0:
                rank = get(ids[prior] << shift | ids[at])
                point(prior, none if rank is None else rank * width + prior)
        return [x for x in ids if x >= 0]

    def encode_pieces(self, pieces: list[bytes]) -> dict[bytes, list[int]]:
        """The ids of every distinct piece."""
        out: dict[bytes, list[int]] = {}
        by_width: dict[int, list[bytes]] = {}
        for p in dict.fromkeys(pieces):
            rank = self.ranks.get(p)
            if rank is not None:
                out[p] = [rank]
            elif len(p) > _ROW_WIDTH:
                out[p] = self.merge_long(p)
            else:
                by_width.setdefault(1 << max(2, (len(p) - 1).bit_length()), []).append(p)
        for width, own in by_width.items():
            for k in range(0, len(own), 8192):
                out |= zip(own[k : k + 8192], self.merge_rows(own[k : k + 8192], width), strict=True)
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of every text: each match of the pattern is encoded for itself."""
        found = [[m.encode("utf-8", "surrogatepass") for m in self.find(t)] for t in texts]
        table = self.encode_pieces([p for ps in found for p in ps])
        return [[i for p in ps for i in table[p]] for ps in found]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_ready: dict[tuple[str, str], tuple[SegmentBPE, ChunkPool]] = {}


def pooled(path: str, pattern: str) -> tuple[SegmentBPE, ChunkPool]:
    """One encoder and pool a worker process."""
    if (path, pattern) not in _ready:
        bpe = SegmentBPE(read_ranks(path), pattern)
        _ready[path, pattern] = bpe, ChunkPool(bpe.encode)
    return _ready[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode and decode every whole text: id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids.

    Null counts as empty (no token); repeated rows and null identifiers stay as they are; an empty table gives an empty result; further columns are not read. Very long texts are encoded as a whole.
    """
    common.need(docs, [id_col, text_col])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, pool = pooled(path, pattern)
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                all_ids = pool.encode_batch([t or "" for t in part.column(1).to_pylist()])
                lists = [x.tolist() for x in all_ids]
                arrays = [
                    part.column(0),
                    pa.array([len(x) for x in lists], pa.int64()),
                    pa.array([hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in lists]),
                    pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in lists]),
                ]
                names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    arrays.append(pa.array(lists, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)
        pool.rest()

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {dict(docs.dtypes)[id_col]}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return narrow.mapInArrow(run, schema).withColumnRenamed("id", id_col)
