"""Hierarchical multi-length packing of documents into training sequences.

Every document is tokenised (its ids, then id 0).  Full windows of the longest tier
are cut off at once; what remains is routed to the smallest tier (1024, 512 or
256 ids) that holds it.  Each tier is packed in turn, the longest first: a window
takes a remainder of its tier, and its gap is filled with the largest remainders of shorter
tiers that fit, the last of them cut to fit exactly.  So windows are full, and a tier's
length is a power of two.  What is left at a task's end, less than one window a
tier, is cut into windows of powers of two, so nothing is padded.

Finished windows of all tiers are dealt to step groups of at most STEP_TOKENS ids: the longest
and dearest window first (its attention cost is the sum of the squared lengths of its pieces), each to the
group that has the fewest ids and then the least cost.  Windows that fill no group wait for the next
deal; a task's last groups share what is left evenly.

A task packs the rows it reads; there is no shuffle, and at most BUFFER remainders are held.
A sequence's number is its task's number and a count, as in monotonically_increasing_id.

Edge cases.  A null text counts as empty (its only id is 0).  Null identifiers and
repeated rows are packed like any row; an empty table gives no piece; further columns
are not read.  A very long text is cut into full windows as soon as it is encoded.
A special token's string in a text gives that token's id, as the library does by default;
``special=False`` takes it as ordinary text.
"""

from __future__ import annotations

import heapq
import os
import zlib
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import common
from plumbline.llm.chunks import ChunkPool, flattened

TIERS = (1024, 512, 256)
BUFFER = 2_048
STEP_TOKENS = 64 * 1024
#: Chunks that are encoded as one text.
LINES = 2_048
#: Bytes of chunks that a process remembers within a task: half the words of a task of 16 MB are new to it.
POOL_BYTES = 192 << 20

_ready: dict[tuple[str, bool], ChunkPool] = {}


def token_pool(path: str, special: bool = True) -> ChunkPool:
    """The tokenizer file's encoder, once a worker process.  ``special``: special tokens' strings in a text give their ids."""
    if (path, special) not in _ready:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = not special
        whole = [x.content for x in t.get_added_tokens_decoder().values()]
        _ready[path, special] = ChunkPool(lambda texts: [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)], _joined_encoder(t), POOL_BYTES, whole)
    return _ready[path, special]


def _joined_encoder(t) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """Encode many chunks as few texts, a line each: a lone newline between two of them is a token of its own that ends a chunk's ids."""
    line = t.encode("\n", add_special_tokens=False).ids
    if len(line) != 1:
        return lambda chunks: flattened([e.ids for e in t.encode_batch_fast(chunks, add_special_tokens=False)])

    def encode(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        bodies = [c[1:] if c[0] == "\n" else c for c in chunks]
        texts = ["\n".join(bodies[k : k + LINES]) + "\n" for k in range(0, len(bodies), LINES)]
        ids = np.concatenate([np.array(e.ids, np.int32) for e in t.encode_batch_fast(texts, add_special_tokens=False)])
        ends = np.flatnonzero(ids == line[0])
        if len(ends) != len(chunks):  # a chunk that holds the newline's token: encode each for itself
            return flattened([e.ids for e in t.encode_batch_fast(chunks, add_special_tokens=False)])
        own = np.fromiter((c[0] == "\n" for c in chunks), bool, len(chunks))
        sizes = np.diff(ends, prepend=-1) - 1 + own
        # the newline that ended the line before stands for the chunk's own; others go
        keep = np.ones(len(ids) + 1, bool)
        keep[ends + 1] = False
        starts = np.concatenate(([0], ends[:-1] + 1))
        ids = np.concatenate([np.array(line, np.int32), ids])  # now a newline precedes every chunk, at ``starts``
        keep[0] = False
        keep[starts[own]] = True
        return ids[keep], sizes

    return encode


class Packer:
    """Packs pieces (document, start, ids) given one at a time; ``emit`` gets (tier, step group, pieces) of every finished window."""

    def __init__(self, emit: Callable[[int, int, list], None], tiers: tuple[int, ...] = TIERS, buffer: int = BUFFER):
        self.emit, self.tiers, self.buffer = emit, tiers, buffer
        self.held: dict[int, list] = {t: [] for t in tiers}  # (size, order, document, start, ids), sorted
        self.count = self.order = self.steps = self.tokens = 0
        self.done: list[tuple[int, list]] = []

    def add(self, doc, ids: np.ndarray) -> None:
        top, at = self.tiers[0], 0
        while len(ids) - at >= top:
            self._finish(top, [(doc, at, ids[at : at + top])])
            at += top
        if at < len(ids):
            self._route(doc, at, ids[at:])
            if self.count >= self.buffer:
                self._pack()

    def _route(self, doc, start: int, ids: np.ndarray) -> None:
        tier = min(t for t in self.tiers if t >= len(ids))
        self.order += 1
        self.count += 1
        insort(self.held[tier], (len(ids), self.order, doc, start, ids), key=lambda x: x[:2])

    def _fit(self, tiers: list[int], gap: int):
        """The largest remainder of ``tiers`` that fits, or the smallest of all to be cut, or None."""
        for t in tiers:
            k = bisect_right(self.held[t], gap, key=lambda x: x[0])
            if k:
                self.count -= 1
                return self.held[t].pop(k - 1)
        for t in reversed(tiers):
            if self.held[t]:
                self.count -= 1
                return self.held[t].pop(0)
        return None

    def _pack(self) -> None:
        """Pack all that is held; what does not fill a window stays."""
        for k, tier in enumerate(self.tiers):
            while self.held[tier]:
                self.count -= 1
                size, _, doc, start, ids = self.held[tier].pop()
                window, room = [(doc, start, ids)], tier - size
                while room:
                    piece = self._fit(list(self.tiers[k:]), room)
                    if piece is None:
                        break
                    size, _, doc, start, ids = piece
                    if size > room:
                        self._route(doc, start + room, ids[room:])
                        ids = ids[:room]
                    window.append((doc, start, ids))
                    room -= len(ids)
                if room:  # nothing else is left in this tier or below
                    for doc, start, ids in window:
                        self._route(doc, start, ids)
                    break
                self._finish(tier, window)
        self._deal()

    def _finish(self, tier: int, window: list) -> None:
        self.done.append((tier, window))
        self.tokens += tier
        if len(self.done) >= 4 * self.buffer:
            self._deal()

    def _deal(self, last: bool = False) -> None:
        """Deal finished windows to step groups; what fills no group stays, but for the ``last`` time."""
        groups = -(-self.tokens // STEP_TOKENS) if last else self.tokens // STEP_TOKENS
        if not groups:
            return
        # as lengths are powers of two, longest first, a group that has room takes a window without passing STEP_TOKENS
        ready = sorted(self.done, key=lambda w: (-w[0], -sum(len(p[2]) ** 2 for p in w[1])))
        least = [(0, 0, k) for k in range(groups)]
        self.done = []
        for tier, window in ready:
            tokens, cost, k = least[0]
            if tokens + tier > STEP_TOKENS:
                self.done.append((tier, window))
                continue
            heapq.heapreplace(least, (tokens + tier, cost + sum(len(p[2]) ** 2 for p in window), k))
            self.emit(tier, self.steps + k, window)
            self.tokens -= tier
        self.steps += groups

    def close(self) -> None:
        """Pack the rest; the last ids go to windows of powers of two."""
        self._pack()
        rest = [x[2:] for t in self.tiers for x in self.held[t]]
        total, k, cut = sum(len(p[2]) for p in rest), 0, 0
        while total:
            size = 1 << (total.bit_length() - 1)
            size, room, window = min(size, self.tiers[0]), min(size, self.tiers[0]), []
            while room:
                doc, start, ids = rest[k]
                take = min(room, len(ids) - cut)
                window.append((doc, start + cut, ids[cut : cut + take]))
                room, cut = room - take, cut + take
                if cut == len(ids):
                    k, cut = k + 1, 0
            total -= size
            self._finish(size, window)
        while self.done:
            self._deal(last=True)
        self.held = {t: [] for t in self.tiers}
        self.count = 0


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, special: bool = True) -> DataFrame:
    """Per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length, step_group and, if asked for, ids."""
    common.need(docs, [id_col, text_col])
    id_type = dict(docs.dtypes)[id_col]
    schema = f"id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long, step_group long" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = token_pool(tokenizer_path, special)
        base = TaskContext.get().partitionId() << 33
        out: list[list] = []
        made = 0

        def emit(tier: int, step: int, window: list) -> None:
            nonlocal made
            at = 0
            for (doc, tokens), start, ids in window:
                row = [doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), tokens, base + made, at, tier, base + step]
                out.append([*row, ids.tolist()] if with_ids else row)
                at += len(ids)
            made += 1

        def table() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            arrays = [pa.array(cols[0], id_arrow), *(pa.array(c, pa.int64()) for c in cols[1:9])]
            if with_ids:
                arrays.append(pa.array(cols[9], pa.list_(pa.int32())))
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length", "step_group"] + ["ids"] * with_ids)

        packer = Packer(emit)
        id_arrow = pa.int64()
        zero = np.zeros(1, np.int32)
        for b in batches:
            id_arrow = b.column(0).type
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                for doc, ids in zip(part.column(0).to_pylist(), pool.encode_batch([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    ids = np.concatenate([ids, zero])
                    packer.add((doc, len(ids)), ids)
                if len(out) > 5_000:
                    yield table()
        packer.close()
        pool.rest()
        if out:
            yield table()

    narrow = docs.select(common.named(id_col).alias("id"), common.named(text_col).alias("text"))
    return narrow.mapInArrow(common.trimmed(run), schema).withColumnRenamed("id", id_col)
