"""Local (per text) arithmetic of the suffix-array operator: rolling hashes and winnowed anchors.

Nothing here knows Spark.  A text of ``n`` bytes has ``n - T + 1`` windows of
``T`` bytes.  Each window is *owned* by one anchor: the leftmost position, among
the ``T - K + 1`` K-grams inside the window, whose K-gram hash is smallest.
Equal windows own their anchor at equal distance, so two equal windows always
meet under one K-gram hash, and the windows owned by one anchor are contiguous.
"""

from __future__ import annotations

import numpy as np

T = 200  # bytes of a repeated window
K = 64  # bytes of an anchor's seed

_U = np.uint64
_rng = np.random.default_rng(20240607)
_TABLE = _rng.integers(1, 2**63, size=(2, 256), dtype=np.uint64) | _U(1)
_BASE = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
_powers: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads low-entropy sums."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n - 1).bit_length())
    got = _powers.get((which, size))
    if got is None:
        b = _BASE[which]
        up = np.full(size, _U(b))
        up[0] = 1
        down = np.full(size, _U(pow(b, -1, 2**64)))
        down[0] = 1
        got = np.cumprod(up), np.cumprod(down)
        if size <= 1 << 20:
            _powers[(which, size)] = got
    return got


class Rolling:
    """Hashes of any substring of one byte string, by prefix sums modulo 2**64."""

    def __init__(self, data: np.ndarray, which: int = 0):
        n = len(data)
        up, self.down = _power(which, n + 1)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE[which][data] * up[:n], out=self.prefix[1:])

    def at(self, starts: np.ndarray, lengths) -> np.ndarray:
        return mix((self.prefix[starts + lengths] - self.prefix[starts]) * self.down[starts])

    def every(self, length: int) -> np.ndarray:
        m = len(self.prefix) - length
        return mix((self.prefix[length:] - self.prefix[:-length]) * self.down[:m])


def leftmost_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost minimum of each run of ``width`` values, by block-wise running minima."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, _U(2**64 - 1))
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = np.arange(n - width + 1)
    lowest = np.minimum(right[starts], left[starts + width - 1])
    # the leftmost position that holds the minimum: the next place, from the start on, of that value
    order = np.arange(len(padded)).reshape(blocks, width)
    held = grid == right.reshape(blocks, width)  # suffix minimum is met here
    first = np.where(held, order, np.iinfo(np.int64).max)
    first = np.minimum.accumulate(first[:, ::-1], axis=1)[:, ::-1].ravel()  # next suffix-minimum holder
    # a new prefix minimum begins where the running minimum drops
    drops = np.ones((blocks, width), bool)
    lg = left.reshape(blocks, width)
    drops[:, 1:] = lg[:, 1:] < lg[:, :-1]
    last = np.maximum.accumulate(np.where(drops, order, 0), axis=1).ravel()
    in_right = right[starts] == lowest
    return np.where(in_right, first[starts], last[starts + width - 1])


def anchors(data: bytes) -> tuple[np.ndarray, ...] | None:
    """(seed, span, lo, hi): per anchor its seed hash, the hash of all that its windows cover, and its windows' first and last start."""
    raw = np.frombuffer(data, np.uint8)
    if len(raw) < T:
        return None
    one, two = Rolling(raw, 0), Rolling(raw, 1)
    at = leftmost_minimum(one.every(K), T - K + 1)
    edge = np.flatnonzero(np.diff(at)) + 1
    lo = np.concatenate(([0], edge))
    hi = np.concatenate((edge - 1, [len(at) - 1]))
    pos = at[lo]
    seed = two.at(pos, K)
    span = mix(two.at(lo, hi - lo + T) ^ mix(((pos - lo) << 20 | (hi - lo)).astype(np.uint64))) ^ one.at(lo, hi - lo + T)
    return seed, span, lo, hi
