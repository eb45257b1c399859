"""Words of whole texts as 64-bit hashes, for an Arrow batch at a time.

Two words are told apart by a 64-bit polynomial hash of their bytes: among m
different words about m^2 / 3.7e19 pairs share one (10 million words: 3e-6).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import by_value

by_value(__name__)

BASE, INVERSE = 0x5851F42D4C957F2D, pow(0x5851F42D4C957F2D, -1, 1 << 64)
CHUNK = 1 << 20  # bytes of text that are looked at together; one text may be longer


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(29))


def powers(x: int, n: int, kept: dict[int, np.ndarray] = {}) -> np.ndarray:  # noqa: B006
    """x to the power 0 to n; kept for later calls up to ``CHUNK``."""
    if x not in kept or len(kept[x]) <= n:
        every = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, min(2 * n, CHUNK)), x, np.uint64)]))
        if n > CHUNK:
            return every[:n + 1]
        kept[x] = every
    return kept[x][:n + 1]


def stretches(x: np.ndarray):
    """A function (from, to) that hashes stretches x[from:to] by their content."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(x * powers(BASE, len(x))[:-1])])
    inverse = powers(INVERSE, len(x))
    return lambda a, b: mixed((total[b] - total[a]) * inverse[a])


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.empty(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def pieces(batches, column: str):
    """The batches in slices of about ``CHUNK`` bytes of ``column``, one row at least."""
    for b in batches:
        sizes = np.diff(raw(b.column(column))[1])
        part = np.cumsum(sizes) // CHUNK
        for p in np.unique(part):
            lo, hi = np.searchsorted(part, p), np.searchsorted(part, p, side="right")
            yield b.slice(lo, hi - lo)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of all texts, in order; the first word of each text and the end)."""
    data, offsets = raw(texts)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True  # a text's first byte, and the end
    ahead = np.concatenate([[False], inside])  # the byte before
    after = np.concatenate([inside, [False]])
    starts = np.flatnonzero(after & (edge | ~ahead))
    ends = np.flatnonzero(ahead & (edge | ~after))
    table = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return stretches(table[data])(starts, ends), np.searchsorted(starts, offsets)
