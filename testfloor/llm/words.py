"""Words of whole texts, found and hashed block by block with numpy inside tasks.

All separators of a word are ASCII, so words are found on the UTF-8 bytes. A
block is a run of documents of an Arrow batch with about ``BLOCK_BYTES`` of text
(one document at least), which bounds the working memory of a task.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

BLOCK_BYTES = 1 << 20
_U = np.uint64


def per_worker(name: str, make: Callable[[], object]) -> object:
    """A value made once per Python worker (functions sent by value have no lasting globals)."""
    kept = sys.modules.setdefault("_testfloor_llm_worker", types.ModuleType("_testfloor_llm_worker"))
    if not hasattr(kept, name):
        setattr(kept, name, make())
    return getattr(kept, name)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; NULL is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    edges = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), edges


def blocks(edges: np.ndarray, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of about ``block_bytes`` each."""
    a, rows = 0, len(edges) - 1
    while a < rows:
        b = int(np.searchsorted(edges, edges[a] + block_bytes, "right")) - 1
        b = min(max(b, a + 1), rows)
        yield a, b
        a = b


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def chain(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A hash of the ordered pairs (x, y). It is not linear, so sums of pairs cannot cancel."""
    return mix(mix(x) * _U(0x9E3779B97F4A7C15) + y)


# Words of up to this many bytes are hashed eight bytes at a time over all words of a block, longer ones one by one.
_SHORT_WORD = 64
_LOW_BYTES = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=_U)


@dataclass
class Words:
    """The words of a block: byte spans, 64-bit hashes, and the first word of each row."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """64-bit hashes of the words' bytes."""
        sizes = self.ends - self.starts
        out = mix(sizes.astype(_U))
        padded = np.zeros(len(self.data) + 8, np.uint8)
        padded[: len(self.data)] = self.data
        eight = np.ndarray(len(self.data) + 1, "<u8", padded, strides=(1,))
        left = np.flatnonzero(sizes <= _SHORT_WORD)
        for at in range(0, _SHORT_WORD, 8):
            left = left[sizes[left] > at]
            if not len(left):
                break
            value = eight[self.starts[left] + at] & _LOW_BYTES[np.minimum(sizes[left] - at, 8)]
            out[left] = chain(out[left], value)
        for i in np.flatnonzero(sizes > _SHORT_WORD).tolist():
            out[i] = xxhash.xxh3_64_intdigest(self.data[self.starts[i] : self.ends[i]])
        return out


WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased; other bytes as they are."""
    return data | (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)


def find_words(data: np.ndarray, edges: np.ndarray, separator: np.ndarray = WHITE) -> Words:
    """Words of the rows whose bytes lie between consecutive ``edges`` of ``data``."""
    data, edges = data[edges[0] : edges[-1]], edges - edges[0]
    inside = ~separator[data]
    opens, closes = inside.copy(), inside.copy()
    if len(data):
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        cut = edges[1:-1]
        cut = cut[(cut > 0) & (cut < len(data))]
        opens[cut] = inside[cut]
        closes[cut - 1] = inside[cut - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return Words(data, starts, ends, np.searchsorted(starts, edges))


def rolling(hashes: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hashes of all runs of ``k`` consecutive values (not minding row ends), put together from runs of powers of two."""
    n = max(0, len(hashes) - k + 1)
    power, size, done = chain(np.full(len(hashes), seed + 1, _U), hashes), 1, 0
    out = np.full(n, k, _U)
    while n and done < k:
        if k & size:
            out = chain(out, power[done : done + n])
            done += size
        if done < k:
            power, size = chain(power[: len(power) - size], power[size:]), 2 * size
    return out
