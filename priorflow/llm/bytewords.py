"""Words of whole texts as numpy arrays, straight from Arrow's UTF-8 buffers.

A word is a longest run of ASCII letters, digits and non-ASCII characters, with A-Z
lower-cased. A word's hash is a polynomial of its bytes, got for all words of a batch at
once from one running sum: ``(S[end] - S[start]) * P**-start`` modulo 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}

#: Byte -> lower-cased byte of a word, or 0 between words.
WORD_BYTES = np.array(
    [c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 0 for c in range(256)], np.uint8
)


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(steps)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins (one more entry than texts)."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(texts: pa.ChunkedArray | pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) with up to ``limit`` bytes of text together, or one longer text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets = buffer(texts)
    i, n = 0, len(texts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, texts.slice(i, j - i)
        i = j


def gathered(batches: Iterator[pa.RecordBatch], column: int, limit: int) -> Iterator[pa.Table]:
    """Batches put together until their texts have ``limit`` bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(column).nbytes
        if size >= limit:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


class Words:
    """Word starts, ends (byte offsets), hashes, and each text's range of words."""

    def __init__(self, texts: pa.Array, classes: np.ndarray = WORD_BYTES):
        self.raw, self.offsets = buffer(texts)
        self.bytes = classes[self.raw]
        inside = self.bytes != 0
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edges = self.offsets[(self.offsets > 0) & (self.offsets < len(inside))]
        begins[edges] = inside[edges]
        ends[edges - 1] = inside[edges - 1]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, self.offsets)

    def running(self, values: np.ndarray | None = None) -> np.ndarray:
        values = self.bytes if values is None else values
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * _powers(_P, len(values)), out=total[1:])
        return total

    def spans(self, total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges; ranges with equal bytes have equal hashes."""
        return mix((total[ends] - total[starts]) * _powers(_P_INV, len(total))[starts])

    def hashes(self) -> np.ndarray:
        return self.spans(self.running(), self.starts, self.ends)


def digests(words: np.ndarray, first: np.ndarray) -> list[bytes]:
    """16 bytes for each text's sequence of word hashes."""
    n, counts = len(first) - 1, np.diff(first)
    place = np.arange(len(words)) - np.repeat(first[:-1], counts)
    out = np.zeros((n, 2), np.uint64)
    for k, base in enumerate((0xD6E8FEB86659FD93, 0xA0761D6478BD642F)):
        total = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(mix(words + np.uint64(k)) * _powers(base, int(counts.max(initial=1)))[place], out=total[1:])
        out[:, k] = mix(total[first[1:]] - total[first[:-1]] + counts.astype(np.uint64))
    return [row.tobytes() for row in out]
