"""Words of many texts at once, as arrays over the bytes of an Arrow string column.

A word is a maximal run of bytes other than the space and 0x09-0x0D; those bytes never
occur inside a multi-byte UTF-8 character, so the bytes need not be decoded. Words and
runs of words are named by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

# For comparing wording only: ASCII punctuation parts words, upper case is lower case.
_PLAIN = np.array([b if chr(b).isalnum() or b > 127 else 32 for b in range(256)], np.uint8)
_PLAIN[65:91] += 32

BASE = 0x9E3779B97F4A7C15
_powers = {"up": np.ones(1, U), "down": np.ones(1, U)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_powers["up"]) < n:
        size = 1 << (n - 1).bit_length()
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, U)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit hangs on every input bit."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each span: equal runs of values hash alike."""
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, U)
    np.cumsum((values + U(1)) * up[:-1], out=total[1:])
    found = (total[ends] - total[starts]) * down[starts]
    return mix(found + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    where = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[where[0]:where[-1]], where - where[0]


class Words:
    """The words of a column: byte spans, and the word range of each text."""

    def __init__(self, column: pa.Array, lower: bool = False, plain: bool = False):
        self.data, self.text_at = text_buffers(column)
        if lower:
            self.data = _LOWER[self.data]
        if plain:
            accented = (self.data[1:] >= 0x80) & (self.data[1:] <= 0x9E) & (self.data[:-1] == 0xC3)
            self.data = _PLAIN[self.data]
            self.data[1:][accented] += 0x20
        n = len(self.data)
        inside = ~_SPACE[self.data]
        edge = np.zeros(n + 1, bool)
        edge[self.text_at] = True
        first, last = inside.copy(), inside.copy()
        if n:
            first[1:] &= ~inside[:-1] | edge[1:-1]
            last[:-1] &= ~inside[1:] | edge[1:-1]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.word_at = np.searchsorted(self.starts, self.text_at)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.word_at)

    def hashes(self) -> np.ndarray:
        return spans_hash(self.data.astype(U), self.starts, self.ends)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def slices(batch: pa.RecordBatch, text: str, most: int = 2 << 20, rows: int = 1 << 30):
    """Pieces of a batch with about ``most`` bytes of text and at most ``rows`` rows each, a whole text at least."""
    column = batch.column(batch.schema.get_field_index(text))
    sizes = np.cumsum(np.nan_to_num(pc.binary_length(column).to_numpy(zero_copy_only=False)))
    at = 0
    while at < batch.num_rows:
        base = sizes[at - 1] if at else 0
        to = min(max(at + 1, int(np.searchsorted(sizes, base + most, "right"))), at + rows)
        yield batch.slice(at, to - at)
        at = to


def lists(values: np.ndarray, at: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and offsets."""
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values, kind))
