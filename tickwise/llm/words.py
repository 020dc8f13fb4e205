"""Words of Arrow text batches as numpy arrays, for the operators that work inside tasks.

A word is a run of bytes other than space and 0x09 to 0x0D. Everything here works on whole
texts, in slices of a quarter of a megabyte, so that memory depends on the longest single text and
not on the size of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Every ASCII byte that is neither a letter nor a digit separates words.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BYTE = np.random.Generator(np.random.PCG64(0x5EED)).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD1B54A32D192ED03)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, for at least ``n`` bytes."""
    size = max(SLICE_BYTES * 2, 1 << max(1, int(n)).bit_length())
    if size not in _powers:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        tables = []
        for b in (_BASE, inverse):
            t = np.full(size, b, dtype=np.uint64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        if size > SLICE_BYTES * 2:
            return tables[0], tables[1]
        _powers[size] = (tables[0], tables[1])
    return _powers[size]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits, so that all bits of a hash depend on all bits of ``x``."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """Words of some texts: byte bounds, 64-bit hashes, and the first word of each text."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    def text_of_word(self) -> np.ndarray:
        """Index of the text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def _strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    return column.fill_null("")


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, bytes, offsets) for consecutive texts of about ``limit`` bytes; null is empty."""
    arr = _strings(column)
    n = len(arr)
    if not n:
        return
    buffers = arr.buffers()
    off = np.frombuffer(buffers[1], dtype=np.int64)[arr.offset : arr.offset + n + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(off, off[at] + limit, side="right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to, data[off[at] : off[to]], off[at : to + 1] - off[at]
        at = to


def split_words(data: np.ndarray, offsets: np.ndarray, fold: bool = False, between: np.ndarray = _SPACE) -> Words:
    """Words of the texts that lie in ``data`` at ``offsets``; ``fold`` lower-cases A to Z.

    ``between`` says for each byte whether it separates words.
    """
    n = len(data)
    if not n:
        none = np.empty(0, np.int64)
        return Words(data, none, none, np.zeros(len(offsets), np.int64), np.empty(0, np.uint64))
    space = between.take(data)
    edge = np.ones(n + 1, dtype=bool)
    edge[1:n] = space[:-1]
    edge[offsets[:-1][offsets[:-1] < n]] = True
    starts = np.flatnonzero(edge[:n] & ~space)
    edge = np.ones(n + 1, dtype=bool)
    edge[: n - 1] = space[1:]
    inner = offsets[1:][offsets[1:] > 0] - 1
    edge[inner] = True
    ends = np.flatnonzero(edge[:n] & ~space) + 1
    power, inverse = _power_tables(n + 1)
    code = _BYTE[_FOLD] if fold else _BYTE
    # What separates words counts nothing, so a sum may run on to the next word.
    value = np.where(between, np.uint64(0), code).take(data, mode="clip")
    value *= power[:n]
    hashes = mix(np.add.reduceat(value, starts) * inverse[starts]) if len(starts) else np.empty(0, np.uint64)
    return Words(data, starts, ends, np.searchsorted(starts, offsets), hashes)


def run_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words from each position on; the last ``k - 1`` positions are left out.

    Runs are joined by doubling: the hash of a+b words is that of a words plus a power times
    the hash of the next b words.
    """
    if len(h) < k:
        return np.empty(0, np.uint64)
    done, have = h[:0], 0
    block, width, rest = h, 1, k
    while rest:
        if rest & 1:
            if have:
                m = len(h) - have - width + 1
                done = done[:m] + block[have : have + m] * np.uint64(pow(int(_STEP), have, 1 << 64))
            else:
                done = block
            have += width
        rest >>= 1
        if rest:
            m = len(block) - width
            block = block[:m] + block[width : width + m] * np.uint64(pow(int(_STEP), width, 1 << 64))
            width *= 2
    return mix(done)


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost minimum of ``values[p : p + width]`` for each p."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    pos = np.arange(len(values))
    size = 1
    while size < width:
        step = min(size, width - size)
        m = len(pos) - step
        left, right = pos[:m], pos[step : step + m]
        pos = np.where(values[right] < values[left], right, left)
        size += step
    return pos[:n]


def whole_groups(
    batches: Iterator[pa.RecordBatch], keys: list[str], limit: int, limit_bytes: int | None = None
) -> Iterator[pa.Table]:
    """Tables of about ``limit`` rows or ``limit_bytes`` from batches sorted by ``keys``, cut between groups only."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows < limit and (limit_bytes is None or sum(b.nbytes for b in held) < limit_bytes):
            continue
        t = pa.Table.from_batches(held)
        new = np.zeros(t.num_rows - 1, dtype=bool)
        for k in keys:
            v = t.column(k).to_numpy()
            new |= v[1:] != v[:-1]
        cut = np.flatnonzero(new)
        if len(cut):
            yield t.slice(0, int(cut[-1]) + 1)
            t = t.slice(int(cut[-1]) + 1)
        held, rows = t.combine_chunks().to_batches(), t.num_rows
    if held:
        yield pa.Table.from_batches(held)
