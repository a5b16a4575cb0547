"""Arrow text columns as flat NumPy buffers, and the vectorised hashing built on them.

A batch's texts are one ``uint8`` array plus row offsets, so that every pass below runs over all rows at once
instead of row by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_MASK = (1 << 64) - 1
#: Odd multiplier of the polynomial hashes, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of text handled at once; temporaries are a small multiple of it.
BLOCK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: A random 64-bit value for each byte value.
BYTE_VALUE = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))
#: The same after A-Z are folded to a-z.
BYTE_VALUE_FOLDED = BYTE_VALUE[[b + 32 if 65 <= b <= 90 else b for b in range(256)]]


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, U)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = {"p": _powers(0, BASE), "i": _powers(0, _INVERSE)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n."""
    if len(_POWERS["p"]) < n:
        size = max(n, BLOCK_BYTES + 2)
        _POWERS["p"], _POWERS["i"] = _powers(size, BASE), _powers(size, _INVERSE)
    return _POWERS["p"][:n], _POWERS["i"][:n]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """h with h[j] = sum of values[i] * BASE**i over i < j; ``span_hash`` reads any range from it."""
    p, _ = powers(len(values))
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * p, out=out[1:])
    return out


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each pair, whatever its place."""
    _, inverse = powers(len(h))
    return mix((h[end] - h[start]) * inverse[start] + (end - start).astype(U))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    first = int(offsets[0])
    return np.frombuffer(data, np.uint8)[first : int(offsets[-1])], offsets - first


def blocks(batch: pa.RecordBatch, column: str, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts hold at most ``most`` bytes; a longer text is a run by itself."""
    _, offsets = buffers(batch.column(batch.schema.get_field_index(column)))
    row = 0
    while row < batch.num_rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield batch.slice(row, end - row)
        row = end


def row_of(offsets: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The row that holds each byte place."""
    return np.searchsorted(offsets, places, "right") - 1


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of other bytes than x20 and x09-x0D; none crosses a row."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = _SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    inside = ~space
    before = np.empty(n, bool)
    before[0], before[1:] = True, space[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, space[1:]
    starts = np.flatnonzero(inside & (before | edge[:-1]))
    ends = np.flatnonzero(inside & (after | edge[1:])) + 1
    return starts, ends
