"""Word hashes of whole Arrow batches at array speed; used inside Python workers.

Words are runs of bytes other than the separators, cut at document ends. A word's hash depends
on its bytes alone, so it is the same in every task and process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)
_BYTE = np.random.default_rng(20_240_229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
#: Bytes of text that are worked on at once: temporaries take some forty times as much.
SLICE_BYTES = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = (x ^ (x >> _S30)) * _MIX1
    x = (x ^ (x >> _S27)) * _MIX2
    return x ^ (x >> _S31)


def multipliers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _BASE, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_bytes(separators: str) -> np.ndarray:
    table = np.ones(256, dtype=bool)
    table[[ord(c) for c in separators]] = False
    return table


#: The separators `[\x20\x09-\x0D]`.
BLANK = word_bytes(" \t\n\x0b\x0c\r")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SAME = np.arange(256, dtype=np.uint8)


class Words:
    """Word hashes of consecutive documents: of document i, those from first[i] to first[i + 1]."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, lower: bool, table: np.ndarray = BLANK):
        """data: the documents' bytes; ends: where they begin, and the end of the last."""
        self.n = len(ends) - 1
        word = table[data]
        begin = word.copy()
        begin[1:] &= ~word[:-1]
        inner = ends[:-1][ends[:-1] < len(data)]
        begin[inner] = word[inner]
        self.starts = np.flatnonzero(begin)
        self.first = np.searchsorted(self.starts, ends)
        if not len(self.starts):
            self.hash = np.empty(0, dtype=np.uint64)
            return
        at = self._offsets(len(data))
        value = np.where(word, _BYTE[(_LOWER if lower else _SAME)[data]], np.uint64(0))
        value *= _powers(int(at.max()) + 1)[at]
        self.hash = mix(np.add.reduceat(value, self.starts))

    def _offsets(self, n: int) -> np.ndarray:
        at = np.zeros(n, dtype=np.int64)
        at[self.starts[0] :] = np.arange(self.starts[0], n) - np.repeat(self.starts, np.diff(np.append(self.starts, n)))
        return at


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)), ends


def documents(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, ends) of slices of about SLICE_BYTES; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    data, ends = _buffers(column)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(ends, ends[row] + SLICE_BYTES, side="right")) - 1)
        yield row, stop, data[ends[row] : ends[stop]], ends[row : stop + 1] - ends[row]
        row = stop
