"""Whole texts as flat byte blocks, so that NumPy works on millions of characters per call.

A block is some consecutive rows of an Arrow text column. Rows are never cut: a block is closed once it holds
``BLOCK_BYTES``, and a longer text is a block of its own. Null texts are empty texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 512 << 10

#: Space, tab, line feed, vertical tab, form feed, carriage return.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

U64 = np.uint64
_ODD = U64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53)
#: Which bits of eight bytes belong to a span of so many bytes.
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)
#: Longer spans are hashed one by one.
LONG = 256


@dataclass
class Block:
    """Rows first..last of an Arrow column: their bytes and, for each row, where it begins and ends in them."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1


def text_blocks(column: pa.Array | pa.ChunkedArray, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + block_bytes, "right")) - 1)
        yield Block(first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64 bits."""
    h = h ^ (h >> U64(33))
    h = h * _MIX1
    h ^= h >> U64(33)
    h *= _MIX2
    h ^= h >> U64(33)
    return h


_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[ord("A") : ord("Z") + 1] += 32


class SpanHasher:
    """64-bit hashes of any spans of a block; fold: A-Z count as a-z.

    A span is taken eight bytes at a time, each mixed into the hash of those before, the first into the length. Spans of
    one length of at most 8 bytes, and all of at most 7, differ if their bytes do; others have equal hashes with the
    chance of random numbers. Spans of over ``LONG`` bytes have the hash of BLAKE2b."""

    def __init__(self, data: np.ndarray, fold: bool = False):
        self._data = np.zeros(len(data) + 8, np.uint8)
        self._data[: len(data)] = _FOLDED[data] if fold else data
        self._from = np.ndarray(len(data) + 1, "<u8", self._data, strides=(1,))  # the eight bytes from each place on

    def _chunk(self, starts: np.ndarray, left: np.ndarray) -> np.ndarray:
        return self._from[starts] & _MASKS[np.minimum(left, 8)]

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        lengths = ends - starts
        out = mix(self._chunk(starts, lengths) ^ lengths.astype(U64) * _ODD)
        more = np.flatnonzero((lengths > 8) & (lengths <= LONG))
        at = 8
        while len(more):
            out[more] = mix(out[more] * _ODD + self._chunk(starts[more] + at, lengths[more] - at))
            at += 8
            more = more[lengths[more] > at]
        for k in np.flatnonzero(lengths > LONG).tolist():
            out[k] = int.from_bytes(hashlib.blake2b(self._data[starts[k] : ends[k]], digest_size=8).digest(), "little")
        return out

    def same(self, left: np.ndarray, right: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Whether the spans of that length at left and right have the same bytes."""
        out = np.ones(len(lengths), bool)
        more, at = np.flatnonzero((lengths <= LONG) & (left != right)), 0
        while len(more):
            out[more] &= self._chunk(left[more] + at, lengths[more] - at) == self._chunk(right[more] + at, lengths[more] - at)
            at += 8
            more = more[(lengths[more] > at) & out[more]]
        for k in np.flatnonzero((lengths > LONG) & (left != right)).tolist():
            out[k] = np.array_equal(self._data[left[k] : left[k] + lengths[k]], self._data[right[k] : right[k] + lengths[k]])
        return out


_WORD = np.ones(256, bool)
_WORD[list(SPACE_BYTES)] = False


def spans(block: Block, solid_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that solid_bytes marks, and for each row (and the end) the number of its
    first run. A run ends where its row ends."""
    solid = np.zeros(len(block.data) + 2, bool)
    solid[1:-1] = solid_bytes[block.data]
    edge = solid[1:] != solid[:-1]
    begins, stops = edge & solid[1:], edge & solid[:-1]
    cuts = block.offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(block.data))]
    joined = cuts[solid[cuts] & solid[cuts + 1]]
    begins[joined] = stops[joined] = True
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops)
    return starts, ends, np.searchsorted(starts, block.offsets)


def words(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words ([^\\x20\\x09-\\x0D]+) of a block, as spans gives them."""
    return spans(block, _WORD)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions starts[0], .., starts[0] + lengths[0] - 1, starts[1], .. as one array."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)
