"""Texts as byte arrays: words, word hashes and shingle hashes of whole Arrow batches at once.

Words are maximal runs of bytes other than space and 0x09 to 0x0D.  Work goes in blocks of about a
megabyte of text, so memory is bounded by the block or by one document, whichever is larger.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
BASE = 0x9E3779B97F4A7C55
INVERSE = pow(BASE, -1, 1 << 64)
SHINGLE_FACTORS = (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xA0761D6478BD642F)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of a hash depends on every bit of its input."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_values(lower: bool) -> np.ndarray:
    """A hash value per byte; with ``lower``, A to Z have those of a to z."""
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE)) | np.uint64(1)
    if lower:
        values[65:91] = values[97:123]
    return values


def space_bytes() -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


def powers(base: int, n: int) -> np.ndarray:
    """base**0 … base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(max(n, 1), dtype=np.uint64)
    done, factor = 1, base
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * np.uint64(factor)
        done, factor = done + step, factor * factor % (1 << 64)
    return out


@dataclass
class Block:
    """Consecutive texts: ``data[offsets[i]:offsets[i + 1]]`` are the bytes of text ``first + i``."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1


@dataclass
class Words:
    """Words of a block in order: byte bounds, the text each belongs to, its hash, and the first word per text."""

    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    hash: np.ndarray
    first: np.ndarray


def blocks(column: pa.Array | pa.ChunkedArray, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut a string or binary column into blocks; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    n = len(column)
    if n == 0:
        return
    if column.null_count:
        column = column.fill_null(b"")
    buffers = column.buffers()
    ends = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(ends, ends[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield Block(at, data[ends[at] : ends[to]], ends[at : to + 1] - ends[at])
        at = to


class Hasher:
    """Finds and hashes the words of blocks; keeps its tables from block to block."""

    def __init__(self, lower: bool, block: int = BLOCK_BYTES):
        self.values, self.space, self.block = byte_values(lower), space_bytes(), block
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """Hash of data[s:e] is (p[e] - p[s]) * down[s]."""
        if len(self.up) <= len(data):
            size = max(len(data) + 1, self.block + 1)
            self.up, self.down = powers(BASE, size), powers(INVERSE, size)
        out = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.values[data] * self.up[: len(data)], out=out[1:])
        return out

    def words(self, block: Block) -> Words:
        data, offsets = block.data, block.offsets
        if not len(data):
            none = np.zeros(0, dtype=np.int64)
            return Words(none, none, none, none.astype(np.uint64), np.zeros(block.n + 1, np.int64))
        inside = ~self.space[data]
        begins, stops = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        stops[:-1] &= ~inside[1:]
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(data))]  # a word ends where its text ends
        begins[edges] = inside[edges]
        stops[edges - 1] = inside[edges - 1]
        start, end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        p = self.prefix(data)
        hashed = mix((p[end] - p[start]) * self.down[start])
        first = np.searchsorted(start, offsets)
        text = np.repeat(np.arange(block.n), np.diff(first))
        return Words(start, end, text, hashed, first)


class Lookup:
    """Places of 64-bit keys in an ascending table; one short walk for all queries at once."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, min(22, int(len(keys)).bit_length() + 1))
        self.keys = np.append(keys, np.uint64(np.iinfo(np.uint64).max))
        sizes = np.bincount((keys >> np.uint64(64 - self.bits)).astype(np.int64), minlength=1 << self.bits)
        self.begin = (np.cumsum(sizes) - sizes).astype(np.int32)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Place of each wanted key, or the number of keys where it is missing."""
        at = self.begin[wanted >> np.uint64(64 - self.bits)]
        while True:
            short = self.keys[at] < wanted
            if not short.any():
                break
            at = at + short
        return np.where(self.keys[at] == wanted, at, len(self.keys) - 1)


def shingles(words: Words, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and the first of each text.

    A text with fewer words than ``width`` has its whole sequence as one; without words it has none.
    """
    n = len(words.first) - 1
    counts = np.diff(words.first)
    total = len(words.hash)
    hashed = np.zeros(total, dtype=np.uint64)
    keep = np.zeros(total, dtype=bool)
    if total >= width:
        span = total - width + 1
        value = words.hash[:span] * np.uint64(SHINGLE_FACTORS[0])
        for j in range(1, width):
            value = mix(value) + words.hash[j : j + span] * np.uint64(SHINGLE_FACTORS[j % 5] + 2 * (j // 5))
        hashed[:span] = value
        keep[:span] = words.text[:span] == words.text[width - 1 :]
    for i in np.flatnonzero((counts > 0) & (counts < width)):
        at, value = words.first[i], np.uint64(counts[i])
        with np.errstate(over="ignore"):
            for w in words.hash[at : words.first[i + 1]]:
                value = mix(np.array([value], np.uint64))[0] * np.uint64(SHINGLE_FACTORS[1]) + w
        hashed[at], keep[at] = value, True
    owner, hashed = words.text[keep], mix(hashed[keep])
    order = np.lexsort((hashed, owner))
    owner, hashed = owner[order], hashed[order]
    fresh = np.ones(len(hashed), dtype=bool)
    fresh[1:] = (hashed[1:] != hashed[:-1]) | (owner[1:] != owner[:-1])
    owner, hashed = owner[fresh], hashed[fresh]
    return hashed, np.searchsorted(owner, np.arange(n + 1))
