"""Words and shingles of whole batches of texts as 64-bit hashes, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash

# Separators between words; a fixed value.
_SEPARATORS = np.zeros(256, bool)
_SEPARATORS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_BASE = 0x9E3779B97F4A7C15
_PIECE = 1 << 20
# Words of more bytes are hashed one by one.
_LONG = 64
_PLACES = tuple(np.uint64(odd) for odd in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63))


def mixed(values: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    values = values ^ (values >> np.uint64(30))
    values *= np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(27)
    values *= np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


@lru_cache(1)
def _lowered() -> np.ndarray:
    """The lower-case form of every byte that is one of A to Z, and the others as they are."""
    lowered = np.arange(256, dtype=np.uint8)
    lowered[65:91] += 32
    return lowered


class Words:
    """The words of a run of texts, in order: a hash each, and the first word of every text.

    ``starts`` and ``ends`` are byte places in ``data``; ``first`` has one more entry than texts.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool, seed: int = 0):
        self.data, self.offsets = data, offsets
        inside = ~_SEPARATORS[data]
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        begins = offsets[:-1][offsets[:-1] < len(data)]
        opens[begins] |= inside[begins]
        closes = inside.copy()
        closes[:-1] &= ~inside[1:]
        last = offsets[1:][offsets[1:] > 0] - 1
        closes[last] |= inside[last]
        self.starts, self.ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.hashes = self._hashed(lower, seed)

    def _hashed(self, lower: bool, seed: int) -> np.ndarray:
        """A word's bytes are mixed in eight at a time, those of long words by a library; both begin with the seed.

        Mixing is no polynomial, under which words can be built that collide whatever its base.
        """
        if not len(self.starts):
            return np.empty(0, np.uint64)
        data = _lowered()[self.data] if lower else self.data
        sizes = self.ends - self.starts
        # Eight bytes at every place, as one number.
        padded = np.concatenate((data, np.zeros(8, np.uint8)))
        eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
        hashes = mixed(mixed(sizes.astype(np.uint64)) ^ mixed(np.array([seed], np.uint64) ^ np.uint64(_BASE)))
        short = np.flatnonzero(sizes <= _LONG)
        for step in range(0, _LONG, 8):
            short = short[sizes[short] > step]
            if not len(short):
                break
            chunk = eight[self.starts[short] + step].copy().view("<u8").ravel()
            left = np.minimum(sizes[short] - step, 8).astype(np.uint64)
            chunk &= np.uint64(2**64 - 1) >> (np.uint64(64) - np.uint64(8) * left)
            hashes[short] = mixed((hashes[short] ^ chunk) * np.uint64(_BASE) + np.uint64(step + 1))
        for word in np.flatnonzero(sizes > _LONG).tolist():
            held = data[self.starts[word] : self.ends[word]].tobytes()
            hashes[word] = xxhash.xxh3_64_intdigest(held, seed)
        return hashes

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each text begins and ends; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    places = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    held = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return held[places[0] : places[-1]], places - places[0]


def words_of(column: pa.Array, lower: bool = True, seed: int = 0) -> Iterator[tuple[int, Words]]:
    """The words of a column in runs of about a mebibyte: the first row of each run, and its words."""
    data, offsets = column_bytes(column)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + _PIECE, "right")) - 1)
        end = min(end, len(column))
        yield row, Words(data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row], lower, seed)
        row = end


def shingled(words: np.ndarray, size: int) -> np.ndarray:
    """The distinct shingles of one text, ascending; a shorter text is one shingle of all its words."""
    if not len(words):
        return words
    width = min(size, len(words))
    total = np.full(len(words) - width + 1, width, np.uint64)
    for place in range(width):
        total += words[place : len(words) - width + 1 + place] * place_factor(place)
    total = np.sort(mixed(total))
    return total[np.concatenate(([True], total[1:] != total[:-1]))]


def place_factor(place: int) -> np.uint64:
    return _PLACES[place] if place < len(_PLACES) else np.uint64(pow(_BASE, place + 2, 2**64) | 1)


def shingle_sets(column: pa.Array, size: int, seed: int = 0) -> Iterator[np.ndarray]:
    """The shingles of every text of a column."""
    for _, words in words_of(column, seed=seed):
        for begin, end in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
            yield shingled(words.hashes[begin:end], size)
