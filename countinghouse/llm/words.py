"""Vectorised word scanning over Arrow string columns.

A batch of texts is handled as one byte array with document offsets: word
boundaries, word hashes and hashes of runs of words all come from numpy passes
over that array, with no Python work per word. Texts are cut into chunks of
about half a megabyte; a longer text is a chunk of its own, never a prefix.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 19
#: Odd multipliers of the polynomial hashes modulo 2**64, over bytes and over words, for two independent seeds.
BYTE_BASE = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
WORD_BASE = (0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F)

_SPACE = bytes([0x20, *range(0x09, 0x0E)])


def _table(is_word) -> np.ndarray:
    return np.array([is_word(b) for b in range(256)], dtype=bool)


def spaced_table() -> np.ndarray:
    """Word bytes of `[^\\x20\\x09-\\x0D]+`."""
    return _table(lambda b: b not in _SPACE)


def alnum_table() -> np.ndarray:
    """Word bytes of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`, for text in which A-Z is lower-cased."""
    return _table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)


def lower_table() -> np.ndarray:
    """Maps the bytes of A-Z to a-z and others to themselves; bytes of longer UTF-8 sequences stay."""
    return np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def text_chunks(column, limit: int = CHUNK_BYTES):
    """(first row, end row, bytes, offsets) for runs of rows of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
    """(starts, ends, bounds): byte spans of the words, and for document d its words bounds[d]:bounds[d+1]."""
    n = len(data)
    inside = table[data]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    if n:
        before[1:], after[:-1] = inside[:-1], inside[1:]
        edge = offsets[(offsets > 0) & (offsets < n)]
        before[edge] = False
        after[edge - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, extended as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int):
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, b in (("up", self.base), ("down", self.inverse)):
                row = np.full(size, b, np.uint64)
                row[0] = 1
                setattr(self, name, np.cumprod(row, dtype=np.uint64))
        return self.up[:n], self.down[:n]


class Hasher:
    """Rolling (Rabin-Karp) hashes of words and of runs of consecutive words."""

    def __init__(self, seed: int = 0):
        self.bytes, self.words = Powers(BYTE_BASE[seed]), Powers(WORD_BASE[seed])

    @staticmethod
    def _spans(values, powers: Powers, starts, ends):
        up, down = powers.to(len(values) + 1)
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[:-1], dtype=np.uint64, out=total[1:])
        return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))

    def of_words(self, data, starts, ends):
        return self._spans(data.astype(np.uint64) + np.uint64(1), self.bytes, starts, ends)

    def of_runs(self, word_hashes, starts, ends):
        """Hashes of words starts:ends, as indexes into word_hashes."""
        return self._spans(word_hashes, self.words, starts, ends)


def run_starts(bounds: np.ndarray, width: int, short: bool):
    """(first word, end word, document) of each run of `width` words in a document.

    short: a document with fewer words, but not none, has all of them as its one run.
    """
    counts = np.diff(bounds)
    docs = np.repeat(np.arange(len(counts)), counts)
    first = np.arange(bounds[0], bounds[-1]) if len(bounds) else np.zeros(0, np.int64)
    room = np.repeat(bounds[1:], counts) - first
    full = room >= width
    if short:
        whole = (first == np.repeat(bounds[:-1], counts)) & ~full
        size = np.where(whole, room, width)
        keep = full | whole
        return first[keep], (first + size)[keep], docs[keep]
    return first[full], first[full] + width, docs[full]
