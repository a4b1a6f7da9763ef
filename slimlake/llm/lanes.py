"""Words and their hashes for many texts at once, as numpy arrays over UTF-8 bytes.

Tasks see Arrow batches. A batch's text column is one byte buffer with offsets, so
finding words, hashing them and hashing runs of words are a few array operations
over the whole buffer instead of a Python loop over words. Both word rules of this
package split at ASCII bytes only, and no byte of a longer UTF-8 sequence is below
0x80, so working on bytes gives the same words as working on characters.

Null texts have no words. Batches are cut into pieces of bounded size; one text is
never cut, so a piece may be as large as the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20

_SPACES = [0x20, *range(0x09, 0x0E)]

#: True for bytes of words ``[^\x20\x09-\x0D]+``.
SPACED = np.ones(256, dtype=bool)
SPACED[_SPACES] = False

#: True for bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of lower-cased text.
PLAIN = np.zeros(256, dtype=bool)
PLAIN[0x30:0x3A] = True
PLAIN[0x61:0x7B] = True
PLAIN[0x80:] = True

#: Lower-cases A-Z and leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASES = (0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)
_MASK = (1 << 64) - 1


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Scramble 64-bit values one to one, so that sums of them behave as random."""
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & _MASK)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(0, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, PIECE_BYTES + 1)
            for name, base in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))
        return self.up, self.down


_BYTE_POWERS = _Powers(_BYTE_BASE)
_WORD_POWERS = tuple(_Powers(b) for b in _WORD_BASES)


class Words:
    """The words of several texts: byte spans, and for each text its first word's number.

    ``bounds[t]:bounds[t + 1]`` are the words of text ``t``.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        self.data, self.offsets = data, offsets
        inside = table[data]
        if not len(data):
            self.starts = self.ends = np.zeros(0, dtype=np.int64)
        else:
            edge = np.zeros(len(data) + 1, dtype=bool)
            edge[offsets] = True
            before = np.empty_like(inside)
            before[0] = False
            before[1:] = inside[:-1]
            self.starts = np.flatnonzero(inside & (~before | edge[:-1]))
            after = np.empty_like(inside)
            after[-1] = False
            after[:-1] = inside[1:]
            self.ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        self._hashes: np.ndarray | None = None
        self._sums: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def text_of(self) -> np.ndarray:
        """For each word the number of its text."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    @property
    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if self._hashes is None:
            self._hashes = self._spans(self.ends)
        return self._hashes

    def prefix_hashes(self, length: int) -> np.ndarray:
        """A hash of each word's first ``length`` bytes."""
        return self._spans(np.minimum(self.ends, self.starts + length))

    def _spans(self, ends: np.ndarray) -> np.ndarray:
        n = len(self.data)
        up, down = _BYTE_POWERS.get(n + 1)
        if self._sums is None:
            self._sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[:n], out=self._sums[1:])
        spans = (self._sums[ends] - self._sums[self.starts]) * down[self.starts]
        return mix(spans ^ (ends - self.starts).astype(np.uint64))

    def runs(self, length: int, lane: int = 0) -> np.ndarray:
        """A hash of the ``length`` words that start at each word, as far as they exist.

        The result is ``length - 1`` shorter than the words; runs that cross into
        another text are there and must be left out with ``whole``.
        """
        n = len(self)
        if n < length:
            return np.zeros(0, dtype=np.uint64)
        up, down = _WORD_POWERS[lane].get(n + 1)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(mix(self.hashes, lane) * up[:n], out=total[1:])
        return mix((total[length:] - total[:-length]) * down[: n + 1 - length], length)

    def whole(self, length: int) -> np.ndarray:
        """True where the run of ``length`` words stays within its text."""
        n = len(self)
        if n < length:
            return np.zeros(0, dtype=bool)
        of = self.text_of
        return of[: n + 1 - length] == of[length - 1 :]


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and its offsets; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if pa.types.is_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)
    offsets = offsets[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part has about ``limit`` bytes of text, one row at least."""
    _, offsets = text_bytes(batch.column(column))
    at, rows = 0, batch.num_rows
    while at < rows:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), rows)
        yield batch.slice(at, to - at)
        at = to


def spread(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, joined."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def signed(values: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark's BIGINT."""
    return values.view(np.int64)
