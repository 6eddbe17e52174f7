"""Words of many texts at once: places, 64-bit hashes and lines as numpy arrays, straight from Arrow buffers.

A batch of texts is one byte buffer in which a line feed ends each text. Words are runs of bytes between ASCII white
space, with A-Z lower-cased. The hash of a word comes from prefix sums of a polynomial over its bytes, so no Python loop
runs over words. Buffers are read in windows that end at white space, whose size does not depend on the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Odd multiplier of the polynomial and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes read at once, and bytes of texts that make a slab.
READ, SLAB = 1 << 17, 1 << 20
#: Most texts of a slab.
TEXTS = 1 << 14


def mixed(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers; equal ones stay equal."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Rolling:
    """Hashes of stretches of a sequence of numbers from prefix sums; the powers are kept from one use to the next."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.up) <= n:
            size = max(n + 1, 2 * len(self.up))
            up, down = np.full(size, BASE, np.uint64), np.full(size, INVERSE, np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)

    def sums(self, values: np.ndarray) -> np.ndarray:
        self.grow(len(values))
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hashes of the stretches from start to stop (exclusive); equal stretches have equal ones wherever they stand."""
        return mixed((sums[stop] - sums[start]) * self.down[start] + (stop - start).astype(np.uint64))


class Reader:
    """Cuts slabs of texts into hashed words; one for each task."""

    def __init__(self):
        self.rolling = Rolling()
        self.symbols = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32

    def words(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, stop and hash of each word of a buffer that ends with white space."""
        starts, stops, hashes, at = [], [], [], 0
        folded = self.lower[65] == 97
        while at < len(raw):
            to = min(len(raw), at + READ)
            while True:
                part = raw[at:to]
                # bytes wrap around, so one comparison tells a range; tables would be looked up byte by byte
                if folded:
                    part = part + ((part - np.uint8(65)) < 26).view(np.uint8) * np.uint8(32)
                space = (part == 32) | ((part - np.uint8(9)) < 5)
                if to == len(raw):
                    break
                last = np.flatnonzero(space[-4096:])
                if len(last):
                    to -= min(len(part), 4096) - int(last[-1]) - 1
                    part, space = part[: to - at], space[: to - at]
                    break
                to = min(len(raw), to + max(READ, to - at))
            edge = np.diff(np.r_[True, space, True].view(np.int8))
            start, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
            sums = self.rolling.sums(self.symbols.take(part))
            hashes.append(self.rolling.of(sums, start, stop))
            starts.append(start + at)
            stops.append(stop + at)
            at = to
        if not starts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return np.concatenate(starts), np.concatenate(stops), np.concatenate(hashes)


class Slab:
    """Some rows of a batch: `rows` (from, to), the word hashes, and for each word its text (0 for the first row).

    `starts` and `stops` are places in `raw`, the bytes as they are; `bounds` are the words of each text, `bounds[i]` to `bounds[i + 1]`.
    """

    def __init__(self, reader: Reader, raw: np.ndarray, ends: np.ndarray, rows: tuple[int, int]):
        self.raw, self.ends, self.rows = raw, ends, rows
        self.starts, self.stops, self.hashes = reader.words(raw)
        self.bounds = np.r_[0, np.searchsorted(self.starts, ends)]
        self.text = np.repeat(np.arange(len(ends)), np.diff(self.bounds))

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each word the line of the slab it stands on; for each line of the slab its text and its number there."""
        feeds = np.flatnonzero(self.raw == 10)
        text = np.searchsorted(self.ends, feeds + 1)
        first = np.r_[0, np.searchsorted(feeds, self.ends[:-1])] if len(self.ends) else np.zeros(0, np.int64)
        return np.searchsorted(feeds, self.starts), text, np.arange(len(feeds)) - first[text]

    def windows(self, rolling: Rolling, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, text and first word of every run of n words of a text; a shorter text, but not an empty one, is one run."""
        sizes = np.diff(self.bounds)
        counts = np.where(sizes > 0, np.maximum(1, sizes - n + 1), 0)
        text = np.repeat(np.arange(len(sizes)), counts)
        start = self.bounds[text] + np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
        return rolling.of(rolling.sums(self.hashes), start, np.minimum(start + n, self.bounds[text + 1])), text, start


def slabs(texts: pa.Array, reader: Reader, most: int = SLAB) -> Iterator[Slab]:
    """The texts of an Arrow column in slabs of about `most` bytes (a longer text is one slab); null is the empty text."""
    ended = pc.binary_join_element_wise(pc.fill_null(texts, "").cast(pa.large_string()), pa.scalar("\n", pa.large_string()), pa.scalar("", pa.large_string()))
    if isinstance(ended, pa.ChunkedArray):
        ended = ended.combine_chunks()
    if not len(ended):
        return
    offsets = np.frombuffer(ended.buffers()[1], np.int64)[ended.offset : ended.offset + len(ended) + 1]
    data = np.frombuffer(ended.buffers()[2], np.uint8)
    row = 0
    while row < len(ended):
        to = min(row + TEXTS, max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1))
        yield Slab(reader, data[offsets[row] : offsets[to]], offsets[row + 1 : to + 1] - offsets[row], (row, to))
        row = to
