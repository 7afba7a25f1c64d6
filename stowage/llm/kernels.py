"""Vectorised text kernels shared by the corpus operators: words, shingles, MinHash.

Everything works on the flat byte buffer of an Arrow column, so the cost a word is a few numpy
passes instead of a Python loop, and memory is bounded by ``SLICE_BYTES`` (or one text, if longer).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_WIDTH = 4096
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_PLACE = _rng.integers(1, 2**63, _WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ROLE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SEED = _rng.integers(1, 2**63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    array = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(array.buffers()[2] or b"", np.uint8)
    return (data[offsets[0] : offsets[-1]], offsets - offsets[0]) if len(offsets) else (data[:0], np.zeros(1, np.int64))


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) in runs of about ``size`` bytes, one row at least."""
    data, offsets = flat(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def spans(texts: pa.Array, size: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """(first row, end row) of runs of about ``size`` bytes, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield at, end
        at = end


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, in order, and the
    index of each row's first word (one more entry closes the last row)."""
    solid = ~_BLANK[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[first] = solid[first]
    at = np.flatnonzero(solid)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    starts = np.flatnonzero(begins)
    word = np.cumsum(begins[at]) - 1
    place = at - starts[word]
    runs = np.flatnonzero(begins[at])
    weight = _PLACE[place & (_WIDTH - 1)]
    far = np.flatnonzero(place >= _WIDTH)
    if len(far):  # beyond the table's places, every stretch of a word has a factor of its own
        weight[far] *= mix((place[far] // _WIDTH).astype(np.uint64)) | np.uint64(1)
    sums = np.add.reduceat(_BYTE[data[at]] * weight, runs)
    length = np.diff(np.append(runs, len(at))).astype(np.uint64)
    return mix(sums + length * _ROLE[63]), np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``width``-word shingles of each row and their bounds. A row with fewer words has
    its whole sequence as one shingle; one without words has none."""
    counts = np.diff(bounds)
    total = len(words)
    rolled = np.zeros(max(0, total - width + 1), np.uint64)
    for i in range(width):
        rolled += words[i : i + len(rolled)] * _ROLE[i]
    each = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    out_bounds = np.concatenate([[0], np.cumsum(each)])
    owner = np.repeat(np.arange(len(counts)), each)
    source = bounds[:-1][owner] + np.arange(out_bounds[-1]) - out_bounds[:-1][owner]
    short = np.flatnonzero((counts > 0) & (counts < width))
    out = np.zeros(out_bounds[-1], np.uint64)
    whole = counts[owner] >= width
    out[whole] = rolled[source[whole]]
    for row in short:
        own = words[bounds[row] : bounds[row + 1]]
        out[out_bounds[row]] = np.append(own * _ROLE[: len(own)], _ROLE[40 + len(own)]).sum(dtype=np.uint64)
    return mix(out), out_bounds


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row, whole texts."""
    for _, _, data, offsets in slices(column):
        hashes, bounds = shingle_hashes(*word_hashes(data, offsets), width)
        for i in range(len(bounds) - 1):
            yield np.unique(hashes[bounds[i] : bounds[i + 1]])


def minhash(values: np.ndarray, size: int) -> np.ndarray:
    """``size`` symbols of 16 bits (b-bit minwise hashing, b = 16) of a non-empty set."""
    least = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    seeds = _SEED[:size, None]
    for i in range(0, len(values), 16384):
        np.minimum(least, mix_fast(values[None, i : i + 16384], seeds).min(axis=1), out=least)
    return (mix(least) & np.uint64(0xFFFF)).astype(np.uint16)


def mix_fast(values: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    x = values * seeds
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x9E3779B97F4A7C15)
    return x


def set_digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The parts of ``flat`` that begin at ``starts``, one after another."""
    ends = np.cumsum(sizes)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)]


class WordTable:
    """What ``learn`` gives for words, as (numbers, how many for each word), kept in Arrow (the words) and
    numpy: of ``most`` words of up to 64 bytes, some 40 bytes each, and forgotten beyond that."""

    def __init__(self, learn: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], most: int = 400_000):
        self.learn, self.most = learn, most
        self._forget()

    def _forget(self) -> None:
        self.words, self.flat = pa.array([], pa.string()), np.zeros(0, np.uint32)
        self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int32)

    def __call__(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(numbers, starts, sizes) of distinct words."""
        at = pc.index_in(words, value_set=self.words)
        fresh = pc.is_null(at).to_numpy(zero_copy_only=False)
        at = pc.fill_null(at, 0).to_numpy(zero_copy_only=False)
        new = words.filter(pa.array(fresh))
        made, sizes = self.learn(new)
        begins = np.cumsum(sizes) - sizes
        starts, lengths = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        starts[fresh], lengths[fresh] = begins + len(self.flat), sizes
        starts[~fresh], lengths[~fresh] = self.starts[at[~fresh]], self.sizes[at[~fresh]]
        flat = np.concatenate([self.flat, made])
        short = pc.less_equal(pc.binary_length(new), 64).to_numpy(zero_copy_only=False)
        if len(self.words) + len(new) > self.most:
            self._forget()
        kept = np.flatnonzero(short)
        self.starts = np.concatenate([self.starts, (np.cumsum(sizes[kept]) - sizes[kept] + len(self.flat)).astype(np.int32)])
        self.sizes = np.concatenate([self.sizes, sizes[kept].astype(np.int32)])
        self.flat = np.concatenate([self.flat, gather(made, begins[kept], sizes[kept])])
        self.words = pa.concat_arrays([self.words, new.filter(pa.array(short))])
        return flat, starts, lengths
