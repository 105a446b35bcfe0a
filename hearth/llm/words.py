"""Words of whole texts as numpy arrays of 64-bit hashes, and bounded tallies of such keys.

Used inside Arrow batches: texts are lower-cased (A-Z only) and cut as UTF-8
bytes, all words of a slice of texts at once.  A word's hash is the sum of a random
number for each byte times a power of an odd multiplier (modulo 2^64), scrambled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19   # text worked on at a time
LONG_WORD = 1 << 12     # longer words are hashed one by one
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
BLANKS = b" \t\n\x0b\x0c\r"   # fixed value: what stands between words


def lowered(text: str | None, fold: bytes = _LOWER) -> bytes:
    """UTF-8 bytes of ``text`` (null: empty) with A-Z in lower case."""
    return (text or "").encode("utf-8", "replace").translate(fold)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit values (the public splitmix64 finisher)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the ordered pair."""
    with np.errstate(over="ignore"):
        return mix(mix(a) * np.uint64(0x9E3779B97F4A7C15) + b)


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
with np.errstate(over="ignore"):
    _POWER = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(LONG_WORD - 1, np.uint64(0xD6E8FEB86659FD93))]))


@dataclass
class Words:
    """The words of some texts, in order: their bytes are ``buffer[starts[i]:ends[i]]``."""
    buffer: bytes
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    owner: np.ndarray      # index of the text

    def word(self, i: int) -> bytes:
        return self.buffer[self.starts[i]:self.ends[i]]

    def distinct(self) -> tuple[list[bytes], np.ndarray]:
        """The distinct words and how often each stands there."""
        _, first, counts = np.unique(self.hashes, return_index=True, return_counts=True)
        return [self.buffer[a:b] for a, b in zip(self.starts[first].tolist(), self.ends[first].tolist())], counts


class Cutter:
    """Cuts lower-cased texts at the bytes of ``gaps``."""

    def __init__(self, gaps: bytes = BLANKS, fold: bytes = _LOWER):
        self.fold = fold
        self.gap = np.zeros(256, bool)
        self.gap[list(gaps)] = True
        self.between = gaps[:1]

    def cut(self, texts: list[str | None], between: bytes | None = None) -> Words:
        between = between or self.between
        low = [lowered(t, self.fold) for t in texts]
        buffer = between.join([*low, b""])
        data = np.frombuffer(buffer, np.uint8)
        inside = np.concatenate([[False], ~self.gap[data], [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        first = np.concatenate([[0], np.cumsum([len(x) + 1 for x in low[:-1]])]) if low else np.zeros(0, np.int64)
        owner = np.searchsorted(first, starts, side="right") - 1
        return Words(buffer, starts, ends, _hashed(data, inside[1:-1], buffer, starts, ends), owner)


def _hashed(data: np.ndarray, inside: np.ndarray, buffer: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    out = np.empty(len(starts), np.uint64)
    # words by runs of about SLICE_BYTES, so that a very long text needs no more memory than others
    cuts = [0, *(np.flatnonzero(np.diff(ends // SLICE_BYTES)) + 1).tolist(), len(starts)]
    for a, b in zip(cuts[:-1], cuts[1:]):
        lengths = ends[a:b] - starts[a:b]
        own = data[starts[a]:ends[b - 1]][inside[starts[a]:ends[b - 1]]]   # the words' bytes without the gaps
        base = np.concatenate([[0], np.cumsum(lengths)])
        place = np.arange(len(own)) - np.repeat(base[:-1], lengths)
        if lengths.max() > LONG_WORD:
            place = np.minimum(place, LONG_WORD - 1)
        with np.errstate(over="ignore"):
            out[a:b] = np.add.reduceat(_BYTE[own] * _POWER[place], base[:-1])
    out = mix(out)
    for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        import xxhash
        out[i] = xxhash.xxh64_intdigest(buffer[starts[i]:ends[i]])
    return out


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows of about ``SLICE_BYTES`` of text (one row at least)."""
    sizes = np.cumsum([len(t) if (t := x.as_py()) else 0 for x in batch.column(column)]) if batch.num_rows else []
    start = 0
    while start < batch.num_rows:
        base = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, base + SLICE_BYTES)))
        yield batch.slice(start, end - start)
        start = end


class Tally:
    """Sums counts by 64-bit key in bounded memory; ``add`` and ``rest`` yield
    ``(keys, counts, tags)`` whenever ``limit`` distinct keys are held.  ``tag`` is any
    value that belongs to a key."""

    def __init__(self, limit: int = 1 << 20):
        self.limit, self.held = limit, []
        self.size = 0

    def _merged(self):
        keys, counts, tags = (np.concatenate(x) for x in zip(*self.held))
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[first], np.add.reduceat(counts[order], first), tags[order][first]

    def add(self, keys: np.ndarray, tags: np.ndarray):
        if not len(keys):
            return
        keys, first, counts = np.unique(keys, return_index=True, return_counts=True)
        self.held.append((keys, counts, tags[first]))
        self.size += len(keys)
        if self.size > 2 * self.limit:
            merged = self._merged()
            self.held, self.size = [merged], len(merged[0])
            if self.size > self.limit:
                yield from self.rest()

    def rest(self):
        if self.held:
            yield self._merged()
        self.held, self.size = [], 0
