"""Vectorised text primitives shared by the operators of this subpackage.

Everything works on one flat UTF-8 byte array that holds a run of documents, so a task handles megabytes of
text with a few numpy passes.  Runs are cut by bytes (``runs``), which bounds the memory of a task whatever the
number of rows in an Arrow batch or the length of a single text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text that one numpy pass holds at a time (one longer document makes a longer run).
RUN_BYTES = 1 << 20

_RANDOM = np.random.default_rng(20240229)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_VALUES = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_SLOT_FACTORS = _RANDOM.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER_ASCII = np.arange(256, dtype=np.uint8)
LOWER_ASCII[65:91] += 32


class Run(NamedTuple):
    """Documents ``first .. first + len(starts)`` of a batch; ``data[starts[i]:ends[i]]`` is the text of one."""

    first: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


class Words(NamedTuple):
    """Word spans in a run; ``offsets[i]:offsets[i + 1]`` are the words of document i."""

    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray


def runs(texts: pa.Array, limit: int = RUN_BYTES) -> Iterator[Run]:
    """Cuts a string column into runs of whole documents; null texts are empty."""
    if pa.types.is_large_string(texts.type):
        width = np.int64
    else:
        texts, width = texts.cast(pa.string()), np.int32
    n = len(texts)
    if not n:
        return
    _, places, data = texts.buffers()
    offsets = np.frombuffer(places, width)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if texts.null_count:
        lengths = np.where(np.asarray(texts.is_valid()), np.diff(offsets), 0)
    else:
        lengths = np.diff(offsets)
    cut = 0
    while cut < n:
        stop = int(np.searchsorted(offsets, offsets[cut] + limit, "right")) - 1
        stop = min(n, max(stop, cut + 1))
        at = offsets[cut]
        begins = offsets[cut:stop] - at
        yield Run(cut, raw[at : offsets[stop]], begins, begins + lengths[cut:stop])
        cut = stop


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(run: Run) -> Words:
    """Maximal sequences of bytes other than space, tab, LF, VT, FF and CR; never across documents."""
    inside = ~_IS_SPACE[run.data]
    edge = np.zeros(len(inside) + 1, bool)
    edge[run.starts] = True
    edge[run.ends] = True
    before = np.empty(len(inside), bool)
    before[:1] = False
    before[1:] = inside[:-1]
    after = np.empty(len(inside), bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    begin = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return Words(begin, end, np.append(np.searchsorted(begin, run.starts), len(begin)))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, at least n of each."""
    global _POWERS
    if len(_POWERS[0]) < n:
        size = max(n, RUN_BYTES + 4096)
        _POWERS = tuple(np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(size - 1, b, np.uint64)))) for b in (_BASE, _BASE_INVERSE))
    return _POWERS


_POWERS: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


class SpanHash:
    """64-bit hashes of any byte spans of a run, from one prefix sum."""

    def __init__(self, data: np.ndarray, fold: bool = False):
        up, self.down = powers(len(data) + 1)
        values = (_BYTE_VALUES[LOWER_ASCII] if fold else _BYTE_VALUES)[data]
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values * up[: len(data)], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        spans = (self.sums[ends] - self.sums[starts]) * self.down[starts]
        return mix(spans + (ends - starts).astype(np.uint64) * _SLOT_FACTORS[63])


def sequence_hash(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k neighbouring values; the caller drops those that cross documents."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n] * _SLOT_FACTORS[0]
    for i in range(1, k):
        out += hashes[i : i + n] * _SLOT_FACTORS[i]
    return mix(out)


def owners(offsets: np.ndarray) -> np.ndarray:
    """The document of each of the items that ``offsets`` deals out."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def per_document(flags: np.ndarray, run: Run) -> np.ndarray:
    """Counts of set bytes in each document."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[run.ends] - sums[run.starts]


def repeated(keys: np.ndarray) -> np.ndarray:
    """True for each key that occurs twice or more."""
    if len(keys) < 2:
        return np.zeros(len(keys), bool)
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(twice, keys)
    at[at == len(twice)] = 0
    return twice[at] == keys


def shingles(run: Run, size: int, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct word-shingle hashes of each document of a run, end to end, and the offsets of documents.

    A document with fewer words than ``size`` has one shingle, its whole word sequence; one without words has none.
    """
    found = words(run)
    hashes = SpanHash(run.data, fold)(found.starts, found.ends)
    counts = np.diff(found.offsets)
    keys = sequence_hash(hashes, size)
    owner = owners(found.offsets)
    whole = owner[: len(keys)] == owner[size - 1 :] if len(keys) else np.zeros(0, bool)
    keys, owner = keys[whole], owner[: len(keys)][whole]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        tails = np.array([int(sequence_hash(hashes[a:b], b - a)[0]) for a, b in zip(found.offsets[short], found.offsets[short + 1])], np.uint64)
        keys, owner = np.concatenate((keys, mix(tails + counts[short].astype(np.uint64)))), np.concatenate((owner, short))
    order = np.lexsort((keys, owner)) if len(short) else _within(keys, owner)
    keys, owner = keys[order], owner[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    keys, owner = keys[fresh], owner[fresh]
    return keys, np.append(np.searchsorted(owner, np.arange(len(counts))), len(owner))


def _within(keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Sorts keys inside each owner; owners are in order already."""
    order = np.argsort(keys, kind="stable")
    return order[np.argsort(owner[order].astype(np.uint32), kind="stable")]
