"""Periodic runs of words: stretches that repeat themselves with one period, four times over or more.

Block matching by scales.  At scale B, a power of two, periods of B to 2B - 1 words are sought: a run that repeats four
times holds one of the blocks of B words that start at multiples of B, and holds it again one period on.  The blocks go
into an automaton over word numbers, which is walked over the places that may repeat them; a block and an occurrence at
a distance of that scale seed an exact extension to both sides.  The shortest period of a run comes first, as scales
grow, so a longer period of the same stretch is known when it is met.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proseloom.llm.store import narrow

#: A run has at least so many words and repeats its period at least so often.
LEAST_WORDS, LEAST_TIMES = 6, 4
#: Words compared at first when a match is extended; the number doubles as long as all are equal.
STEP = 32

_NEVER = np.iinfo(np.int64).max


def _right(ids: np.ndarray, i: int, period: int) -> int:
    """The first place at or after i whose word differs from the one a period on, or the last place that has such a one."""
    size, last = STEP, len(ids) - period
    while i < last:
        stop = min(last, i + size)
        apart = ids[i:stop] != ids[i + period : stop + period]
        if apart.any():
            return i + int(apart.argmax())
        i, size = stop, size * 2
    return last


def _left(ids: np.ndarray, i: int, period: int) -> int:
    """The first place of the stretch that ends before i and repeats itself a period on."""
    size = STEP
    while i > 0:
        stop = max(0, i - size)
        apart = ids[stop:i] != ids[stop + period : i + period]
        if apart.any():
            return i - int(apart[::-1].argmax())
        i, size = stop, size * 2
    return 0


def _gaps(ids: np.ndarray) -> np.ndarray:
    """Words from each place to the next one of the same word."""
    out = np.full(len(ids), _NEVER)
    order = np.argsort(ids, kind="stable")
    same = ids[order[1:]] == ids[order[:-1]]
    out[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return out


def _seeds(ids: np.ndarray, starts: np.ndarray, begins: np.ndarray, ends: np.ndarray, size: int) -> Iterator[tuple[int, list[int]]]:
    """(start, later starts) of blocks that occur again wholly inside their stretch from ``begins`` to ``ends``."""
    automaton, keys, occurrences = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE), {}, []
    blocks = [tuple(ids[s : s + size].tolist()) for s in starts.tolist()]
    for key in blocks:
        if key not in keys:
            keys[key] = len(keys)
            automaton.add_word(key, keys[key])
            occurrences.append([])
    of = [keys[key] for key in blocks]
    del keys, blocks
    automaton.make_automaton()
    # The stretches, joined where they meet, so that each place is walked once.
    fresh = np.flatnonzero(np.append(True, begins[1:] > np.maximum.accumulate(ends)[:-1]))
    for begin, end in zip(begins[fresh].tolist(), np.maximum.reduceat(ends, fresh).tolist()):
        for at, key in automaton.iter(tuple(ids[begin:end].tolist())):
            occurrences[key].append(begin + at - size + 1)
    for s, key, begin, end in zip(starts.tolist(), of, begins.tolist(), ends.tolist()):
        found = occurrences[key]
        lo, hi = bisect_left(found, begin), bisect_right(found, end - size)
        if lo < hi:
            yield s, found[lo:hi]


def find_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, shortest period) of every run of a sequence of word numbers, by start and period."""
    n, found = len(ids), {}
    if n < LEAST_WORDS:
        return []
    gaps, size = _gaps(ids), 1
    while LEAST_TIMES * size <= n:
        # Every word of the block, and of the next one, comes again within the longest period of this scale.
        count = n // size
        again = gaps[: count * size].reshape(count, size).max(1) < 2 * size
        again[:-1] &= again[1:]
        starts = np.flatnonzero(again[:-1]) * size
        # A run of a shorter period that holds a block says all about occurrences that end within it.
        known = sorted((start, start + length) for start, length in found)
        begins, ends = starts + size, np.minimum(starts + 3 * size - 1, n)
        if known:
            reach = np.append(0, np.maximum.accumulate([end for _, end in known]))
            begins = np.maximum(begins, reach[np.searchsorted([start for start, _ in known], starts, "right")] - size + 1)
        open_ = begins + size <= ends
        if open_.any():
            done: dict[int, int] = {}
            for s, places in _seeds(ids, starts[open_], begins[open_], ends[open_], size):
                for place in places:
                    period = place - s
                    if s < done.get(period, 0):
                        continue
                    start, end = _left(ids, s, period), _right(ids, s + size, period)
                    done[period] = end
                    length = end + period - start
                    if length >= max(LEAST_WORDS, LEAST_TIMES * period):
                        found.setdefault((start, length), period)
        size *= 2
    return sorted((start, length, period) for (start, length), period in found.items())


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest exact length / period; of equal ones that of the smallest start, then period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """False for each word that some run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) == 0


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The periodic runs of whole texts, and the texts with each run collapsed to its first period.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0.  Returns id, n_words, runs (start, length, period, by start and
    period), the start, length, period and exponent_milli of the strongest run (null without runs) and collapsed, the
    kept words joined by a space.  Null and empty texts have no words, no runs and an empty collapsed text.  Repeated
    rows and ids are kept as they are; other columns of ``df`` are not read.  A map over partitions without a shuffle; a
    task holds the words of one text, and one scale's automaton over those blocks of it that may come again.
    """

    def scan(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                raw = (batch.column(1)[row].as_py() or "").encode()
                words = raw.split()
                numbers: dict[bytes, int] = {}
                ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
                del numbers
                runs = find_runs(ids)
                best = strongest(runs) or (None, None, None)
                if runs:
                    words = [words[i] for i in np.flatnonzero(kept_words(len(words), runs)).tolist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, 1),
                        pa.array([len(ids)], pa.int64()),
                        pa.array([[{"start": a, "length": b, "period": c} for a, b, c in runs]], pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))),
                        *(pa.array([x], pa.int64()) for x in best),
                        pa.array([1000 * best[1] // best[2] if runs else None], pa.int64()),
                        pa.array([b" ".join(words).decode()], pa.string()),
                    ],
                    names=[id_col, "n_words", "runs", "start", "length", "period", "exponent_milli", "collapsed"],
                )

    def gathered(batches):
        # Rows go back in batches of some megabytes, a very long text in one of its own.
        held, weight = [], 0
        for one in scan(batches):
            held.append(one)
            weight += one.nbytes
            if weight > 4 << 20 or len(held) >= 1024:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, weight = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, start long, length long, period long, exponent_milli long, collapsed string"
    return narrow(df).select(id_col, text_col).mapInArrow(gathered, schema)


def with_planted_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and text of all rows, one text in ten made periodic from one of its words on.

    With h the crc32 of the decimal id and g = floor(h / 10): where 10 divides h and the text has n > 0 words, word i >= a
    becomes word a + (i - a) % p, a = g % n, p = 1 + floor((n - a) / (3 + g % 8)).  Null ids plant nothing.
    """
    words = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    due = df.select(id_col, text_col, F.when(h % 10 == 0, words).alias("w"), F.floor(h / 10).alias("g"))
    due = due.withColumn("a", F.when(F.size("w") > 0, F.col("g") % F.size("w")).cast("int"))
    due = due.withColumn("p", (F.lit(1) + F.floor((F.size("w") - F.col("a")) / (F.lit(3) + F.col("g") % 8))).cast("int"))
    tail = F.transform(F.sequence(F.lit(0), F.size("w") - F.col("a") - 1), lambda k: F.get("w", F.col("a") + k % F.col("p")))
    planted = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), tail), " ")
    return due.select(id_col, F.when(F.col("a").isNotNull(), planted).otherwise(F.col(text_col)).alias(text_col))
