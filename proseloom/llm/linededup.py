"""Line dedup by winnowing over line hashes.

A document is the sequence of its lines that have a word.  From every line on, and up to every line, the shortest run of
lines with ``min_words`` words is a window; where it begins and ends depends on its lines alone, so a passage that
repeats has the same windows at every place.  Each window selects the first minimum of its line hashes; a selected place
is emitted once, with that hash as its fingerprint, however many windows select it.  Every repeated run of ``min_words``
words or more holds a whole window, so its fingerprint is guaranteed to be met.

1. Places are joined on their fingerprint to its first place (by id, then line), not to each other.
2. Each match is extended both ways, line by line, to a maximal run; runs of ``min_words`` words or more count.
3. A fingerprint may have come first in another passage.  Windows with a repeated fingerprint that no run of step 2 holds
   are looked up by their whole content, and those matches are extended in the same way.

The result is exact: a line goes if and only if it is part of a run of lines with ``min_words`` words or more that
occurred earlier in the table.  A line that thousands of documents share is joined to one place; that place is broadcast
where all first places are within ``small``'s bound of bytes, so that it is no hot key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proseloom.llm import textops
from proseloom.llm.store import drop_settled, narrow, settle, small

#: Words from which on a repeated run is deleted.
MIN_WORDS = 8

_PLACE = ["id", "row"]


def lines_of(run: textops.Run) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines with a word: hash (without white space at the ends), words, line number, and the offsets of documents."""
    found = textops.words(run)
    breaks = np.flatnonzero(run.data == 10)
    begins = np.union1d(run.starts[run.starts < run.ends], breaks + 1)
    begins = begins[begins < len(run.data)]
    owner = np.searchsorted(run.starts, begins, "right") - 1
    # Documents that begin at the same place as an empty one before them: the last is the one with text.
    stops = np.minimum(np.append(begins[1:], len(run.data)), run.ends[owner])
    a, b = np.searchsorted(found.starts, begins), np.searchsorted(found.starts, stops)
    number = np.arange(len(begins)) - np.searchsorted(begins, run.starts[owner])
    full = b > a
    a, b, owner, number = a[full], b[full], owner[full], number[full]
    hashes = textops.SpanHash(run.data)(found.starts[a], found.ends[b - 1]) if len(a) else np.zeros(0, np.uint64)
    return hashes, b - a, number, np.searchsorted(owner, np.arange(len(run.starts) + 1))


def windows(hashes: np.ndarray, words: np.ndarray, offsets: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last line of each window, and the line that it selects, as places in ``hashes``."""
    n = len(hashes)
    owner = textops.owners(offsets)
    heads, tails = offsets[owner], offsets[owner + 1] - 1
    sums = np.concatenate(([0], np.cumsum(words)))
    at = np.arange(n)
    ahead = np.searchsorted(sums, sums[:-1] + min_words) - 1
    behind = np.searchsorted(sums, sums[1:] - min_words, "right") - 1
    firsts = np.concatenate((at[ahead <= tails], behind[behind >= heads]))
    lasts = np.concatenate((ahead[ahead <= tails], at[behind >= heads]))
    both = np.unique(firsts * max(n, 1) + lasts)
    firsts, lasts = both // max(n, 1), both % max(n, 1)
    picks, step = firsts.copy(), 1
    while True:
        more = np.flatnonzero(firsts + step <= lasts)
        if not len(more):
            return firsts, lasts, picks
        next_ = firsts[more] + step
        picks[more] = np.where(hashes[next_] < hashes[picks[more]], next_, picks[more])
        step += 1


def contents(hashes: np.ndarray, firsts: np.ndarray, lasts: np.ndarray) -> np.ndarray:
    """64-bit hashes of runs of lines."""
    up, down = textops.powers(len(hashes) + 1)
    sums = np.concatenate(([np.uint64(0)], np.cumsum(hashes * up[: len(hashes)])))
    return textops.mix((sums[lasts + 1] - sums[firsts]) * down[firsts] + (lasts - firsts + 1).astype(np.uint64))


def _list(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values).cast(kind))


def _line_table(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """id, row (hash of the text), hashes, words and numbers of its lines, and the selected places with their fingerprints."""

    def cut(batches):
        for batch in batches:
            for run in textops.runs(batch.column(2)):
                hashes, words, number, offsets = lines_of(run)
                _, _, picks = windows(hashes, words, offsets, min_words)
                picks = np.unique(picks)
                cuts = np.searchsorted(picks, offsets)
                place = picks - np.repeat(offsets[:-1], np.diff(cuts))
                chosen = pa.StructArray.from_arrays([pa.array(place.astype(np.int32)), pa.array(hashes[picks].astype(np.int64))], names=["at", "fingerprint"])
                n, signed = len(run.starts), hashes.astype(np.int64)
                columns = [_list(signed, offsets, pa.int64()), _list(words, offsets, pa.int32()), _list(number, offsets, pa.int32()), pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), chosen)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(run.first, n), batch.column(1).slice(run.first, n), *columns], names=["id", "row", "hashes", "words", "numbers", "picks"])

    kind = docs.schema[id_col].dataType.simpleString()
    read = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"))
    made = narrow(read).mapInArrow(cut, f"id {kind}, row long, hashes array<long>, words array<int>, numbers array<int>, picks array<struct<at: int, fingerprint: long>>")
    return made.where(F.size("picks") > 0)


def _extended(matches: DataFrame, lines: DataFrame, min_words: int) -> DataFrame:
    """Maximal runs through matches (id, row, at, sid, srow, sat): places and line numbers in both documents, the words of a run at least ``min_words``."""
    grouped = matches.groupBy(*_PLACE, "sid", "srow").agg(F.collect_list("at").alias("at"), F.collect_list("sat").alias("sat"))
    grouped = settle(grouped, "matches")
    wanted = grouped.select(F.col("sid").alias("id"), F.col("srow").alias("row")).distinct()
    arrays = lines.dropDuplicates(_PLACE)
    source = settle(arrays.join(small(wanted), _PLACE, "left_semi").select(F.col("id").alias("sid"), F.col("row").alias("srow"), F.col("hashes").alias("theirs"), F.col("numbers").alias("source_numbers")), "sources")
    met = grouped.join(arrays.select(*_PLACE, "hashes", "words", "numbers"), _PLACE).join(small(source, 16 * F.size("theirs")), ["sid", "srow"])
    met = met.select(*_PLACE, "sid", "at", "sat", "hashes", "words", "numbers", "theirs", "source_numbers")

    def extend(batches):
        for batch in batches:
            rows, out = [], []
            for i, (at, sat) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())):
                mine, words, numbers, theirs, source_numbers = (batch.column(c)[i].values.to_numpy() for c in range(5, 10))
                done: dict[int, int] = {}
                for p, q in sorted(zip(at, sat)):
                    if done.get(p - q, -1) >= p:
                        continue
                    ahead = min(len(mine) - p, len(theirs) - q)
                    differ = np.flatnonzero(mine[p : p + ahead] != theirs[q : q + ahead])
                    last = p + (int(differ[0]) if len(differ) else ahead) - 1
                    behind = min(p, q)
                    differ = np.flatnonzero(mine[p - behind : p] != theirs[q - behind : q])
                    first = p - (behind - 1 - int(differ[-1]) if len(differ) else behind)
                    done[p - q] = last
                    if words[first : last + 1].sum() >= min_words:
                        rows.append(i)
                        out.append((first, last, int(numbers[first]), int(numbers[last]), int(source_numbers[first - p + q])))
            columns = list(zip(*out)) or [()] * 5
            took = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(took) for c in range(3)), *(pa.array(c, pa.int64()) for c in columns)], names=["id", "row", "source_id", "first", "last", "first_line", "last_line", "source_line"])

    kind = lines.schema["id"].dataType.simpleString()
    return narrow(met).mapInArrow(extend, f"id {kind}, row long, source_id {kind}, first long, last long, first_line long, last_line long, source_line long")


def _open_windows(lines: DataFrame, repeated: DataFrame, runs: DataFrame, min_words: int) -> DataFrame:
    """Windows with a repeated fingerprint: content, place, and whether no run holds them."""
    met = lines.dropDuplicates(_PLACE).select(*_PLACE, "hashes", "words").join(repeated, _PLACE)
    covered = runs.groupBy(*_PLACE).agg(F.collect_list("first").alias("firsts"), F.collect_list("last").alias("lasts"))
    met = met.join(covered, _PLACE, "left")

    def find(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                hashes, words, again = (batch.column(c)[i].values.to_numpy() for c in (2, 3, 4))
                hashes = hashes.astype(np.uint64)
                firsts, lasts, picks = windows(hashes, words, np.array([0, len(hashes)]), min_words)
                kept = np.isin(picks, again)
                firsts, lasts = firsts[kept], lasts[kept]
                free = np.ones(len(firsts), bool)
                for a, b in zip(*(batch.column(c)[i].as_py() or () for c in (5, 6))):
                    free &= (firsts < a) | (lasts > b)
                key = contents(hashes, firsts, lasts).astype(np.int64)
                same = pa.array(np.full(len(firsts), i))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(same), batch.column(1).take(same), pa.array(key), pa.array(firsts.astype(np.int32)), pa.array(free)], names=["id", "row", "content", "at", "open"])

    kind = lines.schema["id"].dataType.simpleString()
    return narrow(met).mapInArrow(find, f"id {kind}, row long, content long, at int, open boolean")


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Maximal later runs: id, row (hash of the text), first_line, last_line, source_id, source_line (where it came earlier)."""
    lines = settle(_line_table(docs, id_col, text_col, min_words), "lines")
    place = F.struct("id", "row", "at")
    places = lines.select(*_PLACE, F.explode("picks").alias("p")).select(*_PLACE, "p.at", "p.fingerprint")
    first = settle(places.groupBy("fingerprint").agg(F.min(place).alias("o"), F.max(place).alias("z")).where("o < z").select("fingerprint", "o"), "first")
    again = settle(places.join(small(first), "fingerprint").select(*_PLACE, "at", F.col("o.id").alias("sid"), F.col("o.row").alias("srow"), F.col("o.at").alias("sat")), "again")
    later = again.where(F.struct("id", "row", "at") > F.struct("sid", "srow", "sat"))
    runs = settle(_extended(later, lines, min_words), "runs")

    repeated = again.groupBy(*_PLACE).agg(F.collect_set("at").alias("repeated"))
    left = settle(_open_windows(lines, repeated, runs, min_words), "windows")
    wanted = left.where("open").select("content").distinct()
    origin = left.join(small(wanted), "content", "left_semi").groupBy("content").agg(F.min(place).alias("o"))
    more = left.where("open").join(small(settle(origin, "origins")), "content").where(F.struct("id", "row", "at") > F.col("o")).select(*_PLACE, "at", F.col("o.id").alias("sid"), F.col("o.row").alias("srow"), F.col("o.at").alias("sat"))
    out = settle(runs.unionByName(_extended(more, lines, min_words)).drop("first", "last").distinct(), "runs")
    drop_settled(lines, first, again, runs, left)
    return out


def _gaps(runs: Column) -> Column:
    """What runs of lines leave of a text: (start, length) of the stretches between them, up to the last run, and the lines that go."""
    none = F.array().cast("array<struct<start: long, length: long>>")
    state = F.struct(F.lit(0).cast("long").alias("at"), none.alias("kept"), F.lit(0).cast("long").alias("gone"))

    def step(s: Column, r: Column) -> Column:
        after = F.greatest(s["at"], r["last_line"] + 1)
        gap = F.struct(s["at"].alias("start"), (r["first_line"] - s["at"]).alias("length"))
        return F.struct(after.alias("at"), F.when(r["first_line"] > s["at"], F.array_append(s["kept"], gap)).otherwise(s["kept"]).alias("kept"), (s["gone"] + F.greatest(F.lit(0), after - F.greatest(s["at"], r["first_line"]))).alias("gone"))

    return F.aggregate(F.array_sort(runs), state, step)


def _without(text: Column, gaps: Column) -> Column:
    """A text without the lines outside ``gaps``; what follows the last run stays."""

    def keep(lines: Column) -> Column:
        stretches = F.transform(gaps["kept"], lambda g: F.slice(lines, (g["start"] + 1).cast("int"), g["length"].cast("int")))
        rest = F.slice(lines, (gaps["at"] + 1).cast("int"), F.greatest(F.size(lines) - gaps["at"].cast("int"), F.lit(0)))
        return F.array_join(F.concat(F.flatten(stretches), rest), "\n")

    return F.transform(F.array(F.split(text, "\n", -1)), keep)[0]


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Documents without the runs of lines that came earlier.

    Returns id, text, n_lines, n_removed (lines, with blank ones inside deleted runs) and the columns in ``carry``.  Lines
    compare without white space at their ends.  Null texts stay null with 0 lines, empty texts have one line; a document
    whose lines all go has an empty text.  Rows of one id with different texts are documents of their own, the one whose
    text has the smaller hash first; of those with equal texts neither counts as the later.  A null id takes no part.
    Runs are broadcast to the texts within ``small``'s bound; beyond it they are joined by a shuffle.  Other columns are
    not read.
    """
    runs = repeated_runs(docs, min_words, id_col, text_col).groupBy(F.col("id").alias("_id"), F.col("row").alias("_row")).agg(F.collect_set(F.struct("first_line", "last_line")).alias("_runs"))
    of_document = settle(runs.select("_id", "_row", _gaps(F.col("_runs")).alias("_gaps")), "gaps")
    whole, gaps = F.col(text_col), F.col("_gaps")
    joined = docs.select(id_col, text_col, *carry).join(small(of_document, 24 + 16 * F.size("_gaps.kept")), (F.col(id_col) == F.col("_id")) & (F.xxhash64(text_col) == F.col("_row")), "left")
    lines = F.when(whole.isNull(), 0).otherwise(F.size(F.split(whole, "\n", -1))).cast("long")
    return joined.select(id_col, F.when(gaps.isNull(), whole).otherwise(_without(whole, gaps)).alias("text"), lines.alias("n_lines"), F.coalesce(gaps["gone"], F.lit(0)).cast("long").alias("n_removed"), *carry)
