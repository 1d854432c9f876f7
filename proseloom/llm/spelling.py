"""Spelling variants: words one edit apart, grouped under their most frequent neighbours.

Full neighbourhood generation: of each word all distinct deletions, replacements and insertions over the letters that
the vocabulary holds are made, and meet the vocabulary by equality, so that no distance is computed.  Candidates are
made as hashes, by sums over the word's letters; a bit table of the vocabulary's hashes tells nearly all that are no
words, and only the rest become strings, are shuffled and meet the vocabulary.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proseloom.llm.store import drop_settled, narrow, settle, small
from proseloom.llm.textops import mix

#: Letters of words, where the caller names no others.
LETTERS = "A-Za-zÀ-ÿ"
#: Distinct words that a counting task holds before it hands them on.
HELD_WORDS = 200_000
#: Bits of the table a word, those set, and the most bits in all (32 MB); beyond it more candidates pass, and the join drops them.
BITS_A_WORD, PROBES, MOST_BITS = 24, 4, 1 << 28
#: Hashes of candidates that a task holds at a time.
CANDIDATES = 1 << 21

_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def word_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters: str = LETTERS, least_length: int = 5, least_count: int = 3, drop_every: int | None = None) -> DataFrame:
    """(word, n): maximal runs of letters in whole texts, A-Z in lower case, with their occurrences in all rows.

    Words have ``least_length`` code points or more and occur ``least_count`` times or more.  With ``drop_every`` a run
    whose crc32 h of ``<id>:<run>`` it divides loses its code point h % length first (planted misspellings).  Null and
    empty texts have no words; a null id counts as the empty string there.  Tasks count before rows are shuffled, so a
    word that every text holds is a row or two a task.  Other columns of ``df`` are not read.
    """
    find = re.compile(f"[{letters}]+").findall

    def count(batches):
        held: Counter = Counter()

        def rows():
            table = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return table

        for batch in batches:
            for row in range(batch.num_rows):
                # Of UTF-8 bytes, lower() changes A-Z only.
                words = Counter(find((batch.column(1)[row].as_py() or "").encode().lower().decode()))
                if drop_every:
                    seed = zlib.crc32(f"{batch.column(0)[row].as_py() or ''}:".encode())
                    for word in list(words):
                        h = zlib.crc32(word.encode(), seed)
                        if h % drop_every == 0:
                            n = words.pop(word)
                            held[word[: h % len(word)] + word[h % len(word) + 1 :]] += n
                held.update(words)
                if len(held) > HELD_WORDS:
                    yield rows()
        yield rows()

    found = narrow(df).select(F.col(id_col).cast("string"), text_col).mapInArrow(count, "word string, n long")
    return found.where(F.length("word") >= least_length).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class Hashes:
    """Hashes of words and of all their edits, from the letters of many words laid end to end."""

    def __init__(self, words: list[str], alphabet: np.ndarray):
        self.letters = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        self.alphabet = alphabet.astype(np.uint32)
        lengths = np.array([len(w) for w in words], np.int64)
        self.first = np.append(0, np.cumsum(lengths))
        self.word = np.repeat(np.arange(len(words)), lengths)
        self.place = np.arange(len(self.letters)) - self.first[self.word]
        self.up = np.multiply.accumulate(np.append(np.uint64(1), np.full(int(lengths.max(initial=0)) + 1, _STEP)))
        self.sums = np.append(np.uint64(0), np.cumsum(self._value(self.letters) * self.up[self.place]))
        self.whole = self.sums[self.first[1:]] - self.sums[self.first[:-1]]

    @staticmethod
    def _value(letters: np.ndarray) -> np.ndarray:
        return mix(letters.astype(np.uint64) * _STEP + np.uint64(1)) | np.uint64(1)

    def words(self) -> np.ndarray:
        return mix(self.whole)

    def edits(self):
        """(hash, word, place, letter or -1, letters taken out), a block at a time; each distinct edited word once."""
        step = max(1, CANDIDATES // (2 * len(self.alphabet) + 1))
        values = self._value(self.alphabet)
        for at in range(0, len(self.letters), step):
            i = np.arange(at, min(at + step, len(self.letters)))
            word, place, letter = self.word[i], self.place[i], self.letters[i]
            left, whole, up = self.sums[i] - self.sums[self.first[word]], self.whole[word], self.up[place]
            own = self._value(letter) * up
            # Of equal neighbours the first is deleted; a letter goes in after its equals.
            new = (place == 0) | (letter != self.letters[i - 1])
            yield mix(left + (whole - left - own) * _BACK)[new], word[new], place[new], np.full(int(new.sum()), -1), 1
            other = letter[:, None] != self.alphabet
            at_row, at_letter = np.nonzero(other)
            put = values * up[:, None]
            yield mix(whole[:, None] - own[:, None] + put)[other], word[at_row], place[at_row], at_letter, 1
            yield mix((left + (whole - left) * _STEP)[:, None] + put)[other], word[at_row], place[at_row], at_letter, 0
            last = np.flatnonzero(place == self.first[word + 1] - self.first[word] - 1)
            if len(last):
                ends = mix(whole[last][:, None] + values * self.up[place[last] + 1][:, None])
                yield ends.ravel(), np.repeat(word[last], len(values)), np.repeat(place[last] + 1, len(values)), np.tile(np.arange(len(values)), len(last)), 0


def _places(hashes: np.ndarray, probe: int, size: int) -> np.ndarray:
    """The bit of each hash for one of the probes, in a table of ``size`` bits, a power of two."""
    return ((hashes if not probe else mix(hashes ^ np.uint64(probe))) & np.uint64(size - 1)).astype(np.int64)


def _bit_table(vocabulary: DataFrame, n_words: int) -> np.ndarray:
    """The bits of all words; tasks set those of their words and hand on a row for each 64 bits that hold one, at most 4 M in all."""
    size = 1 << min(MOST_BITS.bit_length() - 1, max(10, (BITS_A_WORD * n_words - 1).bit_length()))

    def mark(batches):
        for batch in batches:
            words = batch.column(0).to_pylist()
            if words:
                hashes = Hashes(words, np.zeros(0, np.uint32)).words()
                at = np.unique(np.concatenate([_places(hashes, probe, size) for probe in range(PROBES)]))
                slots, first = np.unique(at >> 6, return_index=True)
                held = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first)
                yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(held.view(np.int64))], names=["slot", "held"])

    rows = narrow(vocabulary.select("word")).mapInArrow(mark, "slot long, held long").groupBy("slot").agg(F.bit_or("held").alias("held")).toArrow()
    table = np.zeros(size >> 6, np.uint64)
    table[rows.column("slot").to_numpy()] = rows.column("held").to_numpy().view(np.uint64)
    return table.view(np.uint8)


def neighbours(vocabulary: DataFrame) -> DataFrame:
    """(word, n_near, near, near_n): of each word of a settled vocabulary (word, n) with near words their number, and the
    one of largest n, of equal ones the smallest.

    Every edit of a word that may be a word is a row (edit, word, n), and the rows of one edit are all words near to it, as
    nearness goes both ways: one aggregation by edit, joined to the words that there are, is the whole answer.  An edit has
    no more rows than a word has edits, so no key is hot.
    """
    n_words = vocabulary.count()
    letters = vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("letter")).distinct().where("letter <> ''")
    alphabet = np.array(sorted(ord(r.letter) for r in letters.toLocalIterator()), np.uint32)
    spark = vocabulary.sparkSession
    table = spark.sparkContext.broadcast(_bit_table(vocabulary, n_words))

    def emit(batches):
        bits = table.value
        size = len(bits) << 3
        for batch in batches:
            words, counts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if not words or not len(alphabet):
                continue
            for hashes, word, place, letter, out in Hashes(words, alphabet).edits():
                there = np.arange(len(hashes))
                for probe in range(PROBES):
                    at = _places(hashes if not probe else hashes[there], probe, size)
                    there = there[(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)]
                made, of = [], word[there].tolist()
                for w, i, a in zip(of, place[there].tolist(), letter[there].tolist()):
                    text = words[w]
                    made.append(text[:i] + (chr(alphabet[a]) if a >= 0 else "") + text[i + out :])
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(made, pa.string()), pa.array([words[w] for w in of], pa.string()), pa.array([counts[w] for w in of], pa.int64())], names=["word", "near", "near_n"])

    # Words are dealt out anew: a vocabulary of a few files would keep few tasks busy.
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    candidates = narrow(vocabulary.select("word", "n").repartition(tasks, "word")).mapInArrow(emit, "word string, near string, near_n long")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near")))
    found = candidates.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b.near").alias("near"), (-F.col("b.less")).alias("near_n"))
    return found.join(vocabulary.select("word"), "word", "left_semi")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of each word's chain of forms, from (word, form); pointers double, so rounds are the log of the longest chain."""
    current = settle(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = current.alias("a").join(small(current.select(F.col("word").alias("root"), F.col("root").alias("next"))), "root", "left")
        found = settle(step.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        drop_settled(current)
        current = found
        if not found.where("moved").limit(1).count():
            return found.select("word", "root")


def spelling_groups(counts: DataFrame) -> DataFrame:
    """Groups words (word, n) under their forms.

    Two words are near if one inserted, deleted or replaced code point makes one of the other.  A word's form is its near
    word of largest n, of equal ones the smallest in code-point order, if that n is at least twice its own.  Returns word,
    form (or null), root (the end of the chain of forms, the word itself without one), n, n_near and form_n.  Words are
    taken as distinct and not null; an empty table gives none.  A chain doubles n at each step, so it is short.
    """
    vocabulary = settle(counts.select("word", F.col("n").cast("long").alias("n")), "vocabulary")
    joined = vocabulary.join(neighbours(vocabulary), "word", "left")
    held = F.col("near_n") >= 2 * F.col("n")
    made = settle(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(held, F.col("near")).alias("form"), F.when(held, F.col("near_n")).alias("form_n")), "forms")
    drop_settled(vocabulary)
    roots = _roots(made.where("form IS NOT NULL"))
    return made.join(small(roots), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
