"""Toxicity from class-conditional Kneser-Ney models over character n-grams and words.

Each class has a Kneser-Ney model whose highest order (six bytes of lower-cased text) counts only its own documents;
all lower orders are continuation counts shared by both classes, so that an expression that is rare in one class backs
off to the same probability in both and decides nothing.  A document's evidence is the toxic minus the ordinary
log-likelihood, divided by length: over the whole text, and over its most toxic stretches of some fixed lengths, so that
one line in a long text counts.

A second pair of models does the same for words: each class has its own word counts, and both back off to shared
continuation counts, the number of different words before a word.  It tells an insult from ordinary words where few
documents are labelled; n-grams alone show it in its first letters only, as either class knows how a word goes on.  A
word that is rare in both classes is worth nothing.

Logistic weights turn those into a score between 0 and 1.

Counting covers every labelled training row but those that fit the weights, at most about ``WEIGHT_ROWS`` of a class
however many there are, and runs as Spark aggregations.  All n-grams, contexts and words that were
counted enter the scored model, which grows with the input: it lies in the folder that the cluster shares, in the order
of its keys.  A task sorts the keys of a run of texts and reads the model past them, a piece at a time; only a model of
at most ``HELD`` rows is held in memory.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proseloom.llm import textops
from proseloom.llm.store import BROADCAST_ROWS, drop_settled, held_out, narrow, settle

#: Bytes of an n-gram: the class models' highest order.
ORDER = 6
#: Kneser-Ney discount.
DISCOUNT = 0.75
#: A model of at most so many rows is held by each process; a larger one is read past every run of ``RUN_BYTES`` of text.
HELD, RUN_BYTES = 1 << 21, 4 << 20
#: Rows of a larger model that a task holds at a time.
PIECE = 1 << 20
#: Lengths of the stretches whose best log-likelihood ratio counts, in bytes.
STRETCHES = (24, 48, 96, 384)
#: The same in words; a word that occurs less often than ``RARE`` in the counted rows only backs off.
WORD_STRETCHES, RARE = (1, 2, 4, 16), 5
#: One in so many training rows fits the weights instead of the counts, but at most about ``WEIGHT_ROWS`` of a class.
FOLDS, WEIGHT_ROWS = 5, 2000
THRESHOLD = 0.3
#: N-grams that a task gathers before it adds them up.
GATHER = 1 << 21

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_LOW = np.uint64(0xFFFFFFFF)
#: Lower-cased letters and digits of ASCII and all bytes of other characters; the rest is a space between words.
_WORD_BYTES = np.full(256, 32, np.uint8)
for _b in (*b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", *range(128, 256)):
    _WORD_BYTES[_b] = textops.LOWER_ASCII[_b]


def grams(run: textops.Run, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams of a run at every place, and the offsets of documents; a shorter document has none."""
    data = textops.LOWER_ASCII[run.data].astype(np.uint64)
    n = max(0, len(data) - order + 1)
    keys = np.zeros(n, np.uint64)
    for i in range(order):
        keys <<= np.uint64(8)
        keys |= data[i : i + n]
    counts = np.maximum(run.ends - run.starts - order + 1, 0)
    offsets = np.concatenate(([0], np.cumsum(counts)))
    places = np.repeat(run.starts - offsets[:-1], counts) + np.arange(offsets[-1])
    return keys[places], offsets


def word_pairs(run: textops.Run) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of each word, low, and of the word before it, high (0 at the start), and the offsets of documents."""
    run = run._replace(data=_WORD_BYTES[run.data])
    found = textops.words(run)
    hashes = textops.SpanHash(run.data)(found.starts, found.ends) & _LOW
    before = np.concatenate((hashes[:0], np.zeros(min(1, len(hashes)), np.uint64), hashes[:-1]))
    before[found.offsets[:-1][np.diff(found.offsets) > 0]] = 0
    return before << np.uint64(32) | hashes, found.offsets


def count_grams(rows: DataFrame, keys_of=grams) -> DataFrame:
    """gram, toxic, ordinary: occurrences in the rows (text, toxic) of each class."""

    def count(batches):
        keys, sums = np.zeros(0, np.uint64), np.zeros((0, 2), np.int64)
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def add():
            nonlocal keys, sums, waiting, size
            every = np.concatenate([keys, *(k for k, _ in waiting)])
            flags = np.concatenate([np.zeros(len(keys), np.int64), *(c for _, c in waiting)])
            found, inverse = np.unique(every, return_inverse=True)
            out = np.zeros((len(found), 2), np.int64)
            out[inverse[: len(keys)]] += sums
            fresh, kinds = inverse[len(keys) :], flags[len(keys) :]
            out[:, 0] += np.bincount(fresh, kinds, len(found)).astype(np.int64)
            out[:, 1] += np.bincount(fresh, 1 - kinds, len(found)).astype(np.int64)
            keys, sums, waiting, size = found, out, [], 0

        def batch_of():
            return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(sums[:, 0]), pa.array(sums[:, 1])], names=["gram", "toxic", "ordinary"])

        for batch in batches:
            kinds = np.asarray(batch.column(1)).astype(np.int64)
            for run in textops.runs(batch.column(0)):
                found, offsets = keys_of(run)
                waiting.append((found, np.repeat(kinds[run.first : run.first + len(run.starts)], np.diff(offsets))))
                size += len(found)
                if size >= GATHER:
                    add()
                    if len(keys) >= GATHER:
                        yield batch_of()
                        keys, sums = np.zeros(0, np.uint64), np.zeros((0, 2), np.int64)
        if size:
            add()
        if len(keys):
            yield batch_of()

    counted = narrow(rows).select("text", "toxic").mapInArrow(count, "gram long, toxic long, ordinary long")
    return counted.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def _discounted(count: Column, total: Column, kinds: Column, lower: Column) -> Column:
    return (F.greatest(count - F.lit(DISCOUNT), F.lit(0.0)) + DISCOUNT * kinds * lower) / total


def shared_lower(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """suffix, p: the shared Kneser-Ney probability of the last byte after the other bytes of each suffix.

    The probability of order n rests on continuation counts, the number of different bytes seen before an n-gram in
    either class, and backs off to order n - 1; the lowest of the three orders backs off to the uniform one.
    """
    levels, seen = [], counts.select(F.col("gram").alias("key"))
    for n in range(order - 1, order - 4, -1):
        seen = seen.groupBy(F.col("key").bitwiseAND(F.lit((1 << (8 * n)) - 1)).alias("key")).count()
        levels.append(seen)
        seen = seen.select("key")
    lower = None
    for level in reversed(levels):
        totals = level.groupBy(F.shiftrightunsigned("key", 8).alias("context")).agg(F.sum("count").alias("total"), F.count("*").alias("kinds"))
        joined = level.withColumn("context", F.shiftrightunsigned("key", 8)).join(totals, "context")
        if lower is None:
            joined = joined.withColumn("below", F.lit(1 / 256))
        else:
            n = order - 1 - levels.index(level)
            joined = joined.withColumn("suffix", F.col("key").bitwiseAND(F.lit((1 << (8 * (n - 1))) - 1))).join(lower.select("suffix", F.col("p").alias("below")), "suffix").drop("suffix")
        lower = joined.select(F.col("key").alias("suffix"), _discounted(F.col("count"), F.col("total"), F.col("kinds"), F.col("below")).alias("p"))
    return lower


def ratios(counts: DataFrame, order: int = ORDER) -> tuple[DataFrame, DataFrame]:
    """(gram, ratio) of what was seen and (context, ratio) for what was not seen after a context; all that were counted."""
    # The mass that backs off: the discount of each n-gram.
    rest = lambda c: F.sum(F.least(F.col(c), F.lit(DISCOUNT)))
    contexts = counts.groupBy(F.shiftrightunsigned("gram", 8).alias("context")).agg(F.sum("toxic").alias("tt"), rest("toxic").alias("tr"), F.sum("ordinary").alias("ot"), rest("ordinary").alias("or"))
    joined = (
        counts.withColumn("context", F.shiftrightunsigned("gram", 8))
        .withColumn("suffix", F.col("gram").bitwiseAND(F.lit((1 << (8 * (order - 1))) - 1)))
        .join(contexts, "context")
        .join(shared_lower(counts, order), "suffix")
    )
    in_class = lambda c, t, r: F.log(F.when(F.col(t) > 0, (F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) + F.col(r) * F.col("p")) / F.col(t)).otherwise(F.col("p")))
    back = lambda t, r: F.log(F.when(F.col(t) > 0, F.col(r) / F.col(t)).otherwise(F.lit(1.0)))
    seen = joined.select("gram", (in_class("toxic", "tt", "tr") - in_class("ordinary", "ot", "or")).alias("ratio"))
    unseen = contexts.select(F.col("context").alias("gram"), (back("tt", "tr") - back("ot", "or")).alias("ratio"))
    return seen, unseen


def word_ratios(pairs: DataFrame) -> DataFrame:
    """(word, ratio) of the words that are not rare, against that of a word never seen.

    Kneser-Ney with a uniform lowest order makes the shared probability of a word its share of the different pairs.
    """
    words = settle(pairs.groupBy(F.col("gram").bitwiseAND(F.lit(0xFFFFFFFF)).alias("word")).agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"), F.count("*").alias("kinds")), "words")
    whole = words.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("toxic", "ordinary", "kinds"))).first()
    kept = F.col("toxic") + F.col("ordinary") >= RARE
    classes = [c for c in ("toxic", "ordinary") if whole[c]]
    if len(classes) < 2:
        return words.where("false").select("word", F.lit(0.0).alias("ratio"))
    rest = words.agg(*(F.sum(F.when(kept, F.least(F.col(c), F.lit(DISCOUNT))).otherwise(F.col(c))).alias(c) for c in classes)).first()
    # Probability in a class over what backing off alone would give.
    over = lambda c: F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) / (rest[c] * F.col("kinds") / whole["kinds"]) + 1
    return words.where(kept).select("word", F.log(over("toxic") / over("ordinary")).alias("ratio"))


class Lookup:
    """Open-addressed table from 64-bit keys to ratios; keys are looked up by whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        size = 1 << max(4, int(2 * len(keys)).bit_length())
        self.mask = np.uint64(size - 1)
        self.keys, self.values = np.full(size, _EMPTY, np.uint64), np.zeros(size, np.float32)
        left, slot = np.arange(len(keys)), textops.mix(keys) & self.mask
        while len(left):
            free = self.keys[slot] == _EMPTY
            at, first = np.unique(slot[free], return_index=True)
            placed = np.flatnonzero(free)[first]
            self.keys[at], self.values[at] = keys[left[placed]], values[left[placed]]
            rest = np.ones(len(left), bool)
            rest[placed] = False
            left, slot = left[rest], (slot[rest] + np.uint64(1)) & self.mask

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 where absent), and which keys are there."""
        slot = textops.mix(keys) & self.mask
        there = self.keys[slot]
        hit = there == keys
        out = np.where(hit, self.values[slot], np.float32(0))
        left = np.flatnonzero(~hit & (there != _EMPTY))
        slot = slot[left]
        while len(left):
            slot = (slot + np.uint64(1)) & self.mask
            there = self.keys[slot]
            found = there == keys[left]
            out[left[found]], hit[left[found]] = self.values[slot[found]], True
            on = ~found & (there != _EMPTY)
            left, slot = left[on], slot[on]
        return out, hit


def _pieces(files: list[str]):
    """Keys and ratios of a stored table, up to ``PIECE`` rows at a time."""
    for file in files:
        system, path = pyarrow.fs.FileSystem.from_uri(file)
        with system.open_input_file(path) as opened:
            for batch in pyarrow.parquet.ParquetFile(opened).iter_batches(PIECE):
                if batch.num_rows:
                    yield batch.column(0).to_numpy().astype(np.uint64), batch.column(1).to_numpy()


class Filed:
    """A table of ratios that stays in files, each in the order of its keys; ``Lookup`` for tables of any size."""

    def __init__(self, files: list[str]):
        self.files = files

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 where absent), and which keys are there."""
        out, hit = np.zeros(len(keys), np.float32), np.zeros(len(keys), bool)
        if not len(keys):
            return out, hit
        order = np.argsort(keys)
        ordered = keys[order]
        for there, values in _pieces(self.files):
            a, b = np.searchsorted(ordered, there[0]), np.searchsorted(ordered, there[-1], "right")
            at = np.searchsorted(there, ordered[a:b])
            found = there[at] == ordered[a:b]
            places = order[a:b][found]
            out[places], hit[places] = values[at[found]], True
        return out, hit


def _stretches(ratio: np.ndarray, offsets: np.ndarray, widths: tuple[int, ...]) -> np.ndarray:
    """A row for each document: ratio a place, and the best stretch of each width."""
    out = np.zeros((len(offsets) - 1, len(widths) + 1))
    for i in range(len(out)):
        part = ratio[offsets[i] : offsets[i + 1]]
        n = len(part)
        if n:
            sums = np.zeros(n + 1)
            np.cumsum(part, out=sums[1:])
            out[i, 0] = sums[-1] / n
            for j, w in enumerate(widths):
                out[i, j + 1] = ((sums[w:] - sums[:-w]).max() if n > w else sums[-1]) / w
    return out


def evidence(run: textops.Run, seen: Lookup | Filed, unseen: Lookup | Filed, words: Lookup | Filed) -> np.ndarray:
    """A row for each document: ratios and best stretches of its bytes and of its words, log of the length."""
    keys, offsets = grams(run)
    ratio, known = seen(keys)
    rest = np.flatnonzero(~known)
    ratio[rest] = unseen(keys[rest] >> np.uint64(8))[0]
    pairs, word_offsets = word_pairs(run)
    of_words = words(pairs & _LOW)[0]
    return np.hstack([_stretches(ratio, offsets, STRETCHES), _stretches(of_words, word_offsets, WORD_STRETCHES), np.log1p(np.diff(offsets))[:, None]])


def fit_weights(rows: np.ndarray, labels: np.ndarray, penalty: float = 3.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge-penalised logistic regression by Newton steps, so that few rows move weights little: weights with the constant last, means and deviations of the columns."""
    mean, spread = rows.mean(0), rows.std(0) + 1e-9
    x = np.hstack([(rows - mean) / spread, np.ones((len(rows), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty * np.eye(len(w)), x.T @ (p - labels) + penalty * np.append(w[:-1], 0))
    return w, mean, spread


class Model:
    """What scoring reads; small tables are built once per process, others stay in their files."""

    _built: dict[str, tuple[Lookup, ...]] = {}

    def __init__(self, name: str, *tables: tuple[list[str], int]):
        """``tables``: files and rows of n-grams seen, of contexts, and of words."""
        self.name, self.files = name, [files for files, _ in tables]
        self.held = sum(rows for _, rows in tables) <= HELD
        self.run_bytes = textops.RUN_BYTES if self.held else RUN_BYTES
        self.weights: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def tables(self) -> tuple[Lookup | Filed, ...]:
        if not self.held:
            return tuple(map(Filed, self.files))
        if self.name not in self._built:
            self._built.clear()
            empty = (np.zeros(0, np.uint64), np.zeros(0, np.float32))
            self._built[self.name] = tuple(Lookup(*map(np.concatenate, zip(empty, *_pieces(files)))) for files in self.files)
        return self._built[self.name]

    def score(self, rows: np.ndarray) -> np.ndarray:
        w, mean, spread = self.weights
        return 1 / (1 + np.exp(-np.clip(np.hstack([(rows - mean) / spread, np.ones((len(rows), 1))]) @ w, -30, 30)))


def _stored(df: DataFrame, what: str) -> tuple[list[str], int]:
    """Files and rows of a table (key, ratio), written in ranges of keys and in their order."""
    key, ratio = df.columns
    whole = settle(df.select(F.col(key).alias("key"), F.col(ratio).cast("float").alias("ratio")), what)
    rows = whole.count()
    ordered = settle(whole.repartitionByRange(max(1, -(-rows // PIECE)), "key").sortWithinPartitions("key"), what)
    drop_settled(whole)
    return sorted(ordered.inputFiles()), rows


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model | None:
    """The model of all labelled rows that are not held out; None if a class has none.

    Labels are broadcast up to ``BROADCAST_ROWS`` rows and joined by a shuffle beyond.  Several labels of one document
    count as toxic if any is.
    """
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(F.max(label_col).alias("toxic"))
    marks = marks.withColumn("toxic", (F.col("toxic") > 0).cast("int"))
    sizes = {r[0]: r[1] for r in marks.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return None
    if sum(sizes.values()) <= BROADCAST_ROWS:
        marks = F.broadcast(marks)
    kept = {c: min(1.0, FOLDS * WEIGHT_ROWS / sizes[c]) for c in (0, 1)}
    fold = F.crc32(F.concat(F.lit("weights"), F.col(id_col).cast("string")).cast("binary")) % FOLDS == 0
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 30)) / float(1 << 30)
    drawn = fold & (draw < F.when(F.col("toxic") == 1, kept[1]).otherwise(kept[0]))
    known = docs.select(id_col, F.coalesce(text_col, F.lit("")).alias("text")).join(marks, id_col)
    counts = settle(count_grams(known.where(~drawn)), "grams")
    pairs = settle(count_grams(known.where(~drawn), word_pairs), "pairs")
    tables = [_stored(t, what) for t, what in zip((*ratios(counts), word_ratios(pairs)), ("seen", "unseen", "words"))]
    model = Model(str(tables[0][0][:1]), *tables)

    rows = _evidence(known.where(drawn), model, "toxic").toArrow()
    x, y = np.array(rows.column("evidence").to_pylist(), float).reshape(rows.num_rows, -1), rows.column("toxic").to_numpy()
    if len(set(y.tolist())) < 2:
        return None
    # Rows of the larger class stand for all that were not drawn.
    w, mean, spread = fit_weights(x, y)
    w[-1] += np.log(kept[0] / kept[1])
    model.weights = w, mean, spread
    return model


def _evidence(df: DataFrame, model: Model, *keep: str) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(model)

    def measure(batches):
        tables = shared.value.tables()
        for batch in batches:
            for run in textops.runs(batch.column(0), shared.value.run_bytes):
                rows = evidence(run, *tables)
                yield pa.RecordBatch.from_arrays([*(batch.column(i + 1).slice(run.first, len(rows)) for i in range(len(keep))), pa.array(list(rows), pa.list_(pa.float64()))], names=[*keep, "evidence"])

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return narrow(df).select("text", *keep).mapInArrow(measure, f"{schema}, evidence array<double>")


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", model: Model | None = None) -> DataFrame:
    """Toxicity of every whole text: id, held_out, score (0 to 1), predicted (1 from ``THRESHOLD`` on).

    Null texts count as empty; empty and very short texts get the score of no evidence.  If a class has no training
    row every score is 0.  Scores read the text only; repeated rows get equal scores; other columns are not read.
    """
    model = model or train(docs, labels, id_col, text_col, label_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches):
        found = shared.value
        for batch in batches:
            for run in textops.runs(batch.column(1), found.run_bytes if found else textops.RUN_BYTES):
                n = len(run.starts)
                scores = found.score(evidence(run, *found.tables())) if found else np.zeros(n)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(run.first, n), batch.column(2).slice(run.first, n), pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))], names=[id_col, "held_out", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return narrow(docs).select(id_col, text_col, held_out(id_col).alias("held_out")).mapInArrow(judge, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")
