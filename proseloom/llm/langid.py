"""Language identification with a blended-spectrum string kernel.

Two texts have as kernel the number of character n-grams of 1 to 3 letters that both contain, over the geometric mean
of their numbers of n-grams.  Nystrom landmarks give the kernel's features, kernel ridge regression one function for
each language.  The kernel is a scalar product of n-gram presence vectors, so landmarks and regression fold into one
matrix, and documents are scored by batched products of their presence matrix with it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proseloom.llm.store import held_out, narrow

#: N-grams are held in so many cells.
CELLS = 1 << 16
#: Documented bounds of the fit: training rows of each language, about, and landmarks of each.  Whole texts count.
TRAIN_ROWS, LANDMARKS = 400, 40
RIDGE = 1e-3
#: Rows of a scored block.
BLOCK = 64
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")
_FACTORS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def cells(text: str) -> np.ndarray:
    """Cells of the 1- to 3-grams of a text, lower-cased; repeated ones are repeated."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out, key = [], np.zeros(len(points), np.uint64)
    for n in range(3):
        key = (key[: len(points) - n] if n else key) * _FACTORS[1] + points[n:]
        out.append(((key + np.uint64(n + 1)) * _FACTORS[0] ^ (key >> np.uint64(29)) * _FACTORS[2]) >> np.uint64(48))
        if len(points) <= n + 1:
            break
    return np.concatenate(out).astype(np.int64)


def presence(texts: list[str | np.ndarray]) -> np.ndarray:
    """Rows of 0 and 1 over the cells, of texts or of their cells."""
    out = np.zeros((len(texts), CELLS), np.float32)
    for row, text in zip(out, texts):
        if len(text):
            row[cells(text) if isinstance(text, str) else text] = 1
    return out


class Model:
    """``languages`` and the folded matrix: a column for each language and, last, ones that count a text's cells."""

    def __init__(self, languages: list[str], matrix: np.ndarray, bias: np.ndarray):
        self.languages, self.matrix, self.bias = languages, matrix, bias

    def decide(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the best language and its softmax share, for each text."""
        product = presence(texts) @ self.matrix
        values = product[:, :-1] / np.sqrt(np.maximum(product[:, -1:], 1)) + self.bias
        odds = np.exp(4 * (values - values.max(1, keepdims=True)))
        return values.argmax(1), (odds / odds.sum(1, keepdims=True)).max(1)


def fit(texts: list[str | np.ndarray], languages: list[str]) -> Model | None:
    """Nystrom kernel ridge regression, one against the rest, on texts or their cells."""
    names = sorted(set(languages))
    if not names:
        return None
    label = np.array([names.index(x) for x in languages])
    picks = np.concatenate([np.flatnonzero(label == i)[:LANDMARKS] for i in range(len(names))])

    def unit(rows: np.ndarray) -> np.ndarray:
        return rows / np.sqrt(np.maximum(rows.sum(1, keepdims=True), 1))

    marks = unit(presence([texts[i] for i in picks]))
    near = marks @ marks.T
    values, vectors = np.linalg.eigh(near.astype(np.float64))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    features = np.concatenate([unit(presence(texts[i : i + BLOCK])) @ marks.T for i in range(0, len(texts), BLOCK)]).astype(np.float64) @ root
    target = np.where(label[:, None] == np.arange(len(names)), 1.0, -1.0)
    mean, centre = features.mean(0), target.mean(0)
    inner = features - mean
    weights = np.linalg.solve(inner.T @ inner + RIDGE * len(texts) * np.eye(inner.shape[1]), inner.T @ (target - centre))
    folded = marks.T.astype(np.float64) @ (root @ weights)
    return Model(names, np.hstack([folded, np.ones((CELLS, 1))]).astype(np.float32), (centre - mean @ weights).astype(np.float32))


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Fits on about ``TRAIN_ROWS`` rows of each language at most, drawn by a hash of the id among rows not held out."""
    usable = df.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    totals = {r[0]: r[1] for r in usable.groupBy(lang_col).count().collect()}
    if not totals:
        return None
    share = F.create_map(*(F.lit(x) for lang, n in totals.items() for x in (lang, min(1.0, TRAIN_ROWS / n))))
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 30)) / float(1 << 30)
    drawn = usable.where(draw < share[F.col(lang_col)]).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))

    def reduce(batches):
        # Whole texts are read here; their distinct cells, at most CELLS of them, go to the fit.
        for batch in batches:
            held = [np.unique(cells(x)).astype("<u2").tobytes() if x else b"" for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.binary()), batch.column(2)], names=["id", "cells", "lang"])

    rows = sorted((tuple(r) for r in narrow(drawn).mapInArrow(reduce, "id string, cells binary, lang string").collect()), key=lambda r: (r[2], r[0], bytes(r[1])))
    return fit([np.frombuffer(r[1], "<u2").astype(np.int64) for r in rows], [r[2] for r in rows])


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: Model | None = None) -> DataFrame:
    """The language of every whole text: id, held_out, lang_pred, score.

    ``und`` with score 0 where the text is null, has no letter, or nothing could be learned.  The score is the softmax
    share of the chosen language.  Equal values go to the first language in order.  Repeated rows are scored one by
    one; the prediction reads the text only.
    """
    model = model or train(df, id_col, text_col, lang_col)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        found = shared.value
        for batch in batches:
            names, scores = [], []
            for at in range(0, batch.num_rows, BLOCK):
                texts = batch.column(1).slice(at, BLOCK).to_pylist()
                if found is None:
                    names += [UNKNOWN] * len(texts)
                    scores += [0.0] * len(texts)
                    continue
                best, share = found.decide([x or "" for x in texts])
                for text, i, p in zip(texts, best.tolist(), share.tolist()):
                    known = bool(text) and _LETTER.search(text) is not None
                    names.append(found.languages[i] if known else UNKNOWN)
                    scores.append(float(p) if known else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[id_col, "held_out", "lang_pred", "score"])

    kind = df.schema[id_col].dataType.simpleString()
    return narrow(df).select(id_col, text_col, held_out(id_col).alias("held_out")).mapInArrow(score, f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double")
