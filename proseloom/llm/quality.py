"""Quality rules as a short-circuit cascade.

The counts of ``COUNTS`` are computed for every document.  The verdict comes from a cascade: on a sample each rule's
cost (seconds a document) and selectivity (share rejected) are estimated, the rules are ordered by rejection per cost,
and each rule sees only the documents that all rules before it let pass.  The order changes the cost, never the verdict,
because a document is kept exactly if no rule rejects it.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from proseloom.llm import textops
from proseloom.llm.store import narrow

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Rows of the sample from which costs and selectivities are estimated.
SAMPLE_ROWS = 400

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_NOT_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
_NOT_LETTER = bytes(b for b in range(256) if not (65 <= b <= 90 or 97 <= b <= 122 or b >= 128))
_CONTROL = bytes(b for b in range(32) if b not in (9, 10, 11, 12, 13)) + b"\x7f"


class Page(NamedTuple):
    """What a rule may read of one document: its counts, the number of lines with a word, and its UTF-8 bytes."""

    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    n_lines: int
    raw: bytes


class Rule(NamedTuple):
    """``rejects(page)`` is true for documents that go."""

    name: str
    rejects: Callable[[Page], bool]


def counts(run: textops.Run) -> dict[str, np.ndarray]:
    """The counts of each document of a run; words are maximal sequences without space, tab, LF, VT, FF and CR."""
    found = textops.words(run)
    n_words = np.diff(found.offsets)
    inside = ~textops._IS_SPACE[run.data] & ((run.data & 0xC0) != 0x80)
    spans = textops.SpanHash(run.data)
    hashes = spans(found.starts, found.ends)
    owner = textops.owners(found.offsets)
    out = {"n_words": n_words, "word_chars": textops.per_document(inside, run), "n_symbols": textops.per_document(_SYMBOL[run.data], run)}

    # Lines that have a word, keyed by content and document.
    breaks = run.data == 10
    edge = np.zeros(len(run.data) + 1, bool)
    edge[run.starts] = True
    edge[1:] |= breaks
    begins = np.flatnonzero(edge[:-1])
    begins = begins[np.searchsorted(run.starts, begins, "right") > 0]
    line_owner = np.searchsorted(run.starts, begins, "right") - 1
    stops = np.append(begins[1:], len(run.data))
    stops = np.minimum(stops, run.ends[line_owner])
    stops -= (stops > begins) & breaks[np.maximum(stops - 1, 0)]
    worded = np.searchsorted(found.starts, begins) < np.searchsorted(found.starts, stops)
    begins, stops, line_owner = begins[worded], stops[worded], line_owner[worded]
    keys = textops.mix(spans(begins, stops) ^ textops.mix(line_owner.astype(np.uint64) + np.uint64(1)))
    n = len(n_words)
    first_of_key = np.unique(keys, return_index=True)[1]
    out["n_lines"] = np.bincount(line_owner, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(line_owner[first_of_key], minlength=n)

    # Words covered by a five-word window that occurs twice or more in its document.
    windows = textops.sequence_hash(hashes, 5)
    covered = np.zeros(len(hashes) + 1, np.int64)
    if len(windows):
        whole = owner[: len(windows)] == owner[4:]
        at = np.flatnonzero(whole)
        again = at[textops.repeated(textops.mix(windows[at] ^ textops.mix(owner[at].astype(np.uint64) + np.uint64(1))))]
        covered[:] = np.bincount(again, minlength=len(covered))[: len(covered)]
        covered -= np.bincount(again + 5, minlength=len(covered))[: len(covered)]
    out["n_repeat_words"] = np.bincount(owner, (np.cumsum(covered)[:-1] > 0), minlength=n).astype(np.int64)
    return out


#: The rule that the counts decide, always first.
def base_fails(n_words, n_repeat_words):
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


def _stutters(p: Page) -> bool:
    """A third of the words or more repeat the word before."""
    found = p.raw.split()
    return 3 * sum(a == b for a, b in zip(found, found[1:])) >= len(found)


def _letters(p: Page) -> int:
    return len(p.raw.translate(None, _NOT_LETTER))


#: Production rules.  Thresholds leave room: ordinary prose in any of the scripts stays.
RULES = (
    Rule("symbols", lambda p: 10 * p.n_symbols > p.n_words),
    Rule("duplicate_lines", lambda p: p.n_lines >= 4 and 2 * p.n_dup_lines > p.n_lines),
    Rule("word_length", lambda p: not 2 * p.n_words <= p.word_chars <= 25 * p.n_words),
    Rule("shouting", lambda p: 10 * len(p.raw.translate(None, _NOT_UPPER)) > 6 * _letters(p)),
    Rule("exclamations", lambda p: 3 * p.raw.count(b"!") > p.n_words),
    Rule("few_letters", lambda p: 2 * _letters(p) < p.word_chars),
    Rule("stutter", _stutters),
    Rule("control_characters", lambda p: 50 * (len(p.raw) - len(p.raw.translate(None, _CONTROL))) > len(p.raw)),
)


def _pages(run: textops.Run, found: dict[str, np.ndarray], rows: np.ndarray):
    columns = [found[c] for c in (*COUNTS, "n_lines")]
    for i in rows.tolist():
        yield i, Page(*(int(c[i]) for c in columns), run.data[run.starts[i] : run.ends[i]].tobytes())


def order_rules(df: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> tuple[Rule, ...]:
    """Rules by estimated rejection per second on a sample of at most ``sample_rows`` rows; ties keep their order."""
    texts = pa.array([r[0] for r in df.select(text_col).limit(sample_rows).collect()], pa.string())
    pages = [p for run in textops.runs(texts) for _, p in _pages(run, counts(run), np.arange(len(run.starts)))]
    if not pages:
        return rules
    worth = []
    for rule in rules:
        began = time.perf_counter()
        rejected = sum(bool(rule.rejects(p)) for p in pages)
        cost = (time.perf_counter() - began) / len(pages) + 1e-9
        worth.append((rejected + 0.5) / (len(pages) + 1) / cost)
    return tuple(rule for _, rule in sorted(zip(worth, rules), key=lambda x: -x[0]))


def kept_documents(df: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that ``quality`` keeps, with all their columns; one map over partitions."""
    plan, at = order_rules(df, rules, text_col), df.columns.index(text_col)

    def keep(batches):
        for batch in batches:
            flags = [_kept(run, counts(run), plan)[1] for run in textops.runs(batch.column(at))]
            yield batch.filter(pa.array(np.concatenate(flags) if flags else np.zeros(0, bool)))

    return narrow(df).mapInArrow(keep, df.schema)


def _kept(run: textops.Run, found: dict[str, np.ndarray], plan: tuple[Rule, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Which documents fail the base rule, and which are kept."""
    failed = base_fails(found["n_words"], found["n_repeat_words"])
    kept = ~failed
    for i, page in _pages(run, found, np.flatnonzero(kept)):
        kept[i] = not any(rule.rejects(page) for rule in plan)
    return failed, kept


def quality(df: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and verdict of every document.

    Returns id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept.  A null or empty
    text has no words, so it fails the base rule.  Repeated rows are judged one by one; other columns are not read.
    One map over partitions, no shuffle; a task holds one run of text at a time.
    """
    plan = order_rules(df, rules, text_col)

    def judge(batches):
        for batch in batches:
            for run in textops.runs(batch.column(1)):
                found = counts(run)
                failed, kept = _kept(run, found, plan)
                ids = batch.column(0).slice(run.first, len(run.starts))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(found[c].astype(np.int64)) for c in COUNTS), pa.array(failed), pa.array(kept)], names=[id_col, *COUNTS, "base_failed", "kept"])

    kind = df.schema[id_col].dataType.simpleString()
    return narrow(df).select(id_col, text_col).mapInArrow(judge, f"`{id_col}` {kind}, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, kept boolean")
