"""Byte-level BPE: the tokenization automaton, the prefix table, and the operators on documents for both.

The vocabulary file is a parameter; its merges are compiled once per Python worker.

``MergeAutomaton`` follows the merge-gadget construction: the automaton starts with one state and an arc for each
byte; the gadget of merge (u, v) adds an arc labelled uv and takes the arc v away from the state that u leads to, so
that u and v can no longer follow each other.  After all gadgets there is one state for each token, and a sequence of
tokens is the BPE encoding of its text exactly if it labels a path.  Written out, the arcs would be the square of the
vocabulary; a gadget is therefore kept as its pair and rank, and the cells of the transition table (state x arc) are
filled from the gadgets when a text first visits them.  Encoding a pre-split word is a walk over that table, decoding
emits the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proseloom.llm.store import narrow

#: White space as in Unicode's White_Space, spelled out because engines differ on \s for U+001C to U+001F.
_SPACE = r"\t-\r \x85\xa0  -     　"
#: How byte-level vocabularies of this kind split text.
SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: The same for texts without characters from U+0250 on, where the classes are short and the plain engine will do.
_LETTER, _NUMBER, _NARROW_SPACE = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0"
_NARROW = re.compile(rf" ?[{_LETTER}]+|'(?:[stmd]|re|ve|ll)| ?[{_NUMBER}]+| ?[^{_NARROW_SPACE}{_LETTER}{_NUMBER}]+|[{_NARROW_SPACE}]+(?![^{_NARROW_SPACE}])|[{_NARROW_SPACE}]+")
_WIDE = re.compile(r"[^\x00-\u024f]")
_SPACES = re.compile(rf"[{_SPACE}]+")
#: Contractions that are two words where a text ends after their first letter.
_CUT_CONTRACTIONS = ("'re", "'ve", "'ll")
#: Entries of a worker's tables of known words, prefixes and cells; a full table starts anew, results stay the same.
TABLE = 200_000
#: Words of more bytes than this are not kept in the tables.
LONG = 64


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files: itself where printable, else the next free letter from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def split_words(text: str) -> list[str]:
    """The words that merges never cross, in order; joined they are the text."""
    return (SPLIT if _WIDE.search(text) else _NARROW).findall(text)


class MergeAutomaton:
    """Deterministic automaton over tokens whose paths are the correct tokenizations."""

    def __init__(self, source: bytes):
        spec = json.loads(source)
        model, letters = spec["model"], _byte_letters()
        vocabulary = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.special_split = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.label: list[bytes] = [b""] * (max([*vocabulary.values(), *self.special.values()]) + 1)
        self.arc: dict[bytes, int] = {}
        for text, i in vocabulary.items():
            if text not in self.special:
                self.label[i] = bytes(letters[c] for c in text)
        for text, i in self.special.items():
            self.label[i] = text.encode()
        self.size = len(self.label)
        self.rank = [-1] * self.size
        self.left = list(range(self.size))
        self.right = list(range(self.size))
        self.gadget: dict[int, int] = {}
        # The longest label that starts, or ends, with these four bytes.
        self.reach: dict[bytes, int] = {}
        self.reach_back: dict[bytes, int] = {}
        for b in range(256):
            self._add_arc(vocabulary[next(c for c, x in letters.items() if x == b)])
        for r, pair in enumerate(model["merges"]):
            u, v = pair.split(" ") if isinstance(pair, str) else pair
            self._merge_gadget(r, vocabulary[u], vocabulary[v], vocabulary[u + v])
        self.cell: dict[int, bool] = {}

    def _add_arc(self, token: int) -> None:
        label = self.label[token]
        self.arc[label] = token
        if len(label) > 3:
            for table, key in ((self.reach, label[:4]), (self.reach_back, label[-4:])):
                table[key] = max(table.get(key, 4), len(label))

    def _merge_gadget(self, rank: int, u: int, v: int, uv: int) -> None:
        """From this rank on, arc v leaves no state reached by u, and arc uv leads from before u to after v."""
        if self.rank[uv] >= 0:
            raise ValueError(f"two merges make token {uv}; a gadget needs a label of its own")
        self.rank[uv], self.left[uv], self.right[uv] = rank, u, v
        self.gadget[u * self.size + v] = rank
        self._add_arc(uv)

    def follows(self, state: int, token: int) -> bool:
        """The cell of the transition table: whether arc ``token`` leaves ``state`` after all gadgets.

        Undoes the newest merge on either side of the border until both sides are bytes; a gadget that joins the
        two pieces at the border removes the arc if it came while both were whole.  Of equal merges the left one
        comes first.
        """
        key = state * self.size + token
        known = self.cell.get(key)
        if known is not None:
            return known
        rank, gadget, size = self.rank, self.gadget, self.size
        a, b, before = state, token, 1 << 40
        while True:
            r = gadget.get(a * size + b)
            if r is not None and r < before:
                out = False
                break
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                out = True
                break
            if ra > rb:
                before, a = ra, self.right[a]
            else:
                before, b = rb + 1, self.left[b]
        if len(self.cell) >= 2 * TABLE:
            self.cell.clear()
        self.cell[key] = out
        return out

    def walk(self, word: bytes) -> list[int]:
        """The path of a word: longest arcs first, back where the table has no arc on.

        Only one path reaches each position, so a position without a way on is never visited again.
        """
        whole = self.arc.get(word)
        if whole is not None:
            return [whole]
        arc, reach, cell, follows, n, size = self.arc.get, self.reach.get, self.cell.get, self.follows, len(word), self.size
        path: list[int] = []
        dead: set[int] = set()
        at, state = 0, -1
        length = min(reach(word[:4]) or 3, n)
        while at < n:
            while length:
                token = arc(word[at : at + length])
                if token is not None and (not dead or at + length not in dead):
                    if state < 0:
                        break
                    known = cell(state * size + token)
                    if known or (known is None and follows(state, token)):
                        break
                length -= 1
            if length:
                path.append(token)
                state, at = token, at + length
                length = min(reach(word[at : at + 4]) or 3, n - at)
            else:
                if not path:
                    raise ValueError("a byte has no arc")
                dead.add(at)
                length = len(self.label[path.pop()])
                at -= length
                length -= 1
                state = path[-1] if path else -1
        return path

    def pieces(self, text: str) -> Iterator[tuple[str, int | None]]:
        """Pre-split words in order; special strings come with their id."""
        parts = self.special_split.split(text) if self.special_split and any(s in text for s in self.special) else (text,)
        for part in parts:
            if (special := self.special.get(part)) is not None:
                yield part, special
            else:
                for word in split_words(part):
                    yield word, None

    def plain(self, text: str) -> list[str] | None:
        """The words of a text without special strings, else None."""
        return split_words(text) if not any(s in text for s in self.special) else None

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """Labels of the arcs, end to end; bytes that make no character become U+FFFD."""
        label = self.label
        return b"".join([label[i] for i in ids]).decode("utf-8", "replace")


class Encoder:
    """Whole texts through the automaton, with a bounded table of known words."""

    def __init__(self, automaton: MergeAutomaton):
        self.automaton = automaton
        self.known: dict[str, bytes] = {}

    def word(self, word: str) -> bytes:
        raw = word.encode("utf-8", "surrogatepass")
        ids = np.array(self.automaton.walk(raw), "<u4").tobytes()
        if len(raw) <= LONG:
            if len(self.known) >= TABLE:
                self.known.clear()
            self.known[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        known, fresh = self.known, self.word
        words = self.automaton.plain(text)
        if words is not None:
            return b"".join([known.get(w) or fresh(w) for w in words])
        return b"".join([(known.get(w) or fresh(w)) if s is None else s.to_bytes(4, "little") for w, s in self.automaton.pieces(text)])


class PrefixTable:
    """Prefix dynamic programming: the last token and the exact token count of every prefix of every word.

    The encoding of a prefix ends in the one token that is a suffix of it and may follow the last token of the prefix
    before that suffix.  Prefixes are shared between words, so a new word costs only its new prefixes.
    """

    def __init__(self, automaton: MergeAutomaton):
        self.automaton = automaton
        self.entry: dict[bytes, tuple[int, int]] = {}
        self.total: dict[str, int] = {}

    def count(self, word: str) -> int:
        """Tokens of a word."""
        raw = word.encode("utf-8", "surrogatepass")
        n = len(raw)
        if n > LONG:
            return self._rows(raw)[-1]
        if not n:
            return 0
        entry = self.entry
        if len(entry) >= 2 * TABLE:
            entry.clear()
        known = n
        while known and raw[:known] not in entry:
            known -= 1
        if known < n:
            a = self.automaton
            arc, back, cell, follows, size = a.arc.get, a.reach_back.get, a.cell.get, a.follows, a.size
            for i in range(known + 1, n + 1):
                whole = arc(raw[:i])
                if whole is not None:
                    entry[raw[:i]] = whole, 1
                    continue
                for length in range(min(back(raw[max(0, i - 4) : i]) or 3, i - 1), 0, -1):
                    token = arc(raw[i - length : i])
                    if token is not None:
                        last, count = entry[raw[: i - length]]
                        follow = cell(last * size + token)
                        if follow or (follow is None and follows(last, token)):
                            entry[raw[:i]] = token, count + 1
                            break
                else:
                    raise ValueError("a byte has no arc")
        total = entry[raw][1]
        if len(self.total) >= TABLE:
            self.total.clear()
        self.total[word] = total
        return total

    def _rows(self, raw: bytes) -> list[int]:
        """Counts at every prefix of one word, without the shared table (long words)."""
        rows: list[tuple[int, int]] = [(-1, 0)]
        arc, back, follows = self.automaton.arc, self.automaton.reach_back, self.automaton.follows
        for i in range(1, len(raw) + 1):
            for length in range(min(back.get(raw[max(0, i - 4) : i], 3), i), 0, -1):
                token = arc.get(raw[i - length : i])
                if token is not None and (length == i or follows(rows[i - length][0], token)):
                    rows.append((token, rows[i - length][1] + 1))
                    break
            else:
                raise ValueError("a byte has no arc")
        return [c for _, c in rows[1:]]

    def _rows_of(self, pieces: list[tuple[str, int | None]], k: int) -> np.ndarray:
        """Tokens of the text up to each byte of piece k, less those of the pieces before.

        A text that ends inside a piece may split otherwise than the whole text: white space at its end is one word, a
        contraction cut in two is none, and what was to be a special string is ordinary text.
        """
        word, special = pieces[k]
        raw = word.encode("utf-8", "surrogatepass")
        if special is not None:
            # The words before that can run into the special string's first characters.
            start = k
            while start and k - start < 2 and pieces[start - 1][1] is None:
                start -= 1
            before = "".join(w for w, _ in pieces[start:k])
            base = sum(self.count(w) for w, _ in pieces[start:k])
            rows = [sum(map(self.count, split_words(before + word[:j]))) - base for j in range(1, len(word))]
            # Special strings are ASCII in the vocabularies at hand; a longer character counts from its first byte on.
            return np.repeat([*rows, 1], [len(c.encode("utf-8", "surrogatepass")) for c in word])
        rows = np.array(self._rows(raw), np.int64)
        if word in _CUT_CONTRACTIONS:
            rows[1] = 2
        run = pieces[k - 1][0] if k and pieces[k - 1][1] is None else ""
        if run and _SPACES.fullmatch(run) and _SPACES.fullmatch(word[0]):
            rows[len(word[0].encode()) - 1] = self.count(run + word[0]) - self.count(run)
        return rows

    def counts(self, text: str) -> np.ndarray:
        """Tokens of text[:i] for every byte prefix i >= 1, exact at every whole character, as if the text ended there."""
        out, base = [], 0
        pieces = list(self.automaton.pieces(text))
        for k, (word, special) in enumerate(pieces):
            out.append(self._rows_of(pieces, k) + base)
            base += 1 if special is not None else self.count(word)
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def measure(self, text: str, budget: int) -> tuple[int, int, int]:
        """Bytes, tokens, and the bytes of the longest prefix of whole characters within the budget."""
        known, fresh = self.total, self.count
        words = self.automaton.plain(text)
        if words is not None:
            counts = [known.get(w) or fresh(w) for w in words]
        else:
            pairs = list(self.automaton.pieces(text))
            words = [w for w, _ in pairs]
            counts = [1 if s is not None else known.get(w) or fresh(w) for w, s in pairs]
        size, total = len(text.encode("utf-8", "surrogatepass")), sum(counts)
        if total <= budget:
            return size, total, size
        sums = np.concatenate(([0], np.cumsum(counts)))
        first = int(np.searchsorted(sums, budget, "right")) - 1
        special = self.automaton.special
        # The piece that breaks the budget; white space or a cut special string after it can bring the count down again.
        pieces = [(w, special.get(w)) for w in words[max(0, first - 2) : first + 3]]
        skipped = max(0, first - 2)
        at = sum(len(w.encode("utf-8", "surrogatepass")) for w in words[:first])
        fit = at if sums[first] <= budget else 0
        for k in range(first, min(first + 3, len(words))):
            raw = words[k].encode("utf-8", "surrogatepass")
            rows = self._rows_of(pieces, k - skipped) + sums[k]
            fit = max(fit, max((at + i + 1 for i, c in enumerate(rows) if c <= budget and (i + 1 == len(raw) or raw[i + 1] & 0xC0 != 0x80)), default=0))
            at += len(raw)
        return size, total, fit


_COMPILED: dict[bytes, MergeAutomaton] = {}
_WORKER: dict[tuple[str, bytes], object] = {}


def automaton_of(source: bytes) -> MergeAutomaton:
    """The automaton of a vocabulary file, compiled once per process."""
    key = hashlib.sha256(source).digest()
    if key not in _COMPILED:
        _COMPILED[key] = MergeAutomaton(source)
    return _COMPILED[key]


def _table(kind, source: bytes):
    key = (kind.__name__, hashlib.sha256(source).digest())
    if key not in _WORKER:
        _WORKER[key] = kind(automaton_of(source))
    return _WORKER[key]


def _vocabulary(df: DataFrame, tokenizer_path: str) -> Broadcast:
    """The vocabulary file, read on the driver; its size does not depend on the data."""
    with open(tokenizer_path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _column(df: DataFrame, name: str) -> str:
    return f"`{name}` {df.schema[name].dataType.simpleString()}"


def _strings(batch: pa.RecordBatch, index: int = 1) -> Iterator[list[str]]:
    """Texts of a batch in slices, so that few are Python objects at a time; null is empty."""
    texts = batch.column(index)
    for at in range(0, len(texts), 512):
        yield [x or "" for x in texts.slice(at, 512).to_pylist()]


def count_tokens(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", budget: int = 1024) -> DataFrame:
    """Exact token counts of whole texts by prefix dynamic programming.

    Returns id, n_bytes, n_tokens, over_limit (n_tokens > budget) and fit_bytes, the bytes of the longest prefix of
    whole characters that needs no more than ``budget`` tokens.  Null and empty texts count 0.  Repeated rows and ids
    are kept as they are; other columns of ``df`` are not read.  A map over partitions: no shuffle.
    """
    source = _vocabulary(df, tokenizer_path)

    def measure(batches):
        table = _table(PrefixTable, source.value)
        for batch in batches:
            rows = [table.measure(x, budget) for texts in _strings(batch) for x in texts]
            size, total, fit = (np.array(x, np.int64) for x in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(total), pa.array(total > budget), pa.array(fit)], names=[id_col, "n_bytes", "n_tokens", "over_limit", "fit_bytes"])

    return narrow(df).select(id_col, text_col).mapInArrow(measure, f"{_column(df, id_col)}, n_bytes long, n_tokens long, over_limit boolean, fit_bytes long")


def prefix_counts(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored table: id and counts, an array with the token count of every byte prefix, null where a prefix would end
    inside a character (empty for null or empty)."""
    source = _vocabulary(df, tokenizer_path)

    def table_of(batches):
        table = _table(PrefixTable, source.value)
        for batch in batches:
            texts = [x for part in _strings(batch) for x in part]
            rows = [table.counts(x) for x in texts]
            raw = np.frombuffer("".join(texts).encode("utf-8", "surrogatepass"), np.uint8)
            # A character goes on where the next byte is no first byte.
            inside = np.append((raw[1:] & 0xC0) == 0x80, False) if len(raw) else np.zeros(0, bool)
            offsets = np.append(0, np.cumsum([len(r) for r in rows])).astype(np.int32)
            flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int64(), mask=inside))], names=[id_col, "counts"])

    return narrow(df).select(id_col, text_col).mapInArrow(table_of, f"{_column(df, id_col)}, counts array<long>")


def bytes_within(counts: Column, budget: Column | int) -> Column:
    """Bytes of the longest prefix of whole characters within a budget, from a stored ``counts`` array; no text is read again."""
    limit = budget if isinstance(budget, Column) else F.lit(budget)
    return F.coalesce(F.array_max(F.transform(counts, lambda c, i: F.when(c <= limit, i + 1))), F.lit(0)).cast("long")


def encode_documents(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of whole texts through the automaton: id, ids array<int> (empty for null or empty texts)."""
    source = _vocabulary(df, tokenizer_path)

    def encode(batches):
        encoder = _table(Encoder, source.value)
        for batch in batches:
            rows = [np.frombuffer(encoder.encode(x), "<u4").astype(np.int32) for texts in _strings(batch) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32()))], names=[id_col, "ids"])

    return narrow(df).select(id_col, text_col).mapInArrow(encode, f"{_column(df, id_col)}, ids array<int>")


def decode_documents(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Texts of id arrays: id, text (empty for null or empty arrays)."""
    source = _vocabulary(df, tokenizer_path)

    def decode(batches):
        automaton = automaton_of(source.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([automaton.decode(x or ()) for x in batch.column(1).to_pylist()], pa.string())], names=[id_col, "text"])

    return narrow(df).select(id_col, ids_col).mapInArrow(decode, f"{_column(df, id_col)}, text string")


def round_trip(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes whole texts in one pass over the data.

    Returns id, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit integers) and decoded_sha256 (of the
    decoded text in UTF-8).  Null and empty texts give 0 tokens and the digest of nothing.
    """
    source = _vocabulary(df, tokenizer_path)

    def both(batches):
        encoder = _table(Encoder, source.value)
        label, sha = encoder.automaton.label, hashlib.sha256
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for texts in _strings(batch):
                for text in texts:
                    raw = encoder.encode(text)
                    out = b"".join([label[i] for i in np.frombuffer(raw, "<u4").tolist()]).decode("utf-8", "replace")
                    counts.append(len(raw) // 4)
                    ids_sha.append(sha(raw).hexdigest())
                    text_sha.append(sha(out.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return narrow(df).select(id_col, text_col).mapInArrow(both, f"{_column(df, id_col)}, n_tokens long, ids_sha256 string, decoded_sha256 string")
