"""Packing documents into sequences of fixed length by linear grouping.

A length is one of as many values as a sequence has tokens, so the packing is planned on counts by length, which stay
that small whatever the number of documents.  Large lengths are put in order, cut into groups of equal cardinality and
rounded up to the greatest of their group; configurations of these few sizes are optimised as a linear program by column
generation and rounded down; the documents' own lengths take the places of the rounded ones; what is left, and all
small documents, goes in by best fit.  The plan tells for each length which of its pieces, by rank, go where; ranks are
counted by Spark, from the ranks inside each task's part.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator
from itertools import count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from proseloom.llm.store import drop_settled, narrow, settle

#: Groups of large lengths; a length is large if no more than ``LARGE`` - 1 of its kind fit into a sequence.
GROUPS, LARGE = 96, 8
#: Distinct words whose ids a task keeps; beyond it the table starts anew.
KEPT_WORDS = 500_000

_EPSILON = 1e-9


class Bins(NamedTuple):
    """``n`` sequences with the same content: (length, pieces of it) in order, and the room left."""

    n: int
    held: tuple[tuple[int, int], ...]
    room: int


def _best_configuration(sizes: list[int], values: np.ndarray, capacity: int) -> np.ndarray:
    """How many of each size give the greatest value within the capacity: a knapsack filled one piece at a time."""
    best = np.zeros(capacity + 1)
    chosen = []
    for _ in range(capacity // min(sizes)):
        after, which = best.copy(), np.full(capacity + 1, -1)
        for j, size in enumerate(sizes):
            got = best[: capacity + 1 - size] + values[j]
            better = got > after[size:] + _EPSILON
            after[size:][better], which[size:][better] = got[better], j
        if (which < 0).all():
            break
        best = after
        chosen.append(which)
    out, room = np.zeros(len(sizes), np.int64), capacity
    for which in reversed(chosen):
        if which[room] >= 0:
            out[which[room]] += 1
            room -= sizes[which[room]]
    return out


def configurations(sizes: list[int], demands: list[int], capacity: int) -> list[tuple[np.ndarray, int]]:
    """(configuration, whole sequences of it): the optimum of the linear program, rounded down.

    Columns are generated by the knapsack on the prices of the present basis, which starts with one size a sequence.
    """
    held = np.diag([capacity // s for s in sizes]).astype(float)
    demand = np.array(demands, float)
    for _ in range(40 * len(sizes)):
        prices = np.linalg.solve(held.T, np.ones(len(sizes)))
        column = _best_configuration(sizes, np.maximum(prices, 0), capacity)
        if prices @ column <= 1 + 1e-7:
            break
        amounts, change = np.linalg.solve(held, demand), np.linalg.solve(held, column.astype(float))
        ratio = np.where(change > _EPSILON, np.maximum(amounts, 0) / np.where(change > _EPSILON, change, 1), np.inf)
        held[:, int(ratio.argmin())] = column
    amounts = np.linalg.solve(held, demand)
    out, left = [], np.array(demands, np.int64)
    for j in np.argsort(-amounts):
        column = held[:, j].astype(np.int64)
        n = int(amounts[j] + 1e-6)
        n = min([n, *(left[column > 0] // column[column > 0]).tolist()])
        if n > 0:
            out.append((column, n))
            left -= column * n
    return out


def equal_groups(counts: list[tuple[int, int]], groups: int) -> list[list[tuple[int, int]]]:
    """Cuts (length, pieces), by falling length, into groups of equal cardinality; a length may lie in two of them."""
    if len(counts) <= groups:
        return [[x] for x in counts]
    total = sum(n for _, n in counts)
    out, before, at = [[]], 0, 1
    for length, n in counts:
        while n:
            take = min(n, total * at // groups - before)
            if take:
                out[-1].append((length, take))
                before, n = before + take, n - take
            if before >= total * at // groups and at < groups:
                at += 1
                if out[-1]:
                    out.append([])
    return [x for x in out if x]


def _substitute(made: list[tuple[np.ndarray, int]], sizes: list[int], counts: dict[int, int], capacity: int) -> tuple[list[Bins], dict[int, int]]:
    """Sequences of real lengths in the places of rounded ones, and the pieces left over.

    A place takes the longest piece left that its size, and what the places before it did not use, allow; the last place
    of a configuration has all its room.  Where longer pieces used a group up, its further sequences are left unmade.
    Sequences alike are one entry, and each entry uses up a length or a configuration.
    """
    stock = dict(counts)
    lengths = sorted(stock)
    below = dict(zip(sizes, [*sizes[1:], 0]))
    bins = []
    for column, n in made:
        places = [sizes[j] for j in np.flatnonzero(column) for _ in range(int(column[j]))]
        extra = capacity - sum(places)
        while n:
            inside, spare = defaultdict(int), 0
            for i, size in enumerate(places):
                room = size + spare + (extra if i + 1 == len(places) else 0)
                at = bisect_right(lengths, room) - 1
                while at >= 0 and stock[lengths[at]] == inside[lengths[at]]:
                    at -= 1
                if at < 0 or lengths[at] <= below[size]:
                    break
                inside[lengths[at]] += 1
                spare = room - lengths[at]
            else:
                m = min(n, *(stock[length] // each for length, each in inside.items()))
                bins.append(Bins(m, tuple(inside.items()), spare))
                for length, each in inside.items():
                    stock[length] -= m * each
                    if not stock[length]:
                        lengths.remove(length)
                n -= m
                continue
            break  # the group has no pieces left: those of the other places are packed by best fit
    return bins, {length: stock[length] for length in lengths}


def _best_fit(bins: list[Bins], left: dict[int, int], capacity: int) -> list[Bins]:
    """Puts pieces, longest first, each into the sequence with the least room that takes it; new sequences where none does."""
    by_room: dict[int, list[Bins]] = defaultdict(list)
    rooms: list[int] = []

    def add(one: Bins) -> None:
        if one.n:
            if not by_room[one.room]:
                insort(rooms, one.room)
            by_room[one.room].append(one)

    for one in bins:
        add(one)
    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                found = by_room[room].pop()
                if not by_room[room]:
                    rooms.pop(at)
            else:
                found = Bins(-(-n // (capacity // length)), (), capacity)
            each = found.room // length
            full, rest = divmod(min(n, each * found.n), each)
            add(Bins(full, (*found.held, (length, each)), found.room - each * length))
            if rest:
                add(Bins(1, (*found.held, (length, rest)), found.room - rest * length))
            add(Bins(found.n - full - (rest > 0), found.held, found.room))
            n -= full * each + rest
    return [one for room in sorted(by_room) for one in by_room[room]]


def plan(counts: dict[int, int], capacity: int, groups: int = GROUPS, large: int = LARGE) -> list[Bins]:
    """Sequences for so many pieces of each length, 1 to ``capacity``; every piece is in one of them."""
    whole = [(length, n) for length, n in counts.items() if length * large > capacity]
    cut = equal_groups(sorted(whole, reverse=True), groups)
    small = {length: n for length, n in counts.items() if length * large <= capacity}
    bins: list[Bins] = []
    if cut:
        sizes = [max(length for length, _ in g) for g in cut]
        made = configurations(sizes, [sum(n for _, n in g) for g in cut], capacity)
        bins, left = _substitute(made, sizes, dict(whole), capacity)
        small |= left
    return _best_fit(bins, small, capacity)


def _places(bins: list[Bins]) -> dict[str, np.ndarray]:
    """The plan by rank: pieces of ``length`` from rank ``first`` on lie ``each`` to a sequence, from ``sequence`` and ``offset`` on."""
    rows, ranks, sequence = [], defaultdict(int), 0
    for one in bins:
        offset = 0
        for length, each in one.held:
            rows.append((length, ranks[length], each, sequence, offset))
            ranks[length] += each * one.n
            offset += each * length
        sequence += one.n
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "each", "sequence", "offset"), table.T))


# How the tokenizers that are known here cut text, and plain words, of which no step but lower case and the
# cut into letters, digits and signs changes anything.
_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_CUT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+").fullmatch
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+").findall


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones themselves, the others from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b if b in shown else next(rest)) for b in range(256)]


class _Ids:
    """Token ids of texts, as little-endian unsigned 32-bit integers: each word between ASCII white space is tokenized once
    by the library and remembered.

    The tokenizer must drop white space, with no token across it, so that a text's ids are those of its words end to end.
    Of plain words under known rules only the letters, digits and signs they are cut into go to the library's model.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        steps = (rules.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        known = (rules.get("normalizer") or {}).get("normalizers") == _NORMALIZER and len(steps) == 2
        known = known and (steps[0].get("pattern"), steps[0].get("behavior"), steps[0].get("invert")) == ({"Regex": _CUT}, "Removed", True)
        self.plain = known and (steps[1].get("type"), steps[1].get("add_prefix_space"), steps[1].get("use_regex")) == ("ByteLevel", False, False)
        self.marked = re.compile("|".join(re.escape(t["content"]) for t in rules.get("added_tokens", ())) or "(?!)").search
        self.letters = {chr(b): letter for b, letter in enumerate(_byte_letters())}
        self.tokenize = self.tokenizer.model.tokenize
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            text = part if part.isascii() else "".join(map(self.letters.__getitem__, part.encode().decode("latin-1")))
            ids = [t.id for t in self.tokenize(text)]
            found = self.parts[part] = struct.pack(f"<{len(ids)}I", *ids)
        return found

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        if self.plain:
            if word.isalpha():
                return self._part(text.lower())
            if _PLAIN(text) and not self.marked(text):
                return b"".join(map(self._part, _PARTS(text.lower())))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        words = text.encode().split()
        if len(self.words) > KEPT_WORDS or len(self.parts) > KEPT_WORDS:
            self.words, self.parts = {}, {}
        known = self.words
        out = [known.get(w) for w in words]
        if None in out:
            for i, found in enumerate(out):
                if found is None:
                    found = known.get(words[i])
                    if found is None:
                        found = known[words[i]] = self._word(words[i])
                    out[i] = found
        return b"".join(out)


def pieces(df: DataFrame, tokenizer_path: str, capacity: int = 2048, end: int = 0, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Documents as token pieces of at most ``capacity``: id, piece, start, length, ids_crc32 and, where kept, ids.

    A document is the ids of its whole text and then ``end``; null and empty texts are ``end`` alone.  Longer documents
    are cut every ``capacity`` tokens.  Repeated rows and ids each have pieces of their own.  ``block`` and ``place`` (in
    the task's pieces of the same length, from 0) serve ``pack``.  Other columns of ``df`` are not read.
    """
    names = [id_col, "piece", "start", "length", "ids_crc32", "block", "place", *(["ids"] if keep_ids else [])]

    def cut(batches):
        encode, seen, last = _Ids(tokenizer_path), defaultdict(count), np.array([end], "<u4").tobytes()
        for batch in batches:
            owner, rows, ids = [], [], []
            blocks = batch.column(2).to_pylist()
            for row in range(batch.num_rows):
                whole = encode(batch.column(1)[row].as_py() or "") + last
                for piece, start in enumerate(range(0, len(whole) // 4, capacity)):
                    part = whole[4 * start : 4 * (start + capacity)]
                    length = len(part) // 4
                    owner.append(row)
                    rows.append((piece, start, length, zlib.crc32(part), blocks[row], next(seen[length])))
                    if keep_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
            columns = [pa.array(x, pa.int64()) for x in zip(*rows)] if rows else [pa.array([], pa.int64())] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), *columns, *([pa.array(ids, pa.list_(pa.int32()))] if keep_ids else [])], names=names)

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece long, start long, length long, ids_crc32 long, block long, place long" + (", ids array<int>" if keep_ids else "")
    return narrow(df).select(id_col, text_col, F.spark_partition_id().cast("long")).mapInArrow(cut, schema)


def pack(cut: DataFrame, capacity: int = 2048, groups: int = GROUPS) -> DataFrame:
    """Adds sequence_id and offset to pieces: few sequences of at most ``capacity`` tokens, gapless from offset 0.

    ``cut`` is a settled table of pieces, as ranks rest on the blocks it was written in.  At most ``capacity`` rows, counts
    by length, reach the driver.  Pieces and counts meet by block and length, which no frequent length makes hot.
    """
    counts = cut.groupBy("block", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = settle(counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "piece-counts")
    totals = {r.length: r.n for r in base.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = _places(plan(totals, capacity, groups))
    span = max(totals.values(), default=0) + 1
    keys = table["length"] * span + table["first"]
    ranked = cut.join(base.select("block", "length", "base"), ["block", "length"]).withColumn("rank", F.col("base") + F.col("place"))
    names = [c for c in cut.columns if c not in ("block", "place")]
    ranked = ranked.select(*names, "rank")
    at_length, at_rank = names.index("length"), len(names)

    def place(batches):
        for batch in batches:
            length, rank = batch.column(at_length).to_numpy(), batch.column(at_rank).to_numpy()
            row = np.searchsorted(keys, length * span + rank, "right") - 1
            sequence, nth = np.divmod(rank - table["first"][row], table["each"][row])
            found = (table["sequence"][row] + sequence, table["offset"][row] + nth * length)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at_rank], *map(pa.array, found)], names=[*names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return ranked.mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed pieces' ids end to end; a group holds no more tokens than a sequence."""
    inside = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(inside, lambda x: x["ids"])).alias("ids"))


def pack_documents(df: DataFrame, tokenizer_path: str, capacity: int = 2048, end: int = 0, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Pieces of whole documents with their places in sequences; ``pieces`` and ``pack`` tell the columns."""
    return pack(settle(pieces(df, tokenizer_path, capacity, end, id_col, text_col, keep_ids), "pieces"), capacity)
