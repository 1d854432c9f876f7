"""Exact Jaccard self-join of documents on word shingles, with token-combination prefixes.

Shingles are ordered from rare to frequent, the same order for all documents.  A set of n shingles shares at least
ceil(threshold * n) of them with any similar set, so it misses D = n - ceil(threshold * n) at most.

* Rare class: with more than D rare shingles, the first D + 1 are indexed one by one; one of them is shared.
* Frequent class: with r <= D rare shingles, all of those are indexed singly and the prefix is extended by 2 D + 2
  frequent ones, which are indexed as pairs, of neighbours and of next but one neighbours in the prefix.  If no rare
  shingle is shared, take the set x whose prefix ends first: at least D + 2 of its frequent ones are shared, all within
  the prefix of the other set y, and the two sets miss 2 D + 1 shingles together at most; so the gaps between
  neighbouring shared shingles, in x and y together, are below 4 on average, and some pair lies within a gap of 2 in both.

Similar sets thus share an index entry, entries grow in proportion to the prefix, and a frequent shingle alone brings
nobody together.

Work and memory:

* Documents with equal texts, and then those with equal sets, share one representative: exact copies never meet in pairs.
* Counts are exact and come from two shuffles, without a table that every task would have to hold.  A task packs the
  shingles of a block of documents, sorted and coded by their differences, into one slice for each range of keys, each
  with its document's number in the block; what repeats inside the block is sent once with its count, so a shingle of
  every document costs a block one entry.  A range knows all holders of its keys, and sends each block back those that
  occur in two documents or more, with the count.  Keys get more bits as the input grows.
* A document with more than D shingles of its own has no partner and ends there; the others carry on their repeated
  shingles only, as a shingle of its own is in no common part.
* In an index entry every document is compared with one centre, the one that has the fewest shingles of its own, the
  nearest to a common source of edited copies.  Such a pair is compared once, however many entries it shares, and gives
  the number of differences and a 256-bit map of them.
* Documents of one centre that those links leave in different components are compared if sizes, the triangle inequality
  and the maps allow a link: |x ^ y| is at least the difference of their distances from the centre, and each bit that one
  map has alone, like each shingle that no other document has, is a difference of its own.  No link between different texts is lost for the components.
* Large groups of one centre are cut into parts, so no task holds more than ``PART`` rows of one side of a group.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proseloom.llm import textops
from proseloom.llm.components import components
from proseloom.llm.store import drop_settled, narrow, settle, small

#: A shingle in so many sets is frequent.
FREQUENT = 64
#: Bits of a key; more where the input is large, so that different shingles that share a key stay one in a thousand.
KEY_BITS = 44
#: Keys, and documents, of one block.
BLOCK_KEYS, BLOCK_DOCS = 1 << 21, 1 << 16
#: Rows of one side of a group that meet in one task.
PART = 4096

_SLICE = "`to` int, block long, a binary, b binary, c binary, d binary"
_CODEC = pa.Codec("zstd", compression_level=1)


def _packed(values: np.ndarray) -> bytes:
    """Unsigned integers by byte planes, compressed; only planes that are in use."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    raw = np.ascontiguousarray(planes).tobytes()
    return len(values).to_bytes(4, "little") + bytes([width]) + _CODEC.compress(raw, asbytes=True)


def _unpacked(raw: bytes) -> np.ndarray:
    n, width = int.from_bytes(raw[:4], "little"), raw[4]
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, :width] = np.frombuffer(_CODEC.decompress(raw[5:], decompressed_size=n * width, asbytes=True), np.uint8).reshape(width, n).T
    return out.reshape(-1).view("<u8")


def _gaps(keys: np.ndarray) -> bytes:
    """Sorted keys, coded by their differences."""
    return _packed(np.diff(keys, prepend=np.uint64(0)))


def _keys(raw: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(raw), dtype=np.uint64)


def _fingerprints(keys: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit sums of each sorted distinct set."""
    out = []
    for salt in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03):
        sums = np.zeros(len(keys) + 1, np.uint64)
        np.cumsum(textops.mix(keys ^ np.uint64(salt)), out=sums[1:])
        out.append((sums[offsets[1:]] - sums[offsets[:-1]]).astype(np.int64))
    return out


def _starts(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal values of a sorted array begins, and its end."""
    return np.append(np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])), len(ordered)) if len(ordered) else np.zeros(1, np.int64)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[2:])], names=["to", "block", "a", "b", "c", "d"])


def _by(batches, column: int):
    """Rows of sorted batches, grouped by a column: value, list of rows."""
    value, held = None, []
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if held and row[column] != value:
                yield value, held
                held = []
            value = row[column]
            held.append(row)
    if held:
        yield value, held


def _slices(docs: DataFrame, size: int, bits: int, ranges: int) -> DataFrame:
    """Slices of blocks by key range; each block also has a row of its own, beyond the ranges, with ids and what repeats in it."""
    low = np.uint64(64 - bits)

    def cut(waiting, number):
        keys, owner = np.concatenate([w[0] for w in waiting]), np.concatenate([w[1] for w in waiting])
        head = np.concatenate([w[2] for w in waiting], 1)
        block = int(textops.mix(np.array([len(keys) + (TaskContext.get().partitionId() << 32), number], np.uint64) + head[3:4].astype(np.uint64).sum()).sum() >> np.uint64(1))
        order = np.argsort(keys, kind="stable")
        keys, owner = keys[order], owner[order]
        at = _starts(keys)
        counts, first = np.diff(at), at[:-1]
        single, several = first[counts == 1], first[counts > 1]
        many = counts[counts > 1]
        edges = np.arange(ranges + 1, dtype=np.uint64) << np.uint64(bits - int(math.log2(ranges)))
        cuts, more = np.searchsorted(keys[single], edges), np.searchsorted(keys[several], edges)
        rows = []
        for r in range(ranges):
            s, m = slice(cuts[r], cuts[r + 1]), slice(more[r], more[r + 1])
            if s.start < s.stop or m.start < m.stop:
                rows.append((r, block, _gaps(keys[single[s]]), _packed(owner[single[s]]), _gaps(keys[several[m]]), _packed(many[m])))
        inside = np.repeat(counts > 1, counts)
        rows.append((ranges + block % ranges, block, head.tobytes(), _gaps(keys[several]), _packed(many), _packed(owner[inside])))
        return _batch(rows)

    def gather(batches):
        waiting, held, holders, number = [], 0, 0, 0
        for batch in batches:
            ids, h1, h2 = batch.column(0), batch.column(2).to_numpy(), batch.column(3).to_numpy()
            known = np.asarray(ids.is_valid())
            ids = ids.fill_null(0).to_numpy().astype(np.int64)
            for run in textops.runs(batch.column(1)):
                keys, offsets = textops.shingles(run, size)
                part = slice(run.first, run.first + len(run.starts))
                head = np.stack([ids[part], known[part].astype(np.int64), np.diff(offsets).astype(np.int64), *_fingerprints(keys, offsets), h1[part], h2[part]])
                # Shingles of one document that share a key count once.
                keys, owner = keys >> low, textops.owners(offsets)
                fresh = np.ones(len(keys), bool)
                fresh[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
                for at in range(0, head.shape[1], BLOCK_DOCS):
                    inside = fresh & (owner >= at) & (owner < at + BLOCK_DOCS)
                    n = min(BLOCK_DOCS, head.shape[1] - at)
                    if waiting and (held + int(inside.sum()) > BLOCK_KEYS or holders + n > BLOCK_DOCS):
                        yield cut(waiting, number)
                        waiting, held, holders, number = [], 0, 0, number + 1
                    waiting.append((keys[inside], owner[inside] - at + holders, head[:, at : at + n]))
                    held, holders = held + int(inside.sum()), holders + n
        if waiting:
            yield cut(waiting, number)

    return narrow(docs).mapInArrow(gather, _SLICE)


def _replies(slices: DataFrame, ranges: int) -> DataFrame:
    """For each range and block the keys that two documents or more hold, with their counts; rows of blocks go on as they are."""

    def count(batches):
        for to, rows in _by(batches, 0):
            if to >= ranges:
                for row in rows:
                    yield _batch([row])
                continue
            single, several = [_keys(r[2]) for r in rows], [_keys(r[4]) for r in rows]
            keys = np.concatenate(single + several)
            weights = np.concatenate([np.ones(sum(map(len, single)), np.int64), *(_unpacked(r[5]).astype(np.int64) for r in rows)])
            order = np.argsort(keys, kind="stable")
            keys, at = keys[order], _starts(keys[order])
            sums = np.add.reduceat(weights[order], at[:-1]) if len(keys) else weights
            again = sums > 1
            keys, sums = keys[at[:-1]][again], sums[again]
            out = []
            for row, s, m in zip(rows, single, several):
                place = np.searchsorted(keys, s)
                place[place == len(keys)] = 0
                hit = keys[place] == s if len(keys) else np.zeros(len(s), bool)
                if hit.any() or len(m):
                    found = np.searchsorted(keys, m)
                    out.append((to, row[1], _gaps(s[hit]), _packed(_unpacked(row[3])[hit]), _packed(sums[place[hit]]), _packed(sums[found])))
                if len(out) >= 64:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)

    return slices.repartition("to").sortWithinPartitions("to").mapInArrow(count, _SLICE)


def needed(n: int, percent: int) -> int:
    """The least overlap of a set of n with a similar set: ceil(percent / 100 * n)."""
    return -(-n * percent // 100)


def prefix_entries(keys: np.ndarray, counts: np.ndarray, n: int, percent: int) -> np.ndarray:
    """Index entries of a set of n shingles, from those that other sets hold too, in order of (count, key), and their counts.

    Empty if the set can have no partner.
    """
    spare, single = n - needed(n, percent), n - len(keys)
    if single > spare or not len(keys):
        return np.zeros(0, np.uint64)
    if n < 4:
        # Only an equal set is similar: one entry stands for all.
        return textops.mix(keys[:1] + np.uint64(n))
    rare = int(np.searchsorted(counts, FREQUENT))
    if single + rare > spare:
        return textops.mix(keys[: spare + 1 - single])
    pairs = keys[rare : rare + 2 * spare + 2]
    near = textops.sequence_hash(pairs, 2)
    far = textops.sequence_hash(np.stack((pairs[:-2], pairs[2:]), 1).ravel(), 2)[::2]
    return np.concatenate((textops.mix(keys[:rare]), near, far))


def _index(replies: DataFrame, id_kind: str, ranges: int, percent: int) -> DataFrame:
    """id, n, repeats (shingles that others hold too), fingerprints of set and text, index entries, and the repeated shingles where there are entries."""

    def assemble(batches):
        for _, rows in _by(batches, 1):
            own = next(r for r in rows if r[0] >= ranges)
            parts = sorted((r for r in rows if r[0] < ranges), key=lambda r: r[0])
            ids, known, n, one, two, h1, h2 = np.frombuffer(own[2], np.int64).reshape(7, -1)
            several, many, holders = _keys(own[3]), _unpacked(own[4]).astype(np.int64), _unpacked(own[5]).astype(np.int64)
            sums = np.concatenate([np.zeros(0, np.uint64), *(_unpacked(r[5]) for r in parts)])
            keys = np.concatenate([np.repeat(several, many), *(_keys(r[2]) for r in parts)])
            counts = np.concatenate([np.repeat(sums, many), *(_unpacked(r[4]) for r in parts)]).astype(np.int64)
            owner = np.concatenate([holders, *(_unpacked(r[3]).astype(np.int64) for r in parts)])
            order = np.lexsort((keys, counts, owner))
            keys, counts, owner = keys[order], counts[order], owner[order]
            at = np.searchsorted(owner, np.arange(len(ids) + 1))
            entries, sets = [], []
            for i in range(len(ids)):
                mine = slice(at[i], at[i + 1])
                # Shingles that share a key inside a document are one less that others can hold.
                found = prefix_entries(keys[mine], counts[mine], int(n[i]), percent) if known[i] else ()
                entries.append(np.asarray(found).astype(np.int64))
                sets.append(keys[mine].astype(np.int64) if len(found) else ())
            for i in range(0, len(ids), 4096):
                j = slice(i, i + 4096)
                columns = [pa.array(x[j]) for x in (n, at[1:] - at[:-1], one, two, h1, h2)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[j], mask=known[j] == 0).cast(arrow), *columns, pa.array(entries[j], pa.list_(pa.int64())), pa.array(sets[j], pa.list_(pa.int64()))], names=names)

    arrow = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}[id_kind]
    names = ["id", "n", "repeats", "one", "two", "h1", "h2", "entries", "keys"]
    return replies.repartition("block").sortWithinPartitions("block").mapInArrow(assemble, f"id {id_kind}, n long, repeats long, one long, two long, h1 long, h2 long, entries array<long>, keys array<long>")


def _may_link(percent: int) -> Column:
    """Two sets share no more than the smaller, nor the repeated shingles of either."""
    most = F.least("x.repeats", "y.repeats")
    return (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")) & ((100 + percent) * most >= percent * (F.col("x.n") + F.col("y.n")))


_MAPS = [f"m{i}" for i in range(4)]


def _compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of ids with n and repeats of b, whether they are similar, the differences of b from a and their map."""
    left, right = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("keys").alias("ka")), sets.select(F.col("id").alias("b"), "n", "repeats", F.col("keys").alias("kb"))
    met = pairs.join(right, "b").join(left, "a").select("a", "b", "na", "n", "repeats", "ka", "kb")

    def compare(batches):
        for batch in batches:
            na, n = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            (ka, oa), (kb, ob) = (_lists(batch.column(i)) for i in (5, 6))
            common, maps = np.zeros(len(n), np.int64), np.zeros((len(n), 256), bool)
            for i in range(len(n)):
                mine, its = ka[oa[i] : oa[i + 1]], kb[ob[i] : ob[i + 1]]
                both = np.sort(np.concatenate((mine, its)))
                twice = both[1:] == both[:-1]
                common[i] = np.count_nonzero(twice)
                alone = np.ones(len(both), bool)
                alone[1:] &= ~twice
                alone[:-1] &= ~twice
                maps[i, both[alone] & 255] = True
            words = np.packbits(maps, axis=1).view(np.int64)
            similar = 100 * common >= percent * (na + n - common)
            columns = [batch.column(0), batch.column(1), batch.column(3), batch.column(4), pa.array(similar), pa.array(na + n - 2 * common), *(pa.array(np.ascontiguousarray(words[:, i])) for i in range(4))]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "n", "repeats", "similar", "distance", *_MAPS])

    kind = pairs.schema["a"].dataType.simpleString()
    return narrow(met).mapInArrow(compare, f"a {kind}, b {kind}, n long, repeats long, similar boolean, distance long, {', '.join(f'{m} long' for m in _MAPS)}")


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column, end to end, and the offsets of its rows."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy()[: offsets[-1]], offsets


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that are similar."""
    left, right = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("keys").alias("ka")), sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("keys").alias("kb"))
    common = F.size(F.array_intersect("ka", "kb"))
    return pairs.join(right, "b").join(left, "a").where(100 * common >= percent * (F.col("na") + F.col("nb") - common)).select("a", "b")


def _across(stars: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of documents with one centre, in different components, that may be similar."""
    root = lambda of, name: roots.select(F.col("id").alias(of), F.col("root").alias(name))
    placed = stars.join(root("a", "ra"), "a", "left").join(root("b", "rb"), "b", "left")
    placed = placed.withColumn("root", F.coalesce("rb", "b")).withColumn("apart", F.col("root") != F.coalesce("ra", "a"))
    # Nothing is left to compare where all are linked to the centre.
    open_ = placed.groupBy("a").agg(F.count_if("apart").alias("far"), F.count("*").alias("group")).where("far > 0 and group > 1")
    placed = placed.join(open_.select("a", F.ceil(F.col("group") / PART).cast("int").alias("parts")), "a")
    fields = ["a", "b", "n", "repeats", "distance", "root", "apart", *_MAPS]
    part = F.pmod(F.xxhash64("b"), F.col("parts"))
    x = placed.where("apart").select(*fields, part.alias("part")).alias("x")
    y = placed.select(*fields, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).alias("y")
    delta = F.floor((100 - percent) * (F.col("x.n") + F.col("y.n")) / (100 + percent))
    alone = lambda p, q: sum((F.bit_count(F.col(f"{p}.{m}").bitwiseAND(F.bitwise_not(F.col(f"{q}.{m}")))) for m in _MAPS), F.lit(0))
    once = ~F.col("y.apart") | (F.col("x.b") < F.col("y.b"))
    own = F.col("x.n") - F.col("x.repeats") + F.col("y.n") - F.col("y.repeats")
    near = (F.abs(F.col("x.distance") - F.col("y.distance")) <= delta) & (alone("x", "y") + alone("y", "x") + own <= delta)
    met = (F.col("x.a") == F.col("y.a")) & (F.col("x.part") == F.col("y.part")) & (F.col("x.root") != F.col("y.root")) & once & _may_link(percent) & near
    return x.join(y, met).select(F.least("x.b", "y.b").alias("a"), F.greatest("x.b", "y.b").alias("b")).distinct()


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of documents that links of similarity percent / 100 or more connect.

    Returns id, n_shingles and component_id, the smallest id that links reach.  A-Z is lower-cased; a shingle is
    ``size`` words in a row, the whole sequence for a text of fewer; null texts and texts without words have none and
    link to nothing.  Ids must be integers; rows of one id share a component; a null id is its own.  Similarity is that
    of shingle hashes of ``KEY_BITS`` bits or more.  Other columns are not read.  ``percent`` is 80 at least, which the
    prefixes need.
    """
    if not 80 <= percent <= 100:
        raise ValueError("percent must be from 80 to 100")
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"))
    spread = max(1, docs.rdd.getNumPartitions())
    ranges = 1 << min(16, max(3, math.ceil(math.log2(2 * spread))))
    bits = min(64, max(KEY_BITS, 32 + math.ceil(math.log2(spread))))

    # Equal texts: one row of each goes on.
    rows = settle(docs.select("id", "h1", "h2", F.col("text").rlike(r"[^\x20\x09-\x0D]").alias("worded")), "rows")
    heads = rows.where("id is not null and worded").groupBy("h1", "h2").agg(F.min("id").alias("head"), F.max("id").alias("last")).where("head < last").drop("last")
    copies = settle(rows.join(small(heads), ["h1", "h2"]).where("id <> head").select("id", "head", "h1", "h2").distinct(), "copies")
    gone = copies.select("id", "h1", "h2")
    first = docs.join(small(gone), ["id", "h1", "h2"], "left_anti").select("id", "text", "h1", "h2")

    indexed = settle(_index(_replies(_slices(first, size, bits, ranges), ranges), kind, ranges, percent), "shingles")
    live = indexed.where(F.size("entries") > 0)
    same = ["n", "one", "two"]
    sources = live.groupBy(*same).agg(F.min("id").alias("source"))
    equal = settle(live.select("id", *same).join(sources, same).select("id", "source").distinct(), "equal")
    sets = live.join(small(equal.where("id = source").select("id")), "id", "left_semi")
    doc = F.struct((F.col("n") - F.col("repeats")).alias("own"), "id").alias("doc")
    entries = settle(sets.select(doc, F.explode("entries").alias("entry")), "entries")
    centres = entries.groupBy("entry").agg(F.min("doc").alias("a"), F.max("doc").alias("last")).where("a.id <> last.id").select("entry", F.col("a.id").alias("a"))
    pairs = settle(entries.join(centres, "entry").where("doc.id <> a").select("a", F.col("doc.id").alias("b")).distinct(), "pairs")
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    sets = sets.join(small(wanted), "id", "left_semi").select("id", "n", "repeats", "keys").dropDuplicates(["id"])
    stars = settle(_compared(pairs, sets, percent), "stars")
    drop_settled(entries)

    links = stars.where("similar").select("a", "b").unionByName(equal.where("id <> source").select(F.col("source").alias("a"), F.col("id").alias("b"))).unionByName(copies.select(F.col("head").alias("a"), F.col("id").alias("b")))
    roots = components(links)
    across = settle(_across(stars, roots, percent), "across")
    more = settle(_linked(across, sets, percent), "links")
    if more.limit(1).count():
        roots = components(roots.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(more))
    drop_settled(stars, across, equal, pairs)
    sizes = indexed.select("id", "n", "h1", "h2").unionByName(copies.join(indexed.select(F.col("id").alias("head"), "h1", "h2", "n").distinct(), ["head", "h1", "h2"]).select("id", "n", "h1", "h2"))
    sized = rows.join(sizes.distinct(), rows["id"].eqNullSafe(sizes["id"]) & (rows["h1"] == sizes["h1"]) & (rows["h2"] == sizes["h2"])).select(rows["id"], "n")
    return sized.join(roots, "id", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("root", "id").alias("component_id"))
