"""Benchmark decontamination with SimHash over item-sized windows, in DataFrame functions only.

Texts are lower-cased sequences of letters and digits; shingles are ``SHINGLE`` words in a row.  A window has as many
words as a benchmark item.  Its 64-bit SimHash weighs each shingle by how often it occurs.  Fingerprints are cut into
eight blocks of 8 bits; of two fingerprints within ``RADIUS`` bits one block differs in ``RADIUS // 8`` bits at most, so
items are filed by their size under every block value within that many bits, windows of that size look their blocks up,
and all fingerprints within the radius meet.  Those pairs are verified by the exact weighted Jaccard similarity of their
shingles.

Windows are placed where they can matter: a window as similar as asked shares all but D of the item's shingles, so one of
any D + 1 of them is in it.  Every window of an item's size that holds one of these is fingerprinted, whatever the order
of the words around it; texts without such a shingle need no fingerprint.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proseloom.llm.store import settle, small

SHINGLE = 5
#: Bits; of 80,000 random pairs at similarity 0.82 none differed in more than 21, and 0.8 to 1.5 % in more than 15.
RADIUS = 23
PERCENT = 80
BLOCKS, BLOCK_BITS = 8, 8

#: Every 8-bit value with at most RADIUS // BLOCKS bits set, by rule.
_MASKS = [sum(1 << b for b in bits) for k in range(RADIUS // BLOCKS + 1) for bits in itertools.combinations(range(BLOCK_BITS), k)]


def word_list(text: Column) -> Column:
    """Lower-cased words of letters and digits; none for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), lambda x: body(x))[0]


def shingle_list(words: Column) -> Column:
    """Shingle hashes in order; a shorter text has one for all its words, an empty one none."""

    def of(w: Column) -> Column:
        n = F.size(w)
        many = F.transform(F.sequence(F.lit(0), F.greatest(n - SHINGLE, F.lit(0))), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(SHINGLE))))
        return F.when(n >= SHINGLE, many).when(n > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<long>"))

    return _let(words, of)


def simhash(shingles: Column) -> Column:
    """Bit b is set if more than half of the shingles, counted as often as they occur, have it set."""

    def of(s: Column) -> Column:
        ones = lambda b: F.aggregate(s, F.lit(0), lambda n, h: n + F.call_function("shiftrightunsigned", h, b).bitwiseAND(F.lit(1)).cast("int"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda out, b: out.bitwiseOR(F.when(2 * ones(b) > F.size(s), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))))

    return _let(shingles, of)


def block(fingerprint: Column, k: int) -> Column:
    return F.shiftrightunsigned(fingerprint, BLOCK_BITS * k).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")


def numbered(shingles: Column) -> Column:
    """Occurrences as distinct elements: each shingle with its number among equal ones, which makes sets of multisets."""

    def of(s: Column) -> Column:
        several = F.transform(s, lambda h, i: F.xxhash64(h, F.size(F.filter(F.slice(s, F.lit(1), i + 1), lambda g: g == h))))
        single = F.transform(s, lambda h: F.xxhash64(h, F.lit(1)))
        return F.when(F.size(F.array_distinct(s)) == F.size(s), single).otherwise(several)

    return _let(shingles, of)


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of numbered shingles."""
    common = F.size(F.array_intersect(a, b))
    return common / (F.size(a) + F.size(b) - common)


def _items(benchmark: DataFrame, item_col: str, text_col: str, percent: int) -> DataFrame:
    items = benchmark.select(F.col(item_col).alias("item_id"), word_list(F.col(text_col)).alias("words")).where("size(words) > 0")
    items = items.select("item_id", F.size("words").alias("size"), shingle_list(F.col("words")).alias("shingles"))
    return items.withColumn("fingerprint", simhash(F.col("shingles"))).withColumn("keys", numbered(F.col("shingles")))


def _short_items(texts: DataFrame, items: DataFrame) -> DataFrame:
    """Places of items that have fewer words than a shingle: their only shingle, at any place of a text."""
    short = items.where(F.col("size") < SHINGLE)
    sizes = [r[0] for r in short.select("size").distinct().collect()]
    whole = short.select("item_id", "size", F.col("shingles")[0].alias("shingle"))

    def runs(words: Column, k: int) -> Column:
        one = lambda i: F.struct(F.xxhash64(F.array_join(F.slice(words, i + 1, k), " ")).alias("shingle"), F.lit(k).alias("size"), i.alias("start"))
        none = F.array().cast("array<struct<shingle: bigint, size: int, start: int>>")
        return F.when(F.size(words) >= k, F.transform(F.sequence(F.lit(0), F.size(words) - k), one)).otherwise(none)

    def of(words: Column) -> Column:
        return F.concat(*(runs(words, k) for k in sizes))

    none = whole.select(F.lit(None).cast(texts.schema["id"].dataType).alias("id"), "item_id", F.lit(1.0).alias("similarity"), F.lit(0).alias("distance"), F.lit(0).alias("start")).where("false")
    if not sizes:
        return none
    read = texts.select("id", F.explode(_let(word_list(F.col("text")), of)).alias("w")).select("id", "w.*")
    return read.join(small(whole), ["shingle", "size"]).select("id", "item_id", F.lit(1.0).alias("similarity"), F.lit(0).alias("distance"), "start")


def windows_of(texts: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """id, size, start, fingerprint and keys of the windows of (id, text) that an item of their size may be as similar to.

    The anchors of an item, one shingle more than a window may lack, are the first ones by hash; a window that holds none
    of them cannot be similar enough.
    """
    spare = F.size("shingles") - F.ceil(F.size("shingles") * F.lit(percent) / 100).cast("int")
    anchors = items.select("size", F.explode(F.slice(F.array_sort(F.array_distinct("shingles")), F.lit(1), spare + 1)).alias("shingle")).distinct()
    read = texts.select("id", F.posexplode(shingle_list(word_list(F.col("text")))).alias("at", "shingle"))
    found = read.join(small(anchors), "shingle").groupBy("id").agg(F.collect_set(F.struct("size", "at")).alias("places"))
    places = settle(found, "places")

    def cut(shingles: Column) -> Column:
        # Windows are cut before they become rows, so that no row carries the whole text.
        def starts(p: Column) -> Column:
            width = F.greatest(F.lit(1), p["size"] - (SHINGLE - 1))
            last = F.greatest(F.lit(0), F.size(shingles) - width)
            return F.transform(F.sequence(F.least(last, F.greatest(F.lit(0), p["at"] - width + 1)), F.least(last, p["at"])), lambda i: F.struct(p["size"].alias("size"), i.alias("start")))

        def one(w: Column) -> Column:
            return F.struct(w["size"].alias("size"), w["start"].alias("start"), F.slice(shingles, w["start"] + 1, F.greatest(F.lit(1), w["size"] - (SHINGLE - 1))).alias("shingles"))

        return F.transform(F.array_distinct(F.flatten(F.transform("places", starts))), one)

    again = texts.join(small(places, 16 * F.size("places")), "id")
    cuts = again.select("id", F.explode(_let(shingle_list(word_list(F.col("text"))), cut)).alias("w")).select("id", "w.*")
    return cuts.select("id", "size", "start", simhash(F.col("shingles")).alias("fingerprint"), numbered(F.col("shingles")).alias("keys"))


def meeting(windows: DataFrame, items: DataFrame) -> tuple[DataFrame, Column]:
    """Windows by the value of each block, with the items of their size that are filed there; and what makes a pair count."""
    blocks = lambda name: F.explode(F.array(*(F.struct(F.lit(k).alias("block"), block(F.col(name), k).alias("value")) for k in range(BLOCKS)))).alias("b")
    probes = windows.select("id", "size", "start", "keys", F.col("fingerprint").alias("f"), blocks("fingerprint")).select("id", "size", "start", "keys", "f", "b.*")
    filed = items.select("item_id", "size", F.col("fingerprint").alias("g"), blocks("fingerprint")).select("item_id", "size", "g", "b.block", F.explode(F.transform(F.array(*map(F.lit, _MASKS)), lambda m: m.bitwiseXOR(F.col("b.value")))).alias("value"))
    # A pair can meet in several blocks; the first of them counts.
    bits = lambda k: F.bit_count(block(F.col("f"), k).bitwiseXOR(block(F.col("g"), k)))
    first = F.coalesce(*(F.when(bits(k) <= RADIUS // BLOCKS, F.lit(k)) for k in range(BLOCKS)))
    return probes.join(small(filed), ["size", "block", "value"]), (F.bit_count(F.col("f").bitwiseXOR(F.col("g"))) <= RADIUS) & (first == F.col("block"))


def near_pairs(windows: DataFrame, items: DataFrame) -> DataFrame:
    """id, start, keys, item_id and distance of all windows and items of one size within ``RADIUS`` bits."""
    met, counts = meeting(windows, items)
    return met.where(counts).select("id", "start", "keys", "item_id", F.bit_count(F.col("f").bitwiseXOR(F.col("g"))).alias("distance"))


def contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Documents with a window that is as similar as ``percent`` / 100 to a benchmark item, and near in SimHash.

    Returns, for each document and item, id, item_id, similarity, distance (bits) and start_word of the best window;
    ties go to the first.  Null and empty texts match nothing; an item of fewer than ``SHINGLE`` words has one shingle and
    matches windows of just its words; a document shorter than an item is one window.  Rows of one id count together,
    equal items are all reported, and other columns are not read.  What comes of the benchmark, and the places where
    windows lie, are broadcast within ``small``'s bound of bytes, else joined by shuffles, of the documents too.
    """
    items = settle(_items(benchmark, item_col, item_text_col, percent), "items")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    near = near_pairs(windows_of(texts, items, percent), items)
    sets = small(items.select("item_id", F.col("keys").alias("item_keys")), 8 * F.size("item_keys"))
    verified = near.join(sets, "item_id").withColumn("similarity", similarity(F.col("keys"), F.col("item_keys"))).where(F.col("similarity") * 100 >= percent)
    verified = verified.select("id", "item_id", "similarity", "distance", "start").unionByName(_short_items(texts, items))
    best = verified.groupBy("id", "item_id").agg(F.min_by(F.struct("similarity", "distance", "start"), F.struct(-F.col("similarity"), "start")).alias("best"))
    return best.select(F.col("id").alias(id_col), "item_id", "best.similarity", F.col("best.distance").cast("int").alias("distance"), F.col("best.start").cast("int").alias("start_word"))
