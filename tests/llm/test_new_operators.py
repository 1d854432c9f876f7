"""Packing, periodic runs and spelling variants against brute-force versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from math import ceil

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from proseloom.llm import packing, periodic, queries, spelling

DATA = "/root/testdata/sf0.001"
AWKWARD = [(1, None), (2, ""), (3, " \n"), (4, "x"), (5, "<|endoftext|> It's\x1cA b ́e café CAFÉ ΣΣ"), (5, "x"), (None, "a b"), (7, "word " * 9000), (8, "中文" * 700)]


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'z' AS length", "1 AS ids", "'q' AS word", "0 AS piece")


# Packing


def plain_pieces(rows, capacity=2048):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    out = []
    for doc_id, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        out += [(doc_id, i, s, ids[s : s + capacity]) for i, s in enumerate(range(0, len(ids), capacity))]
    return out


def check_packing(rows, capacity):
    """No gap, no overlap, nothing above the capacity."""
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for held in by.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("capacity", [2048, 16])
def test_pieces_are_the_librarys_ids_and_lie_gapless(spark, capacity):
    rows = packing.pack_documents(table(spark, AWKWARD), public_tokenizers.path("word_bpe_49k.json"), capacity)
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"]
    got = rows.collect()
    expected = plain_pieces(AWKWARD, capacity)
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in got) == Counter((d, i, s, len(x), zlib.crc32(np.array(x, "<u4").tobytes()), tuple(x)) for d, i, s, x in expected)
    used = check_packing(got, capacity)
    assert used <= ceil(sum(r.length for r in got) / capacity) + 2
    joined = packing.sequences(rows).collect()
    assert len(joined) == used and sum(len(r.ids) for r in joined) == sum(r.length for r in got)


def test_empty_table_packs_to_nothing(spark):
    assert packing.pack_documents(table(spark, []), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_packing_of_all_documents_is_near_the_bound(spark):
    rows = queries.op11_best_fit_packing(spark, DATA).collect()
    assert check_packing(rows, 2048) <= 1.02 * sum(r.length for r in rows) / 2048 + 1


def test_plans_hold_every_piece_and_few_sequences():
    rnd = random.Random(5)
    for kind in range(5):
        counts: Counter = Counter()
        for _ in range(4000):
            length = (lambda: rnd.randrange(1, 2049), lambda: rnd.randrange(600, 1000), lambda: min(2048, int(rnd.lognormvariate(6, 1)) + 1), lambda: 2048, lambda: rnd.choice([700, 650, 1]))[kind]()
            counts[length] += rnd.choice([1, 1, 10**9])
        bins = packing.plan(counts, 2048)
        held: Counter = Counter()
        for one in bins:
            assert one.n > 0 and sum(a * b for a, b in one.held) + one.room == 2048 and one.room >= 0
            for length, each in one.held:
                held[length] += each * one.n
        assert held == counts
        assert len(bins) < 8 * 2048
        if kind in (0, 2, 3):
            assert sum(x.n for x in bins) <= 1.015 * sum(a * b for a, b in counts.items()) / 2048 + 1


def test_groups_have_equal_cardinality():
    counts = [(length, 1 + length % 5) for length in range(2000, 300, -1)]
    groups = packing.equal_groups(counts, 40)
    sizes = [sum(n for _, n in g) for g in groups]
    assert len(groups) == 40 and max(sizes) - min(sizes) <= 1 and sum(sizes) == sum(n for _, n in counts)


# Periodic runs


def plain_runs(words):
    seen = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                seen.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in seen.items())


def plain_planted(doc_id, words):
    if doc_id is None or not words:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def plain_row(doc_id, words):
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    text = " ".join(w for i, w in enumerate(words) if i not in drop)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_runs_are_those_of_brute_force():
    rnd = random.Random(11)
    for _ in range(1500):
        words, kinds = [], rnd.choice([1, 2, 3, 8])
        for _ in range(rnd.randrange(0, 9)):
            block = [rnd.randrange(kinds) for _ in range(rnd.randrange(1, rnd.choice([3, 12, 30])))]
            words += (block * rnd.randrange(1, 8))[: rnd.randrange(1, 150)]
        assert periodic.find_runs(np.array(words, np.int64)) == plain_runs(words)


def test_long_periodic_texts_take_no_square_of_time():
    assert periodic.find_runs(np.zeros(200_000, np.int64)) == [(0, 200_000, 1)]
    assert periodic.find_runs(np.arange(200_000) % 50_000) == [(0, 200_000, 50_000)]
    assert len(periodic.find_runs(np.tile([0] * 500 + [1], 200))) == 201


def test_strongest_run_is_exact_and_earliest():
    assert periodic.strongest([]) is None
    assert periodic.strongest([(0, 12, 3), (20, 8, 2), (30, 4 * 10**17 + 1, 10**17)]) == (30, 4 * 10**17 + 1, 10**17)
    assert periodic.strongest([(0, 12, 3), (20, 8, 2)]) == (0, 12, 3)


def test_periodic_runs_of_awkward_rows(spark):
    rows = [(1, None), (2, ""), (3, "\n \n"), (4, "a a a a a"), (4, "a a a a a a"), (6, "x b\nc b\tc b c b c z"), (None, "q " * 7), (8, "é é " * 40)]
    got = periodic.periodic_runs(table(spark, rows)).collect()
    expected = [plain_row(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    made = [(r.doc_id, len(r.runs), r.start, r.length, r.period, r.exponent_milli, hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in r.runs).encode()).hexdigest(), hashlib.sha256(r.collapsed.encode()).hexdigest()) for r in got]
    assert sorted(made, key=str) == sorted(expected, key=str)
    assert periodic.periodic_runs(table(spark, [])).count() == 0
    assert periodic.with_planted_runs(table(spark, [])).count() == 0


def test_op12_equals_brute_force_on_all_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    # Brute force takes the square of a text's length, so it leaves the longest texts out.
    plain = {r.doc_id: plain_planted(r.doc_id, re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs}
    got = {r.doc_id: tuple(r) for r in queries.op12_periodic_runs(spark, DATA).collect()}
    assert set(got) == set(plain)
    for doc_id, words in plain.items():
        if len(words) < 1500:
            assert got[doc_id] == plain_row(doc_id, words)
    assert sum(r[1] for r in got.values()) > 5


# Spelling variants


def plain_groups(counts):
    letters = sorted(set("".join(counts)))
    form, out = {}, []
    for word in counts:
        edits = {word[:i] + word[i + 1 :] for i in range(len(word))}
        edits |= {word[:i] + a + word[i + k :] for i in range(len(word) + 1) for a in letters for k in (0, 1)}
        near = [w for w in edits - {word} if w in counts]
        best = min(near, key=lambda w: (-counts[w], w), default=None)
        form[word] = (best if best and counts[best] >= 2 * counts[word] else None, len(near))
    for word, (best, near) in form.items():
        root = word
        while form[root][0]:
            root = form[root][0]
        out.append((word, best, root, counts[word], near, counts[best] if best else None))
    return sorted(out, key=str)


def plain_counts(rows, drop_every):
    counts: Counter = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if drop_every and h % drop_every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def test_edits_are_distinct_and_complete():
    words, letters = ["aab", "b", "abba", "×éz"], np.array(sorted(map(ord, "abzé×")), np.uint32)
    made = defaultdict(list)
    own = spelling.Hashes(words, letters)
    by_hash = {}
    for hashes, word, place, letter, out in own.edits():
        for h, w, i, a in zip(hashes.tolist(), word.tolist(), place.tolist(), letter.tolist()):
            text = words[w][:i] + (chr(letters[a]) if a >= 0 else "") + words[w][i + out :]
            made[words[w]].append(text)
            by_hash[h] = text
    for word in words:
        edits = {word[:i] + word[i + 1 :] for i in range(len(word))}
        edits |= {word[:i] + chr(a) + word[i + k :] for i in range(len(word) + 1) for a in letters for k in (0, 1)}
        assert Counter(made[word]) == Counter(edits - {word})
    kept = [t for t in by_hash.values() if t]
    assert spelling.Hashes(kept, letters).words().tolist() == [h for h, t in by_hash.items() if t]


def test_groups_of_awkward_words(spark):
    rows = [(1, None), (2, ""), (3, "12 34"), (4, "hello " * 9 + "hallo " * 4 + "hullo " * 4 + "hallÖ " * 3), (4, "Hello HELLO Étude étude " * 3), (None, "hello hellö " * 3), (5, "abcde " * 3 + "abcdef " * 6 + "abcdefg " * 12 + "abcdeg " * 12), (6, "x" * 30_000 + " " + "x" * 30_000 + " " + "x" * 30_000 + (" " + "x" * 29_999) * 7)]
    dropped = sorted(map(tuple, spelling.spelling_groups(spelling.word_counts(table(spark, rows[:-1]), drop_every=5)).collect()), key=str)
    assert dropped == plain_groups(plain_counts(rows[:-1], 5))
    plain = sorted(map(tuple, spelling.spelling_groups(spelling.word_counts(table(spark, rows))).collect()), key=str)
    long = [r for r in plain if len(r[0]) > 100]
    assert [(len(r[0]), r[1] and len(r[1]), len(r[2]), *r[3:]) for r in long] == [(29_999, None, 29_999, 7, 1, None), (30_000, 29_999, 29_999, 3, 1, 7)]
    assert [r for r in plain if len(r[0]) < 100] == plain_groups(plain_counts(rows[:-1], None))
    assert spelling.spelling_groups(spelling.word_counts(table(spark, []))).count() == 0


def test_op13_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, queries.op13_spelling_variants(spark, DATA).collect()), key=str)
    assert got == plain_groups(plain_counts(docs, 97))
    assert sum(r[1] is not None for r in got) > 20
