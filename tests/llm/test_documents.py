"""Operators on documents against brute-force versions and held-out accuracy."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from proseloom.sources import shared
from proseloom.llm import components, decontaminate, jaccard, langid, linededup, quality, textops, toxicity

DATA = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
AWKWARD = [(1, None), (2, ""), (3, "\n\n"), (4, "a\na\n a\nb b b b b b b b b b b"), (5, "x"), (6, "é a\n"), (7, ""), (8, "A b c d e f g h i j k l"), (8, "A b c d e f g h i j k l"), (9, "wörd " * 3000)]


def documents(spark, rows=AWKWARD, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.selectExpr("*", "'z' AS kept", "1 AS score", "'q' AS runs") if extra else df


def test_runs_cut_batches_by_bytes():
    texts = pa.array(["a" * 10, None, "", "b" * 50, "c"]).slice(1)
    got = []
    for run in textops.runs(texts, 20):
        got += [bytes(run.data[a:b]) for a, b in zip(run.starts, run.ends)]
    assert got == [b"", b"", b"b" * 50, b"c"]


def plain_counts(text):
    text = text or ""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    seen = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark):
    for df in (documents(spark), spark.read.parquet(f"{DATA}/documents.parquet")):
        texts = {r.doc_id: r.text for r in df.collect()}
        for r in quality.quality(df).collect():
            n_words, *_, repeat = want = plain_counts(texts[r.doc_id])
            assert tuple(r[1:6]) == want
            assert r.base_failed == (n_words < 10 or 100 * repeat > 20 * n_words) and not (r.base_failed and r.kept)


def test_quality_order_changes_no_verdict(spark):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    a = {r.doc_id: r.kept for r in quality.quality(df).collect()}
    assert a == {r.doc_id: r.kept for r in quality.quality(df, quality.RULES[::-1]).collect()}
    assert {r.doc_id for r in quality.kept_documents(df).collect()} == {i for i, kept in a.items() if kept}
    good = {r.doc_id for r in spark.read.parquet(f"{DATA}/labels.parquet").where("quality = 1").collect()}
    failed = {r.doc_id for r in quality.quality(df).where("base_failed").collect()}
    assert all(a[i] for i in good - failed)


def test_language_held_out(spark):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    truth = {r.doc_id: r.lang for r in df.collect()}
    held = [r for r in langid.identify(df).collect() if r.held_out]
    assert held and np.mean([truth[r.doc_id] == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in held)


def test_language_without_letters_or_lessons(spark):
    df = documents(spark, [(1, None), (2, ""), (3, "12 !?"), (5, "½ ²"), (6, "Ⅷ①"), (4, "hello"), (7, "wörd " * 40_000)]).selectExpr("*", "cast(null as string) lang")
    assert {r.lang_pred for r in langid.identify(df).collect()} == {"und"}
    model = langid.fit(["der die das und", "the and of to"], ["de", "en"])
    got = {r.doc_id: r.lang_pred for r in langid.identify(df, model=model).collect()}
    assert {got[i] for i in (1, 2, 3, 5, 6)} == {"und"} and got[4] in ("de", "en") and got[7] in ("de", "en")
    assert langid.identify(df.where("false"), model=model).count() == langid.identify(df.where("false")).count() == 0
    assert {r.lang_pred for r in langid.identify(documents(spark).withColumn("lang", F.lit("x"))).where("doc_id = 9").collect()} == {"x"}


def test_toxicity_finds_planted_words(spark):
    rng = random.Random(3)
    mild, bad = [f"w{i}" for i in range(300)], ["vileish", "grubby", "nastic"]
    rows, labels = [], []
    for i in range(1200):
        words = rng.choices(mild, k=rng.randint(30, 300))
        if i % 8 == 0:
            words[rng.randrange(len(words))] = rng.choice(bad)
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 8 == 0)))
    out = toxicity.score(documents(spark, rows + [(5000, None), (5001, "")]), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    truth = dict(labels)
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert sum(r.predicted for r in held) >= 0.9 * sum(truth[r.doc_id] for r in held)
    assert len(out) == 1202 and all(0 <= r.score <= 1 for r in out)


def test_toxicity_without_a_class(spark):
    labels = spark.createDataFrame([(8, 0)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(documents(spark), labels).collect()} == {0.0}


def test_toxicity_model_holds_all_that_was_counted(spark):
    """However much else was counted, what is rare keeps its own ratio."""
    rows = [(0x616161616161, 0, 1 << 40), (0x626262626262, 1, 0), (0x626262626263, 0, 1), (0x646464646464, 5, 0), (0x656565656565, 1 << 40, 0)]
    counts = spark.createDataFrame(rows, "gram long, toxic long, ordinary long")
    seen, unseen = ({r[0]: r[1] for r in t.collect()} for t in toxicity.ratios(counts))
    assert set(seen) == {r[0] for r in rows} and set(unseen) == {r[0] >> 8 for r in rows}
    assert seen[0x626262626262] > 0 > seen[0x626262626263]
    assert {r[0] for r in toxicity.word_ratios(counts).collect()} == {0x61616161, 0x64646464, 0x65656565}


def test_toxicity_tables_in_files_score_alike(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "PIECE", 5000)
    docs, labels = (spark.read.parquet(f"{DATA}/{x}.parquet") for x in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    assert model.held and len(model.files[0]) > 1
    keys = np.random.default_rng(0).permutation(np.concatenate([next(toxicity._pieces(model.files[0]))[0], np.arange(1000, dtype=np.uint64)]))
    for held, files in zip(model.tables(), model.files):
        (a, b), (c, d) = held(keys), toxicity.Filed(files)(keys)
        assert (a == c).all() and (b == d).all()
    held = {r.doc_id: r.score for r in toxicity.score(docs, labels, model=model).collect()}
    model.held = False
    assert held == pytest.approx({r.doc_id: r.score for r in toxicity.score(docs, labels, model=model).collect()})


def test_toxicity_counts_all_rows_that_fit_no_weights(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "WEIGHT_ROWS", 10)
    counted, count = {}, toxicity.count_grams
    monkeypatch.setattr(toxicity, "count_grams", lambda rows, *keys: counted.update({r.doc_id: r.toxic for r in rows.collect()}) or count(rows, *keys))
    labels = spark.createDataFrame([(i, i % 2) for i in range(2000)], "doc_id long, toxic int")
    model = toxicity.train(documents(spark, [(i, f"some words of row {i} {'bad' * (i % 2)}") for i in range(2000)]), labels)
    training = labels.where(~toxicity.held_out("doc_id")).count()
    assert model.weights is not None and 0 < training - len(counted) < 60


def plain_groups(rows, size, percent):
    sets, parent, holders = {}, {}, {}
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + size]) for j in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        for j in {j for g in s for j in holders.get(g, ())}:
            common = len(s & sets[j])
            if 100 * common >= percent * (len(s) + len(sets[j]) - common):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for g in s:
            holders.setdefault(g, []).append(i)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("seed,size,percent", [(0, 4, 85), (1, 5, 80)])
def test_jaccard_components_are_exact(spark, monkeypatch, seed, size, percent):
    monkeypatch.setattr(jaccard, "FREQUENT", 4)
    monkeypatch.setattr(jaccard, "PART", 8)
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", 50)
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(4, 60))] for _ in range(40)]
    rows = []
    for i in range(900):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            at, kind = rng.randrange(len(words)), rng.random()
            if kind < 0.4:
                words[at] = rng.choice(vocabulary)
            elif kind < 0.7 and len(words) > 2:
                del words[at]
            else:
                words.insert(at, rng.choice(vocabulary))
        rows.append((3 * i, " ".join(words + (rng.choice(base) if rng.random() < 0.2 else []))))
    rows += [(9001, None), (9002, ""), (9003, "a"), (9004, "A"), (9005, "b")]
    got = {r[0]: (r[1], r[2]) for r in jaccard.jaccard_components(documents(spark, rows), size, percent).collect()}
    assert got == plain_groups(rows, size, percent)


def test_jaccard_on_empty_tables_and_bad_thresholds(spark):
    assert jaccard.jaccard_components(documents(spark, [])).count() == 0
    assert [tuple(r) for r in jaccard.jaccard_components(documents(spark, [(1, None)])).collect()] == [(1, 0, 1)]
    with pytest.raises(ValueError):
        jaccard.jaccard_components(documents(spark), percent=70)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(10, 40)] + [(100, i) for i in range(101, 120)] + [(5, 5)]
    got = {r.id: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 10 for i in range(11, 41)} | {i: 100 for i in range(101, 120)}


def plain_lines(rows, least):
    strip, seen, out = (lambda x: x.strip(" \t\r\x0b\x0c")), {}, {}
    for i, t in sorted(r for r in rows if r[1] is not None):
        lines = t.split("\n")
        worded, gone = [(k, x) for k, x in enumerate(lines) if WORD.search(x)], set()
        for a in range(len(worded)):
            n = 0
            for b in range(a, min(len(worded), a + 12)):
                n += len(WORD.findall(worded[b][1]))
                if n >= least:
                    key = tuple(strip(worded[k][1]) for k in range(a, b + 1))
                    if seen.setdefault(key, (i, a)) < (i, a):
                        gone |= set(range(worded[a][0], worded[b][0] + 1))
        out[i] = ("\n".join(x for k, x in enumerate(lines) if k not in gone), len(lines), len(gone))
    return out | {i: (None, 0, 0) for i, t in rows if t is None}


def test_line_dedup_is_exact(spark):
    rng = random.Random(1)
    lines = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5))) for _ in range(14)] + ["", " "]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 9)))) for i in range(250)] + [(900, None), (901, ""), (902, "\n")]
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in linededup.dedup_lines(documents(spark, rows).repartition(5), 6).collect()}
    assert got == plain_lines(rows, 6)
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in linededup.dedup_lines(df).collect()}
    assert got == plain_lines([tuple(r) for r in df.select("doc_id", "text").collect()], linededup.MIN_WORDS)


def test_line_dedup_by_shuffle_and_on_nothing(spark, monkeypatch):
    monkeypatch.setattr(shared, "BROADCAST_BYTES", 0)
    rows = [(1, "one two three four five six seven eight\nx"), (2, "y\none two three four five six seven eight")]
    assert {r.doc_id: r.text for r in linededup.dedup_lines(documents(spark, rows)).collect()} == {1: rows[0][1], 2: "y"}
    assert linededup.dedup_lines(documents(spark, [])).count() == 0


def test_line_dedup_keeps_rows_of_one_id_apart(spark):
    shared_line, other = "one two three four five six seven eight", "an innocent second line of more than eight words"
    rows = [(1, shared_line), (2, f"x\n{shared_line}"), (2, f"{other}\ny"), (3, f"{other}\n{shared_line}\n" + "z " * 50_000), (None, shared_line)]
    got = sorted((r.doc_id or 0, r.text, r.n_removed) for r in linededup.dedup_lines(documents(spark, rows)).collect())
    assert got == [(0, shared_line, 0), (1, shared_line, 0), (2, f"{other}\ny", 0), (2, "x", 1), (3, "z " * 50_000, 2)]


def test_a_selected_line_is_emitted_once(spark):
    """Windows of many short lines select few places."""
    rows = [(i, "\n".join(f"w{i * 1000 + j}" for j in range(400))) for i in range(5)]
    table = linededup._line_table(documents(spark, rows), "doc_id", "text", 16).selectExpr("size(picks) n", "size(array_distinct(picks)) d").collect()
    assert all(r.n == r.d and r.n < 400 / 5 for r in table)


def test_decontamination(spark):
    item = " ".join(f"word{i}" for i in range(30))
    rows = [(1, f"Before it. {item.upper()}, after"), (2, "nothing here at all"), (3, None), (4, ""), (5, item), (6, " ".join(item.split()[:15])), (7, "three short words"), (8, "short, words THREE"), (9, f"a b {item} c {item}"), (10, "inside: Short words, three. " + "and so on " * 2_000), (5, "nothing"), (5, item)]
    benchmark = spark.createDataFrame([(10, item), (11, "short words three"), (12, None), (13, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.similarity, r.distance, r.start_word) for r in decontaminate.contaminated(documents(spark, rows), benchmark).collect()}
    assert got == {(1, 10): (1.0, 0, 2), (5, 10): (1.0, 0, 0), (8, 11): (1.0, 0, 0), (9, 10): (1.0, 0, 2), (10, 11): (1.0, 0, 1)}
    assert decontaminate.contaminated(documents(spark, []), benchmark).count() == decontaminate.contaminated(documents(spark, rows), benchmark.where("false")).count() == 0


def test_decontamination_finds_edited_items(spark):
    """Every document that holds an item with edits down to a similarity of 0.8, against all windows by brute force."""
    rng = random.Random(5)
    items = [[f"i{k}w{rng.randrange(10**6)}" for _ in range(rng.randint(24, 70))] for k in range(30)]
    rows, want = [], {}
    shingles = lambda w: Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
    for i in range(900):
        k = i % len(items)
        words = list(items[k])
        for _ in range(rng.randint(1, 2)):
            at, kind = rng.choice((rng.randrange(len(words)), rng.randrange(3))), rng.random()
            words[at : at + (kind < 0.7)] = [] if kind < 0.3 else [f"x{i}"]
        text = [f"b{i}x{j}" for j in range(9)] + words + [f"a{i}x{j}" for j in range(9)]
        n, whole, best = len(items[k]), shingles(items[k]), 0
        for j in range(len(text) - n + 1):
            part = shingles(text[j : j + n])
            common = sum((part & whole).values())
            best = max(best, common / (2 * (n - 4) - common))
        rows.append((i, " ".join(text)))
        if best >= 0.8:
            want[i, k] = best
    benchmark = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(documents(spark, rows), benchmark).collect()}
    assert sum(x <= 0.85 for x in want.values()) > 100 and got == pytest.approx(want)


def test_decontamination_is_similarity_of_shingles(spark):
    words = [f"t{i}" for i in range(60)]
    edited = words[:3] + ["x"] + words[4:]
    got = decontaminate.contaminated(documents(spark, [(1, "a b c " + " ".join(edited) + " d")]), spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")).first()
    assert got.start_word == 3 and got.similarity == pytest.approx(52 / 60) and got.distance <= decontaminate.RADIUS


def test_decontamination_finds_reordered_items_and_compares_few_pairs(spark):
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(4000)]
    items = [(i, " ".join(rnd.choices(words, k=rnd.randrange(16, 100)))) for i in range(5000)]
    rows, wanted = [], set()
    for i in range(0, 5000, 25):
        w = items[i][1].split()
        # Cut in two and changed over, with other words around: only the shingles over the cuts are gone.
        cut = rnd.randrange(len(w) // 3, 2 * len(w) // 3)
        rows.append((i, " ".join(rnd.choices(words, k=rnd.randrange(0, 60)) + w[cut:] + w[:cut] + rnd.choices(words, k=30))))
        kept, all_ = len(w) - 4 - 4, len(w) - 4
        if kept / (2 * all_ - kept) >= 0.8:
            wanted.add((i, i))
    rows += [(10_000 + i, " ".join(rnd.choices(words, k=300))) for i in range(100)]
    docs, benchmark = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, benchmark).select("doc_id", "item_id").collect()}
    assert len(wanted) > 50 and len(wanted - got) <= len(wanted) // 50 and all(d == i for d, i in got)
    held = decontaminate.settle(decontaminate._items(benchmark, "item_id", "text", 80), "items")
    windows = decontaminate.settle(decontaminate.windows_of(docs.select(F.col("doc_id").alias("id"), "text"), held), "windows")
    met, _ = decontaminate.meeting(windows, held)
    assert met.select("id", "size", "start", "item_id").distinct().count() < 0.05 * windows.count() * 5000
