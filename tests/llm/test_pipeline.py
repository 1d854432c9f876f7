"""The whole pipeline against a plain version of each stage."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
from test_documents import plain_counts, plain_groups, plain_lines
from tokenizers import Tokenizer

import corpus_pipeline
from proseloom.llm import linededup, quality


def plain_quality(text):
    """Base rule, then every rule, in no order."""
    n_words, word_chars, symbols, duplicates, repeats = plain_counts(text)
    if n_words < 10 or 100 * repeats > 20 * n_words:
        return False
    lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in text.split("\n"))
    page = quality.Page(n_words, word_chars, symbols, duplicates, repeats, lines, text.encode())
    return not any(rule.rejects(page) for rule in quality.RULES)


def plain_contaminated(text, items):
    words = re.findall(r"[^\W_]+", text.lower())
    grams = lambda w: Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
    for item in items:
        whole = grams(item)
        for j in range(max(1, len(words) - len(item) + 1)):
            part = grams(words[j : j + len(item)])
            common = sum((part & whole).values())
            if 10 * common >= 8 * (sum(part.values()) + sum(whole.values()) - common):
                return True
    return False


def fixture():
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9)))
    vocabulary = [word() for _ in range(3000)]
    said = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [said(rng.randint(16, 30)) for _ in range(6)]
    notice = said(14)
    rows = []
    for i in range(60):
        lines = [said(rng.randint(12, 40)) for _ in range(rng.randint(1, 4))]
        if i % 5 == 0:
            lines.insert(rng.randrange(len(lines) + 1), notice)
        if i % 9 == 0:
            lines.append(f"{said(6)} {rng.choice(items)} {said(5)}")
        rows.append("\n".join(lines))
    for i in range(0, 60, 6):
        rows.append(rows[i])
        changed = rows[i + 1].split(" ")
        changed[len(changed) // 2] = "changed"
        rows.append(" ".join(changed))
        rows.append(rows[i + 2].replace("\n", " ") + " tail")
    rows += [None, "", "too short", said(5) * 30, "# $ % & " * 20, "again and " * 30, "x " * 3000]
    return [(i, t) for i, t in enumerate(rows)], [(100 + k, t) for k, t in enumerate(items)]


def test_pipeline_is_its_stages(spark, tmp_path):
    rows, items = fixture()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source", "cast(length(text) AS long) AS n_chars")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    kept = [(i, t) for i, t in rows if plain_quality(t)]
    lined = plain_lines(kept, linededup.MIN_WORDS)
    kept = [(i, lined[i][0]) for i, _ in kept if re.search(r"[^\x20\x09-\x0D]", lined[i][0])]
    group = plain_groups(kept, corpus_pipeline.SHINGLE, corpus_pipeline.PERCENT)
    kept = [(i, t) for i, t in kept if group[i][1] == i]
    kept = [(i, t) for i, t in kept if not plain_contaminated(t, [t.split() for _, t in items])]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for i, t in kept:
        ids = library.encode(t, add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    got = {r[0]: tuple(r[1:]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want and 30 < len(want) < len(rows)


def test_pipeline_without_documents(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
