import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from proseloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["a", "b", " ", "  ", "\n", "é", "'s", "'ll", "\x1c", "\x85", "\xa0", "​", "　", "😀", "12", "!", "--", "<|endoftext|>", "<|", "the", "ing", "\t", "日本", "\x00", "Ⅷ", "²", "́"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def automaton():
    with open(PATH, "rb") as f:
        return bpe.automaton_of(f.read())


def texts(n):
    rng = random.Random(5)
    return ["".join(rng.choices(PIECES, k=rng.randint(0, 30))) for _ in range(n)] + ["a" * 3000, " " * 2000, "ab" * 1500, "-" * 999, ""]


def test_encoding_counts_and_decoding_are_the_librarys(library, automaton):
    encoder, table = bpe.Encoder(automaton), bpe.PrefixTable(automaton)
    for text in texts(3000):
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == ids
        assert table.measure(text, 5)[1] == len(ids)
        assert automaton.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_every_label_is_its_own_path(library, automaton):
    for label in automaton.label[::7]:
        try:
            text = label.decode()
        except UnicodeDecodeError:
            continue
        assert np.frombuffer(bpe.Encoder(automaton).encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_tables_may_start_anew(library, automaton, monkeypatch):
    monkeypatch.setattr(bpe, "TABLE", 3)
    encoder, table = bpe.Encoder(automaton), bpe.PrefixTable(automaton)
    for text in texts(200):
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert len(encoder.encode(text)) == 4 * n and table.measure(text, 10**9)[1] == n


def test_every_prefix_is_counted_as_a_text_of_its_own(library, automaton):
    table = bpe.PrefixTable(automaton)
    size = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    for text in [*texts(400)[:400], "Tokenization automata aren't small: thnthonhe éclair.", "\n\n'll!", "we've  \u00a0 \n x'r", "a  <|endoftext|>b!<|endoftext|", "!!<|endoftext|>'ve"]:
        counts, at = table.counts(text), 0
        want = []
        for i, c in enumerate(text):
            at += len(c.encode())
            want.append((at, size(text[: i + 1])))
            assert counts[at - 1] == want[-1][1], (text, i)
        for budget in (*range(0, 9), 15):
            assert table.measure(text, budget)[2] == max((n for n, c in want if c <= budget), default=0), (text, budget)


def test_operators_on_awkward_rows(spark, library):
    rows = [(1, None, "x"), (2, "", "x"), (3, "a b", "x"), (3, "a b", "x"), (None, "c", "x"), (4, "word " * 2000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = [(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in bpe.count_tokens(df, PATH).collect()]
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t, _ in rows]
    assert sorted(map(str, got)) == sorted(map(str, want))
    for r in bpe.round_trip(df, PATH).where("doc_id is not null").collect():
        text = next(t or "" for i, t, _ in rows if i == r.doc_id)
        ids = library.encode(text, add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    back = bpe.decode_documents(bpe.encode_documents(df.where("doc_id = 4"), PATH), PATH).first()
    assert back.text == "word " * 2000
    stored = bpe.prefix_counts(df.where("doc_id = 4"), PATH)
    assert stored.select(bpe.bytes_within(F.col("counts"), 10)).first()[0] == len("word " * 10) - 1
    assert bpe.count_tokens(df.where("false"), PATH).count() == 0


def test_budgets_of_the_stored_table_never_cut_characters(spark):
    texts = ["日本", "\U0001f600", "naïve café – dé", "", None, "a日b本c " * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    stored = bpe.prefix_counts(df, PATH)
    for budget in (0, 1, 2, 3, 5, 40):
        got = {r[0]: r[1] for r in stored.select("doc_id", bpe.bytes_within(F.col("counts"), budget)).collect()}
        expected = {r.doc_id: r.fit_bytes for r in bpe.count_tokens(df, PATH, budget=budget).collect()}
        assert got == expected
        for i, text in enumerate(texts):
            (text or "").encode()[: got[i]].decode()
