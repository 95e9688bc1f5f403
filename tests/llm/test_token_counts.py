import json
import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marquee.llm import token_counts as tc

SPECIAL = "<|endoftext|>"


@pytest.fixture(scope="module")
def whole():
    t = Tokenizer.from_file(tc.tokenizer_file(tc.TOKENIZER))
    return lambda text: len(t.encode(text or "", add_special_tokens=False).ids)


def nasty(r, n):
    """Text of parts at which a scan may stumble when it is cut."""
    parts = ["a", "aaaaaaa", " ", "   ", "\n\n", "'", "'ll", "'s", "1", "2024", "é", "中文", "!", "<|", "|>", SPECIAL, SPECIAL[:7],
             SPECIAL[5:], " ", "　", "é", "🙂", "\t ", "_", "x" * 40, " " * 30]
    return "".join(r.choice(parts) for _ in range(n))


def test_splices_are_exact(whole):
    tok, margin = tc.load(tc.TOKENIZER)
    assert margin == len(SPECIAL) + 3
    r, closed = random.Random(1), 0
    for _ in range(1500):
        text = nasty(r, r.randrange(1, 60))
        start = r.randrange(len(text) + 1)
        cut = r.randrange(start, len(text) + 1)
        got = tc.splice(tok, margin, text[:cut], start, cut == len(text))
        if got is not None:
            closed += 1
            assert got == whole(text) - whole(text[start:])
    assert closed > 300


def rows_of(r):
    rows = [(i, nasty(r, r.randrange(0, 250))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "z" * 5000), (103, " " * 3000 + "end"), (104, "ab " * 2000), (105, SPECIAL * 200),
             (106, "z" * 700 + " b" * 300 + "9" * 900), (None, "no id " * 100), (None, "no id " * 100), (1, "again"), (1, "again")]
    return [(i, t, "u", 1) for i, t in rows]


@pytest.mark.parametrize("step,overlap", [(24, 20), (100, 40), (tc.STEP, tc.OVERLAP)])
def test_counts_are_those_of_whole_texts(spark, whole, step, overlap):
    rows = rows_of(random.Random(7))
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, n_tokens long").repartition(3)
    got = tc.token_counts(df, step=step, overlap=overlap)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens"]
    key = lambda x: (x[0] is None, x)
    want = sorted(((i, len((t or "").encode()), whole(t)) for i, t, *_ in rows), key=key)
    assert sorted((tuple(x) for x in got.collect()), key=key) == want


def test_very_long_text(spark, whole):
    r = random.Random(3)
    text = " ".join(nasty(r, 40) for _ in range(1500)) + "q" * 40_000 + " end"
    got = tc.token_counts(spark.createDataFrame([("x", text)], "doc_id string, text string")).first()
    assert (got.n_bytes, got.n_tokens) == (len(text.encode()), whole(text))


def test_other_tokenizers_and_empty_tables(spark, docs, rows, empty):
    assert tc.token_counts(empty).collect() == []
    other = "word_bpe_49k.json"      # a normaliser: boundaries prove nothing, texts are encoded whole
    with open(tc.tokenizer_file(other), encoding="utf-8") as f:
        assert tc.margin_of(json.load(f)) is None
    t = Tokenizer.from_file(tc.tokenizer_file(other))
    got = {x.doc_id: x.n_tokens for x in tc.token_counts(docs, tokenizer=other, step=50, overlap=30).collect()}
    assert got == {i: len(t.encode(x or "", add_special_tokens=False).ids) for i, x, *_ in rows}


def test_query(spark, whole):
    sf = "/root/testdata/sf0.001"
    got = {x.doc_id: (x.n_bytes, x.n_tokens, x.over_limit) for x in tc.op11_token_counts(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("text")).collect()
    assert got == {d.doc_id: (len((d.text or "").encode()), whole(d.text), whole(d.text) > 512) for d in docs}


def test_units_add_up_and_frequent_ones_are_encoded_once(whole, monkeypatch):
    tok, margin = tc.load(tc.TOKENIZER)
    assert tc.separable(tok, margin) and not tc.separable(tok, None)
    r = random.Random(5)
    texts = ["", " ", "word", " word word", "a  b", "a\x1c b", "a  b", "a᠎ b", f"x {SPECIAL} y{SPECIAL} z", *[nasty(r, r.randrange(60)) for _ in range(1500)]]
    for limit in (tc.UNITS, 20):
        monkeypatch.setattr(tc, "UNITS", limit)
        known, seen = {}, tc.Counter()
        got = [n for i in range(0, len(texts), 50) for n in tc._units(tok, texts[i:i + 50], known, seen)]
        assert got == [whole(t) for t in texts]
    monkeypatch.undo()
    sent, known, seen, plain = [], {}, tc.Counter(), tc._whole
    monkeypatch.setattr(tc, "_whole", lambda t, xs: sent.extend(xs) or plain(t, xs))
    for _ in range(10):
        tc._units(tok, ["the same words again and again"] * 3, known, seen)
    assert sum(map(len, sent)) < 200
