import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from dropletry.llm import bpe, op01_bpe

PATH = public_tokenizers.path(op01_bpe.VOCABULARY)
ODD = ["", "  ", "a", "A<|endoftext|>B <|startoftext|>", "ΑΣ Σ İstanbul ǅ", "é́x", "a\x1cb\x85c d", "'s it's I'LL 'tis", "½²३", "日本語テキスト", "aaaaaaa" * 300, "</w> </W>", "\x00\x01", "🙂🙂👍🏽", "don't!!!###", "ab'RE", "x" * 5000]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def check(library, texts):
    c = bpe.codec(PATH)
    for text, ids in zip(texts, c.encode(texts)):
        wanted = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == wanted
        assert c.decode(ids) == library.decode(wanted, skip_special_tokens=False)


def test_odd_texts(library):
    check(library, ODD)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_any_text(library, texts):
    check(library, texts)


def test_long_words_merge_like_short_ones(library):
    rng = np.random.default_rng(3)
    check(library, ["".join(rng.choice(list("theandig"), n)) for n in (99, 100, 101, 102, 400)])


def test_null_repeated_and_extra_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "Hello the", "y"), (2, "Hello the", "y")], "doc_id long, text string, ids string")
    rows = bpe.with_ids(df, PATH).collect()
    assert [len(r["ids"]) for r in rows] == [0, 2, 2] and set(rows[0].asDict()) == {"doc_id", "text", "ids"}
    assert bpe.with_ids(df.limit(0), PATH).count() == 0
    assert [r[0] for r in df.select(bpe.decode(bpe.encode("text", PATH), PATH)).collect()] == ["", "hello</w> the</w>", "hello</w> the</w>"]


def test_query(spark, library):
    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = op01_bpe.query(spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_latin_words_like_the_matcher(library):
    r = np.random.default_rng(4)
    texts = ["".join(r.choice([*"'''stmdrevl.,! \n\t\x1c\x8509", "ß", "é", "ſ", "ŉ", "÷", "é", "'ll", "'re", "Σ", "İ", "x"], r.integers(0, 40))) for _ in range(3000)]
    check(library, texts)
    c = bpe.codec(PATH)
    raws = [raw for t in texts if (raw := c.latin(t)) is not None]
    words, per_text = bpe.latin_words(raws)
    wanted = [[w.encode() for w in c.words_plain(raw.decode())] for raw in raws]
    assert len(raws) > 500 and words == [w for ws in wanted for w in ws] and per_text.tolist() == [len(ws) for ws in wanted]


def test_only_new_words_are_encoded_and_few_at_a_time(library, monkeypatch):
    c, asked = bpe.Codec(PATH), []
    whole = c.encode_words
    monkeypatch.setattr(bpe, "NEW_WORDS", 3)
    monkeypatch.setattr(c, "encode_words", lambda words: (asked.append(list(words)), whole(words))[1])
    texts = ["One two, three", "", "Fouré two. 日本", "<|endoftext|> <|ENDOFTEXT|> one"]
    for _ in range(2):
        assert [ids.tolist() for ids in c.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    flat = [w for words in asked for w in words]
    assert len(flat) == len(set(flat)) and max(map(len, asked)) <= 3
