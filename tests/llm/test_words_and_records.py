"""Word hashing, and token records: exact round trips."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from quarryline.llm import token_records
from quarryline.llm.queries import tokenizer_path
from quarryline.llm.words import hash_words, shingles

ENCODER = token_records.Encoder(tokenizer_path())
TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from(list("abAB é \t\n\x1c 日.'1")), max_size=30)), max_size=8)
MARKED = st.lists(st.lists(st.sampled_from(["<|endoftext|>", "<|endof", "text|>", " ", "  ", "\n", "a", "b c", "é", "日"]), max_size=12).map("".join), max_size=6)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_are_those_of_the_definition(texts):
    w = hash_words(pa.array(texts, pa.string()))
    seen = {}
    for d, t in enumerate(texts):
        want = (t or "").encode().lower().split()
        got = w.of(d).tolist()
        assert len(got) == len(want)
        for a, b in zip(want, got, strict=True):
            assert seen.setdefault(a, b) == b
    assert len(set(seen.values())) == len(seen)


def test_chunks_do_not_cut_words():
    text = "x" * 700_000 + " " + "y" * 1_300_000 + " z"
    w = hash_words(pa.array(["a", text, "b z"]))
    assert np.diff(w.bounds).tolist() == [1, 3, 2] and w.of(1)[2] == w.of(2)[1]


def test_short_texts_are_one_shingle():
    w = hash_words(pa.array(["a b", "a b c d e f", "a b"]))
    assert len(shingles(w.of(0))) == 1 and len(shingles(w.of(1))) == 2 and shingles(w.of(0)) == shingles(w.of(2))


@settings(max_examples=80, deadline=None)
@given(st.one_of(TEXTS, MARKED))
def test_encoder_equals_the_library(texts):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    ids, at = ENCODER.encode(pa.array(texts, pa.string()))
    for d, t in enumerate(texts):
        assert ids[at[d] : at[d + 1]].tolist() == whole.encode(t or "", add_special_tokens=False).ids


def test_control_tokens():
    text = pa.array(["x <|endoftext|> y"])
    assert ENCODER.encode(text)[0].tolist() == [87, 220, 50256, 331]
    assert 50256 not in token_records.Encoder(tokenizer_path(), plain_specials=True).encode(text)[0].tolist()


def test_very_long_texts_are_encoded_whole():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    for text in ("ab" * 100_000, "some words, é 12 " * 60_000):
        assert ENCODER.encode(pa.array([text]))[0].tolist() == whole.encode(text, add_special_tokens=False).ids


def test_frames_notice_damage():
    data = token_records.frame(b"abc") + token_records.frame(b"")
    first, at = token_records.read_frame(data, 0)
    assert bytes(first) == b"abc" and bytes(token_records.read_frame(data, at)[0]) == b""
    with pytest.raises(ValueError):
        token_records.read_frame(data[:13] + b"X" + data[14:], 0)


def test_records_round_trip(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    rows = [(5, "five five"), (1, None), (3, ""), (5, "another five"), (None, "no id"), (2, "é " * 3000), (7, "x <|endoftext|> y"), (8, "long " * 900_000), (9, "after")]
    docs = spark.createDataFrame([(i, t, "clash", 9) for i, t in rows], "doc_id long, text string, start string, n_tokens int")
    got = token_records.read_records(spark, token_records.write_records(docs, tokenizer=tokenizer_path, partitions=3)).orderBy("start").collect()
    by_hash = lambda t: (xxhash.xxh64(t.encode(), seed=42).intdigest() + (1 << 63)) % (1 << 64) if t is not None else 42 + (1 << 63)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, by_hash(r[1])))
    at = 0
    for r, (i, t) in zip(got, order, strict=True):
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_no_documents_no_records(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_records.read_records(spark, token_records.write_records(docs, tokenizer=tokenizer_path())).count() == 0
