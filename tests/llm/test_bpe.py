"""The automaton against the library that owns the vocabulary file."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T
from tokenizers import Tokenizer

from skyreel.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
LIBRARY.no_truncation()
LIBRARY.no_padding()
CODEC = bpe.Codec(open(PATH, encoding="utf-8").read())
ODD = [
    "", " ", "aaaaaaaaaaaaaaaaaaaaaaa", "hahahahahaha mississippi", "Don't we'll I'd THEY'RE '' 's", "ΟΔΟΣ Σ", "İstanbul", "été ñ",
    "<|endoftext|>", "a<|endoftext|><|startoftext|>b <|EndOfText|> <|endoftext", "\x1c\x1d a\x1eb \x85 \xa0x y", "12 345١½Ⅷ", "中文 \U0001f600\U0001f600 ภา", "$$$### a_b--c...!!!", "ßẞ ﬁ", "\n\n\r\n", "x" * 300,
]


def ids(text):
    return np.frombuffer(CODEC.encode(text), "<u4").tolist()


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    assert ids(text) == LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aabcdehilnorst' THE.,1<|>"), st.characters(codec="utf-8", max_codepoint=0x2FFF)), max_size=60))
def test_any_text(text):
    assert ids(text) == LIBRARY.encode(text, add_special_tokens=False).ids
    assert CODEC.decode(CODEC.encode(text)) == LIBRARY.decode(ids(text), skip_special_tokens=False)


def test_documents(spark):
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").toPandas()
    found = bpe.digests(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), PATH).toPandas().set_index("doc_id")
    assert len(found) == len(texts)
    for row in texts.itertuples():
        want = LIBRARY.encode(row.text, add_special_tokens=False).ids
        got = found.loc[row.doc_id]
        assert got.n_tokens == len(want)
        assert got.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert got.decoded_sha256 == hashlib.sha256(LIBRARY.decode(want, skip_special_tokens=False).encode()).hexdigest()


def test_nulls_extra_columns_and_empty_tables(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("token_ids", T.StringType())])
    rows = spark.createDataFrame([(1, None, "x"), (None, "Hello", None), (1, "", "y")], schema)
    got = sorted(map(tuple, bpe.decode(bpe.encode(rows, PATH), PATH).select("doc_id", "decoded").collect()), key=str)
    assert got == [(1, ""), (1, ""), (None, "hello</w>")]
    assert bpe.digests(rows.limit(0), PATH).count() == 0


def test_special_strings_as_ordinary_text():
    plain = bpe.Codec(open(PATH, encoding="utf-8").read(), special=False)
    assert 49407 not in np.frombuffer(plain.encode("a <|endoftext|> b"), "<u4")


def test_a_decoding_worker_needs_no_automaton():
    assert bpe._decoder(open(PATH, encoding="utf-8").read()) == CODEC.labels
