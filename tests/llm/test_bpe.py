"""The trie of words against the library, pair by pair, text by text and through the query."""

import hashlib
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lakesift.llm import bpe, queries

SF = "/root/testdata/sf0.001"
ODD = ["", " ", "  ", "a  b", "\n\nBar foo.\nBaz \n x", "x<|endoftext|> y <|endoftext|>", "a  <|endoftext|>  b", "it's THEY'll don't 've", "日本語 テキスト。 foo", " x y　z", "a\x85 b", "é  é×. à.", "٣ 12345 ½", "a" * 3000, "ab" * 500 + " " * 300, "=-=-" * 100, "\x00\x01\x7f x",
       "İSTANBUL ﬁ ǅ", "👩‍👩‍👧 x", "don’t", "a\tb\r\nc\n", "foo \n", "\nfoo", "Ã" * 64, "x\n\n\ny", "x \n y", "a .b , c", "ʯ.ɐ!"]


@lru_cache(maxsize=1)
def loaded():
    own = Tokenizer.from_file(bpe.default_path())
    own.no_truncation()
    own.no_padding()
    return own


@pytest.fixture(scope="module")
def library():
    return loaded()


def ids_of(library, texts):
    return [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_each_token_is_its_own_encoding():
    """The last token of a prefix is only then the right one if a token's own bytes give that token."""
    own = bpe.bpe(bpe.default_path())
    ordered = sorted(own.id_of)
    assert [ids for ids in own.walk(ordered)] == [[own.id_of[x]] for x in ordered]


def test_odd_texts(library):
    own = bpe.bpe(bpe.default_path())
    got = own.encode(pa.array([*ODD, None]))
    assert got.to_pylist() == ids_of(library, [*ODD, ""])
    assert bpe.decoder(bpe.default_path()).decode(got).to_pylist() == [*ODD, ""]


@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("ab .,\n'st<|>é×日  "), st.characters(codec="utf-8")), max_size=60), min_size=1, max_size=6))
@settings(max_examples=150, deadline=None)
def test_any_texts(texts):
    library, own = loaded(), bpe.bpe(bpe.default_path())
    got = own.encode(pa.array(texts))
    assert got.to_pylist() == ids_of(library, texts) and bpe.decoder(bpe.default_path()).decode(got).to_pylist() == texts


@given(st.lists(st.binary(max_size=12).map(bytes), min_size=1, max_size=8))
@settings(max_examples=60, deadline=None)
def test_sharing_changes_nothing(words):
    """Words encoded together or alone, with or without what the worker kept."""
    own = bpe.bpe(bpe.default_path())
    ordered = sorted({w for w in words if w})
    assert list(own.walk(ordered)) == [next(own.walk([w])) for w in ordered]


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN_STEPS", 5)
    monkeypatch.setattr(bpe, "KNOWN_WORDS", 3)
    own = bpe.ByteBpe(bpe.default_path())
    for _ in range(2):
        assert own.encode(pa.array(ODD)).to_pylist() == ids_of(library, ODD)


def test_decoding_of_any_ids(library):
    own = bpe.Decoder(bpe.default_path())
    lists = [[50256, 262], [447, 247], [447], [99, 447, 262], [], None, [262, None, -1, 60000]]
    expected = [library.decode([i for i in x or [] if i is not None and 0 <= i < 50257], skip_special_tokens=False) for x in lists]
    assert own.decode(pa.array(lists, pa.list_(pa.int32()))).to_pylist() == expected


def test_query_is_the_library(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    rows = {r["doc_id"]: r for r in queries.op13_bpe_encoding(spark, SF).collect()}
    assert rows.keys() == texts.keys()
    for key, ids in zip(texts, ids_of(library, list(texts.values())), strict=True):
        assert (rows[key]["n_tokens"], rows[key]["ids_sha256"], rows[key]["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_edges_of_tables(spark, library):
    rows = [(1, None, "x"), (1, "", "y"), (2, "word " * 25_000, "z"), (2, "word " * 25_000, "z"), (None, "a<|endoftext|>b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __work string").withColumnRenamed("doc_id", "ids")
    got = bpe.decode(bpe.encode(docs, into="Tokens"), ids="Tokens").collect()
    assert sorted((r["ids"] or 0, len(r["Tokens"]), r["decoded"], r["__work"] or "") for r in got) == sorted((a or 0, len(ids), b or "", c or "") for (a, b, c), ids in zip(rows, ids_of(library, [x[1] or "" for x in rows]), strict=True))
    empty = bpe.decode(bpe.encode(docs.where("false"), into="Tokens"), ids="Tokens")
    assert empty.count() == 0 and empty.columns == ["ids", "text", "__work", "Tokens", "decoded"]
    assert bpe.encode(docs.withColumn("text", docs.text), into="ids").columns == ["text", "__work", "ids"]


def test_other_kinds_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        bpe.ByteBpe(public_tokenizers.path("word_bpe_49k.json"))
