import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from almagest.llm import bpe


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.Vocabulary(bpe.read_ranks(bpe.default_vocabulary()[0]), bpe.default_vocabulary()[1]))


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def ids(e, texts):
    flat, at = e.encode(texts)
    return [flat[a:b].tolist() for a, b in zip(at, at[1:])]


def test_perfect_hash_is_minimal():
    keys = np.random.default_rng(1).integers(0, 2**63, 20000, dtype=np.uint64)
    h = bpe.PerfectHash(keys)
    assert sorted(h.slots(keys)) == list(range(len(keys)))
    with pytest.raises(ValueError):
        bpe.PerfectHash(np.array([5, 5], dtype=np.uint64))


def test_all_documents_equal_the_tokenizer(encoder, reference):
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist()
    want = [x.ids for x in reference.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert ids(encoder, texts) == want
    assert encoder.count(texts).tolist() == [len(w) for w in want]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=60), st.text(alphabet=" \t\n\r\x85\xa0　a'sé8.-\x1c", max_size=30)), max_size=4))
def test_any_text_equals_the_tokenizer(encoder, reference, texts):
    assert ids(encoder, texts) == [reference.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_special_strings_long_words_and_memo(encoder, reference, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 3)
    for t in ("<|endoftext|> x", "aaaa" * 30000, "星" * 5000, "one two three four five six"):
        assert ids(encoder, [t]) == [reference.encode(t, add_special_tokens=False).ids]


def test_frames(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (2, None, None), (3, "", None), (None, "z", None)], "doc_id bigint, text string, ids string")
    out = sorted((r.doc_id or 0, r.ids) for r in bpe.encode(df).collect())
    assert [len(x[1]) for x in out] == [1, 2, 2, 0, 0]
    assert bpe.encode(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    assert sorted(r.n_tokens for r in bpe.count_tokens(df).collect()) == [0, 0, 1, 2, 2]
