import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cellweft.llm import tokenize as K

RANKS = K.load_ranks(K.public_path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=K.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_round_trip_and_reference(text):
    import tiktoken

    ref = tiktoken.Encoding("own", pat_str=K.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    ids = K.Encoder(RANKS).encode(text)
    assert ids == ref.encode_ordinary(text) and K.decoded(ids, RANKS) == text


def test_both_merges_agree(reference):
    rng = random.Random(5)
    for n in (1, 2, 3, 17, 255, 256, 257, 3000):
        for letters in ("ab", "ACGT", "the and of in ", "éüß细胞"):
            b = "".join(rng.choice(letters) for _ in range(n)).encode()
            assert K.merge_long(b, RANKS) == K.merge_short(b, RANKS)


def test_whole_documents(spark, sf, reference):
    docs = spark.read.parquet(f"{sf('0.01')}/documents.parquet").select("doc_id", "text")
    want = {r["doc_id"]: reference.encode_ordinary(r["text"] or "") for r in docs.collect()}
    got = {r["doc_id"]: list(r["ids"]) for r in K.encoded(docs, "doc_id", "text").collect()}
    assert got == want


def test_null_empty_special_long_repeated(spark, reference):
    long = "x" * 20000 + " " + "ACGT" * 5000
    rows = [(1, None), (2, ""), (3, "<|endoftext|>"), (4, long), (4, long), (None, "a")]
    df = spark.createDataFrame(rows, "ids long, text string")  # the id column may bear any name but the result's
    out = K.encoded(df.withColumnRenamed("ids", "n"), "n", "text").collect()
    assert sorted((r["n"] or 0, list(r["ids"])) for r in out) == sorted((a or 0, reference.encode_ordinary(b or "")) for a, b in rows)
    assert K.encoded(df.where("ids = 99").withColumnRenamed("ids", "n"), "n", "text").collect() == []
