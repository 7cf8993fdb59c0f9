import pytest

from normforge.llm import tokens as T

pytest.importorskip("tiktoken")


def test_lengths(spark):
    encode = T.encoding(T.TOKENIZER)
    texts = ["Hello, world", "größer   als 2,5 V\n\n", "", None, "<|endoftext|>", "a" * 5_000, "x y " * 5_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in T.with_lengths(df, "doc_id", "text").collect()}
    assert got == {i: len(encode.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}
    for t in texts:
        if t:
            assert encode.decode(encode.encode_ordinary(t)) == t
