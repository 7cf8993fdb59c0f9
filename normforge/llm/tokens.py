"""Lengths of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vocabulary file of the tokenizer; every machine has it at this path.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the tokenizer of that vocabulary cuts text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.lru_cache(2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_lengths(df: DataFrame, key: str, text: str, keep: tuple[str, ...] = (), path: str = TOKENIZER) -> DataFrame:
    """(key, kept columns, n_tokens); null and empty texts have no tokens. Narrow, and texts never leave their partition."""
    source = df.select(F.col(key), *keep, F.col(text).cast("string").alias("token_text"))
    names = [n for n, _ in source.dtypes[:-1]]
    schema = ", ".join(f"`{n}` {t}" for n, t in source.dtypes[:-1]) + ", n_tokens long"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary
        for batch in batches:
            lengths = [len(encode(t)) if t else 0 for t in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lengths, pa.int64())], [*names, "n_tokens"])

    return source.mapInArrow(work, schema)
