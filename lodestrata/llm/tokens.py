"""Encoding whole tables with a public tokenizer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.bpe import encoder

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def encode_texts(texts: DataFrame, key: str, column: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``key`` and the token ids (array of int) of ``column``, without special tokens.

    ``vocabulary`` is the path of a rank file that every executor can read.  Null
    and empty texts have no ids: an empty list, never null.  Rows repeat as given,
    a null key stays null.  The strings of special tokens are ordinary text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        for b in batches:
            coded = [encode(t) for t in b.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, coded)]) // 4
            ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(coded), np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], [key, "ids"])

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(F.col(key), F.col(column).cast("string").alias("text")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count_tokens(texts: DataFrame, key: str, column: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``key`` and n_tokens (0 for null and empty texts); the ids stay in the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        for b in batches:
            sizes = [len(encode(t)) // 4 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64())], [key, "n_tokens"])

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(F.col(key), F.col(column).cast("string").alias("text")).mapInArrow(run, f"`{key}` {kind}, n_tokens long")


def decode_ids(coded: DataFrame, key: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``key`` and the text of ``ids``; null and empty lists give an empty text.

    Bytes that are no UTF-8 (a list cut inside a character) come out as U+FFFD.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = encoder(vocabulary).decode
        for b in batches:
            texts = [decode(np.array(ids or [], np.int64)).decode("utf-8", "replace") for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], [key, "text"])

    kind = coded.schema[key].dataType.simpleString()
    return coded.select(F.col(key), "ids").mapInArrow(run, f"`{key}` {kind}, text string")
