"""Token ids of a text column.

Texts are encoded in Arrow batches by bpe.Encoder, which every Python worker keeps with its cache.  A batch is worked on
in parts of a few MB of text, so that memory doesn't grow with the size of texts or batches; a longer text is encoded in
windows and comes out whole.  No shuffle takes place.

Defined results: one row per input row, repeated rows included; null and empty texts have an empty list; other columns
are left out, so their names don't matter; an empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.shipping import ship
from .bpe import TOKENIZER_DIR, VOCABULARY, encoder

PART_BYTES = 4 << 20


def parts(batch: pa.RecordBatch, text: int, most: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batch with about `most` bytes of text each; a longer text is a slice of its own."""
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy().astype(np.int64)
    share = np.cumsum(lengths) // most
    heads = np.flatnonzero(np.diff(share, prepend=-1))
    for a, b in zip(heads, [*heads[1:], batch.num_rows]):
        yield batch.slice(int(a), int(b - a))


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(values, kind))


def encode(df: DataFrame, key: str, text: str, offsets: bool = False, directory: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids), and with offsets also `ends`: for each id the byte offset in the UTF-8 text at which its token ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(directory, vocabulary)
        for batch in batches:
            for part in parts(batch, 1):
                ids, counts = tool.encode_arrow(part.column(1))
                columns, names = [part.column(0), lists(ids, counts, pa.int32())], ["key", "ids"]
                if offsets:
                    ends = np.cumsum(tool.token_bytes[ids], dtype=np.int64)
                    before = np.append(0, np.cumsum(counts))[:-1]
                    ends -= np.repeat(np.append(0, ends)[before], counts)
                    columns.append(lists(ends, counts, pa.int64()))
                    names.append("ends")
                yield pa.RecordBatch.from_arrays(columns, names)

    ship(df.sparkSession)
    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField("key", kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    if offsets:
        schema = schema.add("ends", T.ArrayType(T.LongType()))
    return df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).mapInArrow(run, schema).withColumnRenamed("key", key)


def count_tokens(df: DataFrame, keys: Sequence[str], text: str, directory: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> DataFrame:
    """(keys..., n_tokens) of every row."""
    width = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(directory, vocabulary)
        for batch in batches:
            for part in parts(batch, width):
                _, counts = tool.encode_arrow(part.column(width))
                yield pa.RecordBatch.from_arrays([*part.columns[:width], pa.array(counts)], [f"k{i}" for i in range(width)] + ["n_tokens"])

    ship(df.sparkSession)
    schema = T.StructType([*(T.StructField(f"k{i}", df.schema[k].dataType) for i, k in enumerate(keys)), T.StructField("n_tokens", T.LongType())])
    counted = df.select(*(F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)), F.col(f"`{text}`").alias("text")).mapInArrow(run, schema)
    return counted.select(*(F.col(f"k{i}").alias(k) for i, k in enumerate(keys)), "n_tokens")


def decode(df: DataFrame, ids: str, text: str = "text", directory: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> DataFrame:
    """(text) of each row's list of ids; bytes that are no UTF-8 come out as U+FFFD, a null list as null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(directory, vocabulary)
        for batch in batches:
            texts = [None if x is None else tool.decode(x).decode("utf-8", "replace") for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])

    ship(df.sparkSession)
    return df.select(F.col(f"`{ids}`").alias("ids")).mapInArrow(run, "text string").withColumnRenamed("text", text)
