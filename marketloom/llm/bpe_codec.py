"""BPE encoding and decoding [8]: the unique last token of every prefix, then the back-pointers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm import bpe, common


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and ids, the whole text's token ids. Null and empty texts give an empty list, repeated rows repeated results."""
    spark = common.ship(docs.sparkSession)
    file = spark.sparkContext.broadcast(common.file_bytes(tokenizer_path))
    schema = pa.schema([("id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = bpe.loaded(file.value)
        for part in common.slices(batches):
            yield common.rows(schema, part.column(0), [list(chain.from_iterable(map(b.ids.__getitem__, b.parts_of(raw.decode())))) for raw in common.texts(part.column(1))])

    return docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, "id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer_path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """Per row: id and text. Null id lists give an empty text."""
    spark = common.ship(encoded.sparkSession)
    file = spark.sparkContext.broadcast(common.file_bytes(tokenizer_path))
    schema = pa.schema([("id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = bpe.loaded(file.value)
        for part in common.slices(batches):
            yield common.rows(schema, part.column(0), [b.decode(ids or []) for ids in part.column(1).to_pylist()])

    return encoded.select(encoded[id_col].cast("long").alias("id"), encoded[ids_col].cast("array<int>").alias("ids")).mapInArrow(run, "id long, text string")


def round_trip(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens and the SHA-256 of the ids and of the text decoded from them, in one pass.

    The same encoder and decoder as encode() and decode(), fused so that ids need not leave the worker.
    """
    spark = common.ship(docs.sparkSession)
    file = spark.sparkContext.broadcast(common.file_bytes(tokenizer_path))
    schema = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = bpe.loaded(file.value)
        digits = {i: b"%d" % i for i in b.bytes_of}
        for part in common.slices(batches):
            counts, ids_hash, text_hash = [], [], []
            for raw in common.texts(part.column(1)):
                ids = list(chain.from_iterable(map(b.ids.__getitem__, b.parts_of(raw.decode()))))
                counts.append(len(ids))
                ids_hash.append(hashlib.sha256(b",".join(map(digits.__getitem__, ids))).hexdigest())
                text_hash.append(hashlib.sha256(b.decode(ids).encode()).hexdigest())
            yield common.rows(schema, part.column(0), counts, ids_hash, text_hash)

    return docs.select(docs[id_col].cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
