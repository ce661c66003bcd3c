"""Token counts [4]: a prefix dynamic programme stores the exact count at every prefix of every piece."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from marketloom.llm import bpe, common

SCHEMA = "id long, n_bytes long, n_tokens long, cut_chars long"


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", budget: int = 512) -> DataFrame:
    """Per row: id, n_bytes, n_tokens and cut_chars, the longest prefix (in characters) within the budget.

    Null and empty texts have 0 tokens. Null ids stay null; repeated rows give repeated results; other
    columns are not read. An empty table gives an empty result.
    """
    spark = common.ship(docs.sparkSession)
    file = spark.sparkContext.broadcast(common.file_bytes(tokenizer_path))
    schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("cut_chars", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = bpe.loaded(file.value)
        stored = b.prefixes.__getitem__
        for part in common.slices(batches):
            sizes, tokens, cuts = [], [], []
            for raw in common.texts(part.column(1)):
                text = raw.decode()
                pieces = b.parts_of(text)
                counts = list(map(stored, pieces))
                n = sum([c[-1] for c in counts])
                sizes.append(len(raw))
                tokens.append(int(n))
                cuts.append(len(text) if n <= budget else bpe.TokenPrefixes(b, text, pieces, counts).longest(budget))
            yield common.rows(schema, part.column(0), sizes, tokens, cuts)

    return docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(count, SCHEMA)
