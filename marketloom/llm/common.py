"""What the operators of this subpackage share: written intermediate tables, batching, tokenizer files."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from marketloom.session import ship  # noqa: F401

#: Text is handled in slices of about so many bytes, so a worker's memory follows this and the longest text.
SLICE_BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session without it gets a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not root:
        root = tempfile.mkdtemp(prefix="marketloom-shared-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir() or root
    return root


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/marketloom-{uuid.uuid4().hex}/{name}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a written table whose readers are done."""
    with contextlib.suppress(Exception):
        jvm = spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path).getParent()
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, name: str, compression: str = "snappy") -> tuple[DataFrame, str]:
    """Writes df as Parquet in the shared folder and reads it again: lineage ends here, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    atexit.register(remove, spark, path)
    return spark.read.schema(df.schema).parquet(path), path


def slices(batches: Iterator[pa.RecordBatch], text: int = 1, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each has about so many bytes of the text column at most, or one row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = max(1, batch.column(text).nbytes // n)
        step = max(1, limit // size)
        for i in range(0, n, step):
            yield batch.slice(i, step)


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def rows(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def file_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()
