"""Sinks of streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.sources.io import latest

BUCKETS = 64


def _index(spark: SparkSession, path: str, batch_id: int) -> dict[int, int]:
    """For each bucket the version that holds it, as of a batch."""
    if batch_id < 0:
        return {}
    try:
        return {r.bucket: r.version for r in spark.read.schema("bucket int, version long").parquet(f"{path}/index={batch_id}").collect()}
    except AnalysisException:
        raise ValueError(f"no version {batch_id} at {path}") from None


def _rows(spark: SparkSession, path: str, index: dict[int, int], schema) -> DataFrame:
    paths = [f"{path}/version={v}/bucket={b}" for b, v in sorted(index.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def upsert_sink(path: str, key: list[str], order: list[str], buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: keeps the latest row of each key, DELETEs as tombstones.

    Keys are dealt over buckets by hash. A batch reads and rewrites just the buckets that its keys fall in; a small index (a row for each
    bucket) says which version holds each bucket. A batch that runs again writes its version anew from the index before, so it can be
    repeated; its index is written last, so a batch that is lost midway leaves no trace.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rest = [c for c in batch.columns if c not in key]
        before = _index(spark, path, batch_id - 1)
        bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
        batch = batch.persist()
        touched = [r.bucket for r in batch.select(bucket.alias("bucket")).distinct().collect()]
        old = _rows(spark, path, {b: before[b] for b in touched if b in before}, batch.schema)
        merged = old.unionByName(batch).groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("x")).select(*key, "x.*")
        merged.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/version={batch_id}")
        after = before | dict.fromkeys(touched, batch_id)
        spark.createDataFrame(sorted(after.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{path}/index={batch_id}")
        batch.unpersist()

    return write


def read_latest(spark: SparkSession, path: str, batch_id: int, key: list[str], order: list[str], schema) -> DataFrame:
    """The rows as of a batch that aren't deleted."""
    return latest(_rows(spark, path, _index(spark, path, batch_id), schema), key, order)


def last_version(spark: SparkSession, path: str) -> int:
    """The last batch whose index is written; -1 if there is none."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath() for s in fs.listStatus(root)] if fs.exists(root) else []
    done = lambda p: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
    return max([int(p.getName()[6:]) for p in names if p.getName().startswith("index=") and done(p)], default=-1)


def change_feed(spark: SparkSession, path: str, since: int, until: int, key: list[str], order: list[str], schema) -> DataFrame:
    """What turns the table as of batch since (-1: empty) into that as of until: row_kind (+I, +U with the new row, -D with the old one) and the row.

    Only buckets that another version holds now are read, so the cost follows the change, not the table. Keys are compared with nulls equal.
    """
    old, new = _index(spark, path, since), _index(spark, path, until)
    changed = [b for b, v in new.items() if old.get(b) != v]
    before, after = (latest(_rows(spark, path, {b: index[b] for b in changed if b in index}, schema), key, order) for index in (old, new))
    rest = [c for c in after.columns if c not in key]
    side = lambda d, name: d.select(*key, F.struct(*rest).alias(name))
    both = side(before, "old").withColumn("new", F.lit(None).cast(side(after, "new").schema["new"].dataType)).unionByName(side(after, "new"), allowMissingColumns=True)
    both = both.groupBy(*key).agg(F.max("old").alias("old"), F.max("new").alias("new")).where("not old <=> new")
    kind = F.when(F.col("old").isNull(), "+I").when(F.col("new").isNull(), "-D").otherwise("+U")
    return both.select(kind.alias("row_kind"), *key, F.coalesce("new", "old").alias("x")).select("row_kind", *key, "x.*")


def lookup(path: str, key: list[str], order: list[str], schema, columns: list[str], write: Callable[[DataFrame, int], None], log: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch with these columns of the table at path, as of the last version when the batch first ran; write gets the result.

    The version is noted in the folder log before it is used, so a batch that runs again meets the rows that it met before, and a change of
    the table has a part only in batches after it. Rows without a match keep nulls.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        noted = f"{log}/batch={batch_id}"
        try:
            version = spark.read.schema("version long").parquet(noted).first()[0]
        except (AnalysisException, TypeError):
            version = last_version(spark, path)
            spark.createDataFrame([(version,)], "version long").coalesce(1).write.mode("overwrite").parquet(noted)
        table = read_latest(spark, path, version, key, order, schema).select(*key, *columns)
        write(batch.join(table, key, "left"), batch_id)

    return run


def vacuum(spark: SparkSession, path: str, batch_id: int) -> int:
    """Deletes buckets that no index from this batch on needs, and the indexes before it; returns how many went. Readers of earlier batches must be done."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    index, gone = _index(spark, path, batch_id), 0
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        kind, _, number = name.partition("=")
        if kind == "index" and int(number) < batch_id:
            fs.delete(status.getPath(), True)
        if kind == "version" and int(number) <= batch_id:
            for part in fs.listStatus(status.getPath()):
                b = part.getPath().getName()
                if b.startswith("bucket=") and index.get(int(b[7:])) != int(number):
                    fs.delete(part.getPath(), True)
                    gone += 1
    return gone
