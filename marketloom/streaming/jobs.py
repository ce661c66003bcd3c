"""Whole jobs as streams: every side output of a micro-batch, written once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marketloom.operators import accounting as acc
from marketloom.plans import jobs
from marketloom.streaming.engine import engine

#: Of the trading engine's tagged changes: the kind, and the table that takes it.
OUTPUTS = {"match": "matches", "lot": "lots_changelog", "rollup": "rollup_changelog", "realized": "realized_changelog"}


def side_outputs(root: str, outputs: dict[str, str] = OUTPUTS) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the rows of each kind in a table of their own, in a folder for each batch.

    The batch is computed once and written once, parted by kind; a batch that runs again overwrites what it wrote, so nothing comes twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        table = F.create_map(*[F.lit(x) for item in outputs.items() for x in item])[F.col("kind")]
        batch.withColumn("table", table).where("table is not null").write.mode("overwrite").partitionBy("table").parquet(f"{root}/batch={batch_id}")

    return write


def read_output(spark: SparkSession, root: str, table: str, schema) -> DataFrame:
    """All rows of one output so far, with their batch."""
    rows = spark.read.option("basePath", root).schema(f"{schema}, batch long, table string").parquet(root)
    return rows.where(F.col("table") == table).drop("table")


def trading_engine(fills: DataFrame, root: str, checkpoint: str) -> StreamingQuery | None:
    """The trading engine over fills: a stream goes on from its checkpoint with what has come (availableNow), a table is taken whole.

    Either way the outputs are matches and changes of lots, rollups and realized profit under root. A table's outputs are those of jobs.trading_engine,
    of which matching, on which the others rest, is computed and written once, before them.
    """
    if fills.isStreaming:
        return engine(fills).writeStream.foreachBatch(side_outputs(root)).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()
    spark = fills.sparkSession
    unique = acc.dedupe_fills(fills)
    acc.fifo_two_sided(unique).write.mode("overwrite").parquet(f"{root}/matches")
    out = jobs.engine_outputs(unique, spark.read.parquet(f"{root}/matches"))
    for name in ("lots", "lots_changelog", "rollup", "rollup_changelog", "realized", "realized_changelog"):
        out[name].write.mode("overwrite").parquet(f"{root}/{name}")
    return None
