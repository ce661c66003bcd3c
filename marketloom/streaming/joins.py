"""Streams with watermarks: candles from ticks, interval joins, deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def never_idle(source: DataFrame, idle: str = "5 seconds", lateness: str = "0 seconds", time: str = "time") -> DataFrame:
    """A live source with a watermark on its time that goes on without it: it is never more than idle behind the clock.

    A query's watermark is that of its slowest source, so one that falls silent holds the windows of all others. Heartbeats of a second each,
    dated idle before now, move this source's watermark on; they are taken out again behind it, and no row is added or lost but
    those that come later than idle and lateness allow. For times near the clock's: a replay of old rows would be late.
    """
    beats = source.sparkSession.readStream.format("rate").option("rowsPerSecond", 1).load()
    at = F.col("timestamp") - F.expr(f"INTERVAL {idle}")
    beats = beats.select(*[(at if c == time else F.lit(None)).cast(source.schema[c].dataType).alias(c) for c in source.columns], at.alias("_beat"))
    # The condition names the time, so it stays behind the watermark.
    marked = source.withColumn("_beat", F.lit(None).cast("timestamp")).unionByName(beats).withWatermark(time, lateness)
    return marked.where(F.col("_beat").isNull() | (F.col("_beat") != F.col(time))).drop("_beat")


def candles(ticks: DataFrame, bar: str = "6 hours", lateness: str = "1 minute") -> DataFrame:
    """Candles of ticks (symbol, time, seq, price), each sent once its window has closed. Late ticks are dropped."""
    at = F.struct("time", "seq")
    d = ticks.withWatermark("time", lateness).groupBy(F.window("time", bar), "symbol")
    d = d.agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.count("*").cast("double").alias("volume"))
    return d.select("symbol", F.unix_millis("window.start").alias("ts"), "open", "high", "low", "close", "volume")


def interval_join(left: DataFrame, right: DataFrame, tolerance: str = "500 milliseconds", lateness: str = "1 minute") -> DataFrame:
    """Pairs of one symbol whose times differ by the tolerance at most. State is kept for no longer than the watermark needs."""
    a = left.withWatermark("time", lateness).alias("a")
    b = right.withWatermark("time", lateness).alias("b")
    near = F.expr(f"a.symbol = b.symbol AND b.time >= a.time - INTERVAL {tolerance} AND b.time <= a.time + INTERVAL {tolerance}")
    return a.join(b, near).select("a.*", F.col("b.time").alias("right_time"), *[F.col(f"b.{c}") for c in right.columns if c not in ("symbol", "time") and c not in left.columns])


def dedupe_fills(fills: DataFrame, within: str = "7 days") -> DataFrame:
    """Fills without those whose ids came before within the time; fills have a time column."""
    return fills.withWatermark("time", within).dropDuplicatesWithinWatermark(["account_id", "strategy_id", "symbol", "order_id", "fill_id"])
