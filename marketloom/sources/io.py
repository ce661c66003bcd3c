"""Tables, files and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None, streaming: bool = False, schema=None, files_per_trigger: int = 1) -> DataFrame:
    """A Parquet table, in batch or as a stream; only the named columns are read."""
    if streaming:
        d = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    else:
        d = spark.read.parquet(path)
    return d.select(*columns) if columns else d


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def latest(changes: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """What an upsert table holds after all changes: the last row of each key, keys whose last op is DELETE left out."""
    rest = [c for c in changes.columns if c not in key]
    d = changes.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("x")).select(*key, "x.*")
    return d.where("op <> 'DELETE'") if "op" in changes.columns else d


def upsert(spark: SparkSession, path: str, changes: DataFrame, key: list[str], order: list[str]) -> str:
    """Merges changes into the table version at path and writes the next version beside it; returns the new path."""
    import uuid

    base, _, _ = path.partition("@")
    known = spark.read.parquet(path) if "@" in path else None
    merged = latest(changes if known is None else known.unionByName(changes, allowMissingColumns=True), key, order)
    after = f"{base}@{uuid.uuid4().hex}"
    merged.write.parquet(after)
    return after


def discard(df: DataFrame) -> None:
    """Runs a plan and keeps nothing."""
    df.write.format("noop").mode("overwrite").save()


def candles_from_json(spark: SparkSession, path: str, symbol: Column | None = None) -> DataFrame:
    """Candles of JSON lines {"symbol": ..., "data": [[ms, open, high, low, close, volume], ...]}."""
    raw = spark.read.schema("symbol string, data array<array<double>>").json(path)
    d = raw.select((symbol if symbol is not None else F.col("symbol")).alias("symbol"), F.explode("data").alias("row"))
    at = lambda k: F.element_at("row", k)
    dec = lambda k: at(k).cast("decimal(10,4)")
    return d.select("symbol", F.timestamp_seconds(F.floor(at(1) / 1000)).alias("time"), dec(2).alias("open"), dec(3).alias("high"), dec(4).alias("low"), dec(5).alias("close"), at(6).cast("long").alias("volume"))


def candles_to_json(bars: DataFrame, path: str) -> None:
    """Candles as JSON lines, one for each symbol and day, which bounds a line."""
    row = F.array(F.col("ts").cast("double"), "open", "high", "low", "close", "volume")
    bars.groupBy("symbol", F.floor(F.col("ts") / 86_400_000)).agg(F.sort_array(F.collect_list(row)).alias("data")).select("symbol", "data").write.json(path)


def seed_candles(spark: SparkSession) -> DataFrame:
    """Six literal candles."""
    return spark.sql("""
        SELECT symbol, CAST(ts AS BIGINT) AS ts, CAST(open AS DOUBLE) AS open, CAST(high AS DOUBLE) AS high, CAST(low AS DOUBLE) AS low, CAST(close AS DOUBLE) AS close, CAST(volume AS DOUBLE) AS volume
        FROM VALUES ('BTC/USDT', 0, 100, 102, 99, 101, 10), ('BTC/USDT', 60000, 101, 103, 100, 102, 11), ('BTC/USDT', 120000, 102, 104, 101, 103, 12),
                    ('BTC/USDT', 180000, 103, 105, 102, 104, 13), ('BTC/USDT', 240000, 104, 106, 103, 105, 14), ('BTC/USDT', 300000, 105, 107, 104, 106, 15) AS t(symbol, ts, open, high, low, close, volume)
    """)


def generated_candles(spark: SparkSession, symbols: list[str], n: int, seed: int = 1, start: float = 100.0) -> DataFrame:
    """Random-walk candles a minute apart: closes move by 2 % at most, wicks by 1 %. The same seed gives the same candles.

    The walk is a running sum of log steps, so it is a window over each symbol's rows.
    """
    from pyspark.sql import Window

    d = spark.range(n).withColumn("symbol", F.explode(F.array(*map(F.lit, symbols))))
    u = lambda k: F.pmod(F.xxhash64("symbol", "id", F.lit(seed), F.lit(k)), F.lit(1_000_003)) / 1_000_003.0
    w = Window.partitionBy("symbol").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("close", start * F.exp(F.sum(F.log(0.98 + 0.04 * u(0))).over(w)))
    d = d.withColumn("open", F.lag("close", 1, start).over(Window.partitionBy("symbol").orderBy("id")))
    return d.select("symbol", (F.col("id") * 60_000).alias("ts"), "open", (F.greatest("open", "close") * (1 + 0.01 * u(1))).alias("high"), (F.least("open", "close") * (1 - 0.01 * u(2))).alias("low"), "close", F.floor(1 + 1000 * u(3)).cast("double").alias("volume"))


def flexible(df: DataFrame, numeric: list[str], special: str | None = None) -> DataFrame:
    """symbol, ts and a map of the numeric columns that aren't null; the special column is kept apart."""
    fields = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, numeric)), F.array(*[F.col(c).cast("double") for c in numeric])), lambda k, v: v.isNotNull())
    return df.select("symbol", "ts", fields.alias("fields"), *([F.col(special).cast("long").alias(special)] if special else []))


def indicator(kind: str, period: int, fields: str = "fields", default: float | None = None) -> Column:
    """The map's value of an indicator such as sma5."""
    value = F.col(fields)[f"{kind}{period}"]
    return value if default is None else F.coalesce(value, F.lit(default))


def typed(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Named columns in the given types; what can't be read becomes null."""
    return df.select(*[F.col(c).try_cast(t).alias(c) for c, t in columns.items()])


def signal_rows(signals: DataFrame) -> DataFrame:
    """Signals as rows of the signal table: run_id is always 'live', numbers are rounded half up to their decimals."""
    dec = lambda c, p, s: F.round(F.col(c), s).try_cast(f"decimal({p},{s})").alias(c)
    return signals.select(F.lit("live").alias("run_id"), "symbol", F.timestamp_millis("ts").alias("time"), dec("close", 10, 4), dec("sma5", 18, 8), dec("sma21", 18, 8), "signal", dec("signal_strength", 5, 2))


def changelog_rows(changes: DataFrame, key: list[str]) -> DataFrame:
    """Changes as rows with a row kind; a DELETE carries its keys only."""
    kind = F.when(F.col("op") == "DELETE", "DELETE").otherwise("UPDATE_AFTER").alias("row_kind")
    return changes.select(kind, *key, *[F.when(F.col("op") != "DELETE", F.col(c)).alias(c) for c in changes.columns if c not in [*key, "op"]])


def match_rows(matches: DataFrame) -> DataFrame:
    """Matches as rows of the match table, in its column order."""
    match_id = F.sha2(F.concat_ws("|", "account_id", "strategy_id", "symbol", "buy_order_id", "buy_fill_id", "sell_order_id", "sell_fill_id", F.col("match_seq").cast("string")), 256)
    columns = ["account_id", "strategy_id", "symbol", "buy_order_id", "sell_order_id", "buy_ts", "sell_ts", "buy_price", "sell_price", "matched_qty", "realized_pnl", "match_ts"]
    return matches.select(F.substring(match_id, 1, 32).alias("match_id"), *columns)
