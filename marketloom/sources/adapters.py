"""The general tables as market data: events as ticks and bars, lineitem as fills, supplier as account policies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BAR_MS = 6 * 3600 * 1000
#: A total order of fills; the key columns alone are not unique.
FILL_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_ms(ts):
    return F.unix_millis(ts.cast("timestamp"))


def cents(price):
    """To two decimals, by the same double arithmetic in any engine."""
    return F.floor(price * 100 + 0.5) / 100


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ts (epoch ms), seq, price."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("symbol"), epoch_ms(F.col("ts")).alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("price"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


def bars(spark: SparkSession, sf_dir: str, bar_ms: int = BAR_MS) -> DataFrame:
    """Candles: symbol, ts (start of the bar, epoch ms), open, high, low, close, volume. One aggregation, combined before its shuffle."""
    t = ticks(spark, sf_dir).withColumn("bar", F.floor(F.col("ts") / bar_ms) * bar_ms)
    at = F.struct("us", "seq")
    return t.groupBy("symbol", F.col("bar").cast("long").alias("ts")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.count("*").cast("double").alias("volume")
    )


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Executions with side: account_id, strategy_id, symbol, order_id, fill_id, side, qty, price, ts and seq, their order within the key."""
    li = table(spark, sf_dir, "lineitem")
    keyed = li.select(F.concat(F.lit("A"), F.col("l_suppkey") % 5).alias("account_id"), F.concat(F.lit("S"), "l_linestatus").alias("strategy_id"), F.concat(F.lit("P"), F.col("l_partkey") % 4).alias("symbol"), *FILL_ORDER)
    return numbered(keyed, ["account_id", "strategy_id", "symbol"]).select(
        "account_id",
        "strategy_id",
        "symbol",
        F.col("l_orderkey").cast("string").alias("order_id"),
        F.col("l_linenumber").cast("string").alias("fill_id"),
        F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 2 == 0, "BUY").otherwise("SELL").alias("side"),
        F.col("l_quantity").alias("qty"),
        cents(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        epoch_ms(F.col("l_shipdate")).alias("ts"),
        "seq",
    )


def fills_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Executions with signed quantity: account_id, symbol, order_id, fill_qty, fill_price, status, ts and seq within (account, symbol)."""
    li = table(spark, sf_dir, "lineitem")
    qty = F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 2 == 0, F.col("l_quantity")).otherwise(-F.col("l_quantity"))
    keyed = li.select(F.concat(F.lit("A"), F.col("l_suppkey") % 5).alias("account_id"), F.concat(F.lit("P"), F.col("l_partkey") % 4).alias("symbol"), "l_returnflag", *FILL_ORDER)
    return numbered(keyed, ["account_id", "symbol"]).select(
        "account_id",
        "symbol",
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("order_id"),
        qty.alias("fill_qty"),
        cents(F.col("l_extendedprice") / F.col("l_quantity")).alias("fill_price"),
        F.when(F.col("l_returnflag") == "R", "REJECTED").otherwise("FILLED").alias("status"),
        epoch_ms(F.col("l_shipdate")).alias("ts"),
        "seq",
    )


#: Days of one run of numbers, and numbers that a run of one key has room for.
RUN_DAYS, RUN_NUMBERS = 16, 1_000_000_000


def numbered(rows: DataFrame, key: list[str]) -> DataFrame:
    """rows with seq, which grows within the key along FILL_ORDER: the run of days, then the number within it, so no task sorts a whole key."""
    run = F.floor(F.datediff(F.col(FILL_ORDER[0]), F.lit("1970-01-01")) / RUN_DAYS)
    within = F.row_number().over(Window.partitionBy(*key, "_run").orderBy(*FILL_ORDER))
    return rows.withColumn("_run", run).withColumn("seq", F.col("_run") * RUN_NUMBERS + within).drop("_run")


def policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """account_id, max_open_symbols, status, initial_capital, ts: one row an account."""
    s = table(spark, sf_dir, "supplier")
    own = s.groupBy(F.concat(F.lit("A"), F.col("s_suppkey") % 5).alias("account_id")).agg(F.max("s_acctbal").alias("initial_capital"))
    return own.select("account_id", F.lit(3).alias("max_open_symbols"), F.when(F.col("account_id") == "A4", "BLOCKED").otherwise("ACTIVE").alias("status"), "initial_capital", F.lit(0).cast("long").alias("ts"))
