"""Reports over matches: account_id, symbol, matched_qty, realized_pnl, match_ts (epoch ms)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PNL = "realized_pnl"


def when_of(ms: str = "match_ts") -> Column:
    return F.timestamp_millis(ms)


def win_rate() -> Column:
    return F.sum(F.when(F.col(PNL) > 0, 1).otherwise(0)) * 100.0 / F.count("*")


def by_account(m: DataFrame) -> DataFrame:
    return m.groupBy("account_id").agg(F.sum(PNL).alias("total_realized_pnl"), F.count("*").alias("total_trades"), F.avg(PNL).alias("avg_pnl_per_trade"), win_rate().alias("win_rate"), F.max(PNL).alias("best_trade"), F.min(PNL).alias("worst_trade"))


def recent(m: DataFrame, as_of_ms: int, days: int = 1) -> DataFrame:
    """By account over the last days before as_of."""
    d = m.where((F.col("match_ts") > as_of_ms - days * 86_400_000) & (F.col("match_ts") <= as_of_ms))
    return d.groupBy("account_id").agg(F.sum(PNL).alias("recent_realized_pnl"), F.count("*").alias("recent_trades"), win_rate().alias("recent_win_rate"))


def by_symbol(m: DataFrame) -> DataFrame:
    return m.groupBy("symbol").agg(F.sum(PNL).alias("symbol_pnl"), F.count("*").alias("trade_count"), F.avg(PNL).alias("avg_pnl_per_trade"), F.stddev_samp(PNL).alias("pnl_volatility")).orderBy(F.desc("symbol_pnl"))


def daily(m: DataFrame) -> DataFrame:
    """By day, with the running total. The total runs over one row a day."""
    d = m.groupBy(F.to_date(when_of()).alias("trade_date")).agg(F.sum(PNL).alias("daily_pnl"), F.count("*").alias("daily_trades"))
    return d.withColumn("cumulative_pnl", F.sum("daily_pnl").over(Window.orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)))


def monthly(m: DataFrame) -> DataFrame:
    return m.groupBy(F.year(when_of()).alias("year"), F.month(when_of()).alias("month")).agg(F.sum(PNL).alias("monthly_pnl"), F.count("*").alias("monthly_trades"), F.countDistinct("symbol").alias("symbols_traded"))


def heatmap(m: DataFrame) -> DataFrame:
    """By day of week (1 is Sunday) and hour."""
    return m.groupBy(F.dayofweek(when_of()).alias("day_of_week"), F.hour(when_of()).alias("hour_of_day")).agg(F.count("*").alias("trade_count"), F.avg(PNL).alias("avg_pnl"))


def last_trades(m: DataFrame, n: int = 10) -> DataFrame:
    """The newest matches of all: a top-n report."""
    return m.orderBy(F.desc("match_ts"), F.desc("match_seq"), "account_id", "symbol", F.desc("matched_qty"), "realized_pnl", "buy_order_id", "sell_order_id").limit(n)
