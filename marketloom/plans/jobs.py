"""Whole jobs: a dict of DataFrames from the input tables. Nothing runs until one of them is written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.operators import accounting as acc
from marketloom.operators import routing


def trade_matching(fills_v1: DataFrame) -> dict[str, DataFrame]:
    matches = acc.fifo_long_only(fills_v1)
    return {"matches": matches, "realized": acc.realized_latest(matches, acc.KEY1)}


def price_ticks(fills_v1: DataFrame) -> DataFrame:
    return fills_v1.select("account_id", "symbol", F.col("fill_price").alias("price"), "ts", "seq")


def latest_prices(fills_v1: DataFrame) -> DataFrame:
    return price_ticks(fills_v1).groupBy("account_id", "symbol").agg(F.max_by("price", "seq").alias("price"), F.max("ts").alias("price_ts"))


def portfolio_and_risk(fills_v1: DataFrame, policies: DataFrame) -> dict[str, DataFrame]:
    """Average-cost positions, matches, profits, portfolios and alerts of fills with signed quantity."""
    positions = acc.avg_cost_latest(fills_v1)
    matches = acc.fifo_long_only(fills_v1)
    portfolios = acc.portfolio(positions, policies)
    return {
        "positions": positions,
        "closes": acc.close_events(fills_v1),
        "matches": matches,
        "realized": acc.realized_latest(matches, acc.KEY1),
        "unrealized": acc.unrealized(positions, latest_prices(fills_v1), acc.KEY1),
        "portfolio": portfolios,
        "alerts": acc.risk_alerts(portfolios),
    }


def trading_engine(fills: DataFrame) -> dict[str, DataFrame]:
    """Matches, lots, rollups, profits and their changes of fills with side."""
    unique = acc.dedupe_fills(fills)
    return engine_outputs(unique, acc.fifo_two_sided(unique))


def engine_outputs(unique: DataFrame, matches: DataFrame) -> dict[str, DataFrame]:
    """All outputs of deduped fills and their matches, which may be a table that is written already."""
    lots = acc.lots_latest(unique)
    return {
        "matches": matches,
        "lots": lots,
        "lots_changelog": acc.lots_changelog(unique, matches),
        "rollup": acc.rollup_latest(lots),
        "rollup_changelog": acc.rollup_changelog(unique),
        "realized": acc.realized_latest(matches, acc.KEY2),
        "realized_changelog": acc.realized_cumulative(matches, acc.KEY2),
    }


def strategy_to_orders(signals: DataFrame, policies: DataFrame, positions: DataFrame | None = None) -> DataFrame:
    """Signals as unit orders of their run's account that pass the gate."""
    trades = routing.signal_to_trade(signals).withColumn("seq", F.xxhash64("symbol", "ts"))
    return routing.admission(trades, policies, positions)
