"""One query for each operator, over the given tables. Doubles that sums or divisions make are rounded, as in the SQL."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.operators import accounting as acc
from marketloom.operators import analytics as an
from marketloom.operators import indicators as ind
from marketloom.operators import joins, prefix, routing, trend, windows
from marketloom.operators import strategies as st
from marketloom.plans import jobs
from marketloom.session import ship
from marketloom.sources import adapters as ad
from marketloom.sources import catalog, io
from marketloom.streaming import sinks

DAY = 86_400_000
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = lambda s, d: f(ship(s), d)
    return f


def rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


def rows_with_indicators(s: SparkSession, d: str) -> DataFrame:
    return ind.with_rsi(ind.with_sma(ad.bars(s, d), 5, 14, 21)).withColumnRenamed("rsi14", "rsi")


def tall_sma(s: SparkSession, d: str) -> DataFrame:
    b = ind.with_sma(ad.bars(s, d), 5, 20, 40)
    t = ind.tall(b.withColumnsRenamed({"sma5": "sma_5", "sma20": "sma_20", "sma40": "sma_40"}), ["sma_5", "sma_20", "sma_40"])
    return rounded(t, "value", digits=8)


def scratch(s: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the application ends. Only a local session without such a folder has one of its own."""
    root = s.conf.get("spark.checkpoint.dir", None) or s.sparkContext.getCheckpointDir()
    if not root and not s.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    top = f"{(root or tempfile.mkdtemp(prefix='marketloom-')).rstrip('/')}/marketloom-{uuid.uuid4().hex}"
    atexit.register(_remove, s, top)
    return f"{top}/{name}"


def _remove(s: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        p = s._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(s._jsc.hadoopConfiguration()).delete(p, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once in the shared folder, where a plan would work it out again at each use."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unique_fills(s: SparkSession, d: str) -> DataFrame:
    return stored(acc.dedupe_fills(ad.fills(s, d)), "fills")


def whole_fills(s: SparkSession, d: str) -> DataFrame:
    """Deduped fills whose seq is their place in all of their key's history, without gaps between days."""
    run = F.floor(F.col("ts") / (ad.RUN_DAYS * DAY))
    return acc.dedupe_fills(prefix.numbered(ad.fills(s, d), acc.KEY2, run, ["seq"]))


def matches(s: SparkSession, d: str) -> DataFrame:
    return acc.fifo_two_sided(unique_fills(s, d))


def engine(s: SparkSession, d: str) -> dict[str, DataFrame]:
    """The trading engine's outputs, of fills that are deduped once."""
    unique = unique_fills(s, d)
    return jobs.engine_outputs(unique, acc.fifo_two_sided(unique))


def signal_stream(s: SparkSession, d: str) -> DataFrame:
    """Signals of the simple rule, to be routed: one for each bar and symbol."""
    return st.simple_cross(rows_with_indicators(s, d))


def orders(s: SparkSession, d: str) -> DataFrame:
    """Fills as order requests: account_id, symbol, qty (signed), price, ts, seq within the account."""
    f = ad.fills_v1(s, d).select("account_id", "symbol", F.col("fill_qty").alias("qty"), F.col("fill_price").alias("price"), "ts", "seq")
    return prefix.numbered(f, ["account_id"], F.floor(F.col("ts") / DAY), ["ts", "symbol", "seq"])


# ---- sources, sinks, formats


@query
def src_table_log(s, d):
    return ad.ticks(s, d).select("symbol", "ts", "seq", "price")


@query
def src_json_nested(s, d):
    path = scratch(s, "candles")
    io.candles_to_json(ad.bars(s, d), path)
    return io.candles_from_json(s, path)


@query
def src_values(s, d):
    return io.seed_candles(s)


@query
def src_generator(s, d):
    return rounded(io.generated_candles(s, ["AAA", "BBB", "CCC"], 1_000), "open", "high", "low", "close", digits=6)


@query
def src_flexible_deser(s, d):
    flex = io.flexible(rows_with_indicators(s, d).withColumn("missing", F.when(F.col("rsi") > 50, F.col("rsi"))), ["close", "sma5", "missing"], "volume")
    return rounded(flex.select("symbol", "ts", F.size("fields").alias("n_fields"), F.col("fields")["close"].alias("close"), F.col("fields")["missing"].alias("missing"), "volume"), "missing", digits=6)


@query
def src_row_accessor(s, d):
    flex = io.flexible(rows_with_indicators(s, d), ["sma5", "sma14", "sma21"])
    return rounded(flex.select("symbol", "ts", io.indicator("sma", 5).alias("sma5"), io.indicator("sma", 21).alias("sma21"), io.indicator("ema", 9, default=0.0).alias("ema9")), "sma5", "sma21", digits=6)


@query
def src_typed_deser(s, d):
    text = ad.fills(s, d).select("account_id", "symbol", "order_id", F.col("qty").cast("string").alias("qty"), F.concat(F.lit("p"), F.col("price").cast("string")).alias("bad_price"), F.col("ts").cast("string").alias("ts"))
    return io.typed(text, {"account_id": "string", "symbol": "string", "order_id": "long", "qty": "double", "bad_price": "double", "ts": "long"})


@query
def src_projection(s, d):
    return io.read_table(s, f"{d}/events.parquet", ["event_type", "value"]).groupBy("event_type").agg(F.max("value").alias("top"))


@query
def snk_append(s, d):
    path = scratch(s, "history")
    f = ad.fills(s, d).select("account_id", "symbol", "side", "qty")
    io.append(f.where("side = 'BUY'"), path)
    io.append(f.where("side = 'SELL'"), path)
    return s.read.parquet(path).groupBy("account_id", "symbol", "side").agg(F.count("*").alias("n"), F.sum("qty").alias("qty"))


@query
def snk_upsert(s, d):
    changes = acc.rollup_changelog(unique_fills(s, d))
    path = io.upsert(s, scratch(s, "rollup"), changes.where("seq % 2 = 0"), acc.KEY2, ["seq"])
    path = io.upsert(s, path, changes.where("seq % 2 = 1"), acc.KEY2, ["seq"])
    return s.read.parquet(path).select(*acc.KEY2, "net_qty", "seq")


@query
def src_changes(s, d):
    """The change feed of a table with a primary key: what the second of two upserts changed."""
    changes = acc.rollup_changelog(unique_fills(s, d)).select("op", *acc.KEY2, "net_qty", "seq")
    path = scratch(s, "positions")
    write = sinks.upsert_sink(path, acc.KEY2, ["seq"], 8)
    write(changes.where("seq div 1000000000 % 2 = 1"), 0)
    write(changes.where("seq div 1000000000 % 2 = 0 and symbol != 'P3'"), 1)
    return sinks.change_feed(s, path, 0, 1, acc.KEY2, ["seq"], changes.schema)


@query
def snk_row_mappers(s, d):
    f = ad.fills_v1(s, d)
    return rounded(f.select("account_id", "order_id", "symbol", "fill_qty", F.col("fill_price").cast("decimal(18,4)").alias("fill_price"), "status", F.timestamp_millis("ts").cast("date").alias("ts_day")), digits=2)


@query
def snk_signal_row(s, d):
    return io.signal_rows(rounded(st.simple_cross(rows_with_indicators(s, d)), "sma5", "sma21", "signal_strength", digits=8))


@query
def snk_changelog_bridge(s, d):
    return io.changelog_rows(acc.rollup_changelog(stored(whole_fills(s, d), "fills")).drop("ts"), [*acc.KEY2, "seq"])


@query
def snk_match_bridge(s, d):
    return rounded(io.match_rows(matches(s, d)).drop("match_id"), "realized_pnl", "matched_qty")


@query
def snk_pojo_adapter(s, d):
    path = scratch(s, "rollup")
    catalog.append(engine(s, d)["rollup"], "open_positions_rollup", path)
    return rounded(s.read.parquet(path), "avg_price", digits=3)


@query
def snk_noop(s, d):
    t = ad.ticks(s, d)
    io.discard(t)
    return t.groupBy("symbol").agg(F.count("*").alias("n"))


def new_catalog(s: SparkSession) -> catalog.Catalog:
    path = scratch(s, "database")
    return catalog.Catalog(s, path.split("/")[-2].replace("-", "_"), path)


@query
def cat_ddl(s, d):
    """Creates all tables, fills three, drops two and describes what is left, with the rows of each."""
    c = new_catalog(s)
    c.create()
    c.write("market_data_history", ad.bars(s, d).withColumn("time", F.timestamp_millis("ts")))
    fills = unique_fills(s, d)
    c.write("exec_report_history", fills.select(*acc.KEY2, "order_id", "fill_id", "side", F.col("qty").alias("fill_qty"), F.col("price").alias("fill_price"), F.timestamp_millis("ts").alias("ts")))
    changes = stored(acc.rollup_changelog(fills).withColumn("last_updated", F.col("ts")), "changes")
    for odd in (0, 1):
        c.write("open_positions_rollup", changes.where(F.col("seq") % 2 == odd), ["seq"])
    c.drop("risk_state_latest", "trendsummary10")
    columns = reduce(DataFrame.unionByName, [c.describe(n) for n in c.tables()])
    tables = columns.groupBy("table_name").agg(F.count("*").alias("n_columns"), F.sum(F.when(F.col("key_place") > 0, 1).otherwise(0)).alias("n_key"))
    return tables.join(c.counts(), "table_name")


@query
def dml_delete_all(s, d):
    """Rows before and after: all of one table deleted, of one by a condition, of one none."""
    c = new_catalog(s)
    names = ["strategy_signals", "trade_match_history", "market_data_history"]
    c.create(*names)
    c.write("strategy_signals", io.signal_rows(st.simple_cross(rows_with_indicators(s, d))))
    c.write("trade_match_history", io.match_rows(matches(s, d)))
    c.write("market_data_history", ad.bars(s, d).withColumn("time", F.timestamp_millis("ts")))
    before = {r.table_name: r.n_rows for r in c.counts(*names).collect()}
    c.delete("strategy_signals")
    c.delete("trade_match_history", "realized_pnl < 0")
    return c.counts(*names).withColumn("n_before", F.create_map(*[F.lit(x) for item in before.items() for x in item])[F.col("table_name")].cast("long"))


# ---- projections, filters, scalar expressions


@query
def prj_signal_to_trade(s, d):
    return routing.signal_to_trade(signal_stream(s, d))


@query
def prj_fill_sim(s, d):
    return routing.simulated_fills(routing.signal_to_trade(signal_stream(s, d))).drop("order_id")


@query
def prj_price_tick(s, d):
    return jobs.price_ticks(ad.fills_v1(s, d)).drop("seq")


@query
def prj_policy_from_signal(s, d):
    return signal_stream(s, d).select(F.col("run_id").alias("account_id"), F.lit(3).alias("max_open_symbols"), F.lit("ACTIVE").alias("status"), F.lit(100000.0).alias("initial_capital"), "ts")


@query
def prj_venue_order(s, d):
    return routing.venue_orders(routing.signal_to_trade(signal_stream(s, d)))


@query
def upd_order_status(s, d):
    o = routing.venue_orders(routing.signal_to_trade(signal_stream(s, d)))
    n = F.floor(F.col("ts") / ad.BAR_MS) % 4
    updates = o.select("order_id", F.when(n == 0, "FILLED").when(n == 1, "REJECTED").otherwise("PARTIAL").alias("status"), (F.col("ts") + 1).alias("ts")).where(F.floor((F.col("ts") - 1) / ad.BAR_MS) % 8 != 3)
    return routing.pending_orders(o, updates)


@query
def flt_positive_close(s, d):
    return ad.bars(s, d).where("close > 0").select("symbol", "ts", "close")


@query
def flt_non_null(s, d):
    side = F.when(F.col("sma5") > F.col("sma21"), "BUY")
    return rows_with_indicators(s, d).select("symbol", "ts", side.alias("signal")).where("signal is not null")


@query
def flt_buy_signals(s, d):
    p = ind.pivoted(tall_sma(s, d), ["SMA_20", "SMA_40"])
    return p.where("sma_20 > sma_40 and sma_20 is not null and sma_40 is not null").select("run_id", "symbol", "ts", F.lit("BUY_SIGNAL").alias("signal_type"), F.lit(1).alias("signal_value"))


@query
def flt_rsi_overbought(s, d):
    return rounded(rows_with_indicators(s, d).where("rsi > 70").select("symbol", "ts", "rsi"), "rsi")


@query
def expr_case_trend(s, d):
    return ind.trend_direction(tall_sma(s, d).where("indicator_name = 'SMA_20'")).select("symbol", "ts", "value", "previous", "trend")


@query
def expr_case_zone(s, d):
    p = ind.pivoted(tall_sma(s, d), ["SMA_20", "SMA_40"])
    return p.select("symbol", "ts", F.when(F.col("sma_20") > F.col("sma_40"), "BUY_ZONE").when(F.col("sma_20") < F.col("sma_40"), "SELL_ZONE").otherwise("NEUTRAL").alias("zone"))


@query
def expr_validate_signal(s, d):
    accounts = ad.policies(s, d).select("account_id", "status", F.lit(50000.0).alias("max_notional"))
    return routing.validated(orders(s, d), accounts).groupBy("account_id", "decision").agg(F.count("*").alias("n"))


@query
def risk_alert(s, d):
    return acc.risk_alerts(pf_aggregate(s, d))


# ---- indicators


@query
def ind_sma(s, d):
    return rounded(ind.with_sma(ad.bars(s, d), 5, 14, 21).select("symbol", "ts", "sma5", "sma14", "sma21"), "sma5", "sma14", "sma21")


@query
def ind_sma_sql(s, d):
    b = ad.bars(s, d).where("close > 0").withColumn("value", F.round(ind.sma(20), 6).cast("decimal(18,6)"))
    return b.select("symbol", "ts", F.lit("SMA_20").alias("indicator_name"), "value")


@query
def ind_ema(s, d):
    return rounded(ind.with_ema(ad.bars(s, d), 5, 14, 21).select("symbol", "ts", "ema5", "ema14", "ema21"), "ema5", "ema14", "ema21")


@query
def ind_rsi(s, d):
    return rounded(ind.with_rsi(ad.bars(s, d)).select("symbol", "ts", "rsi14"), "rsi14")


@query
def ind_multi(s, d):
    names = ["sma5", "sma14", "sma21", "ema5", "ema14", "ema21", "rsi14"]
    return rounded(ind.multi(ad.bars(s, d)).select("symbol", "ts", *names), *names)


@query
def ind_latest(s, d):
    return ind.latest(tall_sma(s, d))


@query
def ind_timeseries(s, d):
    return tall_sma(s, d)


@query
def ind_trend_dir(s, d):
    return ind.trend_direction(tall_sma(s, d)).groupBy("symbol", "indicator_name", "trend").agg(F.count("*").alias("n"))


@query
def ind_pivot(s, d):
    return ind.pivoted(tall_sma(s, d), ["SMA_20", "SMA_40", "SMA_5"])


@query
def ind_swing(s, d):
    return ind.swings(ad.bars(s, d))


@query
def ind_hough(s, d):
    return rounded(trend.hough_lines(ad.bars(s, d), 24 * ad.BAR_MS, 6 * ad.BAR_MS), "price_range", "slope", "slope_norm", "intercept", "support", "score", "breakout_strength", digits=6)


@query
def ind_hough_votes(s, d):
    return trend.line_votes(ad.bars(s, d), 24 * ad.BAR_MS, 6 * ad.BAR_MS).groupBy("symbol", "window_start_ts").agg(F.sum("votes").alias("votes"))


@query
def ind_hough_swings(s, d):
    b = ad.bars(s, d)
    return rounded(trend.hough_lines(b, 24 * ad.BAR_MS, 6 * ad.BAR_MS, ind.swings(b)), "price_range", "slope", "slope_norm", "intercept", "support", "score", "breakout_strength", digits=6)


@query
def ind_line_events(s, d):
    return rounded(trend.line_events(ad.bars(s, d), 24 * ad.BAR_MS, 6 * ad.BAR_MS), "slope", "intercept", "distance", "price", "line_price", digits=6)


@query
def ind_line_dedup(s, d):
    return rounded(trend.hough_lines(ad.bars(s, d), 24 * ad.BAR_MS, 6 * ad.BAR_MS, top_k=12), "price_range", "slope", "slope_norm", "intercept", "support", "score", "breakout_strength", digits=6)


@query
def ind_trend_summary(s, d):
    lines = trend.hough_lines(ad.bars(s, d), 24 * ad.BAR_MS, 6 * ad.BAR_MS)
    return rounded(trend.trend_summary(lines, tau_ms=12.0 * ad.BAR_MS), "alpha", "confidence", "breakout_recency", "breakout_strength", digits=6)


@query
def ind_regime_features(s, d):
    return rounded(ind.regime_features(ad.bars(s, d), 4 * DAY), "rv", "trend")


@query
def ind_regime_class(s, d):
    f = rounded(ind.regime_features(ad.bars(s, d), DAY), "rv", "trend")
    return ind.regime_class(f, 1.2, 0.2, 0.35, 0.15)


@query
def ref_regime_prefs(s, d):
    return regime_prefs(s)


#: How much weight each strategy has in each regime.
REGIME_PREFS = [
    ("sma-xover:v1", "TREND", 1.0), ("meanrev:v2", "TREND", 0.2), ("sma-xover:v1", "MEANREV", 0.3), ("meanrev:v2", "MEANREV", 1.0), ("sma-xover:v1", "HIGHVOL", 0.8),
    ("meanrev:v2", "HIGHVOL", 0.4), ("sma-xover:v1", "LOWVOL", 0.6), ("meanrev:v2", "LOWVOL", 0.8), ("sma-xover:v1", "CHAOS", 0.0), ("meanrev:v2", "CHAOS", 0.0),
]


def regime_prefs(s: SparkSession) -> DataFrame:
    return s.createDataFrame(REGIME_PREFS, "strategy_id string, regime string, weight double")


@query
def regime_weights(s, d):
    return ind_regime_class(s, d).join(F.broadcast(regime_prefs(s)), "regime").select("symbol", "ts_end", "regime", "strategy_id", "weight")


# ---- strategies and patterns


def _signals(df: DataFrame) -> DataFrame:
    return rounded(df, "sma5", "sma21", "signal_strength")


@query
def strat_simple_cross(s, d):
    return _signals(st.simple_cross(rows_with_indicators(s, d)))


@query
def strat_rsi_threshold(s, d):
    return _signals(st.rsi_threshold(rows_with_indicators(s, d)))


@query
def strat_state_cross(s, d):
    return _signals(st.state_cross(rows_with_indicators(s, d)))


@query
def strat_state_gate(s, d):
    return _signals(st.state_gate(rows_with_indicators(s, d)))


@query
def strat_cross_sql(s, d):
    t = tall_sma(s, d)
    a = t.where("indicator_name = 'SMA_20'").select("run_id", "symbol", "ts", F.col("value").alias("sma_20"))
    b = t.where("indicator_name = 'SMA_40'").select("run_id", "symbol", "ts", F.col("value").alias("sma_40"))
    w = Window.partitionBy("symbol").orderBy("ts")
    p20, p40 = F.lag("sma_20").over(w), F.lag("sma_40").over(w)
    side = F.when((F.col("sma_20") > F.col("sma_40")) & (p20 <= p40), "BUY").when((F.col("sma_20") < F.col("sma_40")) & (p20 >= p40), "SELL").otherwise("HOLD")
    return a.join(b, ["run_id", "symbol", "ts"]).select("symbol", "ts", "sma_20", "sma_40", side.alias("crossover_signal"))


@query
def strat_iface(s, d):
    rows, out = rows_with_indicators(s, d), None
    for rule in st.RULES.values():
        own = rule(rows).groupBy("run_id", "signal").agg(F.count("*").alias("n"))
        out = own if out is None else out.unionByName(own)
    return out


@query
def strat_generic_job(s, d):
    r = rows_with_indicators(s, d)
    candles = ad.bars(s, d).select("symbol", (F.col("ts") + 300).alias("ts"), "close")
    return _signals(st.run_strategy(r.select("symbol", "ts", "sma5", "sma21", "rsi"), candles, st.state_cross))


@query
def cep_golden(s, d):
    return _signals(st.cep_golden(rows_with_indicators(s, d), DAY))


@query
def cep_cross2(s, d):
    return _signals(st.cep_cross(rows_with_indicators(s, d), DAY))


@query
def cep_cooldown(s, d):
    return _signals(st.cooldown(st.cep_cross(rows_with_indicators(s, d), DAY), 3 * DAY))


@query
def cep_rsi_sma_buy(s, d):
    return _signals(st.cep_rsi_sma_buy(rows_with_indicators(s, d).withColumn("rsi", F.col("rsi") - 20), 4 * DAY))


@query
def cep_rsi_sma_sell(s, d):
    return _signals(st.cep_rsi_sma_sell(rows_with_indicators(s, d).withColumn("rsi", F.col("rsi") + 20), 4 * DAY))


@query
def cep_seven_green(s, d):
    running = ad.bars(s, d).select("symbol", "ts", F.sum("volume").over(ind.by_time().rowsBetween(Window.unboundedPreceding, 0)).alias("close"), F.lit(0.0).alias("sma5"), F.lit(0.0).alias("sma21"))
    return _signals(st.seven_green(running, 60 * DAY))


@query
def cep_side_debug(s, d):
    return st.debug_lines(_signals(st.cep_cross(rows_with_indicators(s, d), DAY)))


# ---- joins


@query
def jn_interval(s, d):
    """Every tick with every tick of its symbol within ten minutes."""
    return jn_interval_whole(s, d)


@query
def jn_interval_whole(s, d):
    t = ad.ticks(s, d)
    return joins.interval_join(t.select("symbol", "ts", "seq"), t.select("symbol", "ts", F.col("seq").alias("right_seq"), "price"), 600_000)


@query
def jn_equi_self(s, d):
    t = tall_sma(s, d)
    a, b = t.where("indicator_name = 'SMA_5'"), t.where("indicator_name = 'SMA_20'").withColumnRenamed("value", "slow")
    return a.join(b.drop("indicator_name"), ["run_id", "symbol", "ts"]).select("symbol", "ts", "value", "slow")


@query
def jn_temporal(s, d):
    """Orders with their account's row as of their time: three versions of each account."""
    own = ad.policies(s, d).select("account_id", "status")
    versions = F.explode(F.array(*[F.struct(F.lit(v).alias("version"), F.lit(t * DAY).cast("long").alias("ts")) for v, t in enumerate((9500, 10200, 11000))]))
    status = F.when(F.col("x.version") == 1, F.concat(F.lit("SUSPENDED_"), "status")).otherwise(F.col("status"))
    accounts = own.select("account_id", "status", versions.alias("x")).select("account_id", "x.version", status.alias("status"), "x.ts", F.lit(0).cast("long").alias("seq"))
    found = joins.asof_join(orders(s, d).select("account_id", "symbol", "ts", "seq", "qty"), accounts, ["account_id"], ["version", "status"], chunk=30 * DAY)
    return found.groupBy("account_id", "symbol", "version", "status").agg(F.count("*").alias("n"), F.sum("qty").alias("qty"))


@query
def jn_asof_latest(s, d):
    """Each fill with its symbol's price as of the day before: the last of any account."""
    f = ad.fills_v1(s, d)
    prices = f.groupBy("symbol", "ts").agg(F.max_by("fill_price", F.struct("account_id", "seq")).alias("price")).select("symbol", (F.col("ts") + 1).alias("ts"), F.lit(0).cast("long").alias("seq"), "price")
    return joins.asof_join(f.select("account_id", "symbol", "ts", "seq"), prices, ["symbol"], ["price"], chunk=30 * DAY)


@query
def jn_asof_latest_whole(s, d):
    """A row for every position change and for every price; jn_asof_latest has rows for fills alone."""
    f = ad.fills_v1(s, d)
    found = acc.unrealized_updates(acc.avg_cost_updates(f), jobs.price_ticks(f))
    return rounded(found.withColumns({c: F.col(c) + 1e-7 for c in ("avg_price", "unrealized_pnl")}), "avg_price", "unrealized_pnl")


def daily_prices(fills: DataFrame) -> DataFrame:
    """Each symbol's last price of a day, at the day's time; of each key first, which needs no sort of fills."""
    each = fills.groupBy(*acc.KEY2, "ts").agg(F.max_by("price", "seq").alias("price"), F.max("seq").alias("seq"))
    return each.groupBy("symbol", "ts").agg(F.max_by("price", F.struct("account_id", "strategy_id", "seq")).alias("price")).withColumn("seq", F.lit(0).cast("long"))


@query
def jn_asof_symbol(s, d):
    """Every change of an unrealized profit: of each position as it changes, and of all a symbol's holders at each of its prices."""
    unique = unique_fills(s, d)
    changes = stored(acc.positions_changelog(unique), "changes")
    found = acc.unrealized_changelog(changes, stored(daily_prices(unique), "prices"), DAY, stored)
    return rounded(found.withColumn("avg_price", F.col("avg_price") + 1e-6), "avg_price", "unrealized_pnl", digits=2)


@query
def jn_connect_policy(s, d):
    changes = ad.policies(s, d).select("account_id", F.explode(F.array(*[F.struct(F.lit(t * 365 * DAY).cast("long").alias("ts"), F.lit(t).alias("version")) for t in (22, 24, 26)])).alias("x")).select("account_id", "x.*", F.lit(0).cast("long").alias("seq"))
    o = orders(s, d).select("account_id", "ts", "seq", "qty")
    return joins.asof_join(o, changes, ["account_id"], ["version"]).groupBy("account_id", "version").agg(F.count("*").alias("n"), F.sum("qty").alias("qty"))


@query
def jn_broadcast_control(s, d):
    """The router without adding to what an account holds: control records alone decide who gets a signal."""
    return routing.trade_picker(*routed(s, d), qty=2.0, scale_in=False)


@query
def jn_cogroup_window(s, d):
    b = ad.bars(s, d)
    schema = "symbol string, window_start_ts long, n_bars long, n_swings long, n_highs long, top_swing double"

    def of_window(key, bars, swings):
        high = swings["type"] == "HIGH"
        return pd.DataFrame([(key[0], key[1], len(bars), len(swings), int(high.sum()), swings["price"].max() if len(swings) else None)], columns=[c.split()[0] for c in schema.split(", ")])

    return windows.cogrouped(b, ind.swings(b), 24 * ad.BAR_MS, 6 * ad.BAR_MS, of_window, schema)


@query
def jn_unnest(s, d):
    b = ad.bars(s, d).select("symbol", "ts", F.explode(F.array("open", "high", "low", "close")).alias("price"))
    return b.groupBy("symbol").agg(F.count("*").alias("n"), F.max("price").alias("top"))


@query
def jn_union_tag(s, d):
    both = joins.tagged_union(policy=ad.policies(s, d), order=orders(s, d))
    return both.groupBy("account_id", "kind").agg(F.count("*").alias("n"), F.max("initial_capital").alias("capital"), F.sum("qty").alias("qty"))


# ---- routing, admission, accounting


def position_deltas(s: SparkSession, d: str) -> DataFrame:
    """Rollup changes with an order that is total within an account."""
    c = acc.rollup_changelog(unique_fills(s, d))
    c = prefix.numbered(c, ["account_id"], F.floor(F.col("ts") / DAY), ["ts", "strategy_id", "symbol", "seq"])
    return c.select("op", "account_id", "symbol", "net_qty", "ts", "seq")


@query
def rt_account_state(s, d):
    return routing.account_states(position_deltas(s, d))


def routed(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signals, some of which are equal; three policies of each of 50 accounts, from days 0, 11330 and 11340 on; position reports of 12 symbols."""
    found = st.simple_cross(rows_with_indicators(s, d)).select("run_id", F.concat(F.lit("P"), F.floor(F.col("ts") / ad.BAR_MS) % 12).alias("symbol"), (F.col("ts") - 23 * 365 * DAY).alias("ts"), "signal")
    number = F.col("s_suppkey") % 50
    versions = F.explode(F.array(*[F.struct(F.lit(v).alias("v"), F.lit(t * DAY).cast("long").alias("ts")) for v, t in enumerate((0, 11330, 11340))]))
    rules = s.read.parquet(f"{d}/supplier.parquet").select(number.alias("number"), versions.alias("x")).distinct()
    status = F.when((F.col("number") + F.col("x.v")) % 5 == 0, "BLOCKED").when(F.col("x.v") == 1, "Active").otherwise("ACTIVE")
    rules = rules.select(F.concat(F.lit("R"), "number").alias("account_id"), (4 + (F.col("number") + 3 * F.col("x.v")) % 8).cast("int").alias("max_open_symbols"), status.alias("status"), "x.ts")
    li = s.read.parquet(f"{d}/lineitem.parquet")
    gone = (F.col("l_orderkey") + F.col("l_partkey")) % 3 == 0
    reports = li.select(
        F.when(gone, "DELETE").otherwise("UPSERT").alias("op"), F.concat(F.lit("R"), F.col("l_suppkey") % 50).alias("account_id"), F.concat(F.lit("P"), F.col("l_partkey") % 12).alias("symbol"),
        F.when(~gone, F.col("l_quantity")).alias("net_qty"), ad.epoch_ms(F.col("l_shipdate")).alias("ts"), *ad.FILL_ORDER,
    )
    seq = F.row_number().over(Window.partitionBy("account_id").orderBy(*ad.FILL_ORDER)).cast("long")
    return found, rules, reports.withColumn("seq", seq).drop(*ad.FILL_ORDER)


@query
def rt_trade_picker(s, d):
    return routing.trade_picker(*routed(s, d))


@query
def adm_policy_gate(s, d):
    limits = ad.policies(s, d).withColumn("max_open_symbols", F.lit(2))
    return routing.admission(orders(s, d), limits).groupBy("account_id", "symbol").agg(F.count("*").alias("n"), F.sum("qty").alias("qty"))


@query
def adm_position_gate(s, d):
    limits = ad.policies(s, d).withColumn("max_open_symbols", F.lit(2))
    facts = acc.avg_cost_updates(ad.fills_v1(s, d)).select("account_id", "symbol", "net_qty", "ts", "seq")
    return routing.admission(orders(s, d), limits, facts).groupBy("account_id", "symbol").agg(F.count("*").alias("n"), F.sum("qty").alias("qty"))


@query
def rt_strategy_chooser(s, d):
    limits = signal_stream(s, d).select(F.col("run_id").alias("account_id")).distinct().select("account_id", F.lit(3).alias("max_open_symbols"), F.lit("ACTIVE").alias("status"), F.lit(0).cast("long").alias("ts"))
    trades = routing.signal_to_trade(signal_stream(s, d)).withColumn("seq", F.dense_rank().over(Window.partitionBy("account_id", "ts").orderBy("symbol")).cast("long"))
    return routing.admission(trades, limits).drop("seq")


@query
def pos_avg_cost(s, d):
    return rounded(acc.avg_cost_latest(ad.fills_v1(s, d)), "avg_price")


@query
def pos_avg_cost_updates(s, d):
    return rounded(acc.avg_cost_updates(ad.fills_v1(s, d)), "avg_price", digits=2).groupBy("account_id", "symbol").agg(F.count("*").alias("n"), F.sum(F.when(F.col("net_qty") == 0, 1).otherwise(0)).alias("flat"), F.max("net_qty").alias("most"))


@query
def pos_close_events(s, d):
    return acc.close_events(ad.fills_v1(s, d))


@query
def fifo_long_only(s, d):
    return rounded(acc.fifo_long_only(ad.fills_v1(s, d)).drop("match_seq"), "realized_pnl")


@query
def fifo_two_sided(s, d):
    m = matches(s, d)
    return rounded(m.select(*acc.KEY2, "buy_order_id", "buy_fill_id", "sell_order_id", "sell_fill_id", "buy_price", "sell_price", "matched_qty", "realized_pnl", "match_ts", "match_seq"), "realized_pnl")


@query
def realized_pnl_by_symbol(s, d):
    return rounded(acc.realized_latest(matches(s, d), ["account_id", "symbol"]).drop("ts"), "realized_pnl", digits=2)


@query
def fill_dedupe(s, d):
    return whole_fills(s, d).select(*acc.KEY2, "order_id", "fill_id", "side", "qty", "price", "seq")


@query
def lots_latest(s, d):
    return engine(s, d)["lots"].drop("lot_seq")


@query
def lots_changelog(s, d):
    return engine(s, d)["lots_changelog"]


@query
def rollup_latest(s, d):
    return rounded(engine(s, d)["rollup"], "avg_price", digits=3)


@query
def rollup_changelog(s, d):
    return acc.rollup_changelog(unique_fills(s, d))


@query
def rpnl_cumulative(s, d):
    c = acc.realized_cumulative(matches(s, d), acc.KEY2)
    return rounded(c.select(*acc.KEY2, "match_seq", "buy_seq", "sell_seq", "cumulative_pnl"), "cumulative_pnl", digits=2)


@query
def rpnl_updates(s, d):
    return rounded(acc.realized_updates(matches(s, d), acc.KEY2), "cumulative_pnl", digits=2)


@query
def upnl_v1(s, d):
    found = jobs.portfolio_and_risk(ad.fills_v1(s, d), ad.policies(s, d))["unrealized"]
    return rounded(found.select("account_id", "symbol", "current_price", (F.col("unrealized_pnl") + 1e-6).alias("unrealized_pnl"), "ts"), "unrealized_pnl", digits=2)


@query
def upnl_v2(s, d):
    unique = unique_fills(s, d)
    rollup = acc.rollup_latest(acc.lots_latest(unique))
    prices = unique.groupBy("symbol").agg(F.max_by("price", F.struct("ts", "account_id", "strategy_id", "seq")).alias("price"), F.max("ts").alias("price_ts"))
    return rounded(acc.unrealized(rollup, prices, ["symbol"]).groupBy("account_id", "strategy_id").agg(F.sum("unrealized_pnl").alias("unrealized_pnl")), "unrealized_pnl", digits=2)


@query
def pf_aggregate(s, d):
    return rounded(acc.portfolio(acc.avg_cost_latest(ad.fills_v1(s, d)), ad.policies(s, d)), "equity", "exposure", digits=2)


@query
def job_portfolio_risk(s, d):
    out = jobs.portfolio_and_risk(ad.fills_v1(s, d), ad.policies(s, d))
    return summaries(out, positions="net_qty", closes="seq", matches="matched_qty", realized="realized_pnl", portfolio="equity")


def summaries(out: dict[str, DataFrame], **measures: str) -> DataFrame:
    """Of each output by account: its rows and the sum of one of its columns."""
    each = [out[k].groupBy("account_id").agg(F.count("*").alias("n"), (F.round(F.sum(F.col(c).cast("double")), 1) + 0.0).alias("total")).withColumn("output", F.lit(k)) for k, c in measures.items()]
    return reduce(DataFrame.unionByName, each)


@query
def job_trade_matching(s, d):
    return rounded(jobs.trade_matching(ad.fills_v1(s, d))["realized"], "realized_pnl", digits=2)


@query
def job_trading_engine2(s, d):
    out = engine(s, d)
    return summaries(out, matches="matched_qty", lots="qty_rem", rollup="net_qty", rollup_changelog="net_qty", realized="realized_pnl")


# ---- aggregations, windows, sorting, sets


@query
def agg_account_pnl(s, d):
    return rounded(an.by_account(matches(s, d)), "total_realized_pnl", "avg_pnl_per_trade", "win_rate", "best_trade", "worst_trade", digits=2)


@query
def agg_recent_24h(s, d):
    return rounded(an.recent(matches(s, d), 10957 * DAY, 30), "recent_realized_pnl", "recent_win_rate", digits=2)


@query
def agg_symbol_pnl(s, d):
    return rounded(an.by_symbol(matches(s, d)), "symbol_pnl", "avg_pnl_per_trade", "pnl_volatility", digits=2)


@query
def agg_daily_pnl(s, d):
    return rounded(an.daily(matches(s, d)), "daily_pnl", "cumulative_pnl", digits=2)


@query
def agg_monthly(s, d):
    return rounded(an.monthly(matches(s, d)), "monthly_pnl", digits=2)


@query
def agg_heatmap(s, d):
    return rounded(an.heatmap(matches(s, d)), "avg_pnl", digits=2)


@query
def agg_signal_counts(s, d):
    return signal_stream(s, d).groupBy("signal").agg(F.count("*").alias("n"))


@query
def agg_conditional(s, d):
    return ad.bars(s, d).groupBy("symbol").agg(F.max(F.when(F.col("close") > F.col("open"), F.col("close"))).alias("top_up"), F.max(F.when(F.col("close") <= F.col("open"), F.col("close"))).alias("top_down"))


@query
def win_rows(s, d):
    return rounded(ad.bars(s, d).select("symbol", "ts", ind.sma(20).alias("mean20")), "mean20")


@query
def win_lag(s, d):
    return ad.bars(s, d).select("symbol", "ts", F.lag("close").over(ind.by_time()).alias("previous_close"))


@query
def win_cum(s, d):
    return ad.bars(s, d).select("symbol", "ts", F.sum("volume").over(ind.by_time().rowsBetween(Window.unboundedPreceding, 0)).alias("volume_so_far"))


@query
def tw_tumbling(s, d):
    t = s.read.parquet(f"{d}/events.parquet")
    w = t.groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").alias("w"), F.col("event_type").alias("symbol")).agg(F.count("*").alias("n"), F.max("value").alias("top"))
    return w.select("symbol", F.unix_millis("w.start").alias("start_ms"), "n", "top")


@query
def tw_sliding(s, d):
    return windows.sliding(ad.ticks(s, d), DAY, DAY // 4).groupBy("symbol", "window_start_ts").agg(F.count("*").alias("n"), F.max("price").alias("top"))


@query
def sort_top_n(s, d):
    return rounded(an.last_trades(matches(s, d)).select("account_id", "symbol", "matched_qty", "realized_pnl", "match_ts"), "realized_pnl", digits=2)


@query
def sort_view(s, d):
    return ind.latest(tall_sma(s, d)).orderBy("symbol", "indicator_name")


@query
def topk_nms(s, d):
    return rounded(trend.hough_lines(ad.bars(s, d), 24 * ad.BAR_MS, 6 * ad.BAR_MS, top_k=2), "price_range", "slope", "slope_norm", "intercept", "support", "score", "breakout_strength", digits=6)


@query
def set_union_all(s, d):
    c = lambda t: s.read.parquet(f"{d}/{t}.parquet").agg(F.lit(t).alias("table_name"), F.count("*").alias("n")).select("table_name", "n")
    return c("events").unionByName(c("lineitem")).unionByName(c("supplier"))
