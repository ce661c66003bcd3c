"""Scenarios with known results, and set-based operators against plain sequential models."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from marketloom.operators import accounting as acc
from marketloom.operators import indicators as ind
from marketloom.operators import joins, routing, trend
from marketloom.operators import strategies as st
from marketloom.plans import jobs
from marketloom.sources import io
from marketloom.streaming.engine import apply_fill

FILL2 = "account_id string, strategy_id string, symbol string, order_id string, fill_id string, side string, qty double, price double, ts long, seq long"
FILL1 = "account_id string, symbol string, order_id string, fill_qty double, fill_price double, status string, ts long, seq long"
ROWS = "symbol string, ts long, close double, sma5 double, sma21 double, rsi double"


def fills2(spark, *fs, symbol="SYM"):
    return spark.createDataFrame([("A", "S", symbol, f"o{k}", "f1", side, float(q), float(p), k, k) for k, (side, q, p) in enumerate(fs, 1)], FILL2)


def fills1(spark, *fs):
    return spark.createDataFrame([("A", s, f"o{k}", float(q), float(p), status, k, k) for k, (s, q, p, status) in enumerate(fs, 1)], FILL1)


CYCLE = [("BUY", 5, 100), ("BUY", 3, 105), ("SELL", 6, 110), ("SELL", 5, 95), ("BUY", 3, 90)]


def test_two_sided_cycle(spark):
    out = jobs.trading_engine(fills2(spark, *CYCLE))
    got = sorted((r.match_seq, r.buy_order_id, r.sell_order_id, r.matched_qty, r.realized_pnl) for r in out["matches"].collect())
    assert got == [(3, "o1", "o3", 5.0, 50.0), (3, "o2", "o3", 1.0, 5.0), (4, "o2", "o4", 2.0, -20.0), (5, "o5", "o4", 3.0, 15.0)]
    assert out["lots"].count() == 0 and out["rollup"].count() == 0
    assert {r.lot_seq for r in out["lots_changelog"].where("op = 'DELETE'").collect()} == {1, 2, 4}
    assert [r.op for r in out["rollup_changelog"].orderBy("seq").collect()] == ["UPSERT"] * 4 + ["DELETE"]
    assert out["realized"].first().realized_pnl == 50.0


def test_partial_close_and_duplicates(spark):
    d = fills2(spark, *CYCLE[:3])
    out = jobs.trading_engine(d.unionByName(d.where("seq = 3").withColumn("seq", F.lit(9).cast("long"))))
    lot, roll = out["lots"].first(), out["rollup"].first()
    assert (lot.lot_id, lot.qty_rem, lot.avg_price, lot.side) == ("o2#f1", 2.0, 105.0, "LONG")
    assert (roll.net_qty, roll.avg_price, roll.side) == (2.0, 105.0, "LONG")
    assert out["realized"].first().realized_pnl == 55.0


def test_long_only(spark):
    d = fills1(spark, ("X", 1, 50000, "FILLED"), ("X", 0.5, 52000, "FILLED"), ("X", 2, 48000, "FILLED"), ("X", -2.25, 51000, "FILLED"), ("X", -9, 1, "REJECTED"))
    got = sorted((r.matched_qty, r.realized_pnl) for r in acc.fifo_long_only(d).collect())
    assert got == [(0.5, -500.0), (0.75, 2250.0), (1.0, 1000.0)]
    over = fills1(spark, ("X", -4, 10, "FILLED"), ("X", 2, 10, "FILLED"), ("X", -5, 12, "FILLED"), ("X", 1, 9, "FILLED"), ("X", -1, 10, "FILLED"))
    assert sorted((r.matched_qty, r.realized_pnl) for r in acc.fifo_long_only(over).collect()) == [(1.0, 1.0), (2.0, 4.0)]


def test_average_cost_and_closes(spark):
    d = fills1(spark, ("X", 1, 50000, "FILLED"), ("X", 0.5, 52000, "FILLED"), ("X", -0.25, 51000, "FILLED"), ("Y", 2, 10, "FILLED"), ("Y", -3, 12, "FILLED"), ("Z", 1, 5, "FILLED"), ("Z", -1, 6, "FILLED"), ("Z", 7, 6, "REJECTED"))
    got = {r.symbol: (r.net_qty, round(r.avg_price, 2)) for r in acc.avg_cost_latest(d).collect()}
    assert got == {"X": (1.25, 50666.67), "Y": (-1.0, 12.0)}
    assert [(r.symbol, r.close_ts) for r in acc.close_events(d).collect()] == [("Z", 7)]
    assert sorted((r.symbol, r.seq, r.net_qty) for r in acc.avg_cost_updates(d).collect())[-1] == ("Z", 7, 0.0)


def test_portfolio_and_alerts(spark):
    d = fills1(spark, ("BTC", 1, 50000, "FILLED"), ("ETH", 10, 3000, "FILLED"))
    pol = spark.createDataFrame([("A", 3, "ACTIVE", 100000.0, 1), ("A", 3, "ACTIVE", 50000.0, 2)], "account_id string, max_open_symbols int, status string, initial_capital double, ts long")
    p = jobs.portfolio_and_risk(d, pol)["portfolio"].first()
    assert (p.exposure, p.cash_balance, p.equity) == (80000.0, 50000.0, 130000.0)
    big = jobs.portfolio_and_risk(fills1(spark, ("BTC", 25, 50000, "FILLED")), pol)
    assert big["alerts"].first().message == "Exposure limit breached!"


@pytest.mark.parametrize("seed", range(4))
def test_fifo_against_a_sequential_model(spark, seed):
    rng = random.Random(seed)
    fs = [(rng.choice(["BUY", "SELL"]), rng.randint(1, 9), rng.randint(90, 110)) for _ in range(120)]
    lots, want = [], []
    for k, (side, q, p) in enumerate(fs, 1):
        lots, events = apply_fill(lots, side, float(q), float(p), k)
        want += [(min(e[2], k), max(e[2], k), e[5], e[7]) for e in events if e[0] == "match"]
    d = fills2(spark, *fs)
    m = acc.fifo_two_sided(d)
    assert sorted((min(r.buy_seq, r.sell_seq), max(r.buy_seq, r.sell_seq), r.matched_qty, r.realized_pnl) for r in m.collect()) == sorted(want)
    assert sorted((r.lot_seq, r.qty_rem) for r in acc.lots_latest(d).collect()) == sorted((x[0], x[2]) for x in lots)


def test_indicators_against_incremental_ones(spark):
    rng = random.Random(2)
    close = [round(rng.uniform(50, 60), 2) for _ in range(60)]
    d = spark.createDataFrame([("A", k, c, c, c, c, 1.0) for k, c in enumerate(close)], "symbol string, ts long, open double, high double, low double, close double, volume double")
    got = {r.ts: r for r in ind.multi(d).collect()}
    e = 0.0
    for k, c in enumerate(close):
        e = c if e == 0 else e + (c - e) * 2 / 6
        part = close[max(0, k - 13) : k + 1]
        changes = [b - a for a, b in zip(part, part[1:], strict=False)]
        gain, loss = sum(x for x in changes if x > 0), -sum(x for x in changes if x < 0)
        rsi = 0.0 if len(part) < 14 else 100.0 if loss == 0 else 100 - 100 / (1 + gain / loss)
        assert abs(got[k].ema5 - e) < 1e-9 and abs(got[k].rsi14 - rsi) < 1e-9
        assert abs(got[k].sma5 - sum(close[max(0, k - 4) : k + 1]) / min(5, k + 1)) < 1e-9


def crosses(spark, *points):
    return spark.createDataFrame([("BTC", t, 1.0, a, 10.0, 50.0) for t, a in points], ROWS)


def test_cross_patterns_and_cooldown(spark):
    d = crosses(spark, (1000, 9.9), (2000, 10.1), (3000, 10.1), (4000, 9.5))
    assert [(r.signal, r.ts) for r in st.cep_cross(d).orderBy("ts").collect()] == [("BUY", 2000), ("SELL", 4000)]
    assert [(r.signal, r.ts) for r in st.cep_golden(d).collect()] == [("BUY", 2000)]
    d = crosses(spark, (1000, 9.9), (1100, 10.1), (1150, 9.95), (1200, 10.05), (2000, 9.9), (2600, 10.3))
    found = st.cep_cross(d)
    assert [(r.signal, r.ts) for r in st.cooldown(found, 500).orderBy("ts").collect()] == [("BUY", 1100), ("SELL", 2000), ("BUY", 2600)]
    assert [(r.signal, r.ts) for r in st.cooldown(found, 500, ["BUY"]).orderBy("ts").collect()] == [("BUY", 1100), ("BUY", 2600)]


def test_three_stage_patterns(spark):
    rows = [("BTC", 0, 1.0, 20.0, 22.0, 20.0), ("BTC", 60_000, 1.0, 21.5, 22.0, 35.0), ("BTC", 120_000, 1.0, 22.5, 22.0, 45.0), ("ETH", 0, 3100.0, 3000.0, 2950.0, 80.0), ("ETH", 60_000, 3050.0, 3000.0, 2950.0, 65.0), ("ETH", 120_000, 2950.0, 3000.0, 2950.0, 45.0), ("SOL", 0, 1.0, 1.0, 1.0, 50.0)]
    d = spark.createDataFrame(rows, ROWS)
    buy, sell = st.cep_rsi_sma_buy(d).collect(), st.cep_rsi_sma_sell(d).collect()
    assert [(r.symbol, r.ts) for r in buy] == [("BTC", 120_000)] and 0 <= buy[0].signal_strength <= 1
    assert [(r.symbol, r.ts) for r in sell] == [("ETH", 120_000)]


def test_pattern_engine_against_brute_force(spark):
    rng = random.Random(6)
    rows = [("A", t, 1.0, float(rng.randint(0, 2)), 1.0, float(rng.randint(0, 9))) for t in range(200)]
    got = [r.ts for r in st.nfa(spark.createDataFrame(rows, ROWS), ["rsi < 2", "sma5 <= sma21", "sma5 > sma21"], 12, "rsi").orderBy("ts").collect()]
    want, since = [], 0
    for t in range(200):
        best = None
        for a in range(since, t):
            if rows[a][5] < 2 and t - a <= 12:
                b = next((b for b in range(a + 1, t) if rows[b][3] <= 1), None)
                c = b is not None and next((c for c in range(b + 1, t + 1) if rows[c][3] > 1), None) == t
                best = a if c and best is None else best
        if best is not None:
            want.append(t)
            since = t + 1
    assert got == want


def test_state_gate_and_seven_green(spark):
    d = spark.createDataFrame([("BTC", 1, 1.0, 19.5, 21.0, 0.0), ("BTC", 2, 1.0, 20.0, 20.8, 0.0), ("BTC", 3, 1.0, 21.5, 20.5, 0.0)], ROWS)
    assert [r.signal for r in st.state_gate(d).orderBy("ts").collect()] == ["SELL", "BUY"]
    d = spark.createDataFrame([("A", k * 60_000, 10.0 + k, 0.0, 0.0, 0.0) for k in range(15)], ROWS)
    assert [r.ts for r in st.seven_green(d).orderBy("ts").collect()] == [6 * 60_000, 13 * 60_000]


def test_folds_do_not_depend_on_batches(spark):
    rng = random.Random(8)
    rows = [(x, 60_000 * t, rng.choice([0.0] * 7 + [3.0]) + 0.1 * t, float(rng.randint(0, 2)), 1.0, float(rng.randint(0, 90))) for x in ("A", "B", None, "D") for t in range(40)]
    d = spark.createDataFrame(rows, ROWS)
    fills = spark.createDataFrame([(x, "S", t, t, float(rng.choice([-2, -1, 1, 2])), float(rng.randint(1, 9)), "FILLED") for x in ("A", "B") for t in range(40)], "account_id string, symbol string, seq long, ts long, fill_qty double, fill_price double, status string")

    def results():
        found = d.select("symbol", "ts", "close").withColumn("signal", F.lit("BUY"))
        frames = [ind.with_ema(d, 5, 14), st.cooldown(found, 150_000), st.nfa(d, ["rsi < 30", "sma5 <= sma21", "sma5 > sma21"], 900_000, "rsi"), st.seven_green(d), acc.avg_cost_updates(fills), acc.avg_cost_latest(fills)]
        return [sorted(map(repr, f.collect())) for f in frames]

    whole = results()
    assert all(whole)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for n in (1, 5):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
            assert results() == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert ind.with_ema(d.limit(0), 5).count() == st.seven_green(d.limit(0)).count() == acc.avg_cost_latest(fills.limit(0)).count() == 0


def test_router(spark):
    pol = spark.createDataFrame([("A1", 2, "ACTIVE"), ("A2", 2, "active"), ("A3", 9, "BLOCKED")], "account_id string, max_open_symbols int, status string")
    deltas = spark.createDataFrame([("UPSERT", "A1", "ETH", 1.0, 10, 1), ("UPSERT", "A2", "BTC", 1.0, 2000, 1), ("UPSERT", "A2", "XRP", 1.0, 2000, 2), ("DELETE", "A1", "ETH", None, 3000, 2)], "op string, account_id string, symbol string, net_qty double, ts long, seq long")
    sig = spark.createDataFrame([("RUN1", "BTC", 1000, "BUY"), ("RUN1", "BTC", 2500, "BUY"), ("RUN1", "BTC", 3500, "SELL")], "run_id string, symbol string, ts long, signal string")
    got = {r.signal_id: (r.account_id, r.action, r.qty) for r in routing.trade_picker(sig, pol, deltas).collect()}
    assert got == {"RUN1-1000": ("A2", "BUY", 1.0), "RUN1-2500": ("A1", "BUY", 1.0), "RUN1-3500": ("A1", "SELL", 1.0)}


def test_admission(spark):
    schema = "account_id string, symbol string, qty double, price double, ts long, seq long"
    o = spark.createDataFrame([("A", s, q, p, k, k) for k, (s, q, p) in enumerate([("a", 1.0, 1.0), ("b", 1.0, 1.0), ("c", 1.0, 1.0), ("d", 1.0, 1.0), ("a", 1.0, 2e6), ("a", -1.0, 1.0), ("d", 1.0, 1.0)])], schema)
    assert sorted(r.seq for r in routing.admission(o).collect()) == [0, 1, 2, 5, 6]
    facts = spark.createDataFrame([("A", "b", 0.0, 3, 0)], "account_id string, symbol string, net_qty double, ts long, seq long")
    assert sorted(r.seq for r in routing.admission(o, None, facts).collect()) == [0, 1, 2, 3, 5, 6]
    pol = spark.createDataFrame([("A", 1, "ACTIVE", 0)], "account_id string, max_open_symbols int, status string, ts long")
    assert sorted(r.seq for r in routing.admission(o, pol).collect()) == [0, 5, 6]


def test_interval_and_asof_joins(spark):
    a = spark.createDataFrame([("X", t, t) for t in (0, 499, 1000)], "symbol string, ts long, seq long")
    b = spark.createDataFrame([("X", t, float(t)) for t in (-500, 500, 999, 1500, 1501)], "symbol string, ts long, close double")
    got = sorted((r.ts, r.right_ts) for r in joins.interval_join(a, b, 500).collect())
    assert got == sorted((x, y) for x in (0, 499, 1000) for y in (-500, 500, 999, 1500, 1501) if abs(x - y) <= 500)
    s = spark.createDataFrame([("X", 10, 1, "p"), ("X", 499, 2, "q")], "symbol string, ts long, seq long, v string")
    assert [r.v for r in joins.asof_join(a, s, ["symbol"], ["v"]).orderBy("ts").collect()] == [None, "q", "q"]


def test_position_gate_takes_all_real_positions(spark, sf):
    import collections

    from marketloom.plans import queries
    from marketloom.sources import adapters

    limit = {r.account_id: 0 if r.status == "BLOCKED" else 2 for r in adapters.policies(spark, sf).collect()}
    rows = [(r.account_id, r.ts, 1, r.seq, r.symbol, r.qty, r.price) for r in queries.orders(spark, sf).collect()]
    net = collections.Counter()
    for r in sorted(adapters.fills_v1(spark, sf).where("status = 'FILLED' and fill_qty != 0").collect(), key=lambda r: r.seq):
        net[r.account_id, r.symbol] += r.fill_qty
        rows.append((r.account_id, r.ts, 0, r.seq, r.symbol, net[r.account_id, r.symbol], None))
    held, want = collections.defaultdict(dict), collections.defaultdict(lambda: [0, 0.0])
    for account, _, is_order, _, symbol, qty, price in sorted(rows, key=lambda r: r[:4]):
        own = held[account]
        if is_order:
            if abs(qty * price) > 1e6 or not own.get(symbol) and qty and sum(map(bool, own.values())) >= limit[account]:
                continue
            want[account, symbol][0] += 1
            want[account, symbol][1] += qty
            qty += own.get(symbol, 0.0)
        own[symbol] = qty
    got = {(r.account_id, r.symbol): [r.n, r.qty] for r in queries.QUERIES["adm_position_gate"](spark, sf).collect()}
    assert got == want


def test_joins_of_whole_tables(spark, sf):
    import collections

    from marketloom.plans import queries
    from marketloom.sources import adapters

    by = collections.defaultdict(list)
    for r in adapters.ticks(spark, sf).collect():
        by[r.symbol].append((r.ts, r.seq))
    want = sorted((s, *a, *b) for s, v in by.items() for a in v for b in v if abs(a[0] - b[0]) <= 600_000)
    assert sorted((r.symbol, r.ts, r.seq, r.right_ts, r.right_seq) for r in queries.QUERIES["jn_interval_whole"](spark, sf).collect()) == want

    state, want = collections.defaultdict(lambda: (0.0, 0.0, None)), []
    for r in sorted(adapters.fills_v1(spark, sf).collect(), key=lambda r: r.seq):
        key, q, price = (r.account_id, r.symbol), r.fill_qty, r.fill_price
        net, avg, last = state[key]
        if r.status == "FILLED" and q:
            after = net + q
            avg = price if net == 0 or after * net < 0 else (net * avg + q * price) / after if net * q > 0 else avg
            net = after
            if last is not None:
                want.append((*key, r.seq, "position", last, net, (last - avg) * net, r.ts))
        if avg:
            want.append((*key, r.seq, "price", price, net, (price - avg) * net, r.ts))
        state[key] = (net, avg, price)
    got = sorted((r.account_id, r.symbol, r.seq, r.side, r.current_price, r.net_qty, r.unrealized_pnl, r.ts) for r in queries.QUERIES["jn_asof_latest_whole"](spark, sf).collect())
    assert len(got) == len(want)
    for a, b in zip(got, sorted(want), strict=True):
        assert a[:6] + a[7:] == b[:6] + b[7:] and abs(a[6] - b[6]) < 1e-3


def hough_bars(spark):
    minute, rows = 60_000, []
    for k in range(40):
        line = 100.0 + k
        touch = k in (5, 10, 15, 20, 25)
        close = line + 6 if k >= 30 else line - 4
        high = line if touch else close + 1
        rows.append(("A", k * minute, close, high, close - 1, close, 1.0))
    return spark.createDataFrame(rows, "symbol string, ts long, open double, high double, low double, close double, volume double")


def test_trend_lines_and_summary(spark):
    bars, minute = hough_bars(spark), 60_000
    lines = trend.hough_lines(bars, 30 * minute, 5 * minute, touch_eps=0.08, min_score=0.0)
    best = lines.orderBy(F.desc("score")).first()
    assert best.slope > 0 and best.score >= 0.2
    s = trend.trend_summary(lines, tau_ms=7_200_000.0).orderBy("ts").collect()
    assert len(s) == lines.select("window_end_ts").distinct().count()
    assert all(0 < r.confidence <= 1 and -1 <= r.alpha <= 1 for r in s)
    assert {r.type for r in trend.line_events(bars, 30 * minute, 5 * minute, touch_eps=0.08, min_score=0.0).collect()} >= {"TOUCH"}
    wide = trend.hough_lines(bars, 30 * minute, 5 * minute, ind.swings(bars), touch_eps=0.08, min_score=0.0)
    assert wide.where("slope > 0").count() > 0


def test_breakout_persistence_modes():
    import numpy as np

    t = np.arange(8) * 10.0
    close = np.array([1, 1, 1, 5, 5, 5, 5, 5.0])
    kind = dict(slope=0.0, intercept=2.0, eps=0.5, span=4.0, false_bars=0)
    run = lambda mode, n: trend.along(t, close + 0.6, close - 2, close, persist_bars=n, mode=mode, **kind)["breakouts"]
    assert run("corrected", 1) == 1 and run("reference", 1) == 1
    assert run("corrected", 3) == 1 and run("reference", 2) == 0


def test_summary_phases(spark):
    h, cols = 3_600_000, "symbol string, window_end_ts long, slope double, slope_norm double, score double, breakouts int, breakout_strength double, last_breakout_ts long"
    rows = [("A", 10 * h, 1.0, 0.9, 0.9, 1, 0.8, 10 * h), ("A", 11 * h, 1.0, 0.9, 0.9, 0, 0.0, -1), ("A", 12 * h, -1.0, 0.0, 0.0, 0, 0.0, -1), ("B", 10 * h, 1.0, 0.6, 0.8, 0, 0.0, -1), ("B", 10 * h, -1.0, 0.4, 0.6, 0, 0.0, -1)]
    got = {(r.symbol, r.ts): r for r in trend.trend_summary(spark.createDataFrame(rows, cols)).collect()}
    assert [got["A", k * h].phase for k in (10, 11, 12)] == ["BREAKOUT", "PERSIST", "PERSIST"]
    assert got["A", 10 * h].breakout_direction == "UP" and got["A", 10 * h].direction == "STRONG_UP"
    assert got["B", 10 * h].lines_used == 2 and got["B", 10 * h].alpha > 0


def test_generated_candles_and_functions(spark):
    from marketloom.functions import register

    c = io.generated_candles(spark, ["A", "B"], 50)
    rows = c.orderBy("symbol", "ts").collect()
    assert len(rows) == 100 and all(r.low <= min(r.open, r.close) <= max(r.open, r.close) <= r.high for r in rows)
    assert rows == io.generated_candles(spark, ["A", "B"], 50).orderBy("symbol", "ts").collect()
    register(spark)
    assert spark.sql("SELECT norm01(5D, 0D, 10D) AS a, signed_qty('sell', 2D) AS b").first() == (0.5, -2.0)


@pytest.mark.parametrize("seed", range(3))
def test_fifo_of_fractional_quantities(spark, seed):
    """No ghost matches, and the same lots as fill by fill."""
    rng = random.Random(seed)
    fs = [(rng.choice(["BUY", "SELL"]), rng.choice([0.1, 0.2, 0.3, 0.7, 1.0, 0.05]), rng.randint(90, 110)) for _ in range(150)]
    lots, want = [], []
    for k, (side, q, p) in enumerate(fs, 1):
        lots, events = apply_fill(lots, side, q, float(p), k)
        want += [(min(e[2], k), max(e[2], k), round(e[5], 6)) for e in events if e[0] == "match" and e[5] > 1e-9]
    d = fills2(spark, *fs)
    got = acc.fifo_two_sided(d).collect()
    assert sorted((min(r.buy_seq, r.sell_seq), max(r.buy_seq, r.sell_seq), round(r.matched_qty, 6)) for r in got) == sorted(want)
    assert sorted((r.lot_seq, round(r.qty_rem, 6)) for r in acc.lots_latest(d).collect()) == sorted((x[0], round(x[2], 6)) for x in lots if x[2] > 1e-9)


def test_sides_in_any_case_and_fills_without_id(spark):
    schema = "account_id string, strategy_id string, symbol string, order_id string, fill_id string, side string, qty double, price double, ts long, seq long"
    rows = [("A", "S", "X", "o", "", "buy", 1.0, 10.0, 1, 1), ("A", "S", "X", "o", "", "buy", 2.0, 10.0, 2, 2), ("A", "S", "X", "o", "", "buy", 2.0, 10.0, 2, 3), ("A", "S", "X", "o", None, "Sell", 3.0, 12.0, 3, 4), ("A", "S", "X", "o", "f", "SELL", 1.0, 12.0, 4, 5), ("A", "S", "X", "o", "f", "SELL", 9.0, 12.0, 5, 6)]
    d = acc.dedupe_fills(spark.createDataFrame(rows, schema))
    assert sorted(r.seq for r in d.collect()) == [1, 2, 4, 5]
    m = acc.fifo_two_sided(d)
    assert sorted((r.buy_seq, r.sell_seq, r.matched_qty) for r in m.collect()) == [(1, 4, 1.0), (2, 4, 2.0)]
    assert [(r.match_seq, r.cumulative_pnl) for r in acc.realized_updates(m, acc.KEY2).collect()] == [(4, 6.0)]
    assert [(r.side, r.qty_rem) for r in acc.lots_latest(d).collect()] == [("SHORT", 1.0)]
    assert [r.net_qty for r in acc.rollup_changelog(d).orderBy("seq").collect()] == [1.0, 3.0, None, -1.0]


def test_policies_count_from_their_time_on(spark):
    o = spark.createDataFrame([("A", s, 1.0, 1.0, t, k) for k, (s, t) in enumerate([("a", 100), ("b", 150), ("c", 250), ("a", 260), ("d", 350)])], "account_id string, symbol string, qty double, price double, ts long, seq long")
    pol = spark.createDataFrame([("A", 1, "ACTIVE", 120), ("A", 9, "blocked", 200), ("A", 2, "ACTIVE", 350), ("B", 9, "ACTIVE", 0)], "account_id string, max_open_symbols int, status string, ts long")
    assert sorted(r.ts for r in routing.admission(o, pol).collect()) == [100, 260, 350]
    sig = spark.createDataFrame([("R", "X", t, "BUY") for t in (40, 100, 300, 500)], "run_id string, symbol string, ts long, signal string")
    hist = spark.createDataFrame([("A1", 2, "ACTIVE", 50), ("A1", 2, "BLOCKED", 200), ("A2", 1, "ACTIVE", 400)], "account_id string, max_open_symbols int, status string, ts long")
    deltas = spark.createDataFrame([("UPSERT", "A3", "Y", 1.0, 250, 1)], "op string, account_id string, symbol string, net_qty double, ts long, seq long")
    got = {r.ts: r.account_id for r in routing.trade_picker(sig, hist, deltas).collect()}
    assert got == {100: "A1", 300: "A3", 500: "A2"}


def test_admission_of_many_rows_of_an_account(spark):
    """Batches are smaller than the account; the state goes from one to the next."""
    rng = random.Random(3)
    rows = [(rng.choice("AB"), rng.choice("abcdef"), float(rng.choice([-1, 1, 2])), 10.0, k // 3, k) for k in range(2_000)]
    o = spark.createDataFrame(rows, "account_id string, symbol string, qty double, price double, ts long, seq long").repartition(7)
    pol = [("A", rng.randint(1, 4), rng.choice(["ACTIVE", "BLOCKED"]), t) for t in range(0, 600, 37)]
    events = sorted([(t, 0, 0, a, n, s) for a, n, s, t in pol] + [(r[4], 2, r[5], *r) for r in rows], key=lambda e: e[:3])
    net, limit, want = {"A": {}, "B": {}}, {"A": 3, "B": 3}, []
    for e in events:
        if e[1] == 0:
            limit[e[3]] = 0 if e[5] == "BLOCKED" else e[4]
            continue
        own, (a, s, q, *_) = net[e[3]], e[3:]
        if s in own or len(own) < limit[a]:
            own[s] = own.get(s, 0.0) + q
            own.pop(s) if own[s] == 0 else None
            want.append(e[2])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = routing.admission(o, spark.createDataFrame(pol, "account_id string, max_open_symbols int, status string, ts long"))
        assert sorted(r.seq for r in got.collect()) == sorted(want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_fills_are_numbered_over_their_whole_key(spark, sf):
    from marketloom.plans import queries

    for name in ("fill_dedupe", "snk_changelog_bridge"):
        last = queries.QUERIES[name](spark, sf).groupBy("account_id", "strategy_id", "symbol").agg(F.max("seq").alias("last"), F.count("*").alias("n")).collect()
        assert last and all(r.n <= r.last <= 2 * r.n for r in last)


def test_interval_join_unfolds_blocks_where_pairs_are_made(spark, monkeypatch):
    import random

    from marketloom.operators import joins

    rng = random.Random(5)
    left = [(rng.choice(["X", "Y", None]), rng.choice([None, rng.randrange(-2000, 2000)]), k) for k in range(150)] + [("X", 700, k) for k in range(150, 190)]
    right = [(rng.choice(["X", "Y", None]), rng.choice([None, rng.randrange(-2000, 2000)]), k) for k in range(150)] + [("X", 700, k) for k in range(150, 190)]
    want = sorted((s, a, k, b, j) for s, a, k in left for t, b, j in right if s is not None and s == t and a is not None and b is not None and abs(a - b) <= 100)
    frames = spark.createDataFrame(left, "symbol string, ts long, l long"), spark.createDataFrame(right, "symbol string, ts long, r long")
    for size in (1, 7, 1000):
        monkeypatch.setattr(joins, "BLOCK", size)
        found = joins.interval_join(*frames, 100)
        assert sorted((x.symbol, x.ts, x.l, x.right_ts, x.r) for x in found.collect()) == want
    assert "Generate explode(_rows" in found._jdf.queryExecution().optimizedPlan().toString()


def test_interval_join_gives_a_right_row_whole_blocks_and_copies_few_left_rows(spark):
    import itertools

    from marketloom.operators import joins

    left = spark.createDataFrame([("X", 10 * k, k) for k in range(400)], "symbol string, ts long, l long")
    right = spark.createDataFrame([("X", 10 * k + 5, k) for k in range(400)], "symbol string, ts long, r long")
    found = joins.interval_join(left, right, 1000)
    rows = [(x.ts, x.right_ts, x.r) for x in found.collect()]
    assert sorted(rows) == sorted((10 * a, 10 * b + 5, b) for a in range(400) for b in range(400) if abs(10 * a - 10 * b - 5) <= 1000)
    assert len(list(itertools.groupby(rows, lambda x: x[2]))) <= 2 * 400
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(_left" in plan and "explode(sequence(" in plan and "explode(array(" not in plan
