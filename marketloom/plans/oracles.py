"""The same results in SQL, over the same tables, for queries that SQL can express."""

from __future__ import annotations

from marketloom.plans.queries import DAY, REGIME_PREFS
from marketloom.sources.adapters import BAR_MS
from marketloom.sources.catalog import TABLES

#: Shared parts; each names those it needs.
CTE: dict[str, tuple[list[str], str]] = {
    "ticks": ([], "SELECT event_type AS symbol, epoch_us(ts) // 1000 AS ts, epoch_us(ts) AS us, event_id AS seq, value AS price FROM events"),
    "bars": (["ticks"], f"SELECT symbol, bar AS ts, arg_min(price, (us, seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (us, seq)) AS close, CAST(count(*) AS DOUBLE) AS volume FROM (SELECT *, (ts // {BAR_MS}) * {BAR_MS} AS bar FROM ticks) GROUP BY symbol, bar"),
    "smas": (["bars"], "SELECT *, avg(close) OVER w5 AS sma5, avg(close) OVER w14 AS sma14, avg(close) OVER w20 AS sma20, avg(close) OVER w21 AS sma21, avg(close) OVER w40 AS sma40, close - lag(close) OVER w AS change, row_number() OVER w AS n FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts), " + ", ".join(f"w{p} AS (PARTITION BY symbol ORDER BY ts ROWS {p - 1} PRECEDING)" for p in (5, 14, 20, 21, 40))),
    "inds": (["smas"], "SELECT * EXCLUDE (gain, loss, change), CASE WHEN n < 14 THEN 0.0 WHEN loss = 0 THEN 100.0 ELSE 100 - 100 / (1 + gain / loss) END AS rsi FROM (SELECT *, sum(greatest(change, 0)) OVER w AS gain, sum(greatest(-change, 0)) OVER w AS loss FROM smas WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 12 PRECEDING))"),
    "tall": (["smas"], "SELECT 'live' AS run_id, symbol, ts, name AS indicator_name, round(value, 8) AS value FROM (SELECT symbol, ts, unnest(['SMA_5', 'SMA_20', 'SMA_40']) AS name, unnest([sma5, sma20, sma40]) AS value FROM smas)"),
    "signals": (["inds"], "SELECT 'simple-cross' AS run_id, symbol, ts, close, sma5, sma21, CASE WHEN sma5 > sma21 THEN 'BUY' ELSE 'SELL' END AS signal, CASE WHEN sma21 <> 0 THEN abs(sma5 - sma21) / abs(sma21) ELSE 0 END AS signal_strength FROM inds WHERE sma5 <> sma21"),
    "trades": (["signals"], "SELECT run_id AS account_id, symbol, CASE signal WHEN 'BUY' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS qty, close AS price, ts FROM signals"),
    "li": ([], "SELECT 'A' || (l_suppkey % 5) AS account_id, 'S' || l_linestatus AS strategy_id, 'P' || (l_partkey % 4) AS symbol, l_orderkey::VARCHAR AS order_id, l_linenumber::VARCHAR AS fill_id, CASE WHEN (l_orderkey + l_linenumber) % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, l_quantity AS qty, floor(l_extendedprice / l_quantity * 100 + 0.5) / 100 AS price, epoch_ms(l_shipdate) AS ts, epoch_ms(l_shipdate) // 86400000 // 16 AS run, l_returnflag AS flag, (l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) AS o FROM lineitem"),
    "fills": (["li"], "SELECT * EXCLUDE (o, flag, run), run * 1000000000 + row_number() OVER (PARTITION BY account_id, strategy_id, symbol, run ORDER BY o) AS seq FROM li"),
    "uniq": (["fills"], "SELECT * FROM fills QUALIFY row_number() OVER (PARTITION BY account_id, strategy_id, symbol, order_id, fill_id ORDER BY seq) = 1"),
    "cums": (["uniq"], "SELECT *, sum(qty) OVER (PARTITION BY account_id, strategy_id, symbol, side ORDER BY seq) AS hi FROM uniq"),
    "buys": (["cums"], "SELECT * FROM cums WHERE side = 'BUY'"),
    "sells": (["cums"], "SELECT * FROM cums WHERE side = 'SELL'"),
    "points": (["cums"], "SELECT *, hi - coalesce(lag(hi) OVER (PARTITION BY account_id, strategy_id, symbol ORDER BY hi), 0) AS q FROM (SELECT DISTINCT account_id, strategy_id, symbol, hi FROM cums)"),
    "matches": (["points", "buys", "sells"], "SELECT p.account_id, p.strategy_id, p.symbol, b.order_id AS buy_order_id, b.fill_id AS buy_fill_id, s.order_id AS sell_order_id, s.fill_id AS sell_fill_id, b.ts AS buy_ts, s.ts AS sell_ts, b.price AS buy_price, s.price AS sell_price, p.q AS matched_qty, (s.price - b.price) * p.q AS realized_pnl, greatest(b.ts, s.ts) AS match_ts, greatest(b.seq, s.seq) AS match_seq, b.seq AS buy_seq, s.seq AS sell_seq FROM points p ASOF JOIN buys b ON p.account_id = b.account_id AND p.strategy_id = b.strategy_id AND p.symbol = b.symbol AND p.hi <= b.hi ASOF JOIN sells s ON p.account_id = s.account_id AND p.strategy_id = s.strategy_id AND p.symbol = s.symbol AND p.hi <= s.hi"),
    "used": (["matches"], "SELECT account_id, strategy_id, symbol, seq, sum(matched_qty) AS used FROM (SELECT account_id, strategy_id, symbol, buy_seq AS seq, matched_qty FROM matches UNION ALL SELECT account_id, strategy_id, symbol, sell_seq, matched_qty FROM matches) GROUP BY ALL"),
    "lots": (["uniq", "used"], "SELECT account_id, strategy_id, symbol, order_id || '#' || fill_id AS lot_id, CASE side WHEN 'BUY' THEN 'LONG' ELSE 'SHORT' END AS side, qty AS qty_open, qty - coalesce(used, 0) AS qty_rem, price AS avg_price, ts AS ts_open FROM uniq LEFT JOIN used USING (account_id, strategy_id, symbol, seq) WHERE qty - coalesce(used, 0) > 1e-12"),
    "rollup": (["lots"], "SELECT account_id, strategy_id, symbol, CASE WHEN net > 0 THEN 'LONG' ELSE 'SHORT' END AS side, net AS net_qty, abs(v / net) AS avg_price, ts AS last_updated FROM (SELECT account_id, strategy_id, symbol, sum(CASE side WHEN 'LONG' THEN qty_rem ELSE -qty_rem END) AS net, sum(avg_price * CASE side WHEN 'LONG' THEN qty_rem ELSE -qty_rem END) AS v, max(ts_open) AS ts FROM lots GROUP BY ALL) WHERE abs(net) > 1e-12"),
    "changes": (["uniq"], "SELECT CASE WHEN abs(net) <= 1e-12 THEN 'DELETE' ELSE 'UPSERT' END AS op, account_id, strategy_id, symbol, CASE WHEN abs(net) > 1e-12 THEN net END AS net_qty, ts, seq FROM (SELECT *, sum(CASE side WHEN 'BUY' THEN qty ELSE -qty END) OVER (PARTITION BY account_id, strategy_id, symbol ORDER BY seq) AS net FROM uniq)"),
    "fills_whole": (["li"], "SELECT * EXCLUDE (o, flag, run), row_number() OVER (PARTITION BY account_id, strategy_id, symbol ORDER BY o) AS seq FROM li"),
    "uniq_whole": (["fills_whole"], "SELECT * FROM fills_whole QUALIFY row_number() OVER (PARTITION BY account_id, strategy_id, symbol, order_id, fill_id ORDER BY seq) = 1"),
    "changes_whole": (["uniq_whole"], "SELECT CASE WHEN abs(net) <= 1e-12 THEN 'DELETE' ELSE 'UPSERT' END AS op, account_id, strategy_id, symbol, CASE WHEN abs(net) > 1e-12 THEN net END AS net_qty, ts, seq FROM (SELECT *, sum(CASE side WHEN 'BUY' THEN qty ELSE -qty END) OVER (PARTITION BY account_id, strategy_id, symbol ORDER BY seq) AS net FROM uniq_whole)"),
    "deltas": (["changes"], "SELECT op, account_id, symbol, net_qty, ts, row_number() OVER (PARTITION BY account_id ORDER BY ts, strategy_id, symbol, seq) AS seq FROM changes"),
    "states": (["deltas"], "SELECT account_id, ts, seq, symbol, is_open, CAST(sum(CASE WHEN is_open AND NOT was THEN 1 WHEN NOT is_open AND was THEN -1 ELSE 0 END) OVER (PARTITION BY account_id ORDER BY ts, seq) AS BIGINT) AS open_count FROM (SELECT *, coalesce(lag(is_open) OVER (PARTITION BY account_id, symbol ORDER BY ts, seq), false) AS was FROM (SELECT *, op = 'UPSERT' AND abs(coalesce(net_qty, 0)) > 1e-12 AS is_open FROM deltas))"),
    "fills1": (["li"], "SELECT account_id, symbol, order_id || '-' || fill_id AS order_id, CASE side WHEN 'BUY' THEN qty ELSE -qty END AS fill_qty, price AS fill_price, CASE flag WHEN 'R' THEN 'REJECTED' ELSE 'FILLED' END AS status, ts, run * 1000000000 + row_number() OVER (PARTITION BY account_id, symbol, run ORDER BY o) AS seq FROM li"),
    "filled": (["fills1"], "SELECT *, row_number() OVER (PARTITION BY account_id, symbol ORDER BY seq) AS k FROM fills1 WHERE status = 'FILLED' AND fill_qty <> 0"),
    "orders": (["fills1"], "SELECT account_id, symbol, fill_qty AS qty, fill_price AS price, ts, row_number() OVER (PARTITION BY account_id ORDER BY ts, symbol, seq) AS seq FROM fills1"),
    "reflected": (["filled"], "SELECT *, least(0, min(net) OVER (PARTITION BY account_id, symbol ORDER BY seq)) AS low FROM (SELECT *, sum(fill_qty) OVER (PARTITION BY account_id, symbol ORDER BY seq) AS net FROM filled)"),
    "effective": (["reflected"], "SELECT *, CASE WHEN fill_qty > 0 THEN fill_qty ELSE -fill_qty - (coalesce(lag(low) OVER (PARTITION BY account_id, symbol ORDER BY seq), 0) - low) END AS q, fill_qty > 0 AS buy FROM reflected"),
    "cums1": (["effective"], "SELECT *, sum(q) OVER (PARTITION BY account_id, symbol, buy ORDER BY seq) AS hi FROM effective WHERE q > 1e-12"),
    "matches1": (["cums1"], "SELECT b.account_id, b.symbol, b.order_id AS buy_order_id, s.order_id AS sell_order_id, b.fill_price AS buy_price, s.fill_price AS sell_price, least(b.hi, s.hi) - greatest(b.hi - b.q, s.hi - s.q) AS matched_qty, (s.fill_price - b.fill_price) * (least(b.hi, s.hi) - greatest(b.hi - b.q, s.hi - s.q)) AS realized_pnl, s.ts AS match_ts FROM cums1 b JOIN cums1 s ON b.account_id = s.account_id AND b.symbol = s.symbol AND b.buy AND NOT s.buy AND b.hi - b.q < s.hi AND s.hi - s.q < b.hi"),
    "steps": (["filled"], "SELECT account_id, symbol, seq, ts, k, fill_qty AS net, fill_price AS avg FROM filled WHERE k = 1 UNION ALL SELECT f.account_id, f.symbol, f.seq, f.ts, f.k, p.net + f.fill_qty, CASE WHEN p.net = 0 THEN f.fill_price WHEN sign(p.net) = sign(f.fill_qty) THEN (p.net * p.avg + f.fill_qty * f.fill_price) / (p.net + f.fill_qty) WHEN p.net + f.fill_qty = 0 OR sign(p.net + f.fill_qty) = sign(p.net) THEN p.avg ELSE f.fill_price END FROM steps p JOIN filled f ON f.account_id = p.account_id AND f.symbol = p.symbol AND f.k = p.k + 1"),
    "positions": (["steps"], "SELECT account_id, symbol, net AS net_qty, avg AS avg_price, ts AS last_updated FROM steps QUALIFY row_number() OVER (PARTITION BY account_id, symbol ORDER BY k DESC) = 1 AND net <> 0"),
    "policies": ([], "SELECT 'A' || (s_suppkey % 5) AS account_id, 3 AS max_open_symbols, CASE WHEN s_suppkey % 5 = 4 THEN 'BLOCKED' ELSE 'ACTIVE' END AS status, max(s_acctbal) AS initial_capital, 0::BIGINT AS ts FROM supplier GROUP BY s_suppkey % 5"),
    "portfolios": (["positions", "policies"], "SELECT account_id, coalesce(initial_capital, 0) + exposure AS equity, coalesce(initial_capital, 0) AS cash_balance, exposure, 0.0::DOUBLE AS margin_used FROM (SELECT account_id, sum(abs(net_qty * avg_price)) AS exposure FROM positions GROUP BY account_id) LEFT JOIN policies USING (account_id)"),
    "swing": (["bars"], "SELECT symbol, ts, t.type AS type, t.price AS price, 2 AS \"left\", 2 AS \"right\", t.rank AS rank FROM (SELECT symbol, ts, unnest(list_filter([CASE WHEN high >= top AND high - flo >= 0.02 * span THEN {'type': 'HIGH', 'price': high, 'rank': CAST(least(len(list_filter(hb, lambda x: x < high)), len(list_filter(ha, lambda x: x < high))) AS INTEGER)} END, CASE WHEN low <= flo AND top - low >= 0.02 * span THEN {'type': 'LOW', 'price': low, 'rank': CAST(least(len(list_filter(lb, lambda x: x > low)), len(list_filter(la, lambda x: x > low))) AS INTEGER)} END], lambda x: x IS NOT NULL)) AS t FROM (SELECT *, greatest(1e-9, top - flo) AS span FROM (SELECT symbol, ts, high, low, max(high) OVER a AS top, min(low) OVER a AS flo, list(high) OVER b AS hb, list(high) OVER c AS ha, list(low) OVER b AS lb, list(low) OVER c AS la FROM bars WINDOW a AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), b AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), c AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)) WHERE len(hb) = 2 AND len(ha) = 2))"),
    "crosses": (["inds"], f"SELECT symbol, ts, close, sma5, sma21, CASE WHEN sma5 > sma21 AND NOT lag(sma5 > sma21) OVER w AND ts - lag(ts) OVER w <= {DAY} THEN 'BUY' WHEN sma5 < sma21 AND NOT lag(sma5 < sma21) OVER w AND ts - lag(ts) OVER w <= {DAY} THEN 'SELL' END AS signal FROM inds WINDOW w AS (PARTITION BY symbol ORDER BY ts)"),
    "cross2": (["crosses"], "SELECT 'cep-cross' AS run_id, *, CASE WHEN sma21 <> 0 THEN least(1.0, abs(sma5 - sma21) / abs(sma21)) ELSE 0 END AS signal_strength FROM crosses WHERE signal IS NOT NULL"),
}


def regimes(days: int) -> str:
    """Features of windows of so many days, as a subquery."""
    n = days * DAY
    return (
        f"(SELECT symbol, greatest(start + {n}, max(ts)) AS ts_end, CASE WHEN count(r) >= 2 THEN stddev_pop(r) ELSE 0 END AS rv, CASE WHEN sum(tr) > 0 THEN abs(sum(dp) - sum(dm)) / sum(tr) ELSE 0 END AS trend FROM ("
        f"SELECT symbol, start, ts, CASE WHEN close > 0 AND lag(close) OVER w > 0 THEN ln(close / lag(close) OVER w) END AS r, CASE WHEN high - lag(high) OVER w > lag(low) OVER w - low AND high > lag(high) OVER w THEN high - lag(high) OVER w ELSE 0 END AS dp, CASE WHEN lag(low) OVER w - low > high - lag(high) OVER w AND lag(low) OVER w > low THEN lag(low) OVER w - low ELSE 0 END AS dm, CASE WHEN lag(close) OVER w IS NOT NULL THEN high - low ELSE 0 END AS tr "
        f"FROM (SELECT *, (ts // {n}) * {n} AS start FROM bars) WINDOW w AS (PARTITION BY symbol, start ORDER BY ts)) GROUP BY symbol, start)"
    )


def sql(*names: str, select: str) -> str:
    """A statement over the named shared parts and what these need."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in CTE[name][0]:
            add(need)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({CTE[n][1]})" for n in order) + " " + select if order else select


def summaries_sql(**outputs: tuple[str, str]) -> str:
    """Of each output by account: its rows and the sum of one of its columns."""
    return " UNION ALL ".join(f"SELECT account_id, count(*) AS n, round(sum({c})::DOUBLE, 1) AS total, '{k}' AS output FROM {rows} GROUP BY 1" for k, (rows, c) in outputs.items())


KEY = "account_id, strategy_id, symbol"
SIGNAL = "run_id, symbol, ts, close, round(sma5, 4) AS sma5, round(sma21, 4) AS sma21, signal, round(signal_strength, 4) AS signal_strength"
W = "WINDOW w AS (PARTITION BY symbol ORDER BY ts)"
REGIME = "CASE WHEN rv >= 1.2 THEN 'HIGHVOL' WHEN rv <= 0.2 THEN 'LOWVOL' WHEN trend >= 0.35 THEN 'TREND' WHEN trend <= 0.15 THEN 'MEANREV' ELSE 'CHAOS' END"
CHANGED = f"(SELECT * FROM (SELECT symbol, ts_end, rv, trend, regime, lag(regime) OVER (PARTITION BY symbol ORDER BY ts_end) AS b FROM (SELECT *, {REGIME} AS regime FROM (SELECT symbol, ts_end, round(rv, 4) AS rv, round(trend, 4) AS trend FROM {regimes(1)}))) WHERE b IS NULL OR b <> regime)"
PREFS = "(SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', {c}::DOUBLE)" for a, b, c in REGIME_PREFS) + ") AS t(strategy_id, regime, weight))"


ORACLES: dict[str, str] = {
    "src_table_log": sql("ticks", select="SELECT symbol, ts, seq, price FROM ticks"),
    "src_json_nested": sql("bars", select="SELECT symbol, to_timestamp(ts // 1000)::TIMESTAMP AS time, open::DECIMAL(10,4) AS open, high::DECIMAL(10,4) AS high, low::DECIMAL(10,4) AS low, close::DECIMAL(10,4) AS close, volume::BIGINT AS volume FROM bars"),
    "src_values": "SELECT 'BTC/USDT' AS symbol, i * 60000 AS ts, (100 + i)::DOUBLE AS open, (102 + i)::DOUBLE AS high, (99 + i)::DOUBLE AS low, (101 + i)::DOUBLE AS close, (10 + i)::DOUBLE AS volume FROM range(6) t(i)",
    "src_flexible_deser": sql("inds", select="SELECT symbol, ts, CASE WHEN rsi > 50 THEN 3 ELSE 2 END AS n_fields, close, round(CASE WHEN rsi > 50 THEN rsi END, 6) AS missing, volume::BIGINT AS volume FROM inds"),
    "src_row_accessor": sql("inds", select="SELECT symbol, ts, round(sma5, 6) AS sma5, round(sma21, 6) AS sma21, 0.0::DOUBLE AS ema9 FROM inds"),
    "src_typed_deser": sql("fills", select="SELECT account_id, symbol, order_id::BIGINT AS order_id, qty, NULL::DOUBLE AS bad_price, ts FROM fills"),
    "src_projection": "SELECT event_type, max(value) AS top FROM events GROUP BY 1",
    "snk_append": sql("fills", select="SELECT account_id, symbol, side, count(*) AS n, sum(qty) AS qty FROM fills GROUP BY ALL"),
    "snk_upsert": sql("changes", select=f"SELECT {KEY}, net_qty, seq FROM (SELECT * FROM changes QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY seq DESC) = 1) WHERE op <> 'DELETE'"),
    "snk_row_mappers": sql("fills1", select="SELECT account_id, order_id, symbol, fill_qty, fill_price::DECIMAL(18,4) AS fill_price, status, (epoch_ms(ts))::DATE AS ts_day FROM fills1"),
    "snk_signal_row": sql("signals", select="SELECT 'live' AS run_id, symbol, epoch_ms(ts) AS time, round(close, 4)::DECIMAL(10,4) AS close, round(sma5, 8)::DECIMAL(18,8) AS sma5, round(sma21, 8)::DECIMAL(18,8) AS sma21, signal, round(round(signal_strength, 8), 2)::DECIMAL(5,2) AS signal_strength FROM signals"),
    "snk_changelog_bridge": sql("changes_whole", select=f"SELECT CASE op WHEN 'DELETE' THEN 'DELETE' ELSE 'UPDATE_AFTER' END AS row_kind, {KEY}, seq, net_qty FROM changes_whole"),
    "snk_match_bridge": sql("matches", select=f"SELECT {KEY}, buy_order_id, sell_order_id, buy_ts, sell_ts, buy_price, sell_price, round(matched_qty, 4) AS matched_qty, round(realized_pnl, 4) AS realized_pnl, match_ts FROM matches"),
    "snk_pojo_adapter": sql("rollup", select=f"SELECT {KEY}, side, net_qty, round(avg_price, 3) AS avg_price, last_updated FROM rollup"),
    "strat_iface": sql("signals", select=f"SELECT run_id, signal, count(*) AS n FROM signals GROUP BY ALL UNION ALL SELECT 'rsi-threshold', CASE WHEN rsi < 30 THEN 'BUY' ELSE 'SELL' END AS sg, count(*) FROM inds WHERE rsi < 30 OR rsi > 70 GROUP BY sg UNION ALL SELECT 'state-cross', signal, count(*) FROM (SELECT CASE WHEN sma5 > sma21 AND lag(sma5) OVER w <= lag(sma21) OVER w THEN 'BUY' WHEN sma5 < sma21 AND lag(sma5) OVER w >= lag(sma21) OVER w THEN 'SELL' END AS signal FROM inds {W}) WHERE signal IS NOT NULL GROUP BY signal"),
    "snk_noop": sql("ticks", select="SELECT symbol, count(*) AS n FROM ticks GROUP BY 1"),
    "cat_ddl": sql("bars", "uniq", "changes", select="").removesuffix(" ") + (
        ", t AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {len(c.split(', '))}, {len([x for x in p.split(', ') if x])})" for n, (_, p, c) in TABLES.items() if n not in ("risk_state_latest", "trendsummary10")) + ") AS t(table_name, n_columns, n_key)), "
        f"r AS (SELECT 'market_data_history' AS table_name, count(*) AS n FROM bars UNION ALL SELECT 'exec_report_history', count(*) FROM uniq UNION ALL SELECT 'open_positions_rollup', count(*) FROM (SELECT * FROM changes QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY CASE WHEN seq % 2 = 1 THEN 1 ELSE 0 END DESC, seq DESC) = 1) WHERE op <> 'DELETE') "
        "SELECT table_name, n_columns::BIGINT AS n_columns, n_key::BIGINT AS n_key, coalesce(n, 0) AS n_rows FROM t LEFT JOIN r USING (table_name)"
    ),
    "dml_delete_all": sql("bars", "signals", "matches", select="SELECT 'strategy_signals' AS table_name, 0::BIGINT AS n_rows, count(*) AS n_before FROM signals UNION ALL SELECT 'trade_match_history', count(*) FILTER (NOT realized_pnl < 0), count(*) FROM matches UNION ALL SELECT 'market_data_history', count(*), count(*) FROM bars"),
    "prj_signal_to_trade": sql("trades", select="SELECT * FROM trades"),
    "prj_fill_sim": sql("trades", select="SELECT account_id, symbol, qty AS fill_qty, price AS fill_price, 'FILLED' AS status, ts FROM trades"),
    "prj_price_tick": sql("fills1", select="SELECT account_id, symbol, fill_price AS price, ts FROM fills1"),
    "prj_policy_from_signal": sql("signals", select="SELECT run_id AS account_id, 3 AS max_open_symbols, 'ACTIVE' AS status, 100000.0::DOUBLE AS initial_capital, ts FROM signals"),
    "prj_venue_order": sql("trades", select="SELECT account_id, account_id || '-' || symbol || '-' || ts AS order_id, symbol, qty, price, 'SIM_EXCHANGE' AS venue, 'NEW' AS status, ts FROM trades"),
    "upd_order_status": sql("trades", select=f"SELECT account_id, account_id || '-' || symbol || '-' || ts AS order_id, symbol, qty, price, 'SIM_EXCHANGE' AS venue, CASE WHEN (ts // {BAR_MS}) % 8 = 3 THEN 'NEW' ELSE 'PARTIAL' END AS status, ts FROM trades WHERE (ts // {BAR_MS}) % 4 >= 2 OR (ts // {BAR_MS}) % 8 = 3"),
    "flt_positive_close": sql("bars", select="SELECT symbol, ts, close FROM bars WHERE close > 0"),
    "flt_non_null": sql("inds", select="SELECT symbol, ts, 'BUY' AS signal FROM inds WHERE sma5 > sma21"),
    "flt_buy_signals": sql("smas", select="SELECT 'live' AS run_id, symbol, ts, 'BUY_SIGNAL' AS signal_type, 1 AS signal_value FROM smas WHERE round(sma20, 8) > round(sma40, 8)"),
    "flt_rsi_overbought": sql("inds", select="SELECT symbol, ts, round(rsi, 4) AS rsi FROM inds WHERE rsi > 70"),
    "expr_case_trend": sql("tall", select=f"SELECT symbol, ts, value, lag(value) OVER w AS previous, CASE WHEN value > lag(value) OVER w THEN 'RISING' WHEN value < lag(value) OVER w THEN 'FALLING' ELSE 'FLAT' END AS trend FROM tall WHERE indicator_name = 'SMA_20' {W}"),
    "expr_case_zone": sql("smas", select="SELECT symbol, ts, CASE WHEN round(sma20, 8) > round(sma40, 8) THEN 'BUY_ZONE' WHEN round(sma20, 8) < round(sma40, 8) THEN 'SELL_ZONE' ELSE 'NEUTRAL' END AS zone FROM smas"),
    "expr_validate_signal": sql("orders", "policies", select="SELECT account_id, CASE WHEN status <> 'ACTIVE' THEN 'REJECT_ACCOUNT' WHEN qty * price > 50000 THEN 'REJECT_NOTIONAL' ELSE 'ACCEPT' END AS decision, count(*) AS n FROM orders JOIN policies USING (account_id) GROUP BY ALL"),
    "risk_alert": sql("portfolios", select="SELECT account_id, 'Exposure limit breached!' AS message FROM portfolios WHERE round(exposure, 2) > 1000000"),
    "ind_sma": sql("smas", select="SELECT symbol, ts, round(sma5, 4) AS sma5, round(sma14, 4) AS sma14, round(sma21, 4) AS sma21 FROM smas"),
    "ind_sma_sql": sql("smas", select="SELECT symbol, ts, 'SMA_20' AS indicator_name, round(sma20, 6)::DECIMAL(18,6) AS value FROM smas WHERE close > 0"),
    "ind_rsi": sql("inds", select="SELECT symbol, ts, round(rsi, 4) AS rsi14 FROM inds"),
    "ind_latest": sql("tall", select="SELECT symbol, indicator_name, arg_max(value, ts) AS value, max(ts) AS ts FROM tall GROUP BY ALL"),
    "ind_timeseries": sql("tall", select="SELECT * FROM tall"),
    "ind_trend_dir": sql("tall", select="SELECT symbol, indicator_name, trend, count(*) AS n FROM (SELECT *, CASE WHEN value > lag(value) OVER w THEN 'RISING' WHEN value < lag(value) OVER w THEN 'FALLING' ELSE 'FLAT' END AS trend FROM tall WINDOW w AS (PARTITION BY symbol, indicator_name ORDER BY ts)) GROUP BY ALL"),
    "ind_pivot": sql("smas", select="SELECT 'live' AS run_id, symbol, ts, round(sma20, 8) AS sma_20, round(sma40, 8) AS sma_40, round(sma5, 8) AS sma_5 FROM smas"),
    "ind_swing": sql("swing", select="SELECT * FROM swing"),
    "ind_hough_votes": sql("bars", select=f"SELECT symbol, s AS window_start_ts, CAST(2 * 36 * count(*) AS BIGINT) AS votes FROM (SELECT symbol, ts, unnest([(ts // {6 * BAR_MS} - k) * {6 * BAR_MS} FOR k IN [0, 1, 2, 3]]) AS s FROM bars) GROUP BY ALL HAVING count(*) >= 10"),
    "ind_regime_features": sql("bars", select=f"SELECT symbol, ts_end, round(rv, 4) AS rv, round(trend, 4) AS trend FROM {regimes(4)}"),
    "ind_regime_class": sql("bars", select=f"SELECT symbol, ts_end, rv, trend, regime FROM {CHANGED}"),
    "ref_regime_prefs": f"SELECT * FROM {PREFS}",
    "regime_weights": sql("bars", select=f"SELECT symbol, ts_end, regime, strategy_id, weight FROM {CHANGED} JOIN {PREFS} USING (regime)"),
    "strat_simple_cross": sql("signals", select=f"SELECT {SIGNAL} FROM signals"),
    "strat_rsi_threshold": sql("inds", select=f"SELECT {SIGNAL} FROM (SELECT 'rsi-threshold' AS run_id, *, CASE WHEN rsi < 30 THEN 'BUY' ELSE 'SELL' END AS signal, abs(rsi - 50) / 50 AS signal_strength FROM inds WHERE rsi < 30 OR rsi > 70)"),
    "strat_state_cross": sql("inds", select=f"SELECT {SIGNAL} FROM (SELECT 'state-cross' AS run_id, *, CASE WHEN sma5 > sma21 AND lag(sma5) OVER w <= lag(sma21) OVER w THEN 'BUY' WHEN sma5 < sma21 AND lag(sma5) OVER w >= lag(sma21) OVER w THEN 'SELL' END AS signal, CASE WHEN sma21 > 0 THEN least(1.0, abs(sma5 - sma21) / sma21 * 100) ELSE 0 END AS signal_strength FROM inds {W}) WHERE signal IS NOT NULL"),
    "strat_state_gate": sql("signals", "inds", select=f"SELECT {SIGNAL} FROM signals WHERE (symbol, ts) NOT IN (SELECT (symbol, min(ts)) FROM inds GROUP BY symbol)"),
    "strat_cross_sql": sql("smas", select=f"SELECT symbol, ts, sma_20, sma_40, CASE WHEN sma_20 > sma_40 AND lag(sma_20) OVER w <= lag(sma_40) OVER w THEN 'BUY' WHEN sma_20 < sma_40 AND lag(sma_20) OVER w >= lag(sma_40) OVER w THEN 'SELL' ELSE 'HOLD' END AS crossover_signal FROM (SELECT symbol, ts, round(sma20, 8) AS sma_20, round(sma40, 8) AS sma_40 FROM smas) {W}"),
    "strat_generic_job": sql("inds", select=f"SELECT {SIGNAL} FROM (SELECT 'state-cross' AS run_id, *, CASE WHEN sma5 > sma21 AND lag(sma5) OVER w <= lag(sma21) OVER w THEN 'BUY' WHEN sma5 < sma21 AND lag(sma5) OVER w >= lag(sma21) OVER w THEN 'SELL' END AS signal, CASE WHEN sma21 > 0 THEN least(1.0, abs(sma5 - sma21) / sma21 * 100) ELSE 0 END AS signal_strength FROM inds {W}) WHERE signal IS NOT NULL"),
    "cep_golden": sql("crosses", select=f"SELECT {SIGNAL} FROM (SELECT 'cep-golden' AS run_id, *, CASE WHEN sma21 > 0 THEN least(1.0, abs(sma5 - sma21) / sma21 * 100) ELSE 0 END AS signal_strength FROM crosses WHERE signal = 'BUY')"),
    "cep_cross2": sql("cross2", select=f"SELECT {SIGNAL} FROM cross2"),
    "cep_cooldown": sql("cross2", select="").removesuffix(" ") + f", k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS n FROM cross2), g AS (SELECT k.*, ts AS last, true AS ok FROM k WHERE n = 1 UNION ALL SELECT k.*, CASE WHEN k.ts - g.last >= {3 * DAY} THEN k.ts ELSE g.last END, k.ts - g.last >= {3 * DAY} FROM g JOIN k ON k.symbol = g.symbol AND k.n = g.n + 1) SELECT {SIGNAL} FROM g WHERE ok",
    "cep_seven_green": sql("bars", select="SELECT 'seven-green' AS run_id, symbol, ts, v AS close, 0.0::DOUBLE AS sma5, 0.0::DOUBLE AS sma21, 'BUY' AS signal, round(CASE WHEN v0 > 0 THEN least(1.0, 10 * (v - v0) / v0) ELSE 0 END, 4) AS signal_strength FROM (SELECT *, lag(v, 6) OVER (PARTITION BY symbol ORDER BY ts) AS v0, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS n FROM (SELECT symbol, ts, sum(volume) OVER (PARTITION BY symbol ORDER BY ts) AS v FROM bars)) WHERE n % 7 = 0"),
    "cep_side_debug": sql("cross2", select="SELECT symbol, ts, printf('%s %s @%d sma5=%.4f sma21=%.4f', signal, symbol, ts, round(sma5, 4), round(sma21, 4)) AS line FROM cross2"),
    "jn_interval": sql("ticks", select="SELECT l.symbol, l.ts, l.seq, r.ts AS right_ts, r.seq AS right_seq, r.price FROM ticks l JOIN ticks r ON l.symbol = r.symbol AND abs(l.ts - r.ts) <= 600000"),
    "jn_interval_whole": sql("ticks", select="SELECT l.symbol, l.ts, l.seq, r.ts AS right_ts, r.seq AS right_seq, r.price FROM ticks l JOIN ticks r ON l.symbol = r.symbol AND abs(l.ts - r.ts) <= 600000"),
    "jn_equi_self": sql("smas", select="SELECT symbol, ts, round(sma5, 8) AS value, round(sma20, 8) AS slow FROM smas"),
    "jn_temporal": sql("orders", "policies", select=f"SELECT o.account_id, symbol, version::INTEGER AS version, v.status, count(*) AS n, sum(qty) AS qty FROM orders o ASOF LEFT JOIN (SELECT account_id, version, CASE version WHEN 1 THEN 'SUSPENDED_' || status ELSE status END AS status, [9500, 10200, 11000][version + 1]::BIGINT * {DAY} AS vts FROM policies, range(3) t(version)) v ON o.account_id = v.account_id AND o.ts >= v.vts GROUP BY ALL"),
    "jn_asof_latest": sql("fills1", select="SELECT f.account_id, f.symbol, f.ts, f.seq, p.price FROM fills1 f ASOF LEFT JOIN (SELECT symbol, ts AS pts, arg_max(fill_price, (account_id, seq)) AS price FROM fills1 GROUP BY ALL) p ON f.symbol = p.symbol AND f.ts > p.pts"),
    "jn_asof_latest_whole": sql("steps", "fills1", select="SELECT account_id, symbol, seq, side, current_price, net_qty, round(avg + 1e-7, 4) AS avg_price, round((current_price - avg) * net_qty + 1e-7, 4) AS unrealized_pnl, ts FROM ("
        "SELECT p.account_id, p.symbol, p.seq, 'position' AS side, t.fill_price AS current_price, p.net AS net_qty, p.avg, greatest(p.ts, t.ts) AS ts FROM steps p ASOF JOIN fills1 t ON p.account_id = t.account_id AND p.symbol = t.symbol AND p.seq > t.seq "
        "UNION ALL SELECT t.account_id, t.symbol, t.seq, 'price', t.fill_price, p.net, p.avg, greatest(p.ts, t.ts) FROM fills1 t ASOF JOIN steps p ON p.account_id = t.account_id AND p.symbol = t.symbol AND t.seq >= p.seq)"),
    "src_changes": sql("changes", select="").removesuffix(" ") + (
        ", a AS (SELECT * FROM (SELECT * FROM changes WHERE seq // 1000000000 % 2 = 1 QUALIFY row_number() OVER (PARTITION BY account_id, strategy_id, symbol ORDER BY seq DESC) = 1) WHERE op <> 'DELETE'), "
        "b AS (SELECT * FROM (SELECT * FROM changes WHERE seq // 1000000000 % 2 = 1 OR symbol <> 'P3' QUALIFY row_number() OVER (PARTITION BY account_id, strategy_id, symbol ORDER BY seq DESC) = 1) WHERE op <> 'DELETE') "
        "SELECT CASE WHEN a.seq IS NULL THEN '+I' WHEN b.seq IS NULL THEN '-D' ELSE '+U' END AS row_kind, 'UPSERT' AS op, account_id, strategy_id, symbol, coalesce(b.net_qty, a.net_qty) AS net_qty, coalesce(b.seq, a.seq) AS seq FROM a FULL JOIN b USING (account_id, strategy_id, symbol) WHERE a.seq IS DISTINCT FROM b.seq"
    ),
    "jn_asof_symbol": sql("uniq", "matches", select="").removesuffix(" ") + (
        ", gain AS (SELECT account_id, strategy_id, symbol, match_seq AS seq, sum(realized_pnl) AS gain FROM matches GROUP BY ALL), "
        "run AS (SELECT account_id, strategy_id, symbol, ts, seq, sum(CASE side WHEN 'BUY' THEN qty ELSE -qty END) OVER k AS net, sum(CASE side WHEN 'BUY' THEN qty ELSE -qty END * price + coalesce(gain, 0)) OVER k AS cost FROM uniq LEFT JOIN gain USING (account_id, strategy_id, symbol, seq) WINDOW k AS (PARTITION BY account_id, strategy_id, symbol ORDER BY seq)), "
        "pos AS (SELECT *, abs(cost / net) AS avg, lead(ts) OVER (PARTITION BY account_id, strategy_id, symbol ORDER BY seq) AS until FROM run), "
        "px AS (SELECT symbol, ts AS pts, arg_max(price, (account_id, strategy_id, seq)) AS price FROM uniq GROUP BY ALL) "
        "SELECT 'UPSERT' AS op, account_id, strategy_id, pos.symbol, 'price' AS cause, 0::BIGINT AS seq, price AS current_price, net AS net_qty, round(avg + 1e-6, 2) AS avg_price, round((price - avg) * net, 2) AS unrealized_pnl, pts AS ts FROM pos JOIN px ON pos.symbol = px.symbol AND pts >= ts AND (until IS NULL OR pts < until) WHERE abs(net) > 1e-12 "
        "UNION ALL SELECT 'UPSERT', account_id, strategy_id, pos.symbol, 'position', seq, price, net, round(avg + 1e-6, 2), round((price - avg) * net, 2), ts FROM pos ASOF JOIN px ON pos.symbol = px.symbol AND pos.ts > px.pts WHERE abs(net) > 1e-12 "
        "UNION ALL SELECT 'DELETE', account_id, strategy_id, symbol, 'position', seq, NULL, NULL, NULL, NULL, ts FROM pos WHERE abs(net) <= 1e-12"
    ),
    "upnl_v2": sql("rollup", "uniq", select="SELECT account_id, strategy_id, round(sum((price - avg_price) * net_qty), 2) AS unrealized_pnl FROM rollup JOIN (SELECT symbol, arg_max(price, (ts, account_id, strategy_id, seq)) AS price FROM uniq GROUP BY symbol) USING (symbol) GROUP BY ALL"),
    "jn_connect_policy": sql("orders", "policies", select=f"SELECT o.account_id, v.version, count(*) AS n, sum(o.qty) AS qty FROM orders o ASOF LEFT JOIN (SELECT account_id, unnest([22, 24, 26]) AS version, unnest([22, 24, 26])::BIGINT * {365 * DAY} AS vts FROM policies) v ON o.account_id = v.account_id AND o.ts >= v.vts GROUP BY ALL"),
    "jn_cogroup_window": sql("bars", "swing", select=f"SELECT b.symbol, b.s AS window_start_ts, b.n AS n_bars, coalesce(w.n, 0) AS n_swings, coalesce(w.highs, 0) AS n_highs, w.top AS top_swing FROM (SELECT symbol, s, count(*) AS n FROM (SELECT symbol, unnest([(ts // {6 * BAR_MS} - k) * {6 * BAR_MS} FOR k IN [0, 1, 2, 3]]) AS s FROM bars) GROUP BY ALL) b LEFT JOIN (SELECT symbol, s, count(*) AS n, count(*) FILTER (type = 'HIGH') AS highs, max(price) AS top FROM (SELECT symbol, type, price, unnest([(ts // {6 * BAR_MS} - k) * {6 * BAR_MS} FOR k IN [0, 1, 2, 3]]) AS s FROM swing) GROUP BY symbol, s) w USING (symbol, s)"),
    "jn_unnest": sql("bars", select="SELECT symbol, count(*) AS n, max(price) AS top FROM (SELECT symbol, unnest([open, high, low, close]) AS price FROM bars) GROUP BY 1"),
    "jn_union_tag": sql("orders", "policies", select="SELECT account_id, 'policy' AS kind, count(*) AS n, max(initial_capital) AS capital, NULL::DOUBLE AS qty FROM policies GROUP BY 1 UNION ALL SELECT account_id, 'order', count(*), NULL, sum(qty) FROM orders GROUP BY 1"),
    "rt_account_state": sql("states", select="SELECT account_id, ts, seq, symbol, is_open, open_count FROM states"),
    "pos_avg_cost": sql("positions", select="SELECT account_id, symbol, net_qty, round(avg_price, 4) AS avg_price, last_updated FROM positions"),
    "pos_avg_cost_updates": sql("steps", select="SELECT account_id, symbol, count(*) AS n, CAST(sum(CASE WHEN net = 0 THEN 1 ELSE 0 END) AS BIGINT) AS flat, max(net) AS most FROM steps GROUP BY ALL"),
    "pos_close_events": sql("filled", select="SELECT account_id, symbol, 0.0::DOUBLE AS total_qty, 0::BIGINT AS open_ts, ts AS close_ts, seq FROM (SELECT *, sum(fill_qty) OVER (PARTITION BY account_id, symbol ORDER BY seq) AS net FROM filled) WHERE net = 0"),
    "fifo_long_only": sql("matches1", select="SELECT account_id, symbol, buy_order_id, sell_order_id, buy_price, sell_price, matched_qty, round(realized_pnl, 4) AS realized_pnl, match_ts FROM matches1"),
    "fifo_two_sided": sql("matches", select=f"SELECT {KEY}, buy_order_id, buy_fill_id, sell_order_id, sell_fill_id, buy_price, sell_price, matched_qty, round(realized_pnl, 4) AS realized_pnl, match_ts, match_seq FROM matches"),
    "realized_pnl_by_symbol": sql("matches", select="SELECT account_id, symbol, round(sum(realized_pnl), 2) AS realized_pnl FROM matches GROUP BY ALL"),
    "fill_dedupe": sql("uniq_whole", select=f"SELECT {KEY}, order_id, fill_id, side, qty, price, seq FROM uniq_whole"),
    "lots_latest": sql("lots", select="SELECT * FROM lots"),
    "lots_changelog": sql("uniq", "matches", select=f"SELECT CASE WHEN rem <= 1e-12 THEN 'DELETE' ELSE 'UPSERT' END AS op, {KEY}, seq AS lot_seq, change_seq, CASE WHEN rem > 1e-12 THEN rem END AS qty_rem FROM (SELECT *, -sum(used) OVER (PARTITION BY {KEY}, seq ORDER BY change_seq) AS rem FROM (SELECT {KEY}, seq, change_seq, sum(used) AS used FROM (SELECT {KEY}, seq, seq AS change_seq, -qty AS used FROM uniq UNION ALL SELECT {KEY}, buy_seq, greatest(buy_seq, sell_seq), matched_qty FROM matches UNION ALL SELECT {KEY}, sell_seq, greatest(buy_seq, sell_seq), matched_qty FROM matches) GROUP BY ALL)) WHERE NOT (change_seq = seq AND rem <= 1e-12)"),
    "rollup_latest": sql("rollup", select=f"SELECT {KEY}, side, net_qty, round(avg_price, 3) AS avg_price, last_updated FROM rollup"),
    "rollup_changelog": sql("changes", select="SELECT * FROM changes"),
    "rpnl_updates": sql("matches", select=f"SELECT {KEY}, match_seq, ts, round(sum(delta) OVER (PARTITION BY {KEY} ORDER BY match_seq), 2) AS cumulative_pnl FROM (SELECT {KEY}, match_seq, sum(realized_pnl) AS delta, max(match_ts) AS ts FROM matches GROUP BY ALL) WHERE abs(delta) > 1e-12"),
    "rpnl_cumulative": sql("matches", select=f"SELECT {KEY}, match_seq, buy_seq, sell_seq, round(sum(realized_pnl) OVER (PARTITION BY {KEY} ORDER BY match_seq, buy_seq, sell_seq), 2) AS cumulative_pnl FROM matches"),
    "upnl_v1": sql("positions", "fills1", select="SELECT account_id, symbol, price AS current_price, round((price - avg_price) * net_qty + 1e-6, 2) AS unrealized_pnl, greatest(last_updated, pts) AS ts FROM positions JOIN (SELECT account_id, symbol, arg_max(fill_price, seq) AS price, max(ts) AS pts FROM fills1 GROUP BY ALL) USING (account_id, symbol)"),
    "pf_aggregate": sql("portfolios", select="SELECT account_id, round(equity, 2) AS equity, cash_balance, round(exposure, 2) AS exposure, margin_used FROM portfolios"),
    "job_portfolio_risk": sql("portfolios", "filled", "matches1", select=summaries_sql(
        positions=("positions", "net_qty"), closes=("(SELECT * FROM (SELECT *, sum(fill_qty) OVER (PARTITION BY account_id, symbol ORDER BY seq) AS net FROM filled) WHERE net = 0)", "seq"),
        matches=("matches1", "matched_qty"), realized=("(SELECT account_id, symbol, sum(realized_pnl) AS realized_pnl FROM matches1 GROUP BY ALL)", "realized_pnl"), portfolio=("portfolios", "equity"),
    )),
    "job_trade_matching": sql("matches1", select="SELECT account_id, symbol, round(sum(realized_pnl), 2) AS realized_pnl, max(match_ts) AS ts FROM matches1 GROUP BY ALL"),
    "job_trading_engine2": sql("rollup", "changes", "matches", select=summaries_sql(
        matches=("matches", "matched_qty"), lots=("lots", "qty_rem"), rollup=("rollup", "net_qty"), rollup_changelog=("changes", "net_qty"),
        realized=("(SELECT account_id, strategy_id, symbol, sum(realized_pnl) AS realized_pnl FROM matches GROUP BY ALL)", "realized_pnl"),
    )),
    "agg_account_pnl": sql("matches", select="SELECT account_id, round(sum(realized_pnl), 2) AS total_realized_pnl, count(*) AS total_trades, round(avg(realized_pnl), 2) AS avg_pnl_per_trade, round(count(*) FILTER (realized_pnl > 0) * 100.0::DOUBLE / count(*), 2) AS win_rate, round(max(realized_pnl), 2) AS best_trade, round(min(realized_pnl), 2) AS worst_trade FROM matches GROUP BY 1"),
    "agg_recent_24h": sql("matches", select=f"SELECT account_id, round(sum(realized_pnl), 2) AS recent_realized_pnl, count(*) AS recent_trades, round(count(*) FILTER (realized_pnl > 0) * 100.0::DOUBLE / count(*), 2) AS recent_win_rate FROM matches WHERE match_ts > {(10957 - 30) * DAY} AND match_ts <= {10957 * DAY} GROUP BY 1"),
    "agg_symbol_pnl": sql("matches", select="SELECT symbol, round(sum(realized_pnl), 2) AS symbol_pnl, count(*) AS trade_count, round(avg(realized_pnl), 2) AS avg_pnl_per_trade, round(stddev_samp(realized_pnl), 2) AS pnl_volatility FROM matches GROUP BY 1"),
    "agg_daily_pnl": sql("matches", select="SELECT trade_date, round(daily, 2) AS daily_pnl, n AS daily_trades, round(sum(daily) OVER (ORDER BY trade_date), 2) AS cumulative_pnl FROM (SELECT epoch_ms(match_ts)::DATE AS trade_date, sum(realized_pnl) AS daily, count(*) AS n FROM matches GROUP BY 1)"),
    "agg_monthly": sql("matches", select="SELECT year(epoch_ms(match_ts))::INTEGER AS year, month(epoch_ms(match_ts))::INTEGER AS month, round(sum(realized_pnl), 2) AS monthly_pnl, count(*) AS monthly_trades, count(DISTINCT symbol) AS symbols_traded FROM matches GROUP BY 1, 2"),
    "agg_heatmap": sql("matches", select="SELECT (dayofweek(epoch_ms(match_ts)) + 1)::INTEGER AS day_of_week, hour(epoch_ms(match_ts))::INTEGER AS hour_of_day, count(*) AS trade_count, round(avg(realized_pnl), 2) AS avg_pnl FROM matches GROUP BY 1, 2"),
    "agg_signal_counts": sql("signals", select="SELECT signal, count(*) AS n FROM signals GROUP BY 1"),
    "agg_conditional": sql("bars", select="SELECT symbol, max(CASE WHEN close > open THEN close END) AS top_up, max(CASE WHEN close <= open THEN close END) AS top_down FROM bars GROUP BY 1"),
    "win_rows": sql("smas", select="SELECT symbol, ts, round(sma20, 4) AS mean20 FROM smas"),
    "win_lag": sql("bars", select=f"SELECT symbol, ts, lag(close) OVER w AS previous_close FROM bars {W}"),
    "win_cum": sql("bars", select=f"SELECT symbol, ts, sum(volume) OVER w AS volume_so_far FROM bars {W}"),
    "tw_tumbling": sql("ticks", select=f"SELECT symbol, (ts // {DAY}) * {DAY} AS start_ms, count(*) AS n, max(price) AS top FROM ticks GROUP BY 1, 2"),
    "tw_sliding": sql("ticks", select=f"SELECT symbol, s AS window_start_ts, count(*) AS n, max(price) AS top FROM (SELECT symbol, price, unnest([(ts // {DAY // 4} - k) * {DAY // 4} FOR k IN [0, 1, 2, 3]]) AS s FROM ticks) GROUP BY ALL"),
    "sort_top_n": sql("matches", select="SELECT account_id, symbol, matched_qty, round(realized_pnl, 2) AS realized_pnl, match_ts FROM (SELECT * FROM matches ORDER BY match_ts DESC, match_seq DESC, account_id, symbol, matched_qty DESC, realized_pnl, buy_order_id, sell_order_id LIMIT 10)"),
    "sort_view": sql("tall", select="SELECT symbol, indicator_name, arg_max(value, ts) AS value, max(ts) AS ts FROM tall GROUP BY ALL ORDER BY symbol, indicator_name"),
    "set_union_all": "SELECT 'events' AS table_name, count(*) AS n FROM events UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'supplier', count(*) FROM supplier",
}

ema = lambda p: f"CASE WHEN e.ema{p} = 0 THEN b.close ELSE e.ema{p} + (b.close - e.ema{p}) * 2 / {p + 1} END"
_EMA = sql("inds", select="").removesuffix(" ") + f", e AS (SELECT symbol, ts, n, close AS ema5, close AS ema14, close AS ema21 FROM inds WHERE n = 1 UNION ALL SELECT b.symbol, b.ts, b.n, {ema(5)}, {ema(14)}, {ema(21)} FROM e JOIN inds b ON b.symbol = e.symbol AND b.n = e.n + 1) "
ORACLES["ind_ema"] = _EMA + "SELECT symbol, ts, round(ema5, 4) AS ema5, round(ema14, 4) AS ema14, round(ema21, 4) AS ema21 FROM e"
ORACLES["ind_multi"] = _EMA + "SELECT symbol, ts, round(sma5, 4) AS sma5, round(sma14, 4) AS sma14, round(sma21, 4) AS sma21, round(ema5, 4) AS ema5, round(ema14, 4) AS ema14, round(ema21, 4) AS ema21, round(rsi, 4) AS rsi14 FROM inds JOIN e USING (symbol, ts)"

_PICK = sql("inds", select="").removesuffix(" ") + (
    f", sg AS (SELECT row_number() OVER () AS id, 'simple-cross' AS run_id, 'P' || ((ts // {BAR_MS}) % 12) AS symbol, ts - {23 * 365 * DAY} AS ts, CASE WHEN sma5 > sma21 THEN 'BUY' ELSE 'SELL' END AS signal FROM inds WHERE sma5 <> sma21), "
    f"rule AS (SELECT 'R' || n AS account_id, 4 + (n + 3 * v) % 8 AS room, (n + v) % 5 <> 0 AS active, [0, 11330, 11340][v + 1]::BIGINT * {DAY} AS rts FROM (SELECT DISTINCT s_suppkey % 50 AS n FROM supplier), range(3) t(v)), "
    "report AS (SELECT 'R' || (l_suppkey % 50) AS account_id, 'P' || (l_partkey % 12) AS symbol, (l_orderkey + l_partkey) % 3 <> 0 AS is_open, epoch_ms(l_shipdate) AS ts, row_number() OVER (PARTITION BY l_suppkey % 50 ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) AS seq FROM lineitem), "
    "st AS (SELECT *, sum(is_open::INT - was::INT) OVER (PARTITION BY account_id ORDER BY seq) AS n_open FROM (SELECT *, coalesce(lag(is_open) OVER (PARTITION BY account_id, symbol ORDER BY seq), false) AS was FROM report)), "
    "st1 AS (SELECT account_id, ts, arg_max(n_open, seq) AS n_open FROM st GROUP BY ALL), st2 AS (SELECT account_id, symbol, ts, arg_max(is_open, seq) AS is_open FROM st GROUP BY ALL), "
    "ex AS (SELECT sg.*, a.account_id FROM sg, (SELECT account_id FROM rule UNION SELECT account_id FROM report) a), "
    "c0 AS (SELECT ex.*, rule.room, rule.active FROM ex ASOF LEFT JOIN rule ON ex.account_id = rule.account_id AND ex.ts >= rule.rts), "
    "c1 AS (SELECT c0.*, st1.n_open FROM c0 ASOF LEFT JOIN st1 ON c0.account_id = st1.account_id AND c0.ts >= st1.ts), "
    "h AS (SELECT c1.*, coalesce(st2.is_open, false) AS holds FROM c1 ASOF LEFT JOIN st2 ON c1.account_id = st2.account_id AND c1.symbol = st2.symbol AND c1.ts >= st2.ts), "
    "ok AS (SELECT * FROM h WHERE CASE WHEN room IS NULL THEN n_open IS NOT NULL ELSE active AND coalesce(n_open, 0) < room END), "
)
_PICKED = "SELECT run_id || '-' || ts AS signal_id, account_id, run_id AS strategy_id, symbol, signal AS action, {}::DOUBLE AS qty, ts FROM pk"
_FIRST = "pk AS (SELECT * FROM ok WHERE {} QUALIFY row_number() OVER (PARTITION BY id ORDER BY holds, coalesce(n_open, 0), account_id) = 1) "
ORACLES["rt_trade_picker"] = _PICK + _FIRST.format("true") + _PICKED.format("1.0")
ORACLES["jn_broadcast_control"] = _PICK + _FIRST.format("NOT holds") + _PICKED.format("2.0")
