"""Streams agree with batch on the same rows, over several triggers and a restart, with duplicates and late rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from marketloom.operators import accounting as acc
from marketloom.operators import indicators as ind
from marketloom.operators import routing, strategies, trend
from marketloom.sources import adapters as ad
from marketloom.streaming import engine, joins, sinks, trends


def run(stream, path, checkpoint, mode="append"):
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None


def test_engine_agrees_with_batch_over_a_restart(spark, sf, tmp_path):
    fills = ad.fills(spark, sf).where("symbol = 'P1' and account_id = 'A1'")
    source, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    rows, cut = fills.orderBy("seq"), int(fills.approxQuantile("seq", [0.3], 0)[0])
    rows.where(f"seq <= {cut}").coalesce(1).write.mode("append").parquet(source)

    def stream():
        changes = engine.engine(spark.readStream.schema(fills.schema).option("maxFilesPerTrigger", 1).parquet(source))
        q = changes.writeStream.foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{out}/b={i}")).option("checkpointLocation", cp).outputMode("update").trigger(availableNow=True).start()
        q.awaitTermination(240)
        assert q.exception() is None

    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    stream()
    rows.where(f"seq > {cut}").coalesce(1).write.mode("append").parquet(source)
    rows.limit(6).coalesce(1).write.mode("append").parquet(source)  # again: known fills
    stream()
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    got = spark.read.parquet(out)
    unique = acc.dedupe_fills(fills)
    batch = acc.fifo_two_sided(unique)
    want = sorted((r.strategy_id, min(r.buy_seq, r.sell_seq), max(r.buy_seq, r.sell_seq), r.matched_qty, round(r.realized_pnl, 4)) for r in batch.collect())
    have = sorted((r.strategy_id, r.lot_seq, r.other_seq, r.qty, round(r.pnl, 4)) for r in got.where("kind = 'match'").collect())
    assert have == want
    lots = {(r.strategy_id, r.lot_seq): r.qty_rem for r in acc.lots_latest(unique).collect()}
    last = {}
    for r in got.where("kind = 'lot'").orderBy("seq", "other_seq").collect():
        last[r.strategy_id, r.lot_seq] = r.qty
    assert {k: v for k, v in last.items() if v is not None} == lots


def test_interval_join_and_dedupe(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    at = lambda ms: t0 + dt.timedelta(milliseconds=ms)
    left = spark.createDataFrame([("A", at(0), 1.0), ("A", at(2000), 2.0), ("B", at(0), 3.0)], "symbol string, time timestamp, sma5 double")
    right = spark.createDataFrame([("A", at(500), 10.0), ("A", at(501), 11.0), ("A", at(1600), 12.0), ("B", at(9000), 13.0)], "symbol string, time timestamp, close double")
    for name, d in (("l", left), ("r", right)):
        d.write.parquet(str(tmp_path / name))
    read = lambda n, d: spark.readStream.schema(d.schema).parquet(str(tmp_path / n))
    run(joins.interval_join(read("l", left), read("r", right)), str(tmp_path / "j"), str(tmp_path / "jc"))
    assert sorted((r.symbol, r.sma5, r.close) for r in spark.read.parquet(str(tmp_path / "j")).collect()) == [("A", 1.0, 10.0), ("A", 2.0, 12.0)]
    fills = spark.createDataFrame([("a", "s", "x", "o", str(k % 3), at(k)) for k in range(9)], "account_id string, strategy_id string, symbol string, order_id string, fill_id string, time timestamp")
    fills.write.parquet(str(tmp_path / "f"))
    run(joins.dedupe_fills(read("f", fills)), str(tmp_path / "d"), str(tmp_path / "dc"))
    assert spark.read.parquet(str(tmp_path / "d")).count() == 3


def test_candles_drop_late_ticks(spark, sf, tmp_path):
    ticks = ad.ticks(spark, sf).select("symbol", F.timestamp_micros("us").alias("time"), "seq", "price")
    ticks.orderBy("time").coalesce(1).write.parquet(str(tmp_path / "t"))
    run(joins.candles(spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "t"))), str(tmp_path / "c"), str(tmp_path / "cc"))
    got = {(r.symbol, r.ts): (r.open, r.high, r.low, r.close, r.volume) for r in spark.read.parquet(str(tmp_path / "c")).collect()}
    want = {(r.symbol, r.ts): (r.open, r.high, r.low, r.close, r.volume) for r in ad.bars(spark, sf).collect()}
    newest = max(t for _, t in want)
    assert {k: v for k, v in want.items() if k[1] < newest} == {k: v for k, v in got.items() if k[1] < newest} and got


def test_upsert_sink_repeats_a_batch_and_rewrites_touched_buckets(spark, tmp_path):
    path, schema = str(tmp_path / "u"), "op string, k string, v double, seq long"
    rows = lambda *x: spark.createDataFrame(list(x), schema)
    write = sinks.upsert_sink(path, ["k"], ["seq"], buckets=8)
    names = [f"k{i}" for i in range(40)]
    write(rows(*[("UPSERT", k, 1.0, i) for i, k in enumerate(names)]), 0)
    for _ in range(2):
        write(rows(("DELETE", "k0", None, 50), ("UPSERT", "k1", 5.0, 51)), 1)
    write(rows(), 2)
    assert len(list((tmp_path / "u" / "version=0").glob("bucket=*"))) == 8
    assert 1 <= len(list((tmp_path / "u" / "version=1").glob("bucket=*"))) <= 2
    get = lambda i: {r.k: r.v for r in sinks.read_latest(spark, path, i, ["k"], ["seq"], schema).collect()}
    want = {k: 1.0 for k in names[1:]} | {"k1": 5.0}
    assert get(1) == get(2) == want and get(0) == dict.fromkeys(names, 1.0)
    assert sinks.vacuum(spark, path, 2) in (1, 2) and get(2) == want


def parts(frame, root, name, cuts):
    """Writes the rows up to each cut of ts as one file, the files' times in that order; returns a function that reads them as a stream, a file a trigger."""
    at, low = str(root / name), None
    for cut in cuts:
        d = frame.where(F.col("ts") <= cut)
        (d if low is None else d.where(F.col("ts") > low)).coalesce(1).write.mode("append").parquet(at)
        low = cut
    return lambda: frame.sparkSession.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(at)


def same(got, want, digits=9):
    flat = lambda d: sorted(tuple(round(x, digits) if isinstance(x, float) else x for x in r) for r in d.collect())
    a, b = flat(got.select(*want.columns)), flat(want)
    assert len(a) == len(b) > 0
    assert [(x, y) for x, y in zip(a, b, strict=True) if x != y] == []


def test_indicators_and_patterns_agree_with_batch(spark, sf, tmp_path):
    bars = ad.bars(spark, sf).select("symbol", "ts", "close")
    cut = bars.approxQuantile("ts", [0.4, 0.7], 0)
    stream = parts(bars, tmp_path, "bars", [*cut, 2**60])
    run(ind.multi(stream()), str(tmp_path / "m"), str(tmp_path / "mc"))
    made = spark.read.parquet(str(tmp_path / "m"))
    same(made, ind.multi(bars))
    rows = made.select("symbol", "ts", "close", "sma5", "sma21", F.col("rsi14").alias("rsi"))
    again = parts(rows, tmp_path, "rows", [*cut, 2**60])
    wide = 10**12
    rules = {
        "cross": lambda d: strategies.cep_cross(d, wide),
        "state": strategies.state_cross,
        "gate": strategies.state_gate,
        "buy": lambda d: strategies.signals(strategies.nfa(d, ["close > sma5", "sma5 <= sma21", "sma5 > sma21"], wide, "rsi"), F.lit("BUY"), F.col("first_value"), "three"),
        "seven": lambda d: strategies.seven_green(d, wide),
        "calm": lambda d: strategies.cooldown(strategies.simple_cross(d), 3 * 21_600_000),
    }
    for name, rule in rules.items():
        run(rule(again()), str(tmp_path / name), str(tmp_path / f"{name}c"))
        want = rule(rows)
        got = spark.read.schema(want.schema).parquet(str(tmp_path / name))
        if name == "seven":
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        else:
            same(got, want)


def test_admission_agrees_with_batch_over_a_restart(spark, tmp_path):
    orders = spark.createDataFrame([("A", f"S{k % 5}", float(1 + k % 3), 10.0, k * 10, k) for k in range(40)], "account_id string, symbol string, qty double, price double, ts long, seq long")
    policies = spark.createDataFrame([("A", 2, "ACTIVE", 0), ("A", 4, "ACTIVE", 155), ("A", 4, "BLOCKED", 333)], "account_id string, max_open_symbols int, status string, ts long")
    positions = spark.createDataFrame([("A", "S0", 0.0, 85, 1), ("A", "S1", 0.0, 205, 2)], "account_id string, symbol string, net_qty double, ts long, seq long")
    out, cp = str(tmp_path / "o"), str(tmp_path / "c")
    for low, high in ((-1, 160), (160, 400)):
        each = []
        for name, d in (("orders", orders), ("policies", policies), ("positions", positions)):
            d.where((F.col("ts") > low) & (F.col("ts") <= high)).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
            each.append(spark.readStream.schema(d.schema).parquet(str(tmp_path / name)))
        run(routing.admission(*each), out, cp)
    want = routing.admission(orders, policies, positions)
    same(spark.read.parquet(out), want)
    assert want.count() < 40


def test_trend_summary_by_timers_agrees_with_batch(spark, tmp_path):
    hour = 3_600_000
    rows = [(s, k * hour, 0.5 if k % 3 else -0.2, 0.1 + 0.1 * (k % 7), 0.2 + 0.1 * (j + k % 4), k % 2, 0.3 * j, (k - j) * hour if k % 2 else -1) for s in ("A", "B") for k in range(1, 15) for j in range(3)]
    lines = spark.createDataFrame(rows, "symbol string, window_end_ts long, slope double, slope_norm double, score double, breakouts int, breakout_strength double, last_breakout_ts long").withColumn("ts", F.col("window_end_ts"))
    out, cp = str(tmp_path / "o"), str(tmp_path / "c")
    source = str(tmp_path / "in")
    stream = lambda: spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).parquet(source)
    lines.where(F.col("ts") <= 8 * hour).coalesce(1).write.mode("append").parquet(source)
    run(trends.trend_summary(stream(), delay_ms=500), out, cp)
    assert spark.read.parquet(out).agg(F.max("ts")).first()[0] == 7 * hour  # the eighth window's timer waits for the watermark
    late = lines.where(F.col("ts") == 3 * hour)
    lines.where(F.col("ts") > 8 * hour).unionByName(late).coalesce(1).write.mode("append").parquet(source)
    run(trends.trend_summary(stream(), delay_ms=500), out, cp)
    want = trend.trend_summary(lines.where(F.col("ts") < 14 * hour), now_offset_ms=500)
    same(spark.read.parquet(out), want)


def test_average_cost_agrees_with_batch(spark, tmp_path):
    fills = spark.createDataFrame([("A", f"S{k % 2}", (-1.0) ** (k // 3) * (1 + k % 4), 10.0 + k, "FILLED" if k % 7 else "NEW", k, k) for k in range(40)], "account_id string, symbol string, fill_qty double, fill_price double, status string, ts long, seq long")
    stream = parts(fills, tmp_path, "fills", [11, 25, 99])
    run(acc.avg_cost_updates(stream()), str(tmp_path / "o"), str(tmp_path / "c"))
    same(spark.read.parquet(str(tmp_path / "o")), acc.avg_cost_updates(fills))


def test_change_feed_rebuilds_the_latest_table(spark, tmp_path):
    path, schema = str(tmp_path / "u"), "op string, k string, v double, seq long"
    rows = lambda *x: spark.createDataFrame(list(x), schema)
    write = sinks.upsert_sink(path, ["k"], ["seq"], buckets=8)
    assert sinks.last_version(spark, path) == -1
    write(rows(*[("UPSERT", f"k{i}", 1.0, i) for i in range(40)], ("UPSERT", None, 7.0, 40)), 0)
    write(rows(("DELETE", "k0", None, 50), ("UPSERT", "k1", 5.0, 51), ("UPSERT", "new", 6.0, 52), ("DELETE", "never", None, 53)), 1)
    write(rows(("UPSERT", None, 8.0, 60), ("UPSERT", "k0", 9.0, 61), ("DELETE", "new", None, 62)), 2)
    assert sinks.last_version(spark, path) == 2
    feed = lambda a, b: sorted(((r.row_kind, r.k, r.v) for r in sinks.change_feed(spark, path, a, b, ["k"], ["seq"], schema).collect()), key=repr)
    assert feed(0, 1) == [("+I", "new", 6.0), ("+U", "k1", 5.0), ("-D", "k0", 1.0)]
    assert feed(1, 2) == [("+I", "k0", 9.0), ("+U", None, 8.0), ("-D", "new", 6.0)]
    assert feed(2, 2) == [] and len(feed(-1, 0)) == 41
    table = {k: v for _, k, v in feed(-1, 0)}
    for a, b in ((0, 1), (1, 2)):
        for kind, k, v in feed(a, b):
            if kind == "-D":
                del table[k]
            else:
                table[k] = v
    assert table == {r.k: r.v for r in sinks.read_latest(spark, path, 2, ["k"], ["seq"], schema).collect()}


def test_lookup_meets_the_version_of_its_time_also_when_repeated(spark, tmp_path):
    path, log, out = (str(tmp_path / x) for x in ("t", "log", "out"))
    schema = "op string, account_id string, status string, seq long"
    table = sinks.upsert_sink(path, ["account_id"], ["seq"], buckets=4)
    run = sinks.lookup(path, ["account_id"], ["seq"], schema, ["status"], lambda b, i: b.write.mode("overwrite").parquet(f"{out}/b={i}"), log)
    orders = lambda *ids: spark.createDataFrame([(i, a) for i, a in enumerate(ids)], "n int, account_id string")
    seen = lambda i: sorted((r.n, r.account_id, r.status) for r in spark.read.parquet(f"{out}/b={i}").collect())
    run(orders("A"), 0)
    table(spark.createDataFrame([("UPSERT", "A", "ACTIVE", 1), ("UPSERT", "B", "ACTIVE", 2)], schema), 0)
    run(orders("A", "B", "C"), 1)
    table(spark.createDataFrame([("UPSERT", "A", "BLOCKED", 3), ("DELETE", "B", None, 4)], schema), 1)
    run(orders("A", "B", "C"), 1)
    run(orders("A", "B"), 2)
    assert seen(0) == [(0, "A", None)]
    assert seen(1) == [(0, "A", "ACTIVE"), (1, "B", "ACTIVE"), (2, "C", None)]
    assert seen(2) == [(0, "A", "BLOCKED"), (1, "B", None)]


def test_trading_engine_job_writes_each_output_once(spark, sf, tmp_path):
    from marketloom.streaming import jobs

    fills = ad.fills(spark, sf).where("symbol = 'P2' and account_id in ('A1', 'A2')")
    source, root, batch_root = (str(tmp_path / x) for x in ("in", "out", "batch"))
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    cut = int(fills.approxQuantile("seq", [0.4], 0)[0])
    for low, high in ((0, cut), (cut, 2**60)):
        fills.where((F.col("seq") > low) & (F.col("seq") <= high)).coalesce(1).write.mode("append").parquet(source)
        q = jobs.trading_engine(spark.readStream.schema(fills.schema).parquet(source), root, str(tmp_path / "cp"))
        q.awaitTermination(240)
        assert q.exception() is None
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    jobs.trading_engine(fills, batch_root, "")
    got = jobs.read_output(spark, root, "matches", engine.OUTPUT)
    again = jobs.side_outputs(root)
    key = lambda d, a, b: sorted((r.account_id, r.strategy_id, r[a], r[b], r.q) for r in d.collect())
    want = spark.read.parquet(f"{batch_root}/matches").select("account_id", "strategy_id", F.least("buy_seq", "sell_seq").alias("a"), F.greatest("buy_seq", "sell_seq").alias("b"), F.col("matched_qty").alias("q"))
    assert key(got.select("account_id", "strategy_id", F.col("lot_seq").alias("a"), F.col("other_seq").alias("b"), F.col("qty").alias("q")), "a", "b") == key(want, "a", "b")
    lots = jobs.read_output(spark, root, "lots_changelog", engine.OUTPUT).where("not (op = 'DELETE' and lot_seq = seq)")
    want = spark.read.parquet(f"{batch_root}/lots_changelog")
    assert sorted((r.account_id, r.strategy_id, r.lot_seq, r.seq, r.qty or 0) for r in lots.collect()) == sorted((r.account_id, r.strategy_id, r.lot_seq, r.change_seq, r.qty_rem or 0) for r in want.collect())
    rollups = jobs.read_output(spark, root, "rollup_changelog", engine.OUTPUT)
    want = spark.read.parquet(f"{batch_root}/rollup_changelog")
    assert sorted((r.account_id, r.strategy_id, r.seq, r.op, r.qty or 0) for r in rollups.collect()) == sorted((r.account_id, r.strategy_id, r.seq, r.op, r.net_qty or 0) for r in want.collect())
    n = rollups.count()
    first = spark.createDataFrame(spark.read.parquet(f"{root}/batch=1").drop("table").collect(), engine.OUTPUT)
    again(first, 1)
    assert jobs.read_output(spark, root, "rollup_changelog", engine.OUTPUT).count() == n


def test_trend_lines_and_swings_agree_with_batch_over_a_restart(spark, sf, tmp_path):
    bar, size, slide = ad.BAR_MS, 24 * ad.BAR_MS, 6 * ad.BAR_MS
    bars = ad.bars(spark, sf).select("symbol", "ts", "high", "low", "close")
    cut = [int(x) for x in bars.approxQuantile("ts", [0.4, 0.7], 0)]
    again = parts(bars, tmp_path, "bars", [*cut, 2**60])
    run(ind.swings(again()), str(tmp_path / "s"), str(tmp_path / "sc"))
    swings = ind.swings(bars)
    same(spark.read.parquet(str(tmp_path / "s")), swings)
    last = bars.agg(F.max("ts")).first()[0] - 60_000
    for name, delay, batch_swings in (("plain", 0, None), ("swings", 2 * bar, swings)):
        out, cp, source = (str(tmp_path / f"{name}-{x}") for x in ("o", "c", "in"))
        for low, high in ((-1, cut[0]), (cut[0], 2**60)):  # a restart between the two
            stream = []
            for k, d in enumerate(x for x in (bars, batch_swings) if x is not None):
                d.where((F.col("ts") > low) & (F.col("ts") <= high)).coalesce(1).write.mode("append").parquet(f"{source}{k}")
                if low > 0:
                    d.where(F.col("ts") == bars.agg(F.min("ts")).first()[0]).coalesce(1).write.mode("append").parquet(f"{source}{k}")  # long closed
                stream.append(spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(f"{source}{k}"))
            run(trend.hough_lines(stream[0], size, slide, *stream[1:], delay_ms=delay), out, cp)
        want = trend.hough_lines(bars, size, slide, batch_swings)
        slowest = last if batch_swings is None else min(last, swings.agg(F.max("ts")).first()[0] - 60_000)
        same(spark.read.parquet(out), want.where(F.col("window_end_ts") + delay <= slowest))


def test_a_silent_source_does_not_hold_the_windows_of_others(spark, tmp_path):
    schema = "name string, time timestamp, x double"
    for k in range(2):
        (tmp_path / f"in{k}").mkdir()
    begun = dt.datetime.now(dt.UTC).replace(tzinfo=None)
    spark.createDataFrame([("a", begun, 1.0), ("a", begun, 2.0)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in0"))

    def counts(idle: bool):
        sources = [spark.readStream.schema(schema).parquet(str(tmp_path / f"in{k}")) for k in range(2)]
        live = [joins.never_idle(d, "3 seconds") if idle else d.withWatermark("time", "0 seconds") for d in sources]
        made = live[0].unionByName(live[1]).groupBy(F.window("time", "1 second"), "name").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
        out = str(tmp_path / f"out{idle}")
        q = made.select("name", "x", "n").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / f"cp{idle}")).trigger(processingTime="1 second").start()
        try:
            for _ in range(60 if idle else 12):
                q.awaitTermination(1)
                if any((tmp_path / f"out{idle}").glob("part-*")) and (found := spark.read.schema("name string, x double, n long").parquet(out).collect()):
                    return [tuple(r) for r in found]
        finally:
            q.stop()
        return []

    assert counts(True) == [("a", 3.0, 2)]
    assert counts(False) == []
