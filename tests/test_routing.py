"""The router against a sequential model: random controls, equal signals, many accounts, and as a stream over a restart."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from marketloom.operators import routing

SIGNALS = "run_id string, symbol string, ts long, signal string"
POLICIES = "account_id string, max_open_symbols int, status string, ts long"
DELTAS = "op string, account_id string, symbol string, net_qty double, ts long, seq long"


def tables(spark, seed=1, n=600):
    rng = random.Random(seed)
    symbols, accounts = [f"S{i}" for i in range(5)], [f"A{i}" for i in range(12)]
    signals = [("R", rng.choice(symbols), rng.randrange(100), rng.choice(("BUY", "SELL"))) for _ in range(n)]
    signals += signals[:40]
    policies = [(a, rng.choice((0, 1, 2, 3, 9, None)), rng.choice(("ACTIVE", "active", "BLOCKED", None)), t) for a in accounts[:9] for t in sorted(rng.sample(range(100), 4))]
    deltas = []
    for k in range(n):
        op = rng.choice(("UPSERT", "UPSERT", "DELETE"))
        deltas.append((op, rng.choice(accounts), rng.choice(symbols), rng.choice((1.0, -2.0, 0.0, None)) if op == "UPSERT" else None, k // 6, k))
    return spark.createDataFrame(signals, SIGNALS), spark.createDataFrame(policies, POLICIES), spark.createDataFrame(deltas, DELTAS)


def model(signals, policies, deltas, scale_in):
    """Every signal looks at every account."""
    events = [(r.ts, 0, 0, r) for r in policies.collect()] + [(r.ts, 1, r.seq, r) for r in deltas.collect()] + [(r.ts, 2, 0, r) for r in signals.collect()]
    rule, held, out = {}, {}, []
    for _, kind, _, r in sorted(events, key=lambda e: e[:3]):
        if kind == 0:
            rule[r.account_id] = (r.max_open_symbols or 0, (r.status or "").upper() == "ACTIVE")
        elif kind == 1:
            rule.setdefault(r.account_id, (2**30, True))
            held.setdefault(r.account_id, set())
            (held[r.account_id].add if r.op == "UPSERT" and abs(r.net_qty or 0) > 1e-12 else held[r.account_id].discard)(r.symbol)
        else:
            room = [(r.symbol in held.get(a, ()), len(held.get(a, ())), a) for a, (limit, active) in rule.items() if active and len(held.get(a, ())) < limit]
            room = [x for x in room if scale_in or not x[0]]
            if room:
                out.append((f"{r.run_id}-{r.ts}", min(room)[2], r.symbol, r.signal, r.ts))
    return sorted(out)


def picked(df):
    return sorted((r.signal_id, r.account_id, r.symbol, r.action, r.ts) for r in df.collect())


def test_router_against_a_sequential_model(spark):
    for seed in (1, 2):
        t = tables(spark, seed)
        for scale_in in (True, False):
            want = model(*t, scale_in)
            assert len(want) > 100
            for shards in (1, 5):
                assert picked(routing.trade_picker(*t, scale_in=scale_in, shards=shards)) == want


def test_router_without_signals_or_accounts(spark):
    signals, policies, deltas = tables(spark, n=20)
    assert routing.trade_picker(signals.limit(0), policies, deltas).count() == 0
    assert routing.trade_picker(signals, policies.limit(0), deltas.limit(0)).count() == 0
    nobody = spark.createDataFrame([(None, 3, "ACTIVE", 0)], POLICIES)
    assert routing.trade_picker(signals, nobody, deltas.limit(0)).count() == 0


def test_router_with_a_million_accounts(spark):
    n = 1_000_000
    number = F.concat(F.lit("A"), F.lpad(F.col("id").cast("string"), 7, "0"))
    policies = spark.range(n).select(number.alias("account_id"), F.lit(2).alias("max_open_symbols"), F.lit("ACTIVE").alias("status"), F.lit(0).cast("long").alias("ts"))
    deltas = spark.range(n - 1).select(F.lit("UPSERT").alias("op"), number.alias("account_id"), F.lit("S1").alias("symbol"), F.lit(1.0).alias("net_qty"), F.lit(10).cast("long").alias("ts"), F.col("id").alias("seq"))
    signals = spark.createDataFrame([("R", "S1", 5, "BUY"), ("R", "S1", 20, "BUY"), ("R", "S2", 20, "SELL"), ("R", "S1", 20, "BUY")], SIGNALS)
    got = picked(routing.trade_picker(signals, policies, deltas, shards=routing.shards_for(n)))
    last = f"A{n - 1:07d}"
    assert got == [("R-20", last, "S1", "BUY", 20), ("R-20", last, "S1", "BUY", 20), ("R-20", last, "S2", "SELL", 20), ("R-5", "A0000000", "S1", "BUY", 5)]


def test_index_chooses_among_holders():
    index = routing.AccountIndex()
    for a in "abcd":
        index.policy(a, 2, True)
        index.position(a, "X", True)
    assert index.choose("X", False) is None and index.choose("X", True) == (True, 1, "a") and index.choose("Y", False) == (False, 1, "a")
    index.position("c", "X", False)
    index.position("c", "Y", True)
    assert index.choose("X", False) == (False, 1, "c") and index.choose("Y", False) == (False, 1, "a")
    index.policy("c", 1, True)
    assert index.choose("X", False) is None
    again = routing.AccountIndex.load(index.dump())
    assert again.choose("X", True) == index.choose("X", True) and again.free == index.free and again.holders == index.holders


def test_router_as_a_stream_over_a_restart(spark, tmp_path):
    t = tables(spark, 3, 300)
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    for low, high in ((-1, 30), (30, 60), (60, 1000)):
        each = []
        for name, d in zip(("signals", "policies", "deltas"), t, strict=True):
            d.where((F.col("ts") > low) & (F.col("ts") <= high)).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
            each.append(spark.readStream.schema(d.schema).parquet(str(tmp_path / name)))
        q = routing.trade_picker(*each, shards=3).writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(180)
        assert q.exception() is None
    assert picked(spark.read.parquet(out)) == model(*t, True)


def test_account_states_in_chunks_of_time(spark):
    rng, open_, want, rows = random.Random(5), set(), [], []
    for k in range(120):
        account, symbol, is_open = rng.choice("AB"), rng.choice("XYZ"), rng.random() < 0.6
        rows.append(("UPSERT" if is_open else "DELETE", account, symbol, 1.0 if is_open else None, k // 2, k))
        (open_.add if is_open else open_.discard)((account, symbol))
        want.append((account, k // 2, k, symbol, is_open, sum(a == account for a, _ in open_)))
    d = spark.createDataFrame(rows, "op string, account_id string, symbol string, net_qty double, ts long, seq long")
    for ms in (1, 7, 86_400_000):
        assert sorted(map(tuple, routing.account_states(d, chunk_ms=ms).collect())) == sorted(want)
