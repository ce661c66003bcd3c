"""Keys of any size: small chunks give what one chunk gives and what sequential models give; unrealized profits as a changelog, batch and stream."""

from __future__ import annotations

import collections
import random

import pytest
from pyspark.sql import functions as F

from marketloom.operators import accounting as acc
from marketloom.operators import indicators as ind
from marketloom.operators import prefix
from marketloom.streaming.engine import apply_fill

FILLS = "account_id string, strategy_id string, symbol string, order_id string, fill_id string, side string, qty double, price double, ts long, seq long"


def fills(spark, n=240, seed=4, sizes=(0.1, 0.2, 0.3, 1.0, 50.0)):
    """A hot key with a third of all fills and more, a null account, and quantities of very unlike size that meet exactly in decimals."""
    rng, seqs, rows = random.Random(seed), collections.Counter(), []
    for k in range(n):
        key = rng.choice([("HOT", "s", "X"), ("HOT", "s", "X"), ("A", "s", "X"), ("A", "t", "Y"), (None, "s", "Y")])
        seqs[key] += 1
        rows.append((*key, f"o{k}", "f", rng.choice(("BUY", "SELL")), rng.choice(sizes), float(rng.randint(90, 110)), k // 3, seqs[key]))
    return spark.createDataFrame(rows, FILLS).repartition(5)


def v1(df):
    return df.select("account_id", "symbol", "order_id", F.when(F.col("side") == "BUY", F.col("qty")).otherwise(-F.col("qty")).alias("fill_qty"), F.col("price").alias("fill_price"), F.lit("FILLED").alias("status"), "ts", F.col("ts").alias("seq"))


def rows_of(df, digits=9):
    return sorted((tuple(round(x, digits) + 0.0 if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr)


@pytest.fixture(params=[1, 3, 25])
def chunk(request, monkeypatch):
    monkeypatch.setattr(prefix, "CHUNK", request.param)
    return request.param


def test_fifo_in_chunks_is_the_sequential_one(spark, chunk):
    d = fills(spark)
    by_key = collections.defaultdict(list)
    for r in d.collect():
        by_key[r.account_id, r.strategy_id, r.symbol].append(r)
    matches, open_lots, changes = [], [], []
    for key, own in by_key.items():
        lots = []
        for r in sorted(own, key=lambda r: r.seq):
            lots, events = apply_fill(lots, r.side, r.qty, r.price, r.seq)
            lots = [[a, b, round(q, 9), p] for a, b, q, p in lots if round(q, 9)]
            matches += [(*key, min(e[2], e[3]), max(e[2], e[3]), round(e[5], 9)) for e in events if e[0] == "match" and round(e[5], 9)]
            net = round(sum(x[2] if x[1] == "LONG" else -x[2] for x in lots), 9)
            cost = sum(x[2] * x[3] for x in lots)
            changes.append((*key, r.seq, net or None, round(cost / abs(net), 6) if net else None))
        open_lots += [(*key, x[0], x[1], x[2]) for x in lots]
    m = acc.fifo_two_sided(d)
    assert rows_of(m.select(*acc.KEY2, F.least("buy_seq", "sell_seq"), F.greatest("buy_seq", "sell_seq"), "matched_qty")) == sorted(matches, key=repr)
    assert rows_of(acc.lots_latest(d).select(*acc.KEY2, "lot_seq", "side", "qty_rem")) == sorted(open_lots, key=repr)
    assert rows_of(acc.positions_changelog(d, m).select(*acc.KEY2, "seq", "net_qty", F.round("avg_price", 6))) == sorted(changes, key=repr)


def test_long_only_average_cost_and_closes_in_chunks(spark, monkeypatch):
    d = v1(fills(spark)).groupBy("account_id", "symbol", "seq").agg(F.first("order_id").alias("order_id"), F.round(F.sum("fill_qty"), 9).alias("fill_qty"), F.max("fill_price").alias("fill_price"), F.first("status").alias("status"), F.max("ts").alias("ts")).where("fill_qty != 0")
    found = lambda: [rows_of(x) for x in (acc.fifo_long_only(d), acc.avg_cost_updates(d), acc.close_events(d), acc.rollup_changelog(fills(spark)), acc.realized_updates(acc.fifo_two_sided(fills(spark)), acc.KEY2))]
    whole = found()
    assert all(whole[:2])
    monkeypatch.setattr(prefix, "CHUNK", 4)
    assert found() == whole
    state, want = collections.defaultdict(lambda: (0.0, 0.0)), []
    for r in sorted(d.collect(), key=lambda r: r.seq):
        net, avg = state[r.account_id, r.symbol]
        after = round(net + r.fill_qty, 9)
        avg = r.fill_price if net == 0 or net * after < 0 else (net * avg + r.fill_qty * r.fill_price) / after if net * r.fill_qty > 0 else avg
        state[r.account_id, r.symbol] = after, avg
        want.append((r.account_id, r.symbol, r.seq, r.ts, after + 0.0, round(avg, 9)))
    assert whole[1] == sorted(want, key=repr)


def test_fractions_close_a_position(spark):
    d = spark.createDataFrame([("A", "X", "o", q, 10.0, "FILLED", k, k) for k, q in enumerate((0.1, 0.2, -0.3))], "account_id string, symbol string, order_id string, fill_qty double, fill_price double, status string, ts long, seq long")
    assert [r.seq for r in acc.close_events(d).collect()] == [2] and acc.avg_cost_latest(d).count() == 0
    assert [r.net_qty for r in acc.avg_cost_updates(d).orderBy("seq").collect()] == [0.1, 0.3, 0.0]


def test_exponential_means_in_chunks(spark):
    rng = random.Random(1)
    rows = [(s, k * 1000, c) for s in ("A", "B", None) for k, c in enumerate([0.0, 0.0] * (s == "B") + [round(rng.uniform(1, 9), 2) for _ in range(60)])]
    d = spark.createDataFrame(rows, "symbol string, ts long, close double")
    means, want = collections.defaultdict(float), []
    for s, t, c in sorted(rows, key=lambda r: r[1]):
        for p in (3, 9):
            e = means[s, p]
            means[s, p] = c if e == 0 else e + (c - e) * 2 / (p + 1)
        want.append((s, t, c, means[s, 3], means[s, 9]))
    for ms in (1000, 7000, ind.CHUNK_MS):
        got = sorted(map(tuple, ind.with_ema(d, 3, 9, chunk_ms=ms).collect()), key=lambda r: repr(r[:3]))
        assert len(got) == len(want)
        for a, b in zip(got, sorted(want, key=lambda r: repr(r[:3])), strict=True):
            assert a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-9 and abs(a[4] - b[4]) < 1e-9


def changes_and_prices(spark, n=200):
    d = fills(spark, n, 7, (0.1, 0.2, 0.3))
    changes = acc.positions_changelog(d, acc.fifo_two_sided(d)).where("account_id is not null")
    rng = random.Random(2)
    prices = spark.createDataFrame([(rng.choice("XYZ"), float(rng.randint(90, 110)), t, k) for k, t in enumerate(sorted(rng.randrange(5, n // 3) for _ in range(60)))], "symbol string, price double, ts long, seq long")
    return spark.createDataFrame(changes.collect(), changes.schema), prices


def model(changes, prices):
    events = sorted([(r.ts, 0, r.seq, r.account_id, r) for r in changes.collect()] + [(r.ts, 1, r.seq, "", r) for r in prices.collect()], key=lambda e: e[:4])
    last, held, out = {}, {}, []
    for _, kind, _, _, r in events:
        if kind:
            last[r.symbol] = r
            out += [("UPSERT", *k, "price", r.seq, r.price, p.net_qty, p.avg_price, (r.price - p.avg_price) * p.net_qty, max(r.ts, p.ts)) for k, p in held.items() if k[2] == r.symbol]
            continue
        key = (r.account_id, r.strategy_id, r.symbol)
        if r.op == "DELETE":
            held.pop(key, None)
            out.append(("DELETE", *key, "position", r.seq, None, None, None, None, r.ts))
            continue
        held[key] = r
        if t := last.get(r.symbol):
            out.append(("UPSERT", *key, "position", r.seq, t.price, r.net_qty, r.avg_price, (t.price - r.avg_price) * r.net_qty, max(t.ts, r.ts)))
    return sorted((tuple(round(x, 6) + 0.0 if isinstance(x, float) else x for x in r) for r in out), key=repr)


def test_unrealized_changelog_against_a_sequential_model(spark, monkeypatch):
    changes, prices = changes_and_prices(spark)
    want = model(changes, prices)
    assert {r[0] for r in want} == {"UPSERT", "DELETE"} and {r[4] for r in want} == {"position", "price"}
    assert rows_of(acc.unrealized_changelog(changes, prices), 6) == want
    monkeypatch.setattr(prefix, "CHUNK", 5)
    monkeypatch.setattr(acc, "STEP", 3)
    assert rows_of(acc.unrealized_changelog(changes, prices, chunk_ms=4), 6) == want
    assert acc.unrealized_changelog(changes.limit(0), prices).count() == 0
    assert {r.op for r in acc.unrealized_changelog(changes, prices.limit(0)).collect()} == {"DELETE"}


def test_unrealized_stream_agrees_with_batch_over_a_restart(spark, tmp_path):
    changes, prices = changes_and_prices(spark)
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    for low, high in ((-1, 20), (20, 45), (45, 1000)):
        each = []
        for name, d in (("changes", changes), ("prices", prices)):
            d.where((F.col("ts") > low) & (F.col("ts") <= high)).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
            each.append(spark.readStream.schema(d.schema).parquet(str(tmp_path / name)))
        q = acc.unrealized_stream(*each, shares=3).writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(180)
        assert q.exception() is None
    assert rows_of(spark.read.parquet(out), 6) == model(changes, prices)


def test_running_values_deal_rows_once_and_join_nothing(spark):
    d = prefix.running(fills(spark), acc.KEY2, prefix.by_seq(), ["seq"], {"net": F.col("qty")}, {"net": "all"})
    assert "Join" not in d._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in acc.fifo_two_sided(fills(spark))._jdf.queryExecution().optimizedPlan().toString()


def test_dedupe_sorts_fills_once_and_after_their_shuffle(spark):
    twice = fills(spark).unionByName(fills(spark).withColumn("seq", F.col("seq") + 1000))
    assert rows_of(acc.dedupe_fills(twice)) == rows_of(fills(spark))
    assert "WindowGroupLimit" not in acc.dedupe_fills(twice)._jdf.queryExecution().executedPlan().toString()


def test_sweeps_aggregate_only_the_ends_of_cells(spark):
    """What goes to other cells comes of rows next to a carried one (lag and lead), and a chunk's start needs no sort of its own."""
    plan = acc.fifo_two_sided(fills(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert "lag(_own" in plan and "lead(_own" in plan and "max(start" not in plan


def test_unrealized_updates_in_chunks(spark, monkeypatch):
    d = v1(fills(spark).where("account_id is not null")).withColumn("seq", F.col("seq") * 3)
    d = d.dropDuplicates(["account_id", "symbol", "seq"])
    prices = d.select("account_id", "symbol", F.col("fill_price").alias("price"), "ts", (F.col("seq") + F.col("seq") % 2).alias("seq"))
    positions = acc.avg_cost_updates(d).where("seq % 4 = 0")
    state, want = collections.defaultdict(lambda: [None, None]), []
    events = [(r.account_id, r.symbol, r.seq, "position", (r.net_qty, r.avg_price, r.ts)) for r in positions.collect()] + [(r.account_id, r.symbol, r.seq, "price", (r.price, r.ts)) for r in prices.collect()]
    for account, symbol, seq, side, x in sorted(events):
        now = state[account, symbol]
        now[side == "price"] = x
        if None not in now:
            (net, avg, at), (price, told) = now
            want.append((account, symbol, seq, side, price, net, round(avg, 6), round((price - avg) * net, 6) + 0.0, max(at, told)))
    found = lambda: rows_of(acc.unrealized_updates(positions, prices), 6)
    for size in (10_000, 4):
        monkeypatch.setattr(prefix, "CHUNK", size)
        assert [tuple(map(str, r)) for r in found()] == [tuple(map(str, r)) for r in sorted(want, key=repr)]
    assert "_chunk" in acc.unrealized_updates(positions, prices)._jdf.queryExecution().optimizedPlan().toString().split("Union")[0]


def test_positions_come_of_running_quantities_alone(spark, chunk):
    """Costs without matches are those with them, also over chunks that lack a side, and with fills of no quantity."""
    d = fills(spark)
    more = [("LONE", "s", "X", f"p{k}", "f", "SELL" if k in (14, 15, 40) else "BUY", (0.0, 3.0, 40.0)[k % 3], 90.0 + k, k, k + 1) for k in range(41)]
    d = d.unionByName(spark.createDataFrame(more, FILLS))
    found = acc.positions_changelog(d)
    assert rows_of(found, 6) == rows_of(acc.positions_changelog(d, acc.fifo_two_sided(d.where("qty > 0"))), 6)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_changes_of_unrealized_profits_are_not_sorted_by_symbol(spark):
    """Prices are looked up once for each time of a symbol, which may be stored; windows over changes themselves are gone."""
    changes, prices = changes_and_prices(spark)
    kept = []
    found = acc.unrealized_changelog(changes, prices, keep=lambda df, name: kept.append(name) or spark.createDataFrame(df.collect(), df.schema))
    assert rows_of(found, 6) == model(changes, prices) and kept == ["times"]
    plan = found.where("cause = 'position'")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
