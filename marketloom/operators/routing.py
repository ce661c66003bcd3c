"""Routing of signals to accounts and admission of orders under risk limits."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from marketloom.operators import prefix
from marketloom.operators.folds import in_order, taken
from marketloom.session import extended

DEFAULT_MAX_OPEN = 3
MAX_NOTIONAL = 1_000_000.0
#: Capacity of an account whose positions come before its policy.
UNBOUNDED = 2**30


def signal_to_trade(signals: DataFrame, account: str = "run_id") -> DataFrame:
    """Signed unit orders: BUY 1, SELL -1, anything else 0, at the close."""
    side = F.upper("signal")
    return signals.select(F.col(account).alias("account_id"), "symbol", F.when(side == "BUY", 1.0).when(side == "SELL", -1.0).otherwise(0.0).alias("qty"), F.col("close").alias("price"), "ts")


def simulated_fills(trades: DataFrame) -> DataFrame:
    """A full fill for each order, its id a hash of the order."""
    order = F.sha2(F.concat_ws("|", "account_id", "symbol", F.col("qty").cast("string"), F.col("price").cast("string"), F.col("ts").cast("string")), 256)
    return trades.select("account_id", F.substring(order, 1, 16).alias("order_id"), "symbol", F.col("qty").alias("fill_qty"), F.col("price").alias("fill_price"), F.lit("FILLED").alias("status"), "ts")


def venue_orders(trades: DataFrame) -> DataFrame:
    order = F.concat_ws("-", "account_id", "symbol", F.col("ts").cast("string"))
    return trades.select("account_id", order.alias("order_id"), "symbol", "qty", "price", F.lit("SIM_EXCHANGE").alias("venue"), F.lit("NEW").alias("status"), "ts")


def pending_orders(orders: DataFrame, updates: DataFrame) -> DataFrame:
    """Orders with their latest status; FILLED and REJECTED ones are gone."""
    last = updates.groupBy("order_id").agg(F.max_by("status", "ts").alias("_status"))
    d = orders.join(last, "order_id", "left").withColumn("status", F.coalesce("_status", "status")).drop("_status")
    return d.where(~F.col("status").isin("FILLED", "REJECTED")).select(*orders.columns)


def validated(signals: DataFrame, accounts: DataFrame) -> DataFrame:
    """Each order's decision by its account's status and notional limit."""
    decision = F.when(F.col("status") != "ACTIVE", "REJECT_ACCOUNT").when(F.col("qty") * F.col("price") > F.col("max_notional"), "REJECT_NOTIONAL").otherwise("ACCEPT")
    return signals.join(accounts, "account_id").withColumn("decision", decision)


def account_states(deltas: DataFrame, chunk_ms: int = 86_400_000) -> DataFrame:
    """Open symbols of each account after every position change: account_id, ts, seq, symbol, is_open, open_count.

    deltas: op, account_id, symbol, net_qty, ts, seq. One position of an account and symbol opening or closing moves the count by one.
    Both go over chunks of so much time, so no task gets an account.
    """
    own = ["account_id", "symbol"]
    is_open = (F.col("op") == "UPSERT") & (F.abs(F.coalesce("net_qty", F.lit(0.0))) > 1e-12)
    d = deltas.withColumn("is_open", is_open).withColumn("_chunk", F.floor(F.col("ts") / chunk_ms))
    last = d.groupBy(*own, "_chunk").agg(F.max_by("is_open", F.struct("ts", "seq")).alias("_last"))
    carry = last.select(*own, "_chunk", F.lag("_last").over(Window.partitionBy(*own).orderBy("_chunk")).alias("is_open"))
    before = F.lag("is_open").over(Window.partitionBy(*own, "_chunk").orderBy("_own", "ts", "seq"))
    d = prefix.carried(d, carry).withColumn("was", F.coalesce(before, F.lit(False))).where("_own = 1").drop("_own")
    step = F.when(F.col("is_open") & ~F.col("was"), 1).when(~F.col("is_open") & F.col("was"), -1).otherwise(0)
    d = prefix.running(d, ["account_id"], F.col("_chunk"), ["ts", "seq"], {"open_count": step.cast("long")})
    return d.select("account_id", "ts", "seq", "symbol", "is_open", "open_count")


class AccountIndex:
    """The accounts of a shard that have room, by their number of open symbols and then by id, and those of them that hold a symbol.

    A change costs what its account holds, a choice a binary search in each number of open symbols; neither looks at all accounts.
    """

    def __init__(self) -> None:
        #: Of each account: its limit (None: no policy yet), whether it is active, and the symbols that it holds.
        self.accounts: dict[str, list] = {}
        self.free: dict[int, list[str]] = {}
        self.holders: dict[tuple[int, str], list[str]] = {}

    def _place(self, account: str, put: bool) -> None:
        limit, active, held = self.accounts[account]
        n = len(held)
        if not active or n >= limit:
            return
        for table, at in ((self.free, n), *((self.holders, (n, s)) for s in held)):
            if put:
                insort(table.setdefault(at, []), account)
                continue
            ids = table[at]
            del ids[bisect_left(ids, account)]
            if not ids:
                del table[at]

    def policy(self, account: str, limit: int, active: bool) -> None:
        if account in self.accounts:
            self._place(account, False)
        held = self.accounts[account][2] if account in self.accounts else []
        self.accounts[account] = [limit, active, held]
        self._place(account, True)

    def position(self, account: str, symbol: str, is_open: bool) -> None:
        """An account whose positions come before its policy is active, with room without bound."""
        if account not in self.accounts:
            self.policy(account, UNBOUNDED, True)
        held = self.accounts[account][2]
        if is_open != (symbol in held):
            self._place(account, False)
            held.append(symbol) if is_open else held.remove(symbol)
            self._place(account, True)

    def choose(self, symbol: str, scale_in: bool) -> tuple | None:
        """The first account that does not hold the symbol, or else the first that does: (holds, open symbols, id)."""
        for n in sorted(self.free):
            ids, held = self.free[n], self.holders.get((n, symbol), [])
            if len(held) < len(ids):
                at = bisect_left(range(len(held)), True, key=lambda i: held[i] != ids[i])
                return False, n, ids[at]
        if scale_in:
            for n in sorted(self.free):
                if held := self.holders.get((n, symbol)):
                    return True, n, held[0]
        return None

    def dump(self) -> dict:
        return self.accounts

    @classmethod
    def load(cls, accounts: dict) -> AccountIndex:
        index = cls()
        index.accounts = accounts
        for account in accounts:
            index._place(account, True)
        return index


#: What tells signals apart; equal ones each get an order.
SIGNAL = ["run_id", "symbol", "ts", "signal"]
#: Accounts of a shard of the router's index, about.
SHARD_ACCOUNTS = 50_000


def shards_for(n_accounts: int) -> int:
    """How many shards to give trade_picker for so many accounts."""
    return max(1, -(-n_accounts // SHARD_ACCOUNTS))


def trade_picker(signals: DataFrame, policies: DataFrame, deltas: DataFrame, qty: float = 1.0, scale_in: bool = True, shards: int = 8) -> DataFrame:
    """The account for each signal as of its time: active, with room, not holding the symbol (or, with scale_in, holding it), fewest open symbols, then by id.

    Policies and positions count from their own time on (policies without ts from the start); an account whose positions come
    before its policy has room without bound until then. At one time policies go first, then positions by seq, then signals. Nothing is reserved
    by a routed signal. Without an account the signal is dropped; equal signals each give an order. Rows without account are left out.

    Accounts are dealt to shards, each of which keeps an index of its accounts from control events alone and gives its best account for each
    signal; the best of these is taken. Signals meet shards, not accounts: work grows with control events and with signals times shards,
    memory of a task with the accounts of a shard. With streams for all three tables the shards' indexes are state; a trigger's signals
    meet what it and earlier triggers brought.
    """
    if "ts" not in policies.columns:
        policies = policies.withColumn("ts", F.lit(-(2**62)).cast("long"))
    stream = signals.isStreaming
    shard = F.pmod(F.xxhash64("account_id"), F.lit(shards)).cast("int").alias("shard")
    rules = policies.where("account_id is not null").select(shard, F.lit(0).alias("kind"), "ts", F.lit(0).cast("long").alias("seq"), "account_id", F.coalesce(F.col("max_open_symbols"), F.lit(0)).cast("int").alias("n"), F.coalesce(F.upper("status") == "ACTIVE", F.lit(False)).alias("flag"))
    is_open = (F.col("op") == "UPSERT") & (F.abs(F.coalesce("net_qty", F.lit(0.0))) > 1e-12)
    held = deltas.where("account_id is not null").select(shard, F.lit(1).alias("kind"), "ts", "seq", "account_id", "symbol", F.coalesce(is_open, F.lit(False)).alias("flag"))
    if not stream:
        w = Window.partitionBy("account_id", "symbol").orderBy("ts", "seq")
        held = held.withColumn("was", F.lag("flag").over(w)).where("was is null or flag != was").drop("was")
    each = signals.select(*SIGNAL)
    each = each.withColumn("n", F.lit(1)) if stream else each.groupBy(*SIGNAL).agg(F.count("*").cast("int").alias("n"))
    asked = each.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(2).alias("kind"), F.lit(0).cast("long").alias("seq"), *SIGNAL, "n")
    rows = rules.unionByName(held, allowMissingColumns=True).unionByName(asked, allowMissingColumns=True)

    def step(index, pdf):
        index = index or AccountIndex()
        found, asked = [], []
        for k, (kind, account, symbol, n, flag) in enumerate(zip(*(pdf[c].tolist() for c in ("kind", "account_id", "symbol", "n", "flag")), strict=True)):
            if kind == 0:
                index.policy(account, int(n), bool(flag))
            elif kind == 1:
                index.position(account, symbol, bool(flag))
            else:
                asked.append(k)
                found.append(index.choose(symbol, scale_in) or (None, None, None))
        columns = {c: [pdf[c].iloc[k] for k in asked] for c in [*SIGNAL, "n"]} | {c: [x[i] for x in found] for i, c in enumerate(("holds", "n_open", "account_id"))}
        return index, pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in columns.items()})

    schema = extended(each.select(*SIGNAL).schema, "n int, holds boolean, n_open int, account_id string")
    answers = in_order(rows, ["shard"], ["ts", "kind", "seq"], step, schema, lambda index: index.dump(), AccountIndex.load)
    if stream:
        schema = extended(each.select(*SIGNAL).schema, "account_id string")
        best = answers.groupBy(*SIGNAL).transformWithStateInPandas(BestAnswer(answers.columns, shards), schema, outputMode="Append", timeMode="None")
    else:
        best = answers.where("account_id is not null").groupBy(*SIGNAL).agg(F.max("n").alias("n"), F.min(F.struct("holds", "n_open", "account_id")).alias("b"))
        best = best.select(*SIGNAL, "b.account_id", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("_copy"))
    return best.select(F.concat_ws("-", "run_id", F.col("ts").cast("string")).alias("signal_id"), "account_id", F.col("run_id").alias("strategy_id"), "symbol", F.col("signal").alias("action"), F.lit(qty).alias("qty"), "ts")


class BestAnswer(StatefulProcessor):
    """The best of the shards' answers, which all come within the signal's trigger; nothing is kept."""

    def __init__(self, columns: list[str], shards: int):
        self.columns, self.shards = columns, shards

    def init(self, handle: StatefulProcessorHandle) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = taken(rows, self.columns)
        some = pdf[pdf["account_id"].notna()].sort_values(["holds", "n_open", "account_id"])
        if len(some):
            yield pd.concat([some.iloc[:1][[*SIGNAL, "account_id"]]] * (len(pdf) // self.shards), ignore_index=True)

    def close(self) -> None:
        pass


def admission(orders: DataFrame, policies: DataFrame | None = None, positions: DataFrame | None = None) -> DataFrame:
    """Orders that pass: notional of at most MAX_NOTIONAL, and no new symbol beyond the account's limit.

    Accepted orders move the account's estimate; position rows (account_id, symbol, net_qty, ts, seq) set it, and a policy sets the
    limit from its time on. Each decision rests on those before, so an account's rows are taken in order of (ts, controls first, seq)
    by one task, which holds the account's open symbols and a batch of rows, however many rows there are. With streams for all
    tables given, the account's state is kept from trigger to trigger.
    """
    d = orders.withColumn("kind", F.lit(2)).withColumn("limit", F.lit(None).cast("int"))
    if positions is not None:
        d = d.unionByName(positions.select("account_id", "symbol", F.col("net_qty").alias("qty"), "ts", "seq", F.lit(1).alias("kind")), allowMissingColumns=True)
    if policies is not None:
        limit = F.when(F.upper("status") == "BLOCKED", 0).when(F.col("max_open_symbols") > 0, F.col("max_open_symbols")).otherwise(DEFAULT_MAX_OPEN)
        d = d.unionByName(policies.where("account_id is not null").select("account_id", "ts", F.lit(0).cast("long").alias("seq"), F.lit(0).alias("kind"), limit.cast("int").alias("limit")), allowMissingColumns=True)
    columns = orders.columns

    def step(state, pdf):
        limit, net = state or (DEFAULT_MAX_OPEN, {})
        keep = []
        for kind, symbol, qty, price, new in zip(*(pdf[c].tolist() for c in ("kind", "symbol", "qty", "price", "limit")), strict=True):
            ok = False
            if kind == 0:
                limit = int(new)
            elif kind == 1:
                net[symbol] = qty
                if qty == 0:
                    del net[symbol]
            else:
                ok = abs(qty * price) <= MAX_NOTIONAL and (symbol in net or qty == 0 or len(net) < limit)
                if ok:
                    after = round(net.pop(symbol, 0.0) + qty, 12)
                    if after:
                        net[symbol] = after
            keep.append(ok)
        return (limit, net), pdf[keep][columns]

    return in_order(d, ["account_id"], ["ts", "kind", "seq"], step, orders.schema)
