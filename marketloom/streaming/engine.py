"""The trading engine as a stateful stream: each key keeps its open lots and sends tagged changes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from marketloom.operators.folds import taken
from marketloom.session import ship

KEY = ["account_id", "strategy_id", "symbol"]
OUTPUT = "kind string, op string, account_id string, strategy_id string, symbol string, lot_seq long, other_seq long, side string, qty double, price double, pnl double, seq long"
EPS = 1e-12
SEEN_TTL_MS = 7 * 86_400_000


def apply_fill(lots: list[list], side: str, qty: float, price: float, seq: int) -> tuple[list[list], list[tuple]]:
    """Closes the oldest lots of the other side, then opens what is left. lots: [seq, LONG or SHORT, rest, price], oldest first.

    Returns the lots left and events (kind, op, lot_seq, other_seq, side, qty, price, pnl).
    """
    own, other = ("LONG", "SHORT") if side == "BUY" else ("SHORT", "LONG")
    events, left = [], []
    for lot in lots:
        if lot[1] == other and qty > EPS:
            used = min(lot[2], qty)
            pnl = (lot[3] - price) * used if side == "BUY" else (price - lot[3]) * used
            events.append(("match", "INSERT", lot[0], seq, side, used, price, pnl))
            lot = [lot[0], lot[1], lot[2] - used, lot[3]]
            qty -= used
            if lot[2] <= EPS:
                events.append(("lot", "DELETE", lot[0], seq, lot[1], None, lot[3], None))
                continue
            events.append(("lot", "UPSERT", lot[0], seq, lot[1], lot[2], lot[3], None))
        left.append(lot)
    if qty > EPS:
        left.append([seq, own, qty, price])
        events.append(("lot", "UPSERT", seq, seq, own, qty, price, None))
    net = sum(x[2] if x[1] == "LONG" else -x[2] for x in left)
    value = sum(x[2] * x[3] if x[1] == "LONG" else -x[2] * x[3] for x in left)
    flat = abs(net) <= EPS
    events.append(("rollup", "DELETE" if flat else "UPSERT", None, seq, None if flat else own if (net > 0) == (own == "LONG") else other, None if flat else net, None if flat else abs(value / net), None))
    return left, events


class Engine(StatefulProcessor):
    """A key's open lots, its realized profit, and the fills it has seen, each of which is forgotten SEEN_TTL_MS after it came."""

    def __init__(self, columns: list[str]):
        self.columns = columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.lots = handle.getListState("lots", "lot_seq long, side string, rest double, price double")
        self.total = handle.getValueState("total", "total double")
        self.seen = handle.getMapState("seen", "order_id string, fill_id string", "seq long", ttlDurationMs=SEEN_TTL_MS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fills = taken(rows, self.columns).sort_values("seq")
        lots = [list(x) for x in self.lots.get()]
        total = self.total.get()[0] if self.total.exists() else 0.0
        out = []
        for f in fills.itertuples(index=False):
            name = (f.order_id, fill_name(f))
            if self.seen.containsKey(name):
                continue
            self.seen.updateValue(name, (int(f.seq),))
            lots, events = apply_fill(lots, "BUY" if str(f.side).upper() == "BUY" else "SELL", f.qty, f.price, int(f.seq))
            gained = sum(e[7] for e in events if e[0] == "match")
            if abs(gained) > EPS:
                total += gained
                events.append(("realized", "UPSERT", None, int(f.seq), None, None, None, total))
            out += [(e[0], e[1], *key, *e[2:], int(f.seq)) for e in events]
        if lots:
            self.lots.put([tuple(x) for x in lots])
        else:
            self.lots.clear()
        self.total.update((total,))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def close(self) -> None:
        pass


def fill_name(f) -> str:
    """The fill's id; without one (null or empty) all its fields together."""
    return f.fill_id if isinstance(f.fill_id, str) and f.fill_id else f"|{f.side}|{f.qty}|{f.price}|{f.ts}"


def engine(fills: DataFrame) -> DataFrame:
    """Tagged changes (kind match, lot, rollup or realized) of a stream of fills; within a trigger a key's fills go by seq.

    State with a time to live counts in processing time, for which Spark goes on with empty batches; an availableNow trigger ends only
    with spark.sql.streaming.noDataMicroBatches.enabled set to false.
    """
    ship(fills.sparkSession)
    return fills.groupBy(*KEY).transformWithStateInPandas(Engine(fills.columns), OUTPUT, outputMode="Update", timeMode="ProcessingTime")
