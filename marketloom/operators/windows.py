"""Two sources co-grouped by symbol and sliding window, in batch and as a stream."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from marketloom.operators.folds import taken
from marketloom.session import ship

#: From (symbol, window start, window end) and the window's rows of either side to the rows to send.
OfWindow = Callable[[tuple, pd.DataFrame, pd.DataFrame], pd.DataFrame]


def sliding(df: DataFrame, size_ms: int, slide_ms: int) -> DataFrame:
    """Each row once for each window over it: window_start_ts, window_end_ts. Windows begin at multiples of the slide."""
    newest = F.floor(F.col("ts") / slide_ms) * slide_ms
    starts = F.filter(F.transform(F.sequence(F.lit(0), F.lit(-(-size_ms // slide_ms) - 1)), lambda k: (newest - k * slide_ms).cast("long")), lambda s: s + size_ms > F.col("ts"))
    return df.withColumn("window_start_ts", F.explode(starts)).withColumn("window_end_ts", F.col("window_start_ts") + size_ms)


def cogrouped(left: DataFrame, right: DataFrame | None, size_ms: int, slide_ms: int, of_window: OfWindow, schema: str, delay_ms: int = 0, lateness: str = "1 minute") -> DataFrame:
    """What of_window makes of each (symbol, window) with rows on either side; the other side may be empty. Both have symbol and ts.
    Without right, that side is empty everywhere.

    As streams, a window is sent once the watermark, which follows the slower source, passes its end by delay_ms; rows of windows that
    were sent are dropped. Then a symbol's state is the rows of its windows still open, each held once, not once for each window. Values of
    rows are held as JSON: numbers, texts and booleans come back as they were. Rows without symbol or ts are in no window.
    """
    ship(left.sparkSession)
    sources = [d.where("symbol is not null and ts is not null") for d in (left, right) if d is not None]
    names = [left.columns, right.columns if right is not None else ["symbol", "ts"]]
    if not left.isStreaming:
        key = ["symbol", "window_start_ts", "window_end_ts"]
        # Columns of their own on each side: where both stem from one table, Spark would drop the right one's.
        first, *second = (sliding(d.select(*[F.col(c).alias(c) for c in d.columns]), size_ms, slide_ms).groupBy(*key) for d in sources)
        if not second:
            return first.applyInPandas(lambda k, a: of_window(k, a[names[0]], pd.DataFrame(columns=names[1])), schema)
        return first.cogroup(second[0]).applyInPandas(lambda k, a, b: of_window(k, a[names[0]], b[names[1]]), schema)
    timed = [
        d.select("symbol", "ts", F.lit(side).alias("side"), F.to_json(F.struct(*d.columns), {"ignoreNullFields": "false"}).alias("row"), F.timestamp_millis("ts").alias("time")).withWatermark("time", lateness)
        for side, d in enumerate(sources)
    ]
    both = reduce(DataFrame.unionByName, timed)
    processor = Windows(both.columns, names, size_ms, slide_ms, delay_ms, of_window)
    return both.groupBy("symbol").transformWithStateInPandas(processor, schema, outputMode="Append", timeMode="EventTime")


class Windows(StatefulProcessor):
    """A symbol's rows by time, and the ends of its open windows, each with a timer."""

    def __init__(self, columns: list[str], names: list[list[str]], size_ms: int, slide_ms: int, delay_ms: int, of_window: OfWindow):
        self.columns, self.names, self.size_ms, self.slide_ms, self.delay_ms, self.of_window = columns, names, size_ms, slide_ms, delay_ms, of_window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getMapState("rows", "ts long, side int", "rows string")
        self.open = handle.getMapState("open", "window_end_ts long", "begun boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        for (ts, side), group in taken(rows, self.columns).groupby(["ts", "side"], sort=True):
            ts, side = int(ts), int(side)
            last = ts // self.slide_ms * self.slide_ms
            ends = [s + self.size_ms for s in range(last, ts - self.size_ms, -self.slide_ms)]
            ends = [end for end in ends if end + self.delay_ms > passed]
            if not ends:
                continue
            known = json.loads(self.rows.getValue((ts, side))[0]) if self.rows.containsKey((ts, side)) else []
            self.rows.updateValue((ts, side), (json.dumps(known + group["row"].tolist()),))
            for end in ends:
                if not self.open.containsKey((end,)):
                    self.open.updateValue((end,), (True,))
                    self.handle.registerTimer(end + self.delay_ms)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end = int(expiredTimerInfo.getExpiryTimeInMs()) - self.delay_ms
        self.open.removeKey((end,))
        held = sorted((int(k[0]), int(k[1]), v[0]) for k, v in self.rows.iterator())
        sides: list[list] = [[], []]
        for ts, side, found in held:
            if end - self.size_ms <= ts < end:
                sides[side] += map(json.loads, json.loads(found))
        needed = min((int(k[0]) for k in self.open.keys()), default=None)
        for ts, side, _ in held:
            if needed is None or ts < needed - self.size_ms:
                self.rows.removeKey((ts, side))
        yield self.of_window((key[0], end - self.size_ms, end), *(pd.DataFrame(rows, columns=names) for rows, names in zip(sides, self.names, strict=True)))

    def close(self) -> None:
        pass
