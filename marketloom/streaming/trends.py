"""The trend summary as a stream: an event-time timer for each window blends the lines that came for it."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from marketloom.operators.folds import taken
from marketloom.operators.trend import SUMMARY, phases
from marketloom.session import ship

#: What a window's blend takes from a line.
TAKEN = ["slope", "slope_norm", "score", "breakouts", "breakout_strength", "last_breakout_ts"]


def blend(symbol: str, end: int, lines: list[list], now: int, tau_ms: float, softness: float) -> pd.DataFrame:
    """One window's row of operators.trend.fused, of its lines' TAKEN values."""
    x = pd.DataFrame(lines, columns=TAKEN)
    s, q, b = (x[c].clip(0, 1) for c in ("slope_norm", "score", "breakout_strength"))
    broke = x["last_breakout_ts"] > 0
    recency = np.where(broke, np.exp(-np.maximum(0, now - x["last_breakout_ts"]) / max(1.0, tau_ms)), 0.0)
    a = np.where(x["slope"] >= 0, 1, -1) * s * q * np.where(x["breakouts"] > 0, 1.0, 0.6) * (0.5 + 0.5 * b) * np.where(broke, recency, 1.0)
    c = (q * (0.5 + 0.5 * s)).clip(0, 1)
    mean = lambda v: float(np.average(v, weights=np.exp(softness * c)))
    row = (symbol, end, mean(a), min(1.0, max(0.0, mean(c))), int(x["last_breakout_ts"].max()), float(recency.max()), min(1.0, max(0.0, mean(b))), len(x))
    return pd.DataFrame([row], columns=["symbol", "ts", "alpha", "confidence", "last_breakout_ts", "breakout_recency", "breakout_strength", "lines_used"])


class Summaries(StatefulProcessor):
    """A symbol's open windows with their lines, and the recurrence's state. A window's timer stands delay_ms after its end."""

    def __init__(self, columns: list[str], delay_ms: int, tau_ms: float, softness: float, step):
        self.columns, self.delay_ms, self.tau_ms, self.softness, self.step = columns, delay_ms, tau_ms, softness, step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "window_end_ts long", "lines string")
        self.held = handle.getValueState("held", "state string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = taken(rows, self.columns)
        for end, group in pdf.groupby("window_end_ts", sort=True):
            end = int(end)
            if end + self.delay_ms <= timerValues.getCurrentWatermarkInMs():
                continue
            known = json.loads(self.open.getValue((end,))[0]) if self.open.containsKey((end,)) else []
            if not known:
                self.handle.registerTimer(end + self.delay_ms)
            self.open.updateValue((end,), (json.dumps(known + group[TAKEN].to_numpy(float).tolist()),))
        yield pd.DataFrame([], columns=[c.split()[0] for c in SUMMARY.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = int(expiredTimerInfo.getExpiryTimeInMs())
        end = now - self.delay_ms
        lines = json.loads(self.open.getValue((end,))[0])
        self.open.removeKey((end,))
        state = json.loads(self.held.get()[0]) if self.held.exists() else None
        state, out = self.step(state, blend(key[0], end, lines, now, self.tau_ms, self.softness))
        self.held.update((json.dumps(state),))
        yield out

    def close(self) -> None:
        pass


def trend_summary(lines: DataFrame, tau_ms: float = 2 * 3_600_000.0, softness: float = 3.0, beta: float = 0.3, conf: float = 0.35, alpha: float = 0.15, enter: float = 0.6, leave: float = 0.3, delay_ms: int = 10, lateness: str = "1 minute") -> DataFrame:
    """The rows of operators.trend.trend_summary with now_offset_ms = delay_ms, each sent once the watermark passes its window's timer.

    Lines of a window whose timer has gone off are dropped. A symbol's state is its open windows and three numbers.
    """
    ship(lines.sparkSession)
    timed = lines.select("symbol", "window_end_ts", *TAKEN, F.timestamp_millis("window_end_ts").alias("time")).withWatermark("time", lateness)
    processor = Summaries(timed.columns, delay_ms, tau_ms, softness, phases(beta, conf, alpha, enter, leave))
    return timed.groupBy("symbol").transformWithStateInPandas(processor, SUMMARY, outputMode="Append", timeMode="EventTime")
