"""Trading rules and event patterns over indicators with prices: symbol, ts, close, sma5, sma21, rsi."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from marketloom.operators.folds import in_order
from marketloom.session import extended


def by_time() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("ts")


class Strategy(Protocol):
    """A rule from rows with indicators to signals."""

    def __call__(self, rows: DataFrame) -> DataFrame: ...


def signals(rows: DataFrame, signal: Column, strength: Column, run_id: str) -> DataFrame:
    """The rows with a signal: run_id, symbol, ts, close, sma5, sma21, signal, signal_strength."""
    return rows.withColumn("signal", signal).withColumn("signal_strength", strength).where("signal is not null").select(F.lit(run_id).alias("run_id"), "symbol", "ts", "close", "sma5", "sma21", "signal", "signal_strength")


def gap() -> Column:
    return F.abs(F.col("sma5") - F.col("sma21"))


def simple_cross(rows: DataFrame) -> DataFrame:
    """On every row: sma5 above sma21 BUY, below SELL."""
    side = F.when(F.col("sma5") > F.col("sma21"), "BUY").when(F.col("sma5") < F.col("sma21"), "SELL")
    return signals(rows, side, F.when(F.col("sma21") != 0, gap() / F.abs("sma21")).otherwise(0.0), "simple-cross")


def with_previous(rows: DataFrame, *columns: str) -> DataFrame:
    """The columns' values on the symbol's row before, as previous_...; null on its first row. A stream keeps the last row's values."""
    if not rows.isStreaming:
        return rows.select("*", *[F.lag(c).over(by_time()).alias(f"previous_{c}") for c in columns])
    schema = extended(rows.schema, ", ".join(f"previous_{c} {rows.schema[c].dataType.simpleString()}" for c in columns))

    def step(state, pdf):
        state, pdf = state or [None] * len(columns), pdf.copy()
        last = [x.item() if hasattr(x, "item") else x for x in pdf[list(columns)].astype(object).iloc[-1]]
        for c, x in zip(columns, state, strict=True):
            pdf[f"previous_{c}"] = pd.Series([x, *pdf[c].tolist()[:-1]], index=pdf.index, dtype=object)
        return last, pdf

    return in_order(rows, ["symbol"], ["ts"], step, schema)


def rsi_threshold(rows: DataFrame, low: float = 30.0, high: float = 70.0) -> DataFrame:
    side = F.when(F.col("rsi") < low, "BUY").when(F.col("rsi") > high, "SELL")
    return signals(rows, side, F.abs(F.col("rsi") - 50) / 50, "rsi-threshold")


def state_cross(rows: DataFrame) -> DataFrame:
    """Golden and death crosses against the row before."""
    d = with_previous(rows, "sma5", "sma21")
    b5, b21 = F.col("previous_sma5"), F.col("previous_sma21")
    side = F.when((F.col("sma5") > F.col("sma21")) & (b5 <= b21), "BUY").when((F.col("sma5") < F.col("sma21")) & (b5 >= b21), "SELL")
    return signals(d, side, F.when(F.col("sma21") > 0, F.least(F.lit(1.0), gap() / F.col("sma21") * 100)).otherwise(0.0), "state-cross")


def state_gate(rows: DataFrame, rule=simple_cross) -> DataFrame:
    """A per-row rule from each symbol's second row on."""
    return rule(with_previous(rows, "ts").where("previous_ts is not null").drop("previous_ts"))


def _crossed(above: Callable[[Column, Column], Column], within_ms: int) -> Column:
    """Of rows with_previous values: where a condition on sma5 and sma21 holds, did not hold on the row before, and that row is near enough: relaxed two-stage patterns whose stages exclude each other."""
    near = F.col("ts") - F.col("previous_ts") <= within_ms
    return above(F.col("sma5"), F.col("sma21")) & ~above(F.col("previous_sma5"), F.col("previous_sma21")) & near


def cep_golden(rows: DataFrame, within_ms: int = 3_600_000) -> DataFrame:
    """BUY where sma5 rises over sma21 within the time allowed."""
    d = with_previous(rows.where("sma5 is not null and sma21 is not null"), "ts", "sma5", "sma21")
    hit = _crossed(lambda x, y: x > y, within_ms)
    return signals(d, F.when(hit, "BUY"), F.when(F.col("sma21") > 0, F.least(F.lit(1.0), gap() / F.col("sma21") * 100)).otherwise(0.0), "cep-golden")


def cep_cross(rows: DataFrame, within_ms: int = 3_600_000) -> DataFrame:
    """BUY on golden and SELL on death crosses."""
    d = with_previous(rows.where("sma5 is not null and sma21 is not null"), "ts", "sma5", "sma21")
    up, down = _crossed(lambda x, y: x > y, within_ms), _crossed(lambda x, y: x < y, within_ms)
    return signals(d, F.when(up, "BUY").when(down, "SELL"), F.when(F.col("sma21") != 0, F.least(F.lit(1.0), gap() / F.abs("sma21"))).otherwise(0.0), "cep-cross")


def cooldown(found: DataFrame, cooldown_ms: int, sides: list[str] | None = None) -> DataFrame:
    """Greedy: a signal passes if the last one passed of its symbol is at least cooldown_ms older. sides None: all share the state."""
    d = found if sides is None else found.where(F.col("signal").isin(sides))

    def step(last, pdf):
        keep = []
        for t in pdf["ts"].tolist():
            ok = last is None or t - last >= cooldown_ms
            keep.append(ok)
            last = t if ok else last
        return last, pdf[keep]

    return in_order(d, ["symbol"], ["ts", "signal"], step, d.schema)


def nfa(rows: DataFrame, stages: list[str], within_ms: int, carry: str) -> DataFrame:
    """Rows that complete a relaxed pattern of the stages (SQL conditions), with carry's value on the first stage's row as first_value.

    By symbol in time order: old partial matches are dropped, each goes on by one stage at most, a new one opens where
    the first stage holds; of those completed the earliest start wins and all are cleared.
    """
    tests = [f"_s{k}" for k in range(len(stages))]
    d = rows.select("*", *[F.coalesce(F.expr(s), F.lit(False)).alias(t) for s, t in zip(stages, tests, strict=True)])
    schema = extended(rows.schema, "first_value double")
    names, n = rows.columns, len(stages)

    def step(state, pdf):
        partial, firsts = state or [], []
        for ts, value, *holds in zip(pdf["ts"].tolist(), pdf[carry].tolist(), *[pdf[t].tolist() for t in tests], strict=True):
            partial = [p for p in partial if ts - p[0] <= within_ms]
            done, kept = None, []
            for start, at, first in partial:
                if holds[at]:
                    at += 1
                if at == n:
                    done = first if done is None else done
                else:
                    kept.append((start, at, first))
            partial = kept
            if done is not None:
                partial = []
            elif holds[0]:
                partial.append((ts, 1, value))
            firsts.append(done)
        out = pdf[names].copy()
        out["first_value"] = firsts
        return partial, out[[f is not None for f in firsts]]

    return in_order(d, ["symbol"], ["ts"], step, schema)


def cep_rsi_sma_buy(rows: DataFrame, within_ms: int = 4 * 3_600_000) -> DataFrame:
    """Oversold, then sma5 at or below sma21, then above."""
    d = nfa(rows.where("rsi is not null and sma5 is not null and sma21 is not null"), ["rsi < 25", "sma5 <= sma21", "sma5 > sma21"], within_ms, "rsi")
    cross = F.when(F.col("sma21") > 0, F.least(F.lit(1.0), gap() / F.col("sma21") * 100)).otherwise(0.0)
    return signals(d, F.lit("BUY"), (F.least(F.lit(1.0), (30 - F.col("first_value")) / 30) + cross) / 2, "rsi-sma")


def cep_rsi_sma_sell(rows: DataFrame, within_ms: int = 4 * 3_600_000) -> DataFrame:
    """Overbought, then close at or above sma5, then below."""
    d = nfa(rows.where("rsi is not null and sma5 is not null and sma21 is not null"), ["rsi > 72", "close >= sma5", "close < sma5"], within_ms, "rsi")
    cross = F.when(F.col("sma5") > 0, F.least(F.lit(1.0), F.abs(F.col("close") - F.col("sma5")) / F.col("sma5") * 100)).otherwise(0.0)
    return signals(d, F.lit("SELL"), (F.least(F.lit(1.0), (F.col("first_value") - 70) / 30) + cross) / 2, "rsi-sma")


def seven_green(rows: DataFrame, within_ms: int = 12 * 3_600_000) -> DataFrame:
    """Blocks of seven rows in a row (the 2nd to 7th with close above 0) within the time allowed; BUY on a block's last row if closes rise throughout.

    A block ends in time or its first row is given up; the next block starts after it.
    """
    schema = extended(rows.schema, "first_value double, rising boolean")
    names = rows.columns

    def step(state, pdf):
        open_ts, open_close = state or ([], [])
        before = len(open_ts)
        ts, close = open_ts + pdf["ts"].tolist(), open_close + pdf["close"].tolist()
        i, hits = 0, []
        while i + 6 < len(ts):
            block = close[i : i + 7]
            if ts[i + 6] - ts[i] <= within_ms and all(c > 0 for c in block[1:]):
                hits.append((i + 6 - before, block[0], all(a < b for a, b in zip(block, block[1:], strict=False))))
                i += 7
            else:
                i += 1
        out = pdf[names].iloc[[h[0] for h in hits]].copy()
        out["first_value"], out["rising"] = [h[1] for h in hits], [h[2] for h in hits]
        return (ts[i:], close[i:]), out

    d = in_order(rows, ["symbol"], ["ts"], step, schema)
    rise = F.when(F.col("first_value") > 0, F.least(F.lit(1.0), 10 * (F.col("close") - F.col("first_value")) / F.col("first_value"))).otherwise(0.0)
    return signals(d, F.when(F.col("rising"), "BUY"), rise, "seven-green")


def debug_lines(found: DataFrame) -> DataFrame:
    """One text for each signal."""
    return found.select("symbol", "ts", F.format_string("%s %s @%d sma5=%.4f sma21=%.4f", "signal", "symbol", "ts", "sma5", "sma21").alias("line"))


def run_strategy(indicators: DataFrame, candles: DataFrame, rule, tolerance_ms: int = 500) -> DataFrame:
    """Indicators joined with candles of about the same time, then a rule over the rows."""
    from marketloom.operators.joins import interval_join

    return rule(interval_join(indicators, candles, tolerance_ms))


#: Rules by name; further ones can be put in.
RULES: dict[str, Strategy] = {"simple-cross": simple_cross, "rsi-threshold": rsi_threshold, "state-cross": state_cross}
