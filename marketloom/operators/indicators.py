"""Indicators over candles, by symbol in time order."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from marketloom.operators import prefix
from marketloom.operators.folds import in_order
from marketloom.session import extended


def by_time() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("ts")


def sma(p: int, price: str = "close") -> Column:
    """Mean of the last p prices, of fewer at the start."""
    return F.avg(price).over(by_time().rowsBetween(1 - p, 0))


def rsi(p: int = 14) -> Column:
    """From with_change(): RSI over p prices (p - 1 changes): 0 with fewer prices, 100 without losses."""
    frame = by_time().rowsBetween(2 - p, 0)
    gain = F.sum(F.greatest(F.col("_change"), F.lit(0.0))).over(frame)
    loss = F.sum(F.greatest(-F.col("_change"), F.lit(0.0))).over(frame)
    value = F.when(loss == 0, 100.0).otherwise(100 - 100 / (1 + gain / loss))
    return F.when(F.row_number().over(by_time()) < p, 0.0).otherwise(value)


def with_change(df: DataFrame, price: str = "close") -> DataFrame:
    return df.withColumn("_change", F.col(price) - F.lag(price).over(by_time()))


def with_sma(df: DataFrame, *periods: int) -> DataFrame:
    return df.select("*", *[sma(p).alias(f"sma{p}") for p in periods])


def with_rsi(df: DataFrame, p: int = 14) -> DataFrame:
    return with_change(df).withColumn(f"rsi{p}", rsi(p)).drop("_change")


#: The time that a chunk of a symbol's candles covers.
CHUNK_MS = 30 * 86_400_000


def with_ema(df: DataFrame, *periods: int, chunk_ms: int = CHUNK_MS) -> DataFrame:
    """Exponential means e += (c - e) * 2 / (p + 1) from the first close other than 0 on.

    A mean is an affine step of the mean before, so chunks of a symbol's candles are walked by tasks of their own. A stream takes each
    symbol's series in order of time, with the last means as state; there a mean of exactly 0 starts anew.
    """
    if not df.isStreaming:
        d = prefix.running(df, ["symbol"], F.floor(F.col("ts") / chunk_ms), ["ts"], {"_begun": F.when(F.col("close") == 0, 0).otherwise(1).cast("long")}).drop("_chunk")
        first = F.col("_begun") - F.when(F.col("close") == 0, 0).otherwise(1) == 0
        rate = lambda p: (F.when(first, 0.0).otherwise(1 - 2 / (p + 1)), F.when(first, F.col("close")).otherwise(F.col("close") * (2 / (p + 1))))
        d = prefix.affine(d, ["symbol"], F.floor(F.col("ts") / chunk_ms), ["ts"], {f"ema{p}": rate(p) for p in periods})
        return d.select(*df.columns, *[f"ema{p}" for p in periods])
    schema = extended(df.schema, ", ".join(f"ema{p} double" for p in periods))

    def step(state, pdf):
        means, pdf = state or [0.0] * len(periods), pdf.copy()
        for i, p in enumerate(periods):
            k, e, out = 2 / (p + 1), means[i], []
            for c in pdf["close"].tolist():
                e = c if e == 0.0 else e + (c - e) * k
                out.append(e)
            means[i] = e
            pdf[f"ema{p}"] = pd.Series(out, index=pdf.index, dtype="float64")
        return means, pdf

    return in_order(df, ["symbol"], ["ts"], step, schema)


def _moving(df: DataFrame, periods: tuple[int, ...], p: int) -> DataFrame:
    """with_sma and with_rsi for a stream, which has no windows over rows: the state is the last closes."""
    schema = extended(df.schema, ", ".join(f"sma{k} double" for k in periods) + f", rsi{p} double")
    kept = max(*periods, p)

    def step(state, pdf):
        closes = (state or []) + pdf["close"].tolist()
        own = range(len(closes) - len(pdf) + 1, len(closes) + 1)
        pdf = pdf.copy()
        for k in periods:
            pdf[f"sma{k}"] = [sum(closes[max(0, e - k) : e]) / min(k, e) for e in own]
        rsi_values = []
        for e in own:
            moves = [b - a for a, b in zip(closes[max(0, e - p) : e - 1], closes[max(0, e - p) + 1 : e], strict=True)]
            gain, loss = sum(m for m in moves if m > 0), -sum(m for m in moves if m < 0)
            rsi_values.append(0.0 if e < p else 100.0 if loss == 0 else 100 - 100 / (1 + gain / loss))
        pdf[f"rsi{p}"] = rsi_values
        return closes[-kept:], pdf

    return in_order(df, ["symbol"], ["ts"], step, schema)


def multi(df: DataFrame) -> DataFrame:
    """A row for each candle with sma, ema (5, 14, 21) and rsi14. A stream of candles keeps each symbol's last closes and means."""
    if df.isStreaming:
        return with_ema(_moving(df, (5, 14, 21), 14), 5, 14, 21)
    return with_ema(with_rsi(with_sma(df, 5, 14, 21)), 5, 14, 21)


def tall(df: DataFrame, names: list[str], run_id: str = "live") -> DataFrame:
    """One row for each indicator: run_id, symbol, ts, indicator_name, value; absent values are left out."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n.upper()).alias("indicator_name"), F.col(n).alias("value")) for n in names]))
    return df.select(F.lit(run_id).alias("run_id"), "symbol", "ts", pairs.alias("x")).select("run_id", "symbol", "ts", "x.*").where("value is not null")


def latest(tall_df: DataFrame) -> DataFrame:
    """The latest value for each (symbol, indicator)."""
    return tall_df.groupBy("symbol", "indicator_name").agg(F.max_by("value", "ts").alias("value"), F.max("ts").alias("ts"))


def pivoted(tall_df: DataFrame, names: list[str]) -> DataFrame:
    """Back to one row for each (run, symbol, time), with the named indicators as columns."""
    return tall_df.groupBy("run_id", "symbol", "ts").agg(*[F.max(F.when(F.col("indicator_name") == n, F.col("value"))).alias(n.lower()) for n in names])


def trend_direction(tall_df: DataFrame) -> DataFrame:
    """RISING, FALLING or FLAT against the value before."""
    w = Window.partitionBy("run_id", "symbol", "indicator_name").orderBy("ts")
    d = tall_df.withColumn("previous", F.lag("value").over(w))
    return d.withColumn("trend", F.when(F.col("value") > F.col("previous"), "RISING").when(F.col("value") < F.col("previous"), "FALLING").otherwise("FLAT"))


def swings(df: DataFrame, left: int = 2, right: int = 2, min_delta: float = 0.02) -> DataFrame:
    """Swing points: a bar whose high (low) no bar of the left and right ones exceeds (undercuts), with enough amplitude.

    rank: the lesser count of strictly lower highs (higher lows) on either side. Only bars with full sides count. A stream holds a symbol's
    last left + right bars and sends a swing once its right side is full.
    """
    left, right = max(1, left), max(1, right)
    if df.isStreaming:
        return in_order(df.select("symbol", "ts", "high", "low"), ["symbol"], ["ts"], swing_step(left, right, min_delta), SWING)
    before, after, frame = by_time().rowsBetween(-left, -1), by_time().rowsBetween(1, right), by_time().rowsBetween(-left, right)
    d = df.select(
        "symbol", "ts", "high", "low",
        F.max("high").over(frame).alias("top"), F.min("low").over(frame).alias("floor"), F.count("*").over(before).alias("nb"), F.count("*").over(after).alias("na"),
        F.collect_list("high").over(before).alias("hb"), F.collect_list("high").over(after).alias("ha"), F.collect_list("low").over(before).alias("lb"), F.collect_list("low").over(after).alias("la"),
    ).where((F.col("nb") == left) & (F.col("na") == right))
    span = F.greatest(F.lit(1e-9), F.col("top") - F.col("floor"))
    count = lambda arr, test: F.size(F.filter(arr, test))
    is_high = (F.col("high") >= F.col("top")) & (F.col("high") - F.col("floor") >= min_delta * span)
    is_low = (F.col("low") <= F.col("floor")) & (F.col("top") - F.col("low") >= min_delta * span)
    high = F.struct(F.lit("HIGH").alias("type"), F.col("high").alias("price"), F.least(count("hb", lambda x: x < F.col("high")), count("ha", lambda x: x < F.col("high"))).alias("rank"))
    low = F.struct(F.lit("LOW").alias("type"), F.col("low").alias("price"), F.least(count("lb", lambda x: x > F.col("low")), count("la", lambda x: x > F.col("low"))).alias("rank"))
    both = F.filter(F.array(F.when(is_high, high), F.when(is_low, low)), lambda x: x.isNotNull())
    return d.select("symbol", "ts", F.explode(both).alias("x")).select("symbol", "ts", "x.type", "x.price", F.lit(left).alias("left"), F.lit(right).alias("right"), "x.rank")


SWING = "symbol string, ts long, type string, price double, left int, right int, rank int"


def swing_step(left: int, right: int, min_delta: float):
    """The swings whose right side a symbol's next bars fill; the state is its last left + right bars."""

    def step(state, pdf):
        held, out = list(state or []), []
        for symbol, ts, high, low in zip(pdf["symbol"], pdf["ts"].tolist(), pdf["high"].tolist(), pdf["low"].tolist(), strict=True):
            held.append([ts, high, low])
            if len(held) <= left + right:
                continue
            highs, lows, (at, h, x) = [b[1] for b in held], [b[2] for b in held], held[left]
            span = max(1e-9, max(highs) - min(lows))
            rank = lambda below: min(sum(below[:left]), sum(below[left + 1 :]))
            if h >= max(highs) and h - min(lows) >= min_delta * span:
                out.append((symbol, at, "HIGH", h, left, right, rank([y < h for y in highs])))
            if x <= min(lows) and max(highs) - x >= min_delta * span:
                out.append((symbol, at, "LOW", x, left, right, rank([y > x for y in lows])))
            held.pop(0)
        return held, pd.DataFrame(out, columns=[c.split()[0] for c in SWING.split(", ")])

    return step


def regime_features(df: DataFrame, window_ms: int, true_range: str = "reference") -> DataFrame:
    """By tumbling window: rv, the deviation of log returns (two at least), and trend, |sum of DM+ - sum of DM-| / sum of TR.

    Nothing is carried from one window to the next. true_range: "reference" is high - low; "wilder" takes the previous close in.
    """
    start = (F.floor(F.col("ts") / window_ms) * window_ms).cast("long")
    w = Window.partitionBy("symbol", "start").orderBy("ts")
    prev = lambda c: F.lag(c).over(w)
    d = df.withColumn("start", start)
    up, down = F.col("high") - prev("high"), prev("low") - F.col("low")
    tr = F.col("high") - F.col("low")
    if true_range == "wilder":
        tr = F.greatest(tr, F.abs(F.col("high") - prev("close")), F.abs(F.col("low") - prev("close")))
    ok = (F.col("close") > 0) & (prev("close") > 0)
    d = d.select("symbol", "start", "ts", F.when(ok, F.log(F.col("close") / prev("close"))).alias("r"), F.when((up > down) & (up > 0), up).otherwise(0.0).alias("dp"), F.when((down > up) & (down > 0), down).otherwise(0.0).alias("dm"), F.when(prev("close").isNotNull(), tr).otherwise(0.0).alias("tr"))
    g = d.groupBy("symbol", "start").agg(F.count("r").alias("n"), F.stddev_pop("r").alias("sd"), F.sum("dp").alias("dp"), F.sum("dm").alias("dm"), F.sum("tr").alias("tr"), F.max("ts").alias("last"))
    return g.select("symbol", F.greatest(F.col("start") + window_ms, F.col("last")).alias("ts_end"), F.when(F.col("n") >= 2, F.col("sd")).otherwise(0.0).alias("rv"), F.when(F.col("tr") > 0, F.abs(F.col("dp") - F.col("dm")) / F.col("tr")).otherwise(0.0).alias("trend"))


def regime_class(features: DataFrame, high_vol: float, low_vol: float, trend_on: float, trend_off: float) -> DataFrame:
    """HIGHVOL, LOWVOL, TREND, MEANREV or CHAOS, the first that holds; a row where it changes."""
    label = F.when(F.col("rv") >= high_vol, "HIGHVOL").when(F.col("rv") <= low_vol, "LOWVOL").when(F.col("trend") >= trend_on, "TREND").when(F.col("trend") <= trend_off, "MEANREV").otherwise("CHAOS")
    w = Window.partitionBy("symbol").orderBy("ts_end")
    d = features.withColumn("regime", label).withColumn("before", F.lag("regime").over(w))
    return d.where(F.col("before").isNull() | (F.col("before") != F.col("regime"))).drop("before")
