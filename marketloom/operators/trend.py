"""Trend lines by Hough voting over sliding windows, what happens along them, and a summary by window."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.operators.folds import Step, in_order
from marketloom.operators.windows import cogrouped, sliding

LINE = "symbol string, window_start_ts long, window_end_ts long, time_span_ms long, price_range double, slope double, slope_norm double, intercept double, support double, score double, touches int, breakouts int, breakout_strength double, last_breakout_ts long, side string, data_start_ts long, data_end_ts long"
SUMMARY = "symbol string, ts long, alpha double, confidence double, phase string, direction string, breakout_direction string, last_breakout_ts long, breakout_recency double, breakout_strength double, lines_used int"
EVENT = "symbol string, window_end_ts long, slope double, intercept double, ts long, type string, distance double, price double, line_price double"
#: The angles of lines, in degrees, and the weights of a line's score.
ANGLES = (10.0, 170.0)
SCORE = {"votes": 0.45, "touches": 0.25, "strength": 0.20, "slope": 0.15, "false": -0.25}


def votes(t: np.ndarray, high: np.ndarray, low: np.ndarray, theta_bins: int, rho_bins: int, peak_weight: float, peaks: tuple | None = None) -> np.ndarray:
    """The (angle, offset) cells' votes. A bar votes by its high and low, a peak with more weight, and a quarter goes to the cells beside."""
    x = (t - t[0]) / max(1.0, float(t[-1] - t[0]))
    span = max(1e-9, high.max() - low.min())
    if peaks is None:
        ph, pl = np.zeros(len(t), bool), np.zeros(len(t), bool)
        ph[1:-1] = (high[1:-1] >= high[:-2]) & (high[1:-1] >= high[2:])
        pl[1:-1] = (low[1:-1] <= low[:-2]) & (low[1:-1] <= low[2:])
    else:
        ph, pl = peaks
    lo, hi = np.radians(ANGLES)
    theta = lo + (np.arange(theta_bins) + 0.5) * (hi - lo) / theta_bins
    points_x, points_y = np.concatenate([x, x]), np.concatenate([high - low.min(), low - low.min()]) / span
    weight = np.where(np.concatenate([ph, pl]), peak_weight, 1.0)
    width = 2 * np.sqrt(2.0) / rho_bins
    r = np.floor((points_x[:, None] * np.cos(theta) + points_y[:, None] * np.sin(theta) + np.sqrt(2.0)) / width).astype(np.int64)
    acc = np.zeros((theta_bins, rho_bins + 2))
    ok = (r >= 0) & (r < rho_bins)
    at = np.broadcast_to(np.arange(theta_bins), r.shape)
    w = np.broadcast_to(weight[:, None], r.shape)
    for shift, share in ((0, 1.0), (1, 0.25), (-1, 0.25)):
        np.add.at(acc, (at[ok], r[ok] + 1 + shift), w[ok] * share)
    return acc[:, 1:-1]


def picks(acc: np.ndarray, k: int) -> list[tuple[int, int]]:
    """Greedy: the k strongest cells, none near a stronger one; ties in cell order."""
    near_t, near_r = max(1, acc.shape[0] // 90), max(1, acc.shape[1] // 90)
    order = np.argsort(-acc, axis=None, kind="stable")
    order = order[: np.count_nonzero(acc > 0)]
    free, out = np.ones(acc.shape, bool), []
    for cell in order:
        t, r = divmod(int(cell), acc.shape[1])
        if free[t, r]:
            out.append((t, r))
            if len(out) == k:
                break
            free[max(0, t - near_t) : t + near_t + 1, max(0, r - near_r) : r + near_r + 1] = False
    return out


def along(t, high, low, close, slope: float, intercept: float, eps: float, span: float, persist_bars: int, false_bars: int, mode: str) -> dict:
    """A line's side, its touches, breakouts and false breaks, and the events.

    mode "corrected" counts consecutive bars beyond the line; "reference" counts crossings only, so a
    persistence above 1 never comes about.
    """
    line = slope * t + intercept
    near_high, near_low = int((np.abs(high - line) <= eps).sum()), int((np.abs(low - line) <= eps).sum())
    bias = float((close - line).mean())
    if near_high != near_low:
        resistance = near_high > near_low
    elif abs(bias) > eps / 4:
        resistance = bias < 0
    else:
        resistance = slope <= 0
    beyond, edge = (1, high) if resistance else (-1, low)
    spacing = t[1] - t[0] if len(t) > 1 else 0
    touches = breakouts = false_breaks = persist = last = 0
    strength, last_ts, began, broken, events = 0.0, -1, 0, False, []
    for k in range(len(t)):
        d, touch = close[k] - line[k], edge[k] - line[k]
        sign = 1 if d > eps else -1 if d < -eps else 0
        if abs(touch) <= eps:
            touches += 1
            events.append((t[k], "TOUCH", touch / eps, edge[k], line[k]))
            if broken:
                events.append((t[k], "THROWBACK", touch / eps, edge[k], line[k]))
            persist = 0
        else:
            crossed = sign == beyond and (mode == "corrected" and persist > 0 or last * beyond <= 0)
            persist = persist + 1 if crossed else 0
            if crossed and not broken and persist >= persist_bars:
                broken, began, last_ts = True, t[k], t[k]
                breakouts += 1
                events.append((t[k], "BREAKOUT", d / eps, close[k], line[k]))
            if broken:
                strength = max(strength, abs(d) / max(1e-9, span))
        if broken and sign * beyond <= 0 and t[k] - began <= false_bars * spacing:
            false_breaks += 1
            events.append((t[k], "FALSE_BREAK", d / eps, close[k], line[k]))
            broken = False
        last = sign
    return {"side": "RESISTANCE" if resistance else "SUPPORT", "touches": touches, "breakouts": breakouts, "false": false_breaks, "strength": strength, "last_ts": int(last_ts), "events": events}


def lines_of(pdf: pd.DataFrame, p: dict) -> list[dict]:
    """The trend lines of one window's bars, best first, near-equal ones once, each with its events."""
    if len(pdf) < 10:
        return []
    pdf = pdf.sort_values("ts", kind="stable")
    t, high, low, close = (pdf[c].to_numpy() for c in ("ts", "high", "low", "close"))
    peaks = (pdf["swing_high"].to_numpy(), pdf["swing_low"].to_numpy()) if "swing_high" in pdf else None
    length, span, floor = max(1.0, float(t[-1] - t[0])), max(1e-9, high.max() - low.min()), low.min()
    eps = p["touch_eps"] * span
    acc = votes(t, high, low, p["theta_bins"], p["rho_bins"], p["peak_weight"], peaks)
    lo, hi = np.radians(ANGLES)
    found = []
    for a, r in picks(acc, p["top_k"]):
        theta = lo + (a + 0.5) * (hi - lo) / p["theta_bins"]
        if abs(np.sin(theta)) < 1e-6:
            continue
        rho = -np.sqrt(2.0) + (r + 0.5) * 2 * np.sqrt(2.0) / p["rho_bins"]
        offset, tilt = rho / np.sin(theta), -np.cos(theta) / np.sin(theta)
        slope = span * tilt / length
        shift = -1 if p["mode"] == "corrected" else 1
        intercept = floor + span * (offset + shift * tilt * t[0] / length)
        e = along(t, high, low, close, slope, intercept, eps, span, p["persist_bars"], p["false_bars"], p["mode"])
        votes_share = acc[a, r] / acc.max()
        share = min(1.0, max(0.0, e["touches"] / (len(t) // 3)))
        score = SCORE["votes"] * votes_share + SCORE["touches"] * share + SCORE["strength"] * min(1.0, e["strength"]) + SCORE["slope"] * min(1.0, abs(slope) * length / span) + SCORE["false"] * min(1.0, e["false"] / 3)
        if e["touches"] >= p["min_touches"] and score >= p["min_score"]:
            found.append({"slope": slope, "intercept": intercept, "support": votes_share, "score": min(1.0, max(0.0, score)), "span": span, "length": int(length), "t0": int(t[0]), "t1": int(t[-1])} | e)
    found.sort(key=lambda x: -x["score"])
    kept: list[dict] = []
    for x in found:
        if not any(abs(k["slope"] - x["slope"]) < 1e-8 and abs(k["intercept"] - x["intercept"]) < 1e-3 for k in kept):
            kept.append(x)
    return kept


PARAMETERS = {"theta_bins": 180, "rho_bins": 256, "peak_weight": 3.0, "touch_eps": 0.12, "persist_bars": 1, "false_bars": 3, "top_k": 3, "min_score": 0.12, "min_touches": 0, "mode": "corrected"}


def _of_windows(bars: DataFrame, size_ms: int, slide_ms: int, swings: DataFrame | None, rows, schema: str, delay_ms: int, lateness: str) -> DataFrame:
    """The rows that each (symbol, window)'s trend lines give, by key and bars, which carry their swings if there are any."""
    columns = [c.split()[0] for c in schema.split(", ")]
    made = lambda key, pdf: pd.DataFrame(rows(key, pdf), columns=columns)
    used = bars.select("symbol", "ts", "high", "low", "close")
    def with_swings(key, pdf, points):
        flags = {f"swing_{kind.lower()}": pdf["ts"].isin(points.loc[points["type"] == kind, "ts"]) for kind in ("HIGH", "LOW")}
        return made(key, pdf.assign(**flags))

    if swings is None:
        return cogrouped(used, None, size_ms, slide_ms, lambda key, pdf, _: made(key, pdf), schema, delay_ms, lateness)
    return cogrouped(used, swings.select("symbol", "ts", "type"), size_ms, slide_ms, with_swings, schema, delay_ms, lateness)


def hough_lines(bars: DataFrame, size_ms: int, slide_ms: int, swings: DataFrame | None = None, delay_ms: int = 0, lateness: str = "1 minute", **changes) -> DataFrame:
    """Trend lines of each (symbol, window) with ten bars or more; swings replace the bars' own peaks.

    Streams send a window's lines once the watermark passes its end by delay_ms, which must cover what swings need to be known. A window's cells
    depend on its own range of times and prices, so its bars are held and vote when it closes; votes are not taken over from the window before.
    """
    p = PARAMETERS | changes

    def rows(key, pdf):
        return [(key[0], key[1], key[2], x["length"], x["span"], x["slope"], min(1.0, abs(x["slope"]) * x["length"] / x["span"]), x["intercept"], x["support"], x["score"], x["touches"], x["breakouts"], x["strength"], x["last_ts"], x["side"], x["t0"], x["t1"]) for x in lines_of(pdf, p)]

    return _of_windows(bars, size_ms, slide_ms, swings, rows, LINE, delay_ms, lateness)


def line_events(bars: DataFrame, size_ms: int, slide_ms: int, swings: DataFrame | None = None, delay_ms: int = 0, lateness: str = "1 minute", **changes) -> DataFrame:
    """TOUCH, BREAKOUT, FALSE_BREAK and THROWBACK events along the lines of each window; streams as in hough_lines."""
    p = PARAMETERS | changes

    def rows(key, pdf):
        return [(key[0], key[2], x["slope"], x["intercept"], *e) for x in lines_of(pdf, p) for e in x["events"]]

    return _of_windows(bars, size_ms, slide_ms, swings, rows, EVENT, delay_ms, lateness)


def fused(lines: DataFrame, tau_ms: float, softness: float, now_offset_ms: int = 0) -> DataFrame:
    """By (symbol, window end): alpha, confidence, recency and strength of its lines, blended with softmax weights over confidence."""
    clamp = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    broke = F.col("last_breakout_ts") > 0
    age = F.greatest(F.lit(0), F.col("window_end_ts") + now_offset_ms - F.col("last_breakout_ts"))
    d = lines.select(
        "symbol", F.col("window_end_ts").alias("ts"), "last_breakout_ts",
        F.when(F.col("slope") >= 0, 1).otherwise(-1).alias("dir"), clamp(F.col("slope_norm")).alias("s"), clamp(F.col("score")).alias("q"), F.when(F.col("breakouts") > 0, 1.0).otherwise(0.6).alias("wb"),
        F.when(broke, F.exp(-age / F.lit(max(1.0, tau_ms)))).otherwise(0.0).alias("rec"), clamp(F.col("breakout_strength")).alias("b"),
    )
    d = d.withColumn("a", F.col("dir") * F.col("s") * F.col("q") * F.col("wb") * (0.5 + 0.5 * F.col("b")) * F.when(F.col("last_breakout_ts") > 0, F.col("rec")).otherwise(1.0)).withColumn("c", clamp(F.col("q") * (0.5 + 0.5 * F.col("s")))).withColumn("w", F.exp(softness * F.col("c")))
    mean = lambda c: F.sum(F.col("w") * F.col(c)) / F.sum("w")
    return d.groupBy("symbol", "ts").agg(mean("a").alias("alpha"), clamp(mean("c")).alias("confidence"), F.max("last_breakout_ts").alias("last_breakout_ts"), F.max("rec").alias("breakout_recency"), clamp(mean("b")).alias("breakout_strength"), F.count("*").cast("int").alias("lines_used"))


def trend_summary(lines: DataFrame, tau_ms: float = 2 * 3_600_000.0, softness: float = 3.0, beta: float = 0.3, conf: float = 0.35, alpha: float = 0.15, enter: float = 0.6, leave: float = 0.3, now_offset_ms: int = 0) -> DataFrame:
    """One row for each (symbol, window end): smoothed alpha and confidence, phase with hysteresis, direction and breakout.

    Windows are blended set-wise; the recurrence over them takes a symbol's few numbers a window in order.
    """
    return in_order(fused(lines, tau_ms, softness, now_offset_ms), ["symbol"], ["ts"], phases(beta, conf, alpha, enter, leave), SUMMARY)


def phases(beta: float, conf: float, alpha: float, enter: float, leave: float) -> Step:
    """The recurrence over a symbol's blended windows; its state is smoothed alpha, smoothed confidence and phase."""

    def step(state, pdf):
        a, c, phase = state or (None, None, None)
        out = []
        for r in pdf.itertuples(index=False):
            a = r.alpha if a is None else (1 - beta) * a + beta * r.alpha
            c = r.confidence if c is None else max(c * (1 - beta), r.confidence)
            strong = c >= conf and abs(a) >= alpha
            if phase == "BREAKOUT" and r.breakout_recency >= leave or phase != "BREAKOUT" and r.breakout_recency >= enter and strong:
                now = "BREAKOUT"
            elif strong or c >= conf and a != 0 and phase in ("BREAKOUT", "PERSIST"):
                now = "PERSIST"
            else:
                now = "NONE"
            phase = now
            way = "STRONG_UP" if a > 0.3 else "WEAK_UP" if a > 0.1 else "SIDEWAYS" if a >= -0.1 else "WEAK_DOWN" if a >= -0.3 else "STRONG_DOWN"
            out_way = ("UP" if a >= 0 else "DOWN") if r.breakout_recency > 0.1 and r.last_breakout_ts > 0 else None
            out.append((r.symbol, r.ts, max(-1.0, min(1.0, a)), max(0.0, min(1.0, c)), phase, way, out_way, r.last_breakout_ts, r.breakout_recency, r.breakout_strength, r.lines_used))
        return (a, c, phase), pd.DataFrame(out, columns=[x.split()[0] for x in SUMMARY.split(", ")])

    return step


def line_votes(bars: DataFrame, size_ms: int, slide_ms: int, theta_bins: int = 36, rho_bins: int = 64) -> DataFrame:
    """The unweighted vote table in DataFrame functions: (symbol, window, angle, offset) and how many highs and lows fall on it."""
    key = ["symbol", "window_start_ts"]
    w = Window.partitionBy(*key)
    d = sliding(bars, size_ms, slide_ms)
    d = d.select(*key, "ts", "high", "low", F.min("ts").over(w).alias("t0"), F.max("ts").over(w).alias("t1"), F.min("low").over(w).alias("floor"), F.max("high").over(w).alias("top"), F.count("*").over(w).alias("n")).where("n >= 10")
    span = F.greatest(F.lit(1e-9), F.col("top") - F.col("floor"))
    d = d.select(*key, ((F.col("ts") - F.col("t0")) / F.greatest(F.lit(1.0), F.col("t1") - F.col("t0"))).alias("x"), F.explode(F.array((F.col("high") - F.col("floor")) / span, (F.col("low") - F.col("floor")) / span)).alias("y"))
    lo, hi = ANGLES
    d = d.withColumn("theta_bin", F.explode(F.sequence(F.lit(0), F.lit(theta_bins - 1))))
    theta = F.radians(lo + (F.col("theta_bin") + 0.5) * (hi - lo) / theta_bins)
    rho = F.floor((F.col("x") * F.cos(theta) + F.col("y") * F.sin(theta) + F.sqrt(F.lit(2.0))) / (2 * F.sqrt(F.lit(2.0)) / rho_bins))
    return d.withColumn("rho_bin", rho.cast("int")).where((F.col("rho_bin") >= 0) & (F.col("rho_bin") < rho_bins)).groupBy(*key, "theta_bin", "rho_bin").agg(F.count("*").alias("votes"))
