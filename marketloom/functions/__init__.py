"""Scalar helpers and pandas functions for SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def norm01(x: Column, lo: float, hi: float) -> Column:
    """x between lo and hi as 0 to 1, clamped; 0 if hi is not above lo."""
    return F.lit(0.0) if hi <= lo else F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - lo) / (hi - lo)))


def indicators_map(row: Column, names: list[str]) -> Column:
    """A struct's named fields as a map, nulls left out."""
    return F.map_filter(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[row[n].cast("double") for n in names])), lambda k, v: v.isNotNull())


def ema_series(p: int):
    """A pandas function for series that lie in one batch: the exponential mean from the first value on."""

    @F.pandas_udf("double")
    def ema(values: pd.Series) -> pd.Series:
        return values.ewm(alpha=2 / (p + 1), adjust=False).mean()

    return ema


def register(spark: SparkSession) -> None:
    """SQL functions of this package."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION norm01(x DOUBLE, lo DOUBLE, hi DOUBLE) RETURNS DOUBLE RETURN CASE WHEN hi <= lo THEN 0D ELSE least(1D, greatest(0D, (x - lo) / (hi - lo))) END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION signed_qty(side STRING, qty DOUBLE) RETURNS DOUBLE RETURN CASE upper(side) WHEN 'BUY' THEN qty WHEN 'SELL' THEN -qty ELSE 0D END")
