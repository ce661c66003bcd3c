"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm import common


def components(edges: DataFrame) -> tuple[DataFrame, str | None]:
    """Of edges (a, b): id and label, the smallest id reachable. Ids without an edge aren't listed.

    Large and small stars in turn: first every larger neighbour, then every smaller one is tied to the
    smallest neighbour, until nothing changes. Rounds grow with the logarithm of the longest path. Each
    round's edges are written in the shared folder, and minima are taken before anything is joined.
    """
    e = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    spark = edges.sparkSession
    e, path = common.written(e, "edges")
    mark = _mark(e)
    while mark[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        after, after_path = common.written(small.select("x.*").where("u != v").distinct(), "edges")
        after_mark = _mark(after)
        common.remove(spark, path)
        e, path = after, after_path
        if after_mark == mark:
            break
        mark = after_mark
    labels = e.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("id"), "label")
    return labels.union(e.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct()), path


def _mark(e: DataFrame) -> tuple:
    """The number of edges and sums that change with them."""
    x = F.xxhash64("u", "v")
    return tuple(e.agg(F.count("*"), F.sum(F.shiftright(x, 20)), F.sum(x.bitwiseAND(0xFFFFF))).first())
