"""Running values of keys of any size: over chunks of a key's order first, then over the rows of a chunk.

No task gets all rows of a key: rows are dealt by key and chunk, and only one row for each chunk by key. A chunk is any value that
does not fall along the order, so rows need no rank beforehand. What comes before a chunk goes to it as a row of its own, by a union, so
each step deals rows once. Null keys are a key of their own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.operators.folds import in_order
from marketloom.session import extended

#: Rows of a chunk, where a key's rows are numbered.
CHUNK = 10_000


def by_seq(column: str = "seq") -> Column:
    """Chunks of rows that are numbered within their key."""
    return F.floor(F.col(column) / CHUNK).cast("long")


def attached(rows: DataFrame, more: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """rows with the columns of more, which has one row for each value of on; nulls are equal."""
    there = more.withColumnsRenamed({c: f"_on_{c}" for c in on})
    return rows.join(there, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on]), how).drop(*[f"_on_{c}" for c in on])


def carried(rows: DataFrame, carry: DataFrame) -> DataFrame:
    """rows and, with _own 0 in place of 1, what is carried into their chunks: chunks get it in the one shuffle that deals their rows."""
    return rows.withColumn("_own", F.lit(1)).unionByName(carry.withColumn("_own", F.lit(0)), allowMissingColumns=True)


def running(rows: DataFrame, key: list[str], chunk: Column, order: list, sums: dict[str, Column], totals: dict[str, str] | None = None) -> DataFrame:
    """rows with sums of these values over their key's rows so far, themselves included, and column _chunk; totals names columns for the key's whole sums."""
    names = {name: f"_v{i}" for i, name in enumerate(sums)}
    d = rows.withColumn("_chunk", chunk).withColumns({names[name]: value for name, value in sums.items()})
    each = d.groupBy(*key, "_chunk").agg(*[F.sum(v).alias(v) for v in names.values()])
    before, whole = Window.partitionBy(*key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*key)
    carry = each.select(*key, "_chunk", *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(v) for v in names.values()], *[F.sum(names[k]).over(whole).alias(f"_t{name}") for k, name in (totals or {}).items()])
    inside = Window.partitionBy(*key, "_chunk").orderBy("_own", *order).rowsBetween(Window.unboundedPreceding, 0)
    d = carried(d, carry).withColumns({name: F.sum(v).over(inside) for name, v in names.items()} | {name: F.first(f"_t{name}").over(inside) for name in (totals or {}).values()})
    return d.where("_own = 1").drop("_own", *names.values(), *[f"_t{name}" for name in (totals or {}).values()])


def numbered(rows: DataFrame, key: list[str], chunk: Column, order: list[str], name: str = "seq") -> DataFrame:
    """rows with their place among their key's, from 1, in column name, which the order may hold too."""
    return running(rows, key, chunk, order, {"_place": F.lit(1).cast("long")}).withColumn(name, F.col("_place")).drop("_place", "_chunk")


def reflected(rows: DataFrame, key: list[str], chunk: Column, order: list, value: Column, zero: Column) -> DataFrame:
    """rows with the least of zero and the running sums of a value, up to the row (low) and before it (before)."""
    of_rows = Window.partitionBy(*key, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = rows.withColumn("_chunk", chunk).withColumn("_v", value)
    over = Window.partitionBy(*key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    each = d.withColumn("_net", F.sum("_v").over(of_rows)).groupBy(*key, "_chunk").agg(F.sum("_v").alias("_sum"), F.min("_net").alias("_least"))
    each = each.withColumn("_start", F.coalesce(F.sum("_sum").over(over), zero))
    carry = each.select(*key, "_chunk", F.col("_start").alias("_v"), F.least(zero, F.min(F.col("_start") + F.col("_least")).over(over)).alias("_past"))
    inside = Window.partitionBy(*key, "_chunk").orderBy("_own", *order)
    so_far, earlier = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(Window.unboundedPreceding, -1)
    d = carried(d, carry).withColumns({"_net": F.sum("_v").over(so_far), "_past": F.first("_past").over(so_far)})
    d = d.withColumn("_net", F.when(F.col("_own") == 1, F.col("_net"))).withColumn("before", F.least("_past", F.min("_net").over(earlier)))
    return d.where("_own = 1").withColumn("low", F.least("before", "_net")).drop("_v", "_net", "_past", "_chunk", "_own")


def following(rows: DataFrame, key: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """rows, which have _chunk, with the value of their key's next row (null for the last)."""
    each = rows.groupBy(*key, "_chunk").agg(F.min_by(value, F.struct(*order)).alias("_first"))
    carry = each.select(*key, "_chunk", F.lead("_first").over(Window.partitionBy(*key).orderBy("_chunk")).alias(value))
    inside = Window.partitionBy(*key, "_chunk").orderBy(F.desc("_own"), *order)
    return carried(rows, carry).withColumn(name, F.lead(value).over(inside)).where("_own = 1").drop("_own")


def affine(rows: DataFrame, key: list[str], chunk: Column, order: list[str], steps: dict[str, tuple[Column, Column]]) -> DataFrame:
    """rows with x of each name, where a row's (a, b) make x = a * x + b of the x of its key's row before (0 before the first).

    Steps of this kind compose to one of the same kind. So each chunk is walked by itself, which gives each row's step from the chunk's
    start; a key's chunks are walked by their last rows; and a row's x is its step from what its chunk starts with. Doubles,
    in another order of operations than row by row.
    """
    names = list(steps)
    pairs = [(f"_a{i}", f"_b{i}") for i in range(len(names))]
    d = rows.withColumn("_chunk", chunk).withColumns({c: v.cast("double") for pair, values in zip(pairs, steps.values(), strict=True) for c, v in zip(pair, values, strict=True)})

    def compose(state, pdf):
        state, pdf = state or [[1.0, 0.0] for _ in pairs], pdf.copy()
        for (a, b), s in zip(pairs, state, strict=True):
            (p, q), out = s, []
            for x, y in zip(pdf[a].tolist(), pdf[b].tolist(), strict=True):
                p, q = x * p, x * q + y
                out.append((p, q))
            s[:] = p, q
            pdf[a], pdf[b] = [x[0] for x in out], [x[1] for x in out]
        return state, pdf

    def begin(state, pdf):
        state, starts = state or [0.0] * len(pairs), []
        for values in zip(*(pdf[c].tolist() for pair in pairs for c in pair), strict=True):
            starts.append(list(state))
            state = [values[2 * i] * x + values[2 * i + 1] for i, x in enumerate(state)]
        pdf = pdf[[*key, "_chunk"]].copy()
        for i in range(len(pairs)):
            pdf[f"_x{i}"] = [s[i] for s in starts]
        return state, pdf

    parts = in_order(d, [*key, "_chunk"], order, compose, d.schema)
    last = parts.groupBy(*key, "_chunk").agg(F.max_by(F.struct(*[c for pair in pairs for c in pair]), F.struct(*order)).alias("_last")).select(*key, "_chunk", "_last.*")
    schema = extended(last.select(*key, "_chunk").schema, ", ".join(f"_x{i} double" for i in range(len(pairs))))
    d = attached(parts, in_order(last, key, ["_chunk"], begin, schema), [*key, "_chunk"])
    return d.withColumns({name: F.col(a) * F.col(f"_x{i}") + F.col(b) for i, (name, (a, b)) in enumerate(zip(names, pairs, strict=True))}).drop("_chunk", *[c for pair in pairs for c in pair], *[f"_x{i}" for i in range(len(pairs))])
