"""Mixing of sources to target weights [12]: a multivariate-hypergeometric splitting tree over blocks.

A source's documents are put in a random order, as often as the mix takes them; this stream, cut at its target, is split into blocks
of BLOCK words, the last of which may be shorter. The block counts of all sources are the quotas of the tree's root, which stands for
all output shards. Each node halves its shards, and what goes to the left is one multivariate-hypergeometric draw from its
quotas: source by source, conditional on those before. Leaves are shards, with exact quotas and a range of each source's
block ranks. Blocks are ranked by a hash, so ranges are disjoint draws of permuted blocks; within a shard their pieces
are shuffled once more. Everything is drawn from hashes of a seed, so reruns agree.

DataFrame functions throughout. No source is sorted in one task: running sums in hash order go over hash ranges first.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm import common

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: Words of the mix, and the most of one source, as parts of what there is.
SHARE, MOST = 1.5, 2
#: Words of a block; blocks of a shard, about.
BLOCK, SHARD_BLOCKS = 1 << 14, 64
#: Rows of a hash range in running sums, about.
RANGE_ROWS = 50_000
#: Sources up to which their table is broadcast; with more, it is joined by shuffling.
BROADCAST_SOURCES = 10_000
#: Steps of the tree after which its nodes are dealt out.
DEAL = 8


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """row (its number), doc_id, source, size and a hash, by which a source's documents are ordered."""
    text = docs[text_col].cast("string")
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.monotonically_increasing_id().alias("row"), docs[id_col].cast("long").alias("doc_id"), docs[source_col].cast("string").alias("source"), size.alias("size"), F.xxhash64(docs[id_col].cast("long"), text).alias("text_hash"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Of source and size (any rows): place (from 0), source, source_size and target.

    Sources go by code point, null last. A target is the level times the weight, but at most `most` times the size; the level is that at
    which targets add up to the share of all sizes. In the order of most * size / weight the sources that are cut come
    first, so running sums give the level that each would see. One row a source.
    """
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    each = each.withColumn("place", place).withColumn("weight", weight).withColumn("cap", (most * F.col("source_size")).cast("double"))
    up = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before, whole = up.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    sums = each.withColumns({"cut": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "gone": F.coalesce(F.sum("weight").over(before), F.lit(0.0)), "weights": F.sum("weight").over(whole), "words": (share * F.sum("source_size").over(whole))})
    sums = sums.withColumn("level", (F.col("words") - F.col("cut")) / (F.col("weights") - F.col("gone"))).withColumn("free", F.col("cap") > F.col("level") * F.col("weight"))
    level = F.min_by(F.when(F.col("free"), F.col("level")), F.when(F.col("free"), F.struct(F.col("cap") / F.col("weight"), F.col("place")))).over(whole)
    return sums.withColumn("at", level).select("place", "source", "source_size", F.when(F.col("at").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("at") * F.col("weight"))).alias("target"))


def uniform(*key) -> Column:
    """From 0 to below 1, by a hash."""
    return F.shiftrightunsigned(F.xxhash64(*key), 11).cast("double") * F.lit(2.0**-53)


def log_factorial(n: Column) -> Column:
    """Exact factorials up to 15, Stirling's series beyond."""
    x = n.cast("double")
    series = (x + 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return F.when(n < 16, F.log(F.factorial(F.least(n, F.lit(15)).cast("int")).cast("double"))).otherwise(series)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def hypergeometric(total: Column, good: Column, drawn: Column, u: Column) -> Column:
    """How many of `drawn` from `total`, `good` of which count, count: the value at u of the distribution, summed from its mode outwards."""
    given = F.struct(total.alias("total"), good.alias("good"), drawn.alias("drawn"), u.alias("u"), F.greatest(F.lit(0).cast("long"), drawn + good - total).alias("low"), F.least(drawn, good).alias("high"))
    usual = lambda v: F.floor((v["drawn"] + 1.0) * (v["good"] + 1.0) / (v["total"] + 2.0)).cast("long")
    return let(given, lambda v: let(F.least(v["high"], F.greatest(v["low"], usual(v))), lambda mode: _from_mode(v, mode)))


def _from_mode(v: Column, mode: Column) -> Column:
    total, good, drawn, low, high = (v[c] for c in ("total", "good", "drawn", "low", "high"))
    choose = lambda n, k: log_factorial(n) - log_factorial(k) - log_factorial(n - k)
    at_mode = F.exp(choose(good, mode) + choose(total - good, drawn - mode) - choose(total, drawn))
    spread = F.sqrt(drawn.cast("double") * good / F.greatest(total, F.lit(1)) * (total - good) / F.greatest(total, F.lit(1)))
    steps = F.least(F.greatest(high - mode, mode - low), (12 * spread + 30).cast("long"))

    def step(a: Column, d: Column) -> Column:
        x, y = (mode + d - 1).cast("double"), (mode - d + 1).cast("double")
        up = F.when(mode + d <= high, a["up"] * (good - x) * (drawn - x) / ((x + 1) * (total - good - drawn + x + 1))).otherwise(0.0)
        down = F.when(mode - d >= low, a["down"] * y * (total - good - drawn + y) / ((good - y + 1) * (drawn - y + 1))).otherwise(0.0)
        found = lambda p: F.when(a["u"] < p["up"], mode + d).when(a["u"] < p["up"] + p["down"], mode - d)
        after = let(F.struct(up.alias("up"), down.alias("down")), lambda p: F.struct((a["u"] - p["up"] - p["down"]).alias("u"), p["up"].alias("up"), p["down"].alias("down"), found(p).alias("found")))
        return F.when(a["found"].isNotNull(), a).otherwise(after)

    def walk(p: Column) -> Column:
        start = F.struct((v["u"] - p).alias("u"), p.alias("up"), p.alias("down"), F.when(v["u"] < p, mode).alias("found"))
        return F.aggregate(let(steps, lambda n: F.when(n >= 1, F.sequence(F.lit(1).cast("long"), n)).otherwise(F.array().cast("array<bigint>"))), start, step, lambda a: a["found"])

    return F.coalesce(let(at_mode, walk), mode)


def split_tree(quotas: DataFrame, n_blocks: int, n_shards: int, seed: int) -> DataFrame:
    """Of place and blocks (one row a source): shard, place, first (rank of the first block) and n, for each shard and source with blocks there.

    Shards differ by one block at most. A node is a range of shards with quotas and first ranks of all sources; its children are made in
    its row, so the tree takes no shuffle, except that its nodes are dealt out after DEAL steps.
    """
    each = quotas.agg(F.array_sort(F.collect_list(F.struct(F.col("place").cast("long").alias("place"), F.lit(0).cast("long").alias("first"), F.col("blocks").cast("long").alias("n")))).alias("own"))
    nodes = each.select(F.lit(0).cast("long").alias("lo"), F.lit(n_shards).cast("long").alias("hi"), "own")
    upto = lambda shard: ((shard * n_blocks - shard * n_blocks % n_shards) / n_shards).cast("long")
    for depth in range(max(0, math.ceil(math.log2(n_shards))) if n_shards else 0):
        if depth == DEAL:
            nodes = nodes.repartition("lo")
        lo, hi = F.col("lo"), F.col("hi")
        mid = F.floor((lo + hi) / 2).cast("long")
        start = F.struct((upto(hi) - upto(lo)).alias("total"), (upto(mid) - upto(lo)).alias("drawn"), F.array().cast("array<bigint>").alias("left"))

        def draw(a: Column, x: Column) -> Column:
            k = hypergeometric(a["total"], x["n"], a["drawn"], uniform(F.lit(seed), F.col("lo"), F.col("hi"), x["place"]))
            return let(k, lambda k: F.struct((a["total"] - x["n"]).alias("total"), (a["drawn"] - k).alias("drawn"), F.concat(a["left"], F.array(k)).alias("left")))

        left = F.when(hi - lo > 1, F.aggregate("own", start, draw, lambda a: a["left"]))
        split = nodes.withColumn("mid", mid).withColumn("left", left)
        part = lambda n, first: F.zip_with("own", "left", lambda x, k: F.struct(x["place"].alias("place"), first(x, k).alias("first"), n(x, k).alias("n")))
        node = lambda lo, hi, own: F.struct(F.col(lo).alias("lo"), F.col(hi).alias("hi"), own.alias("own"))
        both = F.array(node("lo", "mid", part(lambda x, k: k, lambda x, k: x["first"])), node("mid", "hi", part(lambda x, k: x["n"] - k, lambda x, k: x["first"] + k)))
        nodes = split.select(F.explode(F.when(F.col("left").isNull(), F.array(node("lo", "hi", F.col("own")))).otherwise(both)).alias("node")).select("node.*")
    return nodes.select(F.col("lo").alias("shard"), F.explode("own").alias("x")).select("shard", "x.place", "x.first", "x.n").where("n > 0")


def running(rows: DataFrame, group: str, h: str, value: Column, n_rows: int, name: str) -> DataFrame:
    """rows with the sum of the value over those before, in the order of the hash h within the group, as column name.

    Hash ranges are summed first, so however many rows a group has, a task sorts a range of RANGE_ROWS or so. Rows with one hash keep together.
    """
    bits = max(0, min(40, math.ceil(math.log2(max(1, n_rows / RANGE_ROWS)))))
    cut = rows.withColumn("_range", F.shiftrightunsigned(F.col(h), 64 - bits) if bits else F.lit(0).cast("long")).withColumn("_value", value)
    sums = cut.groupBy(group, "_range").agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(group, "_range").orderBy(F.shiftrightunsigned(F.col(h), 1), F.col(h), *(["row"] if "row" in rows.columns else [])).rowsBetween(Window.unboundedPreceding, -1)
    return cut.join(sums, [group, "_range"]).withColumn(name, F.col("_before") + F.coalesce(F.sum("_value").over(inside), F.lit(0))).drop("_range", "_value", "_before")


def mix(docs: DataFrame, seed: int = 1, block: int = BLOCK, shard_blocks: int = SHARD_BLOCKS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """Two tables. Documents: row, doc_id, source, size, source_size and target. Pieces: row, shard, position (from 0 within the shard), start and words.

    A piece is a run of a document's words that lies in one block. Pieces of a source add up to its target, rounded to a whole word; a
    document is taken whole as often as the mix passes over its source, once more or not at all beyond, and in part only where the target ends.
    A null, empty or blank text has size 0 and no pieces, and so has a source without words. A null source is one source, the last.
    Null ids stay; rows that repeat an id or a text are documents of their own. Other columns are not read. Empty tables give empty tables.
    """
    docs_, _ = common.written(sized(docs, id_col, text_col, source_col), "sized")
    sources, _ = common.written(targets(docs_), "sources")
    sources = sources.withColumn("words", F.least(F.floor(F.col("target") + 0.5).cast("long"), MOST * F.col("source_size"))).withColumn("blocks", F.ceil(F.col("words") / block).cast("long"))
    n_docs, (n_sources, n_blocks) = docs_.count(), sources.agg(F.count("*"), F.coalesce(F.sum("blocks"), F.lit(0))).first()
    few = F.broadcast(sources) if n_sources <= BROADCAST_SOURCES else sources
    found = docs_.join(few, docs_["source"].eqNullSafe(sources["source"])).select("row", "doc_id", docs_["source"], "size", "source_size", "target", "place", "words", F.xxhash64(F.lit(seed), "text_hash").alias("h"))
    found, _ = common.written(found, "documents")
    n_shards = -(-n_blocks // shard_blocks)
    ranges, _ = common.written(split_tree(sources.where("blocks > 0"), n_blocks, n_shards, seed), "tree")

    numbered = sources.where("blocks > 0").select("place", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    ranked = running(numbered.withColumn("h", F.xxhash64(F.lit(seed + 1), "place", "block")), "place", "h", F.lit(1).cast("long"), n_blocks, "rank")
    dealt = ranges.select("shard", "place", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("rank"))
    shards = ranked.select("place", "rank", "block").join(dealt, ["place", "rank"]).select("place", "block", "shard")

    streams = running(found.where("size > 0 and words > 0"), "place", "h", F.col("size"), n_docs, "at")
    turns = F.transform(F.sequence(F.lit(0), F.lit(MOST - 1)), lambda p: F.struct((F.col("at") + p * F.col("source_size")).alias("a"), F.least(F.col("at") + p * F.col("source_size") + F.col("size"), F.col("words")).alias("b")))
    runs = streams.select("row", "place", F.explode(F.filter(turns, lambda x: x["a"] < x["b"])).alias("x"))
    runs = runs.select("row", "place", "x.a", "x.b", F.explode(F.sequence(F.floor(F.col("x.a") / block).cast("long"), F.floor((F.col("x.b") - 1) / block).cast("long"))).alias("block"))
    start = F.greatest(F.col("a"), F.col("block") * block)
    pieces = runs.select("row", "place", "block", (start - F.col("a")).alias("start"), (F.least(F.col("b"), (F.col("block") + 1) * block) - start).alias("words")).join(shards, ["place", "block"])
    position = F.row_number().over(Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed + 2), "place", "block", "start", "row"), "row", "start")) - 1
    return found.select("row", "doc_id", "source", "size", "source_size", "target"), pieces.select("row", "shard", position.cast("long").alias("position"), "start", "words")


def taken(documents: DataFrame, pieces: DataFrame) -> DataFrame:
    """The documents with the words that the mix takes of each."""
    sums = pieces.groupBy("row").agg(F.sum("words").alias("taken"))
    return documents.join(sums, "row", "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("long"))).drop("row")
