"""Approximate nearest neighbours [7]: randomly rotated one-bit codes with error bounds, then exact reranking.

A unit vector, rotated at random, is kept as the signs of its components, packed, and two numbers: its norm and the inner product of
the vector with its code. From these the inner product with a query is estimated without bias; the error's deviation is
sqrt((1 - f * f) / (f * f * (d - 1))) of the vector's and the query's norms, and BOUND of these are allowed for. The vectors of the best
estimates get exact scores first; any other is reranked with its original components only if its upper bound reaches the k-th of these.

Vectors are encoded once and stored in the shared folder, codes beside originals, in blocks. A block stays in one task; the
queries, packed by hundreds, come to it one pack after the other. So each vector moves once, what moves more often is the smaller side, and
a task holds one block and one pack, however many there are of either.

Equal vectors become one class with its smallest ids, as many as a result can hold. A query gets its best few of each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm import common

#: Of the estimate's error, in its own deviations.
BOUND = 1.5
#: For each result so many vectors of the best estimates set the limit for all others.
PILOT = 4
#: Vectors in a block at most (on average), and at least where there are cores for more blocks; queries in a pack.
BLOCK, SMALL_BLOCK, PACK = 65_536, 4_096, 256
#: Vectors of a block that are estimated in one go.
STEP = 2_048
SEED = 7


_turns: dict[int, np.ndarray] = {}


def rotation(d: int) -> np.ndarray:
    """The same in every process, made once in each."""
    if d not in _turns:
        q, r = np.linalg.qr(np.random.default_rng(SEED + d).standard_normal((d, d)))
        _turns.clear()
        _turns[d] = q * np.sign(np.diag(r))
    return _turns[d]


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the rows of x: packed sign bits, norms, and each unit vector's inner product with its code."""
    norm = np.linalg.norm(x, axis=1)
    turned = (x @ rotation(x.shape[1])) / norm[:, None]
    return np.packbits(turned > 0, axis=1), norm, np.abs(turned).sum(axis=1) / np.sqrt(x.shape[1])


class Block:
    """Vectors with their codes, and a search for a pack of queries at a time. ids ascend."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, bits: np.ndarray, norm: np.ndarray, f: np.ndarray):
        self.ids, self.x, self.bits = ids, x, bits
        d = x.shape[1]
        self.scale = (norm / (f * np.sqrt(d))).astype(np.float32)
        self.error = (BOUND * norm * np.sqrt(np.maximum(0.0, 1 - f**2) / (f**2 * max(1, d - 1)))).astype(np.float32)
        self.reranked = 0

    def estimates(self, queries: np.ndarray) -> np.ndarray:
        """Of the inner products, a row a query."""
        turned = (queries @ rotation(queries.shape[1])).astype(np.float32)
        out = np.empty((len(queries), len(self.ids)), np.float32)
        for a in range(0, len(self.ids), STEP):
            signs = np.unpackbits(self.bits[a : a + STEP], axis=1, count=self.x.shape[1]).astype(np.float32) * 2 - 1
            np.multiply(turned @ signs.T, self.scale[a : a + STEP], out=out[:, a : a + STEP])
        return out

    def search(self, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query numbers, ids and exact scores of the k best of each query, where the bounds hold."""
        rows, near, scores = [], [], []
        some = PILOT * k
        for q, (own, guess) in enumerate(zip(queries, self.estimates(queries), strict=True)):
            limit = -np.inf
            if len(guess) > some:
                limit = np.partition(self.x[np.argpartition(guess, -some)[-some:]] @ own, -k)[-k] - 1e-5
            chosen = np.flatnonzero(guess + np.float32(np.linalg.norm(own)) * self.error >= limit)
            self.reranked += len(chosen)
            score = self.x[chosen] @ own
            if len(score) > k:
                good = score >= np.partition(score, -k)[-k]
                chosen, score = chosen[good], score[good]
            order = np.lexsort((chosen, -score))[:k]
            rows.append(np.full(len(order), q))
            near.append(self.ids[chosen[order]])
            scores.append(score[order])
        return np.concatenate(rows), np.concatenate(near), np.concatenate(scores)


def classes_of(vectors: DataFrame, keep: int) -> DataFrame:
    """Of valid (id, v): class (its smallest id), v and its keep smallest ids. Copies are merged in tasks first."""
    schema = pa.schema([("v", pa.list_(pa.float64())), ("ids", pa.list_(pa.int64()))])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[bytes, list] = {}
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.setdefault((np.array(v) + 0.0).tobytes(), []).append(i)
            yield common.rows(schema, [np.frombuffer(b) for b in found], [sorted(set(ids))[:keep] for ids in found.values()])

    few = lambda c: F.slice(F.array_distinct(F.array_sort(F.flatten(F.collect_list(c)))), 1, keep)
    some = vectors.mapInArrow(merge, "v array<double>, ids array<long>").withColumn("share", F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(64)))
    some = some.groupBy("v", "share").agg(few("ids").alias("ids")).groupBy("v").agg(few("ids").alias("ids"))
    return some.select(F.col("ids")[0].alias("class"), "v", "ids")


VECTORS = pa.schema([("d", pa.int32()), ("part", pa.int64()), ("ids", pa.binary()), ("v", pa.binary()), ("bits", pa.binary()), ("norm", pa.binary()), ("f", pa.binary())])
VECTORS_DDL = "d int, part long, ids binary, v binary, bits binary, norm binary, f binary"


def packs(classes: DataFrame, size: int) -> DataFrame:
    """Of (class, v): rows of at most size vectors of one dimension each, encoded: ids, originals, codes, norms and code products."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        part = TaskContext.get().partitionId() << 32

        def closed(d: int) -> pa.RecordBatch:
            nonlocal part
            ids, x = np.array([i for i, _ in held[d]], np.int64), np.array([v for _, v in held.pop(d)])
            bits, norm, f = encode(x)
            part += 1
            return common.rows(VECTORS, [d], [part], [ids.tobytes()], [x.tobytes()], [bits.tobytes()], [norm.tobytes()], [f.tobytes()])

        for batch in batches:
            flat, ends = batch.column(1).flatten().to_numpy(zero_copy_only=False), np.cumsum(batch.column(1).value_lengths().to_numpy(zero_copy_only=False))
            for i, v in zip(batch.column(0).to_pylist(), np.split(flat, ends[:-1]), strict=True):
                own = held.setdefault(len(v), [])
                own.append((i, v))
                if len(own) >= size:
                    yield closed(len(v))
        for d in list(held):
            yield closed(d)

    return classes.select("class", "v").mapInArrow(run, VECTORS_DDL)


def found(stored: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Of packs of all vectors and packs of queries: query, class, score, the k best of each query in each block.

    Packs of vectors are dealt to blocks; each pack of queries goes to all blocks of its dimension, whose number comes from a count.
    In a task a block's own packs lie before the queries that come to it.
    """
    cores = stored.sparkSession.sparkContext.defaultParallelism
    sizes = stored.groupBy("d").agg((F.sum(F.octet_length("ids")) / 8).alias("n"))
    n = F.greatest(F.ceil(F.col("n") / BLOCK), F.least(F.lit(cores), F.ceil(F.col("n") / SMALL_BLOCK)))
    sizes, _ = common.written(sizes.select("d", n.cast("int").alias("blocks")), "block_numbers")
    blocks = sizes.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0]
    own = stored.join(sizes, "d").select("d", F.pmod(F.xxhash64("part"), F.col("blocks")).cast("int").alias("b"), F.lit(0).alias("kind"), "ids", "v", "bits", "norm", "f")
    come = queries.join(sizes, "d").select("d", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"), F.lit(1).alias("kind"), "ids", "v", *[F.lit(None).cast("binary").alias(c) for c in ("bits", "norm", "f")])
    rows = own.unionByName(come).repartition(max(1, blocks), "d", "b").sortWithinPartitions("d", "b", "kind")
    schema = pa.schema([("query", pa.int64()), ("class", pa.int64()), ("score", pa.float64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, block = None, [], None
        for batch in batches:
            for r in range(batch.num_rows):
                d, b, kind, ids, v, bits, norm, f = (batch.column(c)[r].as_py() for c in range(8))
                if (d, b) != at:
                    at, held, block = (d, b), [], None
                ids, v = np.frombuffer(ids, np.int64), np.frombuffer(v).reshape(-1, d)
                if not kind:
                    held.append((ids, v, np.frombuffer(bits, np.uint8).reshape(len(ids), -1), np.frombuffer(norm), np.frombuffer(f)))
                    continue
                if block is None:
                    if not held:
                        continue
                    columns = [np.concatenate(x) for x in zip(*held, strict=True)]
                    order, held = np.argsort(columns[0]), []
                    block = Block(*(x[order] for x in columns))
                q, near, score = block.search(v, k)
                yield common.rows(schema, ids[q], near, score)

    return rows.mapInArrow(search, "query long, class long, score double")


def nearest(table: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Per query (rows whose id is divisible by every) its k nearest others: query_id, rank, id and score.

    Nearness is the largest inner product in double precision; ties go to the smaller id, and only vectors of one
    dimension are compared. Null, empty and zero vectors, ones with null or non-finite components, and rows without id take
    no part. Rows that repeat an id with the same vector count once; of an id's different vectors only the one
    with the least hash counts. An empty table gives an empty result.
    """
    common.ship(table.sparkSession)
    v = table[vec_col].cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = table.where(table[id_col].isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0)).select(table[id_col].cast("long").alias("id"), F.transform(v, lambda x: x + F.lit(0.0)).alias("v"))
    hashed = F.xxhash64("v")
    clash, _ = common.written(rows.groupBy("id").agg(F.min(hashed).alias("chosen"), F.max(hashed).alias("other")).where("chosen != other").select("id", "chosen"), "clashes")
    rows = rows.join(clash, "id", "left").where(F.col("chosen").isNull() | (hashed == F.col("chosen"))).select("id", "v")
    classes, _ = common.written(classes_of(rows, k + 1), "classes")
    asked = rows.where(F.pmod("id", F.lit(every)) == 0).distinct()
    asked, _ = common.written(asked.join(classes.select("v", "class"), "v").select(F.col("id").alias("query_id"), "class"), "queries")
    stored, _ = common.written(packs(classes, PACK), "vectors")
    queries, _ = common.written(packs(classes.join(asked.select("class").distinct(), "class", "left_semi"), PACK).select("d", "ids", "v"), "query_packs")
    top = Window.partitionBy("query").orderBy(F.desc("score"), "class")
    best = found(stored, queries, k + 1).withColumn("r", F.row_number().over(top)).where(F.col("r") <= k + 1)
    named = best.join(classes.select("class", "ids"), "class").join(asked.withColumnRenamed("class", "query"), "query")
    each = named.select("query_id", "score", F.explode("ids").alias("id")).where("id != query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
