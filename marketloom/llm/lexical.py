"""Ranked lexical search [11]: sort-based accumulation of item-document-impact triples.

Each text is read once for a block of items: its term count and the frequencies of those terms that an item holds are
written as a sketch, which gives the corpus counts too (documents, terms, documents of a term). The sketches are then dealt
by ranges of documents. A task concatenates, for a run of its documents, the arrays of items that hold a matched term, packs
(item, document) into keys, sorts these by radix, adds equal keys up, and keeps each item's best in a heap. What
the ranges keep is ranked anew.

Every document is scored for every item with which it shares a term; nothing is pruned. Memory follows a run's matches
(MATCHES, or one document's) and the block (BLOCK pairs of item and term, or one item's).
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm import common

TOP = 10
#: Pairs of item and term that a block of items has, on average.
BLOCK = 1 << 18
#: Matches that are sorted at once.
MATCHES = 1 << 21
#: Bytes of a term: digits, letters and all beyond ASCII; capitals lower-cased, anything else a gap.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms(raw: bytes) -> list[bytes]:
    return raw.translate(_TERM_BYTES).split()


def weight(n: int, df: int) -> int:
    """A term's weight, of n documents of which df hold it."""
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def item_terms(items: DataFrame) -> DataFrame:
    """Of (item_id, text): each item's terms, once each."""
    schema = pa.schema([("item_id", pa.int64()), ("term", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches):
            held = [set(terms(x)) for x in common.texts(part.column(1))]
            ids = itertools.chain.from_iterable(itertools.repeat(i, len(x)) for i, x in zip(part.column(0).to_pylist(), held, strict=True))
            yield common.rows(schema, list(ids), list(itertools.chain.from_iterable(held)))

    return items.mapInArrow(run, "item_id long, term binary").distinct()


def sketch(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Of (doc_id, text): doc_id, n (terms with repeats), and the numbers and frequencies of its terms in the vocabulary. Texts without terms are left out."""
    lists = [("ids", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32()))]
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), *lists])
    size = max(1, len(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches):
            each = [terms(x) for x in common.texts(part.column(1))]
            n = np.array([len(x) for x in each], np.int64)
            ids = np.fromiter(map(vocabulary.get, itertools.chain.from_iterable(each), itertools.repeat(-1)), np.int64, int(n.sum()))
            own = np.repeat(np.arange(len(n)), n)
            keys, tf = np.unique((own * size + ids)[ids >= 0], return_counts=True)
            ends = pa.array(np.searchsorted(keys, np.arange(len(n) + 1) * size), pa.int32())
            values = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (keys % size, tf)]
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(n), *values], schema=schema).filter(pa.array(n > 0))

    return docs.mapInArrow(run, "doc_id long, n long, ids array<int>, tfs array<int>")


def radix_order(keys: np.ndarray, most: int) -> np.ndarray:
    """The order of keys from 0 to below most, by digits of 16 bits, least first; numpy sorts such digits by radix."""
    order = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")
    for shift in range(16, int(most).bit_length(), 16):
        order = order[np.argsort(((keys[order] >> shift) & 0xFFFF).astype(np.uint16), kind="stable")]
    return order


class Accumulator:
    """A block's items by term, and the best documents of each so far."""

    def __init__(self, n_items: int, starts: np.ndarray, holders: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int, top: int):
        self.n_items, self.starts, self.holders, self.weights, self.n_docs, self.n_terms, self.top = n_items, starts, holders, weights, n_docs, n_terms, top
        self.heaps: list[list] = [[] for _ in range(n_items)]
        self.least = np.ones(n_items, np.int64)

    def add(self, docs: list, n: list[int], ends: np.ndarray, ids: np.ndarray, tfs: np.ndarray) -> None:
        """Documents with their term counts; the terms of the i-th lie between ends[i] and ends[i + 1]."""
        length = np.array([100 - 90 + 90 * x * self.n_docs // self.n_terms for x in n], np.int64)
        own = np.repeat(np.arange(len(n)), np.diff(ends))
        tf = tfs.astype(np.int64)
        impact = self.weights[ids] * (1_000_000_000 * tf // (1000 * tf + 8 * length[own]))
        width = np.diff(self.starts)[ids]
        done = np.concatenate([[0], np.cumsum(width)])[ends]
        a = 0
        while a < len(n):
            b = max(a + 1, int(np.searchsorted(done, done[a] + MATCHES, "right")) - 1)
            x = slice(ends[a], ends[b])
            self._sum(docs[a:b], own[x] - a, ids[x], impact[x], width[x])
            a = b

    def _sum(self, docs: list, own: np.ndarray, ids: np.ndarray, impact: np.ndarray, width: np.ndarray) -> None:
        total = int(width.sum())
        if not total:
            return
        at = np.arange(total) + np.repeat(self.starts[ids] - np.cumsum(width) + width, width)
        keys = self.holders[at] * len(docs) + np.repeat(own, width)
        order = radix_order(keys, self.n_items * len(docs))
        keys = keys[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        scores = np.add.reduceat(np.repeat(impact, width)[order], first)
        item, doc = np.divmod(keys[first], len(docs))
        good = scores >= self.least[item]
        for i, d, s in zip(item[good].tolist(), doc[good].tolist(), scores[good].tolist(), strict=True):
            heap, found = self.heaps[i], (s, docs[d] is not None, -(docs[d] or 0))
            if len(heap) < self.top:
                heapq.heappush(heap, found)
            elif found > heap[0]:
                heapq.heapreplace(heap, found)
            if len(heap) == self.top:
                self.least[i] = max(1, heap[0][0])

    def best(self) -> Iterator[tuple]:
        return ((i, -d if known else None, s) for i, heap in enumerate(self.heaps) for s, known, d in heap)


def _best(sketches: DataFrame, pairs: list[tuple], vocabulary: dict[bytes, int], top: int) -> DataFrame:
    """item_id, doc_id and score of the best of each range of documents, for one block of items."""
    names = sorted({i for i, _ in pairs}, key=lambda i: (i is None, i))
    number = {i: k for k, i in enumerate(names)}
    held = np.array(sorted((vocabulary[t], number[i]) for i, t in pairs), np.int64).reshape(-1, 2)
    starts, holders = np.searchsorted(held[:, 0], np.arange(len(vocabulary) + 1)), held[:, 1].copy()
    n_docs, n_terms = sketches.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.full(len(vocabulary), 0, np.int64)
    for r in sketches.select(F.explode("ids").alias("id")).groupBy("id").count().collect():
        weights[r["id"]] = weight(n_docs, r["count"])
    schema = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Accumulator(len(names), starts, holders, weights, n_docs, n_terms, top)
        for part in batches:
            if part.num_rows:
                ids, tfs = part.column(2), part.column(3)
                ends = ids.offsets.to_numpy() - ids.offsets[0].as_py()
                found.add(part.column(0).to_pylist(), part.column(1).to_pylist(), ends, ids.flatten().to_numpy(), tfs.flatten().to_numpy())
        for some in itertools.batched(found.best(), 10_000):
            item, doc, score = zip(*some)
            yield common.rows(schema, [names[i] for i in item], list(doc), list(score))

    dealt = sketches.repartitionByRange(F.col("doc_id"), F.xxhash64("n", "ids"))
    return dealt.mapInArrow(run, "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id and score of each item's best documents with a score above 0: highest first, equal ones by id, a null id last.

    Terms are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased. Null, empty and termless texts
    are in no result and in no count. Each row of docs is a document of its own: rows that repeat an id or a text are scored
    and ranked each. Rows of items that share an id are one item with the terms of all, null ids likewise; an item without terms has no
    rows. Other columns are not read. An empty table on either side gives an empty result. Items are taken in blocks, each of which
    passes over all documents; a block's pairs of item and term are sent to the tasks, block of them on average.
    """
    spark = common.ship(docs.sparkSession)
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).where("text is not null")
    pairs, _ = common.written(item_terms(items.select(items[item_col].cast("long").alias("item_id"), items[item_text_col].cast("string").alias("text"))), "items")
    n_blocks = -(-pairs.count() // block)
    found = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for k in range(n_blocks):
        mine = [(r["item_id"], bytes(r["term"])) for r in pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == k).collect()]
        vocabulary = {t: i for i, t in enumerate(sorted({t for _, t in mine}))}
        sketches, _ = common.written(sketch(own, vocabulary), "sketches")
        found = found.unionByName(_best(sketches, mine, vocabulary, top))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    return found.select("item_id", rank.alias("rank"), "doc_id", "score").where(F.col("rank") <= top)
