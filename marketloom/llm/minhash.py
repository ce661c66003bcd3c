"""MinHash near-dedup [2]: circulant MinHash, banding, exact Jaccard verification, components.

Signature: a shingle's place in a universe of 2**20 goes through one permutation; the k-th coordinate is the
least value, over the document's places, of a second permutation shifted circularly by k. Two permutations
thus serve all coordinates.

Copies with the same word sequence become one class first. Classes that share a band are candidates. A class also
has a parity bitmap of its shingles: the bits in which two bitmaps differ are at most the shingles in which the
sets differ, so a pair with too many of them cannot be linked, and is dropped before any set is read. Each
bucket's classes are compared with the bucket's smallest one, on full sets, and linked ones become
components; two rounds with other pivots follow. What is then left are pairs of different components in a bucket,
one of them outside the bucket's largest component, that the bitmaps allow: these are compared one by one.
No bucket is capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm import common
from marketloom.llm.components import components

UNIVERSE = 1 << 20
BANDS, ROWS = 32, 4
SHINGLE = 5
#: Documents are linked from this percentage of their union on.
PERCENT = 75
#: A pivot's shingle set is given to so many shares of its partners at most.
SHARES = 256
#: Bits of the parity bitmap.
BITS = 1024
#: Ids of candidate classes that are broadcast to pick their texts; with more, texts are joined by shuffling.
BROADCAST_IDS = 400_000

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _scramble(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def shingle_sets(words: list[list[bytes]], size: int = SHINGLE) -> list[np.ndarray]:
    """For each word list its sorted distinct shingles as 64-bit hashes; shorter ones have the whole list as one shingle."""
    n = np.array([len(w) for w in words], np.int64)
    h = np.fromiter((xxhash.xxh3_64_intdigest(w) for ws in words for w in ws), np.uint64, int(n.sum()))
    ends = np.cumsum(n)
    if len(h) >= size:
        s = np.zeros(len(h) - size + 1, np.uint64)
        for k in range(size):
            s += h[k : len(h) - size + 1 + k] * _MIX[k]
        s = _scramble(s)
    out = []
    for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(s[a : b - size + 1]))
        elif b > a:
            x = np.array([sum(int(w) * int(m) for w, m in zip(h[a:b], _MIX)) + (b - a) * 0x2545F4914F6CDD1D & (1 << 64) - 1], np.uint64)
            out.append(_scramble(x))
        else:
            out.append(h[:0])
    return out


class Circulant:
    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.first = rng.permutation(UNIVERSE).astype(np.int32)
        second = rng.permutation(UNIVERSE).astype(np.int32)
        self.second = np.concatenate([second, second])
        self.mult = np.array([int(x) | 1 for x in rng.integers(1, 1 << 62, ROWS)], np.uint64)
        self.band = np.array([int(x) for x in rng.integers(1, 1 << 62, BANDS)], np.uint64)

    def signatures(self, sets: list[np.ndarray]) -> np.ndarray:
        """A row for each set, none of which is empty."""
        sizes = np.array([len(s) for s in sets])
        places = self.first[(np.concatenate(sets) >> np.uint64(44)).astype(np.int64)].astype(np.intp)
        starts = np.cumsum(sizes) - sizes
        out = np.empty((BANDS * ROWS, len(sets)), np.int32)
        values = np.empty(len(places), np.int32)
        for k in range(BANDS * ROWS):
            np.take(self.second[UNIVERSE - k : 2 * UNIVERSE - k], places, out=values, mode="clip")
            out[k] = np.minimum.reduceat(values, starts)
        return out.T

    def bands(self, signatures: np.ndarray) -> np.ndarray:
        x = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
        return _scramble((x * self.mult).sum(axis=2, dtype=np.uint64) + self.band).view(np.int64)


_circulant: list[Circulant] = []


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """For each set its bits, each the parity of the shingles that fall on it, as 64-bit words."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    at = owner * BITS + (np.concatenate(sets) & np.uint64(BITS - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=len(sets) * BITS) & 1).astype(np.uint8)).view(np.int64).reshape(len(sets), -1)


def can_link(x: str, y: str):
    """Whether the bitmaps let two classes be linked: J = (s - d) / (s + d) for sets of s shingles together that differ in d."""
    differ = sum(F.bit_count(F.col(f"{x}.bits")[i].bitwiseXOR(F.col(f"{y}.bits")[i])) for i in range(BITS // 64))
    return differ * (100 + PERCENT) <= (F.col(f"{x}.n") + F.col(f"{y}.n")) * (100 - PERCENT)


def _words(part: pa.RecordBatch) -> list[list[bytes]]:
    return [raw.lower().split() for raw in common.texts(part.column(1))]


def sketch(docs: DataFrame) -> DataFrame:
    """Of (id, text, h): id, h, n (shingles), k1 and k2 (of the word sequence), bands and bitmap, null for a document without words."""
    schema = pa.schema([("id", pa.int64()), ("h", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("bands", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _circulant:
            _circulant.append(Circulant())
        for part in common.slices(batches):
            words = _words(part)
            sets = shingle_sets(words)
            full = [i for i, s in enumerate(sets) if len(s)]
            bands: list = [None] * len(sets)
            bits: list = [None] * len(sets)
            if full:
                some = [sets[i] for i in full]
                for i, b, m in zip(full, _circulant[0].bands(_circulant[0].signatures(some)).tolist(), bitmaps(some).tolist(), strict=True):
                    bands[i], bits[i] = b, m
            keys = np.frombuffer(b"".join(blake2b(b" ".join(w), digest_size=16).digest() for w in words), "<i8").reshape(-1, 2)
            yield common.rows(schema, part.column(0), part.column(2), [len(s) for s in sets], keys[:, 0], keys[:, 1], bands, bits)

    return docs.mapInArrow(run, "id long, h long, n long, k1 long, k2 long, bands array<long>, bits array<long>")


def full_sets(docs: DataFrame) -> DataFrame:
    """Of (number, text): id, the number, and its sorted shingle hashes, packed."""
    schema = pa.schema([("id", pa.int64()), ("packed", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches):
            yield common.rows(schema, part.column(0), [s.astype("<u8").tobytes() for s in shingle_sets(_words(part))])

    return docs.mapInArrow(run, "id long, packed binary")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (a, b): a, b and linked, from the full sets. Partners of one a are dealt over SHARES shares."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("linked", pa.bool_())])
    pairs = pairs.withColumn("share", F.pmod(F.xxhash64("b"), F.lit(SHARES)).cast("int"))
    own = pairs.select("a", "share").distinct().join(sets.select(F.col("id").alias("a"), F.col("packed").alias("of_a")), "a")
    both = pairs.join(sets.select(F.col("id").alias("b"), F.col("packed").alias("of_b")), "b").join(own, ["a", "share"]).select("a", "b", "of_a", "of_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, common.SLICE_BYTES * batch.num_rows // max(1, batch.nbytes))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                linked = []
                for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    union = len(x) + len(y) - both
                    linked.append(100 * both >= PERCENT * union)
                yield common.rows(schema, part.column(0), part.column(1), linked)

    return both.mapInArrow(run, "a long, b long, linked boolean")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id (the smallest id reachable over links) and kept (id = component_id).

    Words: A-Z lower-cased, between ASCII white space. Shingles of five words; a shorter text is one shingle.
    A null, empty or blank text has none and is linked with nothing. A row without id has no component
    (null) and is kept. Rows that repeat an id are documents of their own, each linked by its own text; with one text they get the same
    result. Other columns are not read. An empty table gives an empty result.
    """
    component = F.when(F.col("id").isNotNull(), F.coalesce("first.id", "id"))
    return _grouped(docs, id_col, text_col).select("id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text and h, a hash of the text, which tells rows of one id apart."""
    text = docs[text_col].cast("string")
    return docs.select(docs[id_col].cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("h"))


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, h, n and first, the smallest (id, h) of its component (null without words or id)."""
    spark = common.ship(docs.sparkSession)
    docs = _identified(docs, id_col, text_col)
    sketches, _ = common.written(sketch(docs), "sketches")
    classes = sketches.where("id is not null and n > 0").groupBy("k1", "k2").agg(F.min_by(F.struct("id", "h", "n", "bands", "bits"), F.struct("id", "h")).alias("c"))
    classes, _ = common.written(classes.select(F.monotonically_increasing_id().alias("id"), "k1", "k2", F.struct(F.col("c.id").alias("id"), F.col("c.h").alias("h")).alias("doc"), "c.n", "c.bands", "c.bits"), "classes")
    labels = _labels(spark, docs, classes)
    named = classes.select("id", "k1", "k2", "doc").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    firsts = named.groupBy("label").agg(F.min("doc").alias("first"))
    named = named.join(firsts, "label").select("k1", "k2", "first")
    found = sketches.select("id", "h", "n", "k1", "k2").join(named, ["k1", "k2"], "left")
    return found.select("id", "h", "n", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("first")).alias("first"))


def _labels(spark, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Component labels of the classes (id: their number) that are linked with another."""
    buckets = classes.select("id", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("c"), F.min("id").alias("pivot")).where("c > 1").drop("c")
    members, _ = common.written(buckets.join(shared, "bucket"), "members")
    known_bits = classes.select("id", "n", "bits")
    pairs = members.where("id != pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    pairs = pairs.join(known_bits.select(F.col("id").alias("a"), F.struct("n", "bits").alias("x")), "a").join(known_bits.select(F.col("id").alias("b"), F.struct("n", "bits").alias("y")), "b")
    pairs, _ = common.written(pairs.where(can_link("x", "y")).select("a", "b"), "pairs")
    owners = classes.select(F.col("id").alias("class"), "doc.id", "doc.h")
    labels, _ = components(_linked(spark, docs, owners, pairs))
    known = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    def undecided(rows: DataFrame, labels: DataFrame) -> DataFrame:
        """Those rows (bucket, id) whose bucket has more than one component: label, and whether it is not the bucket's largest."""
        named = rows.join(labels.withColumnRenamed("label", "_label"), "id", "left").withColumn("label", F.coalesce("_label", "id")).drop("_label")
        mixed = named.groupBy("bucket", "label").agg(F.count("*").alias("c")).groupBy("bucket").agg(F.max(F.struct("c", "label")).alias("most"), F.count("*").alias("kinds")).where("kinds > 1")
        return named.join(mixed.select("bucket", F.col("most.label").alias("main")), "bucket").withColumn("minor", F.col("label") != F.col("main")).drop("main")

    left, _ = common.written(undecided(members.select("bucket", "id"), labels).join(known_bits, "id"), "undecided")
    for turn in range(3):
        x, y = left.where("minor").alias("x"), left.alias("y")
        if turn < 2:
            pivot = left.groupBy("bucket").agg(F.min_by(F.struct("id", "label", "n", "bits"), F.xxhash64("id", F.lit(turn))).alias("p")).select("bucket", "p.*")
            x = pivot.alias("x")
        each = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.label") != F.col("y.label")) & can_link("x", "y"))
        pairs = each.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct().join(known, ["a", "b"], "left_anti")
        pairs, _ = common.written(pairs, "pairs")
        if not pairs.isEmpty():
            known = known.union(pairs)
            found = _linked(spark, docs, owners, pairs)
            if not found.isEmpty():
                labels = _joined(labels, found)
                left, _ = common.written(undecided(left.drop("label", "minor"), labels), "undecided")
    return labels


def _joined(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels with further edges: only components that these tie together are worked on."""
    of = lambda c: labels.select(F.col("id").alias(c), F.col("label").alias(f"{c}_label"))
    ends = edges.join(of("a"), "a", "left").join(of("b"), "b", "left")
    more, _ = components(ends.select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b")))
    after = labels.join(more.select(F.col("id").alias("label"), F.col("label").alias("to")), "label", "left").select("id", F.coalesce("to", "label").alias("label"))
    return common.written(after.unionByName(more.join(labels, "id", "left_anti").select("id", "label")), "labels")[0]


def _linked(spark, docs: DataFrame, owners: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs of classes that are linked by their full sets, which are read for just these pairs, from the text of a class's first document."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct().join(owners, "class")
    ids, _ = common.written(ids, "candidates")
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    chosen = docs.join(ids, ["id", "h"]).select("class", "text")
    sets, sets_path = common.written(full_sets(chosen).dropDuplicates(["id"]), "sets")
    found, _ = common.written(verified(pairs, sets).where("linked").select("a", "b"), "linked")
    common.remove(spark, sets_path)
    return found


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose document stays: that of the smallest id of each component, and rows without id or words. Columns are as in docs.

    Rows that repeat an id are documents of their own: of one id and component that of the smallest hash of the text stays. Rows with one
    id and one text are one document, and stay or go together. An empty table gives an empty result.
    """
    same = F.struct("id", "h") == F.col("first")
    gone = _grouped(docs, id_col, text_col).where(F.col("first").isNotNull() & ~same).select(F.col("id").alias("__gone__"), F.col("h").alias("__hash__")).distinct()
    return docs.join(gone, (docs[id_col].cast("long") == gone["__gone__"]) & (F.xxhash64(docs[text_col].cast("string")) == gone["__hash__"]), "left_anti")
