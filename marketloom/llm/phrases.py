"""Phrase collocation mining [13]: contiguous pattern growth as in PrefixSpan, spread over prefixes.

Words are counted first. Then pairs of frequent words are counted by a hash, and both are kept as bitmaps of a fixed size: a position
whose pair is in no frequent place cannot begin or continue a frequent phrase. These filters let through too much at worst, never too
little. What is left is projected: for each occurrence of a frequent prefix of two words, the words that can follow it,
which stand for the occurrence's pointer; equal projections are one row with a count. A prefix's rows go to one task in order, and
there patterns are extended to the right, depth first: a pattern's projection is a run of rows, its extensions are runs
within. A prefix that is a large part of the corpus is dealt by its third word, and its parts are added up. Counts of
phrases come from words themselves, not from hashes.

Scores take the counts of both parts of each cut by joins on equal keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm import common

LEAST = 30
LONGEST = 4
TOP = 2000
#: A longer phrase with this percentage of a phrase's occurrences replaces it.
COVER = 80
SCALE = 2_000_000
#: Bits of each filter.
FILTER_BITS = 1 << 25
#: Bits of a pair's key, and the words to which a bucket of keys comes. Keys serve the filter alone.
PAIR_BITS = 40
BUCKET_WORDS = 1 << 21
#: Pairs that make up so large a part of all words are dealt by their third word too; there are SPLIT of them at most.
SPLIT = 1 << 16
#: Bytes of text that are counted at once; pairs that a task holds before it sends their counts.
SLICE_BYTES = 6 << 20
HELD_PAIRS = 1 << 20
NO_LANG = "und"

#: What a byte is: 0 part of a word, 1 between words, 2 between pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[list(b".,;:!?\x0a\x0b\x0c\x0d")] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]


class Tokens:
    """The words of a batch (lang, text): codes into a dictionary, each word's language, and whether the next word follows in its piece."""

    def __init__(self, part: pa.RecordBatch):
        langs = part.column(0).fill_null(NO_LANG).dictionary_encode()
        text = part.column(1).cast(pa.large_binary()).fill_null(b"")
        ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        raw = _LOWER[np.frombuffer(text.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]]
        ends = ends - ends[0]
        kind = _KIND[raw]
        inside = kind == 0
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        first = ends[:-1][ends[:-1] < len(raw)]
        begins[first] |= inside[first]
        at = np.flatnonzero(begins)
        gap = kind == 2
        gap[first] = True
        piece = np.cumsum(gap, dtype=np.int32)[at]
        length = np.cumsum(inside, dtype=np.int32)
        offsets = np.append(length[at] - 1, length[-1] if len(length) else 0).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])]).dictionary_encode()
        self.codes = words.indices.to_numpy().astype(np.int64)
        self.words = words.dictionary.cast(pa.large_string())
        self.lang_names = langs.dictionary
        self.lang = langs.indices.to_numpy()[np.searchsorted(ends[1:], at, "right")].astype(np.int64)
        self.follows = np.append(piece[1:] == piece[:-1], False)[: len(at)]

    def hashes(self) -> np.ndarray:
        """Of each word with its language."""
        own = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in self.words.cast(pa.large_binary()).to_pylist()), np.uint64, len(self.words))
        lang = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in self.lang_names.to_pylist()), np.uint64, len(self.lang_names))
        return scrambled(own[self.codes] + lang[self.lang] * _MIX[1])


def scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX[0]
    return x ^ (x >> np.uint64(29))


def pair_keys(h: np.ndarray) -> np.ndarray:
    """Of each word with the next one, PAIR_BITS bits; the last word has none."""
    return scrambled(h[:-1] * _MIX[0] + h[1:] * _MIX[1]) >> np.uint64(64 - PAIR_BITS)


def among(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the bit of each hash is set."""
    at = h & np.uint64(FILTER_BITS - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def bitmap(hashes: DataFrame) -> np.ndarray:
    """The filter that has the bits of the column key: FILTER_BITS at any size of the corpus."""
    at = F.col("key").bitwiseAND(FILTER_BITS - 1)
    cells = hashes.groupBy(F.shiftright(at, 6).alias("cell")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63).cast("int"))).alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    out[cells["cell"].to_numpy()] = cells["bits"].to_numpy().view(np.uint64)
    return out


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word and f of all words."""
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("f", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, limit=SLICE_BYTES):
            t = Tokens(part)
            size = max(1, len(t.words))
            both, f = np.unique(t.lang * size + t.codes, return_counts=True)
            lang, code = np.divmod(both, size)
            yield pa.RecordBatch.from_arrays([t.lang_names.take(pa.array(lang)).cast(pa.string()), t.words.take(pa.array(code)).cast(pa.string()), pa.array(f)], schema=schema)

    return docs.mapInArrow(run, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def word_keys(words: DataFrame) -> DataFrame:
    """Of (lang, word): key, the hash of each."""
    schema = pa.schema([("key", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            own, lang = (np.fromiter((xxhash.xxh3_64_intdigest(x) for x in part.column(k).to_pylist()), np.uint64, part.num_rows) for k in (1, 0))
            yield pa.RecordBatch.from_arrays([pa.array(scrambled(own + lang * _MIX[1]).view(np.int64))], schema=schema)

    return words.mapInArrow(run, "key long")


def packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys as gaps, and counts, by byte planes: what is alike lies together."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    planes = [x.view(np.uint8).reshape(len(keys), 8).T.tobytes() for x in (gaps.astype("<u8"), counts.astype("<u8"))]
    return zstandard.compress(b"".join(planes), 1)


def unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(2, 8, -1)
    gaps, counts = (np.ascontiguousarray(x.T).view("<u8").ravel() for x in planes)
    return np.cumsum(gaps, dtype=np.uint64), counts


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(at, np.concatenate(counts), len(found)).astype(np.uint64)


def frequent_pairs(docs: DataFrame, words: np.ndarray, n_words: int, least: int) -> DataFrame:
    """key and f of those pairs of frequent words that occur often enough, pairs with one key taken together.

    Keys are dealt by their first bits, in packed runs; a bucket has BUCKET_WORDS occurrences or so, and fewer keys.
    """
    bits = min(PAIR_BITS - 1, (n_words // BUCKET_WORDS).bit_length())
    sent_schema, schema = pa.schema([("bucket", pa.int64()), ("run", pa.binary())]), pa.schema([("key", pa.int64()), ("f", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def sent() -> pa.RecordBatch:
            keys, f = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            of = (keys >> np.uint64(PAIR_BITS - bits)).astype(np.int64)
            ends = np.flatnonzero(np.append(of[1:] != of[:-1], True)[: len(of)]) + 1
            runs = [(int(of[b - 1]), packed(keys[a:b], f[a:b])) for a, b in zip([0, *ends[:-1]], ends, strict=True)] if len(keys) else []
            return common.rows(sent_schema, [x[0] for x in runs], [x[1] for x in runs])

        for part in common.slices(batches, limit=SLICE_BYTES):
            t = Tokens(part)
            h = t.hashes()
            known = among(words, h)
            held.append(pair_keys(h)[known[:-1] & known[1:] & t.follows[:-1]])
            if sum(map(len, held)) >= HELD_PAIRS:
                yield sent()
        if held:
            yield sent()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, runs = None, []

        def done() -> pa.RecordBatch:
            keys, f = summed(*zip(*runs)) if runs else (np.empty(0, np.uint64), np.empty(0, np.uint64))
            often = f >= least
            return pa.RecordBatch.from_arrays([pa.array(keys[often].astype(np.int64)), pa.array(f[often].astype(np.int64))], schema=schema)

        for batch in batches:
            for own, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if own != bucket:
                    yield done()
                    bucket, runs = own, []
                runs.append(unpacked(raw))
                if len(runs) > 64:
                    runs = [summed(*zip(*runs))]
        yield done()

    sent = docs.mapInArrow(count, "bucket long, run binary").repartition("bucket").sortWithinPartitions("bucket")
    return sent.mapInArrow(merge, "key long, f long")


def projections(docs: DataFrame, pairs: np.ndarray, hot: np.ndarray) -> DataFrame:
    """lang, phrase (two to four words, joined) and c: how often just these words can begin a frequent phrase; deal, by which a prefix's rows
    find together, and split, whether the third word has a part in it."""
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("deal", pa.int64()), ("split", pa.bool_()), ("c", pa.int64())])

    def projected(part: pa.RecordBatch) -> pa.RecordBatch:
        t = Tokens(part)
        good = np.zeros(len(t.codes) + 3, bool)
        h = t.hashes()
        keys = pair_keys(h)
        good[: len(keys)] = among(pairs, keys) & t.follows[:-1]
        at = np.flatnonzero(good)
        codes = np.append(t.codes, [0, 0, 0])
        third, fourth = good[at + 1], good[at + 1] & good[at + 2]
        columns = [t.lang[at], codes[at], codes[at + 1], np.where(third, codes[at + 2], -1), np.where(fourth, codes[at + 3], -1)]
        own, size = np.zeros(len(at), np.int64), len(t.words) + 1
        for x in columns:
            own = np.unique(own * size + x + 1, return_inverse=True)[1]
        _, first, c = np.unique(own, return_index=True, return_counts=True)
        words = [t.words.take(pa.array(x[first], mask=x[first] < 0)) for x in columns[1:]]
        phrase = pc.binary_join_element_wise(*words, pa.scalar(" ", pa.large_string()), null_handling="skip")
        deal = keys[at[first]] if len(at) else np.empty(0, np.uint64)
        split = np.isin(deal, hot)
        after = np.append(h, [0, 0]).astype(np.uint64)[at[first] + 2] * third[first]
        deal = np.where(split, scrambled(deal + after), deal).view(np.int64)
        return pa.RecordBatch.from_arrays([t.lang_names.take(pa.array(columns[0][first])).cast(pa.string()), phrase.cast(pa.string()), pa.array(deal), pa.array(split), pa.array(c)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def sent() -> list[pa.RecordBatch]:
            whole = pa.Table.from_batches(held).group_by(schema.names[:-1], use_threads=False).aggregate([("c", "sum")])
            held.clear()
            return pa.table([whole[c] for c in [*schema.names[:-1], "c_sum"]], schema=schema).to_batches()

        for part in common.slices(batches, limit=SLICE_BYTES):
            held.append(projected(part))
            if sum(x.num_rows for x in held) >= HELD_PAIRS:
                yield from sent()
        if held:
            yield from sent()

    return docs.mapInArrow(run, "lang string, phrase string, deal long, split boolean, c long")


def grown(projected: DataFrame, least: int) -> DataFrame:
    """lang, phrase (its words) and a, of phrases of two words and more with `least` occurrences."""
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.list_(pa.string())), ("a", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path: list[str] = []
        counts: list[int] = []
        lang, in_part, out = None, False, []

        def back_to(depth: int) -> None:
            """Leaves the patterns below this depth, each of which has its whole count now, unless others have parts of its prefix."""
            while len(path) > depth:
                if len(path) > 1 and (counts[-1] >= least or in_part and len(path) == 2):
                    out.append((lang, list(path), counts[-1]))
                path.pop()
                counts.pop()

        for batch in batches:
            for own, words, c, split in zip(*(batch.column(k).to_pylist() for k in ("lang", "words", "c", "split")), strict=True):
                if own != lang:
                    back_to(0)
                    lang = own
                same = 0
                while same < len(path) and same < len(words) and path[same] == words[same]:
                    same += 1
                back_to(same)
                in_part = split
                path += words[same:]
                counts += [0] * (len(words) - same)
                for k in range(len(counts)):
                    counts[k] += c
            if out:
                yield common.rows(schema, *zip(*out))
                out.clear()
        back_to(0)
        if out:
            yield common.rows(schema, *zip(*out))

    merged = projected.repartition("deal").groupBy("lang", "phrase", "deal", "split").agg(F.sum("c").alias("c"))
    dealt = merged.select("lang", F.split("phrase", " ").alias("words"), "c", "split").sortWithinPartitions("lang", "words")
    found = dealt.mapInArrow(run, "lang string, phrase array<string>, a long")
    return found.groupBy("lang", "phrase").agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def cut(phrase: str, start: Column | int, n: Column) -> Column:
    """The words of a phrase from a place on, joined."""
    return F.array_join(F.slice(phrase, start, n), " ")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per language the first phrases of 2 to 4 words: lang, rank, phrase, a, l, r, n and score.

    A-Z are lower-cased; pieces end at . , ; : ! ? and line ends, words at blanks and tabs. a, l and r are all occurrences of the
    phrase and of the two parts at its lowest-scoring cut, n all words of the language. A phrase that lies in a longer one with COVER per
    cent of its occurrences or more is left out. A null language is `und`, and one with rows of that name; null, empty and wordless
    texts count nothing. Each row counts, repeated ones too. Other columns are not read. An empty table gives an empty result.
    """
    common.ship(docs.sparkSession)
    own = docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit(NO_LANG)).alias("lang"), docs[text_col].cast("string").alias("text")).where("text is not null")
    counted, _ = common.written(word_counts(own), "words")
    n_words = counted.agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0]
    frequent = counted.where(F.col("f") >= least)
    pairs, _ = common.written(frequent_pairs(own, bitmap(word_keys(frequent.select("lang", "word"))), n_words, least), "pairs")
    hot = np.sort(pairs.where(F.col("f") * SPLIT > n_words).select("key").toArrow()["key"].to_numpy().astype(np.uint64))
    phrases, _ = common.written(grown(projections(own, bitmap(pairs), hot), least), "phrases")

    text = F.array_join("phrase", " ")
    known = phrases.select("lang", text.alias("part"), F.col("a").alias("f")).unionByName(frequent.select("lang", F.col("word").alias("part"), "f"))
    cuts = phrases.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.size("phrase") - 1)).alias("k"))
    cuts = cuts.select("lang", text.alias("phrase"), "a", "k", cut("phrase", 1, F.col("k")).alias("left"), cut("phrase", F.col("k") + 1, F.size("phrase") - F.col("k")).alias("right"))
    scored = cuts.join(known.select("lang", F.col("part").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(known.select("lang", F.col("part").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    scored = scored.withColumn("score", F.expr(f"cast({SCALE} as decimal(10,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "x.score")

    spans = [F.when((F.size("phrase") > n) & (F.size("phrase") >= start + n - 1), cut("phrase", start, F.lit(n))) for n in range(2, LONGEST) for start in range(1, LONGEST - n + 2)]
    inner = phrases.where(F.size("phrase") > 2).select("lang", F.explode(F.array_compact(F.array(*spans))).alias("phrase"), F.col("a").alias("whole"))
    covers = inner.groupBy("lang", "phrase").agg(F.max("whole").alias("whole"))
    covered = F.coalesce(F.lit(100).cast("decimal(5,0)") * F.col("whole").cast("decimal(20,0)") >= F.lit(COVER).cast("decimal(5,0)") * F.col("a").cast("decimal(20,0)"), F.lit(False))
    left = best.join(covers, ["lang", "phrase"], "left").where(~covered).drop("whole")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = left.withColumn("rank", rank).where(F.col("rank") <= top)
    totals = counted.groupBy("lang").agg(F.sum("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
