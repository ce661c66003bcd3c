"""LM scoring [5]: a weighted backoff automaton over words, of n-grams up to ORDER, all of them, however large the corpus.

Tokens are a text's lower-cased words and one end. The lowest order is the base model. Above it
p(w | h) = (1 - b) * c(hw) / c(h) + b * p(w | h'), with h' the context h without its first word, where a context's share b is that of its
size class (c(h) to the next power of two): D * (distinct n-grams of the class) / (their occurrences), and D = (n1 + 1) / (n1 + 2 * n2 + 2)
of the order's n-grams that occur once and twice. Unseen contexts leave all to the lower order. Text starts are a context of their own.

As an automaton: a seen context is a state, a seen n-gram an arc with its log10 probability to the longest seen context that it
ends with, and each state has a failure arc of weight log10 b to its context without the first word. A text is read once from left to right; the state goes along.

No machine holds the model. Texts lie in blocks; a block's words become numbers of its own list. Each block sends its distinct n-grams
once, as hashes with their counts in training texts, dealt out by these hashes, so no word or context gathers in a task. Back
come the counts of the whole corpus, and each block builds the part of the automaton that its texts can reach.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm import common

ORDER = 3
#: A block of texts, in bytes. A longer text is a block by itself.
BLOCK = 4 << 20
#: n-grams in a group that counts, on average.
GROUP = 3_000_000
#: Texts are read in stretches of so many tokens.
STRETCH = 256
#: Size classes of contexts, by powers of two.
CLASSES = 48
#: Bits of an n-gram's hash, the last two of which are its order.
HASH_BITS = 52
#: Further bits that tell words apart: 62 in all, as n_known and the base model count each word for itself.
WORD_BITS = 12
END, START = b"\n", b"\r"

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]


def is_training(doc_id) -> bool:
    """By the CRC-32 of the id as text, mod 5: held out if 1. A null id counts as an empty text and is for training."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 != 1


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def _whole(hashes: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Hashes with the further bits behind them."""
    return hashes.astype(np.uint64) << np.uint64(WORD_BITS) | low


def _zip(x: np.ndarray, dtype: str) -> bytes:
    """Numbers as compressed byte planes, behind their count."""
    x = np.ascontiguousarray(x.astype(dtype))
    planes = x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
    return len(x).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unzip(data: bytes, dtype: str) -> np.ndarray:
    n, size = int.from_bytes(data[:8], "little"), np.dtype(dtype).itemsize
    if not n:
        return np.zeros(0, dtype)
    planes = np.frombuffer(pa.decompress(data[8:], n * size, codec="zstd"), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view(dtype)


BLOCKS = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.binary()), ("tokens", pa.binary()), ("n_tokens", pa.int64()), ("words", pa.binary()), ("n_words_bytes", pa.int64())])
BLOCKS_DDL = "block long, doc_ids array<long>, sizes binary, tokens binary, n_tokens long, words binary, n_words_bytes long"


def blocks(docs: DataFrame) -> DataFrame:
    """Of (id, text): a row for each block, with its texts' ids, their tokens as numbers of the block's words (0 is the end), and these words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        numbers, ids, sizes, tokens, read = {END: 0}, [], [], [], 0

        def closed() -> pa.RecordBatch:
            nonlocal block
            listed, flat = b"\n".join(w for w in numbers if w != END), np.concatenate(tokens)
            block += 1
            return common.rows(BLOCKS, [block], [list(ids)], [_zip(np.array(sizes), "<u4")], [_zip(flat, "<u4")], [len(flat)], [pa.compress(listed, codec="zstd", asbytes=True)], [len(listed)])

        for part in common.slices(batches):
            words = [raw.lower().split() for raw in common.texts(part.column(1))]
            number = numbers.setdefault
            tokens.append(np.fromiter((number(w, len(numbers)) for ws in words for w in (*ws, END)), np.int32))
            sizes += [len(ws) + 1 for ws in words]
            ids += part.column(0).to_pylist()
            read += part.column(1).nbytes
            if read >= BLOCK:
                yield closed()
                numbers, ids, sizes, tokens, read = {END: 0}, [], [], [], 0
        if ids:
            yield closed()

    return docs.mapInArrow(run, BLOCKS_DDL)


class Grams:
    """The distinct n-grams of a block. Word numbers go on with the start of a text, which is only ever a context.

    pairs and triples are sorted keys: number of the context (a word, or a pair) * width + word. of_pair and of_triple name those that end
    with each token (no triple ends with a text's first).
    """

    def __init__(self, row: dict):
        self.ids = row["doc_ids"]
        self.sizes = _unzip(row["sizes"], "<u4").astype(np.int64)
        self.tokens = _unzip(row["tokens"], "<u4").astype(np.int64)
        listed = pa.decompress(row["words"], row["n_words_bytes"], codec="zstd", asbytes=True) if row["n_words_bytes"] else b""
        words = [END, *(listed.split(b"\n") if listed else [])]
        self.n_words, self.width = len(words), len(words) + 1
        self.held_out = np.array([not is_training(i) for i in self.ids])
        self.train = np.repeat(~self.held_out, self.sizes)
        self.first = np.cumsum(self.sizes) - self.sizes
        before = np.r_[0, self.tokens[:-1]]
        before[self.first] = self.n_words
        self.pairs, self.of_pair = np.unique(before * self.width + self.tokens, return_inverse=True)
        key = np.r_[0, self.of_pair[:-1]] * self.width + self.tokens
        key[self.first] = -1
        self.triples, self.of_triple = np.unique(key, return_inverse=True)
        if len(self.triples) and self.triples[0] < 0:
            self.triples, self.of_triple = self.triples[1:], self.of_triple - 1
        self.words = words

    def hash(self) -> None:
        """All hashes, words, the start (of order 0), pairs and triples in turn, the words' further bits, and the order that sorts them."""
        own = np.fromiter(map(xxhash.xxh3_64_intdigest, (*self.words, START)), np.uint64, self.width)
        two = _scramble(own[self.pairs // self.width] * _MIX[0] + own[self.pairs % self.width] * _MIX[1])
        three = _scramble(two[self.triples // self.width] * _MIX[0] + own[self.triples % self.width] * _MIX[1])
        cut = lambda h, order: (_scramble(h) >> np.uint64(66 - HASH_BITS) << np.uint64(2) | np.uint64(order)).view(np.int64)
        self.hashes = np.concatenate([cut(own[:-1], 1), cut(own[-1:], 0), cut(two, 2), cut(three, 3)])
        self.low = np.zeros(len(self.hashes), np.uint16)
        self.low[: self.width - 1] = _scramble(own[:-1]) >> np.uint64(66 - HASH_BITS - WORD_BITS) & np.uint64((1 << WORD_BITS) - 1)
        self.order = np.argsort(_whole(self.hashes, self.low), kind="stable")

    def counts(self) -> np.ndarray:
        """In the training texts of the block. A text's start counts once for each text."""
        words = np.bincount(self.tokens[self.train], minlength=self.width)
        words[self.n_words] = np.count_nonzero(~self.held_out)
        pairs = np.bincount(self.of_pair[self.train], minlength=len(self.pairs))
        inside = self.train & (self.of_triple >= 0)
        return np.concatenate([words, pairs, np.bincount(self.of_triple[inside], minlength=len(self.triples))])

    def contexts(self) -> tuple[np.ndarray, np.ndarray]:
        """Of pairs and of triples: the place of their context among all n-grams."""
        return self.pairs // self.width, self.width + self.triples // self.width

    def sorted_by_group(self, bits: int) -> list[tuple[int, int, int]]:
        """Groups of the sorted hashes: group, begin, end."""
        group = self.hashes[self.order] >> (HASH_BITS - bits)
        cuts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        return list(zip(group[cuts].tolist(), cuts.tolist(), np.r_[cuts[1:], len(group)].tolist(), strict=True))


SENT = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("low", pa.binary()), ("n", pa.binary())])


def sent(stored: DataFrame, bits: int) -> DataFrame:
    """Each block's n-grams by group: sorted hashes, as differences, the words' further bits, and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1).to_pylist()[0]
                g = Grams(row)
                g.hash()
                keys, low, n = g.hashes[g.order], g.low[g.order], g.counts()[g.order]
                out = [(b, row["block"], _zip(np.diff(keys[i:j], prepend=b << HASH_BITS - bits), "<u8"), _zip(low[i:j][keys[i:j] & 3 == 1], "<u2"), _zip(n[i:j], "<u4")) for b, i, j in g.sorted_by_group(bits)]
                for at in range(0, len(out), 1_000):
                    yield common.rows(SENT, *zip(*out[at : at + 1_000], strict=True))

    return stored.mapInArrow(run, "bucket long, block long, keys binary, low binary, n binary")


COUNTED = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("c", pa.binary()), ("first", pa.binary()), ("stats", pa.list_(pa.int64()))])
COUNTED_DDL = "block long, bucket long, c binary, first binary, stats array<long>"


def counted(rows: DataFrame, bits: int) -> DataFrame:
    """For each row of sent: the corpus's counts of its n-grams, and which of them the row stands for, one row for each n-gram.

    stats, in one row of a group: for each order the n-grams seen, their occurrences, and how many occur once and twice.
    """

    def count(table: pa.Table) -> pa.Table:
        group = table.column("bucket")[0].as_py()
        keys = [np.cumsum(_unzip(x, "<u8").astype(np.int64)) + (group << HASH_BITS - bits) for x in table.column("keys").to_pylist()]
        ends = np.cumsum([len(k) for k in keys])
        every = np.concatenate(keys)
        low = np.zeros(len(every), np.uint16)
        low[every & 3 == 1] = np.concatenate([_unzip(x, "<u2") for x in table.column("low").to_pylist()])
        own, one, at = np.unique(_whole(every, low), return_index=True, return_inverse=True)
        n = np.concatenate([_unzip(x, "<u4") for x in table.column("n").to_pylist()])
        c = np.bincount(at, n, len(own)).astype(np.int64)
        first = np.zeros(len(at), np.uint8)
        first[one] = c > 0
        stats = []
        for order in range(1, ORDER + 1):
            x = c[(own >> np.uint64(WORD_BITS) & np.uint64(3)) == order]
            stats += [int((x > 0).sum()), int(x.sum()), int((x == 1).sum()), int((x == 2).sum())]
        m = len(keys)
        cuts = ends[:-1]
        return pa.Table.from_batches([common.rows(COUNTED, table.column("block").to_pylist(), table.column("bucket").to_pylist(), [_zip(x, "<u8") for x in np.split(c[at], cuts)], [_zip(x, "<u1") for x in np.split(first, cuts)], [stats] + [None] * (m - 1))])

    return rows.groupBy("bucket").applyInArrow(count, COUNTED_DDL)


JOINED = pa.schema([*BLOCKS, ("c", pa.binary()), ("classes", pa.list_(pa.int64()))])


def joined(stored: DataFrame, results: DataFrame, n_blocks: int) -> DataFrame:
    """Blocks with the corpus's counts of their n-grams, and for both upper orders, by size class of the context, the distinct n-grams that the block stands for and their occurrences."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        g = Grams(row)
        g.hash()
        by = np.argsort(right.column("bucket").to_numpy(), kind="stable").tolist()
        c, first = np.zeros(len(g.order), np.int64), np.zeros(len(g.order), bool)
        c[g.order] = np.concatenate([_unzip(right.column("c")[k].as_py(), "<u8") for k in by])
        first[g.order] = np.concatenate([_unzip(right.column("first")[k].as_py(), "<u1") for k in by])
        classes = []
        for context, at in zip(g.contexts(), (g.width, g.width + len(g.pairs)), strict=True):
            own = slice(at, at + len(context))
            k = size_class(c[context])[first[own]]
            classes += [*np.bincount(k, minlength=CLASSES).tolist(), *np.bincount(k, c[own][first[own]], CLASSES).astype(np.int64).tolist()]
        return pa.Table.from_pylist([row | {"c": _zip(c, "<u8"), "classes": classes}], schema=JOINED)

    left, right = stored.repartition(n_blocks, "block"), results.select("block", "bucket", "c", "first").repartition(n_blocks, "block")
    return left.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(run, BLOCKS_DDL + ", c binary, classes array<long>")


def size_class(c: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(np.maximum(c, 1).astype(float))[1] - 1, CLASSES - 1)


class Model:
    """What all blocks need beside their counts: training tokens, distinct words, and log10 of the failure arcs by order and size class."""

    def __init__(self, stats: list[int], classes: list[int]):
        """stats: as in counted. classes: as in joined."""
        self.v, self.n = stats[0], stats[1]
        self.left = []
        for order in (2, 3):
            once, twice = stats[4 * (order - 1) + 2 : 4 * order]
            kinds, whole = np.array(classes[2 * CLASSES * (order - 2) : 2 * CLASSES * (order - 1)], float).reshape(2, CLASSES)
            d = (once + 1) / (once + 2 * twice + 2)
            self.left.append(np.where(whole > 0, d * kinds / np.maximum(whole, 1), 1.0))

    def base(self, c: np.ndarray) -> np.ndarray:
        return (c + 0.5) / (self.n + 0.5 * (self.v + 1))


class Automaton:
    """The states and arcs that a block's texts can reach. State 0 is the empty context, then come words (and the start), then pairs."""

    def __init__(self, g: Grams, c: np.ndarray, model: Model):
        one, two, three = np.split(c, [g.width, g.width + len(g.pairs)])
        base = model.base(one)
        context, word = np.divmod(g.pairs, g.width)
        b = model.left[0][size_class(one)]
        lower = b[context] * base[word]
        p_two = np.where(one[context] > 0, (1 - b[context]) * two / np.maximum(one[context], 1) + lower, base[word])
        pair, last = np.divmod(g.triples, g.width)
        bb = model.left[1][size_class(two)]
        suffix = np.minimum(np.searchsorted(g.pairs, (g.pairs[pair] % g.width) * g.width + last), max(len(g.pairs) - 1, 0))
        p_three = (1 - bb[pair]) * three / np.maximum(two[pair], 1) + bb[pair] * p_two[suffix]
        self.width = g.width
        self.root_log, self.root_next = np.log10(base), np.where(one > 0, 1 + np.arange(g.width), 0)
        self.start = int(self.root_next[g.n_words])
        self.fail = np.concatenate([[0], np.zeros(g.width, np.int64), np.where(one[word] > 0, 1 + word, 0)])
        self.weight = np.concatenate([[0.0], np.log10(b), np.log10(bb)])
        at_two, at_three = np.flatnonzero(two > 0), np.flatnonzero(three > 0)
        states = 1 + g.width
        arcs = np.concatenate([(1 + context[at_two]) * g.width + word[at_two], (states + pair[at_three]) * g.width + last[at_three]])
        targets = np.concatenate([states + at_two, states + suffix[at_three]])
        logs = np.log10(np.concatenate([p_two[at_two], p_three[at_three]]))
        self._table(arcs, targets, logs)

    def _table(self, arcs: np.ndarray, targets: np.ndarray, logs: np.ndarray) -> None:
        """Arcs by hash: their numbers in a table with room to spare; what collides moves to the next free place."""
        bits = max(4, int(np.ceil(np.log2(2 * len(arcs) + 1))))
        self.shift = np.uint64(64 - bits)
        self.arcs, self.next, self.log = np.append(arcs, -1), np.append(targets, 0).astype(np.int32), np.append(logs, 0.0)
        self.number = np.full(1 << bits, -1, np.int32)
        slot, left = self._slot(arcs), np.arange(len(arcs), dtype=np.int32)
        while len(left):
            free = np.flatnonzero(self.number[slot] < 0)
            at, pick = np.unique(slot[free], return_index=True)
            won = free[pick]
            self.number[at] = left[won]
            rest = np.ones(len(left), bool)
            rest[won] = False
            left, slot = left[rest], (slot[rest] + 1) & (len(self.number) - 1)

    def _slot(self, arcs: np.ndarray) -> np.ndarray:
        return ((arcs.astype(np.uint64) * _MIX[0]) >> self.shift).view(np.int64)

    def _find(self, arc: np.ndarray) -> np.ndarray:
        """Numbers of arcs, -1 for those that there are not."""
        slot = self._slot(arc)
        number = self.number[slot]
        moved = np.flatnonzero((self.arcs[number] != arc) & (number >= 0))
        while len(moved):
            slot[moved] = (slot[moved] + 1) & (len(self.number) - 1)
            number[moved] = self.number[slot[moved]]
            moved = moved[(self.arcs[number[moved]] != arc[moved]) & (number[moved] >= 0)]
        return number

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and log10 probabilities of reading a word in each state: failure arcs are followed until an arc has the word."""
        log, after = np.zeros(len(state)), np.zeros(len(state), np.int64)
        lanes, s, w = np.arange(len(state)), state, word
        while len(lanes):
            root = s == 0
            if root.any():
                to = lanes[root]
                after[to] = self.root_next[w[root]]
                log[to] += self.root_log[w[root]]
                lanes, s, w = lanes[~root], s[~root], w[~root]
            number = self._find(s * self.width + w)
            hit = number >= 0
            to = lanes[hit]
            after[to] = self.next[number[hit]]
            log[to] += self.log[number[hit]]
            lanes, s, w = lanes[~hit], s[~hit], w[~hit]
            log[lanes] += self.weight[s]
            s = self.fail[s]
        return after, log

    def scores(self, tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """log10 probability of each text. Long ones are read in stretches side by side; a state is known from the two tokens before it."""
        begin = np.cumsum(sizes) - sizes
        stretches = -(-sizes // STRETCH)
        doc = np.repeat(np.arange(len(sizes)), stretches)
        k = np.arange(len(doc)) - np.repeat(np.cumsum(stretches) - stretches, stretches)
        at = begin[doc] + k * STRETCH
        n = np.minimum(STRETCH, begin[doc] + sizes[doc] - at)
        order = np.argsort(-n, kind="stable")
        doc, at, n, k = doc[order], at[order], n[order], k[order]
        state = np.full(len(doc), self.start, np.int64)
        later = np.flatnonzero(k > 0)
        if len(later):
            state[later] = self.step(self.root_next[tokens[at[later] - 2]], tokens[at[later] - 1])[0]
        total = np.zeros(len(doc))
        for t in range(int(n[0]) if len(n) else 0):
            m = int(np.searchsorted(-n, -t, "left"))
            state[:m], log = self.step(state[:m], tokens[at[:m] + t])
            total[:m] += log
        return np.bincount(doc, total, len(sizes))


SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    A null or empty text has the end token alone. A row without id is for training. Repeated rows count as
    often as they occur; other columns are not read. An empty table gives an empty result, and with no training
    text every word is unknown. Words are told apart by hashes of 62 bits, longer n-grams by 50.
    """
    spark = common.ship(docs.sparkSession)
    docs = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    stored, _ = common.written(blocks(docs), "blocks")
    tokens, n_blocks = stored.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.count("*")).first()
    bits = max(4, int(np.ceil(np.log2(2 * tokens / GROUP + 1))))
    rows = sent(stored, bits).repartition(max(1 << bits, int(spark.conf.get("spark.sql.shuffle.partitions"))), "bucket")
    results, _ = common.written(counted(rows, bits), "counts")
    stats = results.where("stats is not null").agg(*[F.coalesce(F.sum(F.col("stats")[k]), F.lit(0)) for k in range(4 * ORDER)]).first()
    both, _ = common.written(joined(stored, results, max(1, n_blocks)), "counted_blocks")
    classes = both.agg(*[F.coalesce(F.sum(F.col("classes")[k]), F.lit(0)) for k in range(4 * CLASSES)]).first()
    model = spark.sparkContext.broadcast(Model(list(stats), list(classes)))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1).to_pylist()[0]
                g, c, m = Grams(row), _unzip(row["c"], "<u8").astype(np.int64), model.value
                del g.words, g.of_pair, g.of_triple
                known = c[: g.width] > 0
                sums = lambda x: np.add.reduceat(x[g.tokens], g.first)  # noqa: B023, E731
                base = np.log10(m.base(c[: g.width]))
                yield common.rows(SCORED, g.ids, g.held_out, g.sizes, sums(known.astype(np.int64)), np.full(len(g.ids), m.n), sums(base), Automaton(g, c, m).scores(g.tokens, g.sizes))

    return both.drop("classes").mapInArrow(scored, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
