"""Best-fit packing [3]: a local search by moves and swaps between underfull bins, until bins empty.

Texts become token ids on the executors. Documents over the capacity are cut; the pieces are dealt at random
into groups of so many tokens, and each group is packed by itself, so a task holds the lengths of about GROUP
sequences and no more. A group leaves about one unfilled sequence, which its size makes a small share.

A group starts with its pieces in the order they come, each in the fullest bin that takes it, without sorting. What is saved from
there on is the search's work: the least filled bin gives its pieces away, by moves, one-for-one and two-for-one swaps that each
fill another bin up and so raise the sum of squared fills, until it is empty. Where bins are left over the least that the total
allows, a second search starts from the pieces by falling length, and the better result is taken.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm import common

#: Words a worker keeps with their ids, and as many older ones.
MEMO = 300_000
#: Runs of marks that a worker keeps with their ids.
TAILS = 10_000
#: Bytes of text that are split into words at once.
SLICE_BYTES = 1 << 20
#: Sequences' worth of tokens in a group on average.
GROUP = 1_024

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: How the tokenizer's model spells bytes: printable ones as themselves, others from U+0100 on.
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
SPELLED = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class _Words(dict):
    """Lower-cased word (between ASCII white space) to its packed ids.

    The tokenizer lower-cases, drops white space and never joins across it, so words are encoded apart. Letters in a row are one piece,
    and so are ASCII marks behind them, so a word of letters with marks or none behind goes to the tokenizer's model as it is, without the
    tokenizer's steps before it, which leave it alone. This holds for Latin letters (below U+0300: composed, each
    with one lower-case form); other words go through the whole tokenizer.
    """

    def __init__(self, tokenizer):
        self.tokenizer, self.model = tokenizer, tokenizer.model
        self.older: dict = {}
        self.tails = {"": b""}

    def _one(self, piece: str) -> bytes:
        """Ids of one piece, lower-cased, by the model alone."""
        spelled = piece if piece.isascii() else piece.encode().decode("latin-1").translate(SPELLED)
        ids = [t.id for t in self.model.tokenize(spelled)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _tail(self, marks: str) -> bytes:
        if marks not in self.tails:
            if len(self.tails) > TAILS:
                self.tails = {"": b""}
            self.tails[marks] = self._one(marks)
        return self.tails[marks]

    def learn(self, words: set[bytes]) -> None:
        if len(self) > MEMO:
            self.older = dict(self)
            self.clear()
        other = []
        for w in words:
            if w in self:
                continue
            if w in self.older:
                self[w] = self.older[w]
                continue
            s = w.decode().lower()
            stem = s.rstrip(MARKS)
            if not stem.isalpha() or not stem.isascii() and max(stem) >= "\u0300":
                other.append(w)
                continue
            key = stem.encode()
            ids = self.get(key) or self.older.get(key) or self._one(stem)
            self[key] = ids
            self[w] = ids + self._tail(s[len(stem) :])
        for w, e in zip(other, self.tokenizer.encode_batch_fast([w.decode() for w in other], add_special_tokens=False), strict=True):
            self[w] = np.array(e.ids, "<u4").tobytes()


_tokenizers: dict[int, _Words] = {}


def _words(file: bytes) -> _Words:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    key = zlib.crc32(file)
    if key not in _tokenizers:
        t = Tokenizer.from_buffer(file)
        t.no_truncation()
        t.no_padding()
        _tokenizers[key] = _Words(t)
    return _tokenizers[key]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece. A document's ids are its tokens, then end_id; only longer ones are cut, every capacity ids.

    Null and empty texts are the single end_id. Repeated rows give repeated pieces; other columns are not read. row tells
    pieces apart, whatever their documents are.
    """
    spark = common.ship(docs.sparkSession)
    file = spark.sparkContext.broadcast(common.file_bytes(tokenizer_path))
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("row", pa.int64())])
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, row = _words(file.value), TaskContext.get().partitionId() << 40
        for part in common.slices(batches, limit=SLICE_BYTES):
            out = []
            split = [(raw if b"<|" in raw else raw.lower()).split() for raw in common.texts(part.column(1))]
            words.learn(set().union(*split))
            for doc, ws in zip(part.column(0).to_pylist(), split, strict=True):
                ids = b"".join(map(words.__getitem__, ws)) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    out.append((doc, k, at // 4, len(own) // 4, zlib.crc32(own), row))
                    row += 1
            yield common.rows(schema, *zip(*out, strict=True))

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(cut, PIECES + ", row long")


def in_order(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins (lists of item numbers): items as they come, each into the fullest bin that still takes it."""
    bins: list[list[int]] = []
    rooms: list[tuple[int, int]] = []
    for i, n in enumerate(lengths):
        at = bisect_left(rooms, (n, -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        if room > n:
            insort(rooms, (room - n, b))
    return bins


class Search:
    """Empties bins: the least filled one gives, and each step fills another bin, at least as full, by what the giver loses.

    A step is a move of one item, or one item for a smaller one, or two for one, always the one that fills its taker best. Fills of
    giver and taker part with each step, so the sum of squared fills grows and the search ends. A giver that no step
    can help is left as it is; a round without a step is the last. Steps look at the distinct lengths of a bin, of which each bin keeps
    a list, so a bin of many short items costs no more than one of few.
    """

    def __init__(self, bins: list[list[int]], lengths: list[int], capacity: int):
        self.lengths, self.capacity = np.array(lengths, np.int64), capacity
        self.bins = [list(b) for b in bins]
        self.bin_of = np.zeros(len(lengths), np.int64)
        for k, b in enumerate(self.bins):
            self.bin_of[b] = k
        self.room = np.array([*(capacity - int(self.lengths[b].sum()) for b in self.bins), 0], np.int64)
        self.emptied = self.steps = 0
        self.kinds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self._list()

    def run(self) -> list[list[int]]:
        least = -(-int(self.lengths.sum()) // self.capacity)
        alive = len(self.bins)
        gained = True
        while alive > least and gained:
            before = self.steps
            self.rooms = sorted((int(r), k) for k, r in enumerate(self.room.tolist()) if r > 0 and self.bins[k])
            for giver in [k for _, k in reversed(self.rooms)]:
                if alive <= least:
                    break
                if self.room[giver] > 0 and self._empty(giver):
                    alive -= 1
                    self.emptied += 1
            gained = self.steps > before
        return [b for b in self.bins if b]

    def _empty(self, giver: int) -> bool:
        del self.rooms[bisect_left(self.rooms, (int(self.room[giver]), giver))]
        while self.bins[giver] and (self._move(giver) or self._swap(giver)):
            pass
        if self.bins[giver]:
            insort(self.rooms, (int(self.room[giver]), giver))
        return not self.bins[giver]

    def _change(self, giver: int, taker: int, give: list[int], take: list[int]) -> None:
        self.steps += 1
        before, n = int(self.room[taker]), int(self.lengths[give].sum() - self.lengths[take].sum())
        for i in give:
            self.bins[giver].remove(i)
        for i in take:
            self.bins[taker].remove(i)
        self.bins[giver] += take
        self.bins[taker] += give
        self.bin_of[give], self.bin_of[take] = taker, giver
        for b in (giver, taker):
            self._relist(b)
        self.room[giver] += n
        self.room[taker] -= n
        del self.rooms[bisect_left(self.rooms, (before, taker))]
        if before > n:
            insort(self.rooms, (before - n, taker))

    def _lengths(self, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct lengths in a bin, an item of each, and another one of each (-1 where there is none)."""
        if b not in self.kinds:
            items = np.array(self.bins[b], np.int64)
            items = items[np.argsort(self.lengths[items], kind="stable")]
            sizes, at, n = np.unique(self.lengths[items], return_index=True, return_counts=True)
            self.kinds[b] = sizes, items[at], np.where(n > 1, items[np.minimum(at + 1, len(items) - 1)], -1)
        return self.kinds[b]

    def _list(self) -> None:
        """All bins' distinct lengths side by side: length, item and bin, with as much room behind them; span is where a bin's stand."""
        each = [self._lengths(b) for b in range(len(self.bins))]
        ends = np.cumsum([0, *(len(x[0]) for x in each)])
        self.end = int(ends[-1])
        self.size, self.item, self.at = np.zeros((3, 2 * self.end + 1_000), np.int64)
        if each:
            self.size[: self.end], self.item[: self.end] = np.concatenate([x[0] for x in each]), np.concatenate([x[1] for x in each])
            self.at[: self.end] = np.repeat(np.arange(len(each)), np.diff(ends))
        self.span = list(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))

    def _relist(self, b: int) -> None:
        """A bin has changed: its old lengths go to the last bin, which has no room, and its new ones behind all others."""
        del self.kinds[b]
        begin, end = self.span[b]
        self.at[begin:end] = len(self.bins)
        sizes, items, _ = self._lengths(b)
        begin, end = self.end, self.end + len(sizes)
        if end > len(self.at):
            self._list()
            return
        self.size[begin:end], self.item[begin:end], self.at[begin:end] = sizes, items, b
        self.span[b], self.end = (begin, end), end

    def _move(self, giver: int) -> bool:
        """The largest item that fits elsewhere goes to the fullest bin that takes it."""
        sizes, items, _ = self._lengths(giver)
        for n, i in zip(sizes[::-1].tolist(), items[::-1].tolist(), strict=True):
            at = bisect_left(self.rooms, (n, -1))
            if at < len(self.rooms) and self.rooms[at][0] <= self.room[giver]:
                self._change(giver, self.rooms[at][1], [i], [])
                return True
        return False

    def _swap(self, giver: int) -> bool:
        """The best one-for-one swap, or, where there is none, the best two-for-one."""
        room = self.room[self.at[: self.end]]
        theirs = np.flatnonzero((room > 0) & (room <= self.room[giver]) & (self.at[: self.end] != giver))
        if not len(theirs):
            return False
        size = self.size[theirs]
        limit = size + room[theirs]
        sizes, items, others = self._lengths(giver)
        for two in (False, True):
            if two:
                i, j = np.triu_indices(len(items), 1)
                twice = np.flatnonzero(others >= 0)
                offers = np.concatenate([np.stack([items[i], items[j]], 1), np.stack([items[twice], others[twice]], 1)])
            else:
                offers = items[:, None]
            if not len(offers):
                return False
            sums = self.lengths[offers].sum(axis=1)
            by = np.argsort(sums, kind="stable")
            at = np.searchsorted(sums[by], limit, "right") - 1
            gain = np.where(at >= 0, sums[by][np.maximum(at, 0)] - size, 0)
            best = int(np.argmax(gain))
            if gain[best] > 0:
                taken = int(self.item[theirs[best]])
                self._change(giver, int(self.bin_of[taken]), offers[by[at[best]]].tolist(), [taken])
                return True
        return False


def packed(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of items, as lists of item numbers: never more than best-fit decreasing makes."""
    bins = Search(in_order(lengths, capacity), lengths, capacity).run()
    if len(bins) > -(-sum(lengths) // capacity):
        falling = sorted(range(len(lengths)), key=lambda i: -lengths[i])
        start = [[falling[i] for i in b] for b in in_order([lengths[i] for i in falling], capacity)]
        bins = min(bins, Search(start, lengths, capacity).run(), key=len)
    return bins


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset.

    Every row of docs is packed, null and empty texts as the single end_id and repeated rows each on its own.
    An empty table gives an empty result. Pieces in a sequence lie without gaps from offset 0.
    """
    cut, _ = common.written(pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col), "pieces")
    tokens = cut.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    groups = max(1, -(-tokens // (group * capacity)))
    dealt = cut.withColumn("g", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int")).repartition(groups, "g")

    def fill(key, pdf):
        pdf = pdf.sort_values("row", ignore_index=True)
        lengths = pdf["length"].tolist()
        sequence, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        for b, items in enumerate(packed(lengths, capacity)):
            at = 0
            for i in items:
                sequence[i], offset[i] = (int(key[0]) << 32) + b, at
                at += lengths[i]
        return pdf.drop(columns=["g", "row"]).assign(sequence_id=sequence, offset=offset)

    return dealt.groupBy("g").applyInPandas(fill, PIECES + ", sequence_id long, offset long")
