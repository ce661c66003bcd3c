"""Operators on documents: brute force, edge cases, and the pipeline."""

from __future__ import annotations

import collections
import math
import random
import struct
import time
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from marketloom.llm import bpe, bpe_codec, components, line_dedup, lm, minhash, packing, quality, token_counts

WORDS = P.path("word_bpe_49k.json")
BYTES = P.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, n int, gone string, h string, words string"
LONG = " ".join(f"w{i % 977}x" for i in range(30_000))
PARA = " ".join(f"same{i}" for i in range(55))
ODD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one two"), (5, "One  TWO"), (6, "a b c d e f g"), (7, "a b c d e f g"), (7, "a b c d e f g"), (None, "no id here at all, five words"), (None, None), (8, LONG),
    (9, "<|endoftext|> and <|startoftext|>\n\n'll  x"), (10, f"x\n{PARA}\ny"), (11, f"z\n{PARA}\nq"), (12, "\n".join(["ten words in this line which is said over again"] * 12)), (13, "é ß 中文 😀 İ Σ"),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1, "g", "h", "w") for i, t in rows], SCHEMA).repartition(3)


def words(text):
    return (text or "").encode().lower().split()


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, ODD)


def test_prefix_counts_match_the_library():
    b, t = bpe.PrefixBpe(open(BYTES, "rb").read()), Tokenizer.from_file(BYTES)
    rng = random.Random(4)
    parts = ["a", "the", " ", "  ", "\n", "'ll", "'re", "'", "9", "é", "中", "😀", "<|endoftext|>", "!", "...", "ing", "\x85", " "]
    for _ in range(300):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(0, 10)))
        assert b.encode(s) == t.encode(s, add_special_tokens=False).ids
        assert b.decode(b.encode(s)) == s
        counts = [len(t.encode(s[:i], add_special_tokens=False).ids) for i in range(len(s) + 1)]
        p = bpe.TokenPrefixes(b, s)
        assert [p.count(i) for i in range(len(s) + 1)] == counts
        for budget in (0, 1, 4):
            assert p.longest(budget) == max(i for i, c in enumerate(counts) if c <= budget)


def test_prefix_counts_of_pieces_without_a_break():
    b, t = bpe.PrefixBpe(open(BYTES, "rb").read()), Tokenizer.from_file(BYTES)
    rng = random.Random(9)
    for s in ("a" * 100_000, "".join(rng.choice("abcdefgh") for _ in range(100_000)), "中文字" * 30_000, " " * 100_000 + "x", "-" * 50_000 + "<|endoftext|>" * 3):
        began = time.time()
        cut = bpe.TokenPrefixes(b, s).longest(512)
        assert time.time() - began < 20  # grows with the length alone
        count = lambda i: len(t.encode(s[:i], add_special_tokens=False).ids)  # noqa: B023, E731
        assert count(cut) <= 512 < count(cut + 1)


def test_token_counts_and_codec(spark, odd):
    t = Tokenizer.from_file(BYTES)
    want = sorted((i or -1, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in ODD)
    assert sorted((r.id or -1, r.n_bytes, r.n_tokens) for r in token_counts.token_counts(odd, BYTES).collect()) == want
    assert sorted((r.id or -1, r.n_tokens) for r in bpe_codec.round_trip(odd, BYTES).collect()) == [(a, c) for a, _, c in want]
    back = bpe_codec.decode(bpe_codec.encode(odd, BYTES), BYTES)
    assert sorted((r.id or -1, r.text) for r in back.collect()) == sorted((i or -1, x or "") for i, x in ODD)
    assert token_counts.token_counts(odd.limit(0), BYTES).count() == 0
    assert bpe_codec.round_trip(odd.limit(0), BYTES).count() == 0


def check_packing(rows, got, capacity=4096):
    t = Tokenizer.from_file(WORDS)
    want = []
    for i, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), capacity)):
            own = ids[at : at + capacity]
            want.append((i or -1, k, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    assert sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= capacity
    return len(bins), -(-sum(w[3] for w in want) // capacity)


def test_packing(spark, odd):
    n, least = check_packing(ODD, packing.pack(odd, WORDS).collect())
    assert n <= least + 1
    assert packing.pack(odd.limit(0), WORDS).count() == 0


def test_local_search_keeps_documents_and_saves_bins():
    rng = random.Random(1)
    many = [[rng.choice([1, 2, 3, 500, 1000, 1024, 1365, 2048]) for _ in range(rng.randint(1, 200))] for _ in range(60)]  # bins get full while others give
    for lengths in (*many, [rng.choice([1500, 1400, 1300, 2600, 700, 10]) for _ in range(600)], [rng.randint(1, 4096) for _ in range(600)], [rng.randint(5, 1500) for _ in range(600)], [4096] * 3, [5] * 2000, []):
        first = packing.in_order(lengths, 4096)
        search = packing.Search(first, lengths, 4096)
        then = search.run()
        assert sorted(i for b in then for i in b) == list(range(len(lengths)))
        fills = lambda bins: sum(sum(lengths[i] for i in b) ** 2 for b in bins)  # noqa: B023, E731
        assert all(sum(lengths[i] for i in b) <= 4096 for b in then) and len(then) == len(first) - search.emptied
        assert fills(then) > fills(first) if search.steps else then == first


def test_swaps_empty_bins_that_moves_cannot():
    lengths = [2500, 2400, 1500, 1700, 48, 44]
    one = packing.Search([[0, 2], [1, 3]], lengths[:4], 4196)
    assert one.run() and one.emptied == 0  # as few as the total allows
    for bins, sizes in (([[0, 1], [2, 3], [4]], [60, 30, 50, 40, 20]), ([[0, 1], [2, 3], [4, 5]], [60, 37, 50, 45, 2, 1]), ([[0, 1], [2], [3, 4]], [50, 45, 90, 10, 5])):
        s = packing.Search(bins, sizes, 100)
        assert len(s.run()) == 2 and s.emptied == 1


def test_search_empties_bins_of_the_given_documents(spark):
    n = [r.length for r in packing.pieces(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), WORDS).orderBy("row").collect()]
    s = packing.Search(packing.in_order(n, 4096), n, 4096)
    began = len(s.bins)
    assert len(s.run()) == -(-sum(n) // 4096) < began and s.emptied > 0


def test_groups_do_not_follow_ids(spark):
    """Rows without id, or of one id, are dealt over all groups; each group is packed for itself."""
    rows = [(None if k % 2 else 1, f"word{k} " * 40) for k in range(400)]
    got = packing.pack(frame(spark, rows), WORDS, capacity=256, group=8)
    assert got.selectExpr("shiftright(sequence_id, 32) g").groupBy("g").count().where("count > 100").count() == 0
    check_packing(rows, got.collect(), 256)


def brute_components(rows):
    sets = {}
    for i, x in rows:
        w = words(x)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(i for i in sets if i is not None)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def test_near_duplicates(spark, odd):
    rng = random.Random(7)
    base = [f"v{rng.randint(0, 400)}" for _ in range(120)]
    rows = list(ODD)
    for k in range(100, 190):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = f"n{rng.randint(0, 10**6)}"
        rows.append((k, " ".join(w)))
    want = brute_components(rows)
    got = minhash.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == want[r.id]
    kept = minhash.drop_near_duplicates(frame(spark, rows))
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, v in want.items() if v[2]} | {None}
    assert minhash.near_duplicates(odd.limit(0)).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 60)] + [(100, 101), (101, 100)], "a long, b long")
    labels, _ = components.components(edges)
    assert {r.id: r.label for r in labels.collect()} == {k: 1 for k in range(1, 61)} | {100: 100, 101: 100}


def test_line_dedup(spark, odd):
    got = collections.Counter((r.doc_id, r.text, r.n_removed_lines) for r in line_dedup.dedup_lines(odd).collect())
    want = collections.Counter((i, x, 0) for i, x in ODD if i not in (11, 12))
    want[(11, "z\nq", 1)] += 1
    want[(12, "\n".join(["ten words in this line which is said over again"] * 5), 7)] += 1
    assert got == want
    assert line_dedup.dedup_lines(odd.limit(0)).count() == 0


def test_line_dedup_extends_past_the_window_and_leaves_common_lines(spark):
    a = [f"short line {k} of a few words" for k in range(9)]
    rows = [(1, "\n".join(["first", *a, "end"])), (2, "\n".join(["other", *a, "close"])), (3, "\n".join([a[0], "else"]))]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert got == {1: rows[0][1], 2: "other\nclose", 3: rows[2][1]}


def test_quality(spark, odd):
    import re

    got = collections.Counter((r.id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.quality(odd).collect())
    want = collections.Counter()
    for i, x in ODD:
        x = x or ""
        w = re.findall("[^\x20\x09-\x0d]+", x)
        at = collections.defaultdict(list)
        for k in range(len(w) - 4):
            at[tuple(w[k : k + 5])].append(k)
        again = {k + j for v in at.values() if len(v) > 1 for k in v for j in range(5)}
        lines = [y for y in x.split("\n") if y.split()]
        want[(i, len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", x)), len(lines) - len(set(lines)), len(again), len(w) < 10 or 100 * len(again) > 20 * len(w))] += 1
    assert got == want
    assert quality.quality(odd.limit(0)).count() == 0
    assert quality.keep_good(odd).columns == odd.columns
    assert quality.quality(odd.drop("lang")).count() == len(ODD)


def test_lm(spark, odd):
    got = lm.score(odd).collect()
    train = [x for i, x in ODD if zlib.crc32(str(i).encode() if i is not None else b"") % 5 != 1]
    c = collections.Counter(w for x in train for w in [*words(x), b"\n"])
    n, v = sum(c.values()), len(c)
    want = collections.Counter()
    for i, x in ODD:
        w = [*words(x), b"\n"]
        want[(i, not lm.is_training(i), len(w), sum(c[k] > 0 for k in w), n, round(sum(math.log10((c[k] + 0.5) / (n + 0.5 * (v + 1))) for k in w), 6))] += 1
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert lm.score(odd.limit(0)).count() == 0


def brute_scores(rows):
    """The formula of the module, n-gram by n-gram."""
    c, whole = collections.Counter(), collections.Counter()
    seqs = {i: ["<s>", *words(x), "</s>"] for i, x in rows}
    for i, q in seqs.items():
        if lm.is_training(i):
            c.update(tuple(q[t - k + 1 : t + 1]) for t in range(1, len(q)) for k in (1, 2, 3) if t - k + 1 >= 0)
    for g, n in c.items():
        whole[g[:-1]] += n
    v = sum(len(g) == 1 for g in c)
    left = {}
    for k in (2, 3):
        own = {g: n for g, n in c.items() if len(g) == k}
        once, twice = (sum(n == m for n in own.values()) for m in (1, 2))
        kinds, sums = collections.Counter(), collections.Counter()
        for g, n in own.items():
            size = int(math.log2(whole[g[:-1]]))
            kinds[size] += 1
            sums[size] += n
        left[k] = {s: (once + 1) / (once + 2 * twice + 2) * kinds[s] / sums[s] for s in kinds}

    def p(g):
        if len(g) == 1:
            return (c[g] + 0.5) / (whole[()] + 0.5 * (v + 1))
        n = whole[g[:-1]]
        if not n:
            return p(g[1:])
        b = left[len(g)][int(math.log2(n))]
        return (1 - b) * c[g] / n + b * p(g[1:])

    return {i: sum(math.log10(p(tuple(q[max(0, t - 2) : t + 1]))) for t in range(1, len(q))) for i, q in seqs.items()}, p, c


def test_lm_score_is_that_of_all_ngrams(spark, monkeypatch):
    """Over several blocks, groups and stretches, with words, pairs and triples that occur once."""
    monkeypatch.setattr(lm, "BLOCK", 20_000)
    monkeypatch.setattr(lm, "GROUP", 2_000)
    rng = random.Random(5)
    common = [f"word{rng.randint(0, 10**6)}" for _ in range(60)]
    rows = [(k, " ".join(rng.choice(common[: 5 + k]) for _ in range(rng.choice([3, 60, 700])))) for k in range(240)]
    rows += [(1000 + k, f"zq{k}jx vv{k}kk {common[k]} nul\0 é{k}") for k in range(20)] + [(2000, ""), (2001, None), (2002, rows[7][1])]
    got = {r.doc_id: r.score for r in lm.score(frame(spark, rows)).collect()}
    want, p, c = brute_scores(rows)
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 * (1 + abs(want[i])) for i in want)
    vocabulary = [g[0] for g in c if len(g) == 1]
    for h in [(), (words(rows[3][1])[0],), ("<s>",), tuple(words(rows[3][1])[:2]), ("<s>", words(rows[4][1])[0])]:
        assert abs(sum(p((*h, w)) for w in vocabulary) + p((*h, "never seen")) - 1) < 1e-9


def test_rows_that_share_an_id_are_documents_of_their_own(spark):
    run = "\n".join(f"line {k} of a run that several documents of this table share word for word {k * 7}" for k in range(6))
    lines = [(1, run), (2, "alpha stays here\n" + run), (2, "beta first line\nbeta SECOND line must stay\nbeta third"), (2, run + "\nomega")]
    got = collections.Counter(r.text for r in line_dedup.dedup_lines(spark.createDataFrame(lines, "doc_id long, text string").repartition(3)).collect())
    assert got == {run: 1, "alpha stays here": 1, lines[2][1]: 1, "omega": 1}

    tail = " ".join(f"t{k}" for k in range(40))
    x, y, z = f"x {tail}", f"y {tail}", " ".join(f"other{k}" for k in range(40))
    near = [(5, x), (5, f"{y} more"), (9, f"{y} more."), (5, z), (9, z), (7, "a b"), (7, "a b"), (8, "A  b"), (None, x), (5, None)]
    found = minhash.near_duplicates(spark.createDataFrame(near, "doc_id long, text string").repartition(3)).collect()
    want = [(5, 5), (5, 5), (9, 5), (5, 5), (9, 5), (7, 7), (7, 7), (8, 7), (None, None), (5, 5)]
    assert collections.Counter((r.id, r.component_id) for r in found) == collections.Counter(want)
    apart = [(5, z), (9, x), (5, y + " more"), (9, z)]
    found = minhash.near_duplicates(spark.createDataFrame(apart, "doc_id long, text string")).collect()
    assert collections.Counter((r.id, r.component_id, r.kept) for r in found) == collections.Counter([(5, 5, True), (9, 5, False), (5, 5, True), (9, 5, False)])
    kept = [r.text for r in minhash.drop_near_duplicates(spark.createDataFrame([*near, (9, "quite alone")], "doc_id long, text string")).collect()]
    assert sum(t in (x, near[1][1], near[2][1]) for t in kept[:]) == 2 and kept.count(z) == 1 and kept.count("a b") == 2 and "A  b" not in kept and "quite alone" in kept and None in kept

    good = " ".join(f"word{k % 37} and the other thing of it" for k in range(12))
    docs = spark.createDataFrame([(1, good, "en"), (1, "too short", "en"), (None, "bad", "en"), (None, good, "en")], "doc_id long, text string, lang string")
    judged = quality.quality(docs).collect()
    assert sorted(r.text for r in quality.keep_good(docs).collect()) == [good] * sum(r.kept for r in judged)


def test_random_ids_against_brute_force(spark):
    rng = random.Random(12)
    base = [" ".join(rng.choice("abcdefghij") + str(rng.randint(0, 30)) for _ in range(40)) for _ in range(6)]
    rows = []
    for _ in range(120):
        w = rng.choice(base).split()
        for _ in range(rng.choice((0, 0, 1, 2))):
            w[rng.randrange(len(w))] = "z"
        rows.append((rng.randint(0, 25), " ".join(w)))
    got = collections.Counter((r.id, r.component_id) for r in minhash.near_duplicates(frame(spark, rows)).collect())
    sets = [{tuple(words(t)[i : i + 5]) for i in range(len(words(t)) - 4)} for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    least = {}
    for x, (i, _) in zip(label, rows, strict=True):
        least[x] = min(i, least.get(x, i))
    assert got == collections.Counter((i, least[x]) for x, (i, _) in zip(label, rows, strict=True))


def test_lm_is_no_worse_than_its_base(spark, sf):
    for d in (sf, "/root/testdata/sf0.01"):
        r = lm.score(spark.read.parquet(f"{d}/documents.parquet")).where("held_out").selectExpr("sum(score) / sum(n_tokens) as s", "sum(base_score) / sum(n_tokens) as b").first()
        assert r.s >= r.b


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = corpus_pipeline.run(spark, sf).collect()
    good = {r.id for r in quality.quality(docs).where("kept").collect()}
    rows = [(i, x) for i, x in rows if i in good]
    cut = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect() if not r.n_removed_lines or words(r.text)}
    kept = brute_components(list(cut.items()))
    n, least = check_packing([(i, x) for i, x in cut.items() if kept[i][2]], got)
    assert n <= least + 1
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "minhash_near_dedup", "best_fit_packing"]


def test_words_whose_hashes_share_their_first_bits_are_counted_apart(spark):
    import numpy as np

    from marketloom.llm import lm

    word, pair = 5 << 2 | 1, 9 << 2 | 2
    rows = [(0, block, lm._zip(np.diff([word, pair], prepend=0), "<u8"), lm._zip(np.array([low]), "<u2"), lm._zip(np.array([n, n]), "<u4")) for block, low, n in ((1, 7, 2), (2, 8, 3), (3, 7, 5))]
    got = lm.counted(spark.createDataFrame(rows, "bucket long, block long, keys binary, low binary, n binary"), 4).collect()
    assert {r.block: lm._unzip(r.c, "<u8").tolist() for r in got} == {1: [7, 10], 2: [3, 10], 3: [7, 10]}
    assert sum(lm._unzip(r.first, "<u1").astype(int) for r in got).tolist() == [2, 1]
    assert [r.stats[:2] for r in got if r.stats] == [[2, 10]]


def test_packing_never_makes_more_bins_than_best_fit_decreasing():
    rng = random.Random(5)
    mixes = [[rng.randint(1, 4096) for _ in range(600)], [rng.randint(1200, 2400) for _ in range(600)], [rng.randint(3, 60) for _ in range(9_000)] + [rng.randint(1500, 4000) for _ in range(300)], [7] * 20_000, []]
    for lengths in mixes:
        falling = packing.in_order(sorted(lengths, reverse=True), 4096)
        made = packing.packed(lengths, 4096)
        assert sorted(i for b in made for i in b) == list(range(len(lengths)))
        assert all(0 < sum(lengths[i] for i in b) <= 4096 for b in made)
        assert -(-sum(lengths) // 4096) <= len(made) <= len(falling)
    middle = [rng.randint(1200, 2400) for _ in range(600)]
    assert len(packing.packed(middle, 4096)) < len(packing.in_order(sorted(middle, reverse=True), 4096))

def test_packing_workers_keep_a_bounded_number_of_words():
    words = packing._Words(Tokenizer.from_file(WORDS))
    for k in range(16):
        words.learn({f"{'abcdefghijklmnop'[k]}x{i}".encode() for i in range(50_000)})
    assert len(words) + len(words.older) <= 700_000


def test_packing_takes_words_of_letters_past_the_tokenizer_with_the_same_ids():
    full = Tokenizer.from_file(WORDS)
    words = packing._Words(full)
    rng = random.Random(3)
    odd = {"".join(rng.choice("abXYéÈßÄİıŉǅʰªº²½µΣσςЖ한ÅΩ'#$.,<|>_-01̸́­") for _ in range(rng.randint(1, 6))) for _ in range(3000)} | {"x<|endoftext|>"}
    words.learn({w.encode() for w in odd})
    assert all(words[w.encode()] == struct.pack(f"<{len(e.ids)}I", *e.ids) for w, e in zip(odd, full.encode_batch(list(odd), add_special_tokens=False), strict=True))

    class Model:
        model = full.model

        def encode_batch_fast(self, texts, add_special_tokens):
            assert not texts
            return []

    packing._Words(Model()).learn({"naïve***".encode(), b"plain", b"marks.,", "Été".encode()})
