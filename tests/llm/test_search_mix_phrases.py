"""Ranked search, mixing and phrase mining against brute force, with odd rows and hot groups."""

from __future__ import annotations

import collections
import math
import random
import re

import numpy as np
import pytest

from marketloom.llm import lexical, mixing, phrases
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, rank int, term string, h long, row long, w1 string, n int"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LONG = " ".join(f"w{i % 977}x the" for i in range(20_000))
ODD = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, None), (4, "One two.Two three", "en", "b"), (5, "two TWO two", "en", "b"), (5, "two TWO two", "en", "b"), (5, "other text two", None, "é"),
    (None, "two one", "und", None), (None, None, None, None), (6, LONG, "en", "a"), (7, "É é ß-ß 中文 😀 İ Σ two", "fr", "ß"), (8, "...,;:!?", "fr", "Z"), (9, "one two three four one two three four", "en", "a"),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 1, "t", 5, 6, "w", 2) for i, t, lang, s in rows], SCHEMA).repartition(3)


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# ---- ranked search


def brute_search(docs, items, top=10):
    found = [(i, TERM.findall(lower(t))) for i, t in docs]
    found = [(i, collections.Counter(x), len(x)) for i, x in found if x]
    n_docs, n_terms = len(found), sum(n for *_, n in found)
    df = collections.Counter(t for _, c, _ in found for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(TERM.findall(lower(t)))
    out = []
    for i, terms in asked.items():
        scored = []
        for doc, c, n in found:
            m = 100 - 90 + 90 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if s > 0:
                scored.append((-s, doc is None, doc or 0))
        out += [(i, k, None if none else doc, -s) for k, (s, none, doc) in enumerate(sorted(scored)[:top], 1)]
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def test_search_of_odd_rows(spark):
    items = [(1, "two three"), (2, None), (3, ""), (4, "nothing like it"), (5, "TWO two"), (5, "中文"), (None, "one"), (6, LONG), (7, "é É ß")]
    asked = spark.createDataFrame([(i, t, 1, "d", 3) for i, t in items], "item_id long, text string, score long, doc_id string, ids int")
    for block in (lexical.BLOCK, 400):
        got = [tuple(r) for r in lexical.search(frame(spark, ODD), asked, block=block).collect()]
        assert ordered(got) == ordered(brute_search([r[:2] for r in ODD], items))
    nothing = frame(spark, ODD).where("doc_id > 100")
    assert lexical.search(nothing, asked).count() == 0 and lexical.search(frame(spark, ODD), asked.where("item_id > 100")).count() == 0


def test_search_in_small_runs_with_ties(spark):
    rng = random.Random(3)
    word = lambda: f"t{min(int(rng.expovariate(0.2)), 40)}"
    docs = [(i % 350, " ".join(word() for _ in range(rng.choice((1, 3, 30))))) for i in range(400)] + [(1000 + i, "t1 t2 t30") for i in range(50)]
    items = [(i, " ".join(word() for _ in range(6))) for i in range(40)]
    got = lexical.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string"), block=100).collect()
    assert ordered(tuple(r) for r in got) == ordered(brute_search(docs, items))


def test_accumulator_cuts_runs_between_documents(monkeypatch):
    monkeypatch.setattr(lexical, "MATCHES", 7)
    starts, holders = np.array([0, 3, 5]), np.array([0, 1, 2, 0, 2])
    acc = lexical.Accumulator(3, starts, holders, np.array([10, 1]), 5, 9, 2)
    acc.add([10, 11, None, 13], [2, 1, 2, 1], np.array([0, 2, 3, 5, 6]), np.array([0, 1, 0, 0, 1, 1]), np.array([1, 1, 1, 1, 1, 2]))
    long, short = 10 + 90 * 2 * 5 // 9, 10 + 90 * 5 // 9
    x = lambda tf, m: 10**9 * tf // (1000 * tf + 8 * m)
    both, one, two = 11 * x(1, long), 10 * x(1, short), x(2, short)
    assert two < both < one
    assert sorted(acc.best(), key=str) == sorted([(0, 11, one), (0, 10, both), (1, 11, one), (1, 10, 10 * x(1, long)), (2, 11, one), (2, 10, both)], key=str)


def test_radix_order():
    rng = np.random.default_rng(1)
    for most in (1, 300, 70_000, 1 << 33):
        keys = rng.integers(0, most, 5000)
        assert (lexical.radix_order(keys, most) == np.argsort(keys, kind="stable")).all()


# ---- mixing


def brute_targets(sizes):
    """sizes: of each source, in order. The excess is dealt out again and again."""
    weights = [mixing.WEIGHTS[i % 3] for i in range(len(sizes))]
    target, left, free = [0.0] * len(sizes), 1.5 * sum(sizes), set(range(len(sizes)))
    while free and left > 1e-9:
        whole, share = sum(weights[i] for i in free), left
        left = 0.0
        for i in sorted(free):
            target[i] += share * weights[i] / whole
            if target[i] >= 2 * sizes[i]:
                left += target[i] - 2 * sizes[i]
                target[i] = 2.0 * sizes[i]
                free.discard(i)
    return target


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check_mix(spark, rows, **options):
    docs, pieces = mixing.mix(frame(spark, rows), **options)
    docs_, pieces = docs.collect(), pieces.collect()
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(n_words(t) for _, t, _, s in rows if s == name) for name in names]
    want = dict(zip(names, brute_targets(sizes), strict=True))
    assert sorted((r.doc_id, r.source, r.size) for r in docs_ if r.doc_id and r.source) == sorted((i, s, n_words(t)) for i, t, _, s in rows if i and s) and len(docs_) == len(rows)
    own = {r.row: r for r in docs_}
    got, used, by_source = collections.Counter(), collections.defaultdict(collections.Counter), collections.Counter()
    for p in pieces:
        assert p.words > 0 and 0 <= p.start and p.start + p.words <= own[p.row].size
        got[p.row] += p.words
        used[p.row].update(range(p.start, p.start + p.words))
        by_source[own[p.row].source] += p.words
    assert all(max(c.values()) <= 2 for c in used.values())
    for r in docs_:
        assert abs(r.target - want[r.source]) < 1e-6 * (1 + r.target) and r.source_size == sizes[names.index(r.source)]
        assert got[r.row] <= 2 * r.size and abs(by_source[r.source] - r.target) <= 0.5 + 1e-6
    for shard in {p.shard for p in pieces}:
        mine = sorted(p.position for p in pieces if p.shard == shard)
        assert mine == list(range(len(mine)))
    return docs_, pieces


def test_mix_of_odd_rows(spark):
    check_mix(spark, ODD)
    check_mix(spark, ODD, block=7, shard_blocks=3)
    docs, pieces = mixing.mix(frame(spark, ODD).where("doc_id > 100"))
    assert docs.count() == 0 and pieces.count() == 0
    docs, pieces = mixing.mix(frame(spark, [(1, None, "en", "a"), (2, " ", "en", None)]))
    assert [(r.size, r.target) for r in docs.collect()] == [(0, 0.0), (0, 0.0)] and pieces.count() == 0


def test_mix_with_a_hot_source(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.choice((1, 5, 40, 300))), "en", "hot" if i % 3 == 0 else f"s{i % 7}") for i in range(600)]
    first = check_mix(spark, rows, block=64, shard_blocks=8)
    monkeypatch.setattr(mixing, "RANGE_ROWS", 16)
    monkeypatch.setattr(mixing, "DEAL", 2)
    docs, pieces = check_mix(spark, rows, block=64, shard_blocks=8)
    taken = lambda docs, pieces: sorted((own[p.row], p.shard, p.start, p.words) for own in [{r.row: r.doc_id for r in docs}] for p in pieces)
    assert taken(docs, pieces) == taken(*first)
    blocks = collections.Counter(p.shard for p in pieces)
    words = collections.Counter()
    for p in pieces:
        words[p.shard] += p.words
    assert len(blocks) > 20 and max(words.values()) <= 8 * 64


def test_hypergeometric_draws(spark):
    for total, good, drawn in [(50, 20, 10), (9, 9, 4), (9, 0, 4), (5, 3, 5), (40_000, 13_000, 20_000)]:
        whole = math.comb(total, drawn)
        share = lambda k: math.comb(good, k) * math.comb(total - good, drawn - k) / whole
        n = 2000
        lit = lambda v: F.lit(v).cast("long")
        found = spark.range(n).select(mixing.hypergeometric(lit(total), lit(good), lit(drawn), (F.col("id") + 0.5) / n).alias("k")).groupBy("k").count().collect()
        assert sum(r["count"] for r in found) == n
        assert all(abs(r["count"] - n * share(r.k)) <= 1.5 for r in found)


def test_tree_has_the_quotas(spark):
    quotas = [(0, 100), (1, 37), (4, 1), (5, 400)]
    made = spark.createDataFrame(quotas, "place int, blocks long")
    rows = mixing.split_tree(made, 538, 9, seed=3).collect()
    for place, n in quotas:
        mine = sorted((r["first"], r["n"]) for r in rows if r["place"] == place)
        assert mine[0][0] == 0 and all(a + k == b for (a, k), (b, _) in zip(mine, mine[1:], strict=False)) and sum(k for _, k in mine) == n
    shards = collections.Counter()
    for r in rows:
        shards[r["shard"]] += r["n"]
    assert set(shards.values()) <= {59, 60} and len(shards) == 9
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.split_tree(made, 538, 9, seed=3).collect()))
    assert sorted(map(tuple, rows)) != sorted(map(tuple, mixing.split_tree(made, 538, 9, seed=4).collect()))


# ---- phrases


def brute_phrases(rows, least=30, top=2000):
    f, n = collections.Counter(), collections.Counter()
    for _, text, lang, _ in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            f.update((lang or "und", tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    found = {k: v for k, v in f.items() if len(k[1]) > 1 and v >= least}
    out = []
    for lang in n:
        rows = []
        for (x, p), a in found.items():
            longer = [v for (y, q), v in found.items() if y == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if x == lang and not any(100 * v >= 80 * a for v in longer):
                score, _, left, right = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, k, p.decode(), -a, left, right, n[lang], -s) for k, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def mined(df, **options):
    return sorted(tuple(r) for r in phrases.collocations(df, **options).collect())


def test_phrases_of_odd_rows(spark):
    for least in (1, 2):
        assert mined(frame(spark, [r for r in ODD if r[0] != 6]), least=least) == brute_phrases([r for r in ODD if r[0] != 6], least)
    assert mined(frame(spark, ODD)) == brute_phrases(ODD)
    assert mined(frame(spark, ODD).where("doc_id > 100")) == []


@pytest.mark.parametrize("split", [phrases.SPLIT, 1])
def test_phrases_against_brute_force(spark, monkeypatch, split):
    rng = random.Random(8)
    word = lambda: rng.choice("aA bB c d É ef the the the the in in".split() + ["x\x0by", "p.q", "the\x01"])
    rows = [(i, " ".join(rng.choice(("the In", "A b C d", word())) + rng.choice(("", "", "", ",", "\t", "\n")) for _ in range(rng.randint(0, 60))), rng.choice(("en", None, "fr")), "s") for i in range(150)]
    monkeypatch.setattr(phrases, "SPLIT", split)
    monkeypatch.setattr(phrases, "BUCKET_WORDS", 100)
    for least, top in ((5, 2000), (12, 7)):
        assert mined(frame(spark, rows), least=least, top=top) == brute_phrases(rows, least, top)


def test_packed_runs_come_back():
    rng = np.random.default_rng(2)
    for n in (0, 1, 1000):
        keys, counts = np.unique(rng.integers(0, 1 << phrases.PAIR_BITS, n).astype(np.uint64)), None
        counts = rng.integers(1, 1 << 40, len(keys)).astype(np.uint64)
        a, b = phrases.unpacked(phrases.packed(keys, counts))
        assert (a == keys).all() and (b == counts).all()


def test_phrases_do_not_rest_on_the_filter(spark, monkeypatch):
    monkeypatch.setattr(phrases, "bitmap", lambda hashes: np.full(phrases.FILTER_BITS // 64, (1 << 64) - 1, np.uint64))
    rows = [r for r in ODD if r[0] != 6]
    assert mined(frame(spark, rows), least=2) == brute_phrases(rows, 2)
