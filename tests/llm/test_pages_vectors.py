"""Operators on pages and vectors."""

from __future__ import annotations

import base64
import glob
import gzip
import hashlib
import html
import os
import random
import re
import time

import numpy as np

from marketloom.llm import ann, html_extract, warc
from marketloom.llm.html_blocks import blocks

PAGES = "page_id long, url string, html string, id string, digest string, size int"


def test_blocks_bear_with_broken_markup():
    page = "<html><head><title>t</title><script>var t='<p>no</p>';</script></head><body><p>a&amp;b <b>c<p>d\n  e<br>f<ul><li>g<li>h</ul><!-- no --><div>i<div>j</div>k"
    assert [b.text for b in blocks(page)] == ["a&b c", "d e", "f", "g", "h", "i", "j", "k"]
    assert blocks("") == [] and [b.text for b in blocks("plain &copy; text")] == ["plain © text"]


def test_blocks_of_a_page_that_leaves_out_the_end_of_its_head():
    start = "<html>\n<head>\n<title>t</title>\n<meta charset=x><style>p {}</style><noframes>no</noframes>\n"
    for body in ("<p>one<p>two", "<DIV>one</DIV>two", "one<p>two", "<b>one</b><h1>two</h1>", "<svg><p>no</p></svg><p>one<p>two", "<body>one<p>two"):
        assert [b.text for b in blocks(start + body)] == ["one", "two"], body
    assert [b.text for b in blocks(start + "<template><p>no</p></template><script>no</script></head><p>one")] == ["one"]


def texts(page):
    return [b.text for b in blocks(page)]


def test_quotes_count_only_around_values():
    assert texts("<article><a title=it's href=x>Link</a><p>One it is.</p><p>Two don't stop.</p></article>") == ["Link", "One it is.", "Two don't stop."]
    assert texts('<p class="x>One.') == ["One."]
    assert texts("<p>a</p><img alt=5'><p>b</p><p>it's</p>") == ["a", "b", "it's"]
    assert texts("<p title='a > b' class=\"c\">d</p ><!--> e --><p>f<b") == ["d", "e -->", "f"]


def test_content_that_is_not_shown():
    assert texts("<p>a <span hidden>no <b>x</b></span> b<div style='display: none'><p>no</p></div><p hidden>no<p>c") == ["a b", "c"]


def test_hostile_pages_take_time_by_their_length():
    for page in ("<a" * 500_000, "<a " * 200_000, "<" + "a" * 500_000, "<" * 300_000, "<div>" * 100_000 + "</p>" * 100_000, "<script>" + "</script " * 100_000, "<a" + ' b="c' * 200_000, "<!--" * 200_000):
        began = time.time()
        html_extract.features(blocks(page))
        assert time.time() - began < 10


def test_pages_of_which_neither_tags_nor_names_tell_the_regions():
    model, maker = html_extract.trained(), html_extract._Maker(123)
    hits = whole = wrong = 0
    for _ in range(60):
        page = blocks(maker.nameless())
        want = ["\x01" in b.text for b in page]
        for b in page:
            b.text = " ".join(b.text.replace("\x01", " ").split())
        got = model.main([html_extract.features(page)])[0].tolist()
        hits += sum(len(b.text) for b, w, g in zip(page, want, got, strict=True) if w and g)
        whole += sum(len(b.text) for b, w in zip(page, want, strict=True) if w)
        wrong += sum(len(b.text) for b, w, g in zip(page, want, got, strict=True) if g and not w)
    assert hits > 0.97 * whole and wrong < 0.05 * whole


def test_labeller_on_pages_it_has_not_seen():
    model = html_extract.trained()
    pages, labels = html_extract.made_up(150, seed=99)
    found = model.main([html_extract.features(p) for p in pages])
    right = np.concatenate([f == (y > 0) for f, y in zip(found, labels, strict=True)])
    assert right.mean() > 0.98


def test_extract(spark, sf):
    got = html_extract.extract(spark.read.parquet(f"{sf}/pages.parquet")).collect()
    source = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in got:
        article = re.search(r"<article>(.*?)</article>", source[r.id], re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", article))
        assert r.text == "\n".join(x for x in parts if x)
    odd = spark.createDataFrame([(1, "u", None, "x", "y", 1), (None, None, "", "x", "y", 1), (2, "u", "<p>", "x", "y", 1), (2, "u", "<p>", "x", "y", 1)], PAGES)
    assert sorted((r.id or 0, r.text) for r in html_extract.extract(odd).collect()) == [(0, ""), (1, ""), (2, ""), (2, "")]
    assert html_extract.extract(odd.limit(0)).count() == 0


def test_archive_round_trip(spark):
    rows = [(1, "http://a\r\nX: y", "same", "i", "d", 1), (2, None, "same", "i", "d", 1), (3, "u", None, "i", "d", 1), (4, "u", "", "i", "d", 1), (5, "u", "é WARC/1.1\r\n\r\nWARC/1.1\r\nx", "i", "d", 1), (6, "u", "z" * 200_000, "i", "d", 1), (7, "u", "t", "i", "d", 1), (7, "u", "t", "i", "d", 1)]
    got = sorted((r.record_id, r.warc_type, r.refers_to, r.payload_bytes, r.payload_digest, r.gap) for r in warc.archived(spark.createDataFrame(rows, PAGES)).collect())
    last = {}
    for i, _, h, *_ in rows:
        last[h or ""] = max(last.get(h or "", 0), i)
    want = []
    for i, _, h, *_ in rows:
        b = (h or "").encode()
        first = last[h or ""]
        want.append((f"urn:x-page:{i}", "response" if i == first else "revisit", None if i == first else f"urn:x-page:{first}", len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), None))
    assert got == sorted(want)
    assert warc.archived(spark.createDataFrame([], PAGES)).count() == 0


def record(n: int, body: bytes = b"hello") -> bytes:
    block = b"HTTP/1.1 200 OK\r\n\r\n" + body
    digest = base64.b32encode(hashlib.sha1(body).digest())
    return b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:%d>\r\nWARC-Payload-Digest: sha1:%s\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (n, digest, len(block), block)


def found(data: bytes):
    return [(r["warc-record-id"][12:-1] if r else None, why) for _, _, r, why in warc.salvage(data)]


def test_salvage_recovers_what_follows_damage():
    good = record(1) + record(2, b"x WARC/1.1\r\n y") + record(3)
    assert found(good) == [("1", ""), ("2", ""), ("3", "")]
    cut = record(1) + record(2)[:-30] + record(3)
    assert [x for x, _ in found(cut)] == ["1", None, "3"]
    flipped = record(1) + record(2).replace(b"hello", b"jello") + record(3)
    assert found(flipped) == [("1", ""), (None, "digest differs"), ("3", "")]
    assert [x for x, _ in found(b"junk" + record(1) + b"tail")] == [None, "1", None]
    gaps = [(b, e) for b, e, r, _ in warc.salvage(cut) if r is None]
    assert gaps == [(len(record(1)), len(record(1)) + len(record(2)) - 30)]
    assert list(warc.salvage(b"")) == []


def test_salvage_of_gzip_members():
    parts = [gzip.compress(record(n)) for n in (1, 2, 3)]
    assert [x for x, _ in found(b"".join(parts))] == ["1", "2", "3"]
    hurt = bytearray(parts[1])
    hurt[20] ^= 0xFF
    assert [x for x, _ in found(parts[0] + bytes(hurt) + parts[2])] == ["1", None, "3"]


def test_salvage_of_one_damaged_gzip_member():
    """As Spark compresses a file: all records in one member."""
    rng = random.Random(2)
    body = lambda: bytes(rng.randrange(32, 127) for _ in range(3_000))
    whole = gzip.compress(b"".join(record(n, body()) for n in range(20)))
    assert [x for x, _ in found(whole)] == [str(n) for n in range(20)]
    assert [x for x, _ in found(whole[:-12])][:19] == [str(n) for n in range(19)] and found(whole[:-12])[-1] == (None, "broken gzip member")
    hurt = bytearray(whole)
    hurt[len(hurt) // 2] ^= 0xFF
    ids = [x for x, _ in found(bytes(hurt) + gzip.compress(record(77)))]
    assert ids[:8] == [str(n) for n in range(8)] and ids[-2:] == [None, "77"]
    wrong = whole[:-8] + b"\0" * 8  # the checksum alone
    assert [x for x, _ in found(wrong)] == [*map(str, range(20)), None]


def test_salvage_takes_time_by_length():
    began = time.time()
    assert found(b"WARC/1.1\r\n" * 100_000 + b"a: b\r\n" * 10 + record(1))[-1] == ("1", "")
    assert time.time() - began < 10


def test_large_pages_have_files_of_their_own(spark, tmp_path):
    rows = [(k, "u", "x" * (3_000_000 if k < 3 else 200_000 if k < 200 else 10) + str(k), "i", "d", 1) for k in range(260)]
    warc.write(spark.createDataFrame(rows, PAGES).coalesce(1), f"{tmp_path}/a")
    sizes = [os.path.getsize(f) for f in glob.glob(f"{tmp_path}/a/part-*")]
    assert max(sizes) < 16 << 20 and sum(s > 3_000_000 for s in sizes) >= 3
    got = warc.read(spark, f"{tmp_path}/a", payloads=False).collect()
    assert len(got) == 260 and all(r.gap is None for r in got)


def exact(rows, every=20, k=20):
    ok = {i: np.array(v, float) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in ok:
        if q % every == 0:
            s = sorted((-float(v @ ok[q]), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))[:k]
            out[q] = [i for _, i in s]
    return out


def test_nearest(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=16)]) for i in range(300)]
    rows += [(300 + i, rows[40][1]) for i in range(60)]
    rows += [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] * 16), (1060, [None] + [1.0] * 15), (1080, []), (None, [1.0] * 16), (1100, [1.0, 2.0]), (40, rows[40][1])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, v string, class int").repartition(4)
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = {}
    for r in sorted(ann.nearest(df).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append(r.id)
    want = exact(rows)
    want = {q: v for q, v in want.items() if v}
    hits = sum(len(set(v) & set(got[q])) for q, v in want.items())
    assert hits >= 0.99 * sum(map(len, want.values())) and set(got) == set(want)
    assert got[40] == want[40]
    assert ann.nearest(df.limit(0)).count() == 0


def test_nearest_over_many_blocks(spark, monkeypatch):
    """Recall against brute force, with several blocks and packs of queries, two dimensions and ids with two vectors."""
    monkeypatch.setattr(ann, "BLOCK", 700)
    monkeypatch.setattr(ann, "PACK", 50)
    monkeypatch.setattr(ann, "STEP", 128)
    rng = np.random.default_rng(6)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=32 if i % 3 else 8)]) for i in range(6_000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    found = {}
    for r in ann.nearest(df).collect():
        found.setdefault(r.query_id, {})[r["rank"]] = (r.id, r.score)
    want, vectors = exact(rows), dict(rows)
    assert found.keys() == want.keys()
    hits = sum(len(set(v) & {i for i, _ in found[q].values()}) for q, v in want.items())
    assert hits >= 0.95 * sum(map(len, want.values()))
    for q, own in found.items():
        assert sorted(own) == list(range(1, 21)) and all(abs(s - np.dot(vectors[q], vectors[i])) < 1e-9 for i, s in own.values())
        assert [s for _, (_, s) in sorted(own.items())] == sorted((s for _, s in own.values()), reverse=True)


def test_bounds_leave_most_vectors_unread():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(20_000, 256))
    b = ann.Block(np.arange(len(x)), x, *ann.encode(x))
    b.search(x[:20], 21)
    assert b.reranked < 0.1 * 20 * len(x)


def test_nearest_of_an_id_with_two_vectors(spark):
    df = spark.createDataFrame([(20, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [0.25, 1.0]), (2, [0.1, 0.1])], "vec_id long, embedding array<float>")
    got = sorted((r["rank"], r.id, round(r.score, 6)) for r in ann.nearest(df).collect())
    assert got in ([(1, 1, 0.5), (2, 2, 0.1)], [(1, 1, 0.25), (2, 2, 0.1)])
