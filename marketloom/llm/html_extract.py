"""HTML extraction [1]: a recurrent labeller reads a page's blocks forwards and backwards and classifies each.

A block's vector holds its hashed tag path and class names, its hashed words, and a few shares (links, stops,
length, place). A bidirectional LSTM, in numpy, passes over the sequence of blocks, so each is judged with
the whole page in view. It is trained on pages that this module makes up: the same regions under many tags
and names, in random words, so that structure and not vocabulary decides. Training takes seconds, is the same in
every run, and its weights, a few dozen kilobytes, are broadcast.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from marketloom.llm import common
from marketloom.llm.html_blocks import Block, Place, blocks

TAGS, NAMES, WORDS, SHARES = 96, 96, 32, 12
MARKS = 2 * TAGS + NAMES
WIDTH = MARKS + WORDS + SHARES
HIDDEN = 16
#: Made-up pages to train on, and passes over them.
PAGES, EPOCHS = 1_100, 6
#: Share of these in which neither tags nor names tell the regions apart.
NAMELESS = 0.2
#: Blocks that are labelled in one go.
TOGETHER = 6_000

_buckets: dict[tuple, int] = {}


def _bucket(kind: str, value: str, size: int) -> int:
    key = (kind, value)
    b = _buckets.get(key)
    if b is None:
        b = zlib.crc32(f"{kind}:{value}".encode()) % size
        if len(value) <= 40:
            if len(_buckets) > 300_000:
                _buckets.clear()
            _buckets[key] = b
    return b


class Features:
    """A page's blocks for the labeller: which set of marks (hashed tags, tag pairs and names of its path) each has, these sets, and the rest as rows of numbers.

    Blocks with one path share its set, so memory follows the blocks and not their depth.
    """

    def __init__(self, page: list[Block]):
        self.sets: list[np.ndarray] = []
        self.numbers: dict[tuple, int] = {}
        self.which = np.fromiter((self._set(b.place) for b in page), np.int32, len(page))
        self.rest = np.zeros((len(page), WORDS + SHARES), np.float32)
        total, seen = sum(len(b.text) for b in page) + 1, 0
        for i, b in enumerate(page):
            words = b.text.split()
            counts = np.bincount([_bucket("w", w, WORDS) for w in words], minlength=WORDS)
            self.rest[i, :WORDS] = counts / len(words)
            n, tag = len(b.text), b.tag
            stops = b.text.count(".") + b.text.count(",")
            self.rest[i, WORDS:] = (
                min(1.0, len(words) / 50), min(1.0, len(words) / 8), min(1.0, b.linked / n), min(1.0, stops / 6), stops / len(words) if stops < len(words) else 1.0,
                seen / total, n / total, tag == "p", tag in ("h1", "h2", "h3"), tag == "li", i / len(page), 1.0,
            )
            seen += n

    def __len__(self) -> int:
        return len(self.which)

    def _set(self, place: Place | None) -> int:
        chain = []
        while place is not None and place.number < 0:
            chain.append(place)
            place = place.above
        number = self._number((-1, "", "", ())) if place is None else place.number
        for p in reversed(chain):
            number = p.number = self._number((number, p.above.tag if p.above else "", p.tag, p.names))
        return number

    def _number(self, key: tuple) -> int:
        """Of the set of marks that an element with this tag and these names has inside the set key[0]."""
        number = self.numbers.get(key)
        if number is None:
            outer, above, tag, names = key
            marks = set(self.sets[outer].tolist()) if outer >= 0 else set()
            if tag:
                marks |= {_bucket("t", tag, TAGS), TAGS + _bucket("p", f"{above}>{tag}" if above else tag, TAGS), *(2 * TAGS + _bucket("n", x, NAMES) for x in names)}
            number = self.numbers[key] = len(self.sets)
            self.sets.append(np.array(sorted(marks), np.int16))
        return number

    def dense(self) -> np.ndarray:
        """A row for each block, for training."""
        x = np.zeros((len(self), WIDTH), np.float32)
        for i, k in enumerate(self.which.tolist()):
            x[i, self.sets[k]] = 1
        x[:, MARKS:] = self.rest
        return x


def features(page: list[Block]) -> Features:
    return Features(page)


class Labeller:
    """A bidirectional LSTM and a logistic layer over both its outputs."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        h = HIDDEN
        self.p = {}
        for d in "fb":
            self.p["w" + d] = rng.normal(0, 0.08, (WIDTH, 4 * h)).astype(np.float32)
            self.p["u" + d] = rng.normal(0, 0.15, (h, 4 * h)).astype(np.float32)
            self.p["c" + d] = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)]).astype(np.float32)
        self.p["v"] = rng.normal(0, 0.2, 2 * h).astype(np.float32)
        self.p["o"] = np.zeros(1, np.float32)

    def _pass(self, d: str, x: np.ndarray) -> tuple[np.ndarray, list]:
        """For training. x: time, page, width. Returns the outputs, and what each step computed."""
        t, n, _ = x.shape
        h = HIDDEN
        z = (x.reshape(t * n, -1) @ self.p["w" + d] + self.p["c" + d]).reshape(t, n, 4 * h)
        s, c, out, steps = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32), np.zeros((t, n, h), np.float32), []
        for k in range(t):
            a = z[k] + s @ self.p["u" + d]
            gates = 1 / (1 + np.exp(-a[:, : 3 * h]))
            i, f, o, g = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :], np.tanh(a[:, 3 * h :])
            before, c = c, f * c + i * g
            tc = np.tanh(c)
            steps.append((s, before, i, f, o, g, tc))
            s = o * tc
            out[k] = s
        return out, steps

    def _back(self, d: str, x: np.ndarray, steps: list, grad: np.ndarray, g_: dict) -> None:
        t, n, _ = x.shape
        h = HIDDEN
        ds, dc, da = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32), np.zeros((t, n, 4 * h), np.float32)
        du = np.zeros_like(self.p["u" + d])
        for k in range(t - 1, -1, -1):
            s, before, i, f, o, g, tc = steps[k]
            ds = ds + grad[k]
            dc = dc + ds * o * (1 - tc * tc)
            a = da[k]
            a[:, :h], a[:, h : 2 * h] = dc * g * i * (1 - i), dc * before * f * (1 - f)
            a[:, 2 * h : 3 * h], a[:, 3 * h :] = ds * tc * o * (1 - o), dc * i * (1 - g * g)
            du += s.T @ a
            ds, dc = a @ self.p["u" + d].T, dc * f
        flat = da.reshape(t * n, -1)
        g_["w" + d], g_["u" + d], g_["c" + d] = x.reshape(t * n, -1).T @ flat, du, flat.sum(0)

    @staticmethod
    def _laid(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pages side by side, forwards and backwards, each from time 0, and the mask of real blocks."""
        t = max(len(p) for p in pages)
        f = np.zeros((t, len(pages), WIDTH), np.float32)
        b, mask = np.zeros_like(f), np.zeros((t, len(pages)), bool)
        for k, p in enumerate(pages):
            f[: len(p), k], b[: len(p), k], mask[: len(p), k] = p, p[::-1], True
        return f, b, mask

    def train(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = EPOCHS, batch: int = 48, rate: float = 0.01) -> None:
        rng = np.random.default_rng(11)
        m, v, count = {k: np.zeros_like(x) for k, x in self.p.items()}, {k: np.zeros_like(x) for k, x in self.p.items()}, 0
        for _ in range(epochs):
            order = rng.permutation(len(pages))
            for at in range(0, len(order), batch):
                some = order[at : at + batch]
                f, b, mask = self._laid([pages[k] for k in some])
                y = np.zeros(mask.shape, np.float32)
                for col, k in enumerate(some):
                    y[: len(labels[k]), col] = labels[k]
                of, sf = self._pass("f", f)
                ob, sb = self._pass("b", b)
                both = np.concatenate([of, _turned(ob, mask)], axis=2)
                p = 1 / (1 + np.exp(-(both @ self.p["v"] + self.p["o"])))
                e = np.where(mask, p - y, 0) / mask.sum()
                g = {"v": (both * e[..., None]).sum((0, 1)), "o": e.sum(keepdims=True).reshape(1)}
                db = e[..., None] * self.p["v"]
                self._back("f", f, sf, db[..., :HIDDEN], g)
                self._back("b", b, sb, _turned(db[..., HIDDEN:], mask), g)
                count += 1
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    self.p[k] = self.p[k] - (rate * (m[k] / (1 - 0.9**count)) / (np.sqrt(v[k] / (1 - 0.999**count)) + 1e-8)).astype(np.float32)

    def _scores(self, d: str, pages: list[Features]) -> np.ndarray:
        """What one direction adds to the score of every block of the pages, one after the other. Steps are laid out a few at a time."""
        h, w = HIDDEN, self.p["w" + d]
        sizes = np.array([len(p) for p in pages])
        first = np.cumsum(sizes) - sizes
        sets = np.cumsum([0, *(len(p.sets) for p in pages)])
        of_set = np.stack([w[s].sum(0) for p in pages for s in p.sets]) + self.p["c" + d]
        which, rest = np.concatenate([p.which + k for p, k in zip(pages, sets, strict=False)]), np.concatenate([p.rest for p in pages])
        v = self.p["v"][:h] if d == "f" else self.p["v"][h:]
        s, c, out = np.zeros((len(pages), h), np.float32), np.zeros((len(pages), h), np.float32), np.zeros(len(which), np.float32)
        stretch = max(1, TOGETHER // len(pages))
        for at in range(0, int(sizes.max()), stretch):
            k = np.arange(at, min(at + stretch, int(sizes.max())))[:, None]
            here = k < sizes
            place = first + np.where(here, k if d == "f" else sizes - 1 - k, 0)
            z = of_set[which[place]] + rest[place] @ w[MARKS:]
            for j in range(len(z)):
                a = z[j] + s @ self.p["u" + d]
                gates = 1 / (1 + np.exp(-a[:, : 3 * h]))
                c = gates[:, h : 2 * h] * c + gates[:, :h] * np.tanh(a[:, 3 * h :])
                s = gates[:, 2 * h :] * np.tanh(c)
                out[place[j][here[j]]] = (s @ v)[here[j]]
        return out

    def main(self, pages: list[Features]) -> list[np.ndarray]:
        """For each page, whether each of its blocks is main text."""
        out: list = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and (end - at + 1) * len(pages[order[end]]) <= TOGETHER:
                end += 1
            some = [pages[k] for k in order[at:end]]
            score = self._scores("f", some) + self._scores("b", some) + self.p["o"]
            for k, own in zip(order[at:end], np.split(score > 0, np.cumsum([len(p) for p in some])[:-1]), strict=True):
                out[k] = own
            at = end
        return out


def _turned(x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Each page's rows in reverse, padding left where it is."""
    n = mask.sum(0)
    k = np.arange(len(mask))[:, None]
    at = np.where(k < n, n - 1 - k, k)
    return np.take_along_axis(x, at[..., None], axis=0)


class _Maker:
    """Makes up pages with known main text."""

    MAIN = ["article", "post", "entry", "content", "main", "story", "body", "text", "page", "blog"]
    REGIONS = {
        "nav": ["nav", "menu", "navbar", "navigation", "breadcrumb", "topnav", "links"],
        "header": ["header", "masthead", "banner", "top", "logo", "site", "branding"],
        "footer": ["footer", "bottom", "copyright", "legal", "colophon"],
        "aside": ["sidebar", "aside", "widget", "related", "popular", "recommended", "trending"],
        "ad": ["ad", "ads", "advert", "advertisement", "sponsor", "promo", "adsense"],
        "notice": ["cookie", "notice", "consent", "gdpr", "alert", "popup", "modal", "newsletter", "subscribe"],
        "comments": ["comments", "comment", "replies", "discussion", "disqus", "respond"],
        "share": ["share", "social", "sharing", "tags", "meta", "byline", "author"],
    }

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        r = self.r
        return "".join(r.choice("bcdfghklmnprstvwz") + r.choice("aeiouéüó") + r.choice(["", "", "n", "r", "s"]) for _ in range(r.randint(1, 4)))

    def words(self, lo: int, hi: int, end: str = "") -> str:
        ws = [self.word() for _ in range(self.r.randint(lo, hi))]
        if self.r.random() < 0.12:
            ws = [w + self.r.choice(["&amp;", "***", "%%%", "###", "$$$"]) for w in ws]
        if end:
            ws = [w + ("," if self.r.random() < 0.08 else "." if self.r.random() < 0.06 else "") for w in ws]
        return " ".join(ws).capitalize() + end

    def name(self, kind: str) -> str:
        r = self.r
        own = self.MAIN if kind == "main" else self.REGIONS[kind]
        n = r.choice(own)
        if r.random() < 0.3:
            n += r.choice(["-", "_", " "]) + r.choice(["wrap", "box", "inner", "area", "container", "block", "list", "col"])
        return f' {r.choice(["class", "class", "id"])}="{n}"' if r.random() < 0.85 else ""

    def region(self, kind: str) -> str:
        """Text that is not main, under one of the ways to write it."""
        r = self.r
        link = lambda: f'<a href="/{self.word()}">{self.words(1, 3)}</a>'
        tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside"}.get(kind, r.choice(["div", "div", "section"]))
        named = True
        if tag not in ("div", "section") and r.random() < 0.4:
            tag = "div"
        elif tag not in ("div", "section"):
            named = r.random() < 0.5
        attr = self.name(kind) if named else ""
        if named and not attr and tag in ("div", "section"):
            attr = f' class="{r.choice(self.REGIONS[kind])}"'
        if kind == "nav":
            inner = "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(r.randint(2, 9))) + "</ul>" if r.random() < 0.8 else " ".join(link() for _ in range(r.randint(2, 8)))
        elif kind == "comments":
            inner = f"<h3>{self.words(1, 3)}</h3>" + "".join(f'<{r.choice(["p", "div", "li"])}{r.choice(["", " class=comment"])}>{self.words(4, 45, ".")}' for _ in range(r.randint(1, 6)))
        elif kind == "aside":
            inner = f"<h3>{self.words(1, 4)}</h3>" + r.choice(["<ul>" + "".join(f"<li>{link()}</li>" for _ in range(r.randint(2, 6))) + "</ul>", f"<p>{self.words(6, 40, '.')}</p>"])
        elif kind == "footer":
            inner = r.choice([f"&copy; {self.word()}.example.com &middot; {self.words(3, 16, '.')}", f"<p>&copy; 2020 {self.words(2, 6)}</p>" + " | ".join(link() for _ in range(r.randint(1, 5))), f"<p>{self.words(5, 30, '.')}</p>"])
        elif kind == "notice":
            inner = r.choice([f"<p>{self.words(6, 30, '.')}</p><button>{self.words(1, 2)}</button>", f"<form><label>{self.words(2, 5)}</label><input name=q><button>{self.words(1, 2)}</button></form>", self.words(5, 25, ".")])
        elif kind == "header":
            inner = r.choice([f"<h2>{self.words(1, 4)}</h2><p>{self.words(2, 8)}</p>", f'<a href="/">{self.words(1, 3)}</a>', f"<div>{self.words(1, 6)}</div>"])
        elif kind == "share":
            inner = " ".join(link() for _ in range(r.randint(2, 5)))
        else:
            inner = r.choice([self.words(3, 25, "."), f"<p>{self.words(3, 25, '.')}</p>", f'<a href="x">{self.words(3, 12, ".")}</a>', f"<h4>{self.words(1, 4)}</h4><p>{self.words(5, 30, '.')}</p>"])
        return f"<{tag}{attr}>{inner}</{tag}>"

    def main(self) -> list[str]:
        """Parts of main text: markup whose text is all main."""
        r = self.r
        parts = []
        if r.random() < 0.9:
            parts.append(f"<h1>{self.words(2, 12, r.choice(['', '.']))}</h1>")
        for _ in range(r.randint(1, r.choice([3, 10, 22]))):
            k = r.random()
            if k < 0.72:
                body = self.words(1, r.choice([4, 30, 120]), ".")
                if r.random() < 0.15:
                    body += f' <a href="#">{self.words(1, 4)}</a> {self.words(2, 12, ".")}'
                parts.append(f"<p>{body}" + ("</p>" if r.random() < 0.85 else ""))
            elif k < 0.82:
                parts.append(f"<p><b>{self.words(1, 14, '.')}<br>")
            elif k < 0.88:
                parts.append(f"<h{r.choice('23')}>{self.words(1, 7)}" + f"</h{2}>" * 0 + "</h2></h3>")
            elif k < 0.93:
                parts.append("<ul>" + "".join(f"<li>{self.words(3, 25, '.')}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif k < 0.96:
                parts.append(f"<blockquote>{self.words(5, 40, '.')}</blockquote>")
            else:
                parts.append(f"<table><tr><td>{self.words(1, 5)}</td><td>{self.words(1, 5)}</td></tr></table>")
        return parts

    def nameless(self) -> str:
        """A page of div elements whose names say nothing, and no tag that does: links, short lines and the text's own shape are all there is."""
        r = self.r
        attr = lambda: r.choice(["", f' class="x{self.word()}{r.randint(0, 99)}"', f' id={self.word()}'])
        link = lambda: f'<a href="/{self.word()}">{self.words(1, 3)}</a>'
        links = lambda: r.choice([" ".join, " | ".join, lambda x: "<ul><li>" + "<li>".join(x) + "</ul>"])([link() for _ in range(r.randint(2, 9))])
        around = lambda inner: f"<div{attr()}>{inner}</div>"
        tag = r.choice(["p", "p", "div"])
        own = attr() if tag == "div" else ""
        parts = [f"<h1>\x01{self.words(2, 12)}</h1>"] if r.random() < 0.8 else []
        for _ in range(r.randint(2, 14)):
            k = r.random()
            if k < 0.85:
                parts.append(f"<{tag}{own}>\x01{self.words(r.choice([4, 20]), r.choice([40, 90]), '.')}</{tag}>")
            elif k < 0.93:
                parts.append(f"<h{r.choice('23')}>\x01{self.words(1, 7)}</h2></h3>")
            else:
                parts.append("<ul>" + "".join(f"<li>\x01{self.words(4, 25, '.')}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
        before = [around(x) for x in (self.words(1, 4), links(), links()) if r.random() < 0.6]
        after = [around(x) for x in (links(), f"&copy; 2020 {self.words(1, 5)} {link()}", self.words(1, 5)) if r.random() < 0.6]
        body = around("".join(parts))
        return "<html><head><title>x</title></head><body>" + "".join(before) + (around(body) if r.random() < 0.3 else body) + "".join(after)

    def page(self) -> tuple[str, list[int]]:
        """html, with main text marked by a sign that block texts show, and no labels yet."""
        r = self.r
        if r.random() < NAMELESS:
            return self.nameless(), []
        mark = lambda part: part.replace(">", ">\x01", 1) if "<li>" not in part and "<td>" not in part else part.replace("<li>", "<li>\x01").replace("<td>", "<td>\x01")
        parts = [mark(x) for x in self.main()]
        for kind in ("ad", "share", "aside", "notice"):
            if r.random() < 0.12:
                parts.insert(r.randint(1, len(parts)), self.region(kind))
        outer = r.choice(["article", "article", "article", "main", "div", "div", "section"])
        attr = f' class="{r.choice(self.MAIN)}"' if outer in ("div", "section") else self.name("main") if r.random() < 0.3 else ""
        body = f"<{outer}{attr}>{''.join(parts)}</{outer}>"
        if r.random() < 0.25:
            body = f'<div{r.choice(["", " id=content", " class=container", " class=wrapper"])}>{body}</div>'
        order = [k for k in ("notice", "header", "nav", "ad", "share") if r.random() < 0.5]
        if r.random() < 0.35:
            order = ["nav", "ad"]
        before = [self.region(k) for k in order]
        after = [self.region(k) for k in ("share", "aside", "comments", "ad", "nav", "notice") if r.random() < 0.3]
        r.shuffle(after)
        if r.random() < 0.85:
            after.append(self.region("footer"))
        if r.random() < 0.2:
            before, after = before + [self.region("aside")], after
        return "<html><head><title>x</title></head><body>" + "".join(before) + body + "".join(after) + "</body></html>", []


def made_up(n: int, seed: int = 5) -> tuple[list[list[Block]], list[np.ndarray]]:
    """Blocks of n made-up pages and their labels."""
    maker, pages, labels = _Maker(seed), [], []
    for _ in range(n):
        page = blocks(maker.page()[0])
        labels.append(np.array(["\x01" in b.text for b in page], np.float32))
        for b in page:
            b.text = " ".join(b.text.replace("\x01", " ").split())
        keep = [k for k, b in enumerate(page) if b.text]
        pages.append([page[k] for k in keep])
        labels[-1] = labels[-1][keep]
    return pages, labels


_trained: list[Labeller] = []


def trained() -> Labeller:
    """The labeller, trained once for a driver."""
    if not _trained:
        pages, labels = made_up(PAGES)
        labeller = Labeller()
        labeller.train([features(p).dense() for p in pages], labels)
        _trained.append(labeller)
    return _trained[0]


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """Per row: id, url, text (the main blocks joined by line feeds; empty if none), n_blocks and n_main.

    Null and empty html give an empty text. Ids and urls are passed on as they are, repeated rows give repeated
    results, other columns are not read, and an empty table gives an empty result. Pages are read whole.
    """
    spark = common.ship(pages.sparkSession)
    model = spark.sparkContext.broadcast(trained().p)
    schema = pa.schema([("id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_blocks", pa.int64()), ("n_main", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller()
        labeller.p = model.value
        for part in common.slices(batches):
            read = [blocks(raw.decode()) for raw in common.texts(part.column(1))]
            main = labeller.main([features(p) for p in read])
            chosen = [[b.text for b, is_main in zip(p, m, strict=True) if is_main] for p, m in zip(read, main, strict=True)]
            yield common.rows(schema, part.column(0), part.column(2), ["\n".join(c) for c in chosen], [len(p) for p in read], [len(c) for c in chosen])

    return pages.select(pages[id_col].cast("long").alias("id"), pages[html_col].cast("string").alias("html"), pages[url_col].cast("string").alias("url")).mapInArrow(run, "id long, url string, text string, n_blocks long, n_main long")
