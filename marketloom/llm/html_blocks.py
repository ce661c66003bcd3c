"""Leaf blocks of a web page: texts between block tags, with the path of tags above each."""

from __future__ import annotations

import re
from html import unescape

#: Tags that end a block of text, tags whose content is never shown, and tags without content.
BLOCK_TAGS = frozenset("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split())
HIDDEN_TAGS = frozenset("script style template noscript iframe object svg math head canvas".split())
RAW_TAGS = frozenset("script style textarea title iframe noscript noframes xmp".split())
EMPTY_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What a head can have; any other opening tag, and text, ends an open head, as in browsers.
HEAD_TAGS = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
#: Opening one of these closes an open one of its own group.
CLOSES = {t: frozenset(c.split()) for t, c in {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}.items()}
LISTS = frozenset("ul ol dl table select menu".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: No deeper than this is the path of a block; what lies deeper belongs to the last element of it.
DEPTH = 512

SPACE = r"[ \t\n\f\r]"
OPENING = re.compile(r"<(?=[a-zA-Z/!?])")
TAG = re.compile(r"<(/?)([a-zA-Z][^ \t\n\f\r/>]*)")
#: The end of a tag, or an attribute. A quote counts only right after the equals sign, and only if another one closes it.
ATTRIBUTE = re.compile(rf"""[ \t\n\f\r/]*(?:(>)|(=?[^ \t\n\f\r/>=]+|=)(?:{SPACE}*={SPACE}*(?:"([^"]*)"|'([^']*)'|([^ \t\n\f\r>]*)))?)""")
COMMENT_END = re.compile(r"--!?>")
PARTS = re.compile(r"[A-Za-z]+")
UNSHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
RAW_END = {t: re.compile(rf"</{t}(?=[ \t\n\f\r/>])", re.I) for t in RAW_TAGS}


class Place:
    """An open element: its tag, the words of its class, id and role, whether it hides its content, and the place around it."""

    __slots__ = ("tag", "names", "hides", "above", "number")

    def __init__(self, tag: str, names: tuple, hides: bool, above: Place | None):
        self.tag, self.names, self.hides, self.above, self.number = tag, names, hides, above, -1


class Block:
    """A block's text (decoded, white space single), its place, and its linked characters."""

    __slots__ = ("text", "place", "linked")

    def __init__(self, text: str, place: Place | None, linked: int):
        self.text, self.place, self.linked = text, place, linked

    @property
    def tag(self) -> str:
        return self.place.tag if self.place else ""


def attributes(html: str, at: int) -> tuple[int, tuple, bool]:
    """From behind a tag's name: the tag's end (-1 if it has none), the words of class, id and role, and whether it is not to be shown."""
    names: tuple = ()
    unshown = False
    while True:
        m = ATTRIBUTE.match(html, at)
        if not m:
            return -1, names, unshown
        at = m.end()
        if m[1]:
            return at, names, unshown
        key = m[2].lower()
        if key in ("class", "id", "role"):
            names += tuple(PARTS.findall((m[3] or m[4] or m[5] or "").lower()))
        elif key == "hidden" or key == "style" and UNSHOWN.search(m[3] or m[4] or m[5] or ""):
            unshown = True


class _Open:
    """The open elements. A tag that is not open costs nothing to close, and none lies deeper than DEPTH."""

    def __init__(self):
        self.stack: list[Place] = []
        self.count: dict[str, int] = {}
        self.beyond: dict[str, int] = {}
        self.hidden = 0

    @property
    def top(self) -> Place | None:
        return self.stack[-1] if self.stack else None

    def push(self, tag: str, names: tuple, hides: bool) -> None:
        if len(self.stack) >= DEPTH and (self.hidden or not hides):
            self.beyond[tag] = self.beyond.get(tag, 0) + 1
            return
        self.stack.append(Place(tag, names, hides, self.top))
        self.count[tag] = self.count.get(tag, 0) + 1
        self.hidden += hides

    def pop(self) -> None:
        gone = self.stack.pop()
        self.count[gone.tag] -= 1
        self.hidden -= gone.hides
        self.beyond.clear()

    def close(self, tags: frozenset, stop: frozenset = frozenset()) -> bool:
        """Closes the innermost open element of tags, and all inside it, unless one of stop lies between."""
        for t in tags:
            if self.beyond.get(t):
                self.beyond[t] -= 1
                return False
        if not any(self.count.get(t) for t in tags):
            return False
        k = len(self.stack) - 1
        while self.stack[k].tag not in tags:
            if self.stack[k].tag in stop:
                return False
            k -= 1
        while len(self.stack) > k:
            self.pop()
        return True


def blocks(html: str) -> list[Block]:
    """The blocks with text of a page, in page order, in time that grows with the page's length alone.

    Tags are read as browsers read them: unclosed and stray ones are borne with, and a tag that the page's end cuts off is
    dropped with what it swallowed. Content of hidden tags, of elements with the attribute hidden, and of those that a style attribute
    hides is left out. A quote that nothing closes is an ordinary letter.
    """
    out: list[Block] = []
    opened = _Open()
    text: list[str] = []
    linked, in_link = 0, False
    at, n = 0, len(html)

    def flush() -> None:
        nonlocal linked
        if text:
            whole = " ".join(unescape("".join(text)).split())
            if whole:
                out.append(Block(whole, opened.top, linked))
            text.clear()
        linked = 0

    while at < n:
        m = OPENING.search(html, at)
        begin = m.start() if m else n
        m = TAG.match(html, begin) if m else None
        if opened.hidden and opened.top.tag == "head" and (html[at:begin].strip(" \t\n\r\f") or m and not m[1] and m[2].lower() not in HEAD_TAGS):
            opened.pop()
        if begin > at and not opened.hidden:
            piece = html[at:begin]
            text.append(piece)
            if in_link:
                linked += len(piece)
        if begin == n:
            break
        if not m:
            if html.startswith("<!--", begin):
                short = 5 if html.startswith(">", begin + 4) else 6 if html.startswith("->", begin + 4) else 0
                end = None if short else COMMENT_END.search(html, begin + 4)
                at = begin + short if short else end.end() if end else n
            else:
                at = html.find(">", begin) + 1 or n
            continue
        at, names, unshown = (m.end() + 1, (), False) if html.startswith(">", m.end()) else attributes(html, m.end())
        if at < 0:
            break
        tag, closing = m[2].lower(), bool(m[1])
        if tag == "a":
            in_link = not closing
        if tag not in BLOCK_TAGS and tag not in HIDDEN_TAGS and tag not in RAW_TAGS:
            if closing:
                opened.close(frozenset((tag,)))
            elif unshown and tag not in EMPTY_TAGS:
                opened.push(tag, names, True)
            continue
        flush()
        if closing:
            if opened.close(frozenset((tag,))):
                in_link = False
            continue
        if tag in EMPTY_TAGS:
            continue
        if tag in RAW_TAGS:
            end = RAW_END[tag].search(html, at)
            at = attributes(html, end.end())[0] if end else n
            if at < 0:
                break
            continue
        top = opened.top.tag if opened.stack else ""
        if top == "p" or top in HEADINGS and tag in HEADINGS:
            opened.pop()
        group = CLOSES.get(tag)
        if group:
            opened.close(group, LISTS)
        if tag == "body" and opened.hidden:
            while opened.hidden:
                opened.pop()
        opened.push(tag, names, unshown or tag in HIDDEN_TAGS)
    flush()
    return out
