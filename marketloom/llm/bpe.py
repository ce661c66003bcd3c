"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a piece there is one token that ends its encoding. It is the token that ends there (an
automaton of all tokens names the candidates) and that can stand after the last token of what precedes it.
Whether two tokens can stand side by side is a property of the pair, so each prefix needs a few pair tests
and no merge loop, and the answer for every prefix remains known.
"""

from __future__ import annotations

import json

import ahocorasick
import numpy as np
import regex

#: The split pattern and the contractions of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
LONG_CONTRACTIONS = ("'re", "'ve", "'ll")
SPACES, ALNUM = regex.compile(r"\p{White_Space}+"), regex.compile(r"[\p{L}\p{N}]")

FOREVER = 1 << 60
#: Entries a worker keeps of pieces and of pair tests; beyond these the memory is emptied.
MEMO = 600_000
#: Longer pieces are not kept.
MEMO_CHARS = 48


def byte_letters() -> dict[str, int]:
    """The letter by which a vocabulary file writes each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixBpe:
    """A vocabulary with its merges, from the bytes of a tokenizer file.

    Texts: null counts as empty; the strings of special tokens inside a text become those tokens, as the
    tokenizer's library does by default.
    """

    def __init__(self, file: bytes):
        spec = json.loads(file)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        raw = lambda s: bytes(letters[c] for c in s)
        self.bytes_of: dict[int, bytes] = {i: raw(s) for s, i in vocab.items()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.born: dict[int, int] = {}
        self.merge_rank: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.merge_rank[left, right] = rank
            if whole not in self.born:
                self.born[whole] = rank
                self.parts[whole] = left, right
        self.automaton = ahocorasick.Automaton()
        for i, b in self.bytes_of.items():
            if len(b) == 1 or i in self.born:
                self.automaton.add_word(b.decode("latin-1"), (len(b), i))
        self.automaton.make_automaton()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: s for s, i in self.special.items()}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.at_special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.pieces_of = regex.compile(PATTERN).findall
        self.pair_memo: dict[tuple[int, int], bool] = {}
        self.prefixes = _Prefixes(self)
        self.ids = _Ids(self)

    def stands(self, a: int, b: int) -> bool:
        """Whether token b can follow token a: no merge across their border comes before the merges that make them.

        The merges along the border are undone, latest first. While both inner tokens exist, a merge of
        theirs that ranks before what ended them would have been taken. Of equal ranks the left one goes first.
        """
        known = self.pair_memo.get((a, b))
        if known is not None:
            return known
        x, y, x_ends, y_ends, good = a, b, FOREVER, FOREVER, True
        while True:
            rank = self.merge_rank.get((x, y), FOREVER)
            if rank < x_ends and rank <= y_ends and rank != FOREVER:
                good = False
                break
            x_born, y_born = self.born.get(x, -1), self.born.get(y, -1)
            if x_born < 0 and y_born < 0:
                break
            if x_born > y_born:
                x, x_ends = self.parts[x][1], x_born
            else:
                y, y_ends = self.parts[y][0], y_born
        if len(self.pair_memo) >= MEMO:
            self.pair_memo.clear()
        self.pair_memo[a, b] = good
        return good

    def last_tokens(self, piece: bytes) -> list[tuple[int, int]]:
        """For every prefix length from 1: (length, id) of the token that ends the prefix's encoding."""
        last: list[tuple[int, int]] = []
        done = -1
        stands, known = self.stands, self.pair_memo
        for end, token in self.automaton.iter(piece.decode("latin-1")):
            if end == done:
                continue
            start = end + 1 - token[0]
            if start:
                pair = last[start - 1][1], token[1]
                if not (known[pair] if pair in known else stands(*pair)):
                    continue
            last.append(token)
            done = end
        return last

    def encode_piece(self, piece: bytes) -> list[int]:
        """Follows the back-pointers from the piece's end."""
        last, out, at = self.last_tokens(piece), [], len(piece)
        while at:
            n, token = last[at - 1]
            out.append(token)
            at -= n
        return out[::-1]

    def prefix_counts(self, piece: bytes) -> list[int]:
        """Tokens of each prefix of the piece, the empty one first."""
        counts = [0]
        for at, (n, _) in enumerate(self.last_tokens(piece), 1):
            counts.append(counts[at - n] + 1)
        return counts

    def char_counts(self, piece: str) -> np.ndarray:
        """Tokens of the prefixes that end at each character of the piece."""
        raw = piece.encode()
        counts = np.array(self.prefix_counts(raw)[1:], np.int64)
        if len(raw) == len(piece):
            return counts
        inner = (np.frombuffer(raw, np.uint8) & 0xC0) == 0x80
        return counts[np.flatnonzero(~np.r_[inner[1:], False])]

    def parts_of(self, text: str) -> list[str | int]:
        """The text's pieces, special tokens as ids."""
        if self.at_special is None or not any(s in text for s in self.special):
            return self.pieces_of(text)
        out: list[str | int] = []
        for part in self.at_special.split(text):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += self.pieces_of(part)
        return out

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self.parts_of(text):
            out += [part] if isinstance(part, int) else self.ids[part]
        return out

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


class _Memo(dict):
    def __init__(self, bpe: PrefixBpe):
        self.bpe = bpe

    def keep(self, piece, value):
        if not isinstance(piece, int) and len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.clear()
            self[piece] = value
        return value


class _Ids(_Memo):
    """Piece to its ids."""

    def __missing__(self, piece):
        return (piece,) if isinstance(piece, int) else self.keep(piece, tuple(self.bpe.encode_piece(piece.encode())))


class _Prefixes(_Memo):
    """Piece to the token counts of its prefixes, a number for each character: bytes for a short piece, an array for a long one."""

    def __missing__(self, piece):
        if isinstance(piece, int):
            return b"\x01"
        counts = self.bpe.char_counts(piece)
        return self.keep(piece, counts.astype(np.uint8).tobytes()) if len(piece) <= MEMO_CHARS else counts


class TokenPrefixes:
    """Exact token counts of every prefix of one text, without encoding anything again.

    ``count(i)`` gives the tokens of ``text[:i]``; ``longest(budget)`` the longest prefix with so many
    tokens at most. Both look up stored counts. A prefix that ends in white space ends in one run of it, whatever
    follows in the text, and one that ends inside a special token's string has its letters, split as any others; such
    places get counts of their own, once. No special string may begin with another.
    """

    def __init__(self, bpe: PrefixBpe, text: str, parts: list | None = None, counts: list | None = None):
        self.bpe, self.text = bpe, text
        self.parts = bpe.parts_of(text) if parts is None else parts
        self.counts = list(map(bpe.prefixes.__getitem__, self.parts)) if counts is None else counts
        sizes = [len(bpe.names[p] if isinstance(p, int) else p) for p in self.parts]
        self.starts = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        self.before = np.concatenate([[0], np.cumsum([c[-1] for c in self.counts], dtype=np.int64)])
        self.known: dict[int, np.ndarray] = {}

    @property
    def total(self) -> int:
        return int(self.before[-1])

    def _within(self, p: int) -> np.ndarray:
        """The counts of the prefixes that end at each character of part p."""
        if p not in self.known:
            part, own = self.parts[p], self.counts[p]
            if isinstance(part, int):
                self.known[p] = self._inside_special(p)
            else:
                c = np.frombuffer(own, np.uint8).astype(np.int64) if isinstance(own, bytes) else own.copy()
                c += self.before[p]
                if part in LONG_CONTRACTIONS:
                    c[1] = self.before[p] + 2
                spaces = SPACES.match(part)
                if spaces:
                    q = p
                    while q and not isinstance(self.parts[q - 1], int) and SPACES.fullmatch(self.parts[q - 1]):
                        q -= 1
                    run = self.bpe.char_counts(self.text[self.starts[q] : self.starts[p] + spaces.end()])
                    c[: spaces.end()] = self.before[q] + run[self.starts[p] - self.starts[q] :]
                    if spaces.end() == len(part) == 1 and q == p:
                        c[0] = self.before[p + 1]
                self.known[p] = c
        return self.known[p]

    def _inside_special(self, p: int) -> np.ndarray:
        """A cut inside a special token's string leaves letters, which may go on from marks or white space before it."""
        name, q = self.bpe.names[self.parts[p]], p
        if p and not isinstance(self.parts[p - 1], int) and not ALNUM.match(self.parts[p - 1][-1]):
            q = p - 1
        joined = ("" if q == p else self.parts[q]) + name
        plain = TokenPrefixes(self.bpe, joined, self.bpe.pieces_of(joined))
        c = self.before[q] + np.concatenate([plain._within(k) for k in range(len(plain.parts))])[-len(name) :]
        c[-1] = self.before[p + 1]
        return c

    def count(self, i: int) -> int:
        if i <= 0 or not self.parts:
            return 0
        if i >= len(self.text):
            return self.total
        p = int(np.searchsorted(self.starts, i, "left")) - 1
        return int(self._within(p)[i - self.starts[p] - 1])

    def longest(self, budget: int) -> int:
        """A part beyond the one where the stored sums pass the budget can only fit as white space or inside a special token: two more are looked at."""
        if self.total <= budget:
            return len(self.text)
        p = int(np.searchsorted(self.before, budget, "right")) - 1
        for k in range(min(p + 2, len(self.parts) - 1), p - 1, -1):
            fits = np.flatnonzero(self._within(k) <= budget)
            if len(fits):
                return int(self.starts[k] + fits[-1]) + 1
        return int(self.starts[p])


_loaded: dict[bytes, PrefixBpe] = {}


def loaded(file: bytes) -> PrefixBpe:
    """One PrefixBpe for a worker, with what it remembers from earlier tasks."""
    import hashlib

    key = hashlib.sha1(file).digest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = PrefixBpe(file)
    return _loaded[key]
