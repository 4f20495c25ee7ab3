"""Byte-level BPE as a bounded-lookahead streaming transducer.

A sequence of tokens is the encoding of its bytes exactly if every two neighbours are: if
encoding ``a + b`` gives ``[a, b]``. So each prefix of a piece has one last token: the token
t ending there whose neighbour, the last token of the rest, fits t. The transducer walks the
bytes once and keeps the last token of each position within the longest token's reach. What
all those positions have in common behind them no later byte can change: it is emitted.
How far that lies behind at most follows from the merge list (``lookahead``), so the memory
is constant. Texts are read in chunks and split into pieces by the tokenizer's pattern in
the same way, holding back the two last pieces, which later characters can still change.

The vocabulary is a file of ranks, one base64 token and rank a line, in merge order.
"""

from __future__ import annotations

import base64
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np

CHUNK = 1 << 16  # characters taken in at once
CACHE, ONCE, PAIRS, CACHED_CHARS = 150_000, 50_000, 300_000, 32  # entries of the bounded caches, longest cached piece
SPACE = "\t-\r \x85\xa0  -     　"


@lru_cache(1)
def _classes() -> tuple[str, str]:
    """The letters and the numbers of Unicode as insides of character classes."""
    ranges: dict[str, list[list[int]]] = {"L": [], "N": []}
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind in ranges:
            r = ranges[kind]
            if r and r[-1][1] == c - 1:
                r[-1][1] = c
            else:
                r.append([c, c])
    text = lambda k: "".join(re.escape(chr(a)) + ("-" + re.escape(chr(b)) if b > a else "") for a, b in ranges[k])
    return text("L"), text("N")


@lru_cache(2)
def pattern(ascii_only: bool) -> re.Pattern:
    """The vocabulary's split into pieces: contractions, words, numbers, other marks, blanks."""
    letters, numbers, space = ("A-Za-z", "0-9", r"\t-\r ") if ascii_only else (*_classes(), SPACE)
    return re.compile(
        # the branches for words and for contractions begin differently, so the commoner one may come first
        f" ?[{letters}]+|'(?:[sdmt]|ll|ve|re)| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+"
    )


class Transducer:
    def __init__(self, path: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(t): int(r) for t, r in (x.split() for x in lines if x.strip())}
        self.ids = ranks
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.bytes[r] = t
        self.sizes = np.array([len(t) for t in self.bytes], np.int64)
        self.longest = max(map(len, ranks))
        self.left, self.right = array("i", [-1]) * len(self.bytes), array("i", [-1]) * len(self.bytes)
        self.merged: dict[int, int] = {}  # left << 32 | right -> token
        for t, r in sorted(ranks.items(), key=lambda x: x[1]):
            if len(t) > 1:
                a, b = self._made_of(t, r)
                self.left[r], self.right[r] = a, b
                self.merged[a << 32 | b] = r
        self.endings: dict[bytes, int] = {}  # every end of a token: the token that it is, or -1
        for t in ranks:
            for i in range(1, len(t)):
                self.endings.setdefault(t[i:], -1)
        self.endings.update(ranks)
        self.lookahead = self._sufficient_lookahead()
        self._fits: dict[int, bool] = {}
        self._cache: dict[str, tuple[int, ...]] = {}  # pieces that came twice
        self._once: dict[str, tuple[int, ...]] = {}

    def _made_of(self, token: bytes, rank: int) -> tuple[int, int]:
        """The two tokens whose merge makes this one: what the earlier merges leave of it."""
        parts = [self.ids[token[i : i + 1]] for i in range(len(token))]
        merged = self.merged
        while len(parts) > 2:
            best, at = rank, -1
            for i in range(len(parts) - 1):
                r = merged.get(parts[i] << 32 | parts[i + 1])
                if r is not None and r < best:
                    best, at = r, i
            if at < 0:
                raise ValueError(f"token {rank} cannot be reached by merges")
            parts[at : at + 2] = [best]
        return parts[0], parts[1]

    def _sufficient_lookahead(self) -> int:
        """Bytes behind the last one within which all open encodings agree.

        A merge of (a, b) can only be prevented by an earlier merge (b, c), that one by a
        still earlier (c, d), and so on. The reach of such chains is bounded by the
        longest weighted path over the merge list, taken from the earliest merge on.
        """
        reach: dict[int, int] = {}
        most = 1
        for key in self.merged:  # in merge order
            a, b = key >> 32, key & 0xFFFFFFFF
            far = len(self.bytes[b]) + reach.get(b, 0)
            reach[a] = max(reach.get(a, 0), far)
            most = max(most, len(self.bytes[a]) + far)
        return most + self.longest

    def fits(self, a: int, b: int) -> bool:
        """Whether encoding the bytes of a and b gives a, b: no merge across their border comes early enough.

        Undoes the merges next to the border from the last to the first; a merge of what
        then touches the border prevents a, b if it comes before the merge just undone.
        """
        key = a << 32 | b
        known = self._fits.get(key)
        if known is not None:
            return known
        left, right, merged = self.left, self.right, self.merged
        x, y, x_until, y_until, ok = a, b, 1 << 31, 1 << 31, True
        while ok:
            r = merged.get(x << 32 | y)
            # at equal rank the leftmost merge is made first, so one inside a precedes, one inside b follows
            if r is not None and r < x_until and r <= y_until:
                ok = False
            elif left[x] < 0 and left[y] < 0:
                break
            elif left[y] < 0 or (left[x] >= 0 and x > y):
                x_until, x = x, right[x]
            else:
                y_until, y = y, left[y]
        if len(self._fits) >= PAIRS:
            self._fits.clear()
        self._fits[key] = ok
        return ok

    def whole(self, piece: bytes) -> tuple[int, ...]:
        """The tokens of one piece that comes in one part."""
        return tuple(self.stream((piece,)))

    def stream(self, parts: Iterable[bytes]) -> Iterator[int]:
        """The tokens of one piece that comes in parts, emitted once no later byte can change them.

        The state is the bytes since the last emitted token and the last token of each of their
        positions. After every ``lookahead`` bytes what all open encodings share is emitted, which
        by the lookahead's bound leaves at most so many bytes and one token; the end of the piece
        settles the rest.
        """
        held, last, first, wait = b"", [-1], True, self.lookahead
        for part in parts:
            for at in range(0, len(part), wait):
                if len(held) >= wait:
                    stable = self._common(last)
                    yield from self._back(last, stable)
                    if stable:
                        held, last, first = held[stable:], last[stable:], False
                held += part[at : at + wait]
                self._walk(held, last, first)
        yield from self._back(last, len(held))

    def _walk(self, held: bytes, last: list[int], first: bool) -> None:
        """The last token of each further position: the one whose left neighbour, the last token where it begins, fits."""
        ending, known, fits = self.endings.get, self._fits.get, self.fits
        for p in range(len(last), len(held) + 1):
            s, found = p - 1, -1
            while s >= 0:
                t = ending(held[s:p])
                if t is None:  # no token ends so
                    break
                if t >= 0:
                    if first and not s:
                        found = t
                        break
                    a = last[s]
                    ok = known(a << 32 | t)
                    if fits(a, t) if ok is None else ok:
                        found = t
                        break
                s -= 1
            last.append(found)

    def _common(self, last: list[int]) -> int:
        """The last position through which every open encoding passes: those that end where a later token can begin."""
        end = len(last) - 1
        low = max(0, end - self.longest + 1)
        passed, n, size = bytearray(low) + b"\1" * (end + 1 - low), end + 1 - low, self.bytes
        for p in range(end, 0, -1):
            if passed[p]:
                if n == 1:
                    return p
                before = p - len(size[last[p]])
                if passed[before]:
                    n -= 1
                passed[before] = 1
        return 0

    def _back(self, last: list[int], end: int) -> list[int]:
        out = []
        while end > 0:
            out.append(last[end])
            end -= len(self.bytes[last[end]])
        return out[::-1]

    def _miss(self, piece: str) -> tuple[int, ...]:
        found = self._once.pop(piece, None)
        if found is not None:
            if len(self._cache) >= CACHE:
                self._cache.clear()
            self._cache[piece] = found
            return found
        data = piece.encode()
        one = self.ids.get(data)  # a token is its own encoding
        found = self.whole(data) if one is None else (one,)
        if len(piece) <= CACHED_CHARS:
            if len(self._once) >= ONCE:
                self._once.clear()
            self._once[piece] = found
        return found

    def encode(self, text: str) -> list[int]:
        """All tokens of a text."""
        return list(self.encode_chunks(text[i : i + CHUNK] for i in range(0, len(text), CHUNK)))

    def _pieces(self, pieces: list[str]) -> list[int]:
        get, miss = self._cache.get, self._miss
        return [t for p in pieces for t in (get(p) or miss(p))]

    def encode_chunks(self, chunks: Iterable[str]) -> Iterator[int]:
        """The tokens of a text that comes in chunks; holds one chunk and two pieces, or a part of one long piece."""
        source, held = iter(chunks), []
        for chunk in source:
            text = "".join(held) + chunk
            pieces = pattern(text.isascii()).findall(text)
            if len(pieces) <= 2 and len(text) > 2 * CHUNK:
                rest: list[str] = []
                yield from self.stream(self._long_piece(text, source, rest))
                pieces = pattern(False).findall(rest[0])
            held = pieces[-2:]
            yield from self._pieces(pieces[:-2])
        yield from self._pieces(held)

    def _long_piece(self, text: str, source: Iterator[str], rest: list[str]) -> Iterator[bytes]:
        """The bytes of the first piece of a text, as far as it goes on through the chunks; then rest holds what follows."""
        pieces = pattern(False).findall(text)
        if len(pieces) > 1:  # a short piece before the long one
            yield pieces[0].encode()
            rest.append(text[len(pieces[0]) :])
            return
        letters, numbers = _classes()
        kinds = [f"[{letters}]", f"[{numbers}]", f"[^{SPACE}{letters}{numbers}]", f"[{SPACE}]"]
        kind = next(k for k in kinds if re.match(k, text[-1]))
        blank = kind == kinds[3]
        more = re.compile(f"{kind}*")
        while True:
            # the last blank may belong to the next piece
            yield text[:-1].encode() if blank else text.encode()
            text = text[-1:] if blank else ""
            chunk = next(source, None)
            if chunk is None:
                if blank:
                    yield text.encode()
                    text = ""
                break
            go = more.match(chunk).end()
            text += chunk[:go]
            if go < len(chunk):
                if not blank:
                    yield text.encode()
                    text = ""
                else:
                    yield text[:-1].encode()
                    text = text[-1:]
                text += chunk[go:]
                break
        rest.append(text)


class TokenDecoder:
    """Tokens to text, token by token: a state machine over bytes that holds back an unfinished character."""

    def __init__(self, transducer: Transducer):
        self.bytes, self.held = transducer.bytes, b""

    def feed(self, ids: Iterable[int]) -> str:
        data = self.held + b"".join([self.bytes[i] for i in ids])
        keep = 0
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte >= 0xC0:  # a lead byte: how many bytes does its character have
                keep = back if back < (2 if byte < 0xE0 else 3 if byte < 0xF0 else 4) else 0
                break
            if byte < 0x80:
                break
        self.held = data[len(data) - keep :] if keep else b""
        return data[: len(data) - keep].decode("utf-8", "replace")

    def finish(self) -> str:
        out, self.held = self.held.decode("utf-8", "replace"), b""
        return out


@lru_cache(4)
def transducer(path: str) -> Transducer:
    """One per Python worker and vocabulary."""
    return Transducer(path)
