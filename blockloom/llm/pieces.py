"""Long texts in pieces of bounded tokens, cut at the strongest boundary that a length window permits.

Every place between two tokens has a strength: between cells 3, between lines 2, at a blank
1, elsewhere 0; inside a character none. From the start of a piece the window of permitted
ends reaches from just over the overlap to the limit, so a cell border is used whenever one
is in reach. A sparse table of range maxima finds the strongest place, at a tie the last
one. The next piece begins ``overlap`` tokens before that place (up to three more where that
would be inside a character). A piece is a range of the document's own tokens. Its text taken
alone has the same tokens, as every part of an encoding is the encoding of its own bytes and
the split into pieces looks only forward, but for two edges: blanks at the end are no longer
split off for the next word, and an apostrophe at the start may begin a contraction. Those
are counted, and a piece that would be over the limit alone is cut shorter.

Defined results: null and empty texts have no pieces; a text within the limit is one piece;
cell starts that are null, out of range, repeated or out of order are taken as a set; each
row gives its own pieces, repeated ids too; the table is built over bounded segments, so
very long texts need no more memory than their tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.encoding import slices
from blockloom.llm.transducer import Transducer, transducer

LIMIT, OVERLAP, SEGMENT = 1024, 64, 1 << 15
KINDS = {3: "cell", 2: "line", 1: "blank", 0: "token", 9: "end"}
BLANK = np.array([chr(c).isspace() and not 0x1C <= c <= 0x1F for c in range(0x3002)], np.int8)  # the last blank is U+3000
SCHEMA = "piece int, token_start int, token_end int, char_start int, char_end int, n_tokens int, cut string, text string"


class StrongestPlace:
    """Range maxima of strengths over places first..first+len-1, the last place at a tie."""

    def __init__(self, strength: np.ndarray, first: int):
        self.first, self.size = first, len(strength)
        keys = strength.astype(np.int64) * (1 << 32) + np.arange(len(strength))
        self.table = [keys]
        while (1 << len(self.table)) <= len(keys):
            half = 1 << (len(self.table) - 1)
            row = self.table[-1]
            self.table.append(np.maximum(row[: len(row) - half], row[half:]))

    def __call__(self, low: int, high: int) -> int:
        """The strongest place of low..high."""
        a, b = low - self.first, high - self.first + 1
        k = (b - a).bit_length() - 1
        row = self.table[k]
        return int(max(row[a], row[b - (1 << k)]) & 0xFFFFFFFF) + self.first


def strengths(text: str, sizes: np.ndarray, starts) -> tuple[np.ndarray, np.ndarray]:
    """(strength, character offset) of each place 0..n before, between and after the tokens."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    if text.isascii():
        whole, at = np.ones(len(ends), bool), ends
    else:
        lead = np.frombuffer(text.encode(), np.uint8) & 0xC0 != 0x80
        before = np.concatenate([[0], np.cumsum(lead)])
        whole, at = np.append(lead, True)[ends], before[ends]
    if text.isascii():
        points = np.frombuffer(text.encode(), np.uint8)
    else:
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    blank = BLANK[points if text.isascii() else np.minimum(points, len(BLANK) - 1)]
    line = (points == 10) | (points == 0x85) | (points == 0x2028) | (points == 0x2029)
    cr = np.flatnonzero(points == 13)
    line[cr[np.append(points, 0)[cr + 1] != 10]] = True
    kind = np.zeros(len(points) + 1, np.int8)
    kind[:-1] = blank
    kind[1:] |= blank
    kind[1:][line] = 2
    if starts is not None:
        cells = np.array([s for s in starts if s is not None and 0 < s < len(points)], np.int64)
        kind[cells] = 3
    strength = kind[at]
    strength[~whole] = -1
    return strength, at


def alone(t: Transducer, text: str, at: np.ndarray, start: int, end: int) -> int:
    """How many tokens the text of the places start..end has when it is encoded alone."""
    a, b = int(at[start]), int(at[end])
    if text[a] == "'" and start:
        return len(t.encode(text[a:b]))
    if not text[b - 1].isspace():
        return end - start
    run = b - 1
    while run > a and text[run - 1].isspace():
        run -= 1
    if b - run < 2:
        return end - start
    return int(np.searchsorted(at, run, "right")) - 1 - start + len(t.encode(text[run:b]))


def cut(t: Transducer, text: str, starts, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple]:
    """Rows of SCHEMA of one text."""
    ids = t.encode(text)
    n = len(ids)
    if n <= limit:
        return [(0, 0, n, 0, len(text), n, "end", text)] if n else []
    strength, at = strengths(text, t.sizes[np.array(ids)], starts)
    out, start, index = [], 0, None
    while True:
        most = limit
        while True:
            if n - start <= most:
                end, kind = n, 9
            else:
                low, high = start + overlap + 4, start + most
                if index is None or high >= index.first + index.size:
                    index = StrongestPlace(strength[start : start + SEGMENT], start)
                end = index(low, high)
                kind = int(strength[end])
            over = alone(t, text, at, start, end) - limit
            if over > 0 and most > overlap + 8:
                most = max(overlap + 8, min(most, end - start) - over)
                continue
            break
        out.append((len(out), start, end, int(at[start]), int(at[end]), end - start, KINDS[kind], text[at[start] : at[end]]))
        if end == n:
            return out
        start = end - overlap
        while strength[start] < 0:
            start -= 1


def split(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", starts: str = "cell_starts", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(key, piece, token_start, token_end, char_start, char_end, n_tokens, cut, text): the pieces of every text."""
    if overlap < 0 or limit < 2 * overlap + 16:
        raise ValueError("the limit must be at least twice the overlap and 16 more")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(vocabulary)
        for batch in batches:
            for part in slices(batch, "text"):
                rows, of = [], []
                for k, (x, s) in enumerate(zip(part.column("text").to_pylist(), part.column("starts").to_pylist())):
                    got = cut(t, x, s, limit, overlap) if x else []
                    rows += got
                    of += [k] * len(got)
                columns = list(zip(*rows)) if rows else [()] * 8
                kinds = [pa.int32()] * 6 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays(
                    [part.column("key").take(pa.array(of, pa.int32()))] + [pa.array(c, k) for c, k in zip(columns, kinds)],
                    ["key", "piece", "token_start", "token_end", "char_start", "char_end", "n_tokens", "cut", "text"],
                )

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(starts).alias("starts"))
    return rows.mapInArrow(run, f"key {kind}, {SCHEMA}").withColumnRenamed("key", key)
