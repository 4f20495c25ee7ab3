"""Evaluation passages inside corpus documents, through CGK embeddings and bit-sampling LSH.

Items become sequences of word codes, cut where a sentence occurs that several items have.
Every window of ``WINDOW`` words of an item is embedded R times by the CGK random walk, which
maps edit distance to Hamming distance; each repetition samples K coordinates of one
embedding as its LSH key. Documents are read once: markup and escapes are taken out, words
become codes, and every window position of the whole text is a candidate unless it holds
too few word pairs of the items for WINDOW words within EDITS edits (the q-gram lemma: each
edit destroys at most two pairs). Candidates are embedded and looked up the same way, and
every hit is verified by an exact banded alignment: a run of at least WINDOW words of the
item in which every replaced, lost or added word has at least APART kept words before the
next one; the first may follow any kept word. (Sentences of one pattern with other names agree in most words, but not so.)

The work is narrow: no shuffle, no state but the items' windows. ITEMS items are held at
once; more are taken in blocks, each against all documents.

Defined results: null, empty and blank texts carry nothing; items with null ids or texts are
no items; repeated items count as one id each, equal sentences of different ids as shared;
each (document, item) once, also for repeated rows; empty tables give an empty result.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.encoding import slices

WINDOW = 20  # consecutive words that make a passage
APART = 5  # kept words between two edits of a passage: with fewer, replaced words are not isolated
EDITS = -(-WINDOW // (APART + 1))  # the most edits that a window of a passage can have
REPEATS, BITS = 40, 6  # LSH repetitions, sampled coordinates: recall per window 1 - (1 - s**BITS)**REPEATS
STEPS = 2 * WINDOW  # coordinates of the embedding
BAND, BEFORE, AFTER = 5, WINDOW, 2 * WINDOW  # verified alignment around a hit
ITEMS = 5000  # items held at once
TABLE = 1 << 22  # slots of the word pair table

WORD = re.compile(r"[^\W_]+")
SENTENCE = re.compile(r"(?<=[.!?])\s+|[\r\n]+")
UNICODE = re.compile(r"\\+[uU]\{?([0-9a-fA-F]{4})\}?|\\+x([0-9a-fA-F]{2})")
BREAK, ESCAPE = re.compile(r"\\+[nr]"), re.compile(r"\\+[tbfv]")
GUTTER = re.compile(r"""^([ \t"',#>*/]*)\d{1,6} ?[|│]""", re.M)  # line numbers before a bar
ANSI = re.compile(r"\x1b\[[0-9;?]*[ -/]*[@-~]|\x1b[@-_]")
# a tag, or a longer one of nothing but attributes: in code, "a <b" may be far from the next ">"
TAG = re.compile(
    r"""</?[A-Za-z](?:[^<>]{0,400}>|[\w:-]*+(?:\s++[\w:@-]++(?:\s*+=\s*+(?:\\*+"[^"<>]*+"|\\*+'[^'<>]*+'|[^\s"'<>]++))?)*+\s*+/?>)"""
)
ENTITY = re.compile(r"&#?\w{2,8};")
HIDDEN = re.compile("[\xad͏؜ᅟᅠ឴឵᠎​-‏‪-‮⁠-⁯︀-️﻿￹-￻]")


def outside_comments(text: str) -> list[str]:
    """The parts of the text before, between and after comments; one that doesn't end is text."""
    parts, at = [], 0
    while (begin := text.find("<!--", at)) >= 0 and (end := text.find("-->", begin + 4)) >= 0:
        parts.append(text[at:begin])
        at = end + 3
    return [*parts, text[at:]]


def plain(text: str) -> str:
    """The text without escapes, terminal codes, tags, entities, numbers of lines and invisible characters."""
    if "\\" in text:
        text = UNICODE.sub(lambda m: chr(int(m[1] or m[2], 16)), text)
        text = ESCAPE.sub(" ", BREAK.sub("\n", text))
    if "\x1b" in text:
        text = ANSI.sub("", text)
    if "<" in text:
        text = " ".join(TAG.sub(" ", t) for t in outside_comments(text))
    if "&" in text:
        text = ENTITY.sub(lambda m: html.unescape(m[0]), text)
    if "|" in text or "│" in text:
        text = GUTTER.sub(r"\1 ", text)
    return text if text.isascii() else HIDDEN.sub("", text)


def words(text: str) -> list[str]:
    return WORD.findall(plain(text).lower())


@dataclass
class Windows:
    """What is known of a block of items: codes of their words, LSH tables of their windows."""

    codes: dict[str, int]
    sequence: np.ndarray  # word codes of all items, -1 between them and at shared sentences
    item: np.ndarray  # item number of each word
    ids: list[int]
    pairs: np.ndarray  # hashed word pairs that items have
    walk: np.ndarray  # (REPEATS, STEPS, codes + 2): 0 or 1, the steps of the random walks
    sampled: np.ndarray  # (REPEATS, BITS): the coordinates of each key
    keys: list[np.ndarray]  # per repetition, sorted keys
    starts: list[np.ndarray]  # and their window starts


def pair_slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(np.int64) * 1000003 + b.astype(np.int64) * 8191) & (TABLE - 1)


def embedded_keys(sequence: np.ndarray, at: np.ndarray, walk: np.ndarray, sampled: np.ndarray) -> np.ndarray:
    """The LSH key of one repetition of the windows that begin at ``at``."""
    place = np.zeros(len(at), np.int64)
    key = np.zeros(len(at), np.uint64)
    wanted = set(sampled.tolist())
    for step in range(max(wanted) + 1):
        inside = place < WINDOW
        symbol = np.where(inside, sequence[np.minimum(at + place, len(sequence) - 1)], -2)
        if step in wanted:
            key = (key ^ (symbol + 3).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        place += np.where(inside, walk[step][symbol + 2], 1)
    return key


def windows_of(items: list[tuple[int, list[list[str]]]], seed: int = 7) -> Windows:
    """items: (item id, its runs of words between shared sentences)."""
    codes: dict[str, int] = {}
    sequence, number, ids = [-1] * WINDOW, [-1] * WINDOW, []
    for k, (item, runs) in enumerate(items):
        ids.append(item)
        for run in runs:
            for w in run:
                sequence.append(codes.setdefault(w, len(codes) + 1))
            sequence += [-1] * BAND * 2
            number += [k] * (len(run) + BAND * 2)
    seq, num = np.array(sequence + [-1] * 2 * AFTER, np.int32), np.array(number + [-1] * 2 * AFTER, np.int32)
    pairs = np.zeros(TABLE, bool)
    both = (seq[:-1] > 0) & (seq[1:] > 0)
    pairs[pair_slot(seq[:-1][both], seq[1:][both])] = True
    rng = np.random.default_rng(seed)
    walk = rng.integers(0, 2, (REPEATS, STEPS, len(codes) + 3), dtype=np.int8)
    sampled = np.sort(np.array([rng.choice(STEPS, BITS, replace=False) for _ in range(REPEATS)]), axis=1)
    live = np.concatenate([[0], np.cumsum(seq > 0)])
    at = np.flatnonzero(live[WINDOW:] - live[:-WINDOW] == WINDOW)
    keys, starts = [], []
    for r in range(REPEATS):
        key = embedded_keys(seq, at, walk[r], sampled[r])
        order = np.argsort(key, kind="stable")
        keys.append(key[order])
        starts.append(at[order])
    return Windows(codes, seq, num, ids, pairs, walk, sampled, keys, starts)


def longest_runs(text: np.ndarray, p: np.ndarray, item: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The longest passage around the places p of the text and q of the items, aligned within BAND."""
    shift = np.arange(-BAND, BAND + 1)
    none = np.zeros((len(p), 2 * BAND + 1), np.int16)
    # the longest run by kept words since its last edit (1, 2, .. APART and more); a run without an edit may have one at once
    kept = [none] * APART
    # the last of them, to which an edit may follow, of the last two words
    one, two, best = none, none, np.zeros(len(p), np.int16)

    def moved(x: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros_like(x)
        if by > 0:
            out[:, :-by] = x[:, by:]
        else:
            out[:, -by:] = x[:, :by]
        return out

    for i in range(-BEFORE, AFTER):
        a = text[np.clip(p + i, 0, len(text) - 1)]
        b = item[np.clip(q[:, None] + i + shift, 0, len(item) - 1)]
        same = (a[:, None] == b) & (b > 0)
        edited = none
        # a replaced word (in code one for up to three, as in a_b(c)), a word the item doesn't have, a word the text doesn't have
        for n, by, more in ((two, 0, 2), (two, -1, 3), (two, -2, 4), (two, 1, 1), (one, -1, 2)):
            n = moved(n, by) if by else n
            edited = np.maximum(edited, np.where(n > 0, n + more, 0))
        longer = [np.where(n > 0, n + 1, 0) for n in kept[:-1]]
        kept = [np.where(same, n, 0).astype(np.int16) for n in (edited, *longer[:-1], np.maximum(longer[-1], kept[-1] + 1))]
        best = np.maximum(best, np.max(kept, axis=0).max(axis=1))
        two, one = one, kept[-1]
    return best


def pairs_kept(text: np.ndarray, p: np.ndarray, item: np.ndarray, q: np.ndarray) -> np.ndarray:
    """How many of a window's neighbouring words are neighbours in the item within BAND of the same place."""
    shift = np.arange(-BAND, BAND + 1)
    total, last = np.zeros(len(p), np.int16), None
    for i in range(WINDOW):
        a = text[np.minimum(p + i, len(text) - 1)]
        same = (a[:, None] == item[np.clip(q[:, None] + i + shift, 0, len(item) - 1)]) & (a > 0)[:, None]
        if last is not None:
            total += (same & last).any(axis=1)
        last = same
    return total


def leaks(w: Windows, codes: np.ndarray, doc: np.ndarray) -> set[tuple[int, int]]:
    """(document number, item number) of passages in word codes of several documents, with WINDOW zeros between."""
    if len(codes) <= WINDOW:
        return set()
    known = codes > 0
    hit = np.zeros(len(codes), np.int32)
    both = np.flatnonzero(known[:-1] & known[1:])
    hit[both] = w.pairs[pair_slot(codes[both], codes[both + 1])]
    total = np.concatenate([[0], np.cumsum(hit)])
    # WINDOW words have WINDOW - 1 pairs; EDITS edits leave WINDOW - 1 - 2 * EDITS of them
    at = np.flatnonzero(total[WINDOW - 1 : -1] - total[: -WINDOW] >= WINDOW - 1 - 2 * EDITS)
    if not len(at):
        return set()
    found = []
    for r in range(REPEATS):
        key = embedded_keys(codes, at, w.walk[r], w.sampled[r])
        low, high = np.searchsorted(w.keys[r], key, "left"), np.searchsorted(w.keys[r], key, "right")
        n = high - low
        some = np.flatnonzero(n)
        if len(some):
            n, low = n[some], low[some]
            q = w.starts[r][np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]
            p = np.repeat(at[some], n)
            found.append(p << 32 | q)
    if not found:
        return set()
    hits = np.unique(np.concatenate(found))
    p, q = hits >> 32, hits & 0xFFFFFFFF
    kept = np.concatenate([pairs_kept(codes, p[k : k + 20000], w.sequence, q[k : k + 20000]) for k in range(0, len(p), 20000)])
    good = kept >= WINDOW - 1 - 2 * EDITS
    p, q = p[good], q[good]
    # one alignment per diagonal and stretch of text (and so per document and item) stands for all hits on it
    stretch = (p // (WINDOW // 2)) << 32 | (q - p + len(codes))
    _, first = np.unique(stretch, return_index=True)
    every_p, every_q = p[first], q[first]
    out: set[tuple[int, int]] = set()
    for k in range(0, len(every_p), 20000):
        p, q = every_p[k : k + 20000], every_q[k : k + 20000]
        d, i = doc[p + WINDOW - 1], w.item[q]  # the gap behind a document counts as its own, a window may begin in the gap before
        ok = longest_runs(codes, p, w.sequence, q) >= WINDOW
        out.update(zip(d[ok].tolist(), i[ok].tolist()))
    return out


def searched(w: Windows, texts: list[str | None]) -> set[tuple[int, int]]:
    get, parts, of = w.codes.get, [], []
    gap = np.zeros(AFTER, np.int32)
    for k, text in enumerate(texts):
        if text:
            found = words(text)
            if len(found) >= WINDOW:
                parts += [np.array([get(x, 0) for x in found], np.int32), gap]
                of.append(np.full(len(found) + AFTER, k, np.int32))
    return leaks(w, np.concatenate([gap, *parts]), np.concatenate([np.full(AFTER, -1, np.int32), *of])) if parts else set()


def item_runs(items: DataFrame, key: str = "item_id", text: str = "text") -> pd.DataFrame:
    """Each item's sentences in order, as word lists, with whether another item has the sentence too."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, n, " ".join(words(s))) for k, t in zip(pdf["key"], pdf["text"]) for n, s in enumerate(SENTENCE.split(t))]
            yield pd.DataFrame([r for r in rows if r[2]], columns=["key", "n", "sentence"])

    kind = items.schema[key].dataType.simpleString()
    known = items.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("key is not null and text is not null").distinct()
    sentences = known.mapInPandas(run, f"key {kind}, n int, sentence string")
    shared = sentences.groupBy("sentence").agg((F.countDistinct("key") > 1).alias("shared"))
    return sentences.join(shared, "sentence")


def find_leaks(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """(key, item): the items of which a document carries a passage, each pair once."""
    sentences = item_runs(items, item)
    numbers = sentences.select("key").distinct().orderBy("key")
    ids = [r[0] for r in numbers.collect()]  # ids only; the texts come in blocks of ITEMS
    kinds = documents.schema[key].dataType.simpleString(), items.schema[item].dataType.simpleString()
    rows, out = documents.select(F.col(key).alias("key"), F.col(text).alias("text")), None
    for at in range(0, max(len(ids), 1), ITEMS):
        block = ids[at : at + ITEMS]
        part = sentences.filter(F.col("key").between(block[0], block[-1])).orderBy("key", "n").collect() if block else []
        runs: dict = {}
        for r in part:
            own = runs.setdefault(r["key"], [[]])
            if r["shared"]:
                own.append([])
            else:
                own[-1] += r["sentence"].split(" ")
        held = documents.sparkSession.sparkContext.broadcast(windows_of([(k, [x for x in v if len(x) >= WINDOW]) for k, v in runs.items()]))
        found = rows.mapInArrow(_search(held), f"key {kinds[0]}, item {kinds[1]}")
        out = found if out is None else out.unionByName(found)
    return out.select(F.col("key").alias(key), F.col("item").alias(item)).distinct()


def _search(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = held.value
        for batch in batches:
            for part in slices(batch, "text"):
                got = sorted(searched(w, part.column("text").to_pylist()))
                keys = part.column("key").take(pa.array([d for d, _ in got], pa.int32()))
                yield pa.RecordBatch.from_arrays([keys, pa.array([w.ids[i] for _, i in got], pa.int64())], ["key", "item"])

    return run
