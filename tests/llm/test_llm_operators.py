"""The llm problems against brute force, libraries and round trips."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockloom.llm import canonical, components, encoding, leakage, percentiles, pieces, queries
from blockloom.llm import transducer as TR

try:
    VOCABULARY = queries.vocabulary()
except ImportError:
    VOCABULARY = None
needs_vocabulary = pytest.mark.skipif(VOCABULARY is None, reason="no tokenizer files")
ALPHABETS = ["ab", "aeinrst ", "0123456789", "=-_. \n", "aA1 \n\t", "the ", "'relvsdm x", "абв ²Ⅷx9", "\U0001f600​́a 　\x85\x1c", "<|endoftext|> "]


@pytest.fixture(scope="module")
def library():
    import base64

    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts(n, most, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(rng.choice(ALPHABETS[: 1 + i % len(ALPHABETS)])) for _ in range(rng.randrange(most))) for i in range(n)]


@needs_vocabulary
def test_transducer_is_the_library(library):
    t = TR.transducer(VOCABULARY)
    for s in texts(3000, 80, 1):
        assert t.encode(s) == library.encode_ordinary(s), repr(s)
        assert list(t.encode_chunks(s[i : i + 5] for i in range(0, len(s), 5))) == library.encode_ordinary(s), repr(s)
        if s:
            b = s.encode()
            assert list(t.stream(b[i : i + 7] for i in range(0, len(b), 7))) == list(t.whole(b)), repr(s)
    assert t.lookahead < 1000
    assert all(t.whole(b) == (i,) for b, i in list(t.ids.items())[::17])


@needs_vocabulary
def test_every_piece_is_streamed(folder, library, monkeypatch):
    import pyarrow.parquet as pq

    t, ran = TR.Transducer(VOCABULARY), [0]
    stream = t.stream
    monkeypatch.setattr(t, "stream", lambda parts: ran.__setitem__(0, ran[0] + 1) or stream(parts))
    texts = [x for x in pq.read_table(f"{folder}/documents.parquet", columns=["text"])["text"].to_pylist() if x]
    pieces = {p for x in texts for p in TR.pattern(False).findall(x)}
    assert [t.encode(x) for x in texts] == library.encode_ordinary_batch(texts)
    assert ran[0] >= len([p for p in pieces if p.encode() not in t.ids]) > 1000


@needs_vocabulary
def test_state_is_bounded(library):
    t, most = TR.Transducer(VOCABULARY), [0]
    walk = t._walk

    def seen(held, last, first):
        most[0] = max(most[0], len(held))
        walk(held, last, first)

    t._walk = seen
    for s in ("a" * 9000, "abcab" * 3000, "=" * 7001, "-=" * 5000, "\n" * 5001, "aeinrst" * 2000):
        assert list(t.stream([s.encode()])) == library.encode_ordinary(s)
    assert most[0] <= 2 * t.lookahead + t.longest


@needs_vocabulary
def test_long_pieces(library, monkeypatch):
    t = TR.transducer(VOCABULARY)
    monkeypatch.setattr(TR, "CHUNK", 60)
    rng = random.Random(5)
    for _ in range(300):
        a = rng.choice(["ab", "aeinrst", "0123456789", "=-", "  \n", "aA1", "é"])
        s = rng.choice(["", "x ", " ", "1"]) + "".join(rng.choice(a) for _ in range(rng.randrange(900))) + rng.choice(["", " x", "x", "'re", " ", "\n1"])
        assert t.encode(s) == library.encode_ordinary(s), repr(s)


@needs_vocabulary
def test_decoder_token_by_token():
    t = TR.transducer(VOCABULARY)
    for s in texts(300, 60, 2):
        machine = TR.TokenDecoder(t)
        assert "".join(machine.feed([i]) for i in t.encode(s)) + machine.finish() == s


@needs_vocabulary
def test_encode_frame(spark):
    df = spark.createDataFrame([(1, "a b", 9), (2, "", 9), (3, None, 9), (1, "a b", 9), (4, "<|endoftext|>", 9)], "doc_id long, text string, ids int")
    got = sorted((r.doc_id, list(r.ids)) for r in encoding.encode(df, VOCABULARY).collect())
    assert got[0] == got[1] and got[2][1] == got[3][1] == [] and 50256 not in got[4][1] and len(got) == 5
    back = {r.doc_id: r.text for r in encoding.decode(encoding.encode(df, VOCABULARY), VOCABULARY).collect()}
    assert back == {1: "a b", 2: "", 3: "", 4: "<|endoftext|>"}
    assert encoding.encode(df.limit(0), VOCABULARY).count() == 0


@needs_vocabulary
def test_pieces_cover_and_fit():
    t = TR.transducer(VOCABULARY)
    rng = random.Random(3)
    for k in range(40):
        lines = ["".join(rng.choice("abc déf, é\U0001f600") for _ in range(rng.randrange(1, 200))) for _ in range(rng.randrange(1, 90))]
        text = rng.choice(["\n", "\n\n", "\r\n", " "]).join(lines)
        starts = sorted(rng.sample(range(len(text)), min(5, len(text)))) + [None, -3, 10**9, 0]
        rows = pieces.cut(t, text, starts, 120, 16)
        n = len(t.encode(text))
        assert rows[0][1] == 0 and rows[-1][2] == n and rows[-1][4] == len(text)
        for r in rows:
            assert r[2] - r[1] <= 120 and len(t.encode(r[7])) <= 120 and r[7] == text[r[3] : r[4]]
        for a, b in zip(rows, rows[1:]):
            assert 16 <= a[2] - b[1] <= 19 and b[2] > a[2]


@needs_vocabulary
def test_pieces_cut_at_cells_first():
    t = TR.transducer(VOCABULARY)
    text = "word " * 60 + "\n" + "word " * 30 + "\n" + "word " * 100
    rows = pieces.cut(t, text, [301], 100, 8)
    assert rows[0][4] == 301 and rows[0][6] == "cell" and rows[1][6] == "line"


@needs_vocabulary
def test_blanks_of_all_scripts_are_boundaries():
    t = TR.transducer(VOCABULARY)
    for blank, kind in (("\u3000", "blank"), ("\u2003", "blank"), ("\u2028", "line"), ("\u0085", "line"), ("\u2029", "line")):
        text = "語" * 40 + blank + "語" * 90
        rows = pieces.cut(t, text, None, 100, 8)
        assert rows[0][6] == kind and rows[0][4] in (40, 41), (repr(blank), rows[0][:7])


def brute_strongest(s, low, high):
    return max(range(low, high + 1), key=lambda i: (s[i], i))


def test_range_maxima():
    rng = np.random.default_rng(1)
    s = rng.integers(-1, 4, 300)
    index = pieces.StrongestPlace(s[20:], 20)
    for _ in range(300):
        a, b = sorted(rng.integers(20, 300, 2))
        assert index(int(a), int(b)) == brute_strongest(s, a, b)


def test_pieces_of_odd_rows(spark):
    if VOCABULARY is None:
        pytest.skip("no tokenizer files")
    df = spark.createDataFrame([(1, None, None, 1), (2, "", [0], 1), (3, "x", None, 1), (3, "x", None, 1)], "doc_id long, text string, cell_starts array<int>, piece int")
    got = pieces.split(df, VOCABULARY).collect()
    assert [(r.doc_id, r.piece, r.n_tokens, r.cut, r.text) for r in got] == [(3, 0, 1, "end", "x")] * 2


# ---- leaks

NAMES = [f"{a}{b}{c}" for a in ("mun", "dra", "kel", "sor") for b in ("ba", "ti", "ro", "ve", "lu") for c in ("ck", "ster", "ming", "dol")]


def item_text(rng, n=80):
    words = [rng.choice(NAMES) for _ in range(n)]
    return ". ".join(" ".join(words[i : i + 13]) for i in range(0, n, 13)) + "."


def test_planted_passages(spark):
    rng = random.Random(8)
    common = "Explain every step of the answer and state clearly which assumptions were made about these data and why they hold."
    items = [(i, f"{common} {item_text(rng)}") for i in range(30)]
    wanted, docs = set(), []
    for d in range(240):
        i, text = rng.choice(items)
        own = text[len(common) :].split()
        n = rng.choice([8, 12, 22, 30, 45])
        at = rng.randrange(len(own) - n + 1)
        cut = own[at : at + n]
        if n > 20:
            wanted.add((d, i))
        for k in range(7, len(cut) - 6, rng.choice([7, 9])):
            cut[k] = "replaced"
        shape = d % 5
        body = " ".join(cut)
        if shape == 1:
            body = "\\n\", \"".join(cut)
        elif shape == 2:
            body = "<td>" + "</td><td class=\"x\">".join(cut) + "</td>"
        elif shape == 3:
            body = "\n# ".join(" ".join(cut[k : k + 4]) for k in range(0, len(cut), 4)).upper()
        elif shape == 4:
            body = " \x1b[31m&amp; **".join(cut).replace("e", "e​")
        noise = " ".join(rng.choice(NAMES) for _ in range(60))
        docs.append((d, f"{noise} {common} -- {body} -- {noise}"))
    docs += [(900, None), (901, ""), (902, "   "), (0, docs[0][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item", F.lit("clash"))
    table = spark.createDataFrame([*items, (77, None), (None, "x")], "item_id long, text string").withColumn("key", F.lit("clash"))
    got = set(map(tuple, leakage.find_leaks(frame, table).collect()))
    assert got == wanted
    assert leakage.find_leaks(frame, table.limit(0)).count() == 0 and leakage.find_leaks(frame.limit(0), table).count() == 0


def test_items_in_blocks(spark, monkeypatch):
    rng = random.Random(9)
    items = [(i, item_text(rng)) for i in range(7)]
    docs = spark.createDataFrame([(i, "a b c " + t[:400]) for i, t in items], "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, leakage.find_leaks(docs, table).collect()))
    monkeypatch.setattr(leakage, "ITEMS", 3)
    assert sorted(map(tuple, leakage.find_leaks(docs, table).collect())) == whole == [(i, i) for i in range(7)]


def test_alignment_rules():
    codes = np.arange(1, 61, dtype=np.int32)
    item = np.concatenate([np.full(60, -1), codes, np.full(60, -1)]).astype(np.int32)

    def run(text):
        padded = np.concatenate([np.zeros(60), text, np.zeros(60)]).astype(np.int32)
        return int(leakage.longest_runs(padded, np.array([60]), item, np.array([60]))[0])

    assert run(codes[:30]) == 30
    assert run([*codes[:10], 0, *codes[11:30]]) == 30  # replaced
    assert run([*codes[:10], *codes[11:30]]) == 30  # left out
    assert run([*codes[:10], 0, *codes[10:30]]) == 30  # added
    assert run([*codes[:10], 0, 0, *codes[12:20]]) == 10  # two in a row break it
    assert run([*codes[:10], 0, *codes[11:14], 0, *codes[15:20]]) == 14  # too close together


# ---- components and splits


def union_find(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in parent}


def test_components(spark):
    rng = random.Random(4)
    pairs = [(f"n{rng.randrange(400):03d}", f"n{rng.randrange(400):03d}") for _ in range(230)] + [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)]
    pairs = [(a, b) for a, b in pairs if a != b]
    got = {r.record: r.group_id for r in components.components(spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert got == union_find(pairs)
    assert components.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_ties(spark):
    ties = [("t1", "b"), ("t1", "a"), ("t1", "a"), ("t2", "b"), ("t2", "c"), ("t3", "d"), (None, "a"), (None, "z"), ("t4", None), ("t4", "d")]
    got = {r.record: r.group_id for r in components.groups_of(spark.createDataFrame(ties, "token string, record string")).collect()}
    assert got == {"a": "a", "b": "a", "c": "a"}


def test_splits(spark):
    records = spark.createDataFrame([(f"r{i:05d}", 1 + i % 5) for i in range(6000)] + [("huge", 1500), ("zero", 0)], "record string, weight long")
    groups = spark.createDataFrame([(f"r{i:05d}", f"r{i - i % 3:05d}") for i in range(900)], "record string, group_id string")
    out = components.assign_splits(records, groups, queries.SHARES)
    assert out.count() == 6002 and out.groupBy("group_id").agg(F.countDistinct("split").alias("n")).filter("n > 1").count() == 0
    share = {r[0]: r[1] / 19500 for r in out.join(records, "record").groupBy("split").agg(F.sum("weight")).collect()}
    assert abs(share["train"] - 0.8) < 0.03 and abs(share["test"] - 0.1) < 0.03
    again = components.assign_splits(records.repartition(7), groups, queries.SHARES)
    assert out.exceptAll(again).count() == 0
    assert components.assign_splits(records.limit(0), groups.limit(0), queries.SHARES).count() == 0
    # another component, however large, moves none of the others
    more = components.assign_splits(records.unionByName(spark.createDataFrame([("giant", 10**6)], records.schema)), groups, queries.SHARES)
    assert more.filter("record <> 'giant'").exceptAll(out).count() == 0 and more.count() == 6003
    placed = components.assign_splits(records, groups, queries.SHARES, placed_above=0.005)
    near = {r[0]: r[1] / 19500 for r in placed.join(records, "record").groupBy("split").agg(F.sum("weight")).collect()}
    assert abs(near["train"] - 0.8) < 0.03 and abs(near["test"] - 0.1) < 0.03


def test_large_clusters_are_looked_up_apart(spark):
    pairs = [("a", f"n{i:03d}") for i in range(300)] + [("a", "a"), ("b", "a"), ("b", "c"), ("b", "b")]
    df = spark.createDataFrame(pairs, "v string, u string")
    want = sorted((v, u, min(x for w, x in pairs if w == v)) for v, u in pairs)
    for hot in (2, 100, 10**6):
        assert sorted(map(tuple, components.with_least(df, hot).select("v", "u", "m").collect())) == want


# ---- names


REFERENCE = [
    (1, "service", "Детский сад", "kindergarten", ["ДОУ"]), (2, "service", "Общеобразовательная школа", "secondary school", ["СОШ"]),
    (3, "service", "Парк", "urban park", []), (4, "zone", "Смешанное использование", "mixed_use", None),
]


def test_names(spark):
    typed = {
        "ДЕТСКИЙ САД": 1, "Детский сад ": 1, "сад, Детский": 1, "ltncrbq cfl": 1, "Detskiy sad": 1, "Детс. сад": 1, "Дeтcкий сaд": 1, "дОУ": 1, "детскийсад": 1, "Дтеский сад": 1, "Детский сад №7": 1,
        "тип: Детский сад": 1, "Детский сад (на ремонте)": 1, "«Детский  сад»!": 1, "Общеобраз. школа": 2, "secondary_school": 2, "Общеобразоватленая школа": 2, "сош": 2, "парк": 3, "Маяк": -1, "н/д": -1,
        "Танцевальная школа": -1, "Детский лагерь": -1, "12345": -1, "?" * 5000: -1, "пакр": 3,
    }
    rows = [("service", v, i) for i, v in enumerate(typed)] + [("zone", "mixd use", 98), ("zone", "смешанное-использование", 99), ("service", None, 1), ("service", " \t ", 2), ("service", "Детский сад", 3), ("none", "x", 5)]
    df = spark.createDataFrame(rows, "kind string, value string, k int").withColumn("c", F.lit("clash"))
    ref = spark.createDataFrame(REFERENCE, "canon_id long, kind string, canon_name string, name_en string, also_known array<string>")
    got = {r.value: r.canon_id for r in canonical.canonical(df, ref).collect()}
    assert got == {**typed, "mixd use": 4, "смешанное-использование": 4, "x": -1}
    assert canonical.canonical(df.limit(0), ref).count() == 0
    assert {r.canon_id for r in canonical.canonical(df, ref.limit(0)).collect()} == {-1}
    joined = {r.value: r.canon_id for r in canonical.canonical(df, ref, deletes=0).collect()}
    assert joined == got  # a list too long for a broadcast
    assert canonical.canonical(df.unionByName(df), ref).count() == 2 * canonical.canonical(df, ref).count()


def test_most_values_are_found_by_deletes():
    d = canonical.Dictionary([(i, tuple(x for x in (name, en.replace("_", " "), *(also or [])) if x), 0) for i, kind, name, en, also in REFERENCE if kind == "service"])
    for value in ("Детский сад", "Детскии сад", "Дтеский сад", "Общеобразовательная школа (план)", "Общеобразоватленая школа", "Парк №107"):
        cost, how, form = min((c, h, f) for c, h, f in canonical.forms(value) if d(f) > 0)
        keys = {k for x in canonical.probes(how, form, canonical.bound(len(form) + 1)) for k in d.near.get(x, ())}
        assert d(value) in {d.entry[k] for k in keys}


def test_distance_and_deletes():
    rng = random.Random(6)

    def plain_distance(a, b):  # breadth-first over single edits
        seen, last, n = {a}, {a}, 0
        while b not in seen:
            n += 1
            step = set()
            for w in last:
                for i in range(len(w) + 1):
                    step |= {w[:i] + c + w[i:] for c in "abc"} | ({w[:i] + w[i + 1 :]} if i < len(w) else set()) | ({w[:i] + c + w[i + 1 :] for c in "abc"} if i < len(w) else set())
                    if i + 1 < len(w):
                        step.add(w[:i] + w[i + 1] + w[i] + w[i + 2 :])
            last = step - seen
            seen |= step
        return n

    for _ in range(60):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(2))
        n = plain_distance(a, b)
        assert canonical.distance(a, b)[0] == n
        if n <= 2:
            assert canonical.deletes(a, 2) & canonical.deletes(b, 2)


# ---- percentiles


def test_percentiles(spark):
    rng = np.random.default_rng(2)
    data = [(str(i % 7) if i % 3 else "hot", float(np.round(rng.normal(0, 5), 1))) for i in range(4000)] + [("0", float("nan")), ("0", None), (None, 3.0), (None, 3.0), ("inf", float("inf")), ("nothing", None)]
    df = spark.createDataFrame(data, "g string, v double").withColumn("n", F.lit("clash"))
    state = percentiles.value_counts(df, ["v"], F.col("g"))
    got = {(r.grp, r.percentile): r.value for r in percentiles.percentiles(state, (1, 50, 90, 99, 100)).collect()}
    want = {}
    for g in {g for g, _ in data}:
        v = sorted(x for h, x in data if h == g and x is not None and x == x)
        want |= {(g, p): v[-(-p * len(v) // 100) - 1] for p in (1, 50, 90, 99, 100) if v}
    assert got == want
    halves = [percentiles.value_counts(d, ["v"], F.col("g")) for d in df.randomSplit([0.5, 0.5], seed=1)]
    merged = {(r.grp, r.percentile): r.value for r in percentiles.percentiles(percentiles.merge(*halves), (1, 50, 90, 99, 100)).collect()}
    assert merged == want
    assert percentiles.percentiles(state.limit(0)).count() == 0


def test_rounded_state(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1.23456, 98765.4, -0.0012345, 0.0)], "g string, v double")
    got = sorted(r.value for r in percentiles.value_counts(df, ["v"], F.col("g"), digits=3).collect())
    assert got == pytest.approx([-0.00123, 0.0, 1.23, 98800.0])


# ---- queries


def test_registered_queries(spark, folder, duck):
    from tests.conftest import plain

    for name, sql in queries.SQL.items():
        df, other = queries.QUERIES[name](spark, folder), duck.execute(sql)
        columns = [c[0] for c in other.description]
        assert plain(df.select(*sorted(columns)).collect()) == plain([[r[columns.index(c)] for c in sorted(columns)] for r in other.fetchall()]), name
    assert queries.p8_round_trip(spark, folder).filter("not same or same is null").count() == 0
    assert queries.p9_found(spark, folder).count() >= 0 and queries.p2_found(spark, folder).count() > 0 and queries.p1_splits(spark, folder).count() > 0
