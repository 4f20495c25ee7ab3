"""Passages and names that were once passed over."""

import time

import numpy as np
import pytest

from blockloom.llm import canonical, leakage
from tests.llm.test_llm_operators import REFERENCE


def found(text, item):
    w = leakage.windows_of([(5, [item])])
    return leakage.searched(w, [text]) == {(0, 0)}


@pytest.mark.parametrize("k", range(1, 6))
def test_early_edit(k):
    item = [f"word{i}" for i in range(60)]
    for n, wanted in ((20, True), (19, False)):
        text = item[10 : 10 + n]
        text[k] = "other"
        assert found(" ".join(["noise"] * 30 + text + ["noise"] * 30), item) == wanted


def test_passage_after_a_close_edit():
    item = np.concatenate([np.full(60, -1), np.arange(1, 61), np.full(60, -1)]).astype(np.int32)
    text = np.concatenate([np.zeros(60), np.arange(1, 26), np.zeros(60)]).astype(np.int32)
    text[[65, 68]] = 0  # the run from the word behind the first edit has one edit
    assert int(leakage.longest_runs(text, np.array([60]), item, np.array([60]))[0]) == 19
    text[85] = 26
    assert int(leakage.longest_runs(text, np.array([60]), item, np.array([60]))[0]) == 20


def test_long_tags_and_comments():
    item = [f"word{i}" for i in range(60)]
    half = " ".join(item[10:21]), " ".join(item[21:32])
    for tag in (f'<img alt="" src="data:{"ab/ " * 300}"/>', f"<p class=x style='{'left: 0; ' * 100}' hidden>", f"<!-- {'note <b> ' * 100} -->"):
        assert len(tag) > 400 and leakage.words(half[0] + tag + half[1]) == item[10:32]
        assert found(half[0] + tag + half[1], item)
    code = f"if a <b then {'; '.join([half[0]] * 9)} -> c"
    assert len(leakage.words(code)) == 4 + 99 + 1
    assert leakage.words("a <!-- b") == ["a", "b"]
    began = time.time()
    for t in ("<!--" * 100_000, "<a " * 100_000, "<a" + " b" * 200_000, "<a " + 'b="' * 100_000, "<a" + " " * 200_000):
        leakage.plain(t)
    assert time.time() - began < 10


def test_padded_names(spark):
    pad = "​" * 900
    values = ["Детский" + " " * 900 + "сад", pad + "Детский сад", "Детский сад [" + " " * 900 + "1]", "Детский сад (строит" + "ельство" * 150 + ")", "Маяк" + " " * 900 + "Север"]
    df = spark.createDataFrame([("service", v) for v in values], "kind string, value string")
    ref = spark.createDataFrame(REFERENCE, "canon_id long, kind string, canon_name string, name_en string, also_known array<string>")
    got = {r.value: r.canon_id for r in canonical.canonical(df, ref).collect()}
    assert [got[v] for v in values] == [1, 1, 1, 1, -1]
    entries = tuple((i, (name,), 0) for i, _, name, *_ in REFERENCE)
    began = time.time()
    assert canonical.Dictionary(entries)("Детский" + " " * 200_000 + "сад") == 1
    assert canonical.Dictionary(entries)("Детский сад" + " (план)" * 30_000) == 1
    assert time.time() - began < 5
