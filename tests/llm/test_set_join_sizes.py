"""The set join on long texts and on groups of near copies around the threshold, against brute force."""

import os
import random

import numpy as np
import pytest

from bidlens.llm import setjoin
from bidlens.llm.tables import ship
from bidlens.session import shared_dir
from tests.llm.test_llm import brute_components, table


def edited(rng, words, base, edits):
    w = list(base)
    for _ in range(edits):
        w[rng.randrange(len(w))] = rng.choice(words)
    return " ".join(w)


@pytest.mark.parametrize("num,size", [(80, 5), (90, 3)])
def test_long_texts_and_groups_near_the_threshold(spark, num, size):
    """Texts of 5,000 shingles with a shared passage, near copies just inside and outside, and a loose group of 60."""
    ship(spark)
    rng = random.Random(num)
    words = [f"w{k}" for k in range(4000)]
    passage = [rng.choice(words) for _ in range(600)]
    rows = []
    for _ in range(4):
        base = [rng.choice(words) for _ in range(4400)] + passage
        rows.append((len(rows), " ".join(base), "a"))
        # an edit changes ``size`` shingles of both sets: this many leave a similarity of about num / 100
        limit = int(5000 * (100 - num) / (100 + num) / size)
        rows += [(len(rows) + k, edited(rng, words, base, int(limit * f)), "b") for k, f in enumerate((0.5, 0.97, 1.0, 1.06, 1.5))]
    base = [rng.choice(words) for _ in range(120)]
    edits = max(1, int(120 * (100 - num) / (100 + num) / size / 2))
    rows += [(100 + k, edited(rng, words, base, edits + k % 2), "c") for k in range(60)]
    got = sorted(map(tuple, setjoin.jaccard_components(table(spark, rows), num, 100, size).collect()), key=str)
    assert got == brute_components(rows, num, 100, size)


def test_spare_parts_grow_with_the_sets():
    plan = setjoin.Plan(80, 100, 5)
    small, large = setjoin.parts_of(plan, 40), setjoin.parts_of(plan, 4000)
    assert small[1] == setjoin.SPARE and large[1] > 0.24 * (large[0] - large[1])


def test_sets_and_lists_are_deleted_once_read(spark):
    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    base = [f"word{k % 97} other{k}" for k in range(400)]
    rows = [(i, " ".join([*base[: 390 + i % 7], f"end{i}"])) for i in range(30)]
    found = setjoin.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 80, 100, 5)
    assert {r.component_id for r in found.collect()} == {0}
    left = {name.rsplit("-", 1)[0] for name in set(os.listdir(folder)) - before}
    assert "links" in left and not left & {"wanted", "tokens", "rarer", "lists", "pairs"}


@pytest.mark.parametrize("num,size", [(80, 5), (90, 3)])
def test_keys_are_made_where_they_are_dealt_out(spark, num, size, monkeypatch):
    """Staged sets hold no keys, which take more room than the texts; what partners share is known without them."""
    plan = setjoin.Plan(num, 100, size)
    rng = np.random.default_rng(num)
    for n in [*range(0, 40), 57, 120, 333, 1000, 5000]:
        tokens = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        assert setjoin.least_of(plan, tokens) == setjoin.keys_of(plan, tokens)[1]
    ship(spark)
    rows = [(k, " ".join(f"w{rng.integers(0, 900)}" for _ in range(300)), "a") for k in range(20)]
    staged = {}
    write = setjoin.stage
    monkeypatch.setattr(setjoin, "stage", lambda df, label: staged.setdefault(label, df.columns) and write(df, label))
    setjoin.labelled(table(spark, rows), num, 100, size).collect()
    assert "sets" in staged and "keys" not in staged["sets"]
