"""The n-gram Jaccard join against all pairs."""

import random
import re

import numpy as np
import pytest

from turbula.llm import jaccard_groups as J


def shingles(text, width):
    w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    return {b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def components(rows, width, percent):
    """Size of each set and smallest linked id, by all pairs."""
    sets = [(i, shingles(t, width)) for i, t in rows]
    up = {i: i for i, _ in rows if i is not None}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if i is not None and j is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return sorted(((i, len(s), None if i is None else root(i)) for i, s in sets), key=str)


def corpus(seed=3, groups=25):
    rng, rows = random.Random(seed), []
    for _ in range(groups):
        text = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([4, 12, 60, 300, 900]))]
        for _ in range(rng.choice([1, 2, 5])):
            copy = list(text)
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                copy[rng.randrange(len(copy))] = f"w{rng.randrange(4000)}"
            rows.append((len(rows) * 3 + 5, rng.choice([" ", "\n", "  "]).join(copy)))
    rng.shuffle(rows)
    return rows


ODD = [(None, "a b c"), (1, None), (2, ""), (3, " \t"), (4, "One"), (900, "one"), (901, "one two"), (902, "ONE  two"), (903, "a b c"), (903, "x y z q"), (904, "X y z q"), (905, "a b c")]


@pytest.mark.parametrize("width,percent,block_rows", [(3, 90, 96), (5, 80, 4)])
def test_all_links_are_found(make_docs, width, percent, block_rows):
    rows = corpus() + ODD
    got = J.jaccard_components(make_docs(rows), width, percent, block_rows)
    assert sorted(map(tuple, got.collect()), key=str) == components(rows, width, percent)


def test_one_large_group_in_small_blocks(make_docs):
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*base[: i % 200], f"new{i}", *base[i % 200 + 1 :]])) for i in range(120)] + [(500 + i, " ".join(base)) for i in range(40)]
    got = J.jaccard_components(make_docs(rows), 3, 90, block_rows=7).collect()
    assert {r["component_id"] for r in got} == {0}


def test_one_of_each_group_stays(make_docs):
    rows = corpus(9) + ODD
    kept = J.keep_one(make_docs(rows))
    want = sorted((i for i, _, c in components(rows, 5, 80) if i == c), key=str)
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == want
    assert kept.columns == make_docs(rows).columns


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80)])
def test_common_passages_pair_no_blocks(make_docs, monkeypatch, width, percent):
    rng, asked = random.Random(4), []
    common = [" ".join(f"c{i}w{k}" for k in range(20)) for i in range(10)]
    rows = []
    for g in range(100):
        own = " ".join(f"g{g}w{k}" for k in range(30))
        rows += [(2 * g + i, " ".join([own, *rng.sample(common, 3)])) for i in range(2)]

    def seen(df, checkpointed=J.checkpointed):
        done = checkpointed(df)
        if done.columns == ["asking", "asked"]:
            asked.append(done.count())
        return done

    monkeypatch.setattr(J, "checkpointed", seen)
    got = J.jaccard_components(make_docs(rows), width, percent, block_rows=4)
    assert sorted(map(tuple, got.collect()), key=str) == components(rows, width, percent)
    assert len(asked) == 1 and asked[0] <= 2 * 100


def test_rarest_tokens_come_first(spark):
    sets = {1: [5, 7, 9, 11], 2: [5, 7, 9, 12], 3: [5, 7, 13, 14], 4: [5, 20, 21, 22], 5: [3], 6: [3]}
    # High bits, so that 32 bits of a bucket tell the tokens apart.
    rows = [(i, len(x), np.array([t << 40 for t in x], np.uint64).tobytes()) for i, x in sets.items()]
    got = J.rare_prefixes(spark.createDataFrame(rows, "rep long, n long, tokens binary"), 50, 18).collect()
    # 3 of 4, or the one: 1 has 11 (alone, left out), 9 and 7; 3 has 13 and 14 (alone) and 7; 4 only such.
    assert sorted((r["rep"], r["n"], r["token"] >> 40) for r in got) == [(1, 4, 7), (1, 4, 9), (2, 4, 7), (2, 4, 9), (3, 4, 7), (5, 1, 3), (6, 1, 3)]


def test_pairs_in_and_between_blocks():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 40, n).astype(np.uint64)) for n in rng.integers(1, 40, 60)]
    side = rng.integers(0, 2, 60)
    want = {(i, j) for j in range(60) for i in range(j) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 50 * len(np.union1d(sets[i], sets[j]))}
    assert set(zip(*map(np.ndarray.tolist, J.linked_pairs(sets, 50, cells=500)), strict=True)) == want
    across = {(i, j) for i, j in want if side[i] != side[j]}
    assert set(zip(*map(np.ndarray.tolist, J.linked_pairs(sets, 50, side)), strict=True)) == across


def test_no_rows(make_docs):
    none = make_docs([(1, "x")]).where("doc_id < 0")
    assert J.jaccard_components(none).count() == 0 and J.keep_one(none).count() == 0
