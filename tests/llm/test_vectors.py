"""Nearest neighbours and near-duplicate vectors against brute force in double precision."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from turbula.llm import ann_scan, vector_pq

SCHEMA = "vec_id long, embedding array<float>, label long, v string, rep string, n long, list string, shard string"
BAD = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0] * 3]


def table(spark, vectors):
    return spark.createDataFrame([(i, None if x is None else [None if y is None else float(y) for y in x], 0, "a", "b", 1, "c", "d") for i, x in vectors], SCHEMA)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(30, 16))
    x = (centre[rng.integers(0, 30, 900)] + rng.normal(size=(900, 16)) * 0.22).astype(np.float32)
    x[700:760] = x[3]  # one large group of copies
    return [(i, x[i].tolist()) for i in range(900)] + [(2000 + i, b) for i, b in enumerate(BAD)]


def sound(vectors):
    return [(i, np.array(v, np.float32).astype(float)) for i, v in vectors if v and len(v) == 16 and None not in v and np.isfinite(v).all() and np.any(v)]


def test_nearest_neighbours(spark, vectors):
    got = ann_scan.nearest_neighbours(table(spark, vectors), F.col("vec_id") % 100 == 0, list_rows=40, shard_rows=100, block_queries=4).collect()
    rows = sound(vectors)
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    hits = total = 0
    for q in [i for i in ids if i % 100 == 0]:
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(1))
        d[ids == q] = np.inf
        want = np.lexsort((ids, d))[:10]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r for r, *_ in mine] == list(range(1, 11)) and q not in [i for _, i, _ in mine]
        for _, i, s in mine:
            assert s == pytest.approx(d[ids == i][0], rel=1e-12, abs=1e-12)
        assert mine == sorted(mine, key=lambda r: (r[2], r[1]))
        hits += len({i for _, i, _ in mine} & set(ids[want].tolist()))
        total += 10
    assert hits >= 0.9 * total


def test_fewer_candidates_than_asked(spark):
    df = table(spark, [(0, [1.0, 0.0]), (7, [1.0, 1.0]), (9, [1.0, 1.0]), (100, [3.0, 0.0])])
    got = ann_scan.nearest_neighbours(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in got] == [(0, 7), (0, 9), (0, 100), (100, 0), (100, 7), (100, 9)]


def test_a_scan_abandons_only_what_is_far():
    rng = np.random.default_rng(5)
    x, q = rng.normal(size=(500, 64)), rng.normal(size=(3, 64))
    x[250:] *= 6
    d = ((x[None] - q[:, None]) ** 2).sum(2)
    bound = np.sort(d, 1)[:, 9]
    who, row = ann_scan.scan_list(x, q, bound, [8, 16, 32, 64], 3.0)
    for i in range(3):
        assert set(row[who == i].tolist()) >= set(np.flatnonzero(d[i] <= bound[i]).tolist()) or len(row[who == i]) >= 9
        assert len(row[who == i]) < 30


def test_neighbours_in_64_even_dimensions(spark):
    """The hardest case for an index, and null and repeated ids."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(6000, 64))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(None, x[0].tolist()), (100, x[7].tolist()), (5, x[200].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann_scan.nearest_neighbours(df, F.col("vec_id") % 100 == 0).collect()
    ids, y = np.array([i for i, _ in rows if i is not None]), np.array([v for i, v in rows if i is not None])
    hits = 0
    for key in range(0, 6000, 100):
        every = ((y - np.array(min(y[ids == key].tolist()))) ** 2).sum(1)
        d = np.array([np.sqrt(every[ids == i].min()) if i != key else np.inf for i in range(6000)])
        mine = sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == key)
        assert [k for k, _ in mine] == list(range(1, 11))
        hits += len({i for _, i in mine} & set(np.lexsort((np.arange(6000), d))[:10].tolist()))
    assert hits >= 0.9 * 600


def test_few_lists_are_probed_where_vectors_cluster():
    rng = np.random.default_rng(3)
    for spread, least, most in ((0.05, 1, 8), (3.0, 20, 60)):
        centre = rng.normal(size=(60, 32))
        x = centre[rng.integers(0, 60, 3000)] + spread * rng.normal(size=(3000, 32))
        own = np.argmin(((x[:, None] - centre) ** 2).sum(2), 1)
        lists = ann_scan.CoarseLists(centre, x, own, 1.0)
        assert least <= ann_scan.probes_for(lists, 10, 0.97, 1) <= most


def test_near_duplicate_vectors(spark, vectors):
    got = {r["vec_id"]: r for r in vector_pq.near_duplicate_vectors(table(spark, vectors), cell_rows=30, chunk_rows=25, chunk_probes=50).collect()}
    assert len(got) == len(vectors)
    rows = sound(vectors)
    ids, x = [i for i, _ in rows], np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = x @ x.T >= 0.9
    np.fill_diagonal(link, False)
    degree = link.sum(1)
    mine = np.array([got[i]["n_links"] for i in ids])
    assert (mine <= degree).all() and mine.sum() >= 0.9 * degree.sum()
    root = np.arange(len(ids))
    for _ in range(40):
        root = np.array([min(root[k], root[link[k]].min(initial=root[k])) for k in range(len(ids))])
    same = [got[i]["component_id"] == ids[root[k]] for k, i in enumerate(ids)]
    assert np.mean(same) >= 0.9
    for i in range(2000, 2000 + len(BAD)):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


@pytest.mark.parametrize("most_lists", [4096, 20])
def test_links_at_the_threshold_in_64_dimensions(spark, most_lists):
    """Pairs of cosine 0.9 to 0.92 among vectors that are otherwise far apart, with cells in one level and in two."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(12_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.normal(size=(600, 64))
    side -= (side * x[:600]).sum(1, keepdims=True) * x[:600]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    c = rng.uniform(0.9005, 0.92, (600, 1))
    x = np.concatenate([x, c * x[:600] + np.sqrt(1 - c * c) * side])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = vector_pq.near_duplicate_vectors(df, most_lists=most_lists).where("n_links > 0").collect()
    assert all(r["n_links"] == 1 and r["component_id"] in (r["vec_id"], r["vec_id"] - 12_000) for r in got)
    assert len(got) >= 0.9 * 1200


def test_repeated_ids(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [1.0, 0.01]), (None, [1.0, 0.0])], "vec_id long, embedding array<double>")
    got = sorted((str(r["vec_id"]), r["n_links"], r["component_id"]) for r in vector_pq.near_duplicate_vectors(df).collect())
    assert got == [("1", 1, 1), ("1", 1, 1), ("2", 1, 1), ("3", 1, 1), ("None", 0, None)]


def test_no_vectors(spark, vectors):
    none = table(spark, vectors).where("vec_id < 0")
    assert vector_pq.near_duplicate_vectors(none).count() == 0
    assert ann_scan.nearest_neighbours(none, F.col("vec_id") % 100 == 0).count() == 0
    bad = table(spark, [(None, [1.0, 2.0]), (5, None)])
    assert sorted((str(r["vec_id"]), r["n_links"]) for r in vector_pq.near_duplicate_vectors(bad).collect()) == [("5", 0), ("None", 0)]
