"""Approximate nearest neighbours by adaptive dimension scan.

Vectors are rotated at random, so that any first d of D coordinates carry about
d/D of a distance, and kept in column blocks. Within each probed list all its
queries add up one block at a time and abandon a candidate as soon as its
partial distance rejects, at the level of ``epsilon``, the hypothesis that the
whole one is below that of the query's k-th best so far. Survivors' distances
are computed in full on the original vectors.

A query begins with a bound from its distances to a few rows of the table, so
that no shard starts without one. How many lists it probes follows from the
sample, too: as many as hold the stated share of the sample's own nearest
neighbours. Clustered vectors need few; vectors that are spread evenly in many
dimensions need most lists, and then a query set of n/100 rows costs in
proportion to n * n whatever the index.

Equal vectors are one candidate with its smallest ids. Lists are kept in shards
of bounded size and queries come in blocks of bounded size; a task sees one
shard and one block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turbula.llm.vectors import CoarseLists, coarse_lists, matrix, of_one_length, smallest, squared_distances, valid_vectors


def scan_list(
    rotated: np.ndarray, queries: np.ndarray, bound: np.ndarray, blocks: list[int], epsilon: float
) -> tuple[np.ndarray, np.ndarray]:
    """The (query, row) pairs that the hypothesis tests leave; ``bound``: each query's squared distance to beat."""
    width = rotated.shape[1]
    q, r, partial = None, None, None
    for a, b in zip([0, *blocks], blocks, strict=False):
        most = bound * (b / width) * ((1 + epsilon / np.sqrt(b)) ** 2 if b < width else 1 + 1e-9) + 1e-12
        if q is None:
            partial = squared_distances(queries[:, :b], rotated[:, :b])
            q, r = np.nonzero(partial <= most[:, None])
            partial = partial[q, r]
        else:
            gap = rotated[r, a:b] - queries[q, a:b]
            partial = partial + np.einsum("ij,ij->i", gap, gap)
            keep = partial <= most[q]
            q, r, partial = q[keep], r[keep], partial[keep]
    return q, r


def first_bounds(lists: CoarseLists, v: np.ndarray, k: int, n: int, rows: int) -> np.ndarray:
    """For each query, the squared distance to the 2k-th nearest of ``rows`` rows of the sample.

    A table of at least four times ``rows`` rows holds about 8k or more rows
    within that distance, so that k are found; smaller ones get no bound.
    """
    if n < 4 * rows or len(lists.sample) < rows or rows < 2 * k + 1:
        return np.full(len(v), np.inf)
    # The query itself may be among the rows.
    return np.partition(squared_distances(v, lists.sample[:rows]), 2 * k, 1)[:, 2 * k] * (1 + 1e-9) + 1e-12


def probes_for(lists: CoarseLists, k: int, share: float, least: int, trials: int = 300) -> int:
    """How many lists hold ``share`` of the nearest neighbours of rows of the sample.

    Of ``k`` neighbours in the table about k / scale are in the sample, and at
    least one is looked for; they are farther away than those of the whole
    table, so the number is rather too large than too small.
    """
    x = lists.sample
    if len(x) < 3:
        return len(lists.centre)
    asked = np.arange(min(trials, len(x)))
    d = squared_distances(x[asked], x)
    d[asked, asked] = np.inf
    near = smallest(d, min(max(1, round(k / lists.scale)), len(x) - 1))
    order = np.argsort(squared_distances(x[asked], lists.centre), 1, kind="stable")
    rank = np.argsort(order, 1, kind="stable")
    found = np.sort(np.take_along_axis(rank, lists.own[near], 1).ravel())
    needed = int(found[min(len(found) - 1, int(np.ceil(share * len(found))) - 1)]) + 1
    return min(len(lists.centre), max(least, needed))


class Best:
    """The k nearest of each query so far, ties to the smaller id."""

    def __init__(self, keys: np.ndarray, bound: np.ndarray, k: int):
        self.keys, self.k = keys, k
        self.bound = bound.copy()
        self.q, self.d, self.id = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)

    def add(self, q: np.ndarray, d: np.ndarray, ids: np.ndarray) -> None:
        q, d, ids = np.concatenate([self.q, q]), np.concatenate([self.d, d]), np.concatenate([self.id, ids])
        order = np.lexsort((d, ids, q))
        order = order[np.append(True, (np.diff(q[order]) != 0) | (np.diff(ids[order]) != 0))]  # an id's nearest row
        order = order[np.lexsort((ids[order], d[order], q[order]))]
        q, d, ids = q[order], d[order], ids[order]
        first = np.searchsorted(q, np.arange(len(self.keys)))
        rank = np.arange(len(q)) - first[q]
        keep = rank < self.k
        full = rank == self.k - 1
        self.bound[q[full]] = np.minimum(self.bound[q[full]], d[full])
        self.q, self.d, self.id = q[keep], d[keep], ids[keep]


def nearest_neighbours(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    share: float = 0.97,
    least_probes: int = 16,
    list_rows: int = 256,
    most_lists: int = 4096,
    shard_rows: int = 32_768,
    block_queries: int = 16_384,
    sample: int = 20_000,
    bound_rows: int = 1000,
    epsilon: float = 3.0,
    seed: int = 11,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """The ``k`` nearest other rows of every row for which ``is_query`` (a condition on ``vec_id``) holds.

    Returns ``query_id, rank`` (from 1), ``vec_id, score`` (Euclidean distance in
    double precision); ties go to the smaller id; all candidates if fewer.
    Vectors that are null, empty, zero or hold null or non-finite components,
    those of another than the most frequent length, and null ids take no part.
    An id that repeats is found at most once, by its nearest row; of a query id that repeats, the row with the smallest vector asks. No
    queries, or an empty table: an empty result. The lists are trained on at most ``sample``
    rows; every row is indexed. ``share``: see :func:`probes_for`.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    base, n, width = of_one_length(valid_vectors(vectors, id_column, vector_column))
    queries = base.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    n_queries = queries.count() if n else 0
    if not n_queries:
        return spark.createDataFrame([], schema)
    lists = coarse_lists(base, n, list_rows, most_lists, sample)
    probes = probes_for(lists, k, share, least_probes)
    rotation = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, width)))[0]
    columns = [c for c in (8, 16, 32, 64, 128, 256, 512) if c < width] + [width]
    n_blocks = -(-n_queries // block_queries)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shard_rows = min(shard_rows, max(1024, n // tasks))
    # Components as they are stored: single precision loses nothing of a float column.
    kind = "<f4" if "float" in vectors.schema[vector_column].dataType.simpleString() else "<f8"

    # Shards: whole lists together, large lists in chunks.
    shard_of: list[list[int]] = []
    shard, room = 0, shard_rows
    for size in lists.sizes():
        chunks = max(1, round(size / shard_rows))
        if room < min(size, shard_rows) / 2:
            shard, room = shard + 1, shard_rows
        shard_of.append([shard + c for c in range(chunks)])
        shard += chunks - 1
        room = shard_rows if chunks > 1 else room - size
        if chunks > 1:
            shard += 1

    def near(v: np.ndarray, count: int) -> np.ndarray:
        return smallest(squared_distances(v, lists.centre), count)

    def stored(column: pd.Series) -> np.ndarray:
        return np.frombuffer(b"".join(column), kind).reshape(len(column), width).astype(np.float64)

    def deal_vectors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), 1024):
                g = f.iloc[at : at + 1024]
                x = matrix(g["v"])
                own = near(x, 1)[:, 0]
                first = g["ids"].map(lambda ids: int(ids[0])).to_numpy(np.int64)
                spread = (first * 0x9E3779B1 >> 7) & 0x7FFFFFFF
                to = [shard_of[i][h % len(shard_of[i])] for i, h in zip(own, spread, strict=True)]
                yield pd.DataFrame({"shard": np.array(to, np.int32), "list": own.astype(np.int32), "v": [r.tobytes() for r in x.astype(kind)], "ids": g["ids"].array})

    def deal_queries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), 256):
                g = f.iloc[at : at + 256]
                rows: dict[str, list] = {"shard": [], "query_id": [], "v": [], "bound": [], "probed": []}
                x = matrix(g["v"])
                bounds = first_bounds(lists, x, k, n, bound_rows)
                for key, v, bound, found in zip(g["query_id"], x.astype(kind), bounds, near(x, probes).tolist(), strict=True):
                    by: dict[int, list[int]] = {}
                    for i in found:
                        for s in shard_of[i]:
                            by.setdefault(s, []).append(i)
                    for s, own in by.items():
                        for name, value in zip(rows, (s, key, v.tobytes(), bound, own), strict=True):
                            rows[name].append(value)
                yield pd.DataFrame(rows)

    ranked = base.withColumn("_n", F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("_n") <= k + 1)
    candidates = ranked.groupBy("v").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
    left = candidates.mapInPandas(deal_vectors, "shard int, list int, v binary, ids array<long>")
    # The stated query set meets all rows in blocks; up to ``block_queries`` queries there is one.
    left = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))) if n_blocks > 1 else F.lit(0))
    right = queries.withColumnRenamed("vec_id", "query_id").mapInPandas(
        deal_queries, "shard int, query_id long, v binary, bound double, probed array<int>"
    )
    right = right.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).cast("int"))

    def search(mine: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        best = Best(asked["query_id"].to_numpy(np.int64), asked["bound"].to_numpy(float), k)
        if len(mine) and len(asked):
            mine = mine.sort_values("list", kind="stable")
            x, v = stored(mine["v"]), stored(asked["v"])
            turned, turned_queries = x @ rotation, v @ rotation
            many = np.array([len(i) for i in mine["ids"]])
            ids, begin = np.concatenate(list(mine["ids"])).astype(np.int64), np.cumsum(many) - many
            of_list, held = mine["list"].to_numpy(), np.repeat(np.arange(len(asked)), [len(p) for p in asked["probed"]])
            probed = np.concatenate(list(asked["probed"]))
            order = np.argsort(probed, kind="stable")
            probed, held = probed[order], held[order]
            for i in np.unique(of_list):
                a, b = np.searchsorted(of_list, [i, i + 1])
                who = held[slice(*np.searchsorted(probed, [i, i + 1]))]
                step = max(1, 250_000 // (b - a))
                for at in range(0, len(who), step):
                    some = who[at : at + step]
                    q, r = scan_list(turned[a:b], turned_queries[some], best.bound[some], columns, epsilon)
                    q, r = some[q], r + a
                    gap = x[r] - v[q]
                    d = np.einsum("ij,ij->i", gap, gap)
                    keep = d <= best.bound[q]
                    q, r, d = q[keep], r[keep], d[keep]
                    # Each id of equal vectors is a candidate.
                    times = many[r]
                    offset = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    q, d, found = np.repeat(q, times), np.repeat(d, times), ids[np.repeat(begin[r], times) + offset]
                    other = found != best.keys[q]
                    if other.any():
                        best.add(q[other], d[other], found[other])
        return pd.DataFrame({"query_id": best.keys[best.q], "vec_id": best.id, "score": np.sqrt(best.d)})

    found = (
        left.groupBy("shard", "block")
        .cogroup(right.groupBy("shard", "block"))
        .applyInPandas(search, "query_id long, vec_id long, score double")
    )
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
