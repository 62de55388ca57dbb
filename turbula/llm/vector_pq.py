"""Near-duplicate vectors by product quantisation.

Unit vectors are put into coarse inverted cells of about equal size; what is
left over after the cell's centre is coded in subspaces. Each vector is kept in
its own cell and probes a fixed number of the nearest ones, so the work for a
vector stays the same however many there are; two vectors meet if one of them
probes the other's cell. In a cell, asymmetric table lookups give each probing
vector's distance to every code; with the known length of a code's error this
bounds the true distance from below, so only pairs that may reach the cosine are
computed exactly, and only exact cosines link.

Equal vectors count as one with a multiplicity. A task emits, for each vector
that it linked, the number of links and one edge towards the smallest vector of
its local component, so pairs never leave a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turbula.llm.components import connected_components
from turbula.llm.shared import checkpointed
from turbula.llm.vectors import cells, k_means, matrix, of_one_length, squared_distances, unit, valid_vectors


class Roots:
    """Union of numbered things, with the smallest number as root."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """All pairs at once: roots take the smallest neighbour until nothing changes."""
        while True:
            x, y = self.up[a], self.up[b]
            low = np.minimum(x, y)
            before = self.up.copy()
            np.minimum.at(self.up, x, low)
            np.minimum.at(self.up, y, low)
            np.minimum.at(self.up, a, low)
            np.minimum.at(self.up, b, low)
            while (self.up != self.up[self.up]).any():
                self.up = self.up[self.up]
            if (before == self.up).all():
                return


def parts_of(cell: np.ndarray, rows: float, most: int) -> dict[int, int]:
    """Into how many parts each cell is cut that holds more than ``most`` rows; ``rows``: those that an entry stands for."""
    found, times = np.unique(cell, return_counts=True)
    parts = np.ceil(times * rows / most).astype(int)
    # A cell that the sample met only once or twice is not known to be large.
    large = (parts > 1) & (times > 2)
    return dict(zip(found[large].tolist(), parts[large].tolist(), strict=True))


def near_duplicate_vectors(
    vectors: DataFrame,
    cosine: float = 0.9,
    probes: int = 16,
    cell_rows: int = 128,
    most_lists: int = 4096,
    most_second: int = 4096,
    subspace: int = 4,
    codes: int = 256,
    chunk_rows: int = 1024,
    chunk_probes: int = 4096,
    sample: int = 20_000,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """Link vectors whose cosine, in double precision, is at least ``cosine``.

    Returns a row per row of ``vectors``: ``vec_id, n_links`` (other vectors
    linked directly), ``component_id`` (smallest id reachable by links, itself
    included), ``kept`` (whether that is itself). Null, empty or zero vectors,
    those with null or non-finite components and those of another than the most
    frequent length link with nothing. A row without an id has no links and a
    null component. Rows that repeat an id are vectors of their own with a
    common component. An empty table gives an empty result. Cells and codes are
    trained on at most ``sample`` rows; every row is indexed.

    A cell of more than ``chunk_rows`` vectors is kept in chunks, and one that
    more than ``chunk_probes`` vectors probe is searched in turns.
    """
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("v"))
    base, n, width = of_one_length(valid_vectors(vectors, id_column, vector_column))
    if not n:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    first, again = F.xxhash64("v"), F.xxhash64(F.lit(1), "v")
    distinct = checkpointed(base.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")).withColumn("node", first))
    index = cells(base, n, cell_rows, most_lists, most_second, sample)
    seen = index.sample[:4000]
    asked = index.nearest(seen, probes)
    own = index.nearest(index.sample, 1)[:, 0]
    left_over = index.sample - np.stack([index.centre_of(c) for c in own])
    subspaces = [slice(a, min(a + subspace, width)) for a in range(0, width, subspace)]
    books = [k_means(left_over[:, p], codes, rounds=4, seed=3) for p in subspaces]
    farthest = math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-9
    chunks = parts_of(own, index.scale, chunk_rows)
    turns = parts_of(asked.ravel(), n / max(1, len(seen)), chunk_probes)

    # Components as they are stored: single precision loses nothing of a float column.
    kind = "<f4" if "float" in vectors.schema[vector_column].dataType.simpleString() else "<f8"

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), 256):
                out: dict[str, list] = {"cell": [], "chunk": [], "turn": [], "member": [], "node": [], "rep": [], "copies": [], "v": [], "probed": []}
                g = f.iloc[at : at + 256]
                x = matrix(g["v"])
                for node, rep, copies, v, probed in zip(g["node"], g["rep"], g["copies"], x, index.nearest(unit(x), probes).tolist(), strict=True):
                    own, spread = probed[0], (rep * 0x9E3779B1 >> 7) & 0x7FFFFFFF
                    raw = v.astype(kind).tobytes()
                    to = [(own, spread % chunks.get(own, 1), t, True) for t in range(turns.get(own, 1))]
                    to += [(i, c, spread % turns.get(i, 1), False) for i in probed for c in range(chunks.get(i, 1))]
                    for i, c, t, member in to:
                        for name, value in zip(out, (i, c, t, member, node, rep, copies, raw, probed if member else probed[:1]), strict=True):
                            out[name].append(value)
                yield pd.DataFrame(out)

    def stored(column: pd.Series) -> np.ndarray:
        return unit(np.frombuffer(b"".join(column), kind).reshape(len(column), width).astype(np.float64))

    def link(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        found: dict[str, np.ndarray] = {"node": np.empty(0, np.int64), "rep": np.empty(0, np.int64), "links": np.empty(0, np.int64), "root": np.empty(0, np.int64)}
        centre = index.centre_of(int(key[0]))
        mine, asking = f[f["member"]], f[~f["member"]]
        if len(mine) and len(asking):
            u, q = stored(mine["v"]), stored(asking["v"])
            rest = u - centre
            code = [np.argmin(squared_distances(rest[:, p], b), 1) for p, b in zip(subspaces, books, strict=True)]
            near = np.concatenate([b[c] for b, c in zip(books, code, strict=True)], 1)
            error = np.linalg.norm(rest - near, axis=1)
            pairs = []
            for at in range(0, len(q), 1024):
                part = q[at : at + 1024] - centre
                adc = np.zeros((len(part), len(u)))
                for p, b, c in zip(subspaces, books, code, strict=True):
                    adc += squared_distances(part[:, p], b)[:, c]
                a, m = np.nonzero(np.sqrt(adc) <= farthest + error + 1e-9)
                for begin in range(0, len(a), 100_000):
                    i, j = at + a[begin : begin + 100_000], m[begin : begin + 100_000]
                    exact = np.einsum("ij,ij->i", q[i], u[j]) >= cosine
                    pairs.append((i[exact], j[exact]))
            a = np.concatenate([p[0] for p in pairs]) if pairs else np.empty(0, int)
            m = np.concatenate([p[1] for p in pairs]) if pairs else np.empty(0, int)
            (node_a, rep_a), (node_m, rep_m) = ((g["node"].to_numpy(np.int64), g["rep"].to_numpy(np.int64)) for g in (asking, mine))
            other = (node_a[a] != node_m[m]) | (rep_a[a] != rep_m[m])
            a, m = a[other], m[other]
            if len(a):
                times_a, times_m = asking["copies"].to_numpy(np.int64), mine["copies"].to_numpy(np.int64)
                home = np.array([p[0] for p in asking["probed"]])
                # The other vector finds this one too if it probes this one's own list.
                probes = [set(np.asarray(p).tolist()) for p in mine["probed"]]
                alone = np.array([h not in probes[j] for h, j in zip(home[a].tolist(), m.tolist(), strict=True)], bool)
                nodes, at = np.unique(np.concatenate([node_a[a], node_m[m]]), return_index=True)
                reps = np.concatenate([rep_a[a], rep_m[m]])[at]
                order = np.argsort(reps, kind="stable")  # the smallest id as root
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                x, y = place[np.searchsorted(nodes, node_a[a])], place[np.searchsorted(nodes, node_m[m])]
                links = np.bincount(x, times_m[m], len(nodes)) + np.bincount(y[alone], times_a[a[alone]], len(nodes))
                roots = Roots(len(nodes))
                roots.join(x, y)
                found = {"node": nodes[order], "rep": reps[order], "links": links.astype(np.int64), "root": reps[order][roots.up]}
        return pd.DataFrame(found)

    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = distinct.repartition(tasks, "rep").mapInPandas(
        deal, "cell long, chunk int, turn int, member boolean, node long, rep long, copies long, v binary, probed array<long>"
    )
    linked = checkpointed(dealt.groupBy("cell", "chunk", "turn").applyInPandas(link, "node long, rep long, links long, root long"))
    component = connected_components(linked.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    count = linked.groupBy("node", "rep").agg(F.sum("links").alias("links"))
    known = checkpointed(
        distinct.select("node", again.alias("_l"), "rep", "copies")
        .join(count, ["node", "rep"], "left")
        .join(component.withColumnRenamed("node", "rep"), "rep", "left")
        .select(F.col("node").alias("_k"), "_l", "rep", "copies", "component", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    )
    # Vectors meet their class by 128 bits of hash; those without an id or of no use stay without a match.
    keyed = rows.select("vec_id", F.when(F.col("vec_id").isNotNull(), first).alias("_k"), again.alias("_l"))
    often = F.col("copies") * 200 >= n  # at most 200 vectors: they are broadcast, so that their many rows are not shuffled to one task
    hot = F.broadcast(known.where(often))
    whole = keyed.join(hot, ["_k", "_l"]).unionByName(
        keyed.join(hot.select("_k", "_l"), ["_k", "_l"], "left_anti").join(known.where(~often), ["_k", "_l"], "left")
    )
    root = F.coalesce("component", "rep", "vec_id")
    return whole.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), root.alias("component_id"), F.coalesce(F.col("vec_id") == root, F.lit(False)).alias("kept")
    )
