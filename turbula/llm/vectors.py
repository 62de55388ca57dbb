"""What the vector operators share: valid vectors, coarse lists, and how large they will be."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turbula.llm.shared import bounded_sample


def valid_vectors(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``vec_id, v``: rows whose vector is neither null, empty nor zero and whose components are all finite."""
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return (
        vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("v"))
        .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
        .where(sound & F.exists("v", lambda x: x != 0.0))
    )


def of_one_length(vectors: DataFrame) -> tuple[DataFrame, int, int]:
    """Vectors of the most frequent length (of two, the longer), their number and that length."""
    top = (
        vectors.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    )
    if top is None:
        return vectors, 0, 0
    return vectors.where(F.size("v") == top["d"]), top["n"], top["d"]


def matrix(rows) -> np.ndarray:
    return np.array(list(rows), np.float64)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def squared_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1), 0)


def k_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centre = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = np.argmin((centre * centre).sum(1) - 2 * x @ centre.T, 1)
        total = np.zeros_like(centre)
        np.add.at(total, own, x)
        n = np.bincount(own, minlength=len(centre))[:, None]
        centre = np.where(n > 0, total / np.maximum(n, 1), centre)
    return centre


@dataclass(frozen=True)
class CoarseLists:
    centre: np.ndarray
    sample: np.ndarray
    own: np.ndarray  # of each sample row
    scale: float  # rows that a row of the sample stands for

    def sizes(self) -> np.ndarray:
        """Estimated rows of each list."""
        return np.bincount(self.own, minlength=len(self.centre)) * self.scale


def coarse_lists(vectors: DataFrame, n: int, list_rows: int, most_lists: int, sample: int) -> CoarseLists:
    """Lists of about ``list_rows`` rows of column ``v``, trained on at most ``sample`` of them; every row is put into one later."""
    x = matrix(r["v"] for r in bounded_sample(vectors.select("v"), ["v"], sample, n))
    centre = k_means(x, max(1, min(most_lists, n // list_rows, len(x))))
    own = np.argmin(squared_distances(x, centre), 1)
    return CoarseLists(centre, x, own, n / max(1, len(x)))


@dataclass(frozen=True)
class Cells:
    """Inverted lists in two levels: the coarse centres, and in each the same centres of what is left over.

    A cell's number is its list's times the number of second centres, plus that
    of its second centre. With one second centre, at the origin, lists are cells.
    """

    centre: np.ndarray
    second: np.ndarray
    sample: np.ndarray
    scale: float  # rows that a row of the sample stands for

    def nearest(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The ``probes`` nearest cells of each row, nearest first: of all lists, or of the cells of the nearest lists."""
        k = len(self.second)
        d = squared_distances(x, self.centre)
        lists = smallest(d, min(probes, len(self.centre)))
        if k == 1:
            return lists
        rest = x[:, None, :] - self.centre[lists]
        far = squared_distances(rest.reshape(-1, x.shape[1]), self.second).reshape(len(x), -1)
        best = smallest(far, min(probes, far.shape[1]))
        return np.take_along_axis(lists, best // k, 1) * k + best % k

    def centre_of(self, cell: int) -> np.ndarray:
        return self.centre[cell // len(self.second)] + self.second[cell % len(self.second)]


def smallest(d: np.ndarray, n: int) -> np.ndarray:
    """The columns of the ``n`` smallest values of each row, in order."""
    part = np.argpartition(d, n - 1, 1)[:, :n] if n < d.shape[1] else np.broadcast_to(np.arange(d.shape[1]), d.shape)
    return np.take_along_axis(part, np.argsort(np.take_along_axis(d, part, 1), 1, kind="stable"), 1)


def cells(vectors: DataFrame, n: int, cell_rows: int, most_lists: int, most_second: int, sample: int) -> Cells:
    """Cells of about ``cell_rows`` unit vectors, however many there are, up to ``most_lists * most_second`` cells.

    Both levels are trained on at most ``sample`` rows; every row is put into a
    cell later. Up to ``most_lists`` cells, one level does.
    """
    x = unit(matrix(r["v"] for r in bounded_sample(vectors.select("v"), ["v"], sample, n)))
    wanted = max(1, n // cell_rows)
    first = max(1, min(wanted, most_lists, len(x) // 4))
    centre = k_means(x, first)
    second = min(most_second, -(-wanted // first), len(x))
    rest = x - centre[np.argmin(squared_distances(x, centre), 1)]
    books = k_means(rest, second, seed=5) if second > 1 else np.zeros((1, x.shape[1]))
    return Cells(centre, books, x, n / max(1, len(x)))
