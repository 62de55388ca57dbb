"""Quality classification by Bradley-Terry pairwise ranking.

Every document gets a few shape features of its whole text. From pairs of a
better and a worse labelled document, a linear score is learned by logistic
loss on the difference of their features, P(a beats b) = sigmoid(s(a) - s(b)).
All labelled documents take part: blocks of them learn weights of their own,
whose mean over the blocks is the score's. A document is accepted above a
quantile of the scores of all training documents.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turbula.llm.rows import keep_rows, map_rows, whole_text
from turbula.llm.shared import written

FEATURES = (
    "letters", "upper", "digits", "marks", "symbols", "exclaims", "pipes", "spaces",
    "word_length", "long_words", "repeated_next", "distinct_words", "repeated_lines", "line_length", "length",
)

_CLASS = np.zeros(256, np.intp)
for _names, _k in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"0123456789", 2), (b".,;:'\"?()-", 3), (b"!", 5), (b"|", 6), (b" \t\r\n", 7)):
    _CLASS[list(_names)] = _k
_CLASS[list(b"#$%&*+/<=>@[]\\^_`{}~")] = 4
_WORDS = re.compile(rb"[^\x09-\x0d\x20]+").findall


def text_features(text: bytes) -> list[float]:
    """The FEATURES of a whole text; an empty text has zeros."""
    if not text:
        return [0.0] * len(FEATURES)
    n = len(text)
    kinds = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=8) / n
    words = _WORDS(text.lower())
    m = max(1, len(words))
    lines = [x for x in text.split(b"\n") if x]
    same = sum(map(bytes.__eq__, words, words[1:]))
    size = n - kinds[7] * n
    return [
        kinds[0], kinds[1], kinds[2], kinds[3], kinds[4], kinds[5], kinds[6], kinds[7],
        size / m / 10, sum(len(w) > 20 for w in words) / m, same / m, len(set(words)) / m,
        1 - len(set(lines)) / max(1, len(lines)), min(1.0, n / max(1, len(lines)) / 1000), np.log1p(m) / 10,
    ]


@dataclass(frozen=True)
class QualityModel:
    """score = sigmoid(scale * (weights . standardised features - cut) + logit(accept))."""

    mean: tuple[float, ...]
    spread: tuple[float, ...]
    weights: tuple[float, ...]
    cut: float
    scale: float
    accept: float

    def rank(self, features: np.ndarray) -> np.ndarray:
        """The Bradley-Terry score of each row of features."""
        return (features - self.mean) / self.spread @ np.array(self.weights)

    def score(self, features: np.ndarray) -> np.ndarray:
        z = self.scale * (self.rank(features) - self.cut) + np.log(self.accept / (1 - self.accept))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def pair_weights(x: np.ndarray, labels: np.ndarray, turns: int = 6, rounds: int = 300) -> np.ndarray:
    """Weights of standardised features by logistic loss on pairs of a document with label 1 and one with label 0.

    In each turn every document of the larger class meets the next one of the
    other, so that each document is compared at least ``turns`` times.
    """
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    i = np.arange(max(len(good), len(bad)))
    x = np.clip(x, -8, 8)
    shift = max(1, min(len(good), len(bad)) // turns)
    a, b = (len(good) > len(bad)) * shift, (len(good) <= len(bad)) * shift
    difference = np.concatenate([x[good[(i + t * b) % len(good)]] - x[bad[(i + t * a) % len(bad)]] for t in range(turns)])
    w, step = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for _ in range(rounds):
        miss = 1 / (1 + np.exp(np.clip(difference @ w, -30, 30)))
        step = 0.9 * step + difference.T @ miss / len(difference) - 1e-4 * w
        w += 0.5 * step
    return w


def without_a_label(width: int, any_good: bool, accept: float) -> QualityModel:
    """Without both labels nothing can be ranked: every score is 0.5, or ``accept`` and up where all labels are 1."""
    return QualityModel((0.0,) * width, (1.0,) * width, (0.0,) * width, 0.0 if any_good else 1.0, 1.0, accept)


def fit_pairs(features: np.ndarray, labels: np.ndarray, accept: float = 0.7) -> QualityModel:
    """The model of one block of documents.

    The cut is the quantile of the scores at the share of label 0, moved to the
    middle of the gap around it.
    """
    n_bad = int((labels == 0).sum())
    if not n_bad or not (labels == 1).any():
        return without_a_label(features.shape[1] if features.size else len(FEATURES), bool((labels == 1).any()), accept)
    mean, spread = features.mean(0), features.std(0) + 1e-6
    model = QualityModel(tuple(mean), tuple(spread), tuple(pair_weights((features - mean) / spread, labels)), 0.0, 1.0, accept)
    s = np.sort(model.rank(features))
    k = min(len(s) - 1, n_bad)
    return QualityModel(model.mean, model.spread, model.weights, float((s[k - 1] + s[k]) / 2), 4 / max(1e-6, float(np.std(s))), accept)


def fit_quality(
    docs: DataFrame, labels: DataFrame, train, label: str = "quality", block: int = 4000, accept: float = 0.7, id_column: str = "doc_id", text_column: str = "text"
) -> QualityModel:
    """The model of all labelled documents for which ``train``, a condition on the id column, holds.

    Labels other than 0 and 1, null ids and null labels are left out; of a
    repeated id the largest label counts. Features are written once in the shared
    folder; the driver gets sums, the weights of each block of some ``block``
    documents, and the scores nearest to the cut.
    """
    key, width = F.col(id_column).cast("long"), len(FEATURES)
    told = labels.where(key.isNotNull() & F.col(label).isin(0, 1)).where(train).groupBy(key.alias("_id")).agg(F.max(label).cast("int").alias("_label"))

    def features(blocks: Iterator[list[list]]) -> Iterator[list[list]]:
        for ids, texts in blocks:
            yield [ids, [text_features(t) for t in texts]]

    made = map_rows(docs.where(key.isNotNull()), [key.alias("_id"), whole_text(text_column)], features, "_id long,x array<double>")
    known = written(made.join(told, "_id").select("_id", "_label", *[F.get("x", F.lit(i)).alias(f"x{i}") for i in range(width)]))
    xs = [f"x{i}" for i in range(width)]
    total = known.agg(F.count("*").alias("n"), F.sum("_label").alias("good"), *[F.avg(c).alias(f"m_{c}") for c in xs], *[F.stddev_pop(c).alias(f"s_{c}") for c in xs]).first()
    n, good = total["n"], total["good"] or 0
    if not 0 < good < n:
        return without_a_label(width, good > 0, accept)
    # Rounded, as sums in another order differ in their last digits.
    mean, spread = ([round(total[f"{k}_{c}"], 10) for c in xs] for k in "ms")
    spread = [v + 1e-6 for v in spread]

    def learn(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["_id", *xs])
        y = f["_label"].to_numpy()
        if y.min() == y.max():
            return pd.DataFrame({"n": [], "w": []})
        return pd.DataFrame({"n": [len(f)], "w": [pair_weights((f[xs].to_numpy(float) - mean) / spread, y).tolist()]})

    blocks = -(-n // block)
    learned = known.groupBy(F.pmod(F.xxhash64("_id"), F.lit(blocks)).alias("_block")).applyInPandas(learn, "n long, w array<double>").collect()
    size = sum(r["n"] for r in learned)
    if not size:
        return without_a_label(width, True, accept)
    weights = [round(math.fsum(r["n"] * r["w"][i] for r in learned) / size, 10) for i in range(width)]
    s = sum((F.col(c) - m) / v * w for c, m, v, w in zip(xs, mean, spread, weights, strict=True))
    ranks = known.select(F.round(s, 10).alias("s"))
    cut = _gap_middle(ranks, min(n - 1, n - good), n)
    sd = ranks.agg(F.stddev_pop("s")).first()[0]
    return QualityModel(tuple(mean), tuple(spread), tuple(weights), cut, 4 / max(1e-6, round(sd, 10)), accept)


def _gap_middle(ranks: DataFrame, k: int, n: int, few: int = 10_000, bins: int = 1000) -> float:
    """The middle of the ``k``-th and the next smallest of all ``n`` values of ``s``, by ever narrower histograms."""
    low, high = ranks.agg(F.min("s"), F.max("s")).first()
    below, inside = 0, n
    while inside > few and high > low:
        step = (high - low) / bins
        at = F.least(F.floor((F.col("s") - low) / step), F.lit(bins - 1))
        part = ranks.where(F.col("s").between(low, high)).groupBy(at.alias("b")).agg(F.count("*").alias("n"), F.min("s").alias("a"), F.max("s").alias("z")).orderBy("b").collect()
        seen, held = below, []
        for r in part:
            if seen < k + 1 and seen + r["n"] >= k:
                held.append((seen, r))
            seen += r["n"]
        narrower = held[0][1]["a"], held[-1][1]["z"]
        if narrower == (low, high):
            break
        low, high = narrower
        below, inside = held[0][0], sum(r["n"] for _, r in held)
    seen, found = below, []
    for r in ranks.where(F.col("s").between(low, high)).groupBy("s").count().orderBy("s").collect():
        found += [r["s"] for rank in (k, k + 1) if seen < rank <= seen + r["count"]]
        seen += r["count"]
    return sum(found) / 2


def labelled_texts(
    docs: DataFrame, labels: DataFrame, label: str, train, bound: int, id_column: str = "doc_id", text_column: str = "text"
) -> tuple[list[bytes], np.ndarray]:
    """At most ``bound`` labelled texts for training, chosen by a hash of the id.

    ``train``: a condition on the id column. Labels other than 0 and 1, null
    ids and null labels are left out; of a repeated id the largest label counts.
    """
    key = F.col(id_column).cast("long")
    told = labels.where(key.isNotNull() & F.col(label).isin(0, 1)).where(train).select(key.alias("_id"), F.col(label).alias("_label"))
    least = -(-(1 << 40) * bound // max(1, told.count()))
    mark = F.pmod(F.xxhash64("_id"), F.lit(1 << 40))
    chosen = told.where(mark < least).groupBy("_id").agg(F.max("_label").alias("_label"))
    # About ``bound`` rows are broadcast and collected, however many are labelled.
    rows = docs.select(key.alias("_id"), whole_text(text_column)).join(F.broadcast(chosen), "_id").withColumn("_mark", mark).collect()
    rows = sorted(rows, key=lambda r: (r["_mark"], bytes(r["text"])))[:bound]
    return [bytes(r["text"]) for r in rows], np.array([r["_label"] for r in rows], int)


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    train,
    label: str = "quality",
    block: int = 4000,
    accept: float = 0.7,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Score every whole text. Returns ``doc_id, score, predicted`` (1 from ``accept`` on).

    Trained on all labelled documents for which ``train`` holds, in blocks of some ``block``;
    only features of the text enter. Null and empty texts have features of
    zero and are scored by them. A null id is kept. Repeated rows are scored
    each. An empty table gives an empty result. Other columns play no part.
    """
    model = fit_quality(docs, labels, train, label, block, accept, id_column, text_column)

    def run(blocks: Iterator[list[list]]) -> Iterator[list[list]]:
        for keys, texts in blocks:
            score = model.score(np.array([text_features(t) for t in texts]))
            yield [keys, score.tolist(), (score >= accept).astype(int).tolist()]

    columns = [F.col(id_column).cast("long").alias("doc_id"), whole_text(text_column)]
    return map_rows(docs, columns, run, "doc_id long,score double,predicted int")


def accepted_documents(docs: DataFrame, labels: DataFrame, train, label: str = "quality", block: int = 4000, accept: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose text scores ``accept`` or more, all columns as they are."""
    model = fit_quality(docs, labels, train, label, block, accept)

    def keep(texts: list[bytes]) -> list[bool]:
        return (model.score(np.array([text_features(t) for t in texts])) >= accept).tolist()

    return keep_rows(docs, "text", keep)
