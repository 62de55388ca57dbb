"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence is toxic with probability
sigmoid(bias + weights of its words and word beginnings); a document is toxic if
any sentence is, by noisy-or: P = 1 - product of (1 - p). Sentences without a
feature say nothing, however many they are: together they count as one, with the
probability of the bias. Only documents have labels, and the loss is theirs; the
learned sentence probabilities then locate the offending sentences.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turbula.llm.quality_bt import labelled_texts
from turbula.llm.rows import keep_rows, map_rows, whole_text

_SENTENCES = re.compile(rb"[^.!?\n]+").finditer
#: What a sentence has that is not empty.
_FILLED = re.compile(rb"[^.!?\s]").search
_WORD = rb"[A-Za-z\x80-\xff]+"
_WORDS = re.compile(_WORD).findall
#: Lengths, in bytes, of the word beginnings that are features.
BEGINNINGS = (4, 5, 6)
_CAPITALS = re.compile(rb"\xc3[\x80-\x9e]")


def lowered(text: bytes) -> bytes:
    """A-Z and the accented capitals of Western Europe in lower case; every byte keeps its place."""
    low = text.lower()
    return _CAPITALS.sub(lambda m: bytes((0xC3, m[0][1] + 0x20)), low) if b"\xc3" in low else low


def _features(words: set[bytes]) -> set[bytes]:
    """Words as they are, and the beginnings of longer ones with a mark."""
    return words | {w[:k] + b"*" for w in words for k in BEGINNINGS if len(w) > k}


class ToxicityModel:
    """Weights by feature, and the bias of a sentence."""

    def __init__(self, weights: dict[bytes, float], bias: float):
        self.weights, self.bias = weights, bias
        starts: list[bytes] = []
        for f in sorted({f.rstrip(b"*") for f in weights}):  # a beginning comes before what it begins
            if not starts or not f.startswith(starts[-1]):
                starts.append(f)
        # Words that can carry a feature: those that begin with one.
        self.find = re.compile(b"(?<![A-Za-z\x80-\xff])(?:" + b"|".join(map(re.escape, starts)) + b")[A-Za-z\x80-\xff]*").finditer if starts else None
        self.starts = starts

    def sentence(self, words: set[bytes]) -> float:
        z = self.bias + sum(self.weights.get(f, 0.0) for f in _features(words))
        return 1 / (1 + np.exp(-min(max(z, -500.0), 500.0)))

    def sentences(self, text: bytes) -> tuple[list[tuple[int, int, float]], bool]:
        """Byte spans and probabilities of the sentences with features, and whether any other is not empty."""
        low = lowered(text)
        hits = [(m.start(), m[0]) for m in self.find(low)] if self.find and any(s in low for s in self.starts) else []
        if not hits:
            return [], bool(_FILLED(low))
        found, i, plain = [], 0, False
        for m in _SENTENCES(low):
            words = set()
            while i < len(hits) and hits[i][0] < m.end():
                words.add(hits[i][1])
                i += 1
            if any(f in self.weights for f in _features(words)):
                found.append((*m.span(), float(self.sentence(words))))
            else:
                plain = plain or bool(_FILLED(m[0]))
        return found, plain

    def document(self, text: bytes) -> tuple[float, list[tuple[int, int, float]]]:
        """The noisy-or of a text and its sentences with features."""
        found, plain = self.sentences(text)
        calm = int(plain) * np.log1p(-1 / (1 + np.exp(-self.bias))) + sum(np.log1p(-min(p, 1 - 1e-12)) for *_, p in found)
        return float(abs(np.expm1(calm))), found


def fit_bags(
    texts: list[bytes], labels: np.ndarray, most: int = 4000, least_documents: int = 3, least_z: float = 5.0, rounds: int = 300
) -> ToxicityModel:
    """Learn from whole documents with labels 0 or 1.

    Features are those whose share among toxic documents exceeds that among the
    others by ``least_z`` standard errors, at most ``most`` of them. Without both
    labels there are none, and every document scores near 0.
    """
    n1, n0 = int((labels == 1).sum()), int((labels == 0).sum())
    if not n1 or not n0:
        return ToxicityModel({}, -20.0)
    # Texts are read again in each pass; only features that can still count are kept.
    toxic, other = Counter(), Counter()
    for text, y in zip(texts, labels, strict=True):
        if y == 1:
            toxic.update(_features(set(_WORDS(lowered(text)))))
    toxic = {f: a for f, a in toxic.items() if a >= least_documents}
    for text, y in zip(texts, labels, strict=True):
        if y == 0:
            other.update(f for f in _features(set(_WORDS(lowered(text)))) if f in toxic)
    z = {}
    for f, a in toxic.items():
        share = (a + other[f]) / (n1 + n0)
        z[f] = (a / n1 - other[f] / n0) / np.sqrt(max(share * (1 - share), 1e-9) * (1 / n1 + 1 / n0))
    names = [f for f, v in sorted(z.items(), key=lambda x: (-x[1], x[0])) if v >= least_z][:most]
    number = {f: i for i, f in enumerate(names)}
    sentence, feature, owner, count = [], [], [], 0
    for d, text in enumerate(texts):
        plain = False
        for m in _SENTENCES(lowered(text)):
            found = [number[f] for f in _features(set(_WORDS(m[0]))) if f in number]
            if not found:
                if plain or not _FILLED(m[0]):
                    continue
                plain = True
            sentence += [count] * len(found)
            feature += found
            owner.append(d)
            count += 1
    owner, sentence, feature = np.array(owner, int), np.array(sentence, int), np.array(feature, int)
    y = (labels == 1).astype(float)
    weights, bias = np.full(len(names), 0.5), -6.0
    v, vb = np.zeros(len(names)), 0.0
    g2, gb2 = np.full(len(names), 1e-8), 1e-8
    for _ in range(rounds):
        s = bias + np.bincount(sentence, weights[feature], count)
        p = 1 / (1 + np.exp(-np.clip(s, -30, 30)))
        calm = np.bincount(owner, np.log1p(-np.minimum(p, 1 - 1e-9)), len(texts))
        toxic = np.clip(-np.expm1(calm), 1e-9, 1 - 1e-9)
        # d log-likelihood / d s of a sentence: p * (y / P - 1), of its document's P.
        pull = p * (y / toxic - 1)[owner]
        gradient = np.bincount(feature, pull[sentence], len(names)) - 1e-2 * weights
        v, g2 = 0.9 * v + 0.1 * gradient, 0.99 * g2 + 0.01 * gradient**2
        vb, gb2 = 0.9 * vb + 0.1 * pull.sum(), 0.99 * gb2 + 0.01 * pull.sum() ** 2
        weights += 0.1 * v / np.sqrt(g2)
        bias = min(-9.0, bias + 0.1 * vb / np.sqrt(gb2))
    return ToxicityModel({f: float(weights[i]) for f, i in number.items() if weights[i] > 0.05}, float(bias))


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    train,
    label: str = "toxic",
    bound: int = 6000,
    reject: float = 0.7,
    id_column: str = "doc_id",
    text_column: str = "text",
    with_sentences: bool = False,
) -> DataFrame:
    """Score every whole text. Returns ``doc_id, score, predicted`` (1 from ``reject`` on).

    With ``with_sentences`` also ``sentences``, ``start:end:probability`` of each
    sentence that is toxic rather than not, in code points, comma-joined.
    Trained on at most ``bound`` labelled documents for which ``train`` holds;
    only the text enters. Null and empty texts score near 0. A null id is kept.
    Repeated rows are scored each. An empty table gives an empty result. Other
    columns play no part.
    """
    model = fit_bags(*labelled_texts(docs, labels, label, train, bound, id_column, text_column))

    def run(blocks: Iterator[list[list]]) -> Iterator[list[list]]:
        for keys, texts in blocks:
            both = [model.document(t) for t in texts]
            out = [keys, [p for p, _ in both], [int(p >= reject) for p, _ in both]]
            if with_sentences:
                out.append([
                    ",".join(f"{len(t[:a].decode())}:{len(t[:b].decode())}:{p:.4f}" for a, b, p in found if p >= 0.5)
                    for t, (_, found) in zip(texts, both, strict=True)
                ])
            yield out

    columns = [F.col(id_column).cast("long").alias("doc_id"), whole_text(text_column)]
    return map_rows(docs, columns, run, "doc_id long,score double,predicted int" + ",sentences string" * with_sentences)


def accepted_documents(docs: DataFrame, labels: DataFrame, train, label: str = "toxic", bound: int = 6000, reject: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose text scores less than ``reject``, all columns as they are."""
    model = fit_bags(*labelled_texts(docs, labels, label, train, bound))
    return keep_rows(docs, "text", lambda texts: [model.document(t)[0] < reject for t in texts])
