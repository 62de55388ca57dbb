"""Quality and toxicity: held-out accuracy, and defined results for odd tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from turbula.llm import queries, quality_bt, toxicity_mil

SF = "/root/testdata/sf0.1"
ODD = [(None, "one text"), (-1, None), (-2, ""), (-3, "word " * 60_000), (-3, "é\u0000 x")]


# Of the toxic documents about one in twenty holds no word that others of them share.
@pytest.mark.parametrize("query,label,least", [(queries.op6_quality, "quality", 0.9), (queries.op8_toxicity, "toxic", 0.82)])
def test_held_out_accuracy(spark, query, label, least):
    known = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", label)
    got = query(spark, SF).join(known, "doc_id").where(F.col("held_out") & F.col(label).isNotNull()).toPandas()
    assert len(got) > 50 and got["score"].between(0, 1).all() and ((got["score"] >= 0.7) == (got["predicted"] == 1)).all()
    hit = {y: (got["predicted"][got[label] == y] == y).mean() for y in (0, 1)}
    assert min(hit.values()) >= least, hit


@pytest.mark.parametrize("score,label", [(quality_bt.score_quality, "quality"), (toxicity_mil.score_toxicity, "toxic")])
def test_odd_rows(spark, make_docs, texts, labels, score, label):
    rows = ODD + list(texts.items())
    df = make_docs(rows)
    got = score(df, labels, train=F.lit(True)).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in got)
    blank = [r["score"] for r in got if r["doc_id"] in (-1, -2)]
    assert blank[0] == blank[1]
    assert score(df.where("doc_id > 1000000000"), labels, train=F.lit(True)).count() == 0
    none = labels.where("doc_id < 0")
    assert score(df, none, train=F.lit(True)).count() == len(rows)


def test_labels_of_held_out_rows_do_not_matter(spark, documents, labels):
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2
    other = labels.withColumn("quality", F.when(train, F.col("quality")).otherwise(1 - F.col("quality")))
    a, b = (sorted(map(tuple, quality_bt.score_quality(documents, x, train=train).collect())) for x in (labels, other))
    assert a == b


def test_pairs_rank_by_the_feature_that_tells():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, len(quality_bt.FEATURES)))
    y = (x[:, 2] > 0.3).astype(int)
    model = quality_bt.fit_pairs(x, y)
    assert ((model.score(x) >= 0.7) == (y == 1)).mean() > 0.95


def test_offending_sentences_are_located():
    rng = np.random.default_rng(2)
    words = [f"word{i}" for i in range(60)]
    texts, labels = [], []
    for i in range(400):
        s = [" ".join(rng.choice(words, 6)) for _ in range(5)]
        if i % 4 == 0:
            s[int(rng.integers(5))] += " vile"
        texts.append((". ".join(s) + ".").encode())
        labels.append(int(i % 4 == 0))
    model = toxicity_mil.fit_bags(texts, np.array(labels))
    for t, y in zip(texts, labels, strict=True):
        p, found = model.document(t)
        assert (p >= 0.7) == bool(y)
        for a, b, q in found:
            if q >= 0.5:
                assert b"vile" in t[a:b]


def test_noisy_or():
    model = toxicity_mil.ToxicityModel({b"bad": 8.0}, -9.0)
    p, found = model.document(b"bad day. bad day")
    one = found[0][2]
    assert p == pytest.approx(1 - (1 - one) ** 2, rel=1e-6)
    assert model.document(b"good day")[0] == pytest.approx(1 / (1 + np.exp(9.0)), rel=1e-6)


def test_all_labelled_documents_train_the_quality_model(spark, make_docs):
    """With many blocks the cut is the quantile of all training scores, and no label can change without effect."""
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(rng.choice(["aa", "bbb", "cccc"], 30)) + "!" * int(rng.integers(0, 9)) + "." * int(rng.integers(0, 5))) for i in range(600)]
    docs = make_docs(rows).repartition(3)
    marks = [(i, int(t.count("!") < 4)) for i, t in rows]
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    model = quality_bt.fit_quality(docs, labels, F.lit(True), block=50)
    x, y = np.array([quality_bt.text_features(t.encode()) for _, t in rows]), np.array([m for _, m in marks])
    np.testing.assert_allclose(model.mean, x.mean(0), atol=1e-9)
    s, k = np.sort(model.rank(x)), int((y == 0).sum())
    assert model.cut == pytest.approx((s[k - 1] + s[k]) / 2, abs=1e-8)
    assert ((model.score(x) >= 0.7) == (y == 1)).mean() > 0.95
    ranks = spark.createDataFrame([(float(v),) for v in s], "s double")
    assert quality_bt._gap_middle(ranks, k, len(s), few=5, bins=7) == pytest.approx((s[k - 1] + s[k]) / 2, abs=1e-12)
