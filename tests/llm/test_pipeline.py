"""The stages of the pipeline against what each decides row by row."""

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.test_jaccard import components
from tests.llm.test_scans import fixed_spans
from turbula.llm import queries, toxicity_mil

SF = "/root/testdata/sf0.001"


def test_stages(spark, documents, labels):
    docs, columns = documents, documents.columns
    by_quality = {r["doc_id"]: r["predicted"] for r in queries.op6_quality(spark, SF).collect()}
    kept = corpus_pipeline.quality(spark, docs, SF)
    assert kept.columns == columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, p in by_quality.items() if p == 1)
    calm = corpus_pipeline.toxicity(spark, kept, SF)
    scored = toxicity_mil.score_toxicity(kept, labels, train=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    assert sorted(r["doc_id"] for r in calm.collect()) == sorted(r["doc_id"] for r in scored.collect() if r["predicted"] == 0)
    single = corpus_pipeline.near_duplicates(spark, calm, SF)
    want = components([(r["doc_id"], r["text"]) for r in calm.collect()], 5, 80)
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(i for i, _, c in want if i == c)
    clean = corpus_pipeline.secrets(spark, single, SF)
    assert clean.columns == columns and clean.count() == single.count()
    assert not any(fixed_spans(r["text"] or "") for r in clean.collect())
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sizes = {r["doc_id"]: len(library.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in clean.collect()}
    packed = corpus_pipeline.packing(spark, clean, SF).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert {r["doc_id"]: r["n"] for r in packed} == sizes == {r["doc_id"]: r["m"] for r in packed}
    assert corpus_pipeline.run(spark, SF).select("doc_id").distinct().count() == len(sizes)


def test_clean_documents_stay(spark, documents, labels):
    good = labels.where("quality = 1 and toxic = 0").select("doc_id")
    kept = corpus_pipeline.toxicity(spark, corpus_pipeline.quality(spark, documents, SF), SF)
    assert kept.join(good, "doc_id").count() >= 0.9 * documents.join(good, "doc_id").count()


def test_odd_rows(spark, make_docs):
    rows = [(None, "a b c"), (1, None), (2, ""), (3, "Some text that says little. " * 3000), (3, "x"), (4, "Some text that says little. " * 3000)]
    docs = make_docs(rows)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs_out = stage(spark, docs, SF)
        assert docs_out.columns == docs.columns and docs_out.count() <= len(rows)
        assert stage(spark, docs.where("n < 0"), SF).count() == 0
    assert corpus_pipeline.packing(spark, docs, SF).agg(F.countDistinct("doc_id")).first()[0] == 4
