"""The queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turbula.llm import (
    ann_scan,
    bpe_index,
    html_mincut,
    jaccard_groups,
    license_scan,
    packing_dp,
    quality_bt,
    secret_grammar,
    toxicity_mil,
    vector_pq,
)
from turbula.llm.rows import table


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe_index.encode_texts(table(spark, sf_dir, "documents"), path, digests=True)


def _fold(folds: int):
    """The fold of an id: crc32 of its text modulo ``folds``; -1 of a null id, which no fold holds."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds, F.lit(-1))


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_mincut.extract_main_text(table(spark, sf_dir, "pages"))


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_scan.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups.jaccard_components(table(spark, sf_dir, "documents"), width=3, percent=90)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = quality_bt.score_quality(docs, labels, train=_fold(4) != 2)
    return scored.select("doc_id", (_fold(4) == 2).alias("held_out"), "score", "predicted")


def op7_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_pq.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity_mil.score_toxicity(docs, labels, train=_fold(3) != 1, with_sentences=True)
    return scored.select("doc_id", (_fold(3) == 1).alias("held_out"), "score", "predicted", "sentences")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing_dp.pack_documents(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.PATTERN,
    )


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_grammar.scan_secrets(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_html": op1_html,
    "op2_neighbours": op2_neighbours,
    "op3_license": op3_license,
    "op4_bpe": op4_bpe,
    "op5_jaccard": op5_jaccard,
    "op6_quality": op6_quality,
    "op7_vectors": op7_vectors,
    "op8_toxicity": op8_toxicity,
    "op9_packing": op9_packing,
    "op10_secrets": op10_secrets,
}

#: DuckDB SQL, where SQL can express a query.
ORACLES: dict[str, str] = {}
