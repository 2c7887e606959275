"""A corpus, from documents to packed sequences.

Documents that the learned quality rules reject go, then those whose language cannot be told; one
document of each group of near copies (five-word Jaccard 0.8) stays; secrets in what is left are masked; the rest is
tokenized and packed. Every stage works on all that its predecessor kept. A stage's result is read from the
tables that it stored, so stages can be composed without writing in between; run() writes each one's rows and
only then deletes its tables.

Defined cases: a null or empty text has no words and goes at the first stage; a null lang, source or
n_chars stays as it is; rows with a null doc_id are judged like others; repeated rows are copies; an empty
table passes every stage empty; without usable labels only the base rules reject, and without a known
language every document goes.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from scoreloom.llm import common, decision_list, naive_bayes_lang, near_copies, randomness_secrets, residual_packing


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decision_list.keep_good(docs, common.table(spark, sf_dir, "labels"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return naive_bayes_lang.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.keep_one_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return randomness_secrets.mask(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return residual_packing.op8(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality),
    ("language identification", language),
    ("near-duplicates", near_duplicates),
    ("secret masking", secrets),
    ("sequence packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = common.table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        made: list[DataFrame] = []
        with common.recorded(made):
            docs = stage(spark, docs, sf_dir)
        docs = common.store(docs, f"stage-{k}")
        common.discard_all(made)
        if before is not None:
            common.discard(before)
        before = docs
    return docs


#: SQL has no learned rules, Bayes model, XXH64 or BPE; tests/llm compares run() with plain Python.
ORACLE_SQL = None
