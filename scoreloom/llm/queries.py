"""The queries of this subpackage and, where SQL can say the same, their SQL; common.clean() deletes what one stored."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from scoreloom.llm import brown_lm, common, cover_tree, decision_list, merkle_manifest, naive_bayes_lang, norm_buckets, pair_index_bpe, perspective_chat, prefix_trie, randomness_secrets, residual_packing, simhash_bktree, zstd_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            made: list[DataFrame] = []
            with common.recorded(made):
                out = f(spark, sf_dir)
            out._working = made
            return out

        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


@query("op1_brown_classes")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_lm.op1(common.table(spark, sf_dir, "documents"))


@query("op2_decision_list")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decision_list.op2(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


@query("op3_naive_bayes_lang")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naive_bayes_lang.op3(common.table(spark, sf_dir, "documents"))


@query("op4_zstd_toxicity")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zstd_toxicity.op4(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


@query("op5_randomness_secrets")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return randomness_secrets.op5(common.table(spark, sf_dir, "documents"))


@query("op6_perspective_rotation", perspective_chat.ORACLE)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspective_chat.rotate(common.table(spark, sf_dir, "conversations"))


@query("op7_norm_buckets", norm_buckets.ORACLE)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return norm_buckets.top_k(common.table(spark, sf_dir, "embeddings"))


@query("op8_best_fit_packing")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residual_packing.op8(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op9_pair_index_bpe")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_index_bpe.op9(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op10_simhash_bktree")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_bktree.op10(common.table(spark, sf_dir, "documents"))


@query("op11_prefix_trie", prefix_trie.ORACLE)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.op11(common.table(spark, sf_dir, "conversations"))


@query("op12_cover_tree", cover_tree.ORACLE)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.op12(common.table(spark, sf_dir, "embeddings"))


@query("op13_merkle_manifest", merkle_manifest.ORACLE)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.op13(common.table(spark, sf_dir, "documents"))
