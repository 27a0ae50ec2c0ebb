"""The registered queries of this folder and the SQL that checks them where SQL can."""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlens.llm import chat, hashtree, idfile, packing, pii, repair, simjoin, spm, spotsigs, stable, topk, toxicity, whitening
from wardlens.llm.common import ship, table

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    asked = docs.where(F.col("doc_id") % 50 == 0).select(F.col("doc_id").alias("query_id"), "text")
    return topk.top_k(docs, asked)


def op2_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.round_trip(table(spark, sf_dir, "documents"), PIECES)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_spans(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), VOCABULARY)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op7_idfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idfile.round_trip(table(spark, sf_dir, "documents"), VOCABULARY)


def op8_hashtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashtree.shard_documents(table(spark, sf_dir, "documents"))


def op9_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprints(table(spark, sf_dir, "documents"))


def op10_simjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simjoin.jaccard_classes(table(spark, sf_dir, "documents"), width=3, num=90, den=100).drop("cls", "root")


def op11_stable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stable.near_vectors(table(spark, sf_dir, "embeddings"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(table(spark, sf_dir, "conversations"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def _shipped(query):
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)
    return run


QUERIES = {f.__name__: _shipped(f) for f in (op1_topk, op2_merge_dropout, op3_pii, op4_packing, op5_toxicity, op6_chat, op7_idfile, op8_hashtree, op9_spotsigs, op10_simjoin,
                                                op11_stable, op12_repair, op13_whitening)}
ORACLE = {"op1_topk": topk.ORACLE, "op6_chat": chat.ORACLE}
