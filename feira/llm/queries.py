"""The registered queries: each operator over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feira.llm import (
    chat_format, chosen_path, jaccard_join, langid, mixing, quality_bands, spelling, suffix_dedup, topk, toxicity, unigram, warc, whitening,
)
from feira.llm.oracles import oracle_sql  # noqa: F401

TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
PIECE_MODEL = "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fold(column: str, folds: int) -> Column:
    """crc32 of the id as text (null: empty), modulo ``folds``."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"), jaccard_join.Threshold(k=3, num=90, den=100))


def op1_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_counts(table(spark, sf_dir, "documents"), jaccard_join.Threshold(k=3, num=90, den=100))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.range(1).select(F.explode(F.array(
        F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit(said).alias("text")),
        F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(1).cast("long").alias("turn"), F.lit("assistant").alias("role"), F.lit(said).alias("text")),
    )).alias("r")).select("r.*")
    chats = chat_format.format_chats(turns.unionByName(more))
    return chat_format.digests(chat_format.read_back(chats))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64.0)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), train_on=fold("doc_id", 5) != 0)
    found = toxicity.score(docs, model)
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted", "abuse", "misspelled", "quoted")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=400, with_text=True)


def op6_quality_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_bands.quality_bands(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs, train_on=fold("doc_id", 3) != 1)
    found = langid.identify(docs, model, {"doc_id": "doc_id"})
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "cosine", "rejected")


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_total").alias("source_size"), F.col("mix_target").alias("target"),
        (F.col("mix_copies") * F.col("mix_size")).alias("taken"), F.col("mix_copies").alias("copies"), F.col("mix_copy_shards").alias("shards"),
    )


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_warc(table(spark, sf_dir, "pages"))
    records = warc.read_warc(spark, manifest, with_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = unigram.load_vocabulary(os.path.join(TOKENIZER_DIR, PIECE_MODEL))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    tokens = unigram.encode(docs, v, {"doc_id": "doc_id", "text": "text"})
    both = unigram.decode(tokens, v, {"doc_id": "doc_id", "text": "text", "ids": "ids"})
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"),
    )


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(table(spark, sf_dir, "documents"), jaccard_join.Threshold(k=4, num=80, den=100))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard_join": op1_jaccard_join,
    "op1_jaccard_links": op1_jaccard_links,
    "op2_chat_format": op2_chat_format,
    "op3_exact_topk": op3_exact_topk,
    "op4_toxicity": op4_toxicity,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_quality_bands": op6_quality_bands,
    "op7_language_id": op7_language_id,
    "op8_mix_sources": op8_mix_sources,
    "op9_warc": op9_warc,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_whitening": op12_whitening,
    "op13_chosen_path": op13_chosen_path,
}

