"""The registered queries of the operators for training data, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilcheck.llm import chat, decontaminate, host_quality, language_model, lexical, licences, merkle, near_dup, packing, personal_data, sharding, token_counts, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with each benchmark item that it holds."""
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    return host_quality.judge(_table(spark, sf_dir, "documents")).drop("host_rate")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader finds in every formatted conversation, and in one that consists of control strings."""
    conv_id, text = chat.HOSTILE
    hostile = spark.createDataFrame([(conv_id, 0, "user", text), (conv_id, 1, chat.ASSISTANT, text)], "conv_id long, turn long, role string, text string")
    conversations = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(hostile)
    vocabulary = chat.read_ranks(spark)
    return chat.digests(chat.format_chats(conversations, vocabulary), vocabulary)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document in its bin."""
    return packing.pack_sequences(_table(spark, sf_dir, "documents"))


def op5_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with each licence rule that it holds."""
    return licences.scan_licences(_table(spark, sf_dir, "documents"))


def op6_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's URL."""
    pages = _table(spark, sf_dir, "pages")
    return url_filter.judge_urls(pages, url_filter.labelled_urls(pages))


def op8_range_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    return sharding.shard_by_bytes(_table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy word pieces of every document."""
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"))


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model score of every document."""
    return language_model.scores(_table(spark, sf_dir, "documents"))


def op11_dual_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best documents of every benchmark item."""
    return lexical.search_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document, plain and disguised."""
    return personal_data.find_personal_data(_table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proof of every document, and the root that its version has."""
    return merkle.manifest(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontamination, op2_host_quality, op3_chat_format, op4_best_fit_packing, op5_licence_scan,
        op6_simhash_components, op7_url_filter, op8_range_sharding, op9_token_counts, op10_lm_scores, op11_dual_tree_search,
        op12_personal_data, op13_merkle_manifest,
    )
}

SQL = {"op2_host_quality": host_quality.SQL, "op3_chat_format": chat.SQL, "op5_licence_scan": licences.SQL, "op8_range_sharding": sharding.SQL, "op11_dual_tree_search": lexical.SQL, "op13_merkle_manifest": merkle.SQL}
