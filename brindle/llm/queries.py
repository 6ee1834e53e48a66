"""The subpackage's queries over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import archive, classifier, decontam, extraction, neardup, packing, rules, sharding, tokenfile, tokens
from brindle.plans.scratch import new_path

SMALL_SHARD = 64 << 10


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the documents that the classifier keeps; fitted on labelled documents, applied to all."""
    docs = _table(spark, sf_dir, "documents")
    scores = classifier.score(docs, classifier.fit(docs, _table(spark, sf_dir, "labels")))
    return scores.where("keep").drop("keep")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bins of all documents."""
    return packing.pack(_table(spark, sf_dir, "documents"))


def op3_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token table of all documents, written and read again with its metadata."""
    path = new_path(spark, "tokens")
    tokenfile.write_tokens(_table(spark, sf_dir, "documents"), path, metadata=("lang", "source"), encoding="delta")
    return spark.read.parquet(path)


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold which items of the benchmark."""
    return decontam.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document, and its number of links."""
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document, as read from the written shards."""
    docs, path = _table(spark, sf_dir, "documents"), new_path(spark, "shards")
    sharding.write_shards(docs, path)
    made = sharding.read_shards(spark, path, docs.schema)
    return made.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), "shard", "depth")


def sharding_small_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of so few bytes that buckets split at every size of the tables."""
    return sharding.assign(_table(spark, sf_dir, "documents"), limit=SMALL_SHARD)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the rules keep, with their posterior probability of good quality."""
    return rules.kept(_table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of tokens of every document."""
    return tokens.token_counts(_table(spark, sf_dir, "documents"))


def op9_archive_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written as packages and read back by byte ranges."""
    made = archive.write_packages(_table(spark, sf_dir, "pages"), new_path(spark, "archives"))
    return archive.pages(archive.read_packages(made))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages, by their hosts' winning paths."""
    return extraction.extract_pages(_table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_quality_classifier, op2_best_fit_packing, op3_token_id_output, op4_benchmark_decontamination, op5_minhash_near_dedup, op6_sharding, op7_quality_rules, op8_token_counts, op9_archive_reader, op10_html_extraction)
    return {f.__name__: f for f in (*own, sharding_small_shards)}


def oracle_sql() -> dict[str, str]:
    return {"op6_sharding": sharding.sql(), "sharding_small_shards": sharding.sql(limit=SMALL_SHARD), "op7_quality_rules": rules.sql(), "op9_archive_reader": "SELECT page_id, url, html FROM pages"}
