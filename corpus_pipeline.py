"""Stages that turn raw documents into packed training sequences.

Each stage works on all that its predecessor kept and returns the columns of ``documents``, but for the last, which
returns the packed bins. Between stages the rows are written as Parquet into the cluster's shared folder and read again;
what a stage has written for itself, and what the stage before it kept, is deleted once its own rows are written.

Defined results, stage by stage, of a row
                  quality_rules   quality_classifier       minhash_near_dedup         decontamination   best_fit_packing
  null doc_id     judged          judged                   stays                      judged            packed, its id null
  null text       goes            by the priors            stays                      stays             in no bin
  empty text      goes            by the priors            stays                      stays             in no bin
  very long text  judged whole    judged whole             compared whole             searched whole    cut into full bins and a rest
  tie             0.5 stays       quality stays, toxic     the least doc_id stays     half of an        the least doc_id goes first
                                  goes                                                item's windows
                                                                                      is a leak
  repeated row    each judged     each judged              one stays                  each judged       each packed
  no row          no row          no row                   no row                     no row            no bin
  more columns    kept, whatever  kept                     kept                       kept              not read
                  their names
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brindle.llm import classifier, decontam, neardup, packing, rules
from brindle.plans.scratch import hand_on, materialize, remove, scope


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior quality probability under the rules' votes is high enough."""
    return rules.keep(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of good quality that aren't toxic, by a model of the labelled ones among them."""
    return classifier.classify(docs, classifier.fit(docs, _table(spark, sf_dir, "labels")))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return neardup.deduplicate(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontam.decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of a fixed length."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]
#: SQL expresses neither a trained model nor sketches.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, one after the other."""
    docs = _table(spark, sf_dir, "documents")
    with scope(spark) as kept:
        for name, stage in STAGES:
            with scope(spark) as made:
                docs = materialize(stage(spark, docs, sf_dir), name)
                hand_on(made, 1)
            for path in kept[:-1]:
                remove(spark, path)
            del kept[:-1]
        hand_on(kept, 1)
    return docs
