"""The registered queries of the corpus operators: production parameters, whole tables, full results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gondola.llm import chosenpath, collocations, decontaminate, digest, hamerly, langid, linkgraph, mixing, mixlm, quality, rules, toxicity, warc
from gondola.llm.common import table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, folder = warc.write_warc(table(spark, sf_dir, "pages"))
    return warc.read_warc(index, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixlm.score(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.fingerprints(table(spark, sf_dir, "documents"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkgraph.judge(table(spark, sf_dir, "pages"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosenpath.links(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamerly.cluster(table(spark, sf_dir, "embeddings"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_warc, op2_lm_score, op3_language_id, op4_quality, op5_decontamination, op6_fingerprints, op7_url_filters, op8_mixing, op9_toxicity, op10_jaccard_join, op11_collocations, op12_clusters, op13_quality_rules)}
ORACLE_SQL = {"op1_warc": warc.ORACLE_SQL, "op8_mixing": mixing.ORACLE_SQL, "op11_collocations": collocations.ORACLE_SQL, "op12_clusters": hamerly.ORACLE_SQL, "op13_quality_rules": rules.ORACLE_SQL}
