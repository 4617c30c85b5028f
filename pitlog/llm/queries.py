"""Named queries of the corpus operators over the driver tables, and their checks in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from pitlog.llm import (
    clustering,
    decontaminate,
    jaccard_join,
    licenses,
    mixing,
    pii,
    quality_rules,
    resampling,
    secrets,
    token_counts,
    toxicity,
    url_filter,
    warc,
)
from pitlog.llm.common import keep
from pitlog.llm.sql import ORACLES as _SQL

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "text")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_texts(spark, sf_dir)).select("doc_id", "n_tokens")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(_texts(spark, sf_dir), _table(spark, sf_dir, "benchmark"))
    c = F.col("contamination")
    return found.select(
        "doc_id",
        c["n_words"].alias("n_words"),
        c["n_hit"].alias("n_hit"),
        F.size(c["items"]).cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", c["items"]).cast("binary"), 256).alias("items_sha256"),
        decontaminate.contaminated(c).alias("contaminated"),
    )


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = keep(pii.candidates(_texts(spark, sf_dir), beside=["doc_id"]), "pii-candidates", few=True)
    found = pii.judge(seen, pii.learn(seen))
    return found.select("doc_id", *[c.alias(n) for n, c in pii.as_digest("pii").items()])


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _texts(spark, sf_dir)
    rules = quality_rules.learn(docs, _table(spark, sf_dir, "labels"))
    found = quality_rules.judge(docs, rules)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return found.select(
        "doc_id",
        *[F.col("quality.stats")[n].alias(n) for n in names],
        F.col("quality.base_failed").alias("base_failed"),
        F.col("quality.rule").alias("rule"),
        F.col("quality.kept").alias("kept"),
    )


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages).select("page_id", "url_filter.*")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(_texts(spark, sf_dir))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_texts(spark, sf_dir)).drop("text")
    return found.select("doc_id", *[c.alias(n) for n, c in secrets.as_digest("secrets").items()])


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _texts(spark, sf_dir)
    chain = toxicity.learn(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, chain)
    return scored.select(
        "doc_id",
        *[F.col("toxicity")[link.name].alias(f"p_{link.name}") for link in chain.links],
        (F.col("toxicity")[toxicity.OVERALL] >= toxicity.THRESHOLD).alias("toxic"),
    )


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mixing.mix(docs)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return warc.read(manifest, payloads=False).select(*names)


def op11_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, centroids = clustering.cluster(_table(spark, sf_dir, "embeddings"))
    found = clustering.with_inertia(assigned, centroids)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampling.resample(_texts(spark, sf_dir), _table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.col("licenses")
    names = ("n_words", "n_base", "first_word", "last_word")
    return licenses.scan(_texts(spark, sf_dir)).select(
        "doc_id",
        *[found[n].alias(n) for n in names],
        F.concat_ws(",", found["base_labels"]).alias("base_labels"),
        F.concat_ws(",", found["labels"]).alias("labels"),
        found["score"].alias("score"),
    )


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_decontamination,
        op3_pii,
        op4_quality_rules,
        op5_url_filter,
        op6_jaccard_join,
        op7_secret_scan,
        op8_toxicity,
        op9_mixing,
        op10_warc,
        op11_clustering,
        op12_resampling,
        op13_licenses,
    )
} | {"pipeline": corpus_pipeline.run}

ORACLES: dict[str, str] = dict(_SQL) | (
    {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
)
