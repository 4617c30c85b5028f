"""Saved models with their blend weights, and the newest usable ones, ready to score."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitlog.functions import vectors as V
from pitlog.models.boosting import BoostedClasses
from pitlog.models.heads import ClassHead, FeatureSet, ValueHead
from pitlog.sources.paths import exists

ENTRY = "name string, kind string, path string, ts bigint, weight double, about string"


def _about(head: ClassHead | ValueHead) -> dict:
    """What scoring needs beside the fitted stages."""
    f = head.features
    out = {"categorical": list(f.categorical), "numeric": list(f.numeric), "one_hot": f.one_hot}
    if isinstance(head, ClassHead):
        out |= {"classes": list(head.classes), "label": head.label}
        if isinstance(head.model, BoostedClasses):
            out["first"] = head.model.first
    else:
        out["target"] = head.target
    return out


def save_checkpoint(
    spark: SparkSession,
    root: str,
    heads: Mapping[str, ClassHead | ValueHead],
    ts: int,
    weights: Mapping[str, float] | None = None,
) -> str:
    """Models and encoders under root/checkpoint_<ts>, one registry row per member.

    The rows also hold inputs and classes, so a loaded member scores raw rows. They are written
    last, so a checkpoint that is listed is whole.
    """
    where = f"{root}/checkpoint_{ts}"
    rows = []
    for name, head in heads.items():
        models = head.model.members if isinstance(head.model, BoostedClasses) else [head.model]
        PipelineModel([head.features.model, *models]).write().overwrite().save(f"{where}/{name}")
        weight = float(weights[name]) if weights else None
        rows.append((name, type(head).__name__, f"{where}/{name}", ts, weight, json.dumps(_about(head))))
    spark.createDataFrame(rows, ENTRY).coalesce(1).write.mode("append").parquet(f"{root}/registry")
    return where


def registry(spark: SparkSession, root: str) -> DataFrame | None:
    path = f"{root}/registry"
    return spark.read.schema(ENTRY).parquet(path) if exists(spark, path) else None


def _newest(spark: SparkSession, root: str) -> list:
    """Registry rows of the latest checkpoint that has weights."""
    entries = registry(spark, root)
    if entries is None:
        return []
    usable = entries.where(F.col("weight").isNotNull())
    latest = usable.orderBy(F.desc("ts")).limit(1).select("ts")
    return usable.join(latest, "ts", "left_semi").orderBy("name").collect()


def newest_with_weights(spark: SparkSession, root: str) -> dict[str, tuple[str, float]] | None:
    """Member name -> (path, weight) of the latest checkpoint that has weights."""
    return {r["name"]: (r["path"], r["weight"]) for r in _newest(spark, root)} or None


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def load_head(path: str, kind: str, about: str) -> ClassHead | ValueHead:
    """A saved member as the head it was."""
    said, stages = json.loads(about), load(path).stages
    features = FeatureSet(said["categorical"], said["numeric"], stages[0], said["one_hot"])
    if kind == ValueHead.__name__:
        return ValueHead(said["target"], features, model=stages[1])
    model = BoostedClasses(said["first"], list(stages[1:])) if "first" in said else stages[1]
    return ClassHead(said["classes"], said["label"], features, model=model)


def load_newest(spark: SparkSession, root: str) -> dict[str, tuple[ClassHead | ValueHead, float]] | None:
    """Member name -> (head, weight) of the latest checkpoint that has weights."""
    rows = _newest(spark, root)
    return {r["name"]: (load_head(r["path"], r["kind"], r["about"]), r["weight"]) for r in rows} or None


def score_newest(df: DataFrame, root: str, name: str = "probs") -> DataFrame:
    """``df`` with the blended class probabilities of the latest checkpoint's members.

    All members score the same rows as projections; rows may lack inputs.
    """
    members = load_newest(df.sparkSession, root)
    if members is None:
        raise ValueError(f"no checkpoint with weights under {root}")
    heads = [(head, weight) for head, weight in members.values() if isinstance(head, ClassHead)]
    out, total = df, sum(weight for _, weight in heads)
    for i, (head, _) in enumerate(heads):
        out = head.score_onto(out, f"_m{i}")
    blend = V.blend([F.col(f"_m{i}") for i in range(len(heads))], [w / total for _, w in heads])
    return out.select(*df.columns, blend.alias(name))
