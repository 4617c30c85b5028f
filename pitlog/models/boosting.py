"""Multiclass gradient boosting with one loop, stopped by held-out rows.

A round computes every class's gradient and curvature of the softmax loss from the current scores
and fits one regression tree per class to the Newton step (gradient over curvature, weighted by
curvature), so that a leaf's mean is the step of its rows. The trees of a round grow together, in
one pass per level over rows that were binned once (``histogram_trees``), and end as MLlib's models.
The state (codes, class, weight, scores) is a written table; passes add the steps of the rounds since
then to its scores, and every ``FOLD`` rounds a new version replaces it, so neither plan nor folder nor
the work of a pass grows with the rounds. Boosting stops when the held-out log-loss has not improved
for ``patience`` rounds and keeps the best ones.

The result has one boosted ensemble per class, so scoring takes as many columns as classes at
any number of rounds.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark import SparkContext
from pyspark.ml.regression import DecisionTreeRegressionModel, GBTRegressionModel
from pyspark.ml.wrapper import JavaWrapper
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitlog.functions import vectors as V
from pitlog.models import histogram_trees as HT
from pitlog.models.histogram_trees import LEAST_CURVATURE, MOST_STEP
from pitlog.operators.lineage import Succession

SEED = 42
SCAN_TASKS = "spark.sql.files.minPartitionNum"


def newton_targets(scores: Column, y: Column, w: Column) -> Column:
    """Per class (step, weight): (1{y = k} - p) / (p (1 - p)), cut at ``MOST_STEP``, and w p (1 - p)."""

    def one(p: Column, k: Column) -> Column:
        curve = F.greatest(p * (1 - p), F.lit(LEAST_CURVATURE))
        step = ((y == k).cast("double") - p) / curve
        return F.struct(
            F.greatest(F.least(step, F.lit(MOST_STEP)), F.lit(-MOST_STEP)).alias("step"),
            (w * curve).alias("weight"),
        )

    return V.let(V.softmax(scores), lambda v: F.transform(v, one))


def ensemble(trees: Sequence[DecisionTreeRegressionModel], weight: float, n_features: int) -> GBTRegressionModel:
    """The weighted sum of ``trees`` as one MLlib model."""
    jvm = SparkContext._active_spark_context._gateway.jvm
    kind = jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel
    java = JavaWrapper._new_java_obj(
        "org.apache.spark.ml.regression.GBTRegressionModel",
        f"boosted_{uuid.uuid4().hex[:12]}",
        JavaWrapper._new_java_array([t._java_obj for t in trees], kind),
        JavaWrapper._new_java_array([float(weight)] * len(trees), jvm.double),
        n_features,
    )
    return GBTRegressionModel(java)


@dataclass
class BoostedClasses:
    """Fitted boosting: first scores by class and one ensemble per class (none without rounds)."""

    first: list[float]
    members: list[GBTRegressionModel]
    losses: list[float] = field(default_factory=list)

    @property
    def rounds(self) -> int:
        return self.members[0].getNumTrees if self.members else 0

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` (with ``features``) and an array ``probability``."""
        out, names = df, [f"_boost_{k}" for k in range(len(self.members))]
        for name, member in zip(names, self.members):
            out = member.copy().setPredictionCol(name).transform(out)
        scores = [F.lit(f) + F.col(n) for f, n in zip(self.first, names)] or [F.lit(f) for f in self.first]
        return out.select(*df.columns, V.softmax(F.array(*scores)).alias("probability"))

    @property
    def importances(self) -> list[float]:
        """Importance of each feature, averaged over the classes."""
        each = [m.featureImportances.toArray() for m in self.members]
        return [float(x) for x in sum(each) / len(each)] if each else []


@dataclass
class MulticlassBooster:
    """Settings of a fit. ``rounds`` is the most there are; held-out rows may stop it before."""

    n_classes: int
    rounds: int = 200
    depth: int = 5
    rate: float = 0.2
    patience: int = 10
    max_bins: int = 32
    least_rows: int = 5
    seed: int = SEED

    def fit(self, rows: DataFrame) -> BoostedClasses:
        """Boost ``rows`` (features, label, w; optional boolean held_out).

        Without held-out rows all rounds run. Rows without a label must have been left out. The
        first scores are the log shares of the classes, so a class without rows starts low.
        """
        held = F.coalesce("held_out", F.lit(False)) if "held_out" in rows.columns else F.lit(False)
        start = rows.select("features", F.col("label").cast("int").alias("y"), "w", held.alias("held_out"))
        sums = start.where("not held_out").groupBy("y").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n")).collect()
        mass, n = {r["y"]: r["w"] for r in sums}, sum(r["n"] for r in sums)
        total = sum(mass.values()) + self.n_classes
        first = [math.log((mass.get(k, 0.0) + 1.0) / total) for k in range(self.n_classes)]
        if not mass:
            return BoostedClasses(first, [])
        train = start.where("not held_out")
        spark = rows.sparkSession
        # More tasks than cores, as tasks differ, but a bounded number; the session gets its setting back.
        was, tasks = spark.conf.get(SCAN_TASKS, None), 3 * spark.sparkContext.defaultParallelism
        spark.conf.set(SCAN_TASKS, str(tasks))
        try:
            return self._boosted(rows, start, train, n, first, tasks)
        finally:
            spark.conf.unset(SCAN_TASKS) if was is None else spark.conf.set(SCAN_TASKS, was)

    def _boosted(
        self, rows: DataFrame, start: DataFrame, train: DataFrame, n: int, first: list[float], tasks: int
    ) -> BoostedClasses:
        # Rows are binned once; thresholds come from a bounded sample, weighted anew by class and round.
        x, y, w = HT.bounded_sample(train, n, max(self.max_bins**2, HT.LEAST_SAMPLE), self.seed)
        coding = HT.Coding.of(x, HT.arities(rows))
        sample, scores = coding.codes(x), np.tile(first, (len(x), 1))
        state = Succession("boosting")
        coded = HT.start(start, coding, first)
        table = state.put(coded.repartition(tasks) if n > HT.LEAST_SAMPLE else coded)
        losses, grown, since = [self._loss(table, HT.Moves(), coding)], [], []
        for _ in range(self.rounds):
            cuts = coding.cuts(sample, HT.targets(scores, y, w)[1], min(self.max_bins, n))
            moves = HT.Moves(since, self._weight)
            trees = HT.grow(table.where("not held_out"), coding, cuts, self.depth, self.least_rows, moves)
            grown.append(trees)
            since.append(trees)
            scores = scores + self._weight * np.stack([t.steps(sample.T) for t in trees], axis=1)
            moves = HT.Moves(since, self._weight)
            if len(since) == HT.FOLD:
                table, since, moves = state.put(HT.stepped(table, moves, coding)), [], HT.Moves()
            losses.append(None if losses[0] is None else self._loss(table, moves, coding))
            if losses[0] is not None and len(losses) - 1 - losses.index(min(losses)) >= self.patience:
                break
        best = len(grown) if losses[0] is None else min(range(len(losses)), key=losses.__getitem__)
        state.clear()
        kept = [[tree.model(coding) for tree in trees] for trees in grown[:best]]
        members = [ensemble(trees, self._weight, len(coding.mids)) for trees in zip(*kept)]
        return BoostedClasses(first, members, [x for x in losses if x is not None])

    @property
    def _weight(self) -> float:
        return self.rate * (self.n_classes - 1) / self.n_classes

    def _loss(self, table: DataFrame, moves: HT.Moves, coding: HT.Coding) -> float | None:
        """Weighted held-out log-loss; None without held-out rows."""
        each = HT.losses(table.where("held_out"), moves, coding, V.LOG_CLIP)
        row = each.agg(F.sum("s").alias("s"), F.sum("w").alias("w")).first()
        return row["s"] / row["w"] if row["w"] else None
