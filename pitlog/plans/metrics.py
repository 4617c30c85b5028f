"""Model metrics from scored rows.

A scored frame has a true class position ``y`` (0-based) and a probability array
``probs``. Every metric is a partial aggregation; none orders the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitlog.functions import vectors as V
from pitlog.functions.frames import unpivot_row


def confusion_matrix(scored: DataFrame, y: str = "y", probs: str = "probs") -> DataFrame:
    """(y, pred, n) of the non-empty cells."""
    return (
        scored.select(F.col(y).alias("y"), V.argmax(F.col(probs)).alias("pred"))
        .groupBy("y", "pred")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def classification_metrics(
    scored: DataFrame, y: str = "y", probs: str = "probs", k: int = 3
) -> DataFrame:
    """(metric, value): accuracy, top-k accuracy, log-loss."""
    truth, p = F.col(y), F.col(probs)
    row = scored.agg(
        F.avg((V.argmax(p) == truth).cast("int")).alias("accuracy"),
        F.avg(F.array_contains(V.top_k(p, k), truth.cast("int")).cast("int")).alias(
            f"top{k}_accuracy"
        ),
        F.avg(V.log_loss_of(V.at(p, truth))).alias("log_loss"),
    )
    names = ["accuracy", f"top{k}_accuracy", "log_loss"]
    return unpivot_row(row, {n: n for n in names}, "metric", "value")


def per_class(matrix: DataFrame, classes: Sequence[str]) -> DataFrame:
    """(class, support, recall, precision, f1) from a confusion matrix.

    ``recall`` is the per-class accuracy. A class without support, or never
    predicted, has NULL there.
    """
    labels = F.array(*[F.lit(c) for c in classes])
    actual = matrix.groupBy(F.col("y").alias("c")).agg(
        F.sum("n").alias("support"),
        F.sum(F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0)).alias("hits"),
    )
    predicted = matrix.groupBy(F.col("pred").alias("c")).agg(F.sum("n").alias("predicted"))
    recall = F.try_divide("hits", "support")
    precision = F.try_divide(F.coalesce("hits", F.lit(0)), F.col("predicted"))
    return (
        actual.join(predicted, "c", "full")
        .select(
            F.try_element_at(labels, F.col("c").cast("int") + 1).alias("class"),
            F.coalesce("support", F.lit(0)).alias("support"),
            recall.alias("recall"),
            precision.alias("precision"),
        )
        .withColumn(
            "f1",
            F.try_divide(
                F.col("precision") * F.col("recall") * 2, F.col("precision") + F.col("recall")
            ),
        )
    )


def regression_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(metric, value): rmse, mae, r2, mean_actual, mean_pred, over rows that have both.

    R2 needs the mean first; it is the variance of the same aggregation, so one
    pass is enough.
    """
    rows = df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    err = F.col(actual) - F.col(predicted)
    row = rows.agg(
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(F.abs(err)).alias("mae"),
        (1 - F.try_divide(F.avg(err * err), F.var_pop(actual))).alias("r2"),
        F.avg(actual).alias("mean_actual"),
        F.avg(predicted).alias("mean_pred"),
    )
    names = ["rmse", "mae", "r2", "mean_actual", "mean_pred"]
    return unpivot_row(row, {n: n for n in names}, "metric", "value")


AUC_BLOCKS_PER_LOGIT = 2048


def one_vs_rest_auc(
    scored: DataFrame, n_classes: int, y: str = "y", probs: str = "probs"
) -> DataFrame:
    """(class_id, auc), exact, ties counting half; NULL for a class without both kinds of rows.

    Rows are first counted per distinct score. The running count of negatives
    below a score is then taken in two levels: inside blocks of close scores, and
    over the blocks of a class, about 150,000 at most. No task sees all scores of
    a class. Blocks are equal steps of the log-odds, so scores crowded near 0 or 1
    still spread over many.
    """
    odds = F.ln(F.try_divide(F.col("score"), 1 - F.col("score")))
    outside = F.when(F.col("score") <= 0, -40.0).otherwise(40.0)
    block = F.floor(F.coalesce(odds, outside) * AUC_BLOCKS_PER_LOGIT)
    cells = F.array(
        *[
            F.struct(
                F.lit(i).alias("class_id"),
                F.try_element_at(F.col(probs), F.lit(i + 1)).alias("score"),
                (F.col(y) == i).cast("int").alias("pos"),
            )
            for i in range(n_classes)
        ]
    )
    by_score = (
        scored.select(F.inline(cells))
        .groupBy("class_id", "score")
        .agg(F.sum("pos").alias("pos"), F.sum(1 - F.col("pos")).alias("neg"))
        .withColumn("block", block)
    )
    inside = Window.partitionBy("class_id", "block").orderBy("score")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    # Inside a block: pairs won against negatives of the block, and totals.
    won = F.col("pos") * (
        F.coalesce(F.sum("neg").over(before), F.lit(0)) + F.col("neg") / 2
    )
    blocks = (
        by_score.select("class_id", "block", "pos", "neg", won.alias("won"))
        .groupBy("class_id", "block")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum("won").alias("won"))
    )
    lower = (
        Window.partitionBy("class_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    )
    full = F.col("won") + F.col("pos") * F.coalesce(F.sum("neg").over(lower), F.lit(0))
    return (
        blocks.select("class_id", "pos", "neg", full.cast("double").alias("won"))
        .groupBy("class_id")
        .agg(F.sum("won").alias("won"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        .select(
            "class_id",
            F.try_divide(
                F.col("won"), F.col("pos").cast("double") * F.col("neg").cast("double")
            ).alias("auc"),
        )
    )


def baselines(df: DataFrame, label: str) -> DataFrame:
    """(metric, value): accuracy of a random guess and of always the largest class."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    row = counts.agg(
        F.try_divide(F.lit(1.0), F.count(F.lit(1))).alias("random_guess"),
        F.try_divide(F.max("n"), F.sum("n")).alias("largest_class"),
    )
    return unpivot_row(
        row, {n: n for n in ("random_guess", "largest_class")}, "metric", "value"
    )


def mean_of(df: DataFrame, value: Column, name: str) -> DataFrame:
    return df.agg(F.avg(value).alias(name))
