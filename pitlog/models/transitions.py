"""Frequency models: sequence transitions with back-off, and per-entity residuals.

Both are tables of class counts built by grouping, and scored by joins, so they
train and score as ordinary Spark jobs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitlog import schema as S
from pitlog.functions import vectors as V
from pitlog.operators.joins import attach_features
from pitlog.operators.lineage import materialise

ALPHA = 1.0


def class_counts(
    df: DataFrame, context: Sequence[str], label: str, classes: Sequence[str], name: str
) -> DataFrame:
    """(context..., {name} array of class counts in ``classes`` order)."""
    row = [F.count_if(F.col(label) == c) for c in classes]
    return df.groupBy(*context).agg(F.array(*row).alias(name))


def smoothed(counts: Column, prior: Column, alpha: float = ALPHA) -> Column:
    """(count + alpha * prior) / (total + alpha), the prior itself without counts."""
    rows = F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, x: a + x)
    mixed = V.let(
        rows,
        lambda t: F.zip_with(counts, prior, lambda n, p: (n + F.lit(alpha) * p) / (t + F.lit(alpha))),
    )
    return F.when(counts.isNull(), prior).otherwise(mixed)


def transition_tables(
    train: DataFrame,
    contexts: Sequence[Sequence[str]],
    label: str = "pitch_type_can",
    classes: Sequence[str] = S.PITCH_TYPES,
) -> list[DataFrame]:
    """Count tables from the coarsest context to the finest. An empty context is one row.

    The rows are grouped once, by the finest context; where contexts are nested the coarser
    tables add up that small one.
    """
    finest = list(contexts[-1])
    fine = materialise(class_counts(train, finest, label, classes, "_n"), "transitions")
    tables = []
    for i, context in enumerate(contexts):
        if set(context) <= set(finest):
            added = F.array(*[F.sum(F.col("_n")[k]) for k in range(len(classes))])
            tables.append(fine.groupBy(*context).agg(added.alias(f"n{i}")))
        else:
            tables.append(class_counts(train, context, label, classes, f"n{i}"))
    return tables


def transition_probabilities(
    df: DataFrame,
    tables: Sequence[DataFrame],
    contexts: Sequence[Sequence[str]],
    n_classes: int,
    name: str = "probs",
) -> DataFrame:
    """Class probabilities with back-off: each context smooths towards the coarser one.

    Context columns must not be NULL (fill lags with a word such as NONE first).
    """
    out, prior = df, F.array_repeat(F.lit(1.0 / n_classes), n_classes)
    for i, (table, context) in enumerate(zip(tables, contexts)):
        if context:
            out = attach_features(out, table, context)
            counts = F.col(f"n{i}")
        else:
            # One row of class totals, read once and put into the plan as constants.
            counts = F.array(*[F.lit(n).cast("bigint") for n in table.first()[f"n{i}"]])
        out = out.withColumn(f"_p{i}", smoothed(counts, prior))
        prior = F.col(f"_p{i}")
    made = [f"{c}{i}" for c in ("n", "_p") for i in range(len(tables))]
    return out.withColumn(name, prior).drop(*made)


def residual_mix(
    df: DataFrame,
    train: DataFrame,
    base: str,
    context: Sequence[str] = ("pitcher", "count_state", "prev_pitch_1"),
    entity: str = "pitcher",
    label: str = "pitch_type_can",
    classes: Sequence[str] = S.PITCH_TYPES,
    minimum: int = S.MIN_RESIDUAL_PITCHES,
    share: float = S.RESIDUAL_SHARE,
    name: str = "mixed",
) -> DataFrame:
    """Base probabilities mixed with the entity's own frequencies in its context.

    Only entities with ``minimum`` labelled rows in ``train`` get a mixture; the
    others, and contexts never seen, keep the base vector.
    """
    eligible = (
        train.groupBy(entity)
        .agg(F.count(label).alias("_n"))
        .where(F.col("_n") >= minimum)
        .select(entity)
    )
    own = class_counts(train, context, label, classes, "_own").join(eligible, entity, "left_semi")
    joined = attach_features(df, own, list(context))
    p = F.col(base)
    mixed = V.blend([p, smoothed(F.col("_own"), p)], [1.0 - share, share])
    return joined.withColumn(name, F.when(F.col("_own").isNull(), p).otherwise(mixed)).drop("_own")
