"""Counts, shares, distributions and column statistics of a log.

Each report is one aggregation of the log; what follows works on the few
aggregated rows. Totals are scalar subqueries over those.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitlog import schema as S
from pitlog.functions.frames import numeric_columns, unpivot_row


def load_summary(df: DataFrame) -> DataFrame:
    """One row: rows, date range, distinct games, pitchers, batters."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("game_date").alias("first_date"),
        F.max("game_date").alias("last_date"),
        F.countDistinct("game_pk").alias("games"),
        F.countDistinct("pitcher").alias("pitchers"),
        F.countDistinct("batter").alias("batters"),
    )


def _totals(counts: DataFrame, *columns: str) -> Column:
    """One scalar subquery with the sums of all ``columns``.

    It reads exactly what the counts read, so Spark shares their exchange and the
    log is scanned once.
    """
    return counts.agg(F.struct(*[F.sum(c).alias(c) for c in columns])).scalar()


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n, share), NULL values left out."""
    counts = (
        df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    )
    return counts.withColumn("share", F.try_divide(F.col("n"), _totals(counts, "n")["n"]))


def top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    """The ``k`` most frequent values; equal counts in value order."""
    return value_counts(df, column).orderBy(F.desc("n"), F.col(column)).limit(k)


def weighted_distribution(df: DataFrame, label: str, weight: str) -> DataFrame:
    """(label, share, weighted_share, delta) over rows with a label."""
    sums = df.where(F.col(label).isNotNull()).groupBy(label).agg(
        F.count(F.lit(1)).alias("n"), F.sum(weight).alias("w_sum")
    )
    whole = _totals(sums, "n", "w_sum")
    return sums.select(
        label,
        F.try_divide(F.col("n"), whole["n"]).alias("share"),
        F.try_divide(F.col("w_sum"), whole["w_sum"]).alias("weighted_share"),
    ).withColumn("delta", F.col("weighted_share") - F.col("share"))


def class_support(
    df: DataFrame, label: str, weight: str, minimum: float = S.MIN_CLASS_SHARE
) -> DataFrame:
    """One row: smallest weighted class share, classes below ``minimum``, and the verdict."""
    dist = weighted_distribution(df, label, weight)
    return dist.agg(
        F.min("weighted_share").alias("min_share"),
        F.count_if(F.col("weighted_share") < minimum).alias("thin_classes"),
    ).withColumn("passed", F.col("thin_classes") == 0)


def monthly_profile(df: DataFrame, date: str, counted: str, entity: str) -> DataFrame:
    """(month, n, entities): non-NULL ``counted`` rows and distinct entities."""
    return df.groupBy(F.month(date).alias("month")).agg(
        F.count(counted).alias("n"), F.countDistinct(entity).alias("entities")
    )


def null_share(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, null_share), one pass over the log."""
    columns = list(columns or df.columns)
    row = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns])
    return unpivot_row(row, {c: c for c in columns}, "column_name", "null_share")


def mostly_null(df: DataFrame, above: float = 0.5) -> DataFrame:
    return null_share(df).where(F.col("null_share") > above).orderBy(
        F.desc("null_share"), "column_name"
    )


def summary_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, n, mean, std, min, max) of numeric columns, one pass."""
    columns = list(columns or numeric_columns(df))
    stats = {"n": F.count, "mean": F.avg, "std": F.stddev, "min": F.min, "max": F.max}
    row = df.agg(*[fn(c).cast("double").alias(f"{c}__{s}") for c in columns for s, fn in stats.items()])
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                *[F.col(f"{c}__{s}").alias(s) for s in stats],
            )
            for c in columns
        ]
    )
    return row.select(F.inline(rows))


def correlations(
    df: DataFrame, target: str, columns: Sequence[str] | None = None
) -> DataFrame:
    """(column_name, r) with the target, one pass; constant columns are left out."""
    columns = [c for c in (columns or numeric_columns(df)) if c != target]
    row = df.agg(*[_pearson(c, target).alias(c) for c in columns])
    out = unpivot_row(row, {c: c for c in columns}, "column_name", "r")
    return out.where(F.col("r").isNotNull() & ~F.isnan("r"))


def _pearson(a: str, b: str) -> Column:
    """From moments, so that a constant column gives NULL where ``corr`` would divide by zero."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x = F.when(both, F.col(a).cast("double"))
    y = F.when(both, F.col(b).cast("double"))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def sparse_target(
    df: DataFrame, target: str, above: float = S.SPARSE_TARGET_SHARE
) -> DataFrame:
    """Rows with a target if its NULL share exceeds ``above``, else all rows.

    The share is a scalar subquery, so the decision is part of the plan.
    """
    share = df.agg(F.avg(F.col(target).isNull().cast("int"))).scalar()
    return df.where((share <= above) | F.col(target).isNotNull())


def top_n(df: DataFrame, by: str, n: int, ties: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(F.desc(by), *ties).limit(n)
