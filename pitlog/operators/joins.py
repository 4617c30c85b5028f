"""Joins of the fact log with dimensions, feature tables and split sets.

All are equality joins. The log is always the left side of a left join (or of a
semi join), so adaptive execution can split a skewed key of the log and
replicate only the matching feature rows. No broadcast is forced: Spark turns
to one only where the size it measures is under its threshold.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def crosswalk_join(df: DataFrame, crosswalk: DataFrame, key: str, name: str) -> DataFrame:
    """Left join the second id of a player; one id per player, so rows never multiply."""
    ids = (
        crosswalk.where(F.col("mlbam").isNotNull())
        .groupBy(F.col("mlbam").alias(key))
        .agg(F.min("fg").alias(name))
    )
    return df.join(ids, key, "left").select(*df.columns, name)


def attach_features(df: DataFrame, features: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join a table with unique keys: (entity, day) features, or predictions by row key.

    The log keeps its rows and column order; rows without a match get NULLs.
    """
    extra = [c for c in features.columns if c not in keys]
    return df.join(features, list(keys), "left").select(*df.columns, *extra)


def park_factor_join(df: DataFrame, parks: DataFrame | None) -> DataFrame:
    """Left join the park factor; without a table the log passes through."""
    if parks is None:
        return df
    one = parks.groupBy("home_team").agg(F.min("PF").alias("PF"))
    return df.join(one, "home_team", "left").select(*df.columns, "PF")


def eligible_by_count(
    df: DataFrame, key: str, minimum: int, counted: str | None = None
) -> DataFrame:
    """Rows of keys with at least ``minimum`` (non-NULL ``counted``) rows, with that count.

    Counting and joining back needs no task that holds all rows of a key, which a
    window over the key would.
    """
    counts = (
        df.groupBy(key)
        .agg(F.count(F.col(counted) if counted else F.lit(1)).alias("n_rows"))
        .where(F.col("n_rows") >= minimum)
    )
    return df.join(counts, key, "inner").select(*df.columns, "n_rows")


def broadcast_back_max(df: DataFrame, keys: Sequence[str], column: str, name: str) -> DataFrame:
    """The group maximum on every row of the group."""
    top = df.groupBy(*keys).agg(F.max(column).alias(name))
    return df.join(top, list(keys), "left").select(*df.columns, name)


def matching_rows(df: DataFrame, kept: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose key survives in ``kept``."""
    return df.join(kept.select(*key), list(key), "left_semi")


def entity_overlap(splits: Mapping[str, DataFrame], entity: str) -> DataFrame:
    """(left, right, shared): entities that occur in both of two splits, for every pair.

    One aggregation marks the splits of each entity; a second counts the pairs.
    """
    names = list(splits)
    marked = reduce(
        DataFrame.unionByName,
        [d.select(entity, F.lit(i).alias("_s")) for i, d in enumerate(splits.values())],
    )
    seen = marked.where(F.col(entity).isNotNull()).groupBy(entity).agg(
        *[F.max(F.when(F.col("_s") == i, 1).otherwise(0)).alias(f"_in{i}") for i in range(len(names))]
    )
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    counts = seen.agg(
        *[F.count_if((F.col(f"_in{i}") == 1) & (F.col(f"_in{j}") == 1)).alias(f"p{i}_{j}")
          for i, j in pairs]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(names[i]).alias("left"),
                F.lit(names[j]).alias("right"),
                F.col(f"p{i}_{j}").alias("shared"),
            )
            for i, j in pairs
        ]
    )
    return counts.select(F.inline(rows))


def union_ranges(df: DataFrame, ranges: Sequence[tuple[str, str]], date: str) -> DataFrame:
    """Rows of several inclusive date ranges; a row in two ranges appears twice.

    One scan: the filter on all ranges is pushed into it, and a row is repeated per range it is in.
    """
    inside = [between_dates(date, f"{a}:{b}") for a, b in ranges]
    if not inside:
        return df.limit(0)
    times = F.array_compact(F.array(*[F.when(test, F.lit(1)) for test in inside]))
    named = df.where(reduce(lambda a, b: a | b, inside)).select("*", F.explode(times))
    return named.toDF(*df.columns, "_range").drop("_range")


def concat(frames: Sequence[DataFrame]) -> DataFrame:
    """Row concatenation by name; columns a frame lacks become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def between_dates(date: str, span: str) -> Column:
    """``start:end``, both ends included."""
    start, end = span.split(":")
    return F.col(date).between(F.lit(start).cast("date"), F.lit(end).cast("date"))
