"""Leakage and data-quality audits.

Every audit returns rows (check, item, value, passed) and looks at the whole
table: all games, all pitchers, all rows, where a spot check would look at one.
``value`` counts violations unless the audit says otherwise.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitlog import schema as S
from pitlog.functions.frames import numeric_columns
from pitlog.operators.joins import entity_overlap
from pitlog.operators.profile import correlations
from pitlog.operators.selection import bucket_of, leaky_columns
from pitlog.operators.sequence import running_features

GAME = ("pitcher", "game_pk")
IN_GAME = ("at_bat_number", "pitch_number")
TYPES = ("FF", "SL", "CH")


def _report(check: str, row: DataFrame, items: Sequence[str], passed=lambda v: v == 0) -> DataFrame:
    """A one-row frame with one measure per item to report rows."""
    cells = F.array(
        *[
            F.struct(F.lit(i).alias("item"), F.col(f"`{i}`").cast("double").alias("value"))
            for i in items
        ]
    )
    return (
        row.select(F.inline(cells))
        .select(
            F.lit(check).alias("check"), "item", "value", passed(F.col("value")).alias("passed")
        )
    )


def constant_in_game(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Games in which a to-date feature takes more than one value."""
    spans = df.groupBy(*GAME).agg(
        *[(F.max(f) != F.min(f)).alias(f) for f in features]
    )
    row = spans.agg(*[F.count_if(f).alias(f) for f in features])
    return _report("constant_in_game", row, features)


def equals_current(df: DataFrame, pairs: Mapping[str, tuple[str, float, str | None]]) -> DataFrame:
    """Rows whose feature is within a tolerance of the row's own measurement.

    pairs: feature -> (measurement, tolerance, pitch type or None for all rows)
    """
    def close(feature: str, source: str, tolerance: float, code: str | None) -> Column:
        near = F.abs(F.col(source) - F.col(feature)) < tolerance
        return near if code is None else near & (F.col("pitch_type_can") == code)

    row = df.agg(*[F.count_if(close(f, *spec)).alias(f) for f, spec in pairs.items()])
    return _report("equals_current", row, list(pairs))


def to_date_pairs(types: Sequence[str] = S.PITCH_TYPES) -> dict[str, tuple[str, float, str]]:
    out = {}
    for t in types:
        out[f"SPIN_TD_{t}"] = ("release_spin_rate", 1.0, t)
        out[f"V_TD_{t}"] = ("release_speed", 0.1, t)
    return out


def recompute_running(
    df: DataFrame, speed: str = "velocity", tolerance: float = 0.01
) -> DataFrame:
    """Rows whose running count or mean (speed, spin) differs from a recomputation inside the type.

    On rows of a type, the running mean must be the mean of the earlier rows of
    that type and the running count their number, which the first row has none of.
    """
    both = running_features(
        df,
        [*GAME, "pitch_type_can"],
        IN_GAME,
        row_count="_n",
        means={"_speed": F.col("release_speed"), "_spin": F.col("release_spin_rate")},
    )
    bad = {}
    for t in TYPES:
        here, count = F.col("pitch_type_can") == t, F.col(f"cum_{t.lower()}_count")
        for name, again in ((speed, F.col("_speed")), ("spin", F.col("_spin"))):
            mean = F.col(f"cum_{t.lower()}_{name}")
            agrees = F.when(again.isNull(), mean.isNull()).otherwise(
                F.coalesce(F.abs(mean - again) < tolerance, F.lit(False))
            )
            bad[f"cum_{t.lower()}_{name}"] = here & ~agrees
        bad[f"cum_{t.lower()}_count"] = here & (F.coalesce(count, F.lit(0)) != F.col("_n"))
    row = both.agg(*[F.count_if(c).alias(n) for n, c in bad.items()])
    return _report("recompute_running", row, list(bad))


def early_null(df: DataFrame, features: Sequence[str] | None = None, entity: str = "pitcher") -> DataFrame:
    """Non-NULL prior-window features (30 and 7 days) on an entity's first day."""
    features = list(features or [c for c in df.columns if "30d_" in c or c.endswith("_7d")])
    first = df.groupBy(entity).agg(F.min("game_date").alias("_first"))
    opening = df.join(first, entity, "inner").where(F.col("game_date") == F.col("_first"))
    row = opening.agg(*[F.count(f).alias(f) for f in features])
    return _report("early_null", row, features)


def first_row_zero(df: DataFrame, column: str = "cum_game_pitches") -> DataFrame:
    """Games whose first row has earlier pitches.

    The first row has the smallest (at bat, pitch) pair, so one aggregation finds it.
    """
    first = df.groupBy(*GAME).agg(
        F.min_by(F.coalesce(F.col(column), F.lit(0)), F.struct(*IN_GAME)).alias("_first")
    )
    row = first.agg(F.count_if(F.col("_first") != 0).alias(column))
    return _report("first_row_zero", row, [column])


def required_columns(
    df: DataFrame,
    required: Sequence[str] = S.REQUIRED_COLUMNS,
    families: Mapping[str, Sequence[str]] = S.FEATURE_FAMILIES,
    expected: T.StructType | None = None,
) -> DataFrame:
    """Non-NULL values of each required column and of each feature family.

    A missing column, an empty family, or a column whose type differs from
    ``expected`` fails with value 0.
    """
    present = set(df.columns)
    types = {f.name: f.dataType for f in df.schema.fields}
    wanted = {f.name: f.dataType for f in expected.fields} if expected else {}
    measures: dict[str, Column] = {}
    for c in required:
        usable = c in present and (c not in wanted or types[c] == wanted[c])
        measures[c] = F.count(c) if usable else F.sum(F.lit(0))
    for name, parts in families.items():
        members = [c for c in df.columns if any(p in c for p in parts)]
        total = F.sum(F.lit(0))
        for c in members:
            total = total + F.count(c)
        measures[name] = total
    row = df.agg(*[F.coalesce(m, F.lit(0)).alias(n) for n, m in measures.items()])
    return _report("required_columns", row, list(measures), lambda v: v > 0)


def vocabulary(
    df: DataFrame, column: str = "pitch_type_can", expected: Sequence[str] = S.EXPECTED_TYPES
) -> DataFrame:
    """Rows of each expected value, and rows with any other value."""
    other = F.col(column).isNotNull() & ~F.col(column).isin(*expected)
    row = df.agg(
        *[F.count_if(F.col(column) == v).alias(v) for v in expected],
        F.count_if(other).alias("unexpected"),
    )
    found = _report("vocabulary", row, [*expected, "unexpected"], lambda v: v > 0)
    return found.withColumn(
        "passed", F.when(F.col("item") == "unexpected", F.lit(True)).otherwise(F.col("passed"))
    )


def split_overlap(splits: Mapping[str, DataFrame], entity: str) -> DataFrame:
    """Entities shared by two splits; sharing is reported, it is no failure."""
    return entity_overlap(splits, entity).select(
        F.lit("split_overlap").alias("check"),
        F.concat_ws("+", "left", "right").alias("item"),
        F.col("shared").cast("double").alias("value"),
        F.lit(True).alias("passed"),
    )


def high_correlation(
    df: DataFrame, target: str, columns: Sequence[str] | None = None, limit: float = 0.8
) -> DataFrame:
    """|r| of each numeric column with a numeric target."""
    return correlations(df, target, columns).select(
        F.lit("high_correlation").alias("check"),
        F.col("column_name").alias("item"),
        F.abs("r").alias("value"),
        (F.abs("r") <= limit).alias("passed"),
    )


def spread(
    df: DataFrame, column: str = "dvelo1", limit: float = S.DVELO_SPREAD_LIMIT
) -> DataFrame:
    row = df.agg(F.stddev(column).alias(column))
    return _report("spread", row, [column], lambda v: F.coalesce(v <= limit, F.lit(True)))


# --- fixed values: plausible ranges of model quality -------------------------
METRIC_GATES = {
    "type_accuracy": (0.45, 0.75),
    "outcome_accuracy": (None, 0.80),
    "mini_accuracy": (0.2, 0.95),
    "mini_rmse": (0.01, 0.5),
}


def plausibility(
    metrics: DataFrame, gates: Mapping[str, tuple[float | None, float | None]] = METRIC_GATES
) -> DataFrame:
    """Rows (metric, value) against the range in which the metric is believable."""
    ok: Column = F.lit(True)
    for name, (low, high) in gates.items():
        inside = F.lit(True)
        if low is not None:
            inside = inside & (F.col("value") >= low)
        if high is not None:
            inside = inside & (F.col("value") <= high)
        ok = F.when(F.col("metric") == name, inside).otherwise(ok)
    return metrics.select(
        F.lit("plausibility").alias("check"), F.col("metric").alias("item"), "value", ok.alias("passed")
    )


def column_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, bucket, null_share, distinct_values, low, high), one pass.

    ``bucket`` is what the name suggests; the measures show what the data says.
    Distinct counts are approximate.
    """
    columns = list(columns or df.columns)
    numbers = set(numeric_columns(df))
    aggs, cells = [], []
    for c in columns:
        aggs += [
            F.avg(F.col(c).isNull().cast("int")).alias(f"{c}__null"),
            F.approx_count_distinct(c).alias(f"{c}__distinct"),
        ]
        if c in numbers:
            aggs += [
                F.min(c).cast("double").alias(f"{c}__low"),
                F.max(c).cast("double").alias(f"{c}__high"),
            ]
        none = F.lit(None).cast("double")
        cells.append(
            F.struct(
                F.lit(c).alias("column_name"),
                F.lit(bucket_of(c)).alias("bucket"),
                F.col(f"{c}__null").alias("null_share"),
                F.col(f"{c}__distinct").alias("distinct_values"),
                (F.col(f"{c}__low") if c in numbers else none).alias("low"),
                (F.col(f"{c}__high") if c in numbers else none).alias("high"),
            )
        )
    return df.agg(*aggs).select(F.inline(F.array(*cells)))


def leak_gate(
    df: DataFrame,
    features: Sequence[str],
    target: str | None = None,
    tokens: Sequence[str] = S.LEAK_TOKENS,
    limit: float = 0.8,
) -> DataFrame:
    """What to check before a feature table is written.

    One report row per feature the name rule hits, with two measures of the data
    beside it: games in which it varies is expected of a current-pitch value, and
    its correlation with a numeric target. A hit whose values are constant in
    every game is let through: it only looks like a measurement.
    """
    hits = leaky_columns(features, tokens)
    if not hits:
        return df.sparkSession.createDataFrame(
            [], "check string, item string, value double, passed boolean"
        )
    varies = constant_in_game(df, hits).withColumn("check", F.lit("leak_gate"))
    parts = [varies]
    if target is not None:
        numeric = [c for c in hits if c in numeric_columns(df)]
        if numeric:
            parts.append(
                high_correlation(df, target, numeric, limit).withColumn(
                    "check", F.lit("leak_gate_correlation")
                )
            )
    return reduce(DataFrame.unionByName, parts)
