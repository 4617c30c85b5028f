"""Writing feature tables, probabilities and metrics."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitlog.functions.frames import downcast
from pitlog.operators.selection import assert_no_leaks
from pitlog.sources.paths import committed

ROWS_PER_FILE = 5_000_000


def write_partitioned(
    df: DataFrame,
    path: str,
    partition: str,
    codec: str = "zstd",
    mode: str = "overwrite",
) -> None:
    """One folder per partition value; overwriting replaces only the values that ``df`` has.

    Rows of a value are brought together so that it gets few files, but a season is a
    large part of the log: adaptive execution splits what is too big for one task, and
    files are cut at a row limit.
    """
    (
        df.hint("rebalance", partition)
        .write.mode(mode)
        .option("compression", codec)
        .option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", ROWS_PER_FILE)
        .partitionBy(partition)
        .parquet(path)
    )


def write_features(
    df: DataFrame,
    path: str,
    mode: str = "overwrite",
    features: Sequence[str] = (),
    gate: Callable[[DataFrame, list[str]], DataFrame] | None = None,
) -> None:
    """Feature table with floats, zstd, partitioned by the season of its date.

    ``features`` are the columns that models will see. Before anything is written their names are
    tested against the tokens of current-pitch measurements, and ``gate`` (such as
    ``audits.leak_gate``) reports on what the data of those that look like one says; a failed row
    stops the write.
    """
    present = [c for c in features if c in df.columns]
    assert_no_leaks(present, exact=True)
    if gate is not None and present:
        failed = gate(df, present).where("NOT passed").collect()
        if failed:
            raise ValueError(f"leaks found before writing: {[(r['check'], r['item'], r['value']) for r in failed]}")
    out = downcast(df)
    if "season" not in out.columns:
        out = out.withColumn("season", F.year("game_date"))
    write_partitioned(out, path, "season", mode=mode)


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Session default codec, no partitioning."""
    df.write.mode(mode).parquet(path)


def build_once(
    spark: SparkSession, path: str, build: Callable[[], DataFrame], write=write_table
) -> bool:
    """Build and write unless a finished table is there. True if it was built.

    A folder without the success marker is a failed write and is built again.
    """
    if committed(spark, path):
        return False
    write(build(), path)
    return True


def write_metrics(
    spark: SparkSession,
    path: str,
    metrics: Mapping[str, float],
    params: Mapping[str, str] | None = None,
    classes: Mapping[str, float] | None = None,
    features: Sequence[str] = (),
) -> None:
    """One JSON row of metrics, parameters, class shares and the feature list."""
    row = [(dict(metrics), dict(params or {}), dict(classes or {}), list(features))]
    schema = (
        "metrics map<string,double>, params map<string,string>, "
        "class_distribution map<string,double>, features array<string>"
    )
    spark.createDataFrame(row, schema).coalesce(1).write.mode("overwrite").json(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(
        "metrics map<string,double>, params map<string,string>, "
        "class_distribution map<string,double>, features array<string>"
    ).json(path)


def write_probabilities(
    scored: DataFrame, path: str, key: Sequence[str], model: str, classes: Sequence[str]
) -> None:
    """Keyed probability rows, one folder per model."""
    out = scored.select(
        *key,
        "probs",
        F.array(*[F.lit(c) for c in classes]).alias("classes"),
    )
    out.write.mode("overwrite").parquet(f"{path}/model={model}")


def read_probabilities(spark: SparkSession, path: str, model: str) -> DataFrame:
    return spark.read.parquet(f"{path}/model={model}")
