"""Reading pitch logs, dimensions and season files."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitlog import schema as S
from pitlog.functions.frames import conform
from pitlog.sources.drift import read_drifting
from pitlog.sources.paths import exists

log = logging.getLogger(__name__)


def read_season(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path)


def read_seasons(
    spark: SparkSession,
    paths: Sequence[str],
    date_range: str | None = None,
    date: str = "game_date",
) -> DataFrame:
    """Several files as one log. Schemas may drift by season: columns merge by name, types widen.

    The range filter sits directly on each scan and is pushed into it.
    """
    return read_drifting(spark, paths, date_range, date)


def read_columns(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Only the named columns are read; a missing one is an error."""
    return spark.read.parquet(path).select(*columns)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header. Without a schema the types are inferred, which reads the data twice.

    Fields are matched to the schema by header name, whatever their order, and values
    that do not fit become NULL. Files whose headers differ from each other are an
    error, not a silent mix of columns.
    """
    reader = spark.read.option("header", True).option("enforceSchema", False)
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    return conform(reader.csv(path), schema, lenient=True)


def read_optional_csv(
    spark: SparkSession, path: str, schema: T.StructType | None = None
) -> DataFrame | None:
    """``None`` with a warning where the file does not exist."""
    if not exists(spark, path):
        log.warning("no %s, skipping", path)
        return None
    return read_csv(spark, path, schema)


def read_crosswalk(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, S.CROSSWALK)


def read_park_factors(spark: SparkSession, path: str) -> DataFrame | None:
    return read_optional_csv(spark, path, S.PARK_FACTORS)


def with_file_season(df: DataFrame, pattern: str = r".*_(\d{4})[./]") -> DataFrame:
    """Column ``season`` from the last ``_YYYY`` in the path a row came from.

    That is the file's name, or its folder's where a season is a folder of parts.
    """
    season = F.regexp_extract(F.col("_metadata.file_path"), pattern, 1)
    return df.select("*", F.nullif(season, F.lit("")).cast("int").alias("season"))


def discover_seasons(spark: SparkSession, path: str) -> list[int]:
    """Seasons of a partitioned table, ascending, from the partition column alone."""
    rows = spark.read.parquet(path).select("season").distinct().collect()
    return sorted(r["season"] for r in rows if r["season"] is not None)


def build_crosswalk(players: DataFrame) -> DataFrame:
    """Distinct (mlbam, fg) pairs of a player table."""
    return players.select(
        F.col("key_mlbam").cast("bigint").alias("mlbam"),
        F.col("key_fangraphs").cast("bigint").alias("fg"),
    ).distinct()
