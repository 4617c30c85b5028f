"""Landing of season files and the CSV conversion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitlog import schema as S
from pitlog.functions.frames import downcast, keep, strict
from pitlog.sources.paths import exists
from pitlog.sources.readers import read_csv, with_file_season
from pitlog.sources.writers import write_partitioned


# The folder name Spark gives to a NULL partition value.
NO_SEASON = "__HIVE_DEFAULT_PARTITION__"


def clean_season(landed: DataFrame) -> DataFrame:
    """Date cast, essential columns that exist, floats for storage, season from the date."""
    typed = {f.name: f.dataType for f in S.RAW_PITCH.fields}
    kept = keep(landed, S.LANDING_KEEP)
    cast = kept.select(
        [
            F.to_date(c).alias(c)
            if isinstance(typed[c], T.DateType)
            else F.col(c).try_cast(typed[c]).alias(c)
            for c in kept.columns
        ]
    )
    return downcast(cast).withColumn("season", F.year("game_date"))


def land(landed: DataFrame, out: str, mode: str = "ignore") -> None:
    """Write landed rows partitioned by season.

    With ``ignore`` the seasons that are there are left alone and the others are added, with
    ``overwrite`` the landed seasons are replaced; seasons that did not land always stay. A
    season's folder is moved into place when its write ends, so one that is there is whole.
    """
    rows = clean_season(landed)
    if mode == "ignore":
        spark = landed.sparkSession
        seasons = [r["season"] for r in rows.select("season").distinct().collect()]
        there = [s for s in seasons if exists(spark, f"{out}/season={NO_SEASON if s is None else s}")]
        if len(there) == len(seasons):
            return
        for season in there:
            rows = rows.where(~F.col("season").eqNullSafe(F.lit(season)))
        mode = "overwrite"
    write_partitioned(rows, out, "season", mode=mode)


def convert_csv(spark: SparkSession, in_dir: str, out_dir: str) -> None:
    """All CSV files of a folder to the strict ten columns, snappy, one folder per year.

    The year comes from the file name (``..._2020.csv``).
    """
    named = with_file_season(read_csv(spark, f"{in_dir}/*.csv"))
    ten = strict(named, [*S.CONVERT_COLUMNS, "season"]).withColumnRenamed("season", "year")
    write_partitioned(ten, out_dir, "year", codec="snappy", mode="overwrite")
