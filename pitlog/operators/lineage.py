"""Cutting lineage before work that reads a table many times."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from pitlog.session import checkpoint_dir
from pitlog.sources.paths import remove


def shared_folder(spark: SparkSession) -> str:
    """The folder for cut lineage that the driver and all executors share.

    That is the checkpoint folder the session names, else the warehouse.
    """
    folder = checkpoint_dir(spark) or spark.sparkContext.getCheckpointDir()
    return (folder or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def materialise(df: DataFrame, name: str = "table", by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` as parquet in the shared folder and read it back.

    A lost executor then costs a re-read, not a recomputation, and later readers
    still prune columns, and files too if they filter on the columns ``by``. The
    folder's owner removes old tables.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    table = df.sparkSession.read.parquet(path)
    return table.select(*df.columns) if by else table


class Succession:
    """A table that is rewritten again and again: of its versions the last two are kept.

    Each version is read by the next one only, so what came before can go; the state of a
    long loop neither grows its plan nor fills the folder.
    """

    def __init__(self, name: str):
        self.name = name
        self.paths: list[str] = []

    def put(self, df: DataFrame) -> DataFrame:
        spark = df.sparkSession
        self.paths.append(f"{shared_folder(spark)}/{self.name}-{uuid.uuid4().hex}")
        df.write.parquet(self.paths[-1])
        if len(self.paths) > 2:
            remove(spark, self.paths.pop(0))
        return spark.read.parquet(self.paths[-1])

    def clear(self) -> None:
        """Remove what is left; nothing may read the table afterwards."""
        spark = SparkSession.active()
        while self.paths:
            remove(spark, self.paths.pop())
