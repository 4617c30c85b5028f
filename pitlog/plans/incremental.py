"""Incremental build of rolling features: a new day recomputes only what its frames touch.

Three tables lie under one root. ``days`` keeps the daily sums of every entity, partitioned by
day; ``features`` the rolled rows, likewise; ``manifest`` a fingerprint of each day's log rows (their
number and the sum of their hashes) and of each season folder's files. An update first compares
the store's listing with the manifest and reads only seasons whose files changed. Of those it
compares day by day, recomputes the sums of days that differ from their rows, and rolls those days
and the ones whose frames reach back to them, from kept sums. Manifest rows are written last:
a day whose write broke off has none that fits, and is built again by the next update.
"""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitlog.operators.rolling import Family, daily_wide, rolled_days
from pitlog.sources import paths as P

DAY = "day"
_FINGERPRINT = "season string, files string, day date, n bigint, mark decimal(38,0), written bigint"


@dataclass(frozen=True)
class Update:
    """What an update did: seasons read, days whose sums were rebuilt, days rolled again."""

    seasons: tuple[str, ...]
    changed: tuple[datetime.date, ...]
    rolled: tuple[datetime.date, ...]


@dataclass(frozen=True)
class Build:
    """A kept build of the rolling features of one entity.

    ``read`` turns season folders of ``log`` (names such as ``season=2024``) into the prepared log;
    families must reach back a bounded number of days.
    """

    log: str
    root: str
    entity: str
    families: Sequence[Family]
    read: Callable[[SparkSession, Sequence[str]], DataFrame]
    date: str = "game_date"

    @property
    def reach(self) -> int:
        days = [fam.frame.days for fam in self.families]
        if None in days:
            raise ValueError("a to-date frame touches every later day; it has no incremental build")
        return max(days)

    def features(self, spark: SparkSession) -> DataFrame:
        """The built (entity, date) table."""
        return spark.read.parquet(f"{self.root}/features").drop(DAY)

    def manifest(self, spark: SparkSession) -> DataFrame:
        """The last written fingerprint of each season and day."""
        path = f"{self.root}/manifest"
        if not P.exists(spark, path):
            return spark.createDataFrame([], _FINGERPRINT)
        rows = spark.read.schema(_FINGERPRINT).parquet(path)
        last = rows.groupBy("season").agg(F.max("written").alias("written"))
        return rows.join(last, ["season", "written"], "left_semi").select(*rows.columns)

    def update(self, spark: SparkSession) -> Update:
        """Bring the build up to date with the log's folder."""
        known = {r["season"]: r["files"] for r in self.manifest(spark).select("season", "files").distinct().collect()}
        there = P.listing(spark, self.log)
        touched = sorted(s for s in there if known.get(s) != there[s])
        gone = sorted(s for s in known if s not in there)
        if not touched and not gone:
            return Update((), (), ())
        before = {(r["season"], r["day"]): (r["n"], r["mark"]) for r in self._rows(spark, [*touched, *gone])}
        now = {}
        for season in touched:
            rows = self.read(spark, [f"{self.log}/{season}"])
            for r in self._fingerprints(rows).collect():  # one row a calendar day
                now[season, r["day"]] = (r["n"], r["mark"])
        changed = sorted({day for (s, day) in {*before, *now} if before.get((s, day)) != now.get((s, day))})
        # A day may have rows in several seasons' folders, so all that hold it are read for it.
        holding = self.manifest(spark).where(F.col("day").isin(changed)).select("season").distinct().collect()
        seasons = sorted({*touched, *(r["season"] for r in holding)} & set(there))
        rolled = self._rebuild(spark, seasons, changed) if changed else []
        written = 1 + (self._last(spark) or 0)
        rows = [(s, there[s], day, n, mark, written) for (s, day), (n, mark) in now.items()]
        rows += [(s, there[s], None, 0, None, written) for s in touched if not any(k[0] == s for k in now)]
        rows += [(s, None, None, 0, None, written) for s in gone]
        spark.createDataFrame(rows, _FINGERPRINT).coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")
        return Update(tuple(touched), tuple(changed), tuple(rolled))

    def _rows(self, spark: SparkSession, seasons: Sequence[str]) -> list:
        return self.manifest(spark).where(F.col("season").isin(list(seasons)) & F.col("day").isNotNull()).collect()

    def _last(self, spark: SparkSession) -> int | None:
        return self.manifest(spark).agg(F.max("written")).first()[0]

    def _fingerprints(self, rows: DataFrame) -> DataFrame:
        """Number and hash sum of each day's rows, whatever their order."""
        mark = F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]).cast("decimal(20,0)"))
        dated = rows.where(F.col(self.date).isNotNull())
        return dated.groupBy(F.col(self.date).cast("date").alias("day")).agg(
            F.count(F.lit(1)).alias("n"), mark.cast("decimal(38,0)").alias("mark")
        )

    def _rebuild(self, spark: SparkSession, seasons: Sequence[str], changed: Sequence[datetime.date]) -> list:
        """Daily sums of the changed days, then rolled rows of all days whose frames hold one."""
        if seasons:
            rows = self.read(spark, [f"{self.log}/{s}" for s in seasons])
            rows = rows.where(F.col(self.date).cast("date").isin(list(changed)))
            self._replace(spark, daily_wide(rows, self.entity, self.date, self.families), "days", changed)
        else:
            for day in changed:
                P.remove(spark, f"{self.root}/days/{DAY}={day.isoformat()}")
        first, last = min(changed), max(changed)
        days = spark.read.parquet(f"{self.root}/days")
        reach = datetime.timedelta(days=self.reach - 1)
        near = days.where(F.col(DAY).between(first - reach, last + reach))
        shifts = [d + datetime.timedelta(days=i) for d in changed for i in range(self.reach)]
        present = {r[0] for r in near.select(DAY).distinct().collect()}
        rolled = sorted(present.intersection(shifts))
        # Days that lost all their rows go from the features as well.
        wide = rolled_days(near.drop(DAY), self.entity, self.date, self.families)
        wide = wide.where(F.col(self.date).cast("date").isin(rolled)) if rolled else wide.limit(0)
        self._replace(spark, wide, "features", sorted({*rolled, *changed}))
        return rolled

    def _replace(self, spark: SparkSession, df: DataFrame, table: str, days: Sequence[datetime.date]) -> None:
        """Write the rows of ``days`` in place of what the table has for them."""
        path = f"{self.root}/{table}"
        # Written beside the table first, as the rows may come from other days of it.
        aside = f"{self.root}/_aside-{uuid.uuid4().hex}"
        df.withColumn(DAY, F.col(self.date).cast("date")).write.parquet(aside)
        for day in days:
            P.remove(spark, f"{path}/{DAY}={day.isoformat()}")
        fresh = spark.read.parquet(aside)
        fresh.hint("rebalance", DAY).write.mode("append").partitionBy(DAY).parquet(path)
        P.remove(spark, aside)
