"""Train / validation / test splits and samples.

Nothing here sorts the log or numbers its rows. An exact position in an order is
found by counting: one aggregation per sort column narrows the search to the
group that holds the position, and only the boundary values come back.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitlog.operators.joins import between_dates


@dataclass(frozen=True)
class SortKey:
    """A sort expression. ``shifts`` splits a wide integer into several counting
    steps, coarse to fine, so that no step counts more than about a million groups."""

    value: Column
    shifts: tuple[int, ...] = (0,)

    def steps(self) -> list[Column]:
        return [
            F.shiftright(self.value.cast("bigint"), s) if s else self.value for s in self.shifts
        ]


LONG_KEY = (44, 24, 4, 0)
ROW_NUMBER_KEY = (16, 0)


def value_at(df: DataFrame, order: Sequence[SortKey], position: int) -> list[object]:
    """The sort values of the row at 1-based ``position``; NULL sorts first."""
    scope, left, found = df, position, []
    for key in order:
        value = None
        for step in key.steps():
            counts = scope.groupBy(step.alias("v")).agg(F.count(F.lit(1)).alias("n"))
            upto = F.sum("n").over(Window.orderBy("v"))
            row = (
                counts.select("v", "n", upto.alias("upto"))
                .where(F.col("upto") >= left)
                .orderBy("v")
                .first()
            )
            if row is None:
                raise ValueError(f"no row at position {position}")
            value = row["v"]
            left -= row["upto"] - row["n"]
            scope = scope.where(step.eqNullSafe(F.lit(value)))
        found.append(value)
    return found


def at_or_before(order: Sequence[SortKey], boundary: Sequence[object]) -> Column:
    """Row comparison with the boundary, written so that its first column can be pushed down.

    NULL sorts first, so the condition is never NULL and its negation has all other rows.
    """
    test: Column | None = None
    for key, value in reversed(list(zip(order, boundary))):
        missing = key.value.isNull()
        if value is None:
            before, upto = F.lit(False), missing
        else:
            before, upto = missing | (key.value < F.lit(value)), missing | (key.value <= F.lit(value))
        test = upto if test is None else upto & (before | test)
    return test


def first_fraction(df: DataFrame, order: Sequence[SortKey], fraction: float) -> Column:
    """Condition for the first floor(fraction * rows) rows of the order."""
    wanted = int(fraction * df.count())
    if wanted < 1:
        return F.lit(False)
    return at_or_before(order, value_at(df, order, wanted))


def pitch_order(date: str = "game_date") -> list[SortKey]:
    return [
        SortKey(F.col(date)),
        SortKey(F.col("game_pk"), ROW_NUMBER_KEY),
        SortKey(F.col("at_bat_number"), ROW_NUMBER_KEY),
        SortKey(F.col("pitch_number"), ROW_NUMBER_KEY),
    ]


def sample_rows(
    df: DataFrame, key: Sequence[str], n: int, seed: int = 42, rows: int | None = None
) -> DataFrame:
    """Exactly ``n`` rows (all, if fewer) by smallest hash of the row key.

    The pick depends on key and seed only, not on how the rows are partitioned,
    so a lost executor recomputes the same sample. ``rows`` is the number of rows, if known.
    """
    rows = df.count() if rows is None else rows
    if n >= rows:
        return df
    order = _hash_order(key, seed)
    return df.where(at_or_before(order, value_at(df, order, n))) if n > 0 else df.limit(0)


def sample_fraction(
    df: DataFrame, key: Sequence[str], fraction: float, seed: int = 42
) -> DataFrame:
    """int(fraction * rows) rows without replacement."""
    rows = df.count()
    return sample_rows(df, key, int(rows * fraction), seed, rows)


def _hash_order(key: Sequence[str], seed: int) -> list[SortKey]:
    mixed = F.xxhash64(F.lit(seed), *key)
    return [SortKey(mixed, LONG_KEY), *[SortKey(F.col(k), ROW_NUMBER_KEY) for k in key]]


def label_ranges(df: DataFrame, date: str, ranges: Mapping[str, Sequence[str]]) -> DataFrame:
    """Column ``split`` from inclusive ``start:end`` ranges; rows outside all are dropped.

    Earlier names win where ranges overlap.
    """
    label: Column | None = None
    for name, spans in ranges.items():
        inside = F.lit(False)
        for span in spans:
            inside = inside | between_dates(date, span)
        label = F.when(inside, name) if label is None else label.when(inside, name)
    return df.withColumn("split", label).where(F.col("split").isNotNull())


def seasons(df: DataFrame, date: str) -> list[int]:
    """Years in the log, ascending: one aggregation, at most one row per calendar year."""
    rows = df.where(F.col(date).isNotNull()).select(F.year(date).alias("y")).distinct()
    return sorted(r["y"] for r in rows.collect())


def auto_split(
    df: DataFrame, date: str = "game_date", order: Sequence[SortKey] | None = None
) -> DataFrame:
    """Column ``split`` by the seasons the log holds.

    Three or more: test is the last (April to June), val the one before, train
    the rest (both April to September). Two: the first season's April to
    September rows split 80 / 20 in time order, the second is test.
    """
    years = seasons(df, date)
    if len(years) < 2:
        raise ValueError("a temporal split needs two seasons")
    test = {"test": [f"{years[-1]}-04-01:{years[-1]}-06-30"]}

    def summer(ys: Sequence[int]) -> list[str]:
        return [f"{y}-04-01:{y}-09-30" for y in ys]

    if len(years) >= 3:
        spans = {"train": summer(years[:-2]), "val": summer(years[-2:-1]), **test}
        return label_ranges(df, date, spans)
    labelled = label_ranges(df, date, {"train": summer(years[:1]), **test})
    order = order or pitch_order(date)
    early = first_fraction(labelled.where(F.col("split") == "train"), order, 0.8)
    return labelled.withColumn(
        "split", F.when((F.col("split") == "train") & ~early, "val").otherwise(F.col("split"))
    )


def day_blocks(df: DataFrame, blocks: int, date: str = "game_date") -> Column:
    """The block 0, 1, ... of each row: days in order, cut where a block's share of rows is full.

    A day goes whole into the block of its first row, so no block sees part of a day that another
    one has; a block may stay empty if one day holds more than its share. Rows without a date are
    in block 0. One count per calendar day reaches the driver.
    """
    days = df.groupBy(F.col(date).cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    rows = days.orderBy(F.asc_nulls_first("day")).collect()
    total, upto, starts, last = sum(r["n"] for r in rows), 0, [], 0
    for r in rows:
        block = blocks * upto // total
        if block > last and r["day"] is not None:
            starts += [r["day"]] * (block - last)
            last = block
        upto += r["n"]
    out = F.lit(0)
    for start in starts:
        out = out + (F.col(date).cast("date") >= F.lit(start)).cast("int")
    return F.when(F.col(date).isNull(), 0).otherwise(out).cast("int")
