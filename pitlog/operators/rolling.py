"""Daily aggregates and rolling calendar features.

One pass per entity: the raw log is aggregated straight to one wide row per
(entity, day), with every category value of every family as its own conditional
aggregate. That aggregation combines on the map side, so an entity that holds a
third of the log sends only a few rows per day and task. What follows runs on
at most one row per entity and calendar day: one exchange by entity, one sort
and one Window node serve all families and both frame lengths, and the result
is already wide, so no pivot shuffle and no family-to-family join is left.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitlog.functions import labels as L
from pitlog.operators import windows as W


@dataclass(frozen=True)
class Ratio:
    """sum(num) / sum(den) per day, then rolled up over the frame.

    Without ``den`` the divisor is the number of rows.
    ``pooled=False`` averages the daily ratios, each day counting once;
    ``pooled=True`` divides the sums over the frame, each row counting once.
    """

    name: str
    num: Column
    den: Column | None = None
    pooled: bool = False


def mean(name: str, column: str, pooled: bool = False) -> Ratio:
    c = F.col(column)
    return Ratio(name, c, F.when(c.isNotNull(), 1), pooled)


def rate(name: str, condition: Column, pooled: bool = False) -> Ratio:
    """Share of rows where the condition holds; a NULL condition counts as no."""
    return Ratio(name, L.flag(condition), None, pooled)


def boolean_rate(name: str, condition: Column, pooled: bool = False) -> Ratio:
    """As ``rate``, but NULL when no row of the day has a known condition."""
    return Ratio(name, condition.cast("int"), None, pooled)


@dataclass(frozen=True)
class Frame:
    """``days=None`` reaches back to the first day."""

    days: int | None
    with_today: bool = False

    def over(self, keys: Sequence[str], date: str) -> str:
        high = 0 if self.with_today or self.days is None else -1
        low = None if self.days is None else -(self.days - 1)
        return W.calendar_sql(keys, date, low, high)


@dataclass(frozen=True)
class Family:
    """Rolling metrics of one entity, optionally split by a category.

    ``values`` is the fixed list of category values, so the output schema does
    not depend on the data. ``shares`` adds {name}_{value} = rows of the value in
    the frame over rows of all values in the frame. ``min_rows`` blanks metrics
    whose frame holds fewer rows.
    """

    name: str
    frame: Frame
    metrics: tuple[Ratio, ...] = ()
    where: Column | None = None
    category: Column | None = None
    values: tuple[str, ...] = ()
    shares: str | None = None
    pattern: str = "{metric}_{value}"
    densify: bool = False
    min_rows: int | None = None

    def label(self, metric: str, value: str | None) -> str:
        return metric if value is None else self.pattern.format(metric=metric, value=value)

    def cells(self) -> list[tuple[str | None, str]]:
        """(category value, name stem of the cell) pairs; a cell's number is its position."""
        if self.category is None:
            return [(None, f"_{self.name}")]
        return [(v, f"_{self.name}_{v}") for v in self.values]

    def row_columns(self) -> dict[str, Column]:
        """What one log row contributes: its cell's number, and each metric's parts.

        Every aggregate tests the cell, and numbers compare faster than texts.
        """
        if self.category is None:
            inside = F.lit(0)
        else:
            inside = L.position(self.category, self.values)
        cell = inside if self.where is None else F.when(self.where, inside)
        out = {f"_{self.name}__cell": cell}
        for m in self.metrics:
            out[f"_{self.name}__{m.name}__num"] = m.num
            if m.den is not None:
                out[f"_{self.name}__{m.name}__den"] = m.den
        return out


def daily_wide(df: DataFrame, entity: str, date: str, families: Sequence[Family]) -> DataFrame:
    """One row per (entity, day) with the sums every family needs."""
    rows = df.select(
        entity, date, *[c.alias(n) for fam in families for n, c in fam.row_columns().items()]
    )
    sums = []
    for fam in families:
        for number, (_, stem) in enumerate(fam.cells()):
            here = f"`_{fam.name}__cell` = {number}"
            sums.append(f"count_if({here}) AS `{stem}__n`")
            for m in fam.metrics:
                for part in ("num", "den") if m.den is not None else ("num",):
                    source = f"`_{fam.name}__{m.name}__{part}`"
                    sums.append(f"sum(CASE WHEN {here} THEN {source} END) AS `{stem}__{m.name}__{part}`")
    return rows.groupBy(entity, date).agg(*[F.expr(s) for s in sums])


def rolling_features(
    df: DataFrame, entity: str, date: str, families: Sequence[Family]
) -> DataFrame:
    """All families of one entity as one wide table keyed by (entity, date)."""
    return rolled_days(daily_wide(df, entity, date, families), entity, date, families)


def rolled_days(days: DataFrame, entity: str, date: str, families: Sequence[Family]) -> DataFrame:
    """The families from their daily sums (``daily_wide``), which may have been kept."""
    rolled: list[str] = []
    counts: list[str] = []
    for fam in families:
        over = fam.frame.over([entity], date)
        for value, stem in fam.cells():
            n = f"`{stem}__n`"
            counts.append(n)
            rows = f"sum(nullif({n}, 0)) {over}"
            # A cell has a value only on days it was seen; densify keeps it on the others too.
            shown = "true" if fam.densify else f"{n} > 0"
            enough = shown if fam.min_rows is None else f"{shown} AND {rows} >= {fam.min_rows}"
            for m in fam.metrics:
                num = f"`{stem}__{m.name}__num`"
                den = n if m.den is None else f"`{stem}__{m.name}__den`"
                if m.pooled:
                    value_sql = f"try_divide(sum({num}) {over}, sum({den}) {over})"
                else:
                    value_sql = f"avg(try_divide({num}, {den})) {over}"
                rolled.append(f"CASE WHEN {enough} THEN {value_sql} END AS `{fam.label(m.name, value)}`")
            if fam.shares:
                rolled.append(f"CASE WHEN {shown} THEN {rows} END AS `{_total_name(fam, value)}`")

    wide = (
        days.selectExpr(entity, date, f"{' + '.join(counts)} AS _rows", *rolled).where("_rows > 0")
    )
    totals = {fam.name: {v: _total_name(fam, v) for v in fam.values} for fam in families if fam.shares}
    shares = []
    for fam in families:
        if fam.shares:
            names = totals[fam.name]
            whole = " + ".join(f"coalesce(`{c}`, 0)" for c in names.values())
            shares += [
                f"try_divide(`{c}`, {whole}) AS `{fam.label(fam.shares, v)}`"
                for v, c in names.items()
            ]
    hidden = {"_rows", *[c for names in totals.values() for c in names.values()]}
    return wide.selectExpr(*[f"`{c}`" for c in wide.columns if c not in hidden], *shares)


def _total_name(fam: Family, value: str) -> str:
    return f"_total_{fam.name}_{value}"


def daily(
    df: DataFrame,
    keys: Sequence[str],
    aggs: dict[str, Column],
    where: Column | None = None,
) -> DataFrame:
    """Long form: one row per (entity, [category], day)."""
    rows = df if where is None else df.where(where)
    return rows.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()])


def pivot_wide(
    df: DataFrame,
    index: Sequence[str],
    category: str,
    values: Sequence[str],
    metrics: Sequence[str],
    pattern: str = "{metric}_{value}",
) -> DataFrame:
    """Long to wide over a fixed value list, in one aggregation.

    (index, category) is unique in the long table, so the maximum is that one
    value and NULL where the category is absent.
    """
    cells = [
        F.max(F.when(F.col(category) == v, F.col(m))).alias(pattern.format(metric=m, value=v))
        for m in metrics
        for v in values
    ]
    return df.groupBy(*index).agg(*cells)


def densify(
    df: DataFrame, keys: Sequence[str], category: str, values: Sequence[str]
) -> DataFrame:
    """Every key with every category value, measures NULL where there was no row."""
    every = df.select(*keys).distinct().withColumn(
        category, F.explode(F.array(*[F.lit(v) for v in values]))
    )
    return every.join(df, [*keys, category], "left")
