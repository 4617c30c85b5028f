"""Time-travel audit: rolling features recomputed from the log cut at their day.

For (entity, day) pairs picked by hash, every family is computed again from the log's rows of the
days its frame reaches, and from no window: pairs meet rows through a join on entity and a bucket
of days, then rows are added up by day and days by pair. A feature that saw a later row, or its
own day where it should not, differs from that; so does one that missed a row. The join's size is
the picked share of pairs times the rows of one frame, and a bucket of days bounds what one
entity brings into a task, however much of the log it holds.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitlog.operators.rolling import Family, Frame
from pitlog.plans.audits import _report

BUCKET_DAYS = 32
TOLERANCE = 1e-6


def picked(entity: str, date: str, share: float) -> Column:
    """Whether a pair belongs to the audited share: its MD5's first four digits are low enough."""
    name = F.concat_ws(":", F.col(entity).cast("string"), F.col(date).cast("date").cast("string"))
    mark = F.conv(F.substring(F.md5(name.cast("binary")), 1, 4), 16, 10).cast("int")
    return mark < int(share * 65536)


def _inside(frame: Frame) -> str:
    """SQL condition on ``_ago``, the days from a row to the pair's day."""
    first = 0 if frame.with_today or frame.days is None else 1
    return f"_ago >= {first}" if frame.days is None else f"_ago BETWEEN {first} AND {frame.days - 1}"


def _met(log: DataFrame, pairs: DataFrame, entity: str, date: str, families: Sequence[Family]) -> DataFrame:
    """Each pair with the rows of its frames: (entity, date, _row_day, columns of the families)."""
    columns = {n: c for fam in families for n, c in fam.row_columns().items()}
    rows = log.select(
        F.col(entity), F.unix_date(F.col(date).cast("date")).alias("_row"), *[c.alias(n) for n, c in columns.items()]
    )
    asked = pairs.withColumn("_day", F.unix_date(F.col(date).cast("date")))
    reach = [fam.frame.days for fam in families]
    keys = [entity]
    if None not in reach:
        most = max(reach) - 1
        rows = rows.withColumn("_bucket", F.floor(F.col("_row") / BUCKET_DAYS))
        first, last = F.floor((F.col("_day") - most) / BUCKET_DAYS), F.floor(F.col("_day") / BUCKET_DAYS)
        asked = asked.withColumn("_bucket", F.explode(F.sequence(first, last)))
        keys.append("_bucket")
    met = rows.join(asked, keys).where(F.col("_row") <= F.col("_day"))
    if None not in reach:
        met = met.where(F.col("_row") >= F.col("_day") - most)
    return met.withColumn("_ago", F.col("_day") - F.col("_row")).select(entity, date, "_ago", *columns)


def recomputed(
    log: DataFrame, pairs: DataFrame, entity: str, date: str, families: Sequence[Family]
) -> DataFrame:
    """The features of ``families`` for ``pairs`` (distinct entity and date), from the log's rows."""
    by_day, out = [], []
    for fam in families:
        inside = _inside(fam.frame)
        for number, (value, stem) in enumerate(fam.cells()):
            here = f"`_{fam.name}__cell` = {number}"
            by_day.append(f"count_if({here}) AS `{stem}__n`")
            seen = f"sum(CASE WHEN {inside} THEN `{stem}__n` END)"
            today = f"coalesce(max(CASE WHEN _ago = 0 THEN `{stem}__n` END), 0) > 0"
            shown = "true" if fam.densify else today
            enough = shown if fam.min_rows is None else f"{shown} AND {seen} >= {fam.min_rows}"
            for m in fam.metrics:
                parts = {}
                for part in ("num", "den") if m.den is not None else ("num",):
                    parts[part] = f"`{stem}__{m.name}__{part}`"
                    source = f"`_{fam.name}__{m.name}__{part}`"
                    by_day.append(f"sum(CASE WHEN {here} THEN {source} END) AS {parts[part]}")
                num, den = parts["num"], parts.get("den", f"`{stem}__n`")
                if m.pooled:
                    value_sql = f"try_divide(sum(CASE WHEN {inside} THEN {num} END), sum(CASE WHEN {inside} THEN {den} END))"
                else:
                    value_sql = f"avg(CASE WHEN {inside} THEN try_divide({num}, {den}) END)"
                out.append(f"CASE WHEN {enough} THEN {value_sql} END AS `{fam.label(m.name, value)}`")
        if fam.shares:
            counts = {v: f"sum(CASE WHEN {inside} THEN `{stem}__n` END)" for v, stem in fam.cells()}
            whole = " + ".join(f"coalesce({_shown(fam, v)}, 0)" for v in counts)
            for v in counts:
                out.append(f"try_divide({_shown(fam, v)}, {whole}) AS `{fam.label(fam.shares, v)}`")
    met = _met(log, pairs, entity, date, families)
    days = met.groupBy(entity, date, "_ago").agg(*[F.expr(s) for s in dict.fromkeys(by_day)])
    return days.groupBy(entity, date).agg(*[F.expr(s) for s in out])


def _shown(fam: Family, value: str) -> str:
    """Rows of a cell in the frame, on days that have the cell."""
    stem = dict(fam.cells())[value]
    seen = f"sum(CASE WHEN {_inside(fam.frame)} THEN nullif(`{stem}__n`, 0) END)"
    if fam.densify:
        return seen
    return f"CASE WHEN coalesce(max(CASE WHEN _ago = 0 THEN `{stem}__n` END), 0) > 0 THEN {seen} END"


def columns_of(families: Sequence[Family]) -> list[str]:
    out = []
    for fam in families:
        for value, _ in fam.cells():
            out += [fam.label(m.name, value) for m in fam.metrics]
        out += [fam.label(fam.shares, v) for v in fam.values] if fam.shares else []
    return out


def time_travel(
    table: DataFrame,
    log: DataFrame,
    entity: str,
    families: Sequence[Family],
    date: str = "game_date",
    share: float = 0.05,
    tolerance: float = TOLERANCE,
    features: Sequence[str] | None = None,
) -> DataFrame:
    """Report rows: for each feature the audited (entity, day) pairs at which ``table`` differs.

    ``table`` may have several rows a pair, such as one a pitch; a pair counts if any of them
    differs. Values agree within ``tolerance``, and NULL with NULL.
    """
    names = [c for c in (features or columns_of(families)) if c in table.columns]
    sample = table.where(picked(entity, date, share)).select(entity, date, *names)
    own = [f"_own_{i}" for i in range(len(names))]
    again = recomputed(log, sample.select(entity, date).distinct(), entity, date, families)
    again = again.select(entity, date, *[F.col(f"`{c}`").alias(o) for c, o in zip(names, own)])
    both = sample.join(again, [entity, date], "left")

    def differs(name: str, other: str) -> Column:
        a, b = F.col(f"`{name}`").cast("double"), F.col(other).cast("double")
        return F.when(a.isNull() | b.isNull(), a.isNull() != b.isNull()).otherwise(F.abs(a - b) > tolerance)

    pairs = both.groupBy(entity, date).agg(*[F.max(differs(c, o)).alias(c) for c, o in zip(names, own)])
    return _report("time_travel", pairs.agg(*[F.count_if(f"`{c}`").alias(c) for c in names]), names)


def time_travel_all(
    table: DataFrame,
    log: DataFrame,
    by_entity: dict[str, Sequence[Family]],
    date: str = "game_date",
    share: float = 0.05,
) -> DataFrame:
    """The audit of the families of several entities as one report."""
    parts = [time_travel(table, log, e, families, date, share) for e, families in by_entity.items()]
    return reduce(DataFrame.unionByName, parts)
