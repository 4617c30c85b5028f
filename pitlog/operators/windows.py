"""Calendar and sequence window frames.

Calendar frames order by whole days, so several rows of one date share a frame
and a bound of n days means n calendar days, not n rows. They are meant for
rows already aggregated to one per key and day: a window partition then holds at
most one row per calendar day, however large the key is in the raw log.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def _day(date: str) -> Column:
    return F.unix_date(F.col(date).cast("date"))


def prior_days(keys: Sequence[str], date: str, days: int) -> WindowSpec:
    """The ``days`` - 1 calendar days before the row's day, without that day."""
    return Window.partitionBy(*keys).orderBy(_day(date)).rangeBetween(-(days - 1), -1)


def days_through(keys: Sequence[str], date: str, days: int) -> WindowSpec:
    """The ``days`` calendar days that end with the row's day."""
    return Window.partitionBy(*keys).orderBy(_day(date)).rangeBetween(-(days - 1), 0)


def to_date(keys: Sequence[str], date: str) -> WindowSpec:
    """Everything up to and with the row's day."""
    return (
        Window.partitionBy(*keys)
        .orderBy(_day(date))
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )


def before_row(keys: Sequence[str], order: Sequence[str]) -> WindowSpec:
    """All earlier rows of the sequence, without the row itself."""
    return (
        Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )


def in_order(keys: Sequence[str], order: Sequence[str]) -> WindowSpec:
    """The same sequence without a frame, as lag needs it."""
    return Window.partitionBy(*keys).orderBy(*order)


def within(keys: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys)


# The same frames as SQL text, for selects that generate many columns: one parsed
# expression costs the driver far fewer gateway calls than a tree of Column objects.


def calendar_sql(keys: Sequence[str], date: str, low: int | None, high: int) -> str:
    """OVER (...) text of a calendar frame; ``low``/``high`` in days, ``None`` unbounded."""
    def bound(days: int) -> str:
        return "CURRENT ROW" if days == 0 else f"{-days} PRECEDING"

    start = "UNBOUNDED PRECEDING" if low is None else bound(low)
    return (
        f"OVER (PARTITION BY {_names(keys)} ORDER BY unix_date(CAST({_name(date)} AS DATE)) "
        f"RANGE BETWEEN {start} AND {bound(high)})"
    )


def sequence_sql(keys: Sequence[str], order: Sequence[str], rows: str = "") -> str:
    """OVER (...) text of a sequence; ``rows`` is the frame, empty for lag and lead."""
    frame = f" ROWS BETWEEN {rows}" if rows else ""
    return f"OVER (PARTITION BY {_names(keys)} ORDER BY {_names(order)}{frame})"


def _name(column: str) -> str:
    return f"`{column}`"


def _names(columns: Sequence[str]) -> str:
    return ", ".join(_name(c) for c in columns)
