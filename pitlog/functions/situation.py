"""Game-situation flags of one pitch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitlog.functions import labels as L


def _or_zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def situational_flags(df: DataFrame) -> dict[str, Column]:
    """The eleven situation outputs, plus ``runners_on``.

    ``high_leverage`` tests the base columns for the value 1, although they hold
    runner ids; ``runners_on`` is the flag that reads them as ids.
    Columns a log lacks (away score, inning) take their NULL fill.
    """
    balls = L.capped_balls(F.col("balls"))
    strikes = L.capped_strikes(F.col("strikes"))
    inning = F.coalesce(F.col("inning"), F.lit(1)) if "inning" in df.columns else F.lit(1)
    away = _or_zero("away_score") if "away_score" in df.columns else F.lit(0)
    diff = _or_zero("home_score") - away
    base_is_one = (_or_zero("on_1b") == 1) | (_or_zero("on_2b") == 1) | (_or_zero("on_3b") == 1)
    any_runner = (
        F.col("on_1b").isNotNull() | F.col("on_2b").isNotNull() | F.col("on_3b").isNotNull()
    )
    return {
        "count_state": L.count_label12(F.col("balls"), F.col("strikes")),
        "high_leverage": L.flag((_or_zero("outs_when_up") >= 2) & base_is_one),
        "score_diff": diff,
        "close_game": L.flag(F.abs(diff) <= 2),
        "ahead_in_count": L.flag((balls < strikes) | ((balls == 0) & (strikes == 2))),
        "behind_in_count": L.flag(balls > strikes),
        "two_strike_count": L.flag(strikes == 2),
        "three_ball_count": L.flag(balls == 3),
        "full_count": L.flag((balls == 3) & (strikes == 2)),
        "late_inning": L.flag(inning >= 7),
        "extra_innings": L.flag(inning >= 10),
        "runners_on": L.flag(any_runner),
    }


def with_situation(df: DataFrame) -> DataFrame:
    return df.withColumns(situational_flags(df))
