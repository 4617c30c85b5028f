"""Category maps, count states and outcome labels as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from pitlog import schema as S


def lookup(key: Column, table: Mapping[str, object], default: object) -> Column:
    """Value of ``key`` in a small fixed table; NULL and unknown keys give ``default``."""
    literal = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(literal, key), F.lit(default))


def position(value: Column, values: Sequence[str]) -> Column:
    """0-based position in a fixed list, NULL outside it."""
    out = F.when(value == values[0], 0)
    for i, v in enumerate(values[1:], 1):
        out = out.when(value == v, i)
    return out


def canonical_type(code: Column, table: Mapping[str, str] = S.CANONICAL_TYPES) -> Column:
    return lookup(code, table, S.UNKNOWN_TYPE)


def pitch_family(canonical: Column) -> Column:
    return lookup(canonical, S.PITCH_FAMILY, S.DEFAULT_FAMILY)


def count_state3(balls: Column, strikes: Column) -> Column:
    """EVEN early in the count, BEHIND with more balls, AHEAD for all the rest and NULLs."""
    return (
        F.when((balls <= 1) & (strikes <= 1), "EVEN")
        .when(balls > strikes, "BEHIND")
        .otherwise("AHEAD")
    )


def capped_balls(balls: Column) -> Column:
    return F.greatest(F.least(F.coalesce(balls, F.lit(0)), F.lit(3)), F.lit(0)).cast("int")


def capped_strikes(strikes: Column) -> Column:
    return F.greatest(F.least(F.coalesce(strikes, F.lit(0)), F.lit(2)), F.lit(0)).cast("int")


def count_label12(balls: Column, strikes: Column) -> Column:
    return F.concat_ws("_", capped_balls(balls).cast("string"), capped_strikes(strikes).cast("string"))


def is_whiff(description: Column) -> Column:
    return description == S.WHIFF


def is_hit(events: Column) -> Column:
    return events.isin(*S.HIT_EVENTS)


def flag(condition: Column) -> Column:
    """1 / 0, with a NULL condition counting as 0."""
    return F.when(condition, 1).otherwise(0)


def outcome9(events: Column, description: Column) -> Column:
    """Ball-in-play class from the event, else BALL or STRIKE from the description.

    ``blocked_ball`` is no prefix match for ``ball`` and so counts as STRIKE,
    as does every text the rules do not name.
    """
    return (
        F.when(events == "home_run", "HR")
        .when(events == "triple", "3B")
        .when(events == "double", "2B")
        .when(events == "single", "1B")
        .when(events.isin("fielders_choice", "fielders_choice_out"), "FC")
        .when(events.isin("sac_fly", "sac_bunt"), "SAC")
        .when(events.isin("groundout", "flyout", "pop_out", "lineout"), "OUT")
        .when((description == "hit_by_pitch") | description.startswith("ball"), "BALL")
        .otherwise("STRIKE")
    )


def stage1_label(outcome: Column) -> Column:
    return (
        F.when(outcome.isin(*S.IN_PLAY_CLASSES), "IN_PLAY")
        .when(outcome == "BALL", "BALL")
        .otherwise("STRIKE")
    )


def in_play_label(outcome: Column) -> Column:
    """The in-play class, NULL for balls and strikes."""
    return F.when(outcome.isin(*S.IN_PLAY_CLASSES), outcome)


def outcome6(events: Column, description: Column) -> Column:
    text = F.lower(description)
    named = (
        F.when(is_hit(events), "HIT")
        .when(events.isin("walk", "intent_walk"), "WALK")
        .when(events.isin("strikeout", "strikeout_double_play"), "STRIKEOUT")
        .when(
            F.lower(events).contains("out") | events.isin("field_error", "fielders_choice"), "OUT"
        )
    )
    worded = (
        F.when(text.contains("ball") | text.contains("hit_by_pitch"), "BALL")
        .when(
            text.contains("called_strike")
            | text.contains("swinging_strike")
            | text.contains("foul"),
            "STRIKE",
        )
        .otherwise("BALL")
    )
    return F.coalesce(named, worded)


def run_value(outcome: Column) -> Column:
    """Run value of a 9-way outcome; NULL outcomes stay NULL."""
    return F.when(outcome.isNotNull(), lookup(outcome, S.RUN_VALUE, 0.0))
