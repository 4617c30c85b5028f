"""The named feature families of a pitch log, and the full tables built from them.

Column names are part of the contract. ``*_30D`` / ``*_7D`` / ``*_TD`` families
include the current day; the lower-case ones end the day before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitlog import schema as S
from pitlog.functions import labels as L
from pitlog.functions.frames import keep
from pitlog.operators.joins import attach_features, crosswalk_join, park_factor_join
from pitlog.operators.rolling import Family, Frame, boolean_rate, mean, rate, rolling_features
from pitlog.operators.sequence import BLOCK_WIDTH, running_features

PRIOR_30 = Frame(30)
PRIOR_7 = Frame(7)
WITH_30 = Frame(30, with_today=True)
WITH_7 = Frame(7, with_today=True)
TO_DATE = Frame(None, with_today=True)

GAME = ("pitcher", "game_pk")
IN_GAME = ("at_bat_number", "pitch_number")
XWOBA = "estimated_woba_using_speedangle"


def _cols() -> dict[str, Column]:
    return {
        "whiff": L.is_whiff(F.col("description")),
        "hit": L.is_hit(F.col("events")),
        "state": L.count_state3(F.col("balls"), F.col("strikes")),
        "pt": F.col("pitch_type_can"),
        "stand": F.col("stand"),
    }


# --- families that end the day before ---------------------------------------


def arsenal_family(
    min_rows: int | None = None, densify: bool = False, shares: str | None = None, **how
) -> Family:
    c = _cols()
    return Family(
        "arsenal",
        PRIOR_30,
        (
            mean("velocity_30d", "release_speed", **how),
            mean("spin_rate_30d", "release_spin_rate", **how),
            rate("whiff_rate_30d", c["whiff"], **how),
        ),
        where=F.col("release_speed").isNotNull() & F.col("release_spin_rate").isNotNull(),
        category=c["pt"],
        values=S.PITCH_TYPES,
        shares=shares,
        min_rows=min_rows,
        densify=densify,
    )


def arsenal_and_usage() -> Family:
    """F1 and F2 over the same cells, so their counts are taken once."""
    return arsenal_family(shares="usage_30d")


def usage_family() -> Family:
    return Family(
        "usage",
        PRIOR_30,
        where=F.col("release_speed").isNotNull() & F.col("release_spin_rate").isNotNull(),
        category=_cols()["pt"],
        values=S.PITCH_TYPES,
        shares="usage_30d",
    )


def count_state_family(min_rows: int | None = None, **how) -> Family:
    c = _cols()
    return Family(
        "count",
        PRIOR_30,
        (rate("whiff_rate_30d", c["whiff"], **how), rate("contact_rate_30d", c["hit"], **how)),
        category=c["state"],
        values=S.COUNT_STATES,
        min_rows=min_rows,
    )


def form_family(min_rows: int | None = None, **how) -> Family:
    c = _cols()
    return Family(
        "form",
        PRIOR_7,
        (
            mean("velocity_7d", "release_speed", **how),
            rate("whiff_rate_7d", c["whiff"], **how),
            rate("hit_rate_7d", c["hit"], **how),
        ),
        where=F.col("release_speed").isNotNull(),
        min_rows=min_rows,
    )


def platoon_family(min_rows: int | None = None, **how) -> Family:
    c = _cols()
    return Family(
        "platoon",
        PRIOR_30,
        (
            rate("whiff_rate_30d", c["whiff"], **how),
            rate("hit_rate_30d", c["hit"], **how),
            mean("xwoba_30d", XWOBA, **how),
        ),
        where=c["stand"].isNotNull(),
        category=c["stand"],
        values=S.SIDES,
        pattern="{metric}_vs_{value}",
        min_rows=min_rows,
    )


def batter_xwoba_family(min_rows: int | None = None, **how) -> Family:
    return Family(
        "bxwoba",
        PRIOR_30,
        (mean("batter_xwoba_30d", XWOBA, **how),),
        where=F.col(XWOBA).isNotNull(),
        category=_cols()["pt"],
        values=S.PITCH_TYPES,
        min_rows=min_rows,
    )


def k_rate_family(min_rows: int | None = None) -> Family:
    """Whiffs over pitches, pooled over the frame."""
    return Family(
        "krate", PRIOR_30, (rate("k_rate_30d", _cols()["whiff"], pooled=True),), min_rows=min_rows
    )


# --- families that include the current day ------------------------------------


def k_pct_families() -> list[Family]:
    whiff = _cols()["whiff"]
    return [
        Family("ktd", TO_DATE, (boolean_rate("K_PCT_TD", whiff, pooled=True),)),
        Family("k30", WITH_30, (boolean_rate("K_PCT_30D", whiff, pooled=True),)),
    ]


def arsenal_to_date_families() -> list[Family]:
    c = _cols()
    split = {"category": c["pt"], "values": S.PITCH_TYPES}
    return [
        Family(
            "atd",
            TO_DATE,
            (mean("V_TD", "release_speed"), mean("SPIN_TD", "release_spin_rate")),
            shares="USAGE_TD",
            **split,
        ),
        Family(
            "a30", WITH_30, (boolean_rate("WHIFF_30", c["whiff"]),), shares="USAGE_30", **split
        ),
    ]


def count_state_with_today_family() -> Family:
    c = _cols()
    return Family(
        "c30",
        WITH_30,
        (boolean_rate("WHIFF_30", c["whiff"]), boolean_rate("CONTACT_30", c["hit"])),
        category=c["state"],
        values=S.COUNT_STATES,
    )


def form_with_today_family() -> Family:
    c = _cols()
    return Family(
        "f7",
        WITH_7,
        (
            boolean_rate("WHIFF_7D", c["whiff"]),
            mean("VELO_7D", "release_speed"),
            boolean_rate("HIT_7D", c["hit"]),
        ),
    )


def batter_xwoba_to_date_families() -> list[Family]:
    split = {"category": _cols()["pt"], "values": S.PITCH_TYPES}
    return [
        Family("xtd", TO_DATE, (mean("XWOBA_TD", XWOBA),), **split),
        Family("x30", WITH_30, (mean("XWOBA_30", XWOBA),), **split),
    ]


def platoon_with_today_family() -> Family:
    c = _cols()
    return Family(
        "p30",
        WITH_30,
        (
            boolean_rate("WHIFF_30", c["whiff"]),
            boolean_rate("HIT_30", c["hit"]),
            mean("XWOBA_30", XWOBA),
        ),
        category=c["stand"],
        values=S.SIDES,
        pattern="{metric}_VS_{value}",
    )


PITCHER_PRIOR = (arsenal_and_usage, count_state_family, form_family, platoon_family)
BATTER_PRIOR = (batter_xwoba_family, k_rate_family)


def pitcher_prior(df: DataFrame) -> DataFrame:
    """F1-F5 as one (pitcher, game_date) table."""
    return rolling_features(df, "pitcher", "game_date", [f() for f in PITCHER_PRIOR])


def batter_prior(df: DataFrame) -> DataFrame:
    """F6 and F7 as one (batter, game_date) table."""
    return rolling_features(df, "batter", "game_date", [f() for f in BATTER_PRIOR])


def pitcher_with_today(df: DataFrame) -> DataFrame:
    families = [
        *arsenal_to_date_families(),
        count_state_with_today_family(),
        form_with_today_family(),
        platoon_with_today_family(),
    ]
    return rolling_features(df, "pitcher", "game_date", families)


def batter_with_today(df: DataFrame) -> DataFrame:
    families = [*k_pct_families(), *batter_xwoba_to_date_families()]
    return rolling_features(df, "batter", "game_date", families)


# --- within-game sequences -----------------------------------------------------


def _typed(code: str, column: str) -> Column:
    return F.when(F.col("pitch_type_can") == code, F.col(column))


def _lags(prefix: str, depth: int, column: str = "pitch_type_can") -> dict[str, tuple[str, int]]:
    return {f"{prefix}{k}": (column, k) for k in range(1, depth + 1)}


def _difference(df: DataFrame, name: str, newer: str, older: str, drop: Sequence[str]) -> DataFrame:
    return df.withColumn(name, F.col(newer) - F.col(older)).drop(*drop)


def within_game(
    df: DataFrame, speed: str = "velocity", block_width: int | None = BLOCK_WIDTH
) -> DataFrame:
    """Running counts and means, four type lags, and the last velocity step.

    ``dvelo1`` is the step between the two pitches before the current one.
    """
    out = running_features(
        df,
        GAME,
        IN_GAME,
        row_count="cum_game_pitches",
        counts={f"cum_{t.lower()}_count": F.col("pitch_type_can") == t for t in ("FF", "SL", "CH")},
        means=_running_means(speed),
        lags={
            **_lags("prev_pitch_", 4),
            "_v1": ("release_speed", 1),
            "_v2": ("release_speed", 2),
        },
        block_width=block_width,
    )
    return _difference(out, "dvelo1", "_v1", "_v2", ["_v1", "_v2"])


def _running_means(speed: str) -> dict[str, Column]:
    out = {}
    for t in ("FF", "SL", "CH"):
        out[f"cum_{t.lower()}_{speed}"] = _typed(t, "release_speed")
        out[f"cum_{t.lower()}_spin"] = _typed(t, "release_spin_rate")
    return out


def within_game_cumulative(df: DataFrame, block_width: int | None = BLOCK_WIDTH) -> DataFrame:
    """The cumulative build's form: ``_velo`` names, two lags.

    Its velocity step uses the current pitch; it is named ``dvelo_current`` so
    that no model takes it for the leak-free ``dvelo1``.
    """
    out = running_features(
        df,
        GAME,
        IN_GAME,
        row_count="cum_game_pitches",
        counts={f"cum_{t.lower()}_count": F.col("pitch_type_can") == t for t in ("FF", "SL", "CH")},
        means=_running_means("velo"),
        lags={**_lags("prev_pt", 2), "_v1": ("release_speed", 1)},
        block_width=block_width,
    )
    return _difference(out, "dvelo_current", "release_speed", "_v1", ["_v1"])


def lag_block(df: DataFrame, depth: int = 4, block_width: int | None = BLOCK_WIDTH) -> DataFrame:
    """Type lags and the current velocity step, on rows already filtered by date."""
    out = running_features(
        df,
        GAME,
        IN_GAME,
        lags={**_lags("prev_pitch_", depth), "_v1": ("release_speed", 1)},
        block_width=block_width,
    )
    return _difference(out, "dvelo_current", "release_speed", "_v1", ["_v1"])


def sequence_block(
    df: DataFrame, depth: int = 5, block_width: int | None = BLOCK_WIDTH
) -> DataFrame:
    """Lags of type, balls and strikes, and ``depth`` velocity steps.

    ``dvelo_current`` is the step into the current pitch; ``dvelo2`` and on lie
    wholly before it.
    """
    speeds = {f"_v{k}": ("release_speed", k) for k in range(1, depth + 1)}
    out = running_features(
        df,
        GAME,
        IN_GAME,
        lags={
            **_lags("prev_pt", depth),
            **_lags("prev_balls", depth, "balls"),
            **_lags("prev_strikes", depth, "strikes"),
            **speeds,
        },
        block_width=block_width,
    )
    steps = {"dvelo_current": F.col("release_speed") - F.col("_v1")}
    for k in range(2, depth + 1):
        steps[f"dvelo{k}"] = F.col(f"_v{k - 1}") - F.col(f"_v{k}")
    return out.withColumns(steps).drop(*speeds)


def _type_id(code: Column, vocabulary: Sequence[str], padding: int) -> Column:
    return L.lookup(code, {c: i for i, c in enumerate(vocabulary)}, padding)


def sequence_arrays(df: DataFrame, depth: int = 5, include_current: bool = False) -> DataFrame:
    """``sequence_block`` columns to oldest-first arrays and a target id.

    The velocity steps are those between earlier pitches. ``include_current=True`` moves them by
    one and ends with the step into the current pitch, which is known only once it is thrown.
    Rows whose target is NULL or outside the vocabulary are dropped.
    """
    target = F.try_element_at(
        F.create_map(*[F.lit(x) for i, c in enumerate(S.SEQUENCE_TYPES) for x in (c, i)]),
        F.col("pitch_type_can"),
    )
    known = [F.col(f"dvelo{k}") for k in range(2, depth + 1)]
    steps = [F.col("dvelo_current"), *known] if include_current else [*known, F.lit(0.0)]

    def oldest_first(columns: Sequence[Column]) -> Column:
        return F.reverse(F.array(*columns))

    ks = range(1, depth + 1)
    return df.withColumns(
        {
            "seq_types": oldest_first(
                [_type_id(F.col(f"prev_pt{k}"), S.SEQUENCE_TYPES, S.SEQUENCE_PAD) for k in ks]
            ),
            "seq_balls": oldest_first([F.coalesce(F.col(f"prev_balls{k}"), F.lit(0)) for k in ks]),
            "seq_strikes": oldest_first(
                [F.coalesce(F.col(f"prev_strikes{k}"), F.lit(0)) for k in ks]
            ),
            "seq_dvelo": oldest_first([F.coalesce(c, F.lit(0.0)) for c in steps]),
            "target_id": target,
        }
    ).where(F.col("target_id").isNotNull())


def slot_arrays(df: DataFrame, include_current: bool = False, slots: int = 5) -> DataFrame:
    """Newest-first type ids of ``slots`` pitches, and the context vector.

    ``include_current=True`` puts the current pitch, that is the target, into
    slot 0. The default starts with the previous pitch and pads the last slot.
    OTHER targets are dropped. Needs ``prev_pitch_1`` to ``prev_pitch_4`` and a
    velocity step named ``dvelo1`` or ``dvelo_current``.
    """
    def slot(column: str) -> Column:
        return _type_id(F.col(column), S.SLOT_TYPES, S.SLOT_PAD)

    ids = [slot(f"prev_pitch_{k}") for k in range(1, slots)]
    ids = [slot("pitch_type_can"), *ids] if include_current else [*ids, F.lit(S.SLOT_PAD)]
    step = "dvelo1" if "dvelo1" in df.columns else "dvelo_current"
    context = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("balls", "strikes", step)]
    return df.where(F.col("pitch_type_can").isin(*S.SLOT_TYPES)).withColumns(
        {
            "slot_ids": F.array(*ids),
            "context": F.array(*context),
            "target_id": slot("pitch_type_can"),
        }
    )


# --- full tables -----------------------------------------------------------------


def prepare(
    raw: DataFrame,
    crosswalk: DataFrame | None = None,
    table=S.CANONICAL_TYPES,
    columns: Sequence[str] = S.FEATURE_KEEP,
) -> DataFrame:
    """Keep-list, date cast, canonical type and player ids.

    The offline table keeps more of the raw log: ``columns=S.OFFLINE_KEEP``.
    """
    out = keep(raw, columns).withColumns(
        {
            "game_date": F.to_date("game_date"),
            "pitch_type_can": L.canonical_type(F.col("pitch_type"), table),
        }
    )
    if crosswalk is not None:
        out = crosswalk_join(out, crosswalk, "batter", "batter_fg")
        out = crosswalk_join(out, crosswalk, "pitcher", "pitcher_fg")
    return out


def historical_table(pitches: DataFrame, block_width: int | None = BLOCK_WIDTH) -> DataFrame:
    """Every pitch with F8, the pitcher and batter features of its day, and the count label."""
    fact = within_game(pitches, block_width=block_width)
    fact = attach_features(fact, pitcher_prior(pitches), ["pitcher", "game_date"])
    fact = attach_features(fact, batter_prior(pitches), ["batter", "game_date"])
    return fact.withColumn("count_state", L.count_label12(F.col("balls"), F.col("strikes")))


def offline_table(pitches: DataFrame, parks: DataFrame | None = None) -> DataFrame:
    """Every pitch with the to-date and including-today features and, if known, its park factor."""
    fact = attach_features(pitches, batter_with_today(pitches), ["batter", "game_date"])
    fact = attach_features(fact, pitcher_with_today(pitches), ["pitcher", "game_date"])
    return park_factor_join(fact, parks)


def cumulative_table(pitches: DataFrame) -> DataFrame:
    return within_game_cumulative(pitches)
