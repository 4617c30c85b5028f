"""A pitch log derived from the ``events`` table, in Spark and in SQL.

The driver tables hold no pitches. Every event becomes one pitch through integer
arithmetic on its id and text lookups by position, so both engines build the
same log, row for row, at every scale.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitlog import schema as S
from pitlog.catalog.registry import table
from pitlog.functions import labels as L

# Texts by position; None is NULL. They cover every branch of the label rules.
TYPE_CODES = [
    "FF", "SL", "CH", "FF", "SI", "SL", "CU", "FC", "KC", "FS", "ST",
    "SV", "FA", "FT", "CS", "SW", "KN", "XX", None,
]
DESCRIPTIONS = [
    "ball", "called_strike", "swinging_strike", "foul", "hit_into_play", "blocked_ball",
    "swinging_strike_blocked", "foul_tip", "hit_by_pitch", "swinging_strike", None,
]
EVENTS = [
    "single", "double", "triple", "home_run", "field_out", "groundout", "flyout", "lineout",
    "pop_out", "fielders_choice", "fielders_choice_out", "sac_fly", "sac_bunt", "walk",
    "intent_walk", "strikeout", "strikeout_double_play", "field_error", "",
] + [None] * 12


def _pick(values: list[str | None], index: Column) -> Column:
    return F.array(*[F.lit(v) for v in values])[index.cast("int")]


def pitches(spark: SparkSession, sf_dir: str, canonical=S.CANONICAL_TYPES) -> DataFrame:
    e = F.col("event_id")

    def null_each(n: int, value: Column) -> Column:
        return F.when(e % n != 0, value)

    k = F.get_json_object("props", "$.k").cast("bigint")
    raw = table(spark, sf_dir, "events").select(
        "event_id", "user_id", "value", F.to_date("ts").alias("game_date"), k.alias("k")
    )
    k = F.col("k")
    return raw.select(
        F.col("user_id").alias("pitcher"),
        k.alias("batter"),
        "game_date",
        F.datediff("game_date", F.lit("2024-01-01").cast("date")).cast("bigint").alias("game_pk"),
        F.floor(e / 4).alias("at_bat_number"),
        (e % 4 + 1).cast("bigint").alias("pitch_number"),
        F.concat(F.lit("T"), k % 30).alias("home_team"),
        F.when(F.col("user_id") % 2 == 0, "L").otherwise("R").alias("p_throws"),
        null_each(37, F.when(k % 2 == 0, "L").otherwise("R")).alias("stand"),
        _pick(TYPE_CODES, (e * 7 + k) % len(TYPE_CODES)).alias("pitch_type"),
        null_each(23, F.col("value")).alias("release_speed"),
        null_each(17, F.col("value") * 10).alias("release_spin_rate"),
        null_each(29, e % 5).alias("balls"),
        null_each(31, F.floor(e / 5) % 4).alias("strikes"),
        _pick(DESCRIPTIONS, e % len(DESCRIPTIONS)).alias("description"),
        _pick(EVENTS, (e * 3 + k) % len(EVENTS)).alias("events"),
        F.when(e % 4 == 1, F.col("value") / 500).alias("estimated_woba_using_speedangle"),
        null_each(43, e % 11 + 1).alias("inning"),
        null_each(41, e % 3).alias("outs_when_up"),
        F.when(e % 3 == 0, k).when(e % 7 == 0, F.lit(1)).alias("on_1b"),
        F.when(e % 8 == 0, k).alias("on_2b"),
        F.when(e % 13 == 0, k).alias("on_3b"),
        (e % 6).alias("home_score"),
        null_each(47, e % 4).alias("away_score"),
    ).withColumn("pitch_type_can", L.canonical_type(F.col("pitch_type"), canonical))


def _sql_list(values: list[str | None]) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


def _sql_pick(values: list[str | None], index: str) -> str:
    return f"({_sql_list(values)})[CAST(({index}) % {len(values)} AS INTEGER) + 1]"


def canonical_case(column: str, mapping: dict[str, str]) -> str:
    by_target: dict[str, list[str]] = {}
    for code, target in mapping.items():
        by_target.setdefault(target, []).append(code)
    whens = " ".join(
        f"WHEN {column} IN ({', '.join(repr(c) for c in codes)}) THEN '{target}'"
        for target, codes in by_target.items()
    )
    return f"CASE {whens} ELSE 'OTHER' END"


def pitches_sql(canonical: dict[str, str] = S.CANONICAL_TYPES) -> str:
    """The text ``ev AS (...), pitches AS (...)`` to put behind WITH."""
    return f"""ev AS (
  SELECT event_id AS e, user_id, value, CAST(ts AS DATE) AS game_date,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events),
raw_pitches AS (
  SELECT user_id AS pitcher, k AS batter, game_date,
    CAST(game_date - DATE '2024-01-01' AS BIGINT) AS game_pk,
    e // 4 AS at_bat_number, e % 4 + 1 AS pitch_number,
    'T' || CAST(k % 30 AS VARCHAR) AS home_team,
    CASE WHEN user_id % 2 = 0 THEN 'L' ELSE 'R' END AS p_throws,
    CASE WHEN e % 37 = 0 THEN NULL WHEN k % 2 = 0 THEN 'L' ELSE 'R' END AS stand,
    {_sql_pick(TYPE_CODES, "e * 7 + k")} AS pitch_type,
    CASE WHEN e % 23 <> 0 THEN value END AS release_speed,
    CASE WHEN e % 17 <> 0 THEN value * 10 END AS release_spin_rate,
    CASE WHEN e % 29 <> 0 THEN e % 5 END AS balls,
    CASE WHEN e % 31 <> 0 THEN (e // 5) % 4 END AS strikes,
    {_sql_pick(DESCRIPTIONS, "e")} AS description,
    {_sql_pick(EVENTS, "e * 3 + k")} AS events,
    CASE WHEN e % 4 = 1 THEN value / 500 END AS estimated_woba_using_speedangle,
    CASE WHEN e % 43 <> 0 THEN e % 11 + 1 END AS inning,
    CASE WHEN e % 41 <> 0 THEN e % 3 END AS outs_when_up,
    CASE WHEN e % 3 = 0 THEN k WHEN e % 7 = 0 THEN 1 END AS on_1b,
    CASE WHEN e % 8 = 0 THEN k END AS on_2b,
    CASE WHEN e % 13 = 0 THEN k END AS on_3b,
    e % 6 AS home_score,
    CASE WHEN e % 47 <> 0 THEN e % 4 END AS away_score
  FROM ev),
pitches AS (
  SELECT *, {canonical_case("pitch_type", canonical)} AS pitch_type_can FROM raw_pitches)"""


KEY = list(S.PITCH_KEY)
KEY_SQL = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in KEY)
