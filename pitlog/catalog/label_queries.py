"""Row-level queries: maps, flags, outcomes, filters, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitlog import schema as S
from pitlog.catalog.registry import query, r6, table, tidy
from pitlog.catalog.standin import KEY, KEY_SQL, canonical_case, pitches, pitches_sql
from pitlog.functions import labels as L
from pitlog.functions.frames import fill, to_number
from pitlog.functions.situation import situational_flags
from pitlog.functions.weights import class_weight, time_decay
from pitlog.operators import joins as J
from pitlog.operators import profile as P
from pitlog.operators import splits as SP

WITH = f"WITH {pitches_sql()}"

BALLS = "LEAST(GREATEST(COALESCE(balls, 0), 0), 3)"
STRIKES = "LEAST(GREATEST(COALESCE(strikes, 0), 0), 2)"
COUNT_LABEL = f"CAST({BALLS} AS VARCHAR) || '_' || CAST({STRIKES} AS VARCHAR)"
STATE3 = (
    "CASE WHEN balls <= 1 AND strikes <= 1 THEN 'EVEN' WHEN balls > strikes THEN 'BEHIND' "
    "ELSE 'AHEAD' END"
)
FAMILY = (
    "CASE WHEN pitch_type_can IN ('FF','SI','FC') THEN 'FB' "
    "WHEN pitch_type_can IN ('CH','FS','ST') THEN 'OS' ELSE 'BR' END"
)
OUTCOME9 = """CASE WHEN events = 'home_run' THEN 'HR' WHEN events = 'triple' THEN '3B'
  WHEN events = 'double' THEN '2B' WHEN events = 'single' THEN '1B'
  WHEN events IN ('fielders_choice_out', 'fielders_choice') THEN 'FC'
  WHEN events IN ('sac_fly', 'sac_bunt') THEN 'SAC'
  WHEN events IN ('groundout', 'flyout', 'pop_out', 'lineout') THEN 'OUT'
  WHEN description = 'hit_by_pitch' OR description LIKE 'ball%' THEN 'BALL'
  ELSE 'STRIKE' END"""
OUTCOME6 = """CASE WHEN events IN ('single','double','triple','home_run') THEN 'HIT'
  WHEN events IN ('walk','intent_walk') THEN 'WALK'
  WHEN events IN ('strikeout','strikeout_double_play') THEN 'STRIKEOUT'
  WHEN events <> '' AND (lower(events) LIKE '%out%'
       OR events IN ('field_error','fielders_choice')) THEN 'OUT'
  WHEN lower(description) LIKE '%ball%' OR lower(description) LIKE '%hit_by_pitch%' THEN 'BALL'
  WHEN lower(description) LIKE '%called_strike%' OR lower(description) LIKE '%swinging_strike%'
       OR lower(description) LIKE '%foul%' THEN 'STRIKE'
  ELSE 'BALL' END"""
RUN_VALUE_CASE = """CASE outcome WHEN 'HR' THEN 1.44 WHEN '3B' THEN 1.03 WHEN '2B' THEN 0.78
  WHEN '1B' THEN 0.47 WHEN 'FC' THEN 0.30 WHEN 'SAC' THEN 0.02 WHEN 'OUT' THEN -0.27
  WHEN 'BALL' THEN 0.33 ELSE 0.0 END"""


def _rows(spark, sf_dir, **columns):
    df = pitches(spark, sf_dir)
    return tidy(df.select(*KEY, *[c.alias(n) for n, c in columns.items()]))


@query(
    "canon_map",
    f"""{WITH} SELECT {KEY_SQL},
  {canonical_case("pitch_type", S.CANONICAL_TYPES)} AS prior_map,
  {canonical_case("pitch_type", S.CANONICAL_TYPES)} AS running_map,
  {canonical_case("pitch_type", S.CANONICAL_TYPES_TO_DATE)} AS to_date_map
FROM pitches""",
)
def canon_map(spark, sf_dir):
    code = F.col("pitch_type")
    return _rows(
        spark,
        sf_dir,
        prior_map=L.canonical_type(code),
        running_map=L.canonical_type(code, S.CANONICAL_TYPES_RUNNING),
        to_date_map=L.canonical_type(code, S.CANONICAL_TYPES_TO_DATE),
    )


@query("family_map", f"{WITH} SELECT {KEY_SQL}, {FAMILY} AS family FROM pitches")
def family_map(spark, sf_dir):
    return _rows(spark, sf_dir, family=L.pitch_family(F.col("pitch_type_can")))


@query("count_state3", f"{WITH} SELECT {KEY_SQL}, {STATE3} AS state FROM pitches")
def count_state3(spark, sf_dir):
    return _rows(spark, sf_dir, state=L.count_state3(F.col("balls"), F.col("strikes")))


@query("count_label12", f"{WITH} SELECT {KEY_SQL}, {COUNT_LABEL} AS count_state FROM pitches")
def count_label12(spark, sf_dir):
    return _rows(spark, sf_dir, count_state=L.count_label12(F.col("balls"), F.col("strikes")))


def _flag(condition: str) -> str:
    return f"CAST(CASE WHEN {condition} THEN 1 ELSE 0 END AS BIGINT)"


_DIFF = "COALESCE(home_score, 0) - COALESCE(away_score, 0)"


@query(
    "situational_flags",
    f"""{WITH} SELECT {KEY_SQL}, {COUNT_LABEL} AS count_state,
  {_flag('''COALESCE(outs_when_up, 0) >= 2 AND (COALESCE(on_1b, 0) = 1
      OR COALESCE(on_2b, 0) = 1 OR COALESCE(on_3b, 0) = 1)''')} AS high_leverage,
  CAST({_DIFF} AS BIGINT) AS score_diff,
  {_flag(f"abs({_DIFF}) <= 2")} AS close_game,
  {_flag(f"{BALLS} < {STRIKES} OR ({BALLS} = 0 AND {STRIKES} = 2)")} AS ahead_in_count,
  {_flag(f"{BALLS} > {STRIKES}")} AS behind_in_count,
  {_flag(f"{STRIKES} = 2")} AS two_strike_count,
  {_flag(f"{BALLS} = 3")} AS three_ball_count,
  {_flag(f"{BALLS} = 3 AND {STRIKES} = 2")} AS full_count,
  {_flag("COALESCE(inning, 1) >= 7")} AS late_inning,
  {_flag("COALESCE(inning, 1) >= 10")} AS extra_innings,
  {_flag("on_1b IS NOT NULL OR on_2b IS NOT NULL OR on_3b IS NOT NULL")} AS runners_on
FROM pitches""",
)
def situation(spark, sf_dir):
    return _rows(spark, sf_dir, **situational_flags(pitches(spark, sf_dir)))


def _outcome():
    return L.outcome9(F.col("events"), F.col("description"))


@query("outcome9", f"{WITH} SELECT {KEY_SQL}, {OUTCOME9} AS outcome FROM pitches")
def outcome9(spark, sf_dir):
    return _rows(spark, sf_dir, outcome=_outcome())


@query(
    "stage_labels",
    f"""{WITH}, o AS (SELECT *, {OUTCOME9} AS outcome FROM pitches)
SELECT {KEY_SQL},
  CASE WHEN outcome IN ('BALL', 'STRIKE') THEN outcome ELSE 'IN_PLAY' END AS stage1,
  CASE WHEN outcome NOT IN ('BALL', 'STRIKE') THEN outcome END AS in_play
FROM o""",
)
def stage_labels(spark, sf_dir):
    return _rows(
        spark, sf_dir, stage1=L.stage1_label(_outcome()), in_play=L.in_play_label(_outcome())
    )


@query("outcome6", f"{WITH} SELECT {KEY_SQL}, {OUTCOME6} AS outcome FROM pitches")
def outcome6(spark, sf_dir):
    return _rows(spark, sf_dir, outcome=L.outcome6(F.col("events"), F.col("description")))


@query(
    "run_value",
    f"""{WITH}, o AS (SELECT *, {OUTCOME9} AS outcome FROM pitches)
SELECT {KEY_SQL}, outcome, {r6(RUN_VALUE_CASE)} AS run_value FROM o""",
)
def run_value(spark, sf_dir):
    return _rows(spark, sf_dir, outcome=_outcome(), run_value=L.run_value(_outcome()))


@query(
    "date_between",
    """SELECT CAST(l_suppkey AS BIGINT) AS l_suppkey, COUNT(*) AS n,
  CAST(MIN(CAST(l_shipdate AS DATE)) AS VARCHAR) AS first_date,
  CAST(MAX(CAST(l_shipdate AS DATE)) AS VARCHAR) AS last_date
FROM lineitem WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '1994-01-01' AND DATE '1995-06-30'
GROUP BY 1""",
)
def date_between(spark, sf_dir):
    log = table(spark, sf_dir, "lineitem").withColumn("day", F.to_date("l_shipdate"))
    kept = log.where(J.between_dates("day", "1994-01-01:1995-06-30"))
    return tidy(
        kept.groupBy("l_suppkey").agg(
            F.count(F.lit(1)).alias("n"),
            F.min("day").alias("first_date"),
            F.max("day").alias("last_date"),
        )
    )


@query(
    "union_ranges",
    """SELECT CAST(l_suppkey AS BIGINT) AS l_suppkey, COUNT(*) AS n, """
    + r6("SUM(l_quantity)")
    + """ AS quantity FROM (
  SELECT * FROM lineitem WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '1993-04-01' AND DATE '1993-09-30'
  UNION ALL
  SELECT * FROM lineitem WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '1995-04-01' AND DATE '1995-09-30'
  UNION ALL
  SELECT * FROM lineitem WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '1995-08-01' AND DATE '1996-01-31')
GROUP BY 1""",
)
def union_ranges(spark, sf_dir):
    log = table(spark, sf_dir, "lineitem").withColumn("day", F.to_date("l_shipdate"))
    spans = [
        ("1993-04-01", "1993-09-30"), ("1995-04-01", "1995-09-30"), ("1995-08-01", "1996-01-31"),
    ]
    both = J.union_ranges(log, spans, "day")
    return tidy(
        both.groupBy("l_suppkey").agg(
            F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity")
        )
    )


@query(
    "sparsity_filter",
    f"""{WITH}, s AS (SELECT AVG(CASE WHEN estimated_woba_using_speedangle IS NULL THEN 1.0 ELSE 0 END) AS share
  FROM pitches)
SELECT {KEY_SQL}, {r6("estimated_woba_using_speedangle")} AS estimated_woba_using_speedangle
FROM pitches WHERE (SELECT share FROM s) <= 0.3 OR estimated_woba_using_speedangle IS NOT NULL""",
)
def sparsity_filter(spark, sf_dir):
    target = "estimated_woba_using_speedangle"
    return tidy(P.sparse_target(pitches(spark, sf_dir), target).select(*KEY, target))


@query(
    "min_count_eligible",
    f"""{WITH}, n AS (SELECT pitcher, COUNT(pitch_type_can) AS n_rows FROM pitches GROUP BY 1)
SELECT {KEY_SQL}, CAST(pitcher AS BIGINT) AS pitcher, n_rows
FROM pitches JOIN n USING (pitcher) WHERE n_rows >= 68""",
)
def min_count_eligible(spark, sf_dir):
    kept = J.eligible_by_count(pitches(spark, sf_dir), "pitcher", 68, "pitch_type_can")
    return tidy(kept.select(*KEY, "pitcher", "n_rows"))


@query(
    "temporal_80_20",
    f"""{WITH}, o AS (SELECT *, ROW_NUMBER() OVER (ORDER BY game_date, game_pk, at_bat_number,
    pitch_number) AS rn, COUNT(*) OVER () AS n FROM pitches)
SELECT {KEY_SQL}, CASE WHEN rn <= floor(0.8 * n) THEN 'train' ELSE 'val' END AS split FROM o""",
)
def temporal_80_20(spark, sf_dir):
    log = pitches(spark, sf_dir)
    early = SP.first_fraction(log, SP.pitch_order(), 0.8)
    return tidy(log.select(*KEY, F.when(early, "train").otherwise("val").alias("split")))


@query(
    "auto_split",
    """WITH d AS (SELECT CAST(l_shipdate AS DATE) AS day FROM lineitem),
y AS (SELECT DISTINCT year(day) AS y FROM d),
r AS (SELECT y, ROW_NUMBER() OVER (ORDER BY y DESC) AS back FROM y),
s AS (SELECT day, CASE
    WHEN back = 1 AND month(day) BETWEEN 4 AND 6 THEN 'test'
    WHEN back = 2 AND month(day) BETWEEN 4 AND 9 THEN 'val'
    WHEN back > 2 AND month(day) BETWEEN 4 AND 9 THEN 'train' END AS split
  FROM d JOIN r ON year(day) = r.y)
SELECT split, COUNT(*) AS n, CAST(MIN(day) AS VARCHAR) AS first_date,
  CAST(MAX(day) AS VARCHAR) AS last_date
FROM s WHERE split IS NOT NULL GROUP BY 1""",
)
def auto_split(spark, sf_dir):
    log = table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("game_date"))
    return tidy(
        SP.auto_split(log)
        .groupBy("split")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("game_date").alias("first_date"),
            F.max("game_date").alias("last_date"),
        )
    )


@query(
    "sample_size",
    """SELECT 'fraction' AS kind, CAST(floor(COUNT(*) * 0.1) AS BIGINT) AS n,
  CAST(floor(COUNT(*) * 0.1) AS BIGINT) AS distinct_rows FROM events
UNION ALL SELECT 'rows', LEAST(COUNT(*), 777), LEAST(COUNT(*), 777) FROM events""",
)
def sample_size(spark, sf_dir):
    """Exact sample sizes without replacement; which rows are picked is the hash's choice."""
    log = table(spark, sf_dir, "events")
    picks = {
        "fraction": SP.sample_fraction(log, ["event_id"], 0.1),
        "rows": SP.sample_rows(log, ["event_id"], 777),
    }
    counted = [
        d.agg(
            F.lit(kind).alias("kind"),
            F.count(F.lit(1)).alias("n"),
            F.countDistinct("event_id").alias("distinct_rows"),
        )
        for kind, d in picks.items()
    ]
    return tidy(counted[0].unionByName(counted[1]))


@query(
    "time_decay",
    f"""{WITH}, m AS (SELECT MAX(game_date) AS latest FROM pitches)
SELECT {KEY_SQL},
  {r6("exp(-0.0008 * date_diff('day', game_date, (SELECT latest FROM m)))")} AS w
FROM pitches""",
)
def decay(spark, sf_dir):
    log = pitches(spark, sf_dir)
    latest = log.agg(F.max("game_date")).scalar()
    return tidy(log.select(*KEY, time_decay(F.col("game_date"), latest).alias("w")))


@query(
    "class_time_weight",
    f"""{WITH}, m AS (SELECT MAX(game_date) AS latest FROM pitches)
SELECT {KEY_SQL}, pitch_type_can,
  {r6('''CASE pitch_type_can WHEN 'FS' THEN 2.0 WHEN 'OTHER' THEN 2.0 WHEN 'KC' THEN 1.5
    WHEN 'FC' THEN 1.3 ELSE 1.0 END * exp(-0.0008 * date_diff('day', game_date, (SELECT latest FROM m)))''')} AS w
FROM pitches""",
)
def class_time_weight(spark, sf_dir):
    log = pitches(spark, sf_dir)
    latest = log.agg(F.max("game_date")).scalar()
    label = F.col("pitch_type_can")
    weight = class_weight(label) * time_decay(F.col("game_date"), latest)
    return tidy(log.select(*KEY, label, weight.alias("w")))


@query(
    "text_to_number",
    """SELECT CAST(event_id AS BIGINT) AS event_id, """
    + r6("COALESCE(TRY_CAST(CASE WHEN event_id % 5 = 0 THEN event_type ELSE CAST(value AS VARCHAR) END AS DOUBLE), -1)")
    + """ AS number FROM events""",
)
def text_to_number(spark, sf_dir):
    mixed = F.when(F.col("event_id") % 5 == 0, F.col("event_type")).otherwise(
        F.col("value").cast("string")
    )
    log = table(spark, sf_dir, "events").select("event_id", mixed.alias("number"))
    return tidy(fill(to_number(log, ["number"]), {"number": -1.0}))
