"""Windows, pivots, joins and the feature families."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitlog import schema as S
from pitlog.catalog import feature_sql as Q
from pitlog.catalog.label_queries import COUNT_LABEL
from pitlog.catalog.registry import query, r6, table, tidy
from pitlog.catalog.standin import KEY, KEY_SQL, pitches, pitches_sql
from pitlog.functions import labels as L
from pitlog.operators import joins as J
from pitlog.operators import rolling as R
from pitlog.operators import windows as W
from pitlog.operators.rolling import rolling_features
from pitlog.operators.sequence import running_features
from pitlog.plans import features as P
from pitlog.sources.readers import build_crosswalk

# --- window primitives on lineitem: supplier x return flag x ship day ---------

LINE_DAY = """d AS (SELECT l_suppkey, l_returnflag, CAST(l_shipdate AS DATE) AS day,
  COUNT(*) AS n, AVG(l_quantity) AS q FROM lineitem GROUP BY ALL)"""
LINE_KEYS = ["l_suppkey", "l_returnflag"]


def _line_days(spark, sf_dir):
    log = table(spark, sf_dir, "lineitem").withColumn("day", F.to_date("l_shipdate"))
    return R.daily(
        log,
        [*LINE_KEYS, "day"],
        {"n": F.count(F.lit(1)), "q": F.avg("l_quantity")},
    )


def _line_sql(frame: str) -> str:
    over = f"OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY day {frame})"
    return f"""WITH {LINE_DAY} SELECT CAST(l_suppkey AS BIGINT) AS l_suppkey, l_returnflag,
  CAST(day AS VARCHAR) AS day, {r6(f"AVG(q) {over}")} AS mean_quantity,
  CAST(SUM(n) {over} AS DOUBLE) AS n_rows FROM d"""


def _line_query(name, frame, window):
    @query(name, _line_sql(frame))
    def run(spark, sf_dir):
        w = window(LINE_KEYS, "day")
        return tidy(
            _line_days(spark, sf_dir).select(
                *LINE_KEYS,
                "day",
                F.avg("q").over(w).alias("mean_quantity"),
                F.sum("n").over(w).alias("n_rows"),
            ),
            maybe=["n_rows"],
        )


_line_query("prior_30d", Q.W30, lambda k, d: W.prior_days(k, d, 30))
_line_query("prior_7d", Q.W7, lambda k, d: W.prior_days(k, d, 7))
_line_query("incl_30d", Q.W30_TODAY, lambda k, d: W.days_through(k, d, 30))
_line_query("incl_7d", Q.W7_TODAY, lambda k, d: W.days_through(k, d, 7))
_line_query("to_date", Q.TO_DATE, W.to_date)


@query(
    "share_within_day",
    f"""WITH {LINE_DAY} SELECT CAST(l_suppkey AS BIGINT) AS l_suppkey, l_returnflag,
  CAST(day AS VARCHAR) AS day,
  {r6("n::DOUBLE / SUM(n) OVER (PARTITION BY l_suppkey, day)")} AS share FROM d""",
)
def share_within_day(spark, sf_dir):
    whole = F.sum("n").over(W.within(["l_suppkey", "day"]))
    return tidy(
        _line_days(spark, sf_dir).select(
            *LINE_KEYS, "day", F.try_divide(F.col("n"), whole).alias("share")
        )
    )


@query(
    "line_rolling",
    f"""WITH {LINE_DAY},
w AS (SELECT *, AVG(q) OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY day {Q.W30}) AS q30,
  SUM(n) OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY day {Q.W30}) AS n30 FROM d),
s AS (SELECT *, n30::DOUBLE / NULLIF(SUM(n30) OVER (PARTITION BY l_suppkey, day), 0) AS u30 FROM w)
SELECT CAST(l_suppkey AS BIGINT) AS l_suppkey, CAST(day AS VARCHAR) AS day
  {"".join(f''', {r6(f"MAX(CASE WHEN l_returnflag = '{v}' THEN q30 END)")} AS quantity_30d_{v},
  {r6(f"MAX(CASE WHEN l_returnflag = '{v}' THEN u30 END)")} AS share_30d_{v}''' for v in "ANR")}
FROM s GROUP BY l_suppkey, day""",
)
def line_rolling(spark, sf_dir):
    """The one-pass rolling engine on another log: supplier, ship day, return flag."""
    log = table(spark, sf_dir, "lineitem").withColumn("day", F.to_date("l_shipdate"))
    family = R.Family(
        "line",
        R.Frame(30),
        (R.mean("quantity_30d", "l_quantity"),),
        category=F.col("l_returnflag"),
        values=("A", "N", "R"),
        shares="share_30d",
    )
    return tidy(rolling_features(log, "l_suppkey", "day", [family]))


# --- aggregates and pivots on the pitch log ----------------------------------

_ARSENAL_DAILY = Q.daily(
    "d", "pitcher", "pitch_type_can",
    {"cnt": "COUNT(*)", "velocity": "AVG(release_speed)", "spin_rate": "AVG(release_spin_rate)",
     "whiff_rate": Q.WHIFF},
    Q.SPEED_SPIN,
)


def _arsenal_daily(spark, sf_dir):
    known = F.col("release_speed").isNotNull() & F.col("release_spin_rate").isNotNull()
    return R.daily(
        pitches(spark, sf_dir),
        ["pitcher", "game_date", "pitch_type_can"],
        {
            "cnt": F.count(F.lit(1)),
            "velocity": F.avg("release_speed"),
            "spin_rate": F.avg("release_spin_rate"),
            "whiff_rate": F.avg(L.flag(L.is_whiff(F.col("description")))),
        },
        known,
    )


@query(
    "daily_arsenal",
    f"""WITH {pitches_sql()}, {_ARSENAL_DAILY}
SELECT pitcher, CAST(game_date AS VARCHAR) AS game_date, cat AS pitch_type_can, cnt
  {Q.reals(["velocity", "spin_rate", "whiff_rate"])} FROM d""",
)
def daily_arsenal(spark, sf_dir):
    return tidy(_arsenal_daily(spark, sf_dir))


@query(
    "rate_float",
    f"""WITH {pitches_sql()} SELECT pitcher, {r6(Q.WHIFF)} AS rate, {r6(Q.WHIFF_BOOL)} AS bool_rate,
  CAST(SUM(CASE WHEN description = 'swinging_strike' THEN 1 ELSE 0 END) AS BIGINT) AS hits,
  CAST(SUM((description = 'swinging_strike')::INT) AS DOUBLE) AS bool_hits
FROM pitches GROUP BY pitcher""",
)
def rate_float(spark, sf_dir):
    """Conditional count against boolean sum: they differ where all texts are NULL."""
    whiff = L.is_whiff(F.col("description"))
    return tidy(
        pitches(spark, sf_dir).groupBy("pitcher").agg(
            (F.sum(L.flag(whiff)) / F.count(F.lit(1))).alias("rate"),
            (F.sum(whiff.cast("int")) / F.count(F.lit(1))).alias("bool_rate"),
            F.sum(L.flag(whiff)).alias("hits"),
            F.sum(whiff.cast("int")).alias("bool_hits"),
        ),
        ["bool_hits"],
    )


@query(
    "pivot_arsenal",
    f"""WITH {pitches_sql()}, {_ARSENAL_DAILY},
{Q.wide("p", "d", "pitcher", S.PITCH_TYPES, ["velocity", "whiff_rate"])}
SELECT pitcher, CAST(game_date AS VARCHAR) AS game_date
{Q.reals(Q.names(["velocity", "whiff_rate"], S.PITCH_TYPES))} FROM p""",
)
def pivot_arsenal(spark, sf_dir):
    daily = _arsenal_daily(spark, sf_dir)
    return tidy(
        R.pivot_wide(
            daily, ["pitcher", "game_date"], "pitch_type_can", S.PITCH_TYPES, ["velocity", "whiff_rate"]
        )
    )


@query(
    "pivot_platoon",
    f"""WITH {pitches_sql()},
{Q.daily("d", "pitcher", "stand", {"hit_rate": Q.HIT, "xwoba": Q.XWOBA}, "stand IS NOT NULL")},
{Q.wide("p", "d", "pitcher", S.SIDES, ["hit_rate", "xwoba"], Q.VS)}
SELECT pitcher, CAST(game_date AS VARCHAR) AS game_date
{Q.reals(Q.names(["hit_rate", "xwoba"], S.SIDES, Q.VS))} FROM p""",
)
def pivot_platoon(spark, sf_dir):
    daily = R.daily(
        pitches(spark, sf_dir),
        ["pitcher", "game_date", "stand"],
        {
            "hit_rate": F.avg(L.flag(L.is_hit(F.col("events")))),
            "xwoba": F.avg("estimated_woba_using_speedangle"),
        },
        F.col("stand").isNotNull(),
    )
    wide = R.pivot_wide(
        daily, ["pitcher", "game_date"], "stand", S.SIDES, ["hit_rate", "xwoba"],
        "{metric}_vs_{value}",
    )
    return tidy(wide)


@query(
    "densified_days",
    f"""WITH {pitches_sql()}, {_ARSENAL_DAILY},
k AS (SELECT DISTINCT pitcher, game_date FROM d),
v AS (SELECT unnest([{", ".join(repr(t) for t in S.PITCH_TYPES)}]) AS cat)
SELECT k.pitcher, CAST(k.game_date AS VARCHAR) AS game_date, v.cat AS pitch_type_can,
  CAST(d.cnt AS DOUBLE) AS cnt, {r6("d.velocity")} AS velocity
FROM k CROSS JOIN v LEFT JOIN d ON d.pitcher = k.pitcher AND d.game_date = k.game_date AND d.cat = v.cat""",
)
def densified_days(spark, sf_dir):
    daily = _arsenal_daily(spark, sf_dir).select(
        "pitcher", "game_date", "pitch_type_can", "cnt", "velocity"
    )
    return tidy(R.densify(daily, ["pitcher", "game_date"], "pitch_type_can", S.PITCH_TYPES), ["cnt"])


# --- sequences ------------------------------------------------------------------

_RUN_ITEMS, _RUN_REAL = Q.running_columns("velocity")


@query(
    "running_in_game",
    f"""WITH {pitches_sql()}, r AS (SELECT *, {", ".join(_RUN_ITEMS)} FROM pitches)
SELECT {KEY_SQL}, pitcher, cum_game_pitches{Q.maybe(Q.COUNTS)}{Q.reals(_RUN_REAL)} FROM r""",
)
def running_in_game(spark, sf_dir):
    out = P.within_game(pitches(spark, sf_dir))
    return tidy(out.select(*KEY, "pitcher", "cum_game_pitches", *Q.COUNTS, *_RUN_REAL), Q.COUNTS)


_LONG = "PARTITION BY p_throws ORDER BY at_bat_number, pitch_number"
_LONG_BEFORE = f"OVER ({_LONG} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query(
    "running_long_sequence",
    f"""WITH {pitches_sql()}, r AS (SELECT *, COUNT(*) {_LONG_BEFORE} AS seen,
  CAST(SUM(CASE WHEN pitch_type_can = 'FF' THEN 1 ELSE 0 END) {_LONG_BEFORE} AS DOUBLE) AS ff_seen,
  AVG(release_speed) {_LONG_BEFORE} AS mean_speed,
  LAG(pitch_type_can, 1) OVER ({_LONG}) AS prev_1, LAG(pitch_type_can, 3) OVER ({_LONG}) AS prev_3,
  LAG(release_speed, 2) OVER ({_LONG}) AS speed_2 FROM pitches)
SELECT {KEY_SQL}, p_throws, seen, ff_seen, prev_1, prev_3{Q.reals(["mean_speed", "speed_2"])} FROM r""",
)
def running_long_sequence(spark, sf_dir):
    """Two sequences that hold half the log each, so blocks and carries do the work."""
    out = running_features(
        pitches(spark, sf_dir),
        ["p_throws"],
        ["at_bat_number", "pitch_number"],
        row_count="seen",
        counts={"ff_seen": F.col("pitch_type_can") == "FF"},
        means={"mean_speed": F.col("release_speed")},
        lags={"prev_1": ("pitch_type_can", 1), "prev_3": ("pitch_type_can", 3),
              "speed_2": ("release_speed", 2)},
        block_width=256,
    )
    return tidy(
        out.select(*KEY, "p_throws", "seen", "ff_seen", "prev_1", "prev_3", "mean_speed", "speed_2"),
        ["ff_seen"],
    )


@query(
    "lag_block",
    f"""WITH {pitches_sql()}, b AS (SELECT * FROM pitches
  WHERE game_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'),
r AS (SELECT *, {", ".join(Q.type_lags("prev_pitch_", 4))},
  release_speed - LAG(release_speed, 1) {Q.LAG} AS dvelo_current FROM b)
SELECT {KEY_SQL}, pitcher{Q.texts(Q.LAGS4)}{Q.reals(["dvelo_current"])} FROM r""",
)
def lag_block(spark, sf_dir):
    log = pitches(spark, sf_dir).where(J.between_dates("game_date", "2024-01-05:2024-01-20"))
    return tidy(P.lag_block(log).select(*KEY, "pitcher", *Q.LAGS4, "dvelo_current"))


@query(
    "velocity_delta",
    f"""WITH {pitches_sql()}, r AS (SELECT *,
  LAG(release_speed, 1) {Q.LAG} - LAG(release_speed, 2) {Q.LAG} AS dvelo1 FROM pitches)
SELECT {KEY_SQL}, pitcher{Q.reals(["dvelo1"])} FROM r""",
)
def velocity_delta(spark, sf_dir):
    return tidy(P.within_game(pitches(spark, sf_dir)).select(*KEY, "pitcher", "dvelo1"))


# --- joins ------------------------------------------------------------------------


def _crosswalk(spark, sf_dir):
    """Supplier keys as player ids, one of them twice."""
    s = table(spark, sf_dir, "supplier")
    ids = s.select(
        F.col("s_suppkey").alias("mlbam"), (F.col("s_suppkey") * 10 + F.col("s_nationkey")).alias("fg")
    )
    return ids.unionByName(ids.where("mlbam % 7 = 0").withColumn("fg", F.col("fg") + 100_000))


@query(
    "crosswalk_join",
    f"""WITH {pitches_sql()}, x AS (SELECT s_suppkey AS mlbam, MIN(s_suppkey * 10 + s_nationkey) AS fg
  FROM supplier GROUP BY 1)
SELECT {KEY_SQL}, CAST(xb.fg AS DOUBLE) AS batter_fg, CAST(xp.fg AS DOUBLE) AS pitcher_fg
FROM pitches LEFT JOIN x xb ON batter = xb.mlbam LEFT JOIN x xp ON pitcher = xp.mlbam""",
)
def crosswalk_join(spark, sf_dir):
    ids = _crosswalk(spark, sf_dir)
    out = J.crosswalk_join(pitches(spark, sf_dir), ids, "batter", "batter_fg")
    out = J.crosswalk_join(out, ids, "pitcher", "pitcher_fg")
    return tidy(out.select(*KEY, "batter_fg", "pitcher_fg"), ["batter_fg", "pitcher_fg"])


def _parks(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(
        F.concat(F.lit("T"), F.col("n_nationkey")).alias("home_team"),
        (F.lit(0.9) + F.col("n_regionkey") * 0.05).alias("PF"),
    )


@query(
    "park_factor_join",
    f"""WITH {pitches_sql()} SELECT {KEY_SQL}, home_team, {r6("0.9 + n_regionkey * 0.05")} AS "PF"
FROM pitches LEFT JOIN nation ON home_team = 'T' || CAST(n_nationkey AS VARCHAR)""",
)
def park_factor_join(spark, sf_dir):
    out = J.park_factor_join(pitches(spark, sf_dir), _parks(spark, sf_dir))
    return tidy(out.select(*KEY, "home_team", "PF"))


@query(
    "feature_join",
    f"""WITH {pitches_sql()}, {Q.family_ctes(["form", "k_rate"])},
{Q.joined_cte("j", "pitches", ["form", "k_rate"])}
SELECT {KEY_SQL}{Q.reals(["velocity_7d", "whiff_rate_7d", "hit_rate_7d", "k_rate_30d"])} FROM j""",
)
def feature_join(spark, sf_dir):
    log = pitches(spark, sf_dir)
    form = rolling_features(log, "pitcher", "game_date", [P.form_family()])
    k_rate = rolling_features(log, "batter", "game_date", [P.k_rate_family()])
    out = J.attach_features(log, form, ["pitcher", "game_date"])
    out = J.attach_features(out, k_rate, ["batter", "game_date"])
    return tidy(out.select(*KEY, "velocity_7d", "whiff_rate_7d", "hit_rate_7d", "k_rate_30d"))


@query(
    "group_max_back",
    f"""WITH {pitches_sql()} SELECT {KEY_SQL},
  MAX(pitch_number) OVER (PARTITION BY game_pk, at_bat_number) AS ab_end_pitch FROM pitches""",
)
def group_max_back(spark, sf_dir):
    out = J.broadcast_back_max(
        pitches(spark, sf_dir), ["game_pk", "at_bat_number"], "pitch_number", "ab_end_pitch"
    )
    return tidy(out.select(*KEY, "ab_end_pitch"))


@query(
    "matching_rows",
    f"""WITH {pitches_sql()} SELECT {KEY_SQL}, description FROM pitches
WHERE pitch_type IS NOT NULL AND release_speed IS NOT NULL""",
)
def matching_rows(spark, sf_dir):
    log = pitches(spark, sf_dir)
    kept = log.dropna(subset=["pitch_type", "release_speed"])
    return tidy(J.matching_rows(log, kept, KEY).select(*KEY, "description"))


# --- families ----------------------------------------------------------------------


def _family_query(name: str, sql_family: str, entity: str, families) -> None:
    @query(name, Q.family_sql(sql_family))
    def run(spark, sf_dir):
        return tidy(rolling_features(pitches(spark, sf_dir), entity, "game_date", families()))


_family_query("f01_arsenal", "arsenal", "pitcher", lambda: [P.arsenal_family()])
_family_query("f02_usage", "usage", "pitcher", lambda: [P.usage_family()])
_family_query("f03_count_state", "count_state", "pitcher", lambda: [P.count_state_family()])
_family_query("f04_form", "form", "pitcher", lambda: [P.form_family()])
_family_query("f05_platoon", "platoon", "pitcher", lambda: [P.platoon_family()])
_family_query("f06_batter_xwoba", "batter_xwoba", "batter", lambda: [P.batter_xwoba_family()])
_family_query("f07_k_rate", "k_rate", "batter", lambda: [P.k_rate_family()])
_family_query("f10_k_pct", "k_pct", "batter", P.k_pct_families)
_family_query("f11_arsenal_to_date", "arsenal_td", "pitcher", P.arsenal_to_date_families)
_family_query(
    "f12_count_state_today", "count_state_today", "pitcher", lambda: [P.count_state_with_today_family()]
)
_family_query("f13_form_today", "form_today", "pitcher", lambda: [P.form_with_today_family()])
_family_query("f14_batter_xwoba_to_date", "batter_xwoba_td", "batter", P.batter_xwoba_to_date_families)
_family_query(
    "f15_platoon_today", "platoon_today", "pitcher", lambda: [P.platoon_with_today_family()]
)


@query(
    "f08_within_game",
    f"""WITH {pitches_sql()}, {Q.running_cte()}
SELECT {KEY_SQL}, pitcher, cum_game_pitches{Q.maybe(Q.COUNTS)}{Q.texts(Q.LAGS4)}{Q.reals([*_RUN_REAL, "dvelo1"])} FROM running""",
)
def f08(spark, sf_dir):
    out = P.within_game(pitches(spark, sf_dir))
    return tidy(out.select(*KEY, "pitcher", "cum_game_pitches", *Q.COUNTS, *Q.LAGS4, *_RUN_REAL, "dvelo1"), Q.COUNTS)


_VELO_ITEMS, _VELO_REAL = Q.running_columns("velo")


@query(
    "f09_within_game_cumulative",
    f"""WITH {pitches_sql(S.CANONICAL_TYPES_RUNNING)}, r AS (SELECT *, {", ".join(_VELO_ITEMS)},
  {", ".join(Q.type_lags("prev_pt", 2))},
  release_speed - LAG(release_speed, 1) {Q.LAG} AS dvelo_current FROM pitches)
SELECT {KEY_SQL}, pitcher, cum_game_pitches{Q.maybe(Q.COUNTS)}, prev_pt1, prev_pt2
{Q.reals([*_VELO_REAL, "dvelo_current"])} FROM r""",
)
def f09(spark, sf_dir):
    out = P.cumulative_table(pitches(spark, sf_dir, S.CANONICAL_TYPES_RUNNING))
    return tidy(
        out.select(*KEY, "pitcher", "cum_game_pitches", *Q.COUNTS, "prev_pt1", "prev_pt2", *_VELO_REAL, "dvelo_current"),
        Q.COUNTS,
    )


@query(
    "f16_load_lags",
    f"""WITH {pitches_sql()}, b AS (SELECT * FROM pitches
  WHERE game_date BETWEEN DATE '2024-01-08' AND DATE '2024-01-25'),
r AS (SELECT *, {", ".join(Q.type_lags("prev_pitch_", 2))},
  release_speed - LAG(release_speed, 1) {Q.LAG} AS dvelo_current FROM b)
SELECT {KEY_SQL}, pitcher, prev_pitch_1, prev_pitch_2{Q.reals(["dvelo_current"])} FROM r""",
)
def f16(spark, sf_dir):
    log = pitches(spark, sf_dir).where(J.between_dates("game_date", "2024-01-08:2024-01-25"))
    out = P.lag_block(log, depth=2)
    return tidy(out.select(*KEY, "pitcher", "prev_pitch_1", "prev_pitch_2", "dvelo_current"))


_SEQ_TEXT = [f"prev_pt{k}" for k in range(1, 6)]
_SEQ_MAYBE = [f"prev_{c}{k}" for c in ("balls", "strikes") for k in range(1, 6)]
_SEQ_REAL = ["dvelo_current"] + [f"dvelo{k}" for k in range(2, 6)]
_SEQ_CTE = f"""seq AS (SELECT *, {", ".join(Q.type_lags("prev_pt", 5))},
  {", ".join(f"LAG({c}, {k}) {Q.LAG} AS prev_{c}{k}" for c in ("balls", "strikes") for k in range(1, 6))},
  release_speed - LAG(release_speed, 1) {Q.LAG} AS dvelo_current,
  {", ".join(f"LAG(release_speed, {k - 1}) {Q.LAG} - LAG(release_speed, {k}) {Q.LAG} AS dvelo{k}" for k in range(2, 6))}
FROM pitches)"""


@query(
    "f17_sequence_block",
    f"""WITH {pitches_sql()}, {_SEQ_CTE}
SELECT {KEY_SQL}, pitcher{Q.texts(_SEQ_TEXT)}{Q.maybe(_SEQ_MAYBE)}{Q.reals(_SEQ_REAL)} FROM seq""",
)
def f17(spark, sf_dir):
    out = P.sequence_block(pitches(spark, sf_dir))
    return tidy(out.select(*KEY, "pitcher", *_SEQ_TEXT, *_SEQ_MAYBE, *_SEQ_REAL), _SEQ_MAYBE)


def _type_id(column: str, vocabulary, padding: int) -> str:
    whens = " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(vocabulary))
    return f"CASE {column} {whens} ELSE {padding} END"


def _joined(items) -> str:
    return " || ',' || ".join(f"CAST({i} AS VARCHAR)" for i in items)


@query(
    "f18_sequence_arrays",
    f"""WITH {pitches_sql()}, {_SEQ_CTE}
SELECT {KEY_SQL},
  {_joined([_type_id(f"prev_pt{k}", S.SEQUENCE_TYPES, 8) for k in range(5, 0, -1)])} AS seq_types,
  {_joined([f"COALESCE(prev_balls{k}, 0)" for k in range(5, 0, -1)])} AS seq_balls,
  {_joined([f"COALESCE(prev_strikes{k}, 0)" for k in range(5, 0, -1)])} AS seq_strikes,
  {r6(" + ".join(f"COALESCE({c}, 0) * {w}" for c, w in zip(_SEQ_REAL, (1, 2, 3, 4, 5))))} AS dvelo_check,
  CAST({_type_id("pitch_type_can", S.SEQUENCE_TYPES, -1)} AS BIGINT) AS target_id
FROM seq WHERE pitch_type_can <> 'ST'""",
)
def f18(spark, sf_dir):
    out = P.sequence_arrays(P.sequence_block(pitches(spark, sf_dir)), include_current=True)
    check = F.lit(0.0)
    for place, weight in zip(range(4, -1, -1), (1, 2, 3, 4, 5)):
        check = check + F.col("seq_dvelo")[place] * weight
    return tidy(
        out.select(
            *KEY, "seq_types", "seq_balls", "seq_strikes", check.alias("dvelo_check"), "target_id"
        )
    )


@query(
    "f19_slot_arrays",
    f"""WITH {pitches_sql()}, {Q.running_cte()}
SELECT {KEY_SQL},
  {_joined([_type_id(c, S.SLOT_TYPES, 9) for c in ("pitch_type_can", *Q.LAGS4)])} AS with_current,
  {_joined([_type_id(c, S.SLOT_TYPES, 9) for c in Q.LAGS4] + ["9"])} AS without_current,
  {r6("COALESCE(balls, 0)")} AS ctx_balls, {r6("COALESCE(strikes, 0)")} AS ctx_strikes,
  {r6("COALESCE(dvelo1, 0)")} AS ctx_dvelo,
  CAST({_type_id("pitch_type_can", S.SLOT_TYPES, 9)} AS BIGINT) AS target_id
FROM running WHERE pitch_type_can <> 'OTHER'""",
)
def f19(spark, sf_dir):
    log = P.within_game(pitches(spark, sf_dir))
    both = P.slot_arrays(log, include_current=True).withColumnRenamed("slot_ids", "with_current")
    both = P.slot_arrays(both).withColumnRenamed("slot_ids", "without_current")
    ctx = F.col("context")
    return tidy(
        both.select(
            *KEY, "with_current", "without_current",
            ctx[0].alias("ctx_balls"), ctx[1].alias("ctx_strikes"), ctx[2].alias("ctx_dvelo"),
            "target_id",
        )
    )


_PRIOR_REAL = [c for f in Q.PRIOR for c in Q.FAMILIES[f][2]]
_TODAY_REAL = [c for f in Q.TODAY for c in Q.FAMILIES[f][2]]


@query(
    "f20_historical_table",
    f"""WITH {Q.historical_ctes()}
SELECT {Q.raw_items()}, cum_game_pitches{Q.maybe(Q.COUNTS)}{Q.texts(Q.LAGS4)}
{Q.reals([*_RUN_REAL, "dvelo1", *_PRIOR_REAL])}, {COUNT_LABEL} AS count_state FROM hist""",
)
def f20(spark, sf_dir):
    return tidy(P.historical_table(pitches(spark, sf_dir)), [*Q.RAW_MAYBE, *Q.COUNTS])


@query(
    "f21_offline_table",
    f"""WITH {Q.offline_ctes()}
SELECT {Q.raw_items()}{Q.reals(_TODAY_REAL)}, {r6("0.9 + n_regionkey * 0.05")} AS "PF"
FROM offline LEFT JOIN nation ON home_team = 'T' || CAST(n_nationkey AS VARCHAR)""".replace(
        pitches_sql(), pitches_sql(S.CANONICAL_TYPES_TO_DATE)
    ),
)
def f21(spark, sf_dir):
    log = pitches(spark, sf_dir, S.CANONICAL_TYPES_TO_DATE)
    return tidy(P.offline_table(log, _parks(spark, sf_dir)), Q.RAW_MAYBE)


# --- options of the families --------------------------------------------------------


@query(
    "f01_min_rows",
    f"""WITH {pitches_sql()}, {_ARSENAL_DAILY},
w AS (SELECT *, AVG(velocity) OVER x AS v30, SUM(cnt) OVER x AS n30 FROM d
  WINDOW x AS (PARTITION BY pitcher, cat ORDER BY game_date {Q.W30})),
m AS (SELECT pitcher, game_date, cat, CASE WHEN n30 >= 5 THEN v30 END AS velocity_30d FROM w),
{Q.wide("p", "m", "pitcher", S.PITCH_TYPES, ["velocity_30d"])}
SELECT pitcher, CAST(game_date AS VARCHAR) AS game_date
{Q.reals(Q.names(["velocity_30d"], S.PITCH_TYPES))} FROM p""",
)
def f01_min_rows(spark, sf_dir):
    """Rates from fewer than five pitches are blank."""
    wide = rolling_features(
        pitches(spark, sf_dir), "pitcher", "game_date", [P.arsenal_family(min_rows=5)]
    )
    return tidy(wide.select("pitcher", "game_date", *[f"velocity_30d_{t}" for t in S.PITCH_TYPES]))


@query(
    "f01_densified",
    f"""WITH {pitches_sql()}, {_ARSENAL_DAILY},
k AS (SELECT DISTINCT pitcher, game_date FROM d),
v AS (SELECT unnest([{", ".join(repr(t) for t in S.PITCH_TYPES)}]) AS cat),
g AS (SELECT k.pitcher, k.game_date, v.cat, d.whiff_rate FROM k CROSS JOIN v
  LEFT JOIN d ON d.pitcher = k.pitcher AND d.game_date = k.game_date AND d.cat = v.cat),
w AS (SELECT pitcher, game_date, cat,
  AVG(whiff_rate) OVER (PARTITION BY pitcher, cat ORDER BY game_date {Q.W30}) AS whiff_rate_30d FROM g),
{Q.wide("p", "w", "pitcher", S.PITCH_TYPES, ["whiff_rate_30d"])}
SELECT pitcher, CAST(game_date AS VARCHAR) AS game_date
{Q.reals(Q.names(["whiff_rate_30d"], S.PITCH_TYPES))} FROM p""",
)
def f01_densified(spark, sf_dir):
    """Per-type history on every day, so that a value no longer reveals the day's types."""
    wide = rolling_features(
        pitches(spark, sf_dir), "pitcher", "game_date", [P.arsenal_family(densify=True)]
    )
    return tidy(wide.select("pitcher", "game_date", *[f"whiff_rate_30d_{t}" for t in S.PITCH_TYPES]))


@query(
    "f04_pooled",
    f"""WITH {pitches_sql()},
{Q.daily("d", "pitcher", None, {
    "n": "COUNT(*)", "s": "SUM(release_speed)",
    "wh": "SUM(CASE WHEN description = 'swinging_strike' THEN 1 ELSE 0 END)",
    "hr": f"SUM(CASE WHEN events IN {Q.HITS} THEN 1 ELSE 0 END)"}, "release_speed IS NOT NULL")},
w AS (SELECT pitcher, game_date, SUM(s) OVER x / SUM(n) OVER x AS velocity_7d,
  SUM(wh) OVER x / SUM(n) OVER x AS whiff_rate_7d, SUM(hr) OVER x / SUM(n) OVER x AS hit_rate_7d
  FROM d WINDOW x AS (PARTITION BY pitcher ORDER BY game_date {Q.W7}))
SELECT pitcher, CAST(game_date AS VARCHAR) AS game_date
{Q.reals(["velocity_7d", "whiff_rate_7d", "hit_rate_7d"])} FROM w""",
)
def f04_pooled(spark, sf_dir):
    """Form weighted by pitches instead of by days."""
    family = P.form_family(pooled=True)
    return tidy(rolling_features(pitches(spark, sf_dir), "pitcher", "game_date", [family]))


@query("distinct_pairs", "SELECT DISTINCT l_suppkey AS mlbam, l_partkey AS fg FROM lineitem")
def distinct_pairs(spark, sf_dir):
    """The crosswalk build: distinct id pairs."""
    players = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("key_mlbam"), F.col("l_partkey").alias("key_fangraphs")
    )
    return tidy(build_crosswalk(players))


@query(
    "concat_frames",
    """SELECT o_custkey AS entity, """
    + r6("o_totalprice")
    + """ AS amount, NULL::DOUBLE AS balance FROM orders
UNION ALL SELECT c_custkey, NULL, """
    + r6("c_acctbal")
    + " FROM customer",
)
def concat_frames(spark, sf_dir):
    """Row concatenation by name with columns only one side has."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("entity"), F.col("o_totalprice").alias("amount")
    )
    people = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("entity"), F.col("c_acctbal").alias("balance")
    )
    return tidy(J.concat([orders, people]))
