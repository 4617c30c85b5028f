"""Profiles, distributions and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitlog import schema as S
from pitlog.catalog import feature_sql as Q
from pitlog.catalog.registry import query, r6, table, tidy
from pitlog.catalog.standin import pitches, pitches_sql
from pitlog.functions.weights import time_decay
from pitlog.operators import joins as J
from pitlog.operators import profile as P
from pitlog.plans import audits as A
from pitlog.plans import features as FE

WITH = f"WITH {pitches_sql()}"
XWOBA = "estimated_woba_using_speedangle"


@query(
    "load_summary",
    f"""{WITH} SELECT COUNT(*) AS n_rows, CAST(MIN(game_date) AS VARCHAR) AS first_date,
  CAST(MAX(game_date) AS VARCHAR) AS last_date, COUNT(DISTINCT game_pk) AS games,
  COUNT(DISTINCT pitcher) AS pitchers, COUNT(DISTINCT batter) AS batters FROM pitches""",
)
def load_summary(spark, sf_dir):
    return tidy(P.load_summary(pitches(spark, sf_dir)))


@query(
    "value_counts",
    f"""{WITH} SELECT pitch_type, COUNT(*) AS n,
  {r6("COUNT(*)::DOUBLE / (SELECT COUNT(pitch_type) FROM pitches)")} AS share
FROM pitches WHERE pitch_type IS NOT NULL GROUP BY 1""",
)
def value_counts(spark, sf_dir):
    return tidy(P.value_counts(pitches(spark, sf_dir), "pitch_type"))


@query(
    "top_types",
    f"""{WITH} SELECT pitch_type_can, COUNT(*) AS n,
  {r6("COUNT(*)::DOUBLE / (SELECT COUNT(*) FROM pitches)")} AS share
FROM pitches GROUP BY 1 ORDER BY n DESC, 1 LIMIT 5""",
)
def top_types(spark, sf_dir):
    return tidy(P.top_values(pitches(spark, sf_dir), "pitch_type_can", 5))


_WEIGHTED = f"""{WITH}, m AS (SELECT MAX(game_date) AS latest FROM pitches),
w AS (SELECT pitch_type_can, exp(-0.0012 * date_diff('day', game_date, (SELECT latest FROM m))) AS w
  FROM pitches),
c AS (SELECT pitch_type_can, COUNT(*) AS n, SUM(w) AS w_sum FROM w GROUP BY 1),
s AS (SELECT pitch_type_can, n::DOUBLE / SUM(n) OVER () AS share,
  w_sum / SUM(w_sum) OVER () AS weighted_share FROM c)"""


def _weighted(spark, sf_dir):
    log = pitches(spark, sf_dir)
    latest = log.agg(F.max("game_date")).scalar()
    return log.withColumn("w", time_decay(F.col("game_date"), latest, 0.0012))


@query(
    "weighted_class_dist",
    f"""{_WEIGHTED} SELECT pitch_type_can, {r6("share")} AS share,
  {r6("weighted_share")} AS weighted_share, {r6("weighted_share - share")} AS delta FROM s""",
)
def weighted_class_dist(spark, sf_dir):
    return tidy(P.weighted_distribution(_weighted(spark, sf_dir), "pitch_type_can", "w"))


@query(
    "min_class_support",
    f"""{_WEIGHTED} SELECT {r6("MIN(weighted_share)")} AS min_share,
  COUNT(*) FILTER (weighted_share < 0.052) AS thin_classes,
  CAST(COUNT(*) FILTER (weighted_share < 0.052) = 0 AS BIGINT) AS passed FROM s""",
)
def min_class_support(spark, sf_dir):
    return tidy(P.class_support(_weighted(spark, sf_dir), "pitch_type_can", "w", 0.052))


@query(
    "monthly_profile",
    """SELECT CAST(month(CAST(l_shipdate AS DATE)) AS BIGINT) AS month, COUNT(l_returnflag) AS n,
  COUNT(DISTINCT l_suppkey) AS entities FROM lineitem GROUP BY 1""",
)
def monthly_profile(spark, sf_dir):
    log = table(spark, sf_dir, "lineitem").withColumn("day", F.to_date("l_shipdate"))
    return tidy(P.monthly_profile(log, "day", "l_returnflag", "l_suppkey"))


@query(
    "class_by_month",
    """SELECT CAST(month(CAST(l_shipdate AS DATE)) AS BIGINT) AS month, COUNT(*) AS n, """
    + r6("COUNT(*)::DOUBLE / (SELECT COUNT(*) FROM lineitem WHERE l_returnflag = 'R')")
    + """ AS share FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1""",
)
def class_by_month(spark, sf_dir):
    """Rows of one class by month, with shares."""
    log = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == "R")
    return tidy(P.value_counts(log.select(F.month("l_shipdate").alias("month")), "month"))


_NULLABLE = (
    "stand pitch_type release_speed release_spin_rate balls strikes description events inning "
    f"outs_when_up on_1b on_2b on_3b away_score {XWOBA}"
).split()


@query(
    "null_share",
    f"""{WITH} {" UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {r6(f'AVG(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)')} AS null_share FROM pitches"
        for c in _NULLABLE)}""",
)
def null_share(spark, sf_dir):
    return tidy(P.null_share(pitches(spark, sf_dir), _NULLABLE))


@query(
    "mostly_null",
    f"""{WITH}, n AS ({" UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {r6(f'AVG(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)')} AS null_share FROM pitches"
        for c in _NULLABLE)})
SELECT * FROM n WHERE null_share > 0.5""",
)
def mostly_null(spark, sf_dir):
    return tidy(P.mostly_null(pitches(spark, sf_dir).select(*_NULLABLE)))


_MEASURES = ["release_speed", "release_spin_rate", XWOBA, "balls", "strikes"]


@query(
    "summary_stats",
    f"""{WITH} {" UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {r6(f'COUNT({c})')} AS n, {r6(f'AVG({c})')} AS mean, "
        f"{r6(f'stddev_samp({c})')} AS std, {r6(f'MIN({c})')} AS min, {r6(f'MAX({c})')} AS max FROM pitches"
        for c in _MEASURES)}""",
)
def summary_stats(spark, sf_dir):
    return tidy(P.summary_stats(pitches(spark, sf_dir), _MEASURES))


@query(
    "feature_target_corr",
    f"""{WITH}, c AS ({" UNION ALL ".join(
        f"SELECT '{c}' AS column_name, corr({c}::DOUBLE, {XWOBA}) AS r FROM pitches"
        for c in ("release_speed", "release_spin_rate", "balls", "strikes", "inning", "home_score"))})
SELECT column_name, {r6("r")} AS r FROM c WHERE r IS NOT NULL AND NOT isnan(r)""",
)
def feature_target_corr(spark, sf_dir):
    columns = ["release_speed", "release_spin_rate", "balls", "strikes", "inning", "home_score"]
    return tidy(P.correlations(pitches(spark, sf_dir), XWOBA, columns))


def _splits(spark, sf_dir):
    log = table(spark, sf_dir, "orders").select(
        "o_custkey", F.to_date("o_orderdate").alias("day")
    )
    return {
        "train": log.where(F.year("day") <= 1996),
        "val": log.where(F.year("day") == 1997),
        "test": log.where(F.year("day") >= 1998),
    }


_OVERLAP = """WITH o AS (SELECT DISTINCT o_custkey AS c, CASE WHEN year(o_orderdate) <= 1996 THEN 'train'
  WHEN year(o_orderdate) = 1997 THEN 'val' ELSE 'test' END AS s FROM orders),
p(l, r) AS (VALUES ('train', 'val'), ('train', 'test'), ('val', 'test'))
SELECT {columns} FROM p LEFT JOIN
  (SELECT a.s AS l, b.s AS r, COUNT(*) AS shared FROM o a JOIN o b ON a.c = b.c GROUP BY 1, 2) x
  USING (l, r)"""


@query(
    "entity_overlap",
    _OVERLAP.format(columns='l AS "left", r AS "right", COALESCE(shared, 0) AS shared'),
)
def entity_overlap(spark, sf_dir):
    return tidy(J.entity_overlap(_splits(spark, sf_dir), "o_custkey"))


@query(
    "top_n",
    """SELECT o_orderkey, """
    + r6("o_totalprice")
    + """ AS o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20""",
)
def top_n(spark, sf_dir):
    log = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return tidy(P.top_n(log, "o_totalprice", 20, ["o_orderkey"]))


# --- audits -------------------------------------------------------------------

def _report_sql(ctes: str, check: str, items: dict[str, str], passed: str = "value = 0") -> str:
    """items: item -> scalar SQL of its value"""
    rows = " UNION ALL ".join(
        f"""SELECT '{check}' AS "check", '{i}' AS item, CAST(({v}) AS DOUBLE) AS value"""
        for i, v in items.items()
    )
    return (
        f"WITH {ctes}, report AS ({rows})\n"
        f'SELECT "check", item, {r6("value")} AS value, CAST({passed} AS BIGINT) AS passed FROM report'
    )


_TD = ["V_TD_FF", "V_TD_SL", "SPIN_TD_FF", "USAGE_30_CH", "K_PCT_TD", "release_speed"]


@query(
    "audit_constant_in_game",
    _report_sql(
        f"""{Q.offline_ctes()}, g AS (SELECT {", ".join(
            f'MAX("{c}") <> MIN("{c}") AS "{c}"' for c in _TD)} FROM offline GROUP BY pitcher, game_pk)""",
        "constant_in_game",
        {c: f'SELECT COUNT(*) FILTER ("{c}") FROM g' for c in _TD},
    ),
)
def audit_constant_in_game(spark, sf_dir):
    return tidy(A.constant_in_game(FE.offline_table(pitches(spark, sf_dir)), _TD))


@query(
    "audit_equals_current",
    _report_sql(
        Q.offline_ctes(),
        "equals_current",
        {
            f"{m}_{t}": f"""SELECT COUNT(*) FROM offline WHERE pitch_type_can = '{t}'
              AND abs({src} - "{m}_{t}") < {tol}"""
            for t in S.PITCH_TYPES
            for m, src, tol in (("SPIN_TD", "release_spin_rate", 1.0), ("V_TD", "release_speed", 0.1))
        },
    ),
)
def audit_equals_current(spark, sf_dir):
    return tidy(A.equals_current(FE.offline_table(pitches(spark, sf_dir)), A.to_date_pairs()))


_RECOMPUTED = {
    f"cum_{t.lower()}_{m}": (t, m) for t in ("FF", "SL", "CH") for m in ("velocity", "spin", "count")
}


def _recompute_sql(t: str, measure: str) -> str:
    inner = "PARTITION BY pitcher, game_pk, pitch_type_can ORDER BY at_bat_number, pitch_number"
    before = f"OVER ({inner} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    col = f"cum_{t.lower()}_{measure}"
    if measure == "count":
        test = f"COALESCE({col}, 0) <> again"
        again = f"COUNT(*) {before}"
    else:
        test = f"NOT COALESCE(CASE WHEN again IS NULL THEN {col} IS NULL ELSE abs({col} - again) < 0.01 END, false)"
        again = f"AVG({'release_speed' if measure == 'velocity' else 'release_spin_rate'}) {before}"
    return f"""SELECT COUNT(*) FROM (SELECT {col}, {again} AS again FROM running
      WHERE pitch_type_can = '{t}') WHERE {test}"""


@query(
    "audit_recompute",
    _report_sql(
        f"{pitches_sql()}, {Q.running_cte()}",
        "recompute_running",
        {c: _recompute_sql(*spec) for c, spec in _RECOMPUTED.items()},
    ),
)
def audit_recompute(spark, sf_dir):
    return tidy(A.recompute_running(FE.within_game(pitches(spark, sf_dir))))


@query(
    "audit_first_row_zero",
    _report_sql(
        f"{pitches_sql()}, {Q.running_cte()}",
        "first_row_zero",
        {
            "cum_game_pitches": f"""SELECT COUNT(*) FROM (SELECT cum_game_pitches,
              ROW_NUMBER() OVER ({Q.SEQ}) AS rn FROM running) WHERE rn = 1 AND cum_game_pitches <> 0"""
        },
    ),
)
def audit_first_row_zero(spark, sf_dir):
    return tidy(A.first_row_zero(FE.within_game(pitches(spark, sf_dir))))


_EARLY = ["velocity_30d_FF", "usage_30d_SL", "whiff_rate_30d_EVEN", "xwoba_30d_vs_L"]
_EARLY_TODAY = ["V_TD_FF", "WHIFF_30_EVEN"]


@query(
    "audit_early_null",
    _report_sql(
        f"""{pitches_sql()}, {Q.family_ctes([*Q.PRIOR[:5], "arsenal_td", "count_state_today"])},
{Q.joined_cte("j", "pitches", [*Q.PRIOR[:5], "arsenal_td", "count_state_today"])},
f AS (SELECT * FROM j QUALIFY game_date = MIN(game_date) OVER (PARTITION BY pitcher))""",
        "early_null",
        {c: f'SELECT COUNT("{c}") FROM f' for c in [*_EARLY, *_EARLY_TODAY]},
    ),
)
def audit_early_null(spark, sf_dir):
    """Prior features must be NULL on a pitcher's first day; the including-today ones are not."""
    log = pitches(spark, sf_dir)
    both = J.attach_features(log, FE.pitcher_prior(log), ["pitcher", "game_date"])
    both = J.attach_features(both, FE.pitcher_with_today(log), ["pitcher", "game_date"])
    return tidy(A.early_null(both, [*_EARLY, *_EARLY_TODAY]))


@query(
    "audit_required_columns",
    _report_sql(
        f"{Q.historical_ctes()}",
        "required_columns",
        {
            **{
                c: (f'SELECT COUNT("{c}") FROM hist' if c != "count_state" else "SELECT COUNT(*) FROM hist")
                for c in S.REQUIRED_COLUMNS
            },
            "release_extension": "SELECT 0",
            "form_7d": "SELECT COUNT(velocity_7d) + COUNT(whiff_rate_7d) + COUNT(hit_rate_7d) FROM hist",
            "count_state_30d": "SELECT "
            + " + ".join(f'COUNT("whiff_rate_30d_{s}")' for s in S.COUNT_STATES)
            + " FROM hist",
            "platoon_30d": "SELECT "
            + " + ".join(f'COUNT("{c}")' for c in Q.FAMILIES["platoon"][2])
            + " FROM hist",
        },
        "value > 0",
    ),
)
def audit_required_columns(spark, sf_dir):
    families = {k: S.FEATURE_FAMILIES[k] for k in ("form_7d", "count_state_30d", "platoon_30d")}
    full = FE.historical_table(pitches(spark, sf_dir))
    return tidy(A.required_columns(full, [*S.REQUIRED_COLUMNS, "release_extension"], families))


@query(
    "audit_vocabulary",
    _report_sql(
        pitches_sql(),
        "vocabulary",
        {
            **{t: f"SELECT COUNT(*) FROM pitches WHERE pitch_type_can = '{t}'" for t in S.EXPECTED_TYPES},
            "unexpected": "SELECT COUNT(*) FROM pitches WHERE pitch_type_can = 'ST'",
        },
        "value > 0 OR item = 'unexpected'",
    ),
)
def audit_vocabulary(spark, sf_dir):
    return tidy(A.vocabulary(pitches(spark, sf_dir)))


@query(
    "audit_split_overlap",
    _OVERLAP.format(
        columns=f"""'split_overlap' AS "check", l || '+' || r AS item,
  {r6("COALESCE(shared, 0)")} AS value, CAST(1 AS BIGINT) AS passed"""
    ),
)
def audit_split_overlap(spark, sf_dir):
    return tidy(A.split_overlap(_splits(spark, sf_dir), "o_custkey"))


_CORR = ["release_speed", "release_spin_rate", "balls", "cum_game_pitches"]


@query(
    "audit_high_correlation",
    f"""WITH {pitches_sql()}, {Q.running_cte()}, c AS ({" UNION ALL ".join(
        f"SELECT '{c}' AS item, abs(corr({c}::DOUBLE, {XWOBA})) AS value FROM running" for c in _CORR)})
SELECT 'high_correlation' AS "check", item, {r6("value")} AS value,
  CAST(value <= 0.8 AS BIGINT) AS passed FROM c""",
)
def audit_high_correlation(spark, sf_dir):
    return tidy(A.high_correlation(FE.within_game(pitches(spark, sf_dir)), XWOBA, _CORR))


@query(
    "audit_spread",
    _report_sql(
        f"{pitches_sql()}, {Q.running_cte()}",
        "spread",
        {"dvelo1": "SELECT stddev_samp(dvelo1) FROM running"},
        "value <= 20",
    ),
)
def audit_spread(spark, sf_dir):
    return tidy(A.spread(FE.within_game(pitches(spark, sf_dir))))


_GATED = ["release_speed", "prev_pitch_1", "cum_game_pitches", "zone_code", "balls"]


@query(
    "audit_leak_gate",
    f"""WITH {pitches_sql()}, p AS (SELECT *, game_pk * 2 AS zone_code FROM pitches),
g AS (SELECT MAX(release_speed) <> MIN(release_speed) AS a, MAX(zone_code) <> MIN(zone_code) AS b
  FROM p GROUP BY pitcher, game_pk),
r AS (SELECT 'leak_gate' AS "check", 'release_speed' AS item, COUNT(*) FILTER (a)::DOUBLE AS value,
    COUNT(*) FILTER (a) = 0 AS passed FROM g
  UNION ALL SELECT 'leak_gate', 'zone_code', COUNT(*) FILTER (b), COUNT(*) FILTER (b) = 0 FROM g
  UNION ALL SELECT 'leak_gate_correlation', 'release_speed', abs(corr(release_speed, {XWOBA})),
    abs(corr(release_speed, {XWOBA})) <= 0.8 FROM p
  UNION ALL SELECT 'leak_gate_correlation', 'zone_code', abs(corr(zone_code, {XWOBA})),
    abs(corr(zone_code, {XWOBA})) <= 0.8 FROM p)
SELECT "check", item, {r6("value")} AS value, CAST(passed AS BIGINT) AS passed FROM r""",
)
def audit_leak_gate(spark, sf_dir):
    log = FE.within_game(pitches(spark, sf_dir)).withColumn("zone_code", F.col("game_pk") * 2)
    return tidy(A.leak_gate(log, _GATED, XWOBA))


_PROFILED = ["release_speed", "balls", "stand", "cum_game_pitches", "prev_pitch_1", "pitch_type_can"]
_BUCKETS = {
    "release_speed": "post_pitch", "balls": "situational", "stand": "player",
    "cum_game_pitches": "history", "prev_pitch_1": "lag", "pitch_type_can": "target",
}


@query(
    "audit_column_profile",
    f"""WITH {pitches_sql()}, {Q.running_cte()} {" UNION ALL ".join(
        f'''SELECT '{c}' AS column_name, '{b}' AS bucket,
  {r6(f"AVG(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)")} AS null_share,
  {r6(f"MIN({c})" if c in ("release_speed", "balls", "cum_game_pitches") else "NULL")} AS low,
  {r6(f"MAX({c})" if c in ("release_speed", "balls", "cum_game_pitches") else "NULL")} AS high FROM running'''
        for c, b in _BUCKETS.items())}""",
)
def audit_column_profile(spark, sf_dir):
    full = A.column_profile(FE.within_game(pitches(spark, sf_dir)), _PROFILED)
    return tidy(full.drop("distinct_values"))


@query("audit_distinct_estimate")
def audit_distinct_estimate(spark, sf_dir):
    """Estimated distinct values per column; no SQL, the two engines estimate differently."""
    full = A.column_profile(FE.within_game(pitches(spark, sf_dir)), _PROFILED)
    return full.select("column_name", "distinct_values")
