import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pitlog.operators import rolling as R
from pitlog.plans import features as P

DAY0 = dt.date(2024, 4, 1)
LOG = (
    "pitcher long, batter long, game_pk long, game_date date, at_bat_number int, pitch_number int, "
    "pitch_type_can string, stand string, release_speed double, release_spin_rate double, "
    "balls int, strikes int, description string, events string, "
    "estimated_woba_using_speedangle double"
)


def pitch(day, n, pt="FF", speed=90.0, spin=2000.0, desc="ball", pitcher=1, stand="L", event=None, xw=None):
    return (
        pitcher, 7, day, DAY0 + dt.timedelta(days=day), n // 4, n % 4 + 1, pt, stand, speed, spin,
        0, 0, desc, event, xw,
    )


@pytest.fixture(scope="module")
def log(spark):
    days = [0, 1, 6, 7, 28, 29, 30]
    rows = [pitch(d, i, speed=90.0 + d) for i, d in enumerate(days)]
    rows.append(pitch(30, 50, speed=200.0))  # a second row of the last day
    return spark.createDataFrame(rows, LOG)


def by_day(df, column):
    return {(r["game_date"] - DAY0).days: r[column] for r in df.collect()}


def test_prior_frame_excludes_today_and_day_30(log):
    got = by_day(R.rolling_features(log, "pitcher", "game_date", [P.arsenal_family()]), "velocity_30d_FF")
    assert got[0] is None
    assert got[1] == 90.0
    assert got[29] == pytest.approx((90 + 91 + 96 + 97 + 118) / 5)
    assert got[30] == pytest.approx((91 + 96 + 97 + 118 + 119) / 5)


def test_seven_day_frame_is_six_prior_days(log):
    got = by_day(R.rolling_features(log, "pitcher", "game_date", [P.form_family()]), "velocity_7d")
    assert got[6] == pytest.approx((90 + 91) / 2)
    assert got[7] == pytest.approx((91 + 96) / 2)
    assert got[28] is None


def test_with_today_and_to_date(log):
    wide = R.rolling_features(log, "pitcher", "game_date", P.arsenal_to_date_families())
    assert by_day(wide, "V_TD_FF")[1] == pytest.approx(90.5)
    assert by_day(wide, "USAGE_30_FF")[30] == 1.0


def test_daily_means_weigh_days_and_pooled_weighs_rows(spark):
    rows = [pitch(0, i, speed=90.0) for i in range(3)] + [pitch(1, 9, speed=100.0), pitch(2, 10)]
    log = spark.createDataFrame(rows, LOG)
    plain = by_day(R.rolling_features(log, "pitcher", "game_date", [P.form_family()]), "velocity_7d")
    pooled = by_day(
        R.rolling_features(log, "pitcher", "game_date", [P.form_family(pooled=True)]), "velocity_7d"
    )
    assert plain[2] == pytest.approx(95.0)
    assert pooled[2] == pytest.approx(92.5)


def test_category_value_shows_only_on_days_it_was_thrown(spark):
    log = spark.createDataFrame([pitch(0, 0, "SL"), pitch(0, 1, "FF"), pitch(1, 2, "FF")], LOG)
    faithful = R.rolling_features(log, "pitcher", "game_date", [P.arsenal_family()])
    dense = R.rolling_features(log, "pitcher", "game_date", [P.arsenal_family(densify=True)])
    assert by_day(faithful, "velocity_30d_SL")[1] is None
    assert by_day(dense, "velocity_30d_SL")[1] == 90.0
    assert by_day(faithful, "velocity_30d_FF")[1] == 90.0


def test_usage_shares_count_only_types_thrown_that_day(spark):
    rows = [pitch(0, 0, "SL"), pitch(0, 1, "FF"), pitch(0, 2, "FF"), pitch(1, 3, "FF"), pitch(2, 4, "FF"), pitch(2, 5, "SL")]
    log = spark.createDataFrame(rows, LOG)
    wide = R.rolling_features(log, "pitcher", "game_date", [P.usage_family()])
    assert by_day(wide, "usage_30d_FF")[1] == 1.0
    assert by_day(wide, "usage_30d_FF")[2] == pytest.approx(3 / 4)
    assert by_day(wide, "usage_30d_SL")[0] is None


def test_min_rows_blanks_thin_frames(log):
    few = R.rolling_features(log, "pitcher", "game_date", [P.arsenal_family(min_rows=3)])
    got = by_day(few, "velocity_30d_FF")
    assert got[1] is None and got[6] is None and got[7] is not None


def test_boolean_rate_is_null_where_no_text_is_known(spark):
    log = spark.createDataFrame([pitch(0, 0, desc=None), pitch(0, 1, desc=None)], LOG)
    form = R.rolling_features(log, "pitcher", "game_date", [P.form_with_today_family()])
    assert by_day(form, "WHIFF_7D")[0] is None
    k = R.Family("x", P.WITH_7, (R.rate("r", F.col("description") == "swinging_strike"),))
    assert by_day(R.rolling_features(log, "pitcher", "game_date", [k]), "r")[0] == 0.0


def test_families_together_equal_families_alone(spark):
    rnd = random.Random(3)
    rows = [
        pitch(
            rnd.randrange(40), i, rnd.choice(["FF", "SL", "OTHER"]), rnd.choice([None, 90.0, 95.5]),
            rnd.choice([None, 2100.0]), rnd.choice(["ball", "swinging_strike", None]),
            rnd.randrange(3), rnd.choice(["L", "R", None]), rnd.choice(["single", None]),
            rnd.choice([None, 0.4]),
        )
        for i in range(600)
    ]
    log = spark.createDataFrame(rows, LOG)
    together = P.pitcher_prior(log).toPandas().set_index(["pitcher", "game_date"]).sort_index()
    for family in P.PITCHER_PRIOR:
        alone = R.rolling_features(log, "pitcher", "game_date", [family()])
        alone = alone.toPandas().set_index(["pitcher", "game_date"]).sort_index()
        both = together.loc[alone.index, alone.columns]
        assert ((both - alone).abs().fillna(0) < 1e-9).all().all()
        assert (both.isna() == alone.isna()).all().all()


def test_pivot_keeps_fixed_columns(spark):
    df = spark.createDataFrame(
        [(1, "FF", 1.0), (1, "SL", None), (2, "XX", 3.0)], "k int, c string, m double"
    )
    rows = {r["k"]: r.asDict() for r in R.pivot_wide(df, ["k"], "c", ["CH", "FF", "SL"], ["m"]).collect()}
    assert rows[1] == {"k": 1, "m_CH": None, "m_FF": 1.0, "m_SL": None}
    assert rows[2] == {"k": 2, "m_CH": None, "m_FF": None, "m_SL": None}


def test_densify_adds_absent_categories(spark):
    df = spark.createDataFrame([(1, "FF", 1)], "k int, c string, n int")
    got = {r["c"]: r["n"] for r in R.densify(df, ["k"], "c", ["FF", "SL"]).collect()}
    assert got == {"FF": 1, "SL": None}
