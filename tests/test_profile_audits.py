import datetime as dt

import pytest
from pyspark.sql import functions as F

from pitlog import schema as S
from pitlog.operators import profile as P
from pitlog.operators import selection as SL
from pitlog.plans import audits as A
from pitlog.plans import features as FE

LOG = (
    "pitcher long, game_pk long, game_date date, at_bat_number int, pitch_number int, "
    "pitch_type_can string, release_speed double, release_spin_rate double"
)


def game(spark):
    rows = []
    for g in (1, 2):
        for i, (t, v) in enumerate(
            [("FF", 90.0), ("FF", 92.0), ("SL", 80.0), ("FF", None), ("SL", 84.0), ("CH", 70.0), ("FF", 95.0)]
        ):
            rows.append((5, g, dt.date(2024, 4, g), i // 3, i % 3 + 1, t, v, 2000.0 + i))
    return FE.within_game(spark.createDataFrame(rows, LOG))


def verdicts(report):
    return {r["item"]: r["passed"] for r in report.collect()}


def test_recompute_passes_good_and_fires_on_bad(spark):
    good = game(spark)
    assert all(verdicts(A.recompute_running(good)).values())
    leaky = good.withColumn("cum_ff_velocity", F.coalesce("cum_ff_velocity", "release_speed"))
    found = verdicts(A.recompute_running(leaky))
    assert not found["cum_ff_velocity"] and found["cum_sl_velocity"]
    off = good.withColumn("cum_sl_count", F.col("cum_sl_count") + 1)
    assert not verdicts(A.recompute_running(off))["cum_sl_count"]


def test_first_row_zero(spark):
    good = game(spark)
    assert verdicts(A.first_row_zero(good)) == {"cum_game_pitches": True}
    bad = good.withColumn("cum_game_pitches", F.col("cum_game_pitches") + 1)
    assert verdicts(A.first_row_zero(bad)) == {"cum_game_pitches": False}


def test_constant_and_equal_current_on_leaky_rows(spark):
    df = spark.createDataFrame(
        [(1, 1, "FF", 90.0, 2000.0, 90.05, 2100.0), (1, 1, "FF", 92.0, 2010.0, 91.0, 2100.0),
         (1, 2, "SL", 80.0, 1900.0, None, 2200.0), (1, 2, "FF", None, 1900.0, 88.0, 2200.0)],
        "pitcher long, game_pk long, pitch_type_can string, release_speed double, "
        "release_spin_rate double, V_TD_FF double, SPIN_TD_FF double",
    )
    assert verdicts(A.constant_in_game(df, ["V_TD_FF", "SPIN_TD_FF"])) == {
        "V_TD_FF": False, "SPIN_TD_FF": True,
    }
    assert verdicts(A.equals_current(df, A.to_date_pairs(["FF"]))) == {
        "V_TD_FF": False, "SPIN_TD_FF": True,
    }


def test_early_null(spark):
    df = spark.createDataFrame(
        [(1, dt.date(2024, 4, 1), None, 1.0), (1, dt.date(2024, 4, 2), 3.0, 2.0)],
        "pitcher long, game_date date, velocity_30d_FF double, usage_30d_FF double",
    )
    assert verdicts(A.early_null(df)) == {"velocity_30d_FF": True, "usage_30d_FF": False}


def test_required_columns_and_types(spark):
    df = spark.createDataFrame([(1, None)], "a long, b string")
    got = verdicts(A.required_columns(df, ["a", "b", "c"], {"fam": ["zz_"]}))
    assert got == {"a": True, "b": False, "c": False, "fam": False}
    typed = spark.createDataFrame([("x",)], "a string").schema
    assert verdicts(A.required_columns(df, ["a"], {}, typed)) == {"a": False}


def test_vocabulary_and_spread(spark):
    df = spark.createDataFrame([("FF", 1.0), ("ST", 90.0)], "pitch_type_can string, dvelo1 double")
    got = verdicts(A.vocabulary(df, expected=["FF", "SL"]))
    assert got == {"FF": True, "SL": False, "unexpected": True}
    assert verdicts(A.spread(df)) == {"dvelo1": False}


def test_high_correlation_and_plausibility(spark):
    df = spark.createDataFrame([(float(i), i * 2.0, float(i % 3), 1.0) for i in range(20)],
                               "y double, same double, noise double, const double")
    got = verdicts(A.high_correlation(df, "y"))
    assert got == {"same": False, "noise": True}
    metrics = spark.createDataFrame(
        [("type_accuracy", 0.82), ("outcome_accuracy", 0.7), ("mini_rmse", 0.005)], "metric string, value double"
    )
    assert verdicts(A.plausibility(metrics)) == {
        "type_accuracy": False, "outcome_accuracy": True, "mini_rmse": False,
    }


def test_leak_gate_lets_constant_lookalikes_through(spark):
    df = spark.createDataFrame(
        [(1, 1, 90.0, 3, 0.1), (1, 1, 95.0, 3, 0.4)],
        "pitcher long, game_pk long, release_speed double, zone_id int, y double",
    )
    got = {(r["check"], r["item"]): r["passed"] for r in
           A.leak_gate(df, ["release_speed", "zone_id", "other"], "y").collect()}
    assert got[("leak_gate", "release_speed")] is False
    assert got[("leak_gate", "zone_id")] is True
    assert got[("leak_gate_correlation", "release_speed")] is False
    assert A.leak_gate(df, ["other"]).count() == 0


def test_token_scan_modes():
    names = ["PT_PROB_MAX", "release_speed", "away_score", "ax", "usage_30d_FF"]
    assert SL.leaky_columns(names) == ["PT_PROB_MAX", "release_speed", "away_score", "ax"]
    assert SL.leaky_columns(names, exact=True) == ["release_speed", "ax"]
    with pytest.raises(ValueError):
        SL.assert_no_leaks(names)


def test_selection_levels(spark):
    cols = ["balls", "w", "release_speed", "delta_run_exp", "usage_30d_FF", "usage_30d_ST",
            "xwoba_30d_vs_L", "whiff_rate_7d", "velocity_7d", "pitch_type_can_lag", *S.REQUIRED_LAGS]
    df = spark.createDataFrame([], ", ".join(f"{c} double" for c in cols))
    by_level = {lv: SL.blacklist_features(df, "pitch_type_can", lv) for lv in SL.STRICTNESS}
    assert "delta_run_exp" in by_level["balanced"] and "delta_run_exp" not in by_level["enhanced"]
    assert "release_speed" in by_level["clean"] and "release_speed" not in by_level["strict"]
    assert "usage_30d_FF" not in by_level["clean"] and "usage_30d_ST" in by_level["clean"]
    assert "pitch_type_can_lag" not in by_level["balanced"]
    value = SL.blacklist_features(df, "estimated_woba_using_speedangle", "clean")
    assert "xwoba_30d_vs_L" not in value and "usage_30d_FF" in value
    assert SL.conservative_features(df) == ["balls", "usage_30d_FF", "usage_30d_ST", "whiff_rate_7d"]
    assert SL.safe_features(df)[:1] == ["balls"]
    with pytest.raises(ValueError):
        SL.safe_features(df.drop("dvelo1"))


def test_profiles(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None), (None, 8.0)], "t string, w double")
    shares = {r["t"]: (r["n"], r["share"]) for r in P.value_counts(df, "t").collect()}
    assert shares == {"a": (2, 2 / 3), "b": (1, 1 / 3)}
    dist = {r["t"]: r["weighted_share"] for r in P.weighted_distribution(df, "t", "w").collect()}
    assert dist == {"a": 1.0, "b": None}
    nulls = {r["column_name"]: r["null_share"] for r in P.null_share(df).collect()}
    assert nulls == {"t": 0.25, "w": 0.25}
    assert P.sparse_target(df, "w", 0.3).count() == 4
    assert P.sparse_target(df, "w", 0.2).count() == 3
    assert P.class_support(df.fillna(1.0), "t", "w", 0.3).first()["thin_classes"] == 1
