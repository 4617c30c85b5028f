import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pitlog.operators import joins as J
from pitlog.operators import splits as SP


def test_crosswalk_never_multiplies_rows_and_ignores_null_keys(spark):
    log = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (9, "d")], "batter long, x string")
    ids = spark.createDataFrame([(1, 30), (1, 20), (2, 40), (None, 99)], "mlbam long, fg long")
    got = {r["x"]: r["batter_fg"] for r in J.crosswalk_join(log, ids, "batter", "batter_fg").collect()}
    assert got == {"a": 20, "b": 40, "c": None, "d": None}


def test_missing_park_table_passes_through(spark):
    log = spark.createDataFrame([("NYY",)], "home_team string")
    assert J.park_factor_join(log, None) is log


def test_eligible_counts_non_null_labels(spark):
    log = spark.createDataFrame([(1, "a"), (1, None), (2, "a"), (2, "b")], "k long, t string")
    assert {r["k"] for r in J.eligible_by_count(log, "k", 2, "t").collect()} == {2}
    assert {r["k"] for r in J.eligible_by_count(log, "k", 2).collect()} == {1, 2}


def test_concat_fills_absent_columns(spark):
    a = spark.createDataFrame([(1, 2)], "x int, y int")
    b = spark.createDataFrame([(3,)], "x int")
    assert sorted((r["x"], r["y"]) for r in J.concat([a, b]).collect()) == [(1, 2), (3, None)]


def test_overlap_pairs(spark):
    frames = {n: spark.createDataFrame([(v,) for v in vs], "e long")
              for n, vs in {"train": [1, 2, 3], "val": [2, 3, 3], "test": [3, None, 9]}.items()}
    got = {(r["left"], r["right"]): r["shared"] for r in J.entity_overlap(frames, "e").collect()}
    assert got == {("train", "val"): 2, ("train", "test"): 1, ("val", "test"): 1}


def ordered_log(spark, n=700):
    rnd = random.Random(5)
    rows = []
    for i in range(n):
        # one date and game hold most rows
        day = 3 if rnd.random() < 0.6 else rnd.randrange(10)
        rows.append((dt.date(2023, 5, 1) + dt.timedelta(days=day), day % 4, i * 977 % 100_003, i))
    return spark.createDataFrame(
        rows, "game_date date, game_pk long, at_bat_number long, pitch_number long"
    )


@pytest.mark.parametrize("fraction", [0.01, 0.5, 0.8, 1.0])
def test_first_fraction_is_exact(spark, fraction):
    log = ordered_log(spark)
    rows = sorted(tuple(r) for r in log.collect())
    wanted = set(rows[: int(fraction * len(rows))])
    got = {tuple(r) for r in log.where(SP.first_fraction(log, SP.pitch_order(), fraction)).collect()}
    assert got == wanted


@pytest.mark.parametrize("fraction", [0.1, 0.4, 0.8])
def test_rows_with_null_order_come_first_and_none_are_lost(spark, fraction):
    days = [None, "2023-04-01", None, "2023-04-02", "2023-04-03", "2023-04-03", None]
    rows = [(dt.date.fromisoformat(d) if d else None, i % 2 or None, i, i) for i, d in enumerate(days)]
    log = spark.createDataFrame(rows, "game_date date, game_pk long, at_bat_number long, pitch_number long")
    early = SP.first_fraction(log, SP.pitch_order(), fraction)
    first = [r["at_bat_number"] for r in log.where(early).collect()]
    rest = [r["at_bat_number"] for r in log.where(~early).collect()]
    in_order = [r["at_bat_number"] for r in log.orderBy("game_date", "game_pk", "at_bat_number").collect()]
    assert sorted(first) == sorted(in_order[: int(fraction * 7)]) and sorted(first + rest) == list(range(7))


def test_sample_is_exact_and_independent_of_partitioning(spark):
    log = ordered_log(spark)
    key = ["at_bat_number", "pitch_number"]
    a = {tuple(r) for r in SP.sample_rows(log.repartition(3), key, 123).collect()}
    b = {tuple(r) for r in SP.sample_rows(log.repartition(11), key, 123).collect()}
    assert a == b and len(a) == 123
    assert SP.sample_rows(log, key, 5000).count() == 700
    assert SP.sample_fraction(log, key, 0.1).count() == 70


def seasons_log(spark, years):
    rows = []
    for y in years:
        for i, md in enumerate(["03-20", "04-01", "06-30", "07-01", "09-30", "10-01"]):
            rows.append((dt.date.fromisoformat(f"{y}-{md}"), 1, i, 1))
    return spark.createDataFrame(
        rows, "game_date date, game_pk long, at_bat_number long, pitch_number long"
    )


def counts(df):
    return {r["split"]: r["count"] for r in df.groupBy("split").count().collect()}


def test_auto_split_three_seasons(spark):
    got = SP.auto_split(seasons_log(spark, [2020, 2021, 2022, 2023]))
    assert counts(got) == {"train": 8, "val": 4, "test": 2}
    assert got.where("split = 'val'").select(F.year("game_date")).distinct().collect()[0][0] == 2022


def test_auto_split_two_seasons_splits_the_first(spark):
    got = SP.auto_split(seasons_log(spark, [2022, 2023]))
    assert counts(got) == {"train": 3, "val": 1, "test": 2}
    late = got.where("split = 'val'").first()["game_date"]
    assert late == dt.date(2022, 9, 30)


def test_auto_split_needs_two_seasons(spark):
    with pytest.raises(ValueError):
        SP.auto_split(seasons_log(spark, [2023]))
