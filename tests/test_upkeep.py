"""Time travel, outliers, sketches, drifting schemas, incremental builds, halving, the write gate."""

import datetime
import os
import random
import shutil

import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from pitlog import schema as S
from pitlog.catalog.standin import pitches
from pitlog.models import search as SE
from pitlog.operators import outliers as O
from pitlog.operators import sketches as K
from pitlog.operators.rolling import Frame, rolling_features
from pitlog.plans import audits as A
from pitlog.plans import features as FE
from pitlog.plans import time_travel as TT
from pitlog.plans.incremental import Build
from pitlog.sources import drift as D
from pitlog.sources import writers
from pitlog.sources.readers import read_seasons

SF = "/root/testdata/sf0.001"
DAY = datetime.date


@pytest.fixture(scope="module")
def log(spark):
    return pitches(spark, SF).persist()


# --- time travel ---------------------------------------------------------------------------

def prior():
    return {
        "pitcher": [FE.arsenal_and_usage(), FE.count_state_family(), FE.form_family(), FE.platoon_family()],
        "batter": [FE.batter_xwoba_family(), FE.k_rate_family()],
    }


def values(report):
    return {r["item"]: r["value"] for r in report.collect()}


def test_clean_tables_have_no_differences(log):
    table = FE.historical_table(log)
    report = values(TT.time_travel_all(table, log, prior(), share=1.0))
    assert len(report) > 60 and set(report.values()) == {0.0}
    today = [*FE.arsenal_to_date_families(), FE.form_with_today_family(), FE.platoon_with_today_family()]
    report = values(TT.time_travel(FE.pitcher_with_today(log), log, "pitcher", today, share=1.0))
    assert len(report) > 40 and set(report.values()) == {0.0}


@pytest.mark.parametrize("make", [FE.arsenal_family, FE.count_state_family, FE.form_family, FE.platoon_family])
def test_a_leak_of_the_day_itself_is_found_in_each_family(log, make):
    family = make()
    from dataclasses import replace

    leaky = replace(family, frame=Frame(family.frame.days, with_today=True))
    table = rolling_features(log, "pitcher", "game_date", [leaky])
    found = values(TT.time_travel(table, log, "pitcher", [family], share=1.0))
    assert sum(v > 0 for v in found.values()) > len(found) / 2


def test_a_missed_row_and_a_later_row_are_found(spark):
    rows = [(1, DAY(2024, 1, d), float(d), "ball", None) for d in range(1, 29)]
    log = spark.createDataFrame(rows, "pitcher long, game_date date, release_speed double, description string, events string")
    family = FE.form_family()
    table = rolling_features(log, "pitcher", "game_date", [family])
    assert set(values(TT.time_travel(table, log, "pitcher", [family], share=1.0)).values()) == {0.0}
    late = rolling_features(log.where("game_date != '2024-01-10'"), "pitcher", "game_date", [family])
    found = values(TT.time_travel(late, log, "pitcher", [family], share=1.0))
    assert found["velocity_7d"] == 6
    shifted = table.withColumn("velocity_7d", F.when(F.col("game_date") == "2024-01-20", 99.0).otherwise(F.col("velocity_7d")))
    assert values(TT.time_travel(shifted, log, "pitcher", [family], share=1.0))["velocity_7d"] == 1
    gone = table.withColumn("velocity_7d", F.when(F.col("game_date") != "2024-01-20", F.col("velocity_7d")))
    assert values(TT.time_travel(gone, log, "pitcher", [family], share=1.0))["velocity_7d"] == 1
    share = log.select(TT.picked("pitcher", "game_date", 0.5).alias("p")).agg(F.avg(F.col("p").cast("int"))).first()[0]
    assert 0.2 < share < 0.8


def test_running_spin_is_recomputed(log):
    good = FE.within_game(log)
    assert set(values(A.recompute_running(good)).values()) == {0.0}
    bad = good.withColumn("cum_ff_spin", F.col("cum_ff_spin") + 1)
    assert values(A.recompute_running(bad))["cum_ff_spin"] > 0


# --- outliers and sketches ---------------------------------------------------------------------


def test_planted_outliers_are_found_and_blanked(spark):
    r = random.Random(2)
    rows = [("a" if i % 3 else "b", r.gauss(90 if i % 3 else 70, 2), r.gauss(2000, 50)) for i in range(3000)]
    rows += [("a", 200.0, 2000.0), ("b", 90.0, None), ("b", 70.0, -5.0), (None, 500.0, 1.0), ("few", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "t string, v double, s double")
    limits = O.fences(K.sketches(df, ["t"], ["v", "s"]), ["t"], ["v", "s"])
    out = O.mark_outliers(df, limits, ["t"], ["v", "s"])
    flagged = {(x.t, x.v, x.s) for x in out.where("v_outlier OR s_outlier").collect()}
    assert flagged == {("a", 200.0, 2000.0), ("b", 90.0, None), ("b", 70.0, -5.0)}
    blank = O.mark_outliers(df, limits, ["t"], ["v", "s"], flags=False, blank=True)
    assert blank.columns == df.columns and blank.count() == len(rows)
    assert blank.where("t = 'a'").agg(F.max("v")).first()[0] < 110
    assert blank.where("t IS NULL").first().v == 500.0 and blank.where("t = 'few'").first().v == 1.0
    assert O.without_outliers(df, ["t"], ["v"]).agg(F.count("v")).first()[0] == len(rows) - 2
    assert O.without_outliers(df.limit(0), ["t"], ["v"]).count() == 0


def test_united_sketches_answer_for_the_union(spark):
    rows = [(i % 4, i % 977, float((i * 7919) % 20011)) for i in range(20000)] + [(9, None, None)]
    df = spark.createDataFrame(rows, "season long, id long, x double")
    stored = K.sketches(df, ["season"], ["x"], ["id"], k=256)
    one = K.united(stored).select("n_rows", K.distinct("id").alias("d"), K.quantile("x", 0.5).alias("m")).first()
    assert one.n_rows == 20001 and abs(one.d / 977 - 1) <= K.count_error()
    xs = sorted(x for _, _, x in rows if x is not None)
    assert abs(sum(x <= one.m for x in xs) / len(xs) - 0.5) <= K.rank_error(256)
    by = {r.season: r.m for r in stored.select("season", K.quantile("x", 0.5).alias("m")).collect()}
    assert by[9] is None and len(by) == 5


# --- drifting schemas ----------------------------------------------------------------------------


def season(spark, path, schema, rows):
    spark.createDataFrame(rows, schema).write.parquet(path)
    return path


def test_four_seasons_of_four_schemas(spark, tmp_path):
    d = [DAY(2020 + i, 5, 1) for i in range(4)]
    paths = [
        season(spark, str(tmp_path / "a"), "game_date date, balls int, speed float", [(d[0], 1, 1.5)]),
        season(spark, str(tmp_path / "b"), "game_date date, balls double, speed double, extra string", [(d[1], 2.5, 2.5, "x")]),
        season(spark, str(tmp_path / "c"), "speed float, game_date date", [(3.5, d[2])]),
        season(spark, str(tmp_path / "d"), "balls long, speed float, game_date date", [(4, 4.5, d[3])]),
    ]
    df = read_seasons(spark, paths)
    assert df.schema.simpleString() == "struct<game_date:date,balls:double,speed:double,extra:string>"
    assert [tuple(r) for r in df.orderBy("game_date").collect()] == [
        (d[0], 1.0, 1.5, None), (d[1], 2.5, 2.5, "x"), (d[2], None, 3.5, None), (d[3], 4.0, 4.5, None),
    ]
    some = D.read_drifting(spark, paths, "2021-01-01:2022-12-31", columns=["balls", "game_date"])
    assert sorted(str(r.balls) for r in some.collect()) == ["2.5", "None"]
    plan = some._jdf.queryExecution().toString()
    # A scan for each set of types, with the range; the file without ``balls`` joins another one.
    assert plan.count("PushedFilters: [IsNotNull(game_date), GreaterThanOrEqual(game_date,2021-01-01)") == 3
    assert "speed" not in plan.split("Physical Plan")[1]
    found = {(r.column_name, r.data_type): r.n_paths for r in D.drift_report(spark, paths).collect()}
    assert found["balls", "int"] == 1 and found["speed", "float"] == 3
    with pytest.raises(ValueError, match="nowhere"):
        D.read_drifting(spark, paths, columns=["nowhere"])


def test_conflicts_name_the_files_and_text_days_are_filtered(spark, tmp_path):
    a = season(spark, str(tmp_path / "a"), "game_date date, v int", [(DAY(2020, 1, 1), 1), (DAY(2021, 1, 1), 2)])
    b = season(spark, str(tmp_path / "b"), "game_date string, v array<int>", [("2020-06-01", [1])])
    with pytest.raises(D.SchemaConflict) as e:
        D.read_drifting(spark, [a, b])
    assert e.value.conflicts["v"] == {"int": [a], "array<int>": [b]} and a in str(e.value)
    c = season(spark, str(tmp_path / "c"), "game_date string, v long", [("2020-06-01", 7), ("2021-06-01", 8)])
    rows = D.read_drifting(spark, [a, c], "2020-01-01:2020-12-31").collect()
    assert sorted((r.game_date, r.v) for r in rows) == [("2020-01-01", 1), ("2020-06-01", 7)]


def test_lattice_is_symmetric():
    from pyspark.sql import types as T

    kinds = [T.ByteType(), T.IntegerType(), T.LongType(), T.FloatType(), T.DoubleType(), T.DateType(), T.StringType(),
             T.TimestampType(), T.BooleanType(), T.ArrayType(T.IntegerType()), T.NullType()]
    for a in kinds:
        for b in kinds:
            assert D.wider(a, b) == D.wider(b, a)
            for wide in [D.wider(a, b)]:
                assert wide is None or D.wider(wide, a) == wide
    assert D.wider(T.LongType(), T.FloatType()) == T.DoubleType() and D.wider(T.DateType(), T.IntegerType()) is None


# --- incremental builds ---------------------------------------------------------------------------


def log_rows(days, seed=0):
    r = random.Random(seed)
    return [
        (e, DAY(2024, 1, 1) + datetime.timedelta(days=d), r.gauss(90, 3), "swinging_strike" if r.random() < 0.3 else "ball", None)
        for d in days
        for e in (1, 2, 3)
        for _ in range(r.randrange(4))
    ]


LOG = "pitcher long, game_date date, release_speed double, description string, events string"


def put(spark, build, season, rows):
    path = f"{build.log}/season={season}"
    shutil.rmtree(path, ignore_errors=True)
    spark.createDataFrame(rows, LOG).coalesce(2).write.parquet(path)


def assert_same(build, spark, parts):
    every = spark.createDataFrame([r for rows in parts.values() for r in rows], LOG)
    want = rolling_features(every, "pitcher", "game_date", [FE.form_family()])
    got = build.features(spark).select(*want.columns)
    key = lambda r: (r.pitcher, r.game_date)
    a, b = sorted(got.collect(), key=key), sorted(want.collect(), key=key)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert key(x) == key(y)
        for c in want.columns[2:]:
            assert x[c] == y[c] or x[c] == pytest.approx(y[c]), (x, y)


def test_build_by_day_equals_the_full_build(spark, tmp_path):
    reads = []

    def read(session, folders):
        reads.append([os.path.basename(f) for f in folders])
        return session.read.parquet(*folders)

    build = Build(str(tmp_path / "log"), str(tmp_path / "out"), "pitcher", [FE.form_family()], read)
    assert build.update(spark).seasons == ()
    parts = {"a": log_rows(range(0, 20), 1), "b": log_rows(range(40, 55), 2)}
    for s, rows in parts.items():
        put(spark, build, s, rows)
        build.update(spark)
    assert_same(build, spark, parts)
    # A new day: only its season is read, and only days whose frames reach it are rolled.
    reads.clear()
    parts["b"] = parts["b"] + log_rows([55], 3) + [(1, DAY(2024, 1, 1) + datetime.timedelta(days=55), 95.0, "ball", None)]
    put(spark, build, "b", parts["b"])
    done = build.update(spark)
    assert {s for one in reads for s in one} == {"season=b"}
    assert done.changed == (DAY(2024, 2, 25),) and done.rolled == (DAY(2024, 2, 25),)
    assert_same(build, spark, parts)
    assert build.update(spark) == type(done)((), (), ())
    # A corrected row in the middle, and a day that loses its rows.
    lost = parts["a"][0][1]
    parts["a"] = [(e, d, v + (d == DAY(2024, 1, 10)), x, y) for e, d, v, x, y in parts["a"] if d != lost]
    put(spark, build, "a", parts["a"])
    done = build.update(spark)
    assert set(done.changed) == {lost, DAY(2024, 1, 10)}
    assert max(done.rolled) <= DAY(2024, 1, 16)
    assert_same(build, spark, parts)
    # A season that is gone.
    shutil.rmtree(f"{build.log}/season=a")
    build.update(spark)
    assert_same(build, spark, {"b": parts["b"]})


def test_a_half_written_day_is_built_again(spark, tmp_path, monkeypatch):
    build = Build(str(tmp_path / "log"), str(tmp_path / "out"), "pitcher", [FE.form_family()],
                  lambda session, folders: session.read.parquet(*folders))
    parts = {"a": log_rows(range(0, 12), 5)}
    put(spark, build, "a", parts["a"])
    build.update(spark)
    parts["a"] = parts["a"] + [(1, DAY(2024, 1, 13), 99.0, "ball", None)]
    put(spark, build, "a", parts["a"])
    whole = Build._replace

    def breaks(self, session, df, table, days):
        if table == "features":
            raise RuntimeError("lost")
        whole(self, session, df, table, days)

    monkeypatch.setattr(Build, "_replace", breaks)
    with pytest.raises(RuntimeError):
        build.update(spark)
    monkeypatch.setattr(Build, "_replace", whole)
    assert build.update(spark).changed == (DAY(2024, 1, 13),)
    assert_same(build, spark, parts)


# --- halving and the gate ---------------------------------------------------------------------------


def test_halving_finds_the_planted_setting_and_resumes(spark, tmp_path):
    r = random.Random(6)
    # Three bands with some noise: one cut is too few, very deep trees learn the noise.
    band = lambda x: "ab"[int(3 * x) % 2] if r.random() < 0.85 else r.choice("ab")
    rows = [(i, x := r.random(), r.random(), band(x)) for i in range(3000)]
    df = spark.createDataFrame(rows, "i long, x double, z double, c string").withColumn("w", F.lit(1.0))
    train, val = df.where("i % 4 != 0"), df.where("i % 4 = 0")
    settings = [{"maxDepth": 1}, {"maxDepth": 2}, {"maxDepth": 12}, {"maxDepth": 0}]
    made = []

    def make(params):
        made.append(params["maxDepth"])
        return RandomForestClassifier(numTrees=1, featureSubsetStrategy="all", seed=1, weightCol="w", **params)

    def run():
        return SE.halving(train, val, make, "ab", "c", ([], ["x", "z"]), settings, ["i"], str(tmp_path / "s"), factor=2)

    results = run().collect()
    assert SE.best_params(run()) == {"maxDepth": 2} and len(made) == len(results) == 4 + 2 + 1
    assert {(x.rung, round(x.share, 4)) for x in results} == {(0, 0.25), (1, 0.5), (2, 1.0)}
    small, large = (SE.sampled(train, ["i"], s) for s in (0.25, 0.5))
    assert small.join(large, "i", "left_anti").isEmpty() and 400 < small.count() < 700
    # What a broken run has fitted is not fitted again.
    made.clear()

    def breaks(params):
        if len(made) == 4:
            raise RuntimeError("lost")
        return make(params)

    args = (train, val, breaks, "ab", "c", ([], ["x", "z"]), settings, ["i"], str(tmp_path / "t"), 2, 1)
    with pytest.raises(RuntimeError):
        SE.halving(*args)
    first = len(made)
    again = SE.halving(*args[:2], make, *args[3:])
    assert first == 4 and len(made) == 7 and SE.best_params(again) == {"maxDepth": 2}


def test_write_gate_stops_leaks(spark, tmp_path, log):
    table = FE.within_game(log)
    writers.write_features(table, str(tmp_path / "ok"), features=["balls", "cum_ff_velocity"], gate=A.leak_gate)
    with pytest.raises(ValueError, match="release_speed"):
        writers.write_features(table, str(tmp_path / "bad"), features=["balls", "release_speed"])
    assert not os.path.exists(tmp_path / "bad")
    odd = table.withColumn("my_release_speed_copy", F.col("release_speed"))
    with pytest.raises(ValueError, match="my_release_speed_copy"):
        writers.write_features(odd, str(tmp_path / "bad"), features=["my_release_speed_copy"], gate=A.leak_gate)
    assert not os.path.exists(tmp_path / "bad") and S.LEAK_TOKENS
