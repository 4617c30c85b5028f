import datetime as dt
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitlog import schema as S
from pitlog.functions import frames as FR
from pitlog.sources import landing, paths, readers, writers

TWELVE = (
    "game_date string, pitch_type string, events string, release_speed double, "
    "release_spin_rate long, hc_x double, hc_y double, stand string, p_throws string, "
    "home_team string, extra_col1 string, extra_col2 long"
)
ROWS = [
    ("2020-07-23", "FF", "single", 95.1, 2300, 100.0, 120.5, "L", "R", "NYY", "x", 1),
    ("2020-07-24", "SL", None, 85.0, 2500, None, None, "R", "L", "BOS", "y", 2),
    ("2020-07-25", "CH", "walk", 84.2, 1700, 90.1, 80.2, "L", "L", "LAD", "z", 3),
]


def test_strict_selection(spark):
    df = spark.createDataFrame(ROWS, TWELVE)
    assert FR.strict(df, S.CONVERT_COLUMNS).columns == S.CONVERT_COLUMNS
    with pytest.raises(ValueError):
        FR.strict(df.drop("hc_x"), S.CONVERT_COLUMNS)


def test_keep_uses_list_order_and_skips_absent(spark):
    df = spark.createDataFrame([(1, 2)], "pitcher long, game_pk long")
    assert FR.keep(df, S.FEATURE_KEEP).columns == ["game_pk", "pitcher"]


def test_csv_conversion_reads_every_file(spark, tmp_path):
    src, out = tmp_path / "csv", tmp_path / "out"
    src.mkdir()
    names = [c.split()[0] for c in TWELVE.split(", ")]
    for year in (2020, 2021):
        lines = [",".join(names)] + [",".join("" if v is None else str(v) for v in r) for r in ROWS]
        (src / f"pitches_{year}.csv").write_text("\n".join(lines) + "\n")
    landing.convert_csv(spark, str(src), str(out))
    got = spark.read.parquet(str(out))
    assert got.count() == 6 and set(got.columns) == {*S.CONVERT_COLUMNS, "year"}
    assert os.path.isdir(out / "year=2020") and os.path.isdir(out / "year=2021")
    files = [f for f in os.listdir(out / "year=2020") if f.endswith(".parquet")]
    assert files and all("snappy" in f for f in files)


def test_landing_types_partitions_and_ignores_existing(spark, tmp_path):
    out = str(tmp_path / "landed")
    raw = spark.createDataFrame(
        [("2023-04-01", "7", "95.5", "FF", "junk"), ("2024-05-01", "8", "bad", None, "junk")],
        "game_date string, game_pk string, release_speed string, pitch_type string, other string",
    )
    landing.land(raw, out)
    got = spark.read.parquet(out)
    assert dict(got.dtypes)["release_speed"] == "float" and dict(got.dtypes)["game_pk"] == "bigint"
    assert "other" not in got.columns
    assert {r["release_speed"] for r in got.collect()} == {95.5, None}
    assert readers.discover_seasons(spark, out) == [2023, 2024]
    landing.land(raw.limit(1), out)
    assert spark.read.parquet(out).count() == 2


def test_seasons_that_do_not_land_stay(spark, tmp_path):
    out, features = str(tmp_path / "landed"), str(tmp_path / "features")

    def season(year, *speeds):
        rows = [(f"{year}-05-01" if year else None, "7", str(s)) for s in speeds]
        return spark.createDataFrame(rows, "game_date string, game_pk string, release_speed string")

    def found(path):
        rows = spark.read.parquet(path).select("season", "release_speed").collect()
        return sorted(((r["season"] or 0, r["release_speed"]) for r in rows))

    landing.land(season(2022, 1, 2), out)
    landing.land(season(2023, 3).unionByName(season(2022, 9)), out)
    assert found(out) == [(2022, 1.0), (2022, 2.0), (2023, 3.0)]
    landing.land(season(2023, 4), out)
    landing.land(season(None, 5), out)
    landing.land(season(None, 6), out)
    assert found(out) == [(0, 5.0), (2022, 1.0), (2022, 2.0), (2023, 3.0)]
    landing.land(season(2023, 4, 5), out, mode="overwrite")
    assert found(out) == [(0, 5.0), (2022, 1.0), (2022, 2.0), (2023, 4.0), (2023, 5.0)]
    for year, speed in ((2022, 1), (2023, 2), (2023, 3)):
        writers.write_features(landing.clean_season(season(year, speed)), features)
    assert found(features) == [(2022, 1.0), (2023, 3.0)]


def test_feature_table_roundtrip(spark, tmp_path):
    path = str(tmp_path / "features")
    df = spark.createDataFrame(
        [(dt.date(2023, 4, 1), 1, 1.25), (dt.date(2024, 4, 1), 2, None)],
        "game_date date, pitcher long, velocity_7d double",
    )
    writers.write_features(df, path)
    got = spark.read.parquet(path)
    assert dict(got.dtypes)["velocity_7d"] == "float" and got.count() == 2
    files = os.listdir(f"{path}/season=2023")
    assert any("zstd" in f for f in files)
    pruned = got.where("season = 2023").select("velocity_7d")
    text = pruned._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(season" in text
    assert "ReadSchema: struct<velocity_7d:float>" in text


def test_season_files_merge_and_filter_at_the_scan(spark, tmp_path):
    a, b = str(tmp_path / "pitches_2022.parquet"), str(tmp_path / "pitches_2023.parquet")
    spark.createDataFrame([(dt.date(2022, 5, 1), 1)], "game_date date, x int").write.parquet(a)
    spark.createDataFrame([(dt.date(2023, 5, 1), 2, "n")], "game_date date, x int, y string").write.parquet(b)
    both = readers.read_seasons(spark, [a, b])
    assert sorted((r["x"], r["y"]) for r in both.collect()) == [(1, None), (2, "n")]
    ranged = readers.read_seasons(spark, [a, b], "2023-01-01:2023-05-01")
    assert ranged.count() == 1
    text = ranged._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(game_date), GreaterThanOrEqual(game_date,2023-01-01)" in text
    assert [r["season"] for r in readers.with_file_season(both).orderBy("x").collect()] == [2022, 2023]
    assert readers.read_columns(spark, b, ["x"]).columns == ["x"]


def test_csv_schema_matches_by_name_and_optional_is_none(spark, tmp_path):
    path = tmp_path / "park.csv"
    path.write_text("PF,home_team\n1.1,NYY\n")
    row = readers.read_park_factors(spark, str(path)).first()
    assert (row["home_team"], row["PF"]) == ("NYY", 1.1)
    assert readers.read_park_factors(spark, str(tmp_path / "none.csv")) is None


def test_conform_adds_typed_nulls(spark):
    df = spark.createDataFrame([("5",)], "game_pk string")
    got = FR.conform(df, T.StructType([S.RAW_PITCH["game_pk"], S.RAW_PITCH["zone"]]))
    assert got.dtypes == [("game_pk", "bigint"), ("zone", "int")]
    assert got.first() == (5, None)


def test_build_once_skips_finished_and_redoes_unfinished(spark, tmp_path):
    path = str(tmp_path / "once")
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    assert writers.build_once(spark, path, build) is True
    assert writers.build_once(spark, path, build) is False
    assert len(calls) == 1 and paths.committed(spark, path)
    (tmp_path / "broken").mkdir()
    assert writers.build_once(spark, str(tmp_path / "broken"), build) is True


def test_metrics_and_probabilities_roundtrip(spark, tmp_path):
    path = str(tmp_path / "metrics")
    writers.write_metrics(spark, path, {"acc": 0.5}, {"depth": "6"}, {"FF": 0.4}, ["balls"])
    row = readers_row = writers.read_metrics(spark, path).first()
    assert row["metrics"] == {"acc": 0.5} and readers_row["features"] == ["balls"]
    probs = spark.createDataFrame([(1, 1, 1, [0.4, 0.6])], "game_pk long, at_bat_number int, pitch_number int, probs array<double>")
    writers.write_probabilities(probs, str(tmp_path / "probs"), S.PITCH_KEY, "forest", ["FF", "SL"])
    got = writers.read_probabilities(spark, str(tmp_path / "probs"), "forest").first()
    assert got["probs"] == [0.4, 0.6] and got["classes"] == ["FF", "SL"]


def test_crosswalk_build(spark):
    players = spark.createDataFrame([("1", "10"), ("1", "10"), ("2", None)], "key_mlbam string, key_fangraphs string")
    assert sorted(map(tuple, readers.build_crosswalk(players).collect()), key=str) == [(1, 10), (2, None)]


def test_frame_helpers(spark):
    df = spark.createDataFrame([("1.5", None, 0), ("x", 2.0, 3)], "a string, b double, c int")
    assert [r["a"] for r in FR.to_number(df, ["a"]).collect()] == [1.5, None]
    filled = FR.fill(df, {"b": -1.0, "z": "NONE"}).first()
    assert filled["b"] == -1.0 and filled["z"] == "NONE"
    assert FR.align(df, ["c", "missing"]).columns == ["c", "missing"]
    assert FR.by_prefix(df, "a") == ["a"] and FR.by_suffix(df, "c") == ["c"] and FR.by_part(df, "b") == ["b"]
    sums = df.select(FR.row_sum([F.col("b"), F.col("c")]).alias("s")).collect()
    assert [r["s"] for r in sums] == [None, 5.0]
