"""Raw log to written feature table."""

import pytest
from pyspark.sql import functions as F

from pitlog import schema as S
from pitlog.catalog.standin import pitches
from pitlog.operators import selection as SL
from pitlog.operators import windows as W
from pitlog.plans import features as P
from pitlog.sources import readers, writers

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def raw(spark):
    """The stand-in log in landed form: no derived columns, dates as text, one column too many."""
    log = pitches(spark, SF).drop("pitch_type_can")
    return log.withColumn("game_date", F.col("game_date").cast("string")).withColumn("noise", F.lit(1))


def test_raw_to_written_features(spark, raw, tmp_path):
    ids = tmp_path / "ids.csv"
    ids.write_text("fg,mlbam\n500,1\n501,1\n700,3\nbad,4\n")
    log = P.prepare(raw, readers.read_crosswalk(spark, str(ids)))
    assert "noise" not in log.columns and dict(log.dtypes)["game_date"] == "date"
    table = P.historical_table(log)
    assert len(table.columns) == len(set(table.columns))
    missing = [c for c in S.SAFE_FEATURES if c not in table.columns and not c.startswith("FAM_PROB")]
    assert missing == []
    out = str(tmp_path / "features")
    writers.write_features(table, out)
    back = readers.read_season(spark, out)
    assert back.count() == raw.count()
    assert back.select(*S.PITCH_KEY).distinct().count() == raw.count()
    assert {r["pitcher_fg"] for r in back.where("pitcher = 1").select("pitcher_fg").distinct().collect()} <= {500}
    assert len(SL.safe_features(back)) == len(S.SAFE_FEATURES) - 3


def test_schema_does_not_depend_on_the_values_present(spark, raw):
    one_type = raw.where("pitch_type = 'FF'")
    full, part = P.historical_table(P.prepare(raw)), P.historical_table(P.prepare(one_type))
    assert full.dtypes == part.dtypes
    assert P.offline_table(P.prepare(raw)).dtypes == P.offline_table(P.prepare(one_type)).dtypes


def test_offline_table_columns(spark, raw):
    """80 including-today features with nine types in use; the fixed list has a tenth."""
    log = P.prepare(raw, table=S.CANONICAL_TYPES_TO_DATE, columns=S.OFFLINE_KEEP)
    table = P.offline_table(log)
    assert len(S.OFFLINE_KEEP) == len(set(S.OFFLINE_KEEP)) == 54
    assert set(table.columns) >= set(raw.columns) & set(S.OFFLINE_KEEP)
    made = [c for c in table.columns if c[:1].isupper()]
    assert len([c for c in made if not c.endswith("_ST")]) == 80


def test_window_frames_agree_with_running_features(spark, raw):
    log = P.prepare(raw)
    before = W.before_row(P.GAME, P.IN_GAME)
    order = W.in_order(P.GAME, P.IN_GAME)
    direct = log.select(
        *S.PITCH_KEY,
        F.count(F.lit(1)).over(before).alias("cum_game_pitches"),
        F.lag("pitch_type_can", 2).over(order).alias("prev_pitch_2"),
    )
    blocked = P.within_game(log, block_width=2).select(direct.columns)
    assert direct.exceptAll(blocked).count() == 0 and blocked.exceptAll(direct).count() == 0
