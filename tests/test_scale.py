"""What fits compute, encode and write, and how often: their time grows with the rows, not with the passes."""

import random

import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from pitlog.models import heads as H
from pitlog.models import search as SE
from pitlog.plans import stacking as ST
from pitlog.plans import training as T

UNREAD = ["usage_30d_KC", "plate_x", "velocity_30d"]


class Stop(Exception):
    pass


def wide(spark):
    """One row of every column the reports read, and of some they do not."""
    names = dict.fromkeys([*T.S.PITCH_KEY, *T.NUMERIC, "target", *UNREAD])
    text = dict.fromkeys([*T.CATEGORICAL, *T.CONTEXTS, "pitch_type_can", "events", "description"])
    row = spark.range(1).select(F.to_date(F.lit("2024-04-01")).alias("game_date"), *[F.lit(1).alias(n) for n in names])
    return row.withColumns({n: F.lit("FF") for n in text})


@pytest.mark.parametrize(
    "report",
    [
        T.sequence_blend_report,
        T.outcome_report,
        T.chain_report,
        lambda df: T.forest_report(df, "target"),
        lambda df: T.value_report(df, "target"),
    ],
)
def test_reports_write_what_they_read(spark, monkeypatch, report):
    written = []

    def stop(df, *_):
        written.append(df.columns)
        raise Stop

    for module in (T, ST):
        monkeypatch.setattr(module, "materialise", stop)
    with pytest.raises(Stop):
        report(wide(spark))
    assert {*T.CATEGORICAL, *T.NUMERIC, "pitch_type_can", "game_date"} <= set(written[0])
    assert not set(UNREAD) & set(written[0])


def test_blocks_are_counted_on_written_rows(spark, monkeypatch):
    seen, count = [], ST.day_blocks
    monkeypatch.setattr(ST, "day_blocks", lambda df, *a: seen.append(df.inputFiles()) or count(df, *a))
    days = spark.range(40).withColumn("game_date", F.date_add(F.lit("2024-04-01").cast("date"), F.col("id").cast("int")))
    assert ST.blocked(days).groupBy("block").count().count() == ST.BLOCKS
    assert seen[0]


def test_heads_fit_on_written_vectors(spark):
    class Fake:
        def fit(self, rows):
            self.rows = rows

    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "c string, x double")
    fake, features = Fake(), H.FeatureSet([], ["x"])
    H.ClassHead("ab", "c", features, fake).fit(df)
    assert fake.rows.inputFiles() and fake.rows.count() == 2
    value = Fake()
    H.ValueHead("x", features, value).fit(df)
    assert value.rows.inputFiles() and value.rows.count() == 2


def test_a_search_encodes_once(spark, monkeypatch):
    calls, encoder = [], H.encoder
    monkeypatch.setattr(H, "encoder", lambda *a: calls.append(a) or encoder(*a))
    r = random.Random(3)
    df = spark.createDataFrame([(r.choice("ab"), r.random()) for _ in range(60)], "c string, x double")
    make = lambda p: RandomForestClassifier(seed=1, weightCol="w", **p)
    settings = [{"numTrees": 1, "maxDepth": 1}, {"numTrees": 2, "maxDepth": 1}]
    found = SE.search(df, df, make, "ab", "c", ([], ["x"]), settings)
    assert found.count() == 2 and len(calls) == 1


def test_a_searched_ensemble_writes_its_features_once(spark, monkeypatch):
    calls, split = [], T.split_features

    def stop(*_, **__):
        raise Stop

    monkeypatch.setattr(T, "split_features", lambda *a: calls.append(a) or split(*a))
    monkeypatch.setattr(T.SE, "halving", lambda *a: None)
    monkeypatch.setattr(T.SE, "best_params", lambda _: {})
    monkeypatch.setattr(T, "model_inputs", stop)
    days = F.date_add(F.lit("2024-04-01").cast("date"), F.col("id").cast("int"))
    rows = wide(spark).drop("game_date").crossJoin(spark.range(20).select(days.alias("game_date")))
    with pytest.raises(Stop):
        T.searched_ensemble_report(rows, [{"numTrees": 1}], "nowhere")
    assert len(calls) == 1
