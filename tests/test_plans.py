"""Plan shapes that must hold for the work to scale."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from pitlog.catalog.standin import pitches
from pitlog.models import context_tree as C
from pitlog.models import transitions as T
from pitlog.operators import joins as J
from pitlog.plans import audits as A
from pitlog.plans import features as P

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    df.collect()
    return plan(df)


def test_all_pitcher_families_take_one_scan_and_two_exchanges(spark):
    text = plan(P.pitcher_prior(pitches(spark, SF)))
    assert text.count("FileScan parquet") == 1
    assert text.count("Exchange hashpartitioning") == 2
    assert len(re.findall(r"\bWindow \[", text)) == 1


def test_rolling_aggregates_before_its_first_exchange(spark):
    text = plan(P.pitcher_prior(pitches(spark, SF)))
    below = text[text.rindex("Exchange hashpartitioning"):]
    assert "partial_" in below


def test_scan_reads_only_needed_columns(spark):
    text = plan(P.batter_prior(pitches(spark, SF)))
    schema = re.search(r"ReadSchema: (struct<[^>]*>)", text).group(1)
    assert "user_id" not in schema and "value" in schema


def test_no_python_and_no_cross_join_in_the_full_table(spark):
    text = plan(P.historical_table(pitches(spark, SF)))
    for bad in ("Python", "BatchEval", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in text


def test_full_table_joins_the_log_once_per_entity(spark):
    text = plan(P.historical_table(pitches(spark, SF)))
    joins = re.findall(r"(SortMergeJoin|BroadcastHashJoin|ShuffledHashJoin) \[(\w+)#", text)
    by_key = [k for _, k in joins]
    assert sorted(by_key) == ["batter", "pitcher"]


@pytest.fixture
def skew_settings(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
        "spark.sql.shuffle.partitions": "16",
    }
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_hot_entity_is_split_in_the_feature_join(spark, skew_settings):
    """Half of the log on one (pitcher, day): the left join splits that key's rows."""
    day = F.lit(dt.date(2024, 4, 1))
    log = spark.range(0, 200_000, 1, 8).select(
        F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id") % 5000 + 2).alias("pitcher"),
        day.alias("game_date"),
        F.sha2(F.col("id").cast("string"), 256).alias("payload"),
    )
    features = log.groupBy("pitcher", "game_date").agg(F.count(F.lit(1)).alias("n"))
    joined = J.attach_features(log, features, ["pitcher", "game_date"])
    sink = joined.groupBy("n").agg(F.count(F.lit(1)).alias("rows"), F.max("payload"))
    got = {r["n"]: r["rows"] for r in sink.collect()}
    assert got[100_000] == 100_000 and sum(got.values()) == 200_000
    assert "skew=true" in plan(sink)


def test_materialised_tables_use_the_shared_folder(spark):
    from pitlog.operators.lineage import materialise

    df = materialise(spark.range(5), "t")
    root = spark.conf.get("spark.checkpoint.dir")
    assert df.inputFiles()[0].replace("file://", "").startswith(root)
    assert df.count() == 5


def test_shares_scan_the_log_once(spark):
    from pitlog.operators.profile import value_counts, weighted_distribution

    log = pitches(spark, SF).withColumn("w", F.col("pitch_number") * 0.5)
    for df in (value_counts(log, "pitch_type"), weighted_distribution(log, "pitch_type_can", "w")):
        df.collect()
        text = plan(df).split("== Initial Plan ==")[0]
        assert "ReusedExchange" in text


@pytest.mark.parametrize(
    "build,scans,exchanges",
    [
        (P.within_game, 1, 1),  # F8 and F9
        (P.lag_block, 1, 1),  # F16
        (P.sequence_block, 1, 1),  # F17
        (lambda log: A.recompute_running(P.within_game(log)), 1, 1),
        (P.historical_table, 3, 5),
    ],
)
def test_ordinary_logs_are_read_and_shuffled_once_for_sequences(spark, build, scans, exchanges):
    text = plan(build(pitches(spark, SF)))
    assert text.count("FileScan parquet") == scans
    assert text.count("Exchange hashpartitioning") == exchanges


def test_transition_tables_group_the_rows_once(spark):
    log = pitches(spark, SF).withColumns({"a": F.coalesce("stand", F.lit("-")), "b": F.coalesce("p_throws", F.lit("-"))})
    contexts = [[], ["a"], ["a", "b"]]
    tables = T.transition_tables(log, contexts)
    out = plan(T.transition_probabilities(log, tables, contexts, 10))
    # One scan of the log; the others are of the small table of the finest context.
    assert out.count("events.parquet") == 1


def test_context_tree_scores_without_shuffling_the_rows(spark):
    log = pitches(spark, SF).withColumns({"a": F.coalesce("stand", F.lit("-")), "b": F.coalesce("p_throws", F.lit("-"))})
    text = plan(C.fit(log, ["a", "b"]).predict(log))
    assert text.count("events.parquet") == 1 and "SortMergeJoin" not in text and "CartesianProduct" not in text
