import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from pitlog import schema as S
from pitlog.catalog.model_queries import _features
from pitlog.functions import vectors as V
from pitlog.models import heads as H
from pitlog.models import registry as R
from pitlog.models import search as SE
from pitlog.plans import training as T

SF = "/root/testdata/sf0.001"
KEY = list(S.PITCH_KEY)
NUMERIC = ["balls", "strikes", "cum_game_pitches"]


@pytest.fixture(scope="module")
def split(spark):
    return T.split_features(_features(spark, SF))


@pytest.fixture(scope="module")
def head(split):
    return H.ClassHead(S.PITCH_TYPES, "pitch_type_can", H.FeatureSet(["stand", "count_state"], NUMERIC)).fit(split[0])


def test_split_keeps_time_order(split):
    train, val = split
    assert train.count() == 800 and val.count() == 200
    assert train.agg(F.max("game_date")).first()[0] <= val.agg(F.min("game_date")).first()[0]


def test_probabilities_sum_to_one_and_keep_keys(split, head):
    scored = head.score(split[1], KEY).withColumn("s", V.total(F.col("probs")))
    rows = scored.agg(F.count(F.lit(1)), F.min("s"), F.max("s"), F.countDistinct(*KEY)).first()
    assert rows[0] == rows[3] == 200
    assert rows[1] == pytest.approx(1.0) and rows[2] == pytest.approx(1.0)


def test_unseen_label_is_scored(split, head):
    odd = split[1].limit(1).withColumn("count_state", F.lit("4_3"))
    assert head.score(odd, KEY).count() == 1


def test_one_vs_rest_member_is_normalised(split):
    train = T.weighted(split[0])
    head = H.ClassHead(("BALL", "STRIKE", "IN_PLAY"), "side3", H.FeatureSet(["stand"], NUMERIC), H.one_vs_rest(64), "w")
    rows = train.withColumn("side3", F.element_at(F.array(F.lit("BALL"), F.lit("STRIKE"), F.lit("IN_PLAY")), (F.col("pitch_number") % 3 + 1).cast("int")))
    head.fit(rows)
    totals = head.score(rows, KEY).select(V.total(F.col("probs")).alias("s"))
    assert totals.agg(F.min("s")).first()[0] == pytest.approx(1.0)


def test_one_vs_rest_probabilities_are_those_of_its_members(split):
    train = T.weighted(split[0]).withColumn("side", F.element_at(F.array(*map(F.lit, "abc")), (F.col("balls") % 3 + 1).cast("int")))
    head = H.ClassHead("abc", "side", H.FeatureSet([], ["strikes", "pitch_number"]), H.one_vs_rest(), "w")
    head.fit(train)
    rows = head.features.transform(train).orderBy(*KEY).limit(20)
    own = [
        [r["p"][1] for r in m.transform(rows).select(vector_to_array("probability").alias("p")).collect()]
        for m in head.model.models
    ]
    got = [r["probs"] for r in head.score(rows.drop("features"), KEY).collect()]
    for i, probs in enumerate(got):
        total = sum(member[i] for member in own)
        assert probs == pytest.approx([member[i] / total for member in own])


def test_fitting_without_an_input_is_an_error(split):
    with pytest.raises(ValueError, match="no_such"):
        H.FeatureSet(["stand"], ["balls", "no_such"]).fit(split[0])
    ones = H.FeatureSet(["stand"], ["balls"], one_hot=True).fit(split[0])
    sizes = {r["features"].size for r in ones.transform(split[1]).select("features").limit(3).collect()}
    stands = split[0].select("stand").distinct().count()
    assert sizes == {1 + stands + 1}  # one for labels that training has not seen


def test_attach_adds_group_columns(split, head):
    out = head.attach(split[1], "PT_PROB_", S.PROBABILITY_GROUPS)
    row = out.select([c for c in out.columns if c.startswith("PT_PROB_")]).first()
    assert row["PT_PROB_FASTBALL_GROUP"] == pytest.approx(
        row["PT_PROB_FF"] + row["PT_PROB_SI"] + row["PT_PROB_FC"]
    )
    assert out.count() == 200


def test_value_by_type_uses_default_without_a_model(split):
    heads = H.value_by_type(split[0], "estimated_woba_using_speedangle", NUMERIC)
    assert set(heads) <= set(S.SEQUENCE_TYPES)
    only = {"FF": heads["FF"]}
    rows = split[1].withColumn("p", F.array(F.lit(0.0), F.lit(1.0)))
    got = H.expected_value(rows, only, "p", ["FF", "ST"])
    assert {r["expected_xwoba"] for r in got.collect()} == {S.DEFAULT_XWOBA}


def test_registry_returns_newest_with_weights(spark, head, tmp_path):
    root = str(tmp_path / "models")
    assert R.newest_with_weights(spark, root) is None
    R.save_checkpoint(spark, root, {"forest": head}, 100, {"forest": 1.0})
    R.save_checkpoint(spark, root, {"forest": head}, 200)
    found = R.newest_with_weights(spark, root)
    assert found["forest"][1] == 1.0 and found["forest"][0].endswith("checkpoint_100/forest")
    assert len(R.load(found["forest"][0]).stages) == 2


def test_search_orders_trials_by_loss(split):
    settings = [{"numTrees": 2, "maxDepth": 2}, {"numTrees": 4, "maxDepth": 3}]
    results = SE.search(
        split[0], split[1],
        lambda p: RandomForestClassifier(seed=1, weightCol="w", **p),
        S.PITCH_TYPES, "pitch_type_can", (["stand"], NUMERIC), settings,
    )
    losses = [r["log_loss"] for r in SE.best_trials(results).collect()]
    assert len(losses) == 2 and losses == sorted(losses)
    assert SE.trials(SE.TRIAL_SPACE, 3) == SE.trials(SE.TRIAL_SPACE, 3)


def test_importance_names_match_features(head):
    names = {r["feature"] for r in H.importances(head).collect()}
    assert names == {"stand", "count_state", *NUMERIC}
