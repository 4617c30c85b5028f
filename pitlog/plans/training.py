"""End-to-end training plans: split, weight, fit, blend, evaluate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from pitlog import schema as S
from pitlog.functions import vectors as V
from pitlog.functions.weights import class_weight, time_decay
from pitlog.models import context_tree as CT
from pitlog.models import heads as H
from pitlog.models import search as SE
from pitlog.operators.joins import attach_features
from pitlog.operators import selection as SL
from pitlog.operators.lineage import materialise
from pitlog.operators.splits import day_blocks, first_fraction, pitch_order
from pitlog.plans import blending as B
from pitlog.plans import metrics as M
from pitlog.plans import stacking as ST

CATEGORICAL = ("stand", "p_throws", "count_state", "prev_pitch_1", "prev_pitch_2")
NUMERIC = (
    "balls", "strikes", "outs_when_up", "home_score", "away_score", "dvelo1",
    "cum_game_pitches", "cum_ff_count", "cum_sl_count", "cum_ch_count",
    "velocity_7d", "whiff_rate_7d", "hit_rate_7d", "k_rate_30d",
    "usage_30d_FF", "usage_30d_SL", "usage_30d_CH",
)
Y = "y"


def narrowed(
    features: DataFrame,
    *more: str,
    inputs: Sequence[str] = (*CATEGORICAL, *NUMERIC),
) -> DataFrame:
    """Key, day, type, model inputs and columns ``more``: what no model reads is neither computed nor written."""
    wanted = {*S.PITCH_KEY, "game_date", "pitch_type_can", *inputs, *more}
    return features.select(*[c for c in features.columns if c in wanted])


def split_features(features: DataFrame, name: str = "features") -> tuple[DataFrame, DataFrame]:
    """The first 80 % of the rows in time order, and the rest, from one written table."""
    table = materialise(features, name)
    early = first_fraction(table, pitch_order(), 0.8)
    return table.where(early), table.where(~early)


def weighted(train: DataFrame, rate: float = S.DECAY) -> DataFrame:
    """Column ``w``: recency times class factor."""
    latest = train.agg(F.max("game_date")).scalar()
    return train.withColumn(
        "w",
        time_decay(F.col("game_date").cast("date"), latest, rate)
        * class_weight(F.col("pitch_type_can")),
    )


def with_truth(df: DataFrame, classes: Sequence[str], label: str) -> DataFrame:
    """Column ``y``, the class position; rows outside the classes are dropped."""
    y = H.label_position(F.col(label), classes).cast("int")
    return df.withColumn(Y, y).where(F.col(Y).isNotNull())


def evaluate(head: H.ClassHead, df: DataFrame, model: str) -> DataFrame:
    scored = head.score_onto(with_truth(df, head.classes, head.label))
    return _named(M.classification_metrics(scored), model)


def _named(metrics: DataFrame, model: str) -> DataFrame:
    return metrics.select(F.lit(model).alias("model"), "metric", "value")


def model_inputs(df: DataFrame) -> tuple[list[str], list[str]]:
    """The features known before the pitch that ``df`` has, as (categorical, numeric)."""
    names = SL.safe_features(df)
    text = [c for c in names if isinstance(df.schema[c].dataType, StringType)]
    return text, [c for c in names if c not in text]


def ensemble_report(features: DataFrame, size: int = 1, forest: Mapping | None = None) -> DataFrame:
    """(model, metric, value) on validation rows: three members, and their best blend.

    The last fifth of the training days decides when boosting stops. The members score the same
    rows one after the other, as projections of one scan. ``forest`` are the forest's parameters
    (see ``searched_ensemble_report``).
    """
    return _ensemble_report(*split_features(features), size, forest)


def _ensemble_report(train: DataFrame, val: DataFrame, size: int, forest: Mapping | None) -> DataFrame:
    train = weighted(train).withColumn("held", day_blocks(train, 5) == 4)
    members = H.type_ensemble(train, *model_inputs(train), size=size, validation="held", forest=forest)
    names = [f"p{i}" for i in range(len(members))]
    scored = with_truth(val, S.PITCH_TYPES, "pitch_type_can")
    for name, head in zip(names, members.values()):
        scored = head.score_onto(scored, name)
    scored = materialise(scored.select(*S.PITCH_KEY, Y, *names), "scores")
    best = B.best_weights(B.score_weights(scored, names, Y, B.tenths_grid(len(members)))).first()
    blend = B.blended(scored, names, [best[f"w{i}"] for i in range(len(members))])
    reports = [_named(M.classification_metrics(scored, Y, p), m) for m, p in zip(members, names)]
    reports.append(_named(M.classification_metrics(blend, Y), "blend"))
    return reduce(DataFrame.unionByName, reports)


def searched_ensemble_report(
    features: DataFrame, settings: Sequence[dict], store: str, size: int = 1
) -> DataFrame:
    """The ensemble's report with the forest parameters that halving finds best.

    The search is fitted and judged on training rows only: their last fifth of days is its
    validation set, so the report's rows have no part in the choice.
    """
    train, val = split_features(features)
    rows = narrowed(train).withColumn("held", day_blocks(train, 5) == 4)
    rows = materialise(rows.withColumn("w", F.lit(1.0)), "search")
    results = SE.halving(
        rows.where("not held"),
        rows.where("held"),
        lambda p: RandomForestClassifier(seed=H.SEED, weightCol="w", maxBins=64, **p),
        S.PITCH_TYPES,
        "pitch_type_can",
        (CATEGORICAL, NUMERIC),
        settings,
        S.PITCH_KEY,
        store,
    )
    return _ensemble_report(train, val, size, SE.best_params(results))


CONTEXTS = ("prev_pitch_1", "count_state", "prev_pitch_2", "prev_pitch_3")


def sequence_blend_report(features: DataFrame) -> DataFrame:
    """(model, metric, value) on the last block: a tree member, the context tree, and their blend.

    Both members are fitted on the first three blocks, of which the third stops the boosting and
    prunes the contexts; the fourth chooses the weights among the candidates; the fifth judges.
    """
    lags = {c: F.coalesce(c, F.lit("NONE")) for c in CONTEXTS if c.startswith("prev_")}
    features = narrowed(features, *CONTEXTS)
    table = ST.blocked(features.withColumn("count_state", F.coalesce("count_state", F.lit("0_0"))))
    train = table.where(F.col(ST.BLOCK) < 3).withColumn("held", F.col(ST.BLOCK) == 2)
    inputs = H.FeatureSet(CATEGORICAL, NUMERIC).fit(train.where("not held"))
    vectors = materialise(inputs.transform(train).select("pitch_type_can", "held", "features"), "vectors")
    head = H.boosted_head(
        vectors, "pitch_type_can", S.PITCH_TYPES, inputs, validation="held", rounds=8, depth=4, rate=0.3, patience=3
    )
    tree = CT.fit(train.withColumns(lags), CONTEXTS, held=F.col("held"), refit=True)
    later = with_truth(table.where(F.col(ST.BLOCK) >= 3), S.PITCH_TYPES, "pitch_type_can")
    scored = tree.predict(head.score_onto(later, "p0").withColumns(lags), "p1")
    scored = materialise(scored.select(*S.PITCH_KEY, ST.BLOCK, Y, "p0", "p1"), "members", [ST.BLOCK])
    choice, judged = scored.where(F.col(ST.BLOCK) == 3), scored.where(F.col(ST.BLOCK) > 3)
    best = B.best_weights(B.score_weights(choice, ["p0", "p1"], Y, B.SEQUENCE_WEIGHTS)).first()
    blend = B.blended(judged, ["p0", "p1"], [best["w0"], best["w1"]])
    reports = [
        _named(M.classification_metrics(judged, Y, "p0"), "boosted"),
        _named(M.classification_metrics(judged, Y, "p1"), "context_tree"),
        _named(M.classification_metrics(blend, Y), "blend"),
    ]
    return reduce(DataFrame.unionByName, reports)


def family_features(features: DataFrame) -> DataFrame:
    """Every row with family probabilities of a head that was fitted on earlier blocks only."""
    table = ST.blocked(features)
    fit = lambda train: H.family_head(train, CATEGORICAL, NUMERIC)
    return ST.stacked(table, fit, S.FAMILIES, "FAM_PROB_")


def type_head(train: DataFrame) -> H.ClassHead:
    return H.ClassHead(S.PITCH_TYPES, "pitch_type_can", H.FeatureSet(CATEGORICAL, NUMERIC)).fit(train)


def linear_type_head(train: DataFrame) -> H.ClassHead:
    linear = H.ensemble_members(len(S.PITCH_TYPES))["linear"]
    features = H.FeatureSet(CATEGORICAL, NUMERIC, one_hot=True)
    return H.ClassHead(S.PITCH_TYPES, "pitch_type_can", features, linear.setWeightCol("w")).fit(train)


def stacked_features(features: DataFrame) -> DataFrame:
    """Every row with out-of-sample type probabilities, their groups, maximum and entropy."""
    return ST.stacked(ST.blocked(features), type_head, S.PITCH_TYPES, "PT_PROB_", S.PROBABILITY_GROUPS)


def outcome_report(features: DataFrame) -> DataFrame:
    """(model, metric, value) of both outcome stages on the out-of-sample blend of two type heads."""
    features = narrowed(features, "events", "description")
    table = ST.blocked(features.withColumn("_y", H.label_position(F.col("pitch_type_can"), S.PITCH_TYPES).cast("int")))
    fits = {"forest": type_head, "linear": linear_type_head}
    rows, _ = ST.blended_members(table, fits, "_y", S.PITCH_TYPES)
    return ST.outcome_report(rows)


def boosting_report(features: DataFrame, **settings) -> DataFrame:
    """(model, metric, value) of multiclass boosting on later rows, and of the class shares.

    The last fifth of the training days decides when boosting stops; ``rounds`` is what it kept.
    """
    train, val = split_features(features)
    train = train.withColumn("held", day_blocks(train, 5) == 4)
    inputs = H.FeatureSet(*model_inputs(train)).fit(train.where("not held"))
    rows = materialise(inputs.transform(train).select("pitch_type_can", "held", "features"), "vectors")
    head = H.boosted_head(rows, "pitch_type_can", S.PITCH_TYPES, inputs, validation="held", **settings)
    scored = head.score_onto(with_truth(val, S.PITCH_TYPES, "pitch_type_can"))
    report = ST.against_prior(
        with_truth(train, S.PITCH_TYPES, "pitch_type_can"), scored, len(S.PITCH_TYPES), "boosted"
    )
    rounds = train.sparkSession.createDataFrame(
        [("boosted", "rounds", float(head.model.rounds))], "model string, metric string, value double"
    )
    return report.unionByName(rounds)


def value_report(features: DataFrame, target: str) -> DataFrame:
    """(model, metric, value) of the boosted value regressor with early stopping."""
    table = materialise(narrowed(features, target), "value")
    early = first_fraction(table, pitch_order(), 0.8)
    rows = weighted(table.withColumn("held", ~early))
    head = H.ValueHead(target, H.FeatureSet(CATEGORICAL, NUMERIC), None, "w", "held").fit(rows)
    scored = head.score_onto(rows.where("held"))
    return _named(M.regression_metrics(scored, target, "prediction"), "value")


def forest_report(features: DataFrame, target: str) -> DataFrame:
    train, val = split_features(narrowed(features, target))
    clf, reg = H.forest_pair(S.PITCH_TYPES, "pitch_type_can", target, CATEGORICAL, NUMERIC)
    train = weighted(train)
    clf.fit(train)
    reg.fit(train)
    return evaluate(clf, val, "forest_classifier").unionByName(
        _named(M.regression_metrics(reg.score_onto(val), target, "prediction"), "forest_regressor")
    )


def outcome_rows(features: DataFrame, probs: DataFrame, key: Sequence[str] = S.PITCH_KEY) -> DataFrame:
    """(key..., run_value): both outcome heads on blended type probabilities."""
    rows = materialise(
        attach_features(features.select(*key, "game_date", "events", "description"), probs, key),
        "outcomes",
    )
    early = first_fraction(rows, pitch_order(), 0.8)
    heads = H.outcome_heads(rows.where(early), "probs")
    out = H.outcome_probabilities(rows, "probs", heads)
    return out.select(*key, V.expected_run_value(F.col("outcome_probs")).alias("run_value"))


def chain_report(features: DataFrame) -> DataFrame:
    """(model, metric, value) of the type model and of the outcome model behind it, out of sample."""
    return ST.chain_report(ST.blocked(narrowed(features, "events", "description")), CATEGORICAL, NUMERIC)
