"""Model fits on the feature table of the stand-in log.

MLlib's numbers have no SQL counterpart, so these are checked for rows, and by
tests for what must hold of any model (probabilities sum to one, keys survive).
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer
from pyspark.sql import functions as F

from pitlog import schema as S
from pitlog.catalog import feature_sql as Q
from pitlog.catalog.probability_queries import scored
from pitlog.catalog.registry import query, tidy
from pitlog.catalog.standin import KEY, KEY_SQL, pitches, pitches_sql
from pitlog.functions import vectors as V
from pitlog.models import heads as H
from pitlog.models import search as SE
from pitlog.operators import selection as SL
from pitlog.operators.lineage import materialise
from pitlog.plans import features as FE
from pitlog.plans import stacking as ST
from pitlog.plans import training as T

XWOBA = "estimated_woba_using_speedangle"


def _features(spark, sf_dir):
    return FE.historical_table(pitches(spark, sf_dir))


@query(
    "label_encoding",
    f"""WITH {pitches_sql()}, f AS (SELECT *, COALESCE(description, '__MISSING__') AS d FROM pitches),
c AS (SELECT d, ROW_NUMBER() OVER (ORDER BY d) - 1 AS code FROM (SELECT DISTINCT d FROM f))
SELECT {KEY_SQL}, CAST(code AS BIGINT) AS code FROM f JOIN c USING (d)""",
)
def label_encoding(spark, sf_dir):
    log = H.with_inputs(pitches(spark, sf_dir), ["description"], [])
    indexer = StringIndexer(
        inputCol="_in_description", outputCol="code", stringOrderType="alphabetAsc", handleInvalid="keep"
    )
    return tidy(indexer.fit(log).transform(log).select(*KEY, F.col("code").cast("bigint").alias("code")))


@query("type_ensemble")
def type_ensemble(spark, sf_dir):
    return tidy(T.ensemble_report(_features(spark, sf_dir)))


@query("forest_pair")
def forest_pair(spark, sf_dir):
    return tidy(T.forest_report(_features(spark, sf_dir), XWOBA))


@query("value_regressor")
def value_regressor(spark, sf_dir):
    return tidy(T.value_report(_features(spark, sf_dir), XWOBA))


@query("family_probabilities")
def family_probabilities(spark, sf_dir):
    return tidy(T.family_features(T.narrowed(_features(spark, sf_dir))).select(*KEY, *[f"FAM_PROB_{f}" for f in S.FAMILIES]))


@query("stacked_probabilities")
def stacked_probabilities(spark, sf_dir):
    out = T.stacked_features(T.narrowed(_features(spark, sf_dir)))
    return tidy(out.select(*KEY, *[c for c in out.columns if c.startswith("PT_PROB_")]))


@query("outcome_heads")
def outcome_heads(spark, sf_dir):
    probs = scored(spark, sf_dir, 1).select(*KEY, F.col("p0").alias("probs"))
    return tidy(T.outcome_rows(pitches(spark, sf_dir), probs, KEY))


@query("two_model_chain")
def two_model_chain(spark, sf_dir):
    return tidy(T.chain_report(_features(spark, sf_dir)))


@query("expected_value_by_type")
def expected_value_by_type(spark, sf_dir):
    log = T.narrowed(_features(spark, sf_dir), XWOBA)
    train, _ = T.split_features(log)
    heads = H.value_by_type(train, XWOBA, T.NUMERIC)
    rows = scored(spark, sf_dir, 1).select(*KEY, "p0")
    joined = log.join(rows, KEY, "inner")
    return tidy(H.expected_value(joined, heads, "p0", S.PITCH_TYPES).select(*KEY, "expected_xwoba"))


@query("parameter_search")
def parameter_search(spark, sf_dir):
    train, val = T.split_features(T.narrowed(_features(spark, sf_dir)))
    space = {"numTrees": [3, 5], "maxDepth": [3, 4], "subsamplingRate": [0.8, 1.0]}
    results = SE.search(
        train,
        val,
        lambda p: RandomForestClassifier(seed=H.SEED, weightCol="w", maxBins=64, **p),
        S.PITCH_TYPES,
        "pitch_type_can",
        (T.CATEGORICAL, T.NUMERIC),
        SE.trials(space, 3),
    )
    return tidy(SE.best_trials(results))


@query("feature_importance")
def feature_importance(spark, sf_dir):
    features = H.FeatureSet(T.CATEGORICAL, T.NUMERIC)
    rows = materialise(T.narrowed(_features(spark, sf_dir)), "importance")
    head = H.ClassHead(S.PITCH_TYPES, "pitch_type_can", features).fit(rows)
    return tidy(H.importances(head))


@query("sequence_network")
def sequence_network(spark, sf_dir):
    """A feed-forward network on the five-step arrays, scored by key out of sample.

    Each block of days is scored by a network fitted on the blocks before it; the first has NULL.
    """
    rows = FE.sequence_arrays(FE.sequence_block(pitches(spark, sf_dir)))
    inputs = {
        f"{c}_{i}": F.col(c)[i].cast("double")
        for c in ("seq_types", "seq_balls", "seq_strikes")
        for i in range(5)
    }
    # The newest velocity step reads the current pitch, so only the older ones are inputs.
    inputs |= {f"seq_dvelo_{i}": F.col("seq_dvelo")[i] for i in range(4)}
    table = ST.blocked(rows.withColumns(inputs).select(*KEY, "game_date", "pitch_type_can", *inputs))
    heads = ST.fit_forward(table, lambda train: H.sequence_head(train, list(inputs)))
    out = ST.score_forward(table, heads, {"pred": V.argmax, "p": F.array_max})
    return tidy(out.select(*KEY, "pred", "p"), ["pred"])


# --- feature selections, as non-NULL counts of the selected columns -----------------

_RAW = [*S.PITCH_KEY, "game_date", *Q.RAW_WHOLE, *Q.RAW_MAYBE, *Q.RAW_TEXT, *Q.RAW_REAL]
_RUNNING = ["cum_game_pitches", *Q.COUNTS, *Q.LAGS4, "dvelo1", *Q.running_columns("velocity")[1]]
_FAMILY = [c for f in Q.PRIOR for c in Q.FAMILIES[f][2]]
_COLUMNS = [*_RAW, *_RUNNING, *_FAMILY, "count_state"]
# Substring tokens: ``ay`` also takes the away score.
_PHYSICS = ("release_speed", "release_spin_rate", "away_score")
_BY_TYPE = tuple(f"_{t}" for t in S.PITCH_TYPES if t != "ST")


def _selected(log, features):
    counts = SL.matrix(log, features).agg(*[F.count(c).alias(c) for c in features])
    rows = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_values")) for c in features]
    )
    return tidy(counts.select(F.inline(rows)))


def _selected_sql(features) -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, "
        + (f'COUNT("{c}")' if c != "count_state" else "COUNT(*)")
        + " AS n_values FROM hist"
        for c in features
    )
    return f"WITH {Q.historical_ctes()} {rows}"


@query("select_safe", _selected_sql([c for c in _COLUMNS if c in S.SAFE_FEATURES]))
def select_safe(spark, sf_dir):
    log = _features(spark, sf_dir)
    return _selected(log, SL.safe_features(log))


@query("select_balanced", _selected_sql([c for c in _COLUMNS if c not in S.BASE_DROP and c not in _PHYSICS]))
def select_balanced(spark, sf_dir):
    log = _features(spark, sf_dir)
    return _selected(log, SL.blacklist_features(log, "pitch_type_can", "balanced"))


@query(
    "select_strict",
    _selected_sql(
        [
            c
            for c in _COLUMNS
            if c not in S.BASE_DROP and c not in _PHYSICS and not any(t in c for t in _BY_TYPE)
        ]
    ),
)
def select_strict(spark, sf_dir):
    log = _features(spark, sf_dir)
    return _selected(log, SL.blacklist_features(log, "pitch_type_can", "strict"))


@query(
    "select_conservative",
    _selected_sql(
        "balls strikes outs_when_up on_1b on_2b on_3b home_score stand p_throws".split()
        + [c for c in _FAMILY if c.startswith("usage_30d_")]
        + ["whiff_rate_7d", "hit_rate_7d"]
        + [f"whiff_rate_30d_{s}" for s in S.COUNT_STATES]
        + ["cum_game_pitches"]
    ),
)
def select_conservative(spark, sf_dir):
    log = _features(spark, sf_dir)
    return _selected(log, SL.conservative_features(log))
