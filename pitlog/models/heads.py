"""Model heads on ``pyspark.ml``.

Encoders are fitted on the training rows and reused, with unseen labels in a
slot of their own. All fits are MLlib's distributed ones. Scored frames keep the
row key, so their probabilities can be joined and blended by key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import OneHotEncoder, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from pitlog import schema as S
from pitlog.functions import labels as L
from pitlog.functions import vectors as V
from pitlog.models.boosting import BoostedClasses, MulticlassBooster
from pitlog.operators.lineage import materialise

MISSING = "__MISSING__"
SEED = 42


# Model inputs are filled copies under this prefix, so the log's own columns stay as they are.
_IN = "_in_"


def encoder(categorical: Sequence[str], numeric: Sequence[str], one_hot: bool = False) -> Pipeline:
    """Index text inputs in alphabetical order and assemble one feature vector."""
    indexed = [f"{_IN}{c}__ix" for c in categorical]
    stages: list[Estimator] = []
    if categorical:
        stages.append(
            StringIndexer(
                inputCols=[f"{_IN}{c}" for c in categorical],
                outputCols=indexed,
                stringOrderType="alphabetAsc",
                handleInvalid="keep",
            )
        )
    if categorical and one_hot:
        codes, indexed = indexed, [f"{c}__1h" for c in indexed]
        stages.append(OneHotEncoder(inputCols=codes, outputCols=indexed, handleInvalid="keep"))
    stages.append(
        VectorAssembler(
            inputCols=[f"{_IN}{c}" for c in numeric] + indexed,
            outputCol=f"{_IN}features",
            handleInvalid="keep",
        )
    )
    return Pipeline(stages=stages)


def with_inputs(df: DataFrame, categorical: Sequence[str], numeric: Sequence[str]) -> DataFrame:
    """Add the filled inputs: NULL text to a word, NULL or non-numeric numbers to 0.

    Columns the log lacks become constants.
    """
    present = set(df.columns)
    text = {
        f"{_IN}{c}": F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) if c in present else F.lit(MISSING)
        for c in categorical
    }
    numbers = {
        f"{_IN}{c}": F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) if c in present else F.lit(0.0)
        for c in numeric
    }
    return df.withColumns(text | numbers)


@dataclass
class FeatureSet:
    """The inputs of a model and, once fitted, their encoding.

    Trees take categories as codes; linear models and networks need ``one_hot``.
    """

    categorical: Sequence[str]
    numeric: Sequence[str]
    model: PipelineModel | None = None
    one_hot: bool = False

    def fit(self, train: DataFrame) -> FeatureSet:
        """Fit the encoding, once: heads that share inputs share it.

        Rows to score may lack inputs, rows to fit on may not.
        """
        if self.model is None:
            lacking = sorted(set(self.names) - set(train.columns))
            if lacking:
                raise ValueError(f"training rows lack inputs: {lacking}")
            ready = with_inputs(train, self.categorical, self.numeric)
            self.model = encoder(self.categorical, self.numeric, self.one_hot).fit(ready)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with a column ``features``; rows that were encoded and written before pass."""
        if "features" in df.columns:
            return df
        ready = self.model.transform(with_inputs(df, self.categorical, self.numeric))
        return ready.select(*df.columns, F.col(f"{_IN}features").alias("features"))

    @property
    def names(self) -> list[str]:
        return [*self.numeric, *self.categorical]

    @property
    def max_bins(self) -> int:
        """Trees need a bin per category."""
        sizes = [len(a) + 1 for s in self.model.stages if isinstance(s, StringIndexerModel)
                 for a in s.labelsArray]
        return max([32, *sizes])


def label_position(label: Column, classes: Sequence[str]) -> Column:
    """0-based class position as MLlib wants it; NULL outside the classes."""
    return L.position(label, classes).cast("double")


def ensemble_members(
    n_classes: int, max_bins: int = 32, size: int = 1, forest: Mapping | None = None
) -> dict[str, Estimator | MulticlassBooster]:
    """The three multiclass members; ``size`` scales trees, iterations and rounds.

    Boosting has up to 10 rounds a size and stops by itself where rows are held out. ``forest``
    are parameters for the forest, such as the best ones of a search.
    """
    trees = {"numTrees": 20 * size, "maxDepth": 8} | dict(forest or {})
    return {
        "forest": RandomForestClassifier(maxBins=max_bins, seed=SEED, weightCol="w", **trees),
        "linear": LogisticRegression(
            maxIter=20 * size, regParam=0.01, family="multinomial", weightCol="w"
        ),
        "boosted": MulticlassBooster(
            n_classes, rounds=10 * size, depth=4, rate=0.3, patience=2 + size, max_bins=max_bins
        ),
    }


def one_vs_rest(max_bins: int = 32, size: int = 1) -> OneVsRest:
    """A boosted two-class member per class."""
    boosted = GBTClassifier(maxIter=10 * size, maxDepth=4, maxBins=max_bins, seed=SEED)
    return OneVsRest(classifier=boosted, weightCol="w", parallelism=4)


def probabilities(scored: DataFrame, n_classes: int) -> Column:
    """Probability array of a scored frame.

    One-vs-rest gives raw scores only. The margin of boosted trees is half the log-odds, so the
    probability is the sigmoid of twice the score; these are normalised to one.
    """
    if "probability" in scored.columns:
        array = isinstance(scored.schema["probability"].dataType, ArrayType)
        return V.pad(F.col("probability") if array else vector_to_array("probability"), n_classes)
    raw = vector_to_array("rawPrediction")
    return V.pad(V.normalise(F.transform(raw, lambda x: 1 / (1 + F.exp(-2 * x)))), n_classes)


def encoded(rows: DataFrame, source: DataFrame) -> DataFrame:
    """``rows`` of a fit, written unless their ``source`` brought vectors: a fit reads them several
    times, and encoding them costs more than reading."""
    return rows if "features" in source.columns else materialise(rows, "vectors")


@dataclass
class ClassHead:
    """A classifier over a fixed class list.

    With ``validation`` (a boolean column) those rows only decide when boosting stops.
    """

    classes: Sequence[str]
    label: str
    features: FeatureSet
    estimator: Estimator | MulticlassBooster | None = None
    weight: str | None = None
    model: Model | BoostedClasses | None = field(default=None)
    validation: str | None = None

    def fit(self, train: DataFrame) -> ClassHead:
        held = F.coalesce(F.col(self.validation), F.lit(False)) if self.validation else F.lit(False)
        if self.features.model is None:
            self.features.fit(train.where(~held) if self.validation else train)
        y = label_position(F.col(self.label), self.classes)
        w = F.col(self.weight).cast("double") if self.weight else F.lit(1.0)
        rows = (
            self.features.transform(train)
            .select("features", y.alias("label"), w.alias("w"), held.alias("held_out"))
            .where(F.col("label").isNotNull())
        )
        rows = encoded(rows, train)
        estimator = self.estimator or RandomForestClassifier(
            numTrees=10, maxDepth=6, maxBins=self.features.max_bins, seed=SEED, weightCol="w"
        )
        self.model = estimator.fit(rows)
        return self

    def score_onto(self, df: DataFrame, name: str = "probs") -> DataFrame:
        """``df`` with one probability per class in ``name``: a projection, no join."""
        scored = self.model.transform(self.features.transform(df))
        return scored.select(*df.columns, probabilities(scored, len(self.classes)).alias(name))

    def score(self, df: DataFrame, key: Sequence[str], name: str = "probs") -> DataFrame:
        """(key..., name), for storing and for joining with other members."""
        return self.score_onto(df, name).select(*key, name)

    def attach(self, df: DataFrame, prefix: str, groups: Mapping | None = None) -> DataFrame:
        """Probabilities as columns of ``df``; with ``groups``, group features too."""
        columns = V.class_columns(F.col("_p"), self.classes, prefix)
        if groups is not None:
            columns |= V.group_features(F.col("_p"), self.classes, groups, prefix)
        return self.score_onto(df, "_p").select(*df.columns, *[c.alias(n) for n, c in columns.items()])


def boosted_head(
    train: DataFrame,
    label: str,
    classes: Sequence[str],
    features: FeatureSet,
    weight: str | None = None,
    validation: str | None = None,
    **settings,
) -> ClassHead:
    """A multiclass boosted head; ``settings`` are those of ``MulticlassBooster``."""
    features.fit(train)
    booster = MulticlassBooster(len(classes), max_bins=features.max_bins, **settings)
    return ClassHead(classes, label, features, booster, weight, validation=validation).fit(train)


def family_head(train: DataFrame, categorical: Sequence[str], numeric: Sequence[str]) -> ClassHead:
    """Three-class head; its probabilities become FAM_PROB_ columns."""
    labelled = train.withColumn("pitch_family", L.pitch_family(F.col("pitch_type_can")))
    return ClassHead(S.FAMILIES, "pitch_family", FeatureSet(categorical, numeric)).fit(labelled)


def type_ensemble(
    train: DataFrame,
    categorical: Sequence[str],
    numeric: Sequence[str],
    classes: Sequence[str] = S.PITCH_TYPES,
    size: int = 1,
    weight: str | None = "w",
    validation: str | None = None,
    forest: Mapping | None = None,
) -> dict[str, ClassHead]:
    """Three fitted members; the tree members share one encoding, the linear one is one-hot.

    Both encodings are fitted and their vectors written once; all passes of the fits read those.
    Rows of ``validation`` (a boolean column) only decide when boosting stops.
    """
    held = F.coalesce(F.col(validation), F.lit(False)) if validation else F.lit(False)
    columns = ["pitch_type_can", *([weight] if weight else []), *([validation] if validation else [])]
    out = {}
    for one_hot in (False, True):
        features = FeatureSet(categorical, numeric, one_hot=one_hot).fit(train.where(~held))
        vectors = materialise(features.transform(train).select(*columns, "features"), "vectors")
        bins = features.max_bins
        for name, member in ensemble_members(len(classes), bins, size, forest).items():
            if (name == "linear") == one_hot:
                stops = validation if isinstance(member, MulticlassBooster) else None
                rows = vectors if stops or not validation else vectors.where(~held)
                head = ClassHead(classes, "pitch_type_can", features, member, weight, validation=stops)
                out[name] = head.fit(rows)
    return {name: out[name] for name in ensemble_members(len(classes))}


@dataclass
class ValueHead:
    """Boosted regression on rows that have a target.

    With ``validation`` (a boolean column) the boosting stops when those rows stop improving.
    """

    target: str
    features: FeatureSet
    estimator: Estimator | None = None
    weight: str | None = None
    validation: str | None = None
    model: Model | None = field(default=None)

    def fit(self, train: DataFrame) -> ValueHead:
        rows = train.where(F.col(self.target).isNotNull())
        w = F.col(self.weight).cast("double") if self.weight else F.lit(1.0)
        held = F.coalesce(F.col(self.validation), F.lit(False)) if self.validation else F.lit(False)
        self.features.fit(rows.where(~held))
        ready = self.features.transform(rows).select(
            "features", F.col(self.target).cast("double").alias("label"),
            w.alias("w"), held.alias("held_out"),
        )
        ready = encoded(ready, rows)
        estimator = self.estimator or GBTRegressor(
            maxIter=10, maxDepth=4, maxBins=self.features.max_bins, seed=SEED, weightCol="w"
        )
        if self.validation and isinstance(estimator, GBTRegressor):
            estimator = estimator.copy().setValidationIndicatorCol("held_out")
        self.model = estimator.fit(ready)
        return self

    def score_onto(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        scored = self.model.transform(self.features.transform(df))
        return scored.select(*df.columns, F.col("prediction").alias(name))


def forest_pair(
    classes: Sequence[str], label: str, target: str, categorical, numeric, size: int = 1
) -> tuple[ClassHead, ValueHead]:
    """The random-forest pair; ``size=10`` gives the 200 and 300 trees of a full run."""
    clf = RandomForestClassifier(numTrees=20 * size, maxDepth=8, seed=SEED, maxBins=64, weightCol="w")
    reg = RandomForestRegressor(numTrees=30 * size, maxDepth=8, seed=SEED, maxBins=64, weightCol="w")
    return (
        ClassHead(classes, label, FeatureSet(categorical, numeric), clf, "w"),
        ValueHead(target, FeatureSet(categorical, numeric), reg, "w"),
    )


def sequence_head(
    train: DataFrame,
    inputs: Sequence[str],
    classes: Sequence[str] = S.SEQUENCE_TYPES,
    hidden: Sequence[int] = (16,),
    iterations: int = 20,
) -> ClassHead:
    """Feed-forward network on fixed-length sequence inputs, an ensemble member by key."""
    network = MultilayerPerceptronClassifier(
        layers=[len(inputs), *hidden, len(classes)], maxIter=iterations, seed=SEED
    )
    return ClassHead(classes, "pitch_type_can", FeatureSet([], inputs), network).fit(train)


def outcome_heads(
    train: DataFrame, probs: str, classes: Sequence[str] = S.PITCH_TYPES
) -> tuple[ClassHead, ClassHead]:
    """Stage 1 (in play, ball, strike) and the in-play head, both on a probability vector."""
    inputs = [f"_x{i}" for i in range(len(classes))]
    rows = with_probability_inputs(train, probs, len(classes)).withColumn(
        "_outcome", L.outcome9(F.col("events"), F.col("description"))
    )
    rows = rows.withColumns(
        {
            "stage1": L.stage1_label(F.col("_outcome")),
            "in_play": L.in_play_label(F.col("_outcome")),
        }
    )
    stage1 = ClassHead(S.STAGE1_CLASSES, "stage1", FeatureSet([], inputs)).fit(rows)
    in_play = ClassHead(S.IN_PLAY_CLASSES, "in_play", FeatureSet([], inputs)).fit(rows)
    return stage1, in_play


def with_probability_inputs(df: DataFrame, probs: str, n_classes: int) -> DataFrame:
    return df.withColumns(
        {f"_x{i}": F.try_element_at(F.col(probs), F.lit(i + 1)) for i in range(n_classes)}
    )


def outcome_probabilities(
    df: DataFrame, probs: str, heads: tuple[ClassHead, ClassHead], name: str = "outcome_probs"
) -> DataFrame:
    """``df`` with the outcome 9-vector of both stages."""
    ready = with_probability_inputs(df, probs, len(S.PITCH_TYPES))
    both = heads[1].score_onto(heads[0].score_onto(ready, "_s1"), "_ip")
    return both.select(*df.columns, V.combine_stages(F.col("_s1"), F.col("_ip")).alias(name))


def two_model_chain(
    train: DataFrame, categorical: Sequence[str], numeric: Sequence[str]
) -> tuple[ClassHead, ClassHead]:
    """Type model, then an outcome model that sees the *predicted* type."""
    typed = train.withColumn("pitch_type_can", F.coalesce("pitch_type_can", F.lit(S.UNKNOWN_TYPE)))
    first = ClassHead(S.PITCH_TYPES, "pitch_type_can", FeatureSet(categorical, numeric)).fit(typed)
    rows = with_predicted_type(typed, first).withColumn(
        "outcome6", L.outcome6(F.col("events"), F.col("description"))
    )
    second = ClassHead(
        S.OUTCOME6_CLASSES,
        "outcome6",
        FeatureSet([*categorical, "predicted_pitch_type"], numeric),
    ).fit(rows)
    return first, second


def with_predicted_type(df: DataFrame, head: ClassHead) -> DataFrame:
    names = F.array(*[F.lit(c) for c in head.classes])
    best = F.try_element_at(names, V.argmax(F.col("_p")) + 1)
    return head.score_onto(df, "_p").select(*df.columns, best.alias("predicted_pitch_type"))


def value_by_type(
    train: DataFrame,
    target: str,
    numeric: Sequence[str],
    classes: Sequence[str] = S.SEQUENCE_TYPES,
    rounds: int = 10,
    depth: int = 4,
    validation: str | None = None,
) -> dict[str, ValueHead]:
    """One value regressor per pitch type with a row; a type without rows has none.

    Rows of ``validation`` (a boolean column) decide when the boosting of each type stops.
    """
    rows = train.where(F.col(target).isNotNull() & F.col("pitch_type_can").isin(*classes))
    counts = {r["pitch_type_can"]: r["n"] for r in
              rows.groupBy("pitch_type_can").agg(F.count(F.lit(1)).alias("n")).collect()}
    heads = {}
    for c in classes:
        if counts.get(c, 0) > 0:
            est = GBTRegressor(maxIter=rounds, maxDepth=depth, seed=SEED, weightCol="w")
            heads[c] = ValueHead(target, FeatureSet([], numeric), est, validation=validation).fit(
                rows.where(F.col("pitch_type_can") == c)
            )
    return heads


def expected_value(
    df: DataFrame,
    heads: Mapping[str, ValueHead],
    probs: str,
    classes: Sequence[str],
    default: float = S.DEFAULT_XWOBA,
    name: str = "expected_xwoba",
) -> DataFrame:
    """Sum over types of P(type) times its predicted value; the default where a type has no model.

    All regressors read the same vector, so the rows are scored in one pass without a join.
    """
    first = next(iter(heads.values()), None)
    if first is None:
        return df.withColumn(name, F.lit(default))
    out = first.features.transform(df)
    for i, c in enumerate(classes):
        if c in heads:
            out = heads[c].model.copy().setPredictionCol(f"_v{i}").transform(out)
        else:
            out = out.withColumn(f"_v{i}", F.lit(default))
    values = F.array(*[F.col(f"_v{i}") for i in range(len(classes))])
    return out.withColumn(name, V.dot(F.col(probs), values)).select(*df.columns, name)


def importances(head: ClassHead | ValueHead) -> DataFrame:
    """(feature, importance) of all features, largest first."""
    boosted = isinstance(head.model, BoostedClasses)
    values = head.model.importances if boosted else [float(x) for x in head.model.featureImportances.toArray()]
    rows = SparkSession.active().createDataFrame(
        list(zip(head.features.names, values)), "feature string, importance double"
    )
    return rows.orderBy(F.desc("importance"), "feature")
