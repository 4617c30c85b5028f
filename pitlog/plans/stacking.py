"""Cross-fitting in time order: stacked features without a model that saw its own rows.

Rows fall into blocks of whole days. The head that scores block j was fitted on the blocks before
it, so no row carries a probability from a model that saw the row or a later one. Block 0 has no
model before it; its rows carry NULL and train no second level.

The table is written once, partitioned by block. Fitting a head reads the blocks before its own,
scoring is a projection of its own block; the union of the scored blocks is the whole table.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitlog import schema as S
from pitlog.functions import labels as L
from pitlog.functions import vectors as V
from pitlog.models import heads as H
from pitlog.operators.lineage import materialise
from pitlog.operators.splits import day_blocks
from pitlog.plans import blending as B
from pitlog.plans import metrics as M

BLOCK = "block"
BLOCKS = 5

Fit = Callable[[DataFrame], H.ClassHead]


def blocked(df: DataFrame, blocks: int = BLOCKS, date: str = "game_date") -> DataFrame:
    """``df`` with its block, in a written table.

    ``df`` itself is computed once; days are counted on its written rows.
    """
    rows = materialise(df, "rows")
    return materialise(rows.withColumn(BLOCK, day_blocks(rows, blocks, date)), "blocks", [BLOCK])


def fit_forward(table: DataFrame, fit: Fit, blocks: int = BLOCKS) -> dict[int, H.ClassHead]:
    """By block the head fitted on all earlier blocks; none for a block without rows before it."""
    present = sorted(r[0] for r in table.select(BLOCK).distinct().collect())
    return {b: fit(table.where(F.col(BLOCK) < b)) for b in present if b > present[0]}


def score_forward(
    table: DataFrame, heads: Mapping[int, H.ClassHead], names: Mapping[str, Callable[[Column], Column]]
) -> DataFrame:
    """``table`` with columns ``names`` made from each row's out-of-sample class probabilities.

    Rows of a block without a head have NULL there.
    """
    parts = []
    for block, head in heads.items():
        scored = head.score_onto(table.where(F.col(BLOCK) == block), "_p")
        parts.append(scored.select(*table.columns, *[make(F.col("_p")).alias(n) for n, make in names.items()]))
    rest = table.where(~F.col(BLOCK).isin(*heads)) if heads else table
    none = F.lit(None).cast("array<double>")
    parts.append(rest.select(*table.columns, *[make(none).alias(n) for n, make in names.items()]))
    return reduce(DataFrame.unionByName, parts)


def stacked(
    table: DataFrame,
    fit: Fit,
    classes: Sequence[str],
    prefix: str,
    groups: Mapping[str, Sequence[str]] | None = None,
    blocks: int = BLOCKS,
) -> DataFrame:
    """``table`` with class probabilities as columns, and with ``groups`` their group features."""

    def columns(p: Column) -> dict[str, Column]:
        out = V.class_columns(p, classes, prefix)
        return out | V.group_features(p, classes, groups, prefix) if groups is not None else out

    names = {n: (lambda p, n=n: columns(p)[n]) for n in columns(F.col("_p"))}
    return score_forward(table, fit_forward(table, fit, blocks), names)


def blended_members(
    table: DataFrame, fits: Mapping[str, Fit], y: str, classes: Sequence[str], blocks: int = BLOCKS
) -> tuple[DataFrame, list[float]]:
    """``table`` with the out-of-sample vectors p0, p1, ... of the members and their blend ``probs``.

    The weights are those of the grid with the least loss on scored rows before the last block, so
    the last block judges a blend that has not seen it either. ``y`` is the true class position.
    """
    out = table
    for i, fit in enumerate(fits.values()):
        out = score_forward(out, fit_forward(table, fit, blocks), {f"p{i}": lambda p: p})
    out = materialise(out, "members", [BLOCK])
    names = [f"p{i}" for i in range(len(fits))]
    last = out.agg(F.max(BLOCK)).first()[0]
    seen = out.where((F.col(BLOCK) < last) & F.col("p0").isNotNull() & F.col(y).isNotNull())
    if len(names) == 1:
        weights = [1.0]
    else:
        best = B.best_weights(B.score_weights(seen, names, y, B.tenths_grid(len(names)))).first()
        weights = [best[f"w{i}"] for i in range(len(names))]
    blend = V.blend([F.col(n) for n in names], weights)
    return out.withColumn("probs", F.when(F.col("p0").isNotNull(), blend)), weights


def prior_vector(train: DataFrame, y: str, n_classes: int) -> list[float]:
    """Class shares with one row added to each class."""
    counts = {r[0]: r[1] for r in train.where(F.col(y).isNotNull()).groupBy(y).count().collect()}
    total = sum(counts.values()) + n_classes
    return [(counts.get(c, 0) + 1) / total for c in range(n_classes)]


def against_prior(train: DataFrame, scored: DataFrame, n_classes: int, model: str, probs: str = "probs") -> DataFrame:
    """(model, metric, value) of ``scored`` (with y) and of the class shares of ``train``."""
    prior = F.array(*[F.lit(p) for p in prior_vector(train, "y", n_classes)])
    base = M.classification_metrics(scored.withColumn("_prior", prior), "y", "_prior")
    own = M.classification_metrics(scored, "y", probs)
    return own.select(F.lit(model).alias("model"), "metric", "value").unionByName(
        base.select(F.lit(f"{model}_prior").alias("model"), "metric", "value")
    )


def _with_label(df: DataFrame, label: Column, classes: Sequence[str]) -> DataFrame:
    return df.withColumn("y", H.label_position(label, classes).cast("int"))


def outcome_report(rows: DataFrame) -> DataFrame:
    """(model, metric, value) of both outcome stages on rows with out-of-sample ``probs`` and block.

    The heads are fitted on the blocks between the first and the last, and judged on the last one
    against the class shares.
    """
    scored = rows.where(F.col("probs").isNotNull())
    scored = scored.withColumn("_outcome", L.outcome9(F.col("events"), F.col("description")))
    last = scored.agg(F.max(BLOCK)).first()[0]
    train, val = scored.where(F.col(BLOCK) < last), scored.where(F.col(BLOCK) == last)
    heads = H.outcome_heads(train, "probs")
    ready = H.with_probability_inputs(val, "probs", len(S.PITCH_TYPES))
    reports = []
    for head, name, label in (
        (heads[0], "stage1", L.stage1_label(F.col("_outcome"))),
        (heads[1], "in_play", L.in_play_label(F.col("_outcome"))),
    ):
        before = _with_label(train, label, head.classes)
        now = _with_label(ready, label, head.classes).where("y IS NOT NULL")
        reports.append(against_prior(before, head.score_onto(now, "_own"), len(head.classes), name, "_own"))
    return reduce(DataFrame.unionByName, reports)


def chain_report(
    table: DataFrame, categorical: Sequence[str], numeric: Sequence[str], blocks: int = BLOCKS
) -> DataFrame:
    """(model, metric, value) of a type model and of the outcome model that sees predicted types.

    The outcome model is fitted on types predicted out of sample, as those it will meet are.
    """
    typed = table.withColumn("pitch_type_can", F.coalesce("pitch_type_can", F.lit(S.UNKNOWN_TYPE)))

    def fit(train: DataFrame) -> H.ClassHead:
        return H.ClassHead(S.PITCH_TYPES, "pitch_type_can", H.FeatureSet(categorical, numeric)).fit(train)

    names = F.array(*[F.lit(c) for c in S.PITCH_TYPES])
    made = {
        "probs": lambda p: p,
        "predicted_pitch_type": lambda p: F.try_element_at(names, V.argmax(p) + 1),
    }
    rows = score_forward(typed, fit_forward(typed, fit, blocks), made)
    rows = rows.withColumn("outcome6", L.outcome6(F.col("events"), F.col("description")))
    rows = materialise(rows.where(F.col("probs").isNotNull()), "chain", [BLOCK])
    last = rows.agg(F.max(BLOCK)).first()[0]
    train, val = rows.where(F.col(BLOCK) < last), rows.where(F.col(BLOCK) == last)
    second = H.ClassHead(
        S.OUTCOME6_CLASSES, "outcome6", H.FeatureSet([*categorical, "predicted_pitch_type"], numeric)
    ).fit(train)
    first = _with_label(val, F.col("pitch_type_can"), S.PITCH_TYPES).where("y IS NOT NULL")
    before = _with_label(train, F.col("pitch_type_can"), S.PITCH_TYPES)
    outcome = _with_label(val, F.col("outcome6"), S.OUTCOME6_CLASSES).where("y IS NOT NULL").drop("probs")
    return against_prior(before, first, len(S.PITCH_TYPES), "type").unionByName(
        against_prior(
            _with_label(train, F.col("outcome6"), S.OUTCOME6_CLASSES),
            second.score_onto(outcome),
            len(S.OUTCOME6_CLASSES),
            "outcome",
        )
    )
