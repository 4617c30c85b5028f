"""Row-wise maths on probability arrays, all as higher-order SQL functions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitlog import schema as S

LOG_CLIP = 1e-15


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once.

    An expression used inside a lambda is evaluated for every element, and again
    for each mention; a lambda variable is evaluated once.
    """
    return F.transform(F.array(value), body)[0]


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def softmax(logits: Column) -> Column:
    """Shifted by the row maximum, so large scores do not overflow."""
    return let(
        F.struct(logits.alias("v"), F.array_max(logits).alias("top")),
        lambda s: normalise(F.transform(s["v"], lambda x: F.exp(x - s["top"]))),
    )


def spread_softmax(df: DataFrame, logits: Sequence[Column], name: str) -> tuple[DataFrame, list[Column]]:
    """``df`` with helper columns ``name``..., and the softmax of ``logits`` as one column per class.

    The same doubles as ``softmax``. Lambdas are interpreted, plain columns compiled; each step is a
    projection of its own, so nothing is evaluated twice.
    """
    n = range(len(logits))
    z, e = [F.col(f"{name}_z{k}") for k in n], [F.col(f"{name}_e{k}") for k in n]
    top = F.greatest(*z) if len(z) > 1 else z[0]
    out = df.withColumns({f"{name}_z{k}": logits[k] for k in n}).withColumn(f"{name}_top", top)
    out = out.withColumns({f"{name}_e{k}": F.exp(z[k] - F.col(f"{name}_top")) for k in n})
    out = out.withColumn(f"{name}_sum", sum(e, F.lit(0.0)))
    return out, [x / F.col(f"{name}_sum") for x in e]


def normalise(v: Column) -> Column:
    return let(
        v, lambda a: let(total(a), lambda t: F.transform(a, lambda x: x / t))
    )


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def pad(v: Column, size: int) -> Column:
    """Append zeros up to ``size`` classes; longer vectors pass through."""
    return F.concat(v, F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.lit(size) - F.size(v))))


def blend(members: Sequence[Column], weights: Sequence[float | Column]) -> Column:
    """Weighted sum of equally long vectors."""
    def scaled(v: Column, w: float | Column) -> Column:
        w = w if isinstance(w, Column) else F.lit(float(w))
        return F.transform(v, lambda x: x * w)

    out = scaled(members[0], weights[0])
    for v, w in zip(members[1:], weights[1:]):
        out = F.zip_with(out, scaled(v, w), lambda x, y: x + y)
    return out


def argmax(v: Column) -> Column:
    """0-based position of the first maximum."""
    return let(v, lambda a: (F.array_position(a, F.array_max(a)) - 1).cast("int"))


def top_k(v: Column, k: int) -> Column:
    """0-based positions of the ``k`` largest values.

    Equal values rank by position, the later one first, which is the order an
    ascending stable sort leaves at its end.
    """
    ranked = F.transform(v, lambda x, i: F.struct(x.alias("p"), i.cast("int").alias("i")))
    best = F.slice(F.sort_array(ranked, asc=False), 1, k)
    return F.transform(best, lambda s: s["i"])


def entropy(v: Column, eps: float = S.ENTROPY_EPS) -> Column:
    return -total(F.transform(v, lambda p: p * F.ln(p + F.lit(eps))))


def at(v: Column, index: Column) -> Column:
    """0-based element, NULL outside the vector."""
    return F.try_element_at(v, (index + 1).cast("int"))


def log_loss_of(p: Column) -> Column:
    """-ln of the probability given to the true class, clipped away from 0 and 1."""
    eps = LOG_CLIP
    return -F.ln(F.least(F.greatest(p, F.lit(eps)), F.lit(1.0 - eps)))


def class_columns(v: Column, classes: Sequence[str], prefix: str) -> dict[str, Column]:
    return {f"{prefix}{c}": F.try_element_at(v, F.lit(i + 1)) for i, c in enumerate(classes)}


def group_features(
    v: Column,
    classes: Sequence[str],
    groups: Mapping[str, Sequence[str]] = S.PROBABILITY_GROUPS,
    prefix: str = "PT_PROB_",
) -> dict[str, Column]:
    """Group sums, the maximum and the entropy of a class-probability vector."""
    single = class_columns(v, classes, "")
    out = {}
    for name, members in groups.items():
        present = [F.coalesce(single[m], F.lit(0.0)) for m in members if m in single]
        acc = F.lit(0.0)
        for p in present:
            acc = acc + p
        out[f"{prefix}{name}_GROUP"] = F.when(v.isNotNull(), acc)
    out[f"{prefix}MAX"] = F.array_max(v)
    out[f"{prefix}ENTROPY"] = entropy(v)
    return out


def combine_stages(
    stage1: Column, in_play: Column, stage1_classes: Sequence[str] = S.STAGE1_CLASSES
) -> Column:
    """9-vector: in-play classes scaled by P(IN_PLAY), then BALL and STRIKE.

    The in-play part is zero where there is no in-play vector and where IN_PLAY
    is not the most likely stage-1 class; such rows sum to less than one.
    """
    pos = {c: i for i, c in enumerate(stage1_classes)}
    known = F.coalesce(in_play, F.array_repeat(F.lit(0.0), len(S.IN_PLAY_CLASSES)))

    def p(s: Column, name: str) -> Column:
        return F.try_element_at(s, F.lit(pos[name] + 1))

    def share(s: Column) -> Column:
        return F.when(argmax(s) == F.lit(pos["IN_PLAY"]), p(s, "IN_PLAY")).otherwise(F.lit(0.0))

    return let(
        stage1,
        lambda s: F.concat(
            let(share(s), lambda w: F.transform(known, lambda x: x * w)),
            F.array(p(s, "BALL"), p(s, "STRIKE")),
        ),
    )


def expected_run_value(outcome_probs: Column) -> Column:
    values = F.array(*[F.lit(S.RUN_VALUE[c]) for c in S.OUTCOME_CLASSES])
    return dot(outcome_probs, values)
