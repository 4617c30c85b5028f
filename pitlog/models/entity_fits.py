"""Thousands of small regressions at once, one per entity, from grouped sums.

No entity gets a model object, a file or a Python group: what a fit needs of an entity's rows are
sums (the Gram matrix of its inputs and the moments with its targets), and those are one
aggregation that is combined before the shuffle, so an entity with a third of all rows is no
problem. The small linear systems are solved row by row with array functions.

``ridge`` solves the normal equations. ``residual_logits`` fits, per entity, what a base model's
class probabilities miss: logits = ln(base) + B x with a ridge penalty on B. Each step raises the
penalised likelihood by Newton's method with the fixed curvature bound 1/2 X'X of the softmax (so
the system is inverted once) and costs one aggregation of gradients over the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitlog import schema as S
from pitlog.functions import vectors as V
from pitlog.operators.joins import attach_features
from pitlog.operators.lineage import Succession, materialise

PENALTY = 1.0
STEPS = 8
LEAST_BASE = 1e-9


def identity(size: int) -> Column:
    return F.array(*[F.array(*[F.lit(float(i == j)) for j in range(size)]) for i in range(size)])


def solve(a: Column, b: Column, size: int) -> Column:
    """X of the positive definite system A X = B, as rows; Gauss-Jordan over array functions.

    Such systems need no pivoting. ``a`` and ``b`` are arrays of rows.
    """
    both = F.zip_with(a, b, lambda x, y: F.concat(x, y))

    def eliminate(m: Column, p: Column) -> Column:
        def with_pivot(row: Column) -> Column:
            lead = V.let(F.element_at(row, p + 1), lambda d: F.transform(row, lambda v: v / d))
            return V.let(
                lead,
                lambda r: F.transform(
                    m,
                    lambda x, i: F.when(i == p, r).otherwise(
                        V.let(F.element_at(x, p + 1), lambda f: F.zip_with(x, r, lambda u, v: u - f * v))
                    ),
                ),
            )

        return V.let(F.element_at(m, p + 1), with_pivot)

    done = F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), both, eliminate)
    return F.transform(done, lambda row: F.slice(row, size + 1, F.size(row) - size))


def with_ridge(gram: Column, penalty: float, scale: float = 1.0) -> Column:
    """``scale`` times the matrix, plus the penalty on its diagonal."""
    return F.transform(
        gram,
        lambda row, i: F.transform(
            row, lambda v, j: v * F.lit(scale) + F.when(i == j, F.lit(penalty)).otherwise(F.lit(0.0))
        ),
    )


def gram(
    rows: DataFrame, entity: str, x: Sequence[Column], targets: Sequence[Column] = (), minimum: int = 1
) -> DataFrame:
    """(entity, n, gram, moments): sums of x x' and of x targets' per entity, as arrays of rows.

    The symmetric half is summed once. Inputs and targets must not be NULL. Entities with fewer
    than ``minimum`` rows are left out.
    """
    d, t = len(x), len(targets)
    named = rows.select(
        entity,
        *[c.cast("double").alias(f"_x{i}") for i, c in enumerate(x)],
        *[c.cast("double").alias(f"_t{k}") for k, c in enumerate(targets)],
    )
    half = [F.sum(F.col(f"_x{i}") * F.col(f"_x{j}")).alias(f"_g{i}_{j}") for i in range(d) for j in range(i, d)]
    sides = [F.sum(F.col(f"_x{i}") * F.col(f"_t{k}")).alias(f"_m{i}_{k}") for i in range(d) for k in range(t)]
    sums = named.groupBy(entity).agg(F.count(F.lit(1)).alias("n"), *half, *sides).where(F.col("n") >= minimum)
    matrix = [F.array(*[F.col(f"_g{min(i, j)}_{max(i, j)}") for j in range(d)]) for i in range(d)]
    moments = [F.array(*[F.col(f"_m{i}_{k}") for k in range(t)]) if t else F.array().cast("array<double>") for i in range(d)]
    return sums.select(entity, "n", F.array(*matrix).alias("gram"), F.array(*moments).alias("moments"))


def ridge(
    rows: DataFrame,
    entity: str,
    x: Sequence[Column],
    targets: Sequence[Column],
    penalty: float = PENALTY,
    minimum: int = 1,
) -> DataFrame:
    """(entity, n, beta): per entity the ridge coefficients, a row per input, a column per target."""
    sums = gram(rows, entity, x, targets, minimum)
    beta = solve(with_ridge(F.col("gram"), penalty), F.col("moments"), len(x))
    return sums.select(entity, "n", beta.alias("beta"))


def apply_ridge(rows: DataFrame, fitted: DataFrame, entity: str, x: Sequence[Column], name: str) -> DataFrame:
    """``rows`` with an array of predictions, NULL for entities without a fit."""
    inputs = F.array(*[c.cast("double") for c in x])
    joined = attach_features(rows, fitted.select(entity, F.col("beta").alias("_beta")), [entity])
    first = F.transform(F.col("_beta")[0], lambda v: v * F.lit(0.0))
    summed = F.aggregate(
        F.zip_with(F.col("_beta"), inputs, lambda row, v: F.transform(row, lambda b: b * v)),
        first,
        lambda acc, row: F.zip_with(acc, row, lambda u, v: u + v),
    )
    return joined.withColumn(name, F.when(F.col("_beta").isNotNull(), summed)).drop("_beta")


def shifted(base: Column, beta: Column, x: Column) -> Column:
    """softmax(ln base + B x): ``beta`` has a row of coefficients per class."""
    logs = F.transform(base, lambda p: F.ln(F.greatest(p, F.lit(LEAST_BASE))))
    return V.softmax(F.zip_with(logs, beta, lambda b, row: b + V.dot(row, x)))


def residual_logits(
    train: DataFrame,
    entity: str,
    x: Sequence[Column],
    y: str,
    base: str,
    n_classes: int,
    penalty: float = PENALTY,
    steps: int = STEPS,
    minimum: int = S.MIN_RESIDUAL_PITCHES,
) -> DataFrame:
    """(entity, n, beta): per entity the coefficients of each class on top of ``base``.

    ``y`` is the class position; rows without one, or outside the classes, are left out. Entities
    with fewer than ``minimum`` such rows get no fit.
    """
    d = len(x)
    known = train.where(F.col(y).between(0, n_classes - 1) & F.col(base).isNotNull())
    # Plain columns, not arrays: the loop over all rows then runs compiled.
    fits = F.size(base) == n_classes
    logs = [F.ln(F.greatest(F.get(base, F.lit(k)), F.lit(LEAST_BASE))) for k in range(n_classes)]
    rows = materialise(
        known.select(
            entity,
            *[c.cast("double").alias(f"_x{i}") for i, c in enumerate(x)],
            F.col(y).cast("int").alias("_y"),
            *[F.when(fits, c).alias(f"_log{k}") for k, c in enumerate(logs)],
        ),
        "entity-rows",
    )
    sums = gram(rows, entity, [F.col(f"_x{i}") for i in range(d)], minimum=minimum)
    inverse = solve(with_ridge(F.col("gram"), penalty, 0.5), identity(d), d)
    zero = F.array_repeat(F.array_repeat(F.lit(0.0), d), n_classes)
    state = Succession("entity-fits")
    fitted = state.put(sums.select(entity, "n", inverse.alias("inverse"), zero.alias("beta")))
    for _ in range(steps):
        fitted = state.put(_step(rows, fitted, entity, d, n_classes, penalty))
    out = materialise(fitted.select(entity, "n", "beta"), "entity-fits")
    state.clear()
    return out


def _step(rows: DataFrame, fitted: DataFrame, entity: str, d: int, n_classes: int, penalty: float) -> DataFrame:
    """One bounded Newton step of every entity."""
    cells = [F.col("beta")[k][i].alias(f"_b{k}_{i}") for k in range(n_classes) for i in range(d)]
    at = rows.join(fitted.select(entity, *cells), entity)
    inputs = [F.col(f"_x{i}") for i in range(d)]
    # ``shifted``, class by class.
    dots = [sum((F.col(f"_b{k}_{i}") * v for i, v in enumerate(inputs)), F.lit(0.0)) for k in range(n_classes)]
    at, shares = V.spread_softmax(at, [F.col(f"_log{k}") + b for k, b in enumerate(dots)], "_p")
    gaps = F.array(*[(F.col("_y") == k).cast("double") - p for k, p in enumerate(shares)])
    at = at.select(entity, *inputs, F.posexplode(gaps).alias("_k", "_gap"))
    # A row per class, so that one short aggregate serves all classes.
    sums = at.groupBy(entity, "_k").agg(*[F.sum(F.col("_gap") * v).alias(f"_s{i}") for i, v in enumerate(inputs)])
    row = F.struct("_k", F.array(*[F.col(f"_s{i}") for i in range(d)]).alias("s"))
    slopes = F.transform(F.sort_array(F.collect_list(row)), lambda r: r["s"])
    joined = fitted.join(sums.groupBy(entity).agg(slopes.alias("slope")), entity)
    pulled = F.zip_with(
        "slope", "beta", lambda s, b: F.zip_with(s, b, lambda u, v: u - F.lit(penalty) * v)
    )
    # Each class moves by the inverse of the bound times its slope.
    moved = F.zip_with(
        "beta",
        F.transform(pulled, lambda g: F.transform(F.col("inverse"), lambda row: V.dot(row, g))),
        lambda b, m: F.zip_with(b, m, lambda u, v: u + v),
    )
    return joined.select(entity, "n", "inverse", moved.alias("beta"))


def residual_mixture(
    rows: DataFrame,
    fitted: DataFrame,
    entity: str,
    x: Sequence[Column],
    base: str,
    share: float = S.RESIDUAL_SHARE,
    name: str = "mixed",
) -> DataFrame:
    """``rows`` with the base vector mixed with the entity's own; the base where it has no fit."""
    joined = attach_features(rows, fitted.select(entity, F.col("beta").alias("_beta")), [entity])
    own = shifted(F.col(base), F.col("_beta"), F.array(*[c.cast("double") for c in x]))
    mixed = V.blend([F.col(base), own], [1.0 - share, share])
    return joined.withColumn(name, F.when(F.col("_beta").isNull(), F.col(base)).otherwise(mixed)).drop("_beta")
