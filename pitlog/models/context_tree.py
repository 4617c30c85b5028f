"""Variable-order sequence model: a context tree with escape probabilities and pruning.

Contexts are nested: the first conditioning column, the first two, and so on to the whole list.
The log is read once, grouped by the finest context into class counts; every coarser level adds
up that small table. A context's probabilities mix its counts with its parent's probabilities by
its escape probability u / (n + u), u being the number of classes seen in n rows.

Rows held out from the counts decide how long contexts are: a context stays if its own
probabilities and those of the longer contexts below it describe its held-out rows better than
its parent's do. All of this happens on tables whose size is the number of contexts; scoring joins
those tables, longest context first, to the rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitlog import schema as S
from pitlog.functions import vectors as V
from pitlog.operators.joins import attach_features
from pitlog.operators.lineage import materialise


def _sum(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, v: a + v)


def escape(counts: Column) -> Column:
    """Share of the parent: classes seen / (rows + classes seen); one without rows."""
    seen = F.size(F.filter(counts, lambda v: v > 0))
    return F.coalesce(F.try_divide(seen, _sum(counts) + seen), F.lit(1.0))


def interpolated(counts: Column, parent: Column) -> Column:
    """(count + seen * parent) / (rows + seen): escape mass goes to the parent's probabilities."""
    return V.let(
        F.struct(_sum(counts).alias("n"), escape(counts).alias("e")),
        lambda s: F.zip_with(
            counts,
            parent,
            lambda c, p: (1 - s["e"]) * F.coalesce(F.try_divide(c, s["n"]), F.lit(0.0)) + s["e"] * p,
        ),
    )


def log_likelihood(counts: Column, probs: Column) -> Column:
    return V.total(F.zip_with(counts, probs, lambda c, p: F.when(c > 0, c * F.ln(p)).otherwise(0.0)))


def _level(finer: DataFrame, context: Sequence[str], k: int) -> DataFrame:
    """A coarser level: the counts of the contexts below it added up."""
    added = [F.array(*[F.sum(F.col(c)[i]) for i in range(k)]).alias(c) for c in ("counts", "held")]
    return finer.groupBy(*context).agg(*added)


@dataclass(frozen=True)
class ContextTree:
    """(depth, contexts..., counts, held, escape, gain, kept, probs); deeper columns are NULL."""

    contexts: tuple[str, ...]
    classes: tuple[str, ...]
    table: DataFrame

    def predict(self, df: DataFrame, name: str = "probs") -> DataFrame:
        """``df`` with the probabilities of the longest kept context of each row."""
        kept = self.table.where("kept")
        root = kept.where("depth = 0").first()
        first = list(root["probs"]) if root else [1.0 / len(self.classes)] * len(self.classes)
        out, found = df, []
        for depth in range(len(self.contexts), 0, -1):
            context = list(self.contexts[:depth])
            level = kept.where(F.col("depth") == depth).select(*context, F.col("probs").alias(f"_p{depth}"))
            out = attach_features(out, level, context)
            found.append(F.col(f"_p{depth}"))
        made = F.coalesce(*found, F.array(*[F.lit(p) for p in first]))
        return out.withColumn(name, made).drop(*[f"_p{d}" for d in range(1, len(self.contexts) + 1)])


def fit(
    df: DataFrame,
    contexts: Sequence[str],
    label: str = "pitch_type_can",
    classes: Sequence[str] = S.PITCH_TYPES,
    held: Column | None = None,
    least_gain: float = 0.0,
    refit: bool = False,
) -> ContextTree:
    """The tree of ``df``. Context columns must not be NULL (fill lags with a word such as NONE).

    ``held`` marks the rows that prune; without it every context with rows stays. With ``refit``
    the probabilities of the kept contexts come from all rows, held-out ones too.
    """
    k, depth = len(classes), len(contexts)
    held = F.coalesce(held, F.lit(False)) if held is not None else F.lit(False)
    which = F.col(label)
    fine = df.select(*contexts, which.alias("_c"), held.alias("_h")).groupBy(*contexts).agg(
        F.array(*[F.count_if((F.col("_c") == c) & ~F.col("_h")) for c in classes]).alias("counts"),
        F.array(*[F.count_if((F.col("_c") == c) & F.col("_h")) for c in classes]).alias("held"),
    )
    levels = [materialise(fine, "contexts")]
    for d in range(depth - 1, -1, -1):
        levels.append(_level(levels[-1], contexts[:d], k))
    levels.reverse()

    # Down from the root: probabilities, and what held-out rows gain over the parent's.
    uniform = F.array_repeat(F.lit(1.0 / k), k)
    counts, rows = F.col("counts"), F.col("held")
    described = [_described(levels[0], uniform)]
    for d in range(1, depth + 1):
        at = _with_parent(levels[d], described[-1], "probs", contexts[: d - 1])
        described.append(_described(at, F.col("_parent")).drop("_parent"))
    described = [materialise(t, f"contexts-{d}") for d, t in enumerate(described)]

    # Up to the root: a context's worth is its own gain and that of the contexts below it.
    worth = [described[-1].withColumn("gain", F.col("own"))]
    for d in range(depth - 1, -1, -1):
        below = worth[-1].groupBy(*contexts[:d]).agg(F.sum(F.greatest("gain", F.lit(0.0))).alias("_below"))
        if d:
            at = attach_features(described[d], below, list(contexts[:d]))
        else:
            at = described[0].withColumn("_below", F.lit(below.first()["_below"]).cast("double"))
        worth.append(at.withColumn("gain", F.col("own") + F.coalesce("_below", F.lit(0.0))).drop("_below"))
    worth.reverse()

    # Down again: a context is kept if it is worth it and its parent is kept.
    enough = F.col("gain") > least_gain if _has_held(worth[0]) else F.lit(True)
    kept = [worth[0].withColumn("kept", F.lit(True))]
    for d in range(1, depth + 1):
        at = _with_parent(worth[d], kept[-1], "kept", contexts[: d - 1])
        kept.append(at.withColumn("kept", F.col("_parent") & enough & (_sum(counts) > 0)).drop("_parent"))
    if refit:
        kept = _refitted(kept, contexts, k, counts, rows)
    named = [
        t.select(
            F.lit(d).alias("depth"),
            *[F.col(c) if i < d else F.lit(None).cast(df.schema[c].dataType).alias(c) for i, c in enumerate(contexts)],
            "counts",
            "held",
            escape(counts).alias("escape"),
            "gain",
            "kept",
            "probs",
        )
        for d, t in enumerate(kept)
    ]
    return ContextTree(tuple(contexts), tuple(classes), materialise(reduce(DataFrame.unionByName, named), "tree"))


def _described(level: DataFrame, parent: Column) -> DataFrame:
    """``level`` with probabilities and what its held-out rows gain over ``parent``."""
    at = level.withColumn("probs", interpolated(F.col("counts"), parent))
    rows = F.col("held")
    return at.withColumn("own", log_likelihood(rows, F.col("probs")) - log_likelihood(rows, parent))


def _with_parent(level: DataFrame, parents: DataFrame, name: str, context: Sequence[str]) -> DataFrame:
    """``level`` with the value ``name`` of each context's parent; the root's is a constant."""
    if context:
        return attach_features(level, parents.select(*context, F.col(name).alias("_parent")), list(context))
    value = parents.first()[name]
    whole = F.array(*[F.lit(v) for v in value]) if isinstance(value, list) else F.lit(value)
    return level.withColumn("_parent", whole)


def _has_held(root: DataFrame) -> bool:
    row = root.select(_sum(F.col("held")).alias("n")).first()
    return bool(row and row["n"])


def _refitted(kept: list[DataFrame], contexts: Sequence[str], k: int, counts: Column, rows: Column) -> list[DataFrame]:
    """The same contexts with probabilities from all rows."""
    every = F.zip_with(counts, rows, lambda a, b: a + b)
    uniform = F.array_repeat(F.lit(1.0 / k), k)
    out = [kept[0].withColumn("probs", interpolated(every, uniform))]
    for d in range(1, len(kept)):
        at = _with_parent(kept[d], out[-1], "probs", contexts[: d - 1])
        out.append(at.withColumn("probs", interpolated(every, F.col("_parent"))).drop("_parent"))
    return out
