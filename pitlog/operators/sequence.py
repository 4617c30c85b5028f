"""Running aggregates and lags inside a sequence, safe for very long sequences.

A window over (pitcher, game) puts each game into one task. That is right for
real games, but not for a key that holds a large part of the log. So sequences
are cut into blocks by their leading order column: a window runs inside each
block, and what earlier blocks of the same sequence contribute (sums, row
count, last few rows) is added from a carry table with one row per later block.
The range of the leading column tells beforehand whether there are later blocks
at all; where there are none, as in an ordinary log, rows are read, shuffled and
windowed once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitlog.operators import windows as W

BLOCK_WIDTH = 65_536
_BLOCK = "_block"
_POS = "_pos"


def running_features(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    row_count: str | None = None,
    counts: Mapping[str, Column] | None = None,
    means: Mapping[str, Column] | None = None,
    lags: Mapping[str, tuple[str, int]] | None = None,
    block_width: int | None = BLOCK_WIDTH,
) -> DataFrame:
    """Add columns computed from the earlier rows of each sequence.

    row_count: name of the number of earlier rows (0 on the first row)
    counts:    name -> condition; earlier rows where it holds, NULL on the first row
    means:     name -> value; mean over earlier rows, NULL until a value was seen
    lags:      name -> (column, k); value k rows before, NULL before the start

    Keys and order columns must not be NULL, and ``order`` must be total inside a
    sequence. Its first column is an integer and sets the blocks: ``block_width``
    consecutive values share one. ``None`` runs one window per sequence, for logs
    whose sequences are known to be short, and is what becomes of a log that has one block.
    """
    if block_width is not None and _one_block(df, order[0], block_width):
        block_width = None
    counts, means, lags = dict(counts or {}), dict(means or {}), dict(lags or {})
    parts = {f"_c_{n}": F.when(c, 1).otherwise(0) for n, c in counts.items()}
    for n, v in means.items():
        parts[f"_s_{n}"] = F.coalesce(v.cast("double"), F.lit(0.0))
        parts[f"_k_{n}"] = F.when(v.isNotNull(), 1).otherwise(0)

    local, block_keys = df.withColumns(parts), list(keys)
    if block_width is not None:
        local = local.withColumn(_BLOCK, F.floor(F.col(order[0]) / block_width))
        block_keys.append(_BLOCK)
    seq = W.sequence_sql(block_keys, order)
    before = W.sequence_sql(block_keys, order, "UNBOUNDED PRECEDING AND 1 PRECEDING")
    windowed = local.selectExpr(
        *[f"`{c}`" for c in [*df.columns, *block_keys[len(keys):]]],
        f"row_number() {seq} AS {_POS}",
        *[f"coalesce(sum(`{p}`) {before}, 0) AS `{p}`" for p in parts],
        *[f"lag(`{c}`, {k}) {seq} AS `_l_{n}`" for n, (c, k) in lags.items()],
    )
    if block_width is None:
        joined, rows_before = windowed, f"({_POS} - 1)"
        total = {p: f"`{p}`" for p in parts}
        lagged = {n: f"`_l_{n}`" for n in lags}
    else:
        carry = _carry(df, keys, order, parts, lags, block_width)
        joined = windowed.join(carry, block_keys, "left")
        rows_before = f"({_POS} - 1 + coalesce(_carry_n, 0))"
        total = {p: f"(`{p}` + coalesce(`_carry{p}`, 0))" for p in parts}
        lagged = {
            n: f"CASE WHEN {_POS} > {k} THEN `_l_{n}` "
            f"ELSE try_element_at(_carry_tail, {_POS} - {k + 1}).`{c}` END"
            for n, (c, k) in lags.items()
        }

    out = {}
    if row_count:
        out[row_count] = f"CAST({rows_before} AS BIGINT)"
    for n in counts:
        out[n] = f"CASE WHEN {rows_before} > 0 THEN CAST({total[f'_c_{n}']} AS BIGINT) END"
    for n in means:
        out[n] = f"try_divide({total[f'_s_{n}']}, {total[f'_k_{n}']})"
    out.update(lagged)
    return joined.selectExpr(
        *[f"`{c}`" for c in df.columns], *[f"{e} AS `{n}`" for n, e in out.items()]
    )


def _one_block(df: DataFrame, leading: str, block_width: int) -> bool:
    """Whether all rows lie in one block; reads the leading order column only."""
    block = F.floor(F.col(leading) / block_width)
    row = df.agg(F.min(block).alias("low"), F.max(block).alias("high")).first()
    return row["low"] == row["high"]


def _carry(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    parts: Mapping[str, Column],
    lags: Mapping[str, tuple[str, int]],
    block_width: int,
) -> DataFrame:
    """Per later block of a sequence: sums, row count and last rows of the blocks before it."""
    depth = max([k for _, k in lags.values()], default=1)
    sources = sorted({c for c, _ in lags.values()})
    block_keys = [*keys, _BLOCK]
    ranks = [f"_o{i}" for i in range(len(order))]
    narrow = df.select(
        *keys,
        F.floor(F.col(order[0]) / block_width).alias(_BLOCK),
        *[F.col(o).alias(r) for o, r in zip(order, ranks)],
        *[e.alias(p) for p, e in parts.items()],
        *[F.col(c).alias(f"_v_{c}") for c in sources],
    )
    seq = W.sequence_sql(block_keys, ranks)
    upto = W.sequence_sql(block_keys, ranks, "UNBOUNDED PRECEDING AND CURRENT ROW")
    # Rows without a successor at distance ``depth`` are the last ``depth`` rows of
    # their block; the very last of them has the sums of the whole block.
    last_rows = narrow.selectExpr(
        *block_keys,
        f"row_number() {seq} AS _n",
        *[f"sum(`{p}`) {upto} AS `{p}`" for p in parts],
        *[f"`_v_{c}`" for c in sources],
        f"lead(1, {depth}) {seq} AS _later",
    ).where("_later IS NULL")
    fields = ", ".join(["'_n', _n", *[f"'{c}', `_v_{c}`" for c in sources]])
    blocks = last_rows.groupBy(*block_keys).agg(
        F.expr("max(_n) AS _n"),
        *[F.expr(f"max_by(`{p}`, _n) AS `{p}`") for p in parts],
        F.expr(f"sort_array(collect_list(named_struct({fields}))) AS _tail"),
    )
    earlier = W.sequence_sql(keys, [_BLOCK], "UNBOUNDED PRECEDING AND 1 PRECEDING")
    # Every block has at least one row, so ``depth`` blocks hold the last ``depth`` rows.
    nearby = W.sequence_sql(keys, [_BLOCK], f"{depth} PRECEDING AND 1 PRECEDING")
    return blocks.selectExpr(
        *block_keys,
        f"sum(_n) {earlier} AS _carry_n",
        *[f"sum(`{p}`) {earlier} AS `_carry{p}`" for p in parts],
        f"flatten(collect_list(_tail) {nearby}) AS _carry_tail",
    ).where("_carry_n IS NOT NULL")
