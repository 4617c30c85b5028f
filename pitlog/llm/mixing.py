"""Mixing sources to target weights by hash-threshold histograms.

Every document has a fixed hash. A source's budget is met by whole copies of all its documents
plus one more copy of those whose hash is below the source's threshold, so budgets are nested:
a larger one only adds documents. The threshold is found without sorting: tokens are summed by
source and hash bucket, the bucket in which the running sum passes the budget is the boundary,
and only its documents are summed again over finer buckets, until all bits of the hash are
used. What is grouped is small: source and bucket, with partial sums before the shuffle, so a
source with a third of all rows is no problem.

Targets share the total by weight, but a source stops at ``most`` times its own size; the
excess goes to the others by weight until none is above. That takes a few aggregations over the
sources, of which there may be many; their order by code point comes from ranges.

The hash is that of id and text, so rows without an id, or with one id, are told apart by their
texts. Rows that are equal in both are told apart by a row number below the hash, which counts
only at the boundary: as many of them are taken as the budget allows, and which ones makes no
difference. So each source ends within one document of its target.

Null and empty texts have size 0 and are taken 0 times the budget like others (they add
nothing). A null source is a source, the last one. Very long texts are counted whole. An empty
table gives no rows. Only three columns are read, so others may have any names. Reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pitlog.llm.common import keep, ranked

WORD = r"[^\x20\x09-\x0D]+"
MOST = 3.0
HEX_DIGITS = 15  # of the hash, 60 bits; 16 digits of a row number follow
LEVELS = (3, 6, HEX_DIGITS)  # 4,096 buckets, then as many in the boundary one, then single values
ROW_LEVELS = (HEX_DIGITS + 8, HEX_DIGITS + 12, HEX_DIGITS + 16)  # of rows with one hash
SOURCES_BROADCAST = 100_000


def words_of(text: str = "text") -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def hash_of(key: str, text: str) -> Column:
    """The first 60 bits of the MD5 of id and text as hex digits, which SQL engines agree on."""
    name, body = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (key, text))
    both = F.concat(name, F.lit(":"), F.md5(body.cast("binary")))
    return F.substring(F.md5(both.cast("binary")), 1, HEX_DIGITS)


def targets(sizes: DataFrame, weight: Column, most: float = MOST) -> DataFrame:
    """``sizes`` (source, source_size; one row a source) with its ``target``.

    A source is at its cap if the common price (target per weight) exceeds its cap per weight. The
    price is what the capped sources leave, divided by the weights of the others; from the price
    with none capped it only rises, so it is recomputed until no further source is capped.
    """
    priced = sizes.select("source", "source_size", weight.cast("double").alias("weight"))
    priced = keep(priced.withColumn("cap", F.lit(most) * F.col("source_size")), "mix-sources")
    total = float(priced.agg(F.sum("source_size")).first()[0] or 0)
    price, capped = 0.0, -1
    while True:
        free = F.col("cap") >= F.col("weight") * F.lit(price)
        row = priced.agg(
            F.count_if(~free).alias("n"),
            F.sum(F.when(~free, F.col("cap")).otherwise(0.0)).alias("spent"),
            F.sum(F.when(free, F.col("weight")).otherwise(0.0)).alias("weights"),
        ).first()
        if row.n == capped or not row.weights:
            break
        capped, price = row.n, (total - row.spent) / row.weights
    return priced.select(
        "source", "source_size", F.least(F.col("cap"), F.col("weight") * F.lit(price)).alias("target")
    )


def cycle_weights(sizes: DataFrame, values: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    """``sizes`` with ``weight``: values that repeat over the sources by code point, null last."""
    placed = ranked(sizes, [F.asc_nulls_last("source")], "place")
    weights = F.array(*[F.lit(float(v)) for v in values])
    return placed.withColumn("weight", F.element_at(weights, (F.col("place") % len(values) + 1).cast("int")))


def _same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def thresholds(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """``goals`` (source, source_size, target) with ``copies`` and ``below``.

    ``sized`` has source, size and hash (with the row number). Each document is taken ``copies``
    times, and once more if its hash is less than ``below``: the budget is not exceeded, and one
    more document would exceed it.
    """
    state = goals.select(
        "source",
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
        .otherwise(0)
        .alias("copies"),
    ).withColumn("budget", F.col("target") - F.col("copies") * F.col("source_size"))
    state = keep(state.withColumn("prefix", F.lit("")), "mix-budgets")
    few = state.count() <= SOURCES_BROADCAST
    for digits in LEVELS:
        state = _refined(sized, state, digits, few)
    # A hash that several rows share at a boundary is refined by their row numbers.
    if not state.where("rows > 1").isEmpty():
        for digits in ROW_LEVELS:
            state = _refined(sized, state, digits, few)
    return state.select("source", "source_size", "target", "copies", F.col("prefix").alias("below"))


def _refined(sized: DataFrame, state: DataFrame, digits: int, few: bool) -> DataFrame:
    """``state`` with the boundary, so far within ``prefix``, found to that many digits."""
    at = F.broadcast(state) if few else state
    inside = sized.join(
        at.select(F.col("source").alias("s"), "prefix"),
        _same(F.col("source"), F.col("s")) & F.col("hash").startswith(F.col("prefix")),
    )
    sums = inside.groupBy("source", F.substring("hash", 1, digits).alias("bucket")).agg(
        F.sum("size").alias("n"), F.count("*").alias("rows")
    )
    run = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    passed = (
        sums.withColumn("upto", F.sum("n").over(run))
        .join(at.select(F.col("source").alias("s"), "budget"), _same(F.col("source"), F.col("s")))
        .where(F.col("upto") > F.col("budget"))
        .groupBy("source")
        .agg(F.min(F.struct("bucket", "upto", "n", "rows")).alias("edge"))
    )
    joined = state.drop("rows").join(
        passed.withColumnRenamed("source", "s"), _same(F.col("source"), F.col("s")), "left"
    )
    # Without a boundary the budget covers everything left in here; the rest is behind it.
    return keep(
        joined.select(
            "source",
            "source_size",
            "target",
            "copies",
            F.coalesce(F.col("budget") - (F.col("edge.upto") - F.col("edge.n")), F.col("budget")).alias("budget"),
            F.coalesce(F.col("edge.bucket"), F.concat("prefix", F.lit("g"))).alias("prefix"),
            F.coalesce(F.col("edge.rows"), F.lit(0)).alias("rows"),
        ),
        "mix-budgets",
    )


def mix(
    docs: DataFrame,
    weight: Column | None = None,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    most: float = MOST,
) -> DataFrame:
    """One row per document: key, source, size, source_size, target, taken.

    ``taken`` counts the words that the mix takes of it, repeats counted.
    """
    row = F.lpad(F.lower(F.hex(F.monotonically_increasing_id())), 16, "0")
    sized = docs.select(
        F.col(f"`{key}`").alias(key),
        F.col(f"`{source}`").alias("source"),
        words_of(text).alias("size"),
        F.concat(hash_of(key, text), row).alias("hash"),
    )
    sized = keep(sized, "mix-sizes")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    if weight is None:
        sizes, weight = cycle_weights(sizes), F.col("weight")
    goals = targets(sizes, weight, most)
    marks = thresholds(sized, goals).withColumnRenamed("source", "s")
    if marks.count() <= SOURCES_BROADCAST:
        marks = F.broadcast(marks)
    times = F.col("copies") + (F.col("hash") < F.col("below")).cast("int")
    return sized.join(marks, _same(F.col("source"), F.col("s"))).select(
        key, "source", "size", "source_size", "target", (times * F.col("size")).cast("bigint").alias("taken")
    )
