"""A bounded sample of labelled rows to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitlog.llm.common import bounded_sample

SAMPLE_ROWS = 20_000


def sample(
    docs: DataFrame,
    labels: DataFrame,
    label: Column,
    key: str = "doc_id",
    text: str = "text",
    rows: int = SAMPLE_ROWS,
    share: Column | None = None,
) -> DataFrame:
    """At most ``rows`` labelled documents: labelled_key, label and the key's ``text``.

    Keys without a label or with labels that contradict each other are left out. Which keys are
    taken depends on their hash alone. A key that several rows have gives one of their texts, the
    least by its hash, null only if it has no other; as an aggregate that is found before the
    shuffle. So repeated rows neither weigh more nor break the bound. The picked keys are
    bounded, so they may be broadcast.
    """
    clear = (
        labels.select(F.col(key).alias("labelled_key"), label.cast("int").alias("label"))
        .where("labelled_key is not null and label is not null")
        .groupBy("labelled_key")
        .agg(F.min("label").alias("label"), F.max("label").alias("highest"))
        .where("label = highest")
        .select("labelled_key", "label")
    )
    picked = bounded_sample(clear, "labelled_key", rows)
    found = docs.select(F.col(f"`{key}`").alias("found_key"), F.col(f"`{text}`").alias("found"))
    found = found.join(F.broadcast(picked), F.col("found_key") == F.col("labelled_key"))
    order = F.struct(F.col("found").isNull().alias("none"), F.xxhash64("found").alias("h"), "found")
    one = found.groupBy("labelled_key", "label").agg(F.min(order).alias("least"))
    return one.select("labelled_key", "label", F.col("least.found").alias(text))
