"""License scan: ordered signature rules behind a keyword prefilter. DataFrame functions only.

Every rule (see ``license_rules``) names a keyword that all it can match contains. A text is
looked through for the keywords, a few plain searches; only a text with one is cut into words
and meets the signatures of its keywords, no others. Finds are intervals of words. One is
dropped if another one contains it whose level is at least its own, the longer one first, then
the higher level, then the rule that comes first in order; so "gpl 2" inside "lgpl 2 1" or a
name inside a notice goes, and finds that merely overlap stay. That needs the finds of a text in
order once, with the farthest end of each level so far: a window, not a comparison of all pairs.

Base places (word sequences with labels) are found apart from the rules; their labels stay.

The confidence of the surest find left is the score; a base place without any find scores
``BASE_CONFIDENCE``, no place at all 0. A null or empty text has no words and no labels. Repeated
rows are judged each, by a row number of their own. Texts of any length are matched whole. An
empty table gives no rows. Only the columns asked for are returned, so others may have any names;
one that has the name of the result is replaced.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pitlog.llm.common import free_name, keep
from pitlog.llm.license_rules import BASE, LEVELS, Rule, rules

FOUND = {
    "labels": "array<string>",
    "sure": "double",
    "spans": "array<struct<start: bigint, end: bigint, label: string, level: int>>",
}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE_CONFIDENCE = 0.5
FINDS_BROADCAST = 100_000
ORDER = sorted(set(LEVELS.values()))


def spaced(words: str) -> str:
    """A signature for a text whose every word stands between two spaces of its own."""
    return " (?:" + words.replace(" ", "  ") + ") "


def phrase(words: str) -> str:
    return " " + words.replace(" ", "  ") + " "


def normal(text: Column) -> Column:
    """The words of ``text``, each between two spaces."""
    lower = F.translate(text, UPPER, LOWER)
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(lower, BETWEEN, "  ")), F.lit(" "))


def n_words(part: Column) -> Column:
    """Words of a piece of a normal text."""
    return ((F.length(part) - F.length(F.replace(part, F.lit(" "), F.lit("")))) / 2).cast("bigint")


def has_keyword(low: Column, keyword: str) -> Column:
    """Whether the lower-cased text may hold the keyword's words one after the other."""
    first, *others = keyword.split(" ")
    found = F.contains(low, F.lit(first))
    if others:
        found &= low.rlike(BETWEEN.join([first, *others]))
    return found


def finds(texts: DataFrame, known: Sequence[Rule]) -> DataFrame:
    """(id, place, start, end): where signatures match in ``texts`` (id, norm, keywords), in words.

    Matches of one rule do not overlap. Pieces between matches give their places.
    """
    spark = texts.sparkSession
    listed = spark.createDataFrame(
        [(r.keyword, r.place, spaced(r.signature)) for r in known], "keyword string, place int, signature string"
    )
    met = texts.select("id", "norm", F.explode("keywords").alias("keyword")).join(F.broadcast(listed), "keyword")
    met = met.where(F.expr("norm rlike signature")).select(
        "id",
        "place",
        F.regexp_extract_all("norm", F.col("signature"), F.lit(0)).alias("matches"),
        F.split("norm", F.col("signature"), -1).alias("between"),
    )
    pairs = F.transform(
        F.arrays_zip("matches", "between"),
        lambda p: F.struct(n_words(p["between"]).alias("gap"), n_words(p["matches"]).alias("n")),
    )
    # The last piece follows no match, so it has no partner.
    each = met.select("id", "place", F.posexplode(F.slice(pairs, F.lit(1), F.size("matches"))).alias("k", "p"))
    upto = W.partitionBy("id", "place").orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    end = F.sum(F.col("p.gap") + F.col("p.n")).over(upto)
    return each.select("id", "place", (end - F.col("p.n")).alias("start"), end.alias("end"))


def undominated(found: DataFrame) -> DataFrame:
    """``found`` (id, level, place, start, end) less finds inside another one of their level or above."""
    order = ["start", F.desc("end"), F.desc("level"), "place"]
    before = W.partitionBy("id").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    ends = [F.max(F.when(F.col("level") >= k, F.col("end"))).over(before).alias(f"end_{k}") for k in ORDER]
    at = found.select("*", *ends)
    covered = reduce(lambda a, k: a | ((F.col("level") == k) & (F.col(f"end_{k}") >= F.col("end"))), ORDER, F.lit(False))
    return at.where(~F.coalesce(covered, F.lit(False))).select(*found.columns)


def _base(norm: Column, words: Column, base: Sequence[tuple[str, str]]) -> dict[str, Column]:
    """Number of base places, their first and last word, and their labels; for a normal text."""
    counts, firsts, lasts, labels = [], [], [], []
    for text, label in base:
        there = F.contains(norm, F.lit(phrase(text)))
        # Counted by the beginning, as places of a phrase may overlap.
        counts.append(F.when(there, F.regexp_count(norm, F.lit(f"(?={phrase(text)})"))).otherwise(0))
        firsts.append(F.when(there, n_words(F.substring_index(norm, phrase(text), 1))))
        behind = n_words(F.substring_index(norm, phrase(text), -1))
        lasts.append(F.when(there, words - behind - len(text.split())))
        labels.append(F.when(there, F.lit(label)))
    none = F.lit(None).cast("bigint")
    return {
        "n_base": reduce(add, counts).cast("bigint"),
        "first_word": F.least(*firsts, none, none),
        "last_word": F.greatest(*lasts, none, none),
        "base_labels": F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))),
    }


def scan(
    docs: DataFrame,
    text: str = "text",
    columns: Sequence[str] | None = None,
    known: Sequence[Rule] | None = None,
    base: Sequence[tuple[str, str]] = BASE,
    out: str = "licenses",
) -> DataFrame:
    """``columns`` of ``docs`` (default: all but the text) with a struct ``out``.

    It has n_words, n_base, first_word, last_word, base_labels, labels (the rules' too), score and
    spans (label, form level, start and end in words) of the finds left.
    """
    known = rules() if known is None else list(known)
    columns = [c for c in (docs.columns if columns is None else columns) if c not in (text, out)]
    whole = F.struct(*[F.col(f"`{c}`") for c in columns]) if columns else F.struct(F.lit(1).alias("none"))
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    at = docs.select(whole.alias("row"), body.alias("t"), F.lower(body).alias("low"))
    gates = [F.when(has_keyword(F.col("low"), k), F.lit(k)) for k in sorted({r.keyword for r in known})]
    phrased = reduce(lambda a, b: a | has_keyword(F.col("low"), b[0]), base, F.lit(False))
    at = at.select("row", "t", F.array_compact(F.array(*gates)).alias("keywords"), phrased.alias("phrased"))
    at = at.select(
        F.monotonically_increasing_id().alias("id"),
        "row",
        F.regexp_count("t", F.lit(WORD)).cast("bigint").alias("n_words"),
        "keywords",
        F.when(F.col("phrased") | (F.size("keywords") > 0), normal(F.col("t"))).alias("norm"),
    )
    # Written once, with the words of gated texts only, so that row numbers hold.
    at = keep(at, "licenses-rows")
    if known:
        gated = at.where(F.size("keywords") > 0).select("id", "norm", "keywords")
        about = at.sparkSession.createDataFrame(
            [(r.place, r.label, r.level, r.confidence) for r in known],
            "place int, label string, level int, confidence double",
        )
        found = undominated(finds(gated, known).join(F.broadcast(about), "place"))
        per_row = found.groupBy("id").agg(
            F.collect_set("label").alias("labels"),
            F.max("confidence").alias("sure"),
            F.sort_array(F.collect_list(F.struct("start", "end", "label", "level"))).alias("spans"),
        )
        per_row = keep(per_row, "licenses-finds")
        few = per_row.count() <= FINDS_BROADCAST
        at = at.join(F.broadcast(per_row) if few else per_row, "id", "left")
    else:
        at = at.select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in FOUND.items()])
    places = _base(F.col("norm"), F.col("n_words"), base)
    at = at.select("*", *[c.alias(n) for n, c in places.items()])
    none = F.array().cast("array<string>")
    sure = F.coalesce("sure", F.when(F.col("n_base") > 0, BASE_CONFIDENCE), F.lit(0.0))
    struct = F.struct(
        "n_words",
        F.coalesce("n_base", F.lit(0).cast("bigint")).alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", none).alias("base_labels"),
        F.array_sort(F.array_union(F.coalesce("base_labels", none), F.coalesce("labels", none))).alias("labels"),
        sure.alias("score"),
        F.coalesce("spans", F.array().cast(FOUND["spans"])).alias("spans"),
    )
    return at.select(*[F.col("row")[c].alias(c) for c in columns], struct.alias(out))
