"""URL filter: rules first, gradient-boosted trees for the rest. DataFrame functions only.

A rule is a host with a path prefix; it fits the host and all subdomains, and the longest one
wins. URLs that no rule fits are judged by boosted trees over lexical features: lengths,
depth, digit and punctuation shares, character entropy, parameters, and statistics of the
host's last label and last two labels. Those statistics, the training rows and the trees all
come from URLs with a label; by default these are the URLs that rules decide.

Training rows are a bounded sample by hash, given by a parameter; suffix statistics count all
labelled URLs, smoothed towards the overall share, so an unseen suffix gets that share.

A null URL or one without "://" has an empty host and path; no rule fits it and the trees
judge its features. Repeated rows are judged each, URLs of any length whole. Of rules of one length
that fit the first by text wins; of labelled URLs all equal ones count. If the labelled URLs are
all of one class (or there are none) the verdict without a rule is that class (or allow). An empty
table gives no rows. A column with the name of the result is replaced.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitlog.llm.common import bounded_sample, free_name

# What the query's rules say, as (verdict, host and path).
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TRAINING_ROWS = 20_000
PRIOR_WEIGHT = 20.0
SUFFIXES_BROADCAST = 100_000
ROUNDS = 20
DEPTH = 4

LEXICAL = (
    "url_length",
    "host_length",
    "path_length",
    "host_labels",
    "depth",
    "digit_share",
    "host_digit_share",
    "hyphens",
    "punctuation_share",
    "entropy",
    "parameters",
    "value_length",
    "has_fragment",
    "has_extension",
    "is_secure",
)


def host_of(url: Column) -> Column:
    """From behind the first "://" up to "/", "?", "#" or the end; A-Z lower-cased."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(rest, F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From behind the host up to "?", "#" or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits, as a struct of rule and verdict; null if none does."""
    out = None
    for verdict, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        at = text.index("/")
        base, prefix = text[:at], text[at:]
        fits = ((host == base) | host.endswith(f".{base}")) & path.startswith(prefix)
        value = F.struct(F.lit(text).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    if out is None:
        return F.lit(None).cast("struct<rule: string, verdict: string>")
    return out


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, characters, ""))


def _entropy(text: Column) -> Column:
    """Shannon entropy of the ASCII characters, in bits: log2(n) - sum(c log2 c) / n."""
    n = F.length(text).cast("double")
    seen = F.array_distinct(F.split(text, ""))
    each = F.transform(
        seen, lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / F.greatest(F.length(c), F.lit(1))
    )
    spread = F.aggregate(each, F.lit(0.0), lambda a, c: a + F.when(c > 0, c * F.log2(c)).otherwise(0.0))
    return F.when(n > 0, F.log2(n) - spread / n).otherwise(0.0)


def features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    text = F.coalesce(url, F.lit(""))
    query = F.coalesce(F.regexp_extract(text, r"(?s)^[^?#]*\?([^#]*)", 1), F.lit(""))
    length = F.greatest(F.length(text), F.lit(1))
    columns = {
        "url_length": F.length(text),
        "host_length": F.length(host),
        "path_length": F.length(path),
        "host_labels": F.size(F.split(host, r"\.")),
        "depth": _count(F.regexp_replace(path, "/+$", ""), "/"),
        "digit_share": _count(text, "[0-9]") / length,
        "host_digit_share": _count(host, "[0-9]") / F.greatest(F.length(host), F.lit(1)),
        "hyphens": _count(host, "-"),
        "punctuation_share": _count(text, "[^A-Za-z0-9]") / length,
        "entropy": _entropy(text),
        "parameters": F.when(query == "", 0).otherwise(F.size(F.split(query, "[&;]"))),
        "value_length": F.length(query),
        "has_fragment": F.instr(text, "#") > 0,
        "has_extension": path.rlike(r"\.[A-Za-z0-9]{1,5}$"),
        "is_secure": text.startswith("https"),
    }
    return {name: c.cast("double") for name, c in columns.items()}


def suffix(host: Column, labels: int) -> Column:
    return F.substring_index(host, ".", -labels)


@dataclass(frozen=True)
class UrlModel:
    """Boosted trees with the suffix statistics they were trained on, or a constant verdict."""

    share: float
    suffixes: DataFrame | None = None
    trees: GBTClassificationModel | None = None

    @property
    def inputs(self) -> list[str]:
        return [*LEXICAL, "suffix_share_1", "suffix_share_2"]

    def add_suffix_shares(self, df: DataFrame) -> DataFrame:
        """``df`` (with ``host``) and the block shares of its last label and last two labels."""
        few = self.suffixes.count() <= SUFFIXES_BROADCAST
        for k in (1, 2):
            part = self.suffixes.where(F.col("labels") == k).select(
                F.col("suffix").alias(f"suffix_{k}"), F.col("share").alias(f"known_{k}")
            )
            df = (
                df.withColumn(f"suffix_{k}", suffix(F.col("host"), k))
                .join(F.broadcast(part) if few else part, f"suffix_{k}", "left")
                .withColumn(f"suffix_share_{k}", F.coalesce(f"known_{k}", F.lit(self.share)))
                .drop(f"suffix_{k}", f"known_{k}")
            )
        return df

    def add_verdict(self, df: DataFrame, out: str) -> DataFrame:
        """``df`` (with url, host and path) and the model's verdict."""
        if self.trees is None:
            return df.withColumn(out, F.lit("block" if self.share > 0.5 else "allow"))
        names = df.columns
        at = df.select("*", *[c.alias(n) for n, c in features(F.col("url"), F.col("host"), F.col("path")).items()])
        at = VectorAssembler(inputCols=self.inputs, outputCol="inputs").transform(self.add_suffix_shares(at))
        at = self.trees.transform(at)
        verdict = F.when(F.col("prediction") == 1.0, "block").otherwise("allow")
        return at.select(*names, verdict.alias(out))


def learn(urls: DataFrame, rows: int = TRAINING_ROWS, rounds: int = ROUNDS, depth: int = DEPTH) -> UrlModel:
    """A model from ``urls`` (url, blocked as 0 or 1; rows with nulls are left out)."""
    named = urls.where("url is not null and blocked is not null").select(
        "url", F.col("blocked").cast("double").alias("blocked")
    )
    named = named.select("*", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    totals = named.agg(F.count("*").alias("n"), F.sum("blocked").alias("blocked")).first()
    if not totals.n or totals.blocked in (0.0, float(totals.n)):
        return UrlModel((totals.blocked or 0.0) / max(totals.n, 1))
    share = totals.blocked / totals.n
    suffixes = (
        named.select("blocked", F.explode(F.array(
            *[F.struct(F.lit(k).alias("labels"), suffix(F.col("host"), k).alias("suffix")) for k in (1, 2)]
        )).alias("s"))
        .groupBy("s.labels", "s.suffix")
        .agg(((F.sum("blocked") + PRIOR_WEIGHT * share) / (F.count("*") + PRIOR_WEIGHT)).alias("share"))
    )
    model = UrlModel(share, suffixes)
    sample = bounded_sample(named, "url", rows)
    sample = sample.select("*", *[c.alias(n) for n, c in features(F.col("url"), F.col("host"), F.col("path")).items()])
    sample = VectorAssembler(inputCols=model.inputs, outputCol="inputs").transform(model.add_suffix_shares(sample))
    trees = GBTClassifier(
        featuresCol="inputs", labelCol="blocked", maxIter=rounds, maxDepth=depth, stepSize=0.2, seed=7
    ).fit(sample.select("inputs", "blocked"))
    return UrlModel(share, suffixes, trees)


def judge(
    pages: DataFrame,
    url: str = "url",
    rules: Sequence[tuple[str, str]] = RULES,
    labelled: DataFrame | None = None,
    out: str = "url_filter",
) -> DataFrame:
    """``pages`` with a struct ``out``: host, path, rule (null: none) and verdict.

    ``labelled`` (url, blocked) trains the trees; without it the URLs that rules decide do.
    """
    link = F.col(f"`{url}`")
    whole = free_name(pages, "row")
    at = pages.select(
        F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias(whole),
        link.alias("url"),
        host_of(link).alias("host"),
        path_of(link).alias("path"),
    )
    at = at.withColumn("ruled", rule_of(F.col("host"), F.col("path"), rules))
    if labelled is None:
        labelled = at.where("ruled is not null").select(
            "url", (F.col("ruled.verdict") == "block").cast("int").alias("blocked")
        )
    judged = learn(labelled).add_verdict(at, "learned")
    found = F.struct(
        "host",
        "path",
        F.col("ruled.rule").alias("rule"),
        F.coalesce("ruled.verdict", "learned").alias("verdict"),
    )
    kept = [F.col(whole)[c].alias(c) for c in pages.columns if c.lower() != out.lower()]
    return judged.select(*kept, found.alias(out))
