"""URL filters: listed rules first, gradient-boosted trees on the wording of the URL for the rest.

Everything is columns and MLlib: features are built-in functions of the URL, the trees are trained by Spark on at most
``TRAIN_ROWS`` labelled URLs, and no page is grouped or shuffled to be judged.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitpanel.llm.common import store

#: Trees are fitted on so many labelled URLs at most: those with the smallest hashes.
TRAIN_ROWS = 20_000
TREES, DEPTH, SEED = 20, 4, 7
#: A suffix seen in n labelled URLs has the weight n / (n + PRIOR) against the overall rate.
PRIOR = 5.0
NUMBERS = ["n_url", "n_host", "n_path", "n_query", "host_depth", "path_depth", "n_params", "digits", "digit_share", "hyphens",
           "entropy", "has_fragment", "has_port", "is_https", "longest_label"]
FEATURES = NUMBERS + ["suffix1_rate", "suffix2_rate"]

Rule = tuple[str, str, str]


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased. NULL, or no ``://``: empty."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end. NULL, or no ``://``: empty."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def rule_name(rule: Rule) -> str:
    return rule[0] + rule[1]


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, or NULLs. A rule fits its host and all subdomains, by prefix of the path."""
    name = verdict = None
    for rule in sorted(rules, key=lambda r: (-len(rule_name(r)), rule_name(r))):
        fits = ((host == rule[0]) | host.endswith("." + rule[0])) & path.startswith(rule[1])
        name = F.when(fits, F.lit(rule_name(rule))) if name is None else name.when(fits, F.lit(rule_name(rule)))
        verdict = F.when(fits, F.lit(rule[2])) if verdict is None else verdict.when(fits, F.lit(rule[2]))
    return (name, verdict) if rules else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def features(df: DataFrame, keys: list[str], url: str) -> DataFrame:
    """The key columns, ``url``, host, path, two suffixes of the host, and one column for each of ``NUMBERS``."""
    text = F.coalesce(F.col(url), F.lit(""))
    slim = df.select(*keys, text.alias("url"), host_of(text).alias("host"), path_of(text).alias("path"))
    u, labels = F.col("url"), F.split("host", r"\.")
    query = F.regexp_extract("url", r"\?([^#]*)", 1)
    size = F.greatest(F.length(u), F.lit(1)).cast("double")
    digits = F.length(u) - F.length(F.translate(u, "0123456789", ""))
    shares = F.transform(F.array_distinct(F.split(u, "")), lambda c: (F.length(u) - F.length(F.replace(u, c, F.lit("")))) / size)
    values = {
        "n_url": F.length(u), "n_host": F.length("host"), "n_path": F.length("path"), "n_query": F.length(query),
        "host_depth": F.size(labels), "path_depth": F.length("path") - F.length(F.translate("path", "/", "")),
        "n_params": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))), "digits": digits, "digit_share": digits / size,
        "hyphens": F.length(u) - F.length(F.translate(u, "-", "")),
        "entropy": F.aggregate(shares, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log(p)).otherwise(0.0)),
        "has_fragment": F.contains(u, F.lit("#")), "has_port": F.col("host").rlike(r":\d+$"), "is_https": u.startswith("https:"),
        "longest_label": F.array_max(F.transform(labels, F.length)),
    }
    return slim.select(*keys, "url", "host", "path", F.element_at(labels, -1).alias("suffix1"),
                       F.substring_index("host", ".", -2).alias("suffix2"), *(values[n].cast("double").alias(n) for n in NUMBERS))


@dataclass
class UrlFilter:
    """Trees and suffix statistics. ``model`` is None where the labelled URLs held one verdict or none."""

    model: GBTClassificationModel | None
    suffixes: DataFrame | None
    rate: float

    def judge(self, df: DataFrame, keys: list[str], url: str) -> DataFrame:
        """The key columns, host, path and ``p_block``, for every row. A NULL URL is judged as an empty one."""
        rows = features(df, keys, url)
        if self.model is None:
            return rows.select(*keys, "host", "path", F.lit(self.rate).alias("p_block"))
        scored = self.model.transform(_assemble(_with_rates(rows, self.suffixes, self.rate)))
        return scored.select(*keys, "host", "path", F.get(vector_to_array("probability"), F.lit(1)).alias("p_block"))


def _with_rates(rows: DataFrame, suffixes: DataFrame, rate: float) -> DataFrame:
    for k in (1, 2):  # at most TRAIN_ROWS suffixes each
        own = suffixes.filter(F.col("level") == k).select(F.col("suffix").alias(f"suffix{k}"), F.col("block_rate").alias(f"suffix{k}_rate"))
        rows = rows.join(F.broadcast(own), f"suffix{k}", "left").fillna({f"suffix{k}_rate": rate})
    return rows


def _assemble(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)


def fit(labelled: DataFrame, url: str, verdict: str, rows: int = TRAIN_ROWS) -> UrlFilter:
    """Train on labelled URLs, verdict ``allow`` or ``block`` (others are not looked at).

    At most ``rows`` distinct URLs are used, those with the smallest hashes, so the choice does not depend on partitions.
    """
    known = labelled.filter(F.col(verdict).isin("allow", "block")).groupBy(F.col(url).alias("url")).agg(
        F.max((F.col(verdict) == "block").cast("double")).alias("label"))
    sample, _ = store(features(known.orderBy(F.xxhash64("url"), "url").limit(rows), ["label"], "url"), "url-sample")
    seen = sample.agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("rate")).first()
    rate = float(seen["rate"] or 0.0)
    if not seen["n"] or rate in (0.0, 1.0):
        return UrlFilter(None, None, rate)
    both = sample.select("label", F.explode(F.array(
        F.struct(F.lit(1).alias("level"), F.col("suffix1").alias("suffix")), F.struct(F.lit(2).alias("level"), F.col("suffix2").alias("suffix")))).alias("s"))
    suffixes, _ = store(both.groupBy("s.level", "s.suffix").agg(
        ((F.sum("label") + PRIOR * rate) / (F.count(F.lit(1)) + PRIOR)).alias("block_rate")), "url-suffixes")
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=SEED, labelCol="label")
    return UrlFilter(trees.fit(_assemble(_with_rates(sample, suffixes, rate)).select("label", "features")), suffixes, rate)
