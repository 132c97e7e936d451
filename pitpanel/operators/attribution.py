"""Per-row contributions of features to a score, and their summaries.

Long records are (keys, feature_name, feature_value, shap_value).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitpanel.functions.text import base_name, sentence, sentence_head
from pitpanel.session import materialise


def linear_contributions(rows: DataFrame, background: DataFrame, coefficients: dict[str, float], keys: list[str],
                         prefix: str = "") -> DataFrame:
    """coef x (x - mean of the background), exactly. The background is the population, never the row itself."""
    names = list(coefficients)
    means = background.agg(*[F.avg(prefix + n).alias(f"__m_{n}") for n in names]).withColumn("__one", F.lit(1))
    joined = rows.withColumn("__one", F.lit(1)).join(F.broadcast(means), "__one")
    parts = F.explode(F.array(*[
        F.struct(F.lit(n).alias("feature_name"),
                 (F.lit(coefficients[n]) * (F.col(prefix + n) - F.col(f"__m_{n}"))).alias("shap_value")) for n in names]))
    return joined.select(*keys, parts.alias("__c")).select(*keys, "__c.*")


def importance(records: DataFrame) -> DataFrame:
    """(feature, mean_abs_shap, mean_shap, share): one row per feature."""
    means = records.groupBy(F.col("feature_name").alias("feature")).agg(
        F.avg(F.abs("shap_value")).alias("mean_abs_shap"), F.avg("shap_value").alias("mean_shap"))
    total = F.sum("mean_abs_shap").over(Window.partitionBy(F.lit(0)))
    return means.withColumn("share", F.col("mean_abs_shap") / F.nullif(total, F.lit(0.0)))


def confound_audit(importance: DataFrame, block: list[str]) -> DataFrame:
    """Share of a block of features, the top features, and the block's best rank. Input: one row per feature."""
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("mean_abs_shap"), "feature")
    ranked = importance.withColumn("rank", F.row_number().over(order))
    inside = F.col("feature").isin(*block)
    share = F.coalesce(F.sum(F.when(inside, F.col("share"))), F.lit(0.0))
    return ranked.agg(
        share.alias("block_share"), (1 - share).alias("other_share"), F.min_by("feature", "rank").alias("top_feature"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("rank") <= 3, F.struct("rank", "feature")))),
                                 lambda x: x["feature"]), ",").alias("top_3"),
        F.min(F.when(inside, F.col("rank"))).alias("best_block_rank"))


def ranked_records(records: DataFrame, keys: list[str], top_n: int | None = None) -> DataFrame:
    """Add ``position`` by falling size; names settle ties. A row has as many records as the model has features."""
    order = Window.partitionBy(*keys).orderBy(F.desc(F.abs("shap_value")), "feature_name")
    out = records.withColumn("position", F.row_number().over(order))
    return out if top_n is None else out.where(F.col("position") <= top_n)


def merge_indicators(records: DataFrame, keys: list[str]) -> DataFrame:
    """Fold ``X_missing`` into ``X``: one fact, one contribution. The value comes from X.

    An indicator without its feature is dropped.
    """
    base = ~F.col("feature_name").endswith("_missing")
    out = records.groupBy(*keys, base_name(F.col("feature_name")).alias("__f")).agg(
        F.max(F.when(base, F.col("feature_value"))).alias("feature_value"), F.sum("shap_value").alias("shap_value"),
        F.max(base).alias("__base"))
    return out.where("__base").select(*keys, F.col("__f").alias("feature_name"), "feature_value", "shap_value")


def with_raw_values(records: DataFrame, panel: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """Join the panel's own values; indicator columns have none."""
    raw = panel.select(*keys, *[F.col(f).cast("double").alias(f) for f in features]).unpivot(
        keys, features, "feature_name", "feature_value")
    return records.join(raw, [*keys, "feature_name"], "left").select(*keys, "feature_name", "feature_value", "shap_value")


def sentences(records: DataFrame, scored: DataFrame, keys: list[str], top_n: int = 3) -> DataFrame:
    """(keys, summary): what raised and what lowered each score."""
    merged = merge_indicators(records, keys)
    item = F.struct(F.abs("shap_value").alias("size"), "feature_name", "feature_value", "shap_value")

    def top(when: Column) -> Column:
        ordered = F.array_sort(
            F.collect_list(F.when(when, item)),
            lambda a, b: F.when(a["size"] > b["size"], -1).when(a["size"] < b["size"], 1)
            .when(a["feature_name"] < b["feature_name"], -1).otherwise(1))
        return F.slice(ordered, 1, top_n)

    sides = merged.groupBy(*keys).agg(top(F.col("shap_value") > 0).alias("up"), top(F.col("shap_value") < 0).alias("down"))
    decile = F.col("risk_decile") if "risk_decile" in scored.columns else None
    band = F.col("risk_band") if "risk_band" in scored.columns else None
    head = sentence_head(F.col("probability"), decile, band)
    return scored.join(sides, keys).select(*keys, sentence(head, F.col("up"), F.col("down")).alias("summary"))


# Trees ---------------------------------------------------------------------------------------

def leaf_paths(spark, model_path: str) -> DataFrame:
    """Leaves of a stored boosted model or forest: (leaf, parts), parts = (feature, conds, share) per feature on the path.

    ``leaf`` is the tree's weight times the leaf's value, which sum to a boosted model's margin and to a forest's probability of
    class 1; ``share`` is the part of the training rows that follows the path at
    this feature's splits. The walk goes on until no inner node is left. The rows are the model's leaves, whatever the data's size.
    """
    nodes = spark.read.parquet(f"{model_path}/data").select("treeID", "nodeData.*")
    weights = spark.read.parquet(f"{model_path}/treesMetadata")
    tree, weight = weights.columns[0], weights.columns[-1]
    weights = weights.select(F.col(tree).alias("treeID"), F.col(weight).alias("weight"))
    if "RandomForestClassificationModel" in spark.read.text(f"{model_path}/metadata").first()[0]:
        classes = F.col("impurityStats")
        nodes = nodes.withColumn("prediction", F.get(classes, F.lit(1)) / F.aggregate(classes, F.lit(0.0), lambda a, b: a + b))
        weights = weights.withColumn("weight", F.col("weight") / F.sum("weight").over(Window.partitionBy(F.lit(0))))  # a row a tree
    step = "struct<feature: int, threshold: double, left: boolean, share: double>"
    paths = nodes.where(F.col("id") == 0).withColumn("steps", F.array().cast(f"array<{step}>"))
    below = nodes.select("treeID", *[F.col(c).alias(f"c_{c}") for c in nodes.columns if c != "treeID"])
    leaves = []
    while True:
        paths = materialise(paths, "tree-level")
        leaves.append(paths.where(F.col("leftChild") < 0).select("treeID", "prediction", "steps"))
        inner = paths.where(F.col("leftChild") >= 0)
        if inner.isEmpty():
            break
        joined = inner.join(below, "treeID").where(F.col("c_id").isin(F.col("leftChild"), F.col("rightChild")))
        taken = F.struct(
            F.col("split.featureIndex").cast("int").alias("feature"),
            F.get("split.leftCategoriesOrThreshold", 0).cast("double").alias("threshold"),
            (F.col("c_id") == F.col("leftChild")).alias("left"), (F.col("c_rawCount") / F.col("rawCount")).alias("share"))
        paths = joined.withColumn("steps", F.concat("steps", F.array(taken))).select(
            "treeID", "steps", *[F.col(f"c_{c}").alias(c) for c in nodes.columns if c != "treeID"])
    every = leaves[0]
    for more in leaves[1:]:
        every = every.unionByName(more)

    def part(f: Column) -> Column:
        mine = F.filter("steps", lambda s: s["feature"] == f)
        return F.struct(f.alias("feature"), mine.alias("conds"),
                        F.aggregate(mine, F.lit(1.0), lambda acc, s: acc * s["share"]).alias("share"))

    parts = F.transform(F.array_distinct(F.transform("steps", lambda s: s["feature"])), part)
    return every.join(F.broadcast(weights), "treeID").select(
        (F.col("prediction") * F.col("weight")).alias("leaf"), parts.alias("parts"))


def tree_contributions(rows: DataFrame, paths: DataFrame, names: list[str], keys: list[str],
                       values: str = "x") -> DataFrame:
    """Path-dependent Shapley values of the margin: (keys, feature_name, shap_value).

    Per leaf, a feature's part is leaf x (follows - share) x the weighted sum over the subsets of the
    path's other features, which is a small polynomial. ``values`` is the model's input as an array.
    All leaves travel as one broadcast row and are folded inside each row: nothing is exploded per leaf, nothing shuffled.
    """
    all_leaves = paths.agg(F.collect_list(F.struct("leaf", "parts")).alias("__leaves")).withColumn("__one", F.lit(1))
    beside = rows.select(*keys, values, F.lit(1).alias("__one")).join(F.broadcast(all_leaves), "__one")
    x = F.col(values)

    def follows(part: Column) -> Column:
        return F.struct(part["feature"].alias("feature"), part["share"].alias("share"), F.forall(
            part["conds"], lambda c: (F.get(x, c["feature"]) <= c["threshold"]) == c["left"]).cast("double").alias("follows"))

    def subsets(seen: Column, me: Column) -> Column:
        others = F.filter(seen, lambda o: o["feature"] != me["feature"])
        poly = F.aggregate(
            others, F.array(F.lit(1.0)),
            lambda acc, o: F.zip_with(
                F.concat(F.transform(acc, lambda v: v * o["share"]), F.array(F.lit(0.0))),
                F.concat(F.array(F.lit(0.0)), F.transform(acc, lambda v: v * o["follows"])), lambda a, b: a + b))
        m = F.size(seen)
        weighted = F.transform(poly, lambda v, k: v * F.factorial(k) * F.factorial(m - k - 1) / F.factorial(m))
        return F.aggregate(weighted, F.lit(0.0), lambda a, b: a + b)

    def effects(leaf: Column) -> Column:
        once = F.array(F.transform(leaf["parts"], follows))  # bound to ``seen`` once a leaf
        return F.get(F.transform(once, lambda seen: F.transform(seen, lambda me: F.struct(
            me["feature"].alias("feature"), (leaf["leaf"] * (me["follows"] - me["share"]) * subsets(seen, me)).alias("value")))), F.lit(0))

    def add(sums: Column, leaf: Column) -> Column:
        return F.aggregate(effects(leaf), sums, lambda acc, e: F.transform(
            acc, lambda v, i: v + F.when(i == e["feature"], e["value"]).otherwise(0.0)))

    totals = F.aggregate("__leaves", F.array_repeat(F.lit(0.0), len(names)), add)
    return beside.select(*keys, F.posexplode(totals).alias("__at", "shap_value")).select(
        *keys, F.get(F.array(*[F.lit(n) for n in names]), F.col("__at")).alias("feature_name"), "shap_value")


def tree_base_value(paths: DataFrame) -> DataFrame:
    """(base): the margin when nothing about a row is known."""
    share = F.aggregate("parts", F.lit(1.0), lambda acc, p: acc * p["share"])
    return paths.agg(F.sum(F.col("leaf") * share).alias("base"))
