"""Feature vectors as maps and arrays: required keys, domain checks, run columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitpanel.plans.quality import FEATURE_BOUNDS


def missing_keys(vector: Column, required: list[str]) -> Column:
    """Required names the map lacks, in order."""
    return F.array_except(F.array(*[F.lit(n) for n in required]), F.map_keys(vector))


def short_number(value: Column) -> Column:
    """Up to six significant digits without trailing zeros, for numbers of everyday size."""
    rounded = F.round(value, 6)
    whole = rounded == F.floor(rounded)
    return F.when(whole, rounded.cast("bigint").cast("string")).otherwise(rounded.cast("string"))


def domain_violations(vector: Column, bounds: dict[str, tuple[float | None, float | None]] | None = None) -> Column:
    """Readable strings for values outside their domain; unknown keys and NULL pass."""
    found = []
    for name, (low, high) in (FEATURE_BOUNDS if bounds is None else bounds).items():
        value = F.try_element_at(vector, F.lit(name))
        if low is not None:
            found.append(F.when(value < low, F.concat(
                F.lit(f"{name}="), short_number(value), F.lit(f" is below the minimum {low:g}"))))
        if high is not None:
            found.append(F.when(value > high, F.concat(
                F.lit(f"{name}="), short_number(value), F.lit(f" is above the maximum {high:g}"))))
    return F.array_compact(F.array(*found))


def assemble(df: DataFrame, features: list[str], out: str = "features") -> DataFrame:
    """Ordered numeric vector; a missing column is an error, never a silent NULL."""
    from pyspark.ml.feature import VectorAssembler

    absent = [f for f in features if f not in df.columns]
    if absent:
        raise ValueError(f"feature columns {absent} are missing")
    return VectorAssembler(inputCols=features, outputCol=out, handleInvalid="error").transform(df)


def run_columns_to_json(runs: DataFrame) -> DataFrame:
    """feature_list and hyperparams as JSON text."""
    return runs.withColumn("feature_list", F.to_json("feature_list")).withColumn("hyperparams", F.to_json("hyperparams"))


def run_columns_from_json(runs: DataFrame) -> DataFrame:
    return runs.withColumn("feature_list", F.from_json("feature_list", "array<string>")).withColumn(
        "hyperparams", F.from_json("hyperparams", "map<string,string>"))


def model_info(runs: DataFrame, metrics: DataFrame) -> DataFrame:
    """Each run with its aggregate metrics (fold -1) as one map."""
    folded = metrics.where(F.col("fold") == -1).groupBy("run_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric_name", "metric_value")))).alias("metrics"))
    return runs.join(folded, "run_id", "left")
