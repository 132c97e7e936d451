"""Keyed merges, replacements and deletes on plain Parquet tables.

Each function returns the new content of a table, or of those of its partitions that a payload touches, as a DataFrame;
``operators.stored`` puts it in place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitpanel.schemas import PREDICTION_SOURCE


def _same(a: str, b: str, key: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in key])


def _check_columns(target: DataFrame, payload: DataFrame, key: list[str]) -> None:
    unknown = sorted(set(payload.columns) - set(target.columns))
    if unknown:
        raise ValueError(f"unknown columns {unknown}; known are {target.columns}")
    missing = sorted(set(key) - set(payload.columns))
    if missing:
        raise ValueError(f"the payload lacks key columns {missing}")


def last_per_key(payload: DataFrame, key: list[str], order: str | None) -> DataFrame:
    """One payload row per key: the last along ``order``; without an order, a repeated key fails the job."""
    rest = [c for c in payload.columns if c not in key and c != order]
    row = F.struct(*rest, F.lit(1).alias("__some"))
    if order is not None:
        picked = payload.groupBy(*key).agg(F.max_by(row, F.col(order)).alias("__row"), F.max(order).alias(order))
        return picked.select(*key, order, *[F.col(f"__row.{c}").alias(c) for c in rest])
    once = payload.groupBy(*key).agg(F.first(row).alias("__row"), F.count("*").alias("__n"))
    repeated = F.raise_error(F.concat(F.lit("repeated payload key "), F.to_json(F.struct(*key)))).cast("boolean")
    return once.where(F.when(F.col("__n") > 1, repeated).otherwise(F.lit(True))).select(*key, *[F.col(f"__row.{c}").alias(c) for c in rest])


def merge_update(target: DataFrame, payload: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """Upsert. A column the payload lacks keeps its value; an explicit NULL overwrites.

    The key is unique in the target. Of payload rows that share a key the last along ``order`` counts; without an order
    they fail the job. ``order`` itself is stored only if the target has such a column.
    """
    stored = order is None or order in target.columns
    payload = last_per_key(payload, key, order)
    payload = payload if stored else payload.drop(order)
    _check_columns(target, payload, key)
    t = target.withColumn("__t", F.lit(1)).alias("t")
    p = payload.withColumn("__p", F.lit(1)).alias("p")
    joined = t.join(p, _same("t", "p", key), "full_outer")
    new = F.col("__p").isNotNull()
    return joined.select(*[
        F.when(new, F.col(f"p.{c}")).otherwise(F.col(f"t.{c}")).alias(c) if c in payload.columns else F.col(f"t.{c}")
        for c in target.columns])


def merge_insert_only(target: DataFrame, payload: DataFrame, key: list[str]) -> DataFrame:
    """Add rows with new keys; existing rows stay untouched."""
    _check_columns(target, payload, key)
    fresh = payload.alias("p").join(target.alias("t"), _same("p", "t", key), "left_anti")
    return target.unionByName(fresh, allowMissingColumns=True)


def replace_by_key(target: DataFrame, payload: DataFrame, key: str = "symbol") -> DataFrame:
    """Drop every row of the payload's key values, then add the payload."""
    keys = payload.select(key).distinct()
    return target.join(keys, key, "left_anti").select(*target.columns).unionByName(payload, allowMissingColumns=True)


def dedupe_first(df: DataFrame, key: list[str], position: str) -> DataFrame:
    """First row per key by source position; NULL key parts count as equal. An aggregate, so hot keys shrink early."""
    rest = [c for c in df.columns if c not in key]
    picked = df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.col(position)).alias("__pick"))
    return picked.select(*key, "__pick.*").select(*df.columns)


def delete_where(target: DataFrame, condition: Column) -> DataFrame:
    """Keep rows for which the condition is false or unknown."""
    return target.where(~F.coalesce(condition, F.lit(False)))


def delete_sessions(tables: dict[str, DataFrame], doomed: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Remove the runs of some sessions and everything that hangs off them, children first.

    ``tables``: model_runs, model_metrics, predictions, explanations, backtest_results (any subset);
    ``doomed``: (session). Returns the remaining tables and (table, deleted).
    """
    runs = tables["model_runs"]
    gone = runs.withColumn("session", F.split("run_id", "_").getItem(0)).join(doomed, "session", "left_semi").select("run_id")
    left, counts = {}, []
    parents = {"run_id": gone}
    if "predictions" in tables:
        parents["prediction_id"] = tables["predictions"].join(gone, "run_id", "left_semi").select("prediction_id")
    for name in ("explanations", "predictions", "model_metrics", "backtest_results", "model_runs"):
        if name not in tables:
            continue
        df, key = tables[name], "prediction_id" if name == "explanations" else "run_id"
        left[name] = df.join(parents[key], key, "left_anti").select(*df.columns)
        counts.append(df.join(parents[key], key, "left_semi").agg(
            F.lit(name).alias("table"), F.count("*").alias("deleted")).select("table", "deleted"))
    return left, reduce(DataFrame.unionByName, counts)


def update_status(ledger: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Apply (filing_id, status, ...) to the ledger; only supplied columns change.

    A status of ``downloaded`` stamps fetched_at.
    """
    merged = merge_update(ledger, changes, ["filing_id"]) if "filing_id" in changes.columns else ledger
    touched = changes.where(F.col("status") == "downloaded").select("filing_id", F.lit(True).alias("__hit")).distinct()
    stamped = merged.join(touched, "filing_id", "left")
    return stamped.withColumn(
        "fetched_at", F.when(F.col("__hit"), now).otherwise(F.col("fetched_at"))).select(*ledger.columns)


def set_flag_in_list(df: DataFrame, keys: DataFrame, column: str, value: int, key: str = "symbol") -> DataFrame:
    """Set a flag for the listed keys and leave the others alone. Spark picks the join by the list's size."""
    hit = keys.select(key).distinct().withColumn("__hit", F.lit(True))
    return df.join(hit, key, "left").withColumn(
        column, F.when(F.col("__hit"), F.lit(value)).otherwise(F.col(column))).select(*df.columns)


def set_single_active(runs: DataFrame, run_id: str) -> DataFrame:
    """Exactly one active run; an unknown id is refused when the result is evaluated."""
    found = runs.agg(F.max((F.col("run_id") == run_id).cast("int")).alias("__found"))
    guard = F.when(F.col("__found") == 1, (F.col("run_id") == run_id).cast("int")).otherwise(
        F.raise_error(F.lit(f"unknown run {run_id}")).cast("int"))
    flagged = runs.withColumn("__one", F.lit(1)).join(F.broadcast(found.withColumn("__one", F.lit(1))), "__one")
    return flagged.withColumn("is_active", guard).select(*runs.columns)


def prepare_predictions(rows: DataFrame, now: Column) -> DataFrame:
    """Fill defaults and refuse a bad source or probability when the rows are written."""
    out = rows
    for name, default in (("source", F.lit("backtest")), ("created_at", now), ("risk_decile", F.lit(None).cast("int"))):
        if name not in out.columns:
            out = out.withColumn(name, default)
    ok = F.col("source").isin(*PREDICTION_SOURCE) & F.col("probability").between(0.0, 1.0)
    bad = F.raise_error(F.concat(F.lit("bad prediction: "), F.to_json(F.struct("run_id", "source", "probability"))))
    return out.withColumn("probability", F.when(ok, F.col("probability")).otherwise(bad.cast("double")))


def metrics_long(wide: DataFrame, names: list[str]) -> DataFrame:
    """(run_id, fold, metric_name, metric_value) rows; NULL metrics are not stored."""
    typed = wide.select("run_id", "fold", *[F.col(n).cast("double").alias(n) for n in names])
    return typed.unpivot(["run_id", "fold"], names, "metric_name", "metric_value").where(
        F.col("metric_value").isNotNull())


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
