"""Typed scans of the twelve tables, with filters that reach the Parquet reader."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitpanel.schemas import TABLES
from pitpanel.settings import KEY_COLUMNS, LABEL_COLUMNS


def scan_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One table with its declared schema; a table never written reads as empty, columns and all."""
    schema = TABLES[name]
    try:
        return spark.read.schema(schema).parquet(f"{root.rstrip('/')}/{name}")
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        return spark.createDataFrame([], schema)


def filtered(df: DataFrame, order: list | None = None, **equal) -> DataFrame:
    """Equality filters; ``None`` means no filter on that column."""
    for column, value in equal.items():
        if value is not None:
            df = df.where(F.col(column) == F.lit(value))
    return df.orderBy(*order) if order else df


def by_symbols_and_dates(df: DataFrame, date: str, symbols: list | None = None, start=None, end=None,
                         key: str = "symbol") -> DataFrame:
    """Symbol list and inclusive date range, both pushed to the reader, in (symbol, date) order."""
    if symbols is not None:
        df = df.where(F.col(key).isin(*symbols)) if symbols else df.where(F.lit(False))
    if start is not None:
        df = df.where(F.col(date) >= F.lit(start))
    if end is not None:
        df = df.where(F.col(date) <= F.lit(end))
    return df.orderBy(*([key] if key in df.columns else []), date)


def distinct_dates(df: DataFrame, date: str, valid_only: bool = False) -> DataFrame:
    if valid_only:
        df = df.where(F.col("label_is_valid") == 1)
    return df.select(date).distinct().orderBy(date)


def predictions_page(predictions: DataFrame, limit: int | None = None, offset: int = 0, **equal) -> DataFrame:
    """Newest date first, then highest probability; symbol and id settle ties."""
    page = filtered(predictions, [F.desc("observation_date"), F.desc("probability"), F.col("symbol"),
                                  F.col("prediction_id")], **equal)
    page = page.offset(offset) if offset else page
    return page if limit is None else page.limit(limit)


def page_with_total(predictions: DataFrame, limit: int = 50, offset: int = 0, **equal) -> DataFrame:
    """A page and, on each row, the total under the very same filters. Past the last page: one row with the total alone."""
    total = filtered(predictions, **equal).agg(F.count("*").alias("total")).withColumn("__one", F.lit(1))
    page = predictions_page(predictions, limit, offset, **equal).withColumn("__one", F.lit(1))
    return total.join(page, "__one", "left").select(*predictions.columns, "total")


def panel_for(panel: DataFrame, features: list[str] | None = None, valid_only: bool = True) -> DataFrame:
    """Labelled rows only, projected to one experiment's features; keys, labels and flags always stay."""
    if valid_only:
        panel = panel.where(F.col("label_is_valid") == 1)
    if features is None:
        return panel
    missing = [f for f in features if f not in panel.columns]
    if missing:
        raise ValueError(f"the panel lacks {missing}")
    return panel.select(*KEY_COLUMNS, *features, "is_stale", *LABEL_COLUMNS)
