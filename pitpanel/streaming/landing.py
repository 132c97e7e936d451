"""Incremental parsing of landed filings with Structured Streaming.

The checkpoint replaces a hand-kept list of what was read. A run with ``availableNow`` takes what
has landed since the last one and stops. Each micro-batch goes through the batch functions and lands
under its own batch id, so a batch that is repeated after a failure overwrites itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pitpanel.plans.filings import state_from_facts
from pitpanel.session import ensure_checkpoint_dir
from pitpanel.sources.filings import shred_filing_facts

DOCUMENTS = "filing_id bigint, content binary"


def landed_documents(spark: SparkSession, path: str, fmt: str = "parquet", files_per_batch: int = 1000) -> DataFrame:
    """Streaming (doc_id, content). ``binaryFile`` reads raw files, with their path as id."""
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_batch)
    if fmt == "binaryFile":
        return reader.format("binaryFile").option("recursiveFileLookup", True).schema(
            "path string, modificationTime timestamp, length bigint, content binary").load(path).select(
            F.col("path").alias("doc_id"), "content")
    return reader.schema(DOCUMENTS).format(fmt).load(path).select(F.col("filing_id").cast("string").alias("doc_id"), "content")


def land_filings(spark: SparkSession, source: str, target: str, checkpoint: str, fmt: str = "parquet",
                 files_per_batch: int = 1000) -> StreamingQuery:
    """Parse everything new under ``source`` into ``target`` (state rows and, apart, rejected ones)."""
    ensure_checkpoint_dir(spark)

    def write(batch: DataFrame, batch_id: int) -> None:
        parsed = state_from_facts(shred_filing_facts(batch))
        parsed.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    return (
        landed_documents(spark, source, fmt, files_per_batch).writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def landed_state(spark: SparkSession, target: str) -> tuple[DataFrame, DataFrame]:
    """(usable, rejected) rows of all batches; a document that landed twice keeps its latest batch."""
    rows = spark.read.parquet(target)
    rest = [c for c in rows.columns if c != "doc_id"]
    latest = rows.groupBy("doc_id").agg(F.max_by(F.struct(*rest), "batch_id").alias("__pick")).select("doc_id", "__pick.*")
    good = F.col("reason").isNull()
    return latest.where(good), latest.where(~good)
