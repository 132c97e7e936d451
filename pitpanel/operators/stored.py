"""Tables on shared storage that change: partition by partition, or version by version behind a pointer.

``PartitionedTable`` is for changes that touch few rows. The payload says which partitions it can touch; only those are read, merged and
written, with Spark's dynamic partition overwrite, and all other files stay as they are. Each partition changes at once; several do one after another.

``VersionedTable`` is for tables that are replaced whole. A version is a folder that never changes once it is written; one small file names the
current one and is replaced by an atomic rename. A reader pins the version it has seen, and a write that dies before the rename changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitpanel.operators import merge


def _file_system(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


@dataclass(frozen=True)
class PartitionedTable:
    """Parquet files under ``path``, partitioned by expressions over columns that identify a row's key.

    ``by`` maps each partition column to its SQL expression, so a payload with key columns alone says which partitions it can touch. Partition
    columns are few-valued (months, buckets of a hash); their touched values are the only thing collected.
    """

    path: str
    by: dict[str, str] = field(hash=False)

    def create(self, df: DataFrame) -> None:
        """Write all rows; fails if there is a table already. Partitions that are too large for a task are split over several."""
        self._write(self._placed(df), "errorifexists")

    def read(self, spark: SparkSession) -> DataFrame:
        """All rows, with the partition columns at the end so that filters on them prune files."""
        return spark.read.parquet(self.path)

    def rows(self, spark: SparkSession) -> DataFrame:
        """All rows as they were written."""
        return self.read(spark).drop(*self.by)

    def touched(self, payload: DataFrame) -> list[Row]:
        """Partition values of the payload's keys: at most as many as there are partitions."""
        return self._placed(payload).select(*self.by).distinct().collect()

    def rewrite(self, spark: SparkSession, touched: list[Row], change: Callable[[DataFrame], DataFrame]) -> None:
        """Replace the rows of the touched partitions by ``change`` of them.

        A changed row that belongs to another partition fails the job. Partitions left without rows go.
        """
        if not touched:
            return
        old = self.read(spark).where(self._among(touched))
        before = [r.file_path for r in old.select("_metadata.file_path").distinct().collect()]
        changed = self._placed(change(old.drop(*self.by)))
        astray = F.raise_error(F.concat(F.lit("row outside the touched partitions: "), F.to_json(F.struct(*self.by)))).cast("boolean")
        self._write(changed.where(F.when(self._among(touched), F.lit(True)).otherwise(astray)), "overwrite")
        for file in before:  # partitions that got new rows have lost their old files
            path, fs = _file_system(spark, file)
            if fs.exists(path):
                fs.delete(path.getParent(), True)
        spark.catalog.refreshByPath(self.path)

    def upsert(self, spark: SparkSession, payload: DataFrame, key: list[str], order: str | None = None) -> None:
        """``merge.merge_update`` within the partitions of the payload's keys."""
        self.rewrite(spark, self.touched(payload), lambda old: merge.merge_update(old, payload, key, order))

    def insert_new(self, spark: SparkSession, payload: DataFrame, key: list[str]) -> None:
        """``merge.merge_insert_only`` within the partitions of the payload's keys."""
        self.rewrite(spark, self.touched(payload), lambda old: merge.merge_insert_only(old, payload, key))

    def replace(self, spark: SparkSession, payload: DataFrame, key: str) -> None:
        """``merge.replace_by_key`` within the partitions of the payload's keys."""
        self.rewrite(spark, self.touched(payload), lambda old: merge.replace_by_key(old, payload, key))

    def delete(self, spark: SparkSession, scope: DataFrame, doomed: Callable[[DataFrame], DataFrame]) -> None:
        """Keep what ``doomed`` leaves of the partitions that the rows of ``scope`` lie in."""
        self.rewrite(spark, self.touched(scope), doomed)

    def _placed(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.expr(e) for c, e in self.by.items()})

    def _among(self, touched: list[Row]) -> Column:
        if len(self.by) == 1:  # one IN list, which prunes partitions whatever their number
            (name,) = self.by
            values = [r[name] for r in touched if r[name] is not None]
            some = F.col(name).isin(values) if values else F.lit(False)
            return F.coalesce(some, F.lit(False)) | F.col(name).isNull() if len(values) < len(touched) else F.coalesce(some, F.lit(False))
        return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(r[c])) for c in self.by]) for r in touched])

    def _write(self, placed: DataFrame, mode: str) -> None:
        dealt = placed.hint("rebalance", *self.by)
        dealt.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*self.by).parquet(self.path)


@dataclass(frozen=True)
class VersionedTable:
    """Folders of versions under ``path`` and a pointer file that names the current one."""

    path: str
    format: str = "parquet"

    @property
    def pointer(self) -> str:
        return f"{self.path}/_current"

    def current(self, spark: SparkSession) -> str | None:
        """The folder of the current version; None before the first."""
        path, fs = _file_system(spark, self.pointer)
        try:
            stream = fs.open(path)
        except Py4JJavaError as exc:
            if "FileNotFound" in str(exc.java_exception):
                return None
            raise
        try:
            return f"{self.path}/{spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, 'UTF-8')}"
        finally:
            stream.close()

    def write(self, df: DataFrame, partition_by: list[str] | None = None) -> str:
        """A new version with these rows, current once they are all written. ``df`` may read the version it follows."""
        spark = df.sparkSession
        folder = self.stage(df, partition_by)
        self.publish(spark, folder)
        return folder

    def stage(self, df: DataFrame, partition_by: list[str] | None = None) -> str:
        """The rows in a folder of their own, which no reader looks for."""
        last = self.current(df.sparkSession)
        number = 1 + int(last.rsplit("/", 1)[1].split("-")[0][1:]) if last else 1
        folder = f"{self.path}/v{number:08d}-{uuid.uuid4().hex}"
        writer = df.write.format(self.format)
        (writer.partitionBy(*partition_by) if partition_by else writer).save(folder)
        return folder

    def publish(self, spark: SparkSession, folder: str) -> None:
        """Make a staged folder the current version: one rename over the pointer."""
        fresh, fs = _file_system(spark, f"{self.pointer}-{uuid.uuid4().hex}")
        stream = fs.create(fresh)
        stream.write(bytearray(folder.rsplit("/", 1)[1], "utf-8"))
        stream.close()
        jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        pointer, _ = _file_system(spark, self.pointer)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(fresh, pointer, how)

    def read(self, spark: SparkSession, schema: T.StructType | None = None, version: str | None = None) -> DataFrame:
        """The rows of one version, the current one unless named; with a schema, a table never written has no rows."""
        folder = version or self.current(spark)
        if folder is None:
            if schema is None:
                raise FileNotFoundError(f"no version of {self.path}")
            return spark.createDataFrame([], schema)
        reader = spark.read.format(self.format)
        return (reader.schema(schema) if schema else reader).load(folder)

    def expire(self, spark: SparkSession, keep: int = 2) -> list[str]:
        """Delete all but the newest ``keep`` version numbers up to the current one, staged leftovers with older numbers included; what went."""
        last = self.current(spark)
        if last is None:
            return []
        number = int(last.rsplit("/", 1)[1].split("-")[0][1:])
        root, fs = _file_system(spark, self.path)
        gone = []
        for status in fs.listStatus(root):
            name = status.getPath().getName()
            if name.startswith("v") and int(name.split("-")[0][1:]) <= number - keep:
                fs.delete(status.getPath(), True)
                gone.append(name)
        return gone
