"""Landed raw files: company lists, charts, filing lists, disclosures, and the ledger of raw files.

JSON sources hold one document per line; ``multi_line=True`` reads one document per file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitpanel.functions import scalars as fx

# Layouts of the landed documents.
CSV_HEADER = "`Company Name` string, Industry string, Symbol string, Series string, `ISIN Code` string"
UNIVERSE_HEADER = "symbol string, company_name string, isin string, industry string"
INDEX_JSON = """data array<struct<symbol: string, industry: string,
    meta: struct<companyName: string, isin: string>>>"""
CHART_JSON = """chart struct<error: string, result: array<struct<
    meta: struct<symbol: string>, timestamp: array<bigint>,
    indicators: struct<adjclose: array<struct<adjclose: array<double>>>, quote: array<struct<volume: array<double>>>>>>>"""
FILING_LIST_JSON = "symbol string, data array<struct<date: string, submissionDate: string, xbrl: string>>"
DISCLOSURE_JSON = """symbol string, data array<struct<sr_dateof_creation: string, broadcastDateTime: string,
    promoterName: string, typeOfEvent: string, numofShares: string, perofShares: string,
    nameOfLenderDebenture: string, reasonForEncumbrance: string>>"""


def _json(spark: SparkSession, path: str, schema: str, multi_line: bool) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def _company(symbol: Column, name: Column, isin: Column, industry: Column) -> list[Column]:
    def text(c: Column) -> Column:
        return F.nullif(F.trim(c), F.lit(""))

    return [text(symbol).alias("symbol"), text(name).alias("company_name"), text(isin).alias("isin"),
            text(industry).alias("industry")]


def universe_csv(spark: SparkSession, path: str) -> DataFrame:
    """Published constituent CSV; rows without symbol or name are dropped."""
    raw = spark.read.schema(CSV_HEADER).option("header", True).option("escape", '"').csv(path)
    rows = raw.select(*_company(F.col("Symbol"), F.col("Company Name"), F.col("ISIN Code"), F.col("Industry")))
    return rows.where(F.col("symbol").isNotNull() & F.col("company_name").isNotNull())


def stored_universe_csv(spark: SparkSession, path: str) -> DataFrame:
    """The universe list written by ``sinks.write_universe_csv``."""
    raw = spark.read.schema(UNIVERSE_HEADER).option("header", True).option("escape", '"').csv(path)
    return raw.select(*_company(*[F.col(c) for c in ("symbol", "company_name", "isin", "industry")]))


def index_json(spark: SparkSession, path: str, index_name: str, multi_line: bool = False) -> DataFrame:
    """Nested index document to company rows; the index's own row is skipped."""
    item = _json(spark, path, INDEX_JSON, multi_line).select(F.explode("data").alias("d"))
    rows = item.select(*_company(F.col("d.symbol"), F.col("d.meta.companyName"), F.col("d.meta.isin"), F.col("d.industry")))
    keep = F.col("symbol").isNotNull() & F.col("company_name").isNotNull() & (F.col("symbol") != index_name)
    return rows.where(keep)


def first_non_empty(*candidates: DataFrame) -> DataFrame:
    """The first source with a row; an error when none has one. Each test reads at most one row."""
    for df in candidates:
        if not df.isEmpty():
            return df
    raise ValueError("every source is empty")


def chart_json(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Parallel arrays to bars (symbol, trade_date, adj_close, volume).

    A document without adjusted closes fails the read: raw closes are no substitute. Missing and
    non-positive closes go; of several bars on one date the first stays.
    """
    doc = _json(spark, path, CHART_JSON, multi_line).select(
        F.get("chart.result", 0).alias("r"), F.col("chart.error").alias("error"))
    symbol = F.col("r.meta.symbol")
    closes = F.get("r.indicators.adjclose", 0)["adjclose"]
    failed = F.raise_error(F.concat(F.coalesce(symbol, F.lit("?")), F.lit(": no adjusted closes"),
                                    F.coalesce(F.concat(F.lit(", "), "error"), F.lit(""))))
    bars = F.when(closes.isNotNull(), F.arrays_zip(
        F.col("r.timestamp").alias("at"), closes.alias("close"),
        F.get("r.indicators.quote", 0)["volume"].alias("volume"))).otherwise(
        failed.cast("array<struct<at: bigint, close: double, volume: double>>"))
    rows = doc.select(symbol.alias("symbol"), F.posexplode(bars).alias("at_pos", "bar")).select(
        "symbol", "at_pos", F.timestamp_seconds("bar.at").cast("date").alias("trade_date"),
        fx.known(F.col("bar.close")).alias("adj_close"), F.col("bar.volume").alias("volume"))
    kept = rows.where(F.col("adj_close") > 0)
    return kept.groupBy("symbol", "trade_date").agg(
        F.min_by(F.struct("adj_close", "volume"), "at_pos").alias("__pick")).select("symbol", "trade_date", "__pick.*")


def filing_list_json(spark: SparkSession, path: str, quarters: Column, multi_line: bool = False) -> DataFrame:
    """Filing lists to ledger rows: a real XML address, a real submission date, a standard quarter in the window."""
    item = _json(spark, path, FILING_LIST_JSON, multi_line).select("symbol", F.explode("data").alias("d"))
    rows = item.select(
        "symbol", fx.parse_date(F.col("d.date")).alias("quarter_end"),
        fx.parse_date(F.col("d.submissionDate")).alias("submission_date"),
        F.trim("d.xbrl").alias("xbrl_url"), F.lit("pending").alias("status"))
    return rows.where(
        F.lower("xbrl_url").endswith(".xml") & F.col("submission_date").isNotNull()
        & F.array_contains(quarters, F.col("quarter_end")))


def disclosures_json(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Disclosures to event rows, with their position in the document; undated ones are skipped."""
    item = _json(spark, path, DISCLOSURE_JSON, multi_line).select("symbol", F.posexplode("data").alias("position", "d"))
    rows = item.select(
        "symbol", "position",
        F.coalesce(fx.parse_date(F.col("d.sr_dateof_creation")), fx.parse_date(F.col("d.broadcastDateTime"))).alias("event_date"),
        fx.clean_text(F.col("d.promoterName")).alias("promoter_name"),
        fx.normalise_event(F.col("d.typeOfEvent")).alias("event_type"),
        fx.clean_number(F.col("d.numofShares")).alias("shares"),
        fx.clean_number(F.col("d.perofShares")).alias("pct_equity"),
        fx.clean_text(F.col("d.nameOfLenderDebenture")).alias("lender"),
        fx.clean_text(F.col("d.reasonForEncumbrance")).alias("reason"))
    return rows.where(F.col("event_date").isNotNull())


def raw_ledger(spark: SparkSession, path: str, ledger: DataFrame | None = None, glob: str = "*") -> DataFrame:
    """(local_path, sha256, size_bytes) of landed files the ledger does not know yet."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    rows = files.select(F.col("path").alias("local_path"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes"))
    return rows if ledger is None else rows.join(ledger.select("local_path"), "local_path", "left_anti")


def write_universe_csv(companies: DataFrame, path: str) -> None:
    """One CSV sorted by symbol, for a stable diff. A company list is small by nature."""
    columns = ["symbol", "company_name", "isin", "industry"]
    companies.select(*columns).coalesce(1).sortWithinPartitions("symbol").write.option("header", True).option("escape", '"').csv(path)


def write_quarantine(rejected: DataFrame, path: str) -> None:
    """Rejected inputs with a reason; the originals stay where they are."""
    rejected.select("local_path", "reason").write.mode("append").parquet(path)
