"""Queries over landed files. Spark writes the files from the tables, so work grows with them."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitpanel.functions import scalars as fx
from pitpanel.operators import merge
from pitpanel.plans import filings as parse, report
from pitpanel.registered.base import piece, query, r
from pitpanel.registered.panels import panel, state, tidy
from pitpanel.registered.tables import ledger
from pitpanel.session import scratch_path
from pitpanel.sources import adapters as src, filings as xml, landed
from pitpanel.streaming import landing


def land(spark, df, name, fmt="json", **options):
    path = scratch_path(spark, name)
    df.write.format(fmt).options(**options).save(path)
    return path


def _company_rows(spark, sf):
    firms = src.companies(spark, sf)
    return firms.select(
        F.concat(F.lit("  "), F.col("company_name")).alias("Company Name"),
        F.when(F.col("in_universe") == 1, F.col("industry")).otherwise(" ").alias("Industry"),
        F.when(F.col("symbol") != 3, F.concat(F.lit("S"), F.col("symbol").cast("string"))).alias("Symbol"),
        F.lit("EQ").alias("Series"), F.lit(None).cast("string").alias("ISIN Code"))


piece("listed", """SELECT 'S' || CAST(symbol AS VARCHAR) AS symbol, company_name, CAST(NULL AS VARCHAR) AS isin,
CASE WHEN in_universe = 1 THEN industry END AS industry FROM companies WHERE symbol <> 3""", "companies")


@query("scan_universe_csv", "SELECT * FROM listed", "listed")
def scan_universe_csv(spark, sf):
    return landed.universe_csv(spark, land(spark, _company_rows(spark, sf), "csv", "csv", header=True, escape='"', ignoreLeadingWhiteSpace=False,
                                         ignoreTrailingWhiteSpace=False))


def _index_docs(spark, sf):
    rows = _company_rows(spark, sf)
    item = F.struct(F.col("Symbol").alias("symbol"), F.col("Industry").alias("industry"),
                    F.struct(F.col("`Company Name`").alias("companyName"), F.col("`ISIN Code`").alias("isin")).alias("meta"))
    own = F.struct(F.lit("INDEX").alias("symbol"), F.lit("").alias("industry"),
                   F.struct(F.lit("the index").alias("companyName"), F.lit(None).cast("string").alias("isin")).alias("meta"))
    return rows.select(F.array(item, own).alias("data"))


@query("scan_index_json", "SELECT * FROM listed", "listed")
def scan_index_json(spark, sf):
    return landed.index_json(spark, land(spark, _index_docs(spark, sf), "index"), "INDEX")


@query("scan_with_fallback", "SELECT * FROM listed", "listed")
def scan_with_fallback(spark, sf):
    empty = land(spark, _company_rows(spark, sf).where(F.lit(False)), "csv", "csv", header=True)
    return landed.first_non_empty(
        landed.universe_csv(spark, empty), landed.index_json(spark, land(spark, _index_docs(spark, sf), "index"), "INDEX"))


@query("sink_csv_sorted", "SELECT * FROM listed", "listed")
def sink_csv_sorted(spark, sf):
    path = scratch_path(spark, "universe")
    landed.write_universe_csv(scan_with_fallback(spark, sf), path)
    return landed.stored_universe_csv(spark, path)


@query("scan_chart_json", f"""SELECT CAST(symbol AS VARCHAR) AS symbol, trade_date, {r('adj_close', 6)}, volume FROM prices WHERE volume <> 7""", "prices")
def scan_chart_json(spark, sf):
    """One chart per (symbol, year): a first bar counts, a repeated later one does not, a missing close goes."""
    bars = src.prices(spark, sf).select(
        "symbol", F.year("trade_date").alias("y"), F.unix_timestamp("trade_date").alias("at"),
        F.when(F.col("volume") != 7, F.col("adj_close")).alias("close"), "volume")
    charts = bars.groupBy("symbol", "y").agg(F.sort_array(F.collect_list(F.struct("at", "close", "volume"))).alias("b"))
    twice = F.concat("b", F.transform("b", lambda x: F.struct(
        (x["at"] + 60).alias("at"), F.when(x["close"].isNotNull(), F.lit(1.0)).alias("close"), F.lit(0.0).alias("volume"))))
    doc = F.struct(F.lit(None).cast("string").alias("error"), F.array(F.struct(
        F.struct(F.col("symbol").cast("string").alias("symbol")).alias("meta"),
        F.transform("b2", lambda x: x["at"]).alias("timestamp"),
        F.struct(F.array(F.struct(F.transform("b2", lambda x: x["close"]).alias("adjclose"))).alias("adjclose"),
                 F.array(F.struct(F.transform("b2", lambda x: x["volume"]).alias("volume"))).alias("quote")).alias("indicators"))).alias("result"))
    path = land(spark, charts.withColumn("b2", twice).select(doc.alias("chart")), "charts", ignoreNullFields=False)
    return landed.chart_json(spark, path).withColumn("adj_close", fx.rounded(F.col("adj_close"), 6))


@query("scan_filing_list_json", """SELECT CAST(symbol AS VARCHAR) AS symbol, quarter_end, submission_date, 'https://x/' || CAST(filing_id AS VARCHAR) || '.xml' AS xbrl_url
FROM filings WHERE pledge_status <> 'UNAVAILABLE' AND quarter_end < DATE '2001-12-31' AND promoter_holding_pct > 4""", "filings")
def scan_filing_list_json(spark, sf):
    """UNAVAILABLE stands for a placeholder address, a tiny holding for a missing submission date."""
    f = src.filings(spark, sf)
    url = F.when(F.col("pledge_status") == "UNAVAILABLE", "-").otherwise(F.concat(F.lit(" https://x/"), "filing_id", F.lit(".xml")))
    item = F.struct(F.upper(F.date_format("quarter_end", "dd-MMM-yyyy")).alias("date"),
                    F.when(F.col("promoter_holding_pct") > 4, F.date_format("submission_date", "dd-MMM-yyyy HH:mm:ss")).alias("submissionDate"),
                    url.alias("xbrl"))
    path = land(spark, f.select(F.col("symbol").cast("string").alias("symbol"), F.array(item).alias("data")), "filing-lists")
    window = fx.quarter_ends(F.lit(src.FIRST_QUARTER), F.date_sub(F.lit(src.LAST_QUARTER), 1))
    return landed.filing_list_json(spark, path, window).drop("status")


@query("scan_disclosures_json", """SELECT CAST(symbol AS VARCHAR) AS symbol, event_date, CASE event_type WHEN 'invocation' THEN NULL ELSE 'P' || CAST(symbol AS VARCHAR) END AS promoter_name,
event_type, shares * 1000 AS shares, pct_equity FROM pledge_events WHERE pct_equity <> 0.05e0""", "pledge_events")
def scan_disclosures_json(spark, sf):
    """Some events carry only a broadcast time; those at 0.05 % carry no date at all."""
    e, kind = src.events(spark, sf), F.col("event_type")
    dated = F.col("pct_equity") != 0.05
    item = F.struct(
        F.when(dated & (kind != "release"), F.date_format("event_date", "dd-MMM-yyyy")).alias("sr_dateof_creation"),
        F.when(dated, F.date_format("event_date", "dd-MMM-yyyy HH:mm:ss")).alias("broadcastDateTime"),
        F.when(kind == "invocation", "-").otherwise(F.concat(F.lit("P"), "symbol", F.lit(" "))).alias("promoterName"),
        F.when(kind == "creation", "Created").when(kind == "release", "Revocation ").otherwise("INVOKED").alias("typeOfEvent"),
        F.format_number(F.col("shares") * 1000, 0).alias("numofShares"), F.col("pct_equity").cast("string").alias("perofShares"))
    path = land(spark, e.select(F.col("symbol").cast("string").alias("symbol"), F.array(item).alias("data")), "disclosures")
    return landed.disclosures_json(spark, path).select("symbol", "event_date", "promoter_name", "event_type", "shares", "pct_equity")


@query("scan_raw_ledger")
def scan_raw_ledger(spark, sf):
    """Files of one landing are known; the second landing is new."""
    docs = _index_docs(spark, sf)
    root = scratch_path(spark, "raw")
    docs.write.json(f"{root}/first")
    known = landed.raw_ledger(spark, f"{root}/first", glob="*.json")
    docs.repartition(4).write.json(f"{root}/second")
    return landed.raw_ledger(spark, root, known, glob="*.json")


# Filing documents ----------------------------------------------------------------------------

_MODERN = "quarter_end >= DATE '1999-01-01'"
piece("docs_expected", f"""SELECT CAST(symbol AS VARCHAR) || '-' || CAST(quarter_end AS VARCHAR) AS doc_id, pledge_status, promoter_holding_pct = 2 AS broken,
CASE WHEN pledge_status = 'UNAVAILABLE' THEN 'unknown' WHEN {_MODERN} THEN 'modern' ELSE 'legacy' END AS schema_generation,
CASE WHEN {_MODERN} THEN 100e0 ELSE 1e0 END AS scale, promoter_holding_pct * 1e4 AS promoter_shares, promoter_holding_pct,
CASE pledge_status WHEN 'NO_PLEDGE' THEN 0e0 WHEN 'PLEDGE_PRESENT' THEN pledge_pct_promoter END AS pledge_pct_promoter,
CASE pledge_status WHEN 'NO_PLEDGE' THEN 0e0 WHEN 'PLEDGE_PRESENT' THEN pledge_pct_promoter * promoter_holding_pct / 1e2 END AS pledge_pct_equity FROM state""", "state")


def documents(spark, sf, rows=None):
    """XML filings from the chosen state rows: both taxonomies, both scales, gaps, stray entities, and truncated ones."""
    s = state(spark, sf) if rows is None else rows
    modern = F.col("quarter_end") >= F.lit("1999-01-01").cast("date")
    status, h, q = F.col("pledge_status"), F.col("promoter_holding_pct"), F.col("pledge_pct_promoter")
    unit = F.when(modern, 100.0).otherwise(1.0)

    def context(i: str, member: str) -> str:
        return (f'<xbrli:context id="{i}"><xbrli:entity><xbrli:segment><xbrldi:explicitMember dimension="x:CategoryOfShareholdersAxis">x:{member}'
                "</xbrldi:explicitMember></xbrli:segment></xbrli:entity></xbrli:context>")

    def fact(tag, ref: str, value) -> F.Column:
        tag = F.lit(tag) if isinstance(tag, str) else tag
        return F.concat(F.lit("<x:"), tag, F.lit(f' contextRef="{ref}">'), value.cast("string"), F.lit("</x:"), tag, F.lit(">"))

    def tag(kind: str):
        pick = lambda g: parse.TAXONOMIES[g][kind] if kind != "flags" else parse.TAXONOMIES[g][kind][0]
        return F.when(modern, pick("modern")).otherwise(pick("legacy"))

    none = F.lit("")
    present = status == "PLEDGE_PRESENT"
    body = F.concat(
        F.lit('<?xml version="1.0"?><xbrl xmlns:x="http://x" xmlns:xbrli="http://i" xmlns:xbrldi="http://d">'
              + context("c1", parse.PROMOTER) + context("c2", parse.TOTAL)),
        fact(parse.SHARES, "c1", F.format_number(h * 10000, 0)), fact(parse.SHARES, "c2", F.lit("1,000,000")),
        fact(parse.HOLDING, "c1", h / unit), fact(parse.HOLDING, "c2", F.lit(100.0) / unit),
        F.when(present, fact(tag("shares"), "c1", h * 100 * q)).otherwise(none),
        F.when(present & (h > 50), fact(tag("pct"), "c1", q / unit)).otherwise(none),
        F.when(status != "UNAVAILABLE", fact(tag("flags"), "c1", F.when(present, "true").otherwise("No"))).otherwise(none),
        F.when(h == 4, F.lit("R&D&nbsp;")).otherwise(none), F.lit("</xbrl>"))
    whole = F.when(h == 2, F.substring(body, 1, 300)).otherwise(body)
    return s.select(F.concat(F.col("symbol").cast("string"), F.lit("-"), F.col("quarter_end").cast("string")).alias("doc_id"),
                    whole.cast("binary").alias("content"))


@query("shred_filing_facts", """SELECT doc_id, CASE WHEN broken THEN 1 ELSE 6 + CAST(pledge_status <> 'UNAVAILABLE' AS INT) + CAST(pledge_status = 'PLEDGE_PRESENT' AS INT)
+ CAST(pledge_status = 'PLEDGE_PRESENT' AND promoter_holding_pct > 50 AS INT) END AS n_facts, broken, promoter_holding_pct = 4 AS recovered FROM docs_expected""", "docs_expected")
def shred_filing_facts(spark, sf):
    facts = xml.shred_filing_facts(documents(spark, sf))
    return facts.groupBy("doc_id").agg(F.count("*").cast("int").alias("n_facts"), F.bool_or(F.col("error").isNotNull()).alias("broken"),
                                      F.bool_or("recovered").alias("recovered"))


@query("detect_generation", "SELECT doc_id, schema_generation FROM docs_expected WHERE NOT broken", "docs_expected")
def detect_generation(spark, sf):
    facts = xml.shred_filing_facts(documents(spark, sf))
    return facts.groupBy("doc_id").agg(
        parse.detect_generation().alias("schema_generation"), F.max("error").alias("e")).where(F.col("e").isNull()).drop("e")


@query("fraction_scale_fix", f"""SELECT doc_id, scale, {r('promoter_holding_pct', 6)} FROM docs_expected WHERE NOT broken""", "docs_expected")
def fraction_scale_fix(spark, sf):
    wide = parse.document_facts(xml.shred_filing_facts(documents(spark, sf))).where(F.col("error").isNull())
    scale = parse.percentage_scale(F.col("holding_total"))
    return tidy(wide.select("doc_id", scale.alias("scale"), (F.col("holding") * scale).alias("promoter_holding_pct")), places=6)


_STATE = f"""doc_id, pledge_status, schema_generation, promoter_shares, {r('promoter_holding_pct', 6)}, {r('pledge_pct_promoter', 6)}, {r('pledge_pct_equity', 6)}"""


def _state_columns(df):
    return tidy(df.select("doc_id", "pledge_status", "schema_generation", "promoter_shares", "promoter_holding_pct",
                          "pledge_pct_promoter", "pledge_pct_equity"), places=6)


# One filing per (symbol, quarter, order): its first line. The id keeps the order of the orders.
_FIRST = ["line_no", "submission_date", "promoter_holding_pct", "pledge_pct_promoter", "pledge_pct_equity", "pledge_status"]
piece("book", f"""SELECT * EXCLUDE (rn), (filing_id * 1000 + (YEAR(quarter_end) - 1990) * 12 + MONTH(quarter_end)) * 1000000 + symbol AS doc_number FROM (SELECT *, ROW_NUMBER() OVER
(PARTITION BY symbol, quarter_end, filing_id ORDER BY {', '.join(_FIRST)}) AS rn FROM filings) f WHERE rn = 1""", "filings")
piece("book_chosen", """SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY symbol, quarter_end ORDER BY submission_date <= quarter_end + 30 DESC,
CASE WHEN submission_date <= quarter_end + 30 THEN submission_date END DESC, CASE WHEN submission_date <= quarter_end + 30 THEN doc_number END DESC,
submission_date, doc_number) AS pick FROM book) b WHERE pick = 1""", "book")


def _ledger_of(spark, sf):
    """The filings as a downloaded ledger with unique ids, and their documents."""
    from pitpanel.session import materialise

    first = src.filings(spark, sf).groupBy("symbol", "quarter_end", "filing_id").agg(F.min(F.struct(*_FIRST)).alias("__pick"))
    rows = materialise(first.select("symbol", "quarter_end", "filing_id", "__pick.*").withColumn(
        "doc_number", (F.col("filing_id") * 1000 + (F.year("quarter_end") - 1990) * 12 + F.month("quarter_end")) * 1_000_000
        + F.col("symbol")), "ledger")
    book = rows.select(F.col("doc_number").alias("filing_id"), "symbol", "quarter_end", "submission_date",
                       F.lit("downloaded").alias("status"), F.concat(F.lit("raw/"), "doc_number", F.lit(".xml")).alias("local_path"))
    docs = documents(spark, sf, rows.withColumn("symbol", F.col("doc_number"))).select(
        F.split("doc_id", "-").getItem(0).cast("bigint").alias("filing_id"), "content")
    return book, docs


@query("pipe_parse_filings", f"SELECT {_STATE} FROM docs_expected WHERE NOT broken", "docs_expected")
def pipe_parse_filings(spark, sf):
    parsed = parse.state_from_facts(xml.shred_filing_facts(documents(spark, sf)))
    return _state_columns(parsed.where(F.col("reason").isNull()))


@query("pipe_parse_ledger", """SELECT (SELECT COUNT(*) FROM book) AS downloaded, COUNT(*) FILTER (promoter_holding_pct <> 2) AS parsed,
COUNT(*) FILTER (promoter_holding_pct = 2) AS quarantined, (SELECT COUNT(*) FROM book) - COUNT(*) AS superseded FROM book_chosen""", "book", "book_chosen")
def pipe_parse_ledger(spark, sf):
    return parse.parse_ledger(*_ledger_of(spark, sf))["stats"]


@query("sink_quarantine", """SELECT doc_number AS filing_id, symbol, quarter_end, TRUE AS malformed, TRUE AS same_reason FROM book_chosen WHERE promoter_holding_pct = 2""", "book_chosen")
def sink_quarantine(spark, sf):
    """Truncated documents end up in the quarantine table with a reason, and their ledger rows say so."""
    book, docs = _ledger_of(spark, sf)
    out = parse.parse_ledger(book, docs)
    path = scratch_path(spark, "quarantine")
    landed.write_quarantine(out["rejected"], path)
    after = merge.merge_update(book.withColumn("error_message", F.lit(None).cast("string")), out["changes"], ["filing_id"])
    return spark.read.parquet(path).join(after.where(F.col("status") == "quarantined"), "local_path").select(
        "filing_id", "symbol", "quarter_end", F.col("reason").startswith("malformed XML").alias("malformed"),
        (F.col("reason") == F.col("error_message")).alias("same_reason"))


@query("stream_land_filings", f"SELECT {_STATE} FROM docs_expected WHERE NOT broken", "docs_expected")
def stream_land_filings(spark, sf):
    """Documents arrive in two landings; the second run reads only the second."""
    incoming, target, checkpoint = (scratch_path(spark, n) for n in ("incoming", "landed", "stream"))
    docs = documents(spark, sf).withColumn("filing_id", F.xxhash64("doc_id"))
    early = F.col("doc_id") < "5"
    for part in (docs.where(early), docs.where(~early)):
        part.select("filing_id", "content").write.mode("append").parquet(incoming)
        landing.land_filings(spark, incoming, target, checkpoint, files_per_batch=50).awaitTermination()
    good, _ = landing.landed_state(spark, target)
    named = good.withColumnRenamed("doc_id", "filing_id").join(
        docs.select(F.col("filing_id").cast("string").alias("filing_id"), "doc_id"), "filing_id")
    return _state_columns(named)


@query("sink_snapshot")
def sink_snapshot(spark, sf):
    path = scratch_path(spark, "snapshot")
    cols = ["symbol", "observation_date", "label", "label_is_valid"]
    report.write_snapshot(panel(spark, sf, cols), src.runs(spark, sf), src.run_metrics(spark, sf), src.STUDY, path)
    return report.read_snapshot(spark, path)
