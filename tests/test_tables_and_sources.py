"""Merges, scalar functions, landed files, filings and the stream."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from pitpanel.functions import scalars as fx, text, vectors
from pitpanel.operators import merge
from pitpanel.plans import filings as parse
from pitpanel.session import scratch_path
from pitpanel.sources import adapters as src, filings as xml, landed, tables, tables as scans
from pitpanel.streaming import landing

D = dt.date


@pytest.fixture()
def target(spark):
    return spark.createDataFrame([(1, "A", "parsed", "x.xml"), (2, "B", "pending", None)],
                                 "filing_id int, symbol string, status string, local_path string")


def test_upsert_keeps_omitted_columns_and_is_idempotent(spark, target):
    payload = spark.createDataFrame([("A", None), ("C", "pending")], "symbol string, status string")
    once = merge.merge_update(target, payload, ["symbol"])
    twice = merge.merge_update(once, payload, ["symbol"])
    got = {r.symbol: (r.filing_id, r.status, r.local_path) for r in twice.collect()}
    assert got == {"A": (1, None, "x.xml"), "B": (2, "pending", None), "C": (None, "pending", None)}
    assert sorted(once.collect(), key=str) == sorted(twice.collect(), key=str)


def test_insert_only_and_unknown_columns(spark, target):
    payload = spark.createDataFrame([("A", "pending"), ("C", "pending")], "symbol string, status string")
    got = {r.symbol: r.status for r in merge.merge_insert_only(target, payload, ["symbol"]).collect()}
    assert got == {"A": "parsed", "B": "pending", "C": "pending"}
    with pytest.raises(ValueError, match="unknown columns"):
        merge.merge_update(target, payload.withColumn("nope", F.lit(1)), ["symbol"])


def test_null_key_parts_match(spark):
    t = spark.createDataFrame([("A", None, 1)], "s string, p string, v int")
    assert merge.merge_update(t, t.withColumn("v", F.lit(2)), ["s", "p"]).collect() == [("A", None, 2)]
    d = spark.createDataFrame([("A", None, 1), ("A", None, 0)], "s string, p string, pos int")
    assert merge.dedupe_first(d, ["s", "p"], "pos").first().pos == 0


def test_bad_predictions_are_refused(spark):
    ok = spark.createDataFrame([("r", 0.5)], "run_id string, probability double")
    assert merge.prepare_predictions(ok, F.current_timestamp()).first().source == "backtest"
    for bad in (ok.withColumn("probability", F.lit(1.5)), ok.withColumn("source", F.lit("elsewhere"))):
        with pytest.raises(Exception, match="bad prediction"):
            merge.prepare_predictions(bad, F.current_timestamp()).collect()


def test_single_active_refuses_unknown(spark):
    r = spark.createDataFrame([("a", 1), ("b", 0)], "run_id string, is_active int")
    assert {x.run_id: x.is_active for x in merge.set_single_active(r, "b").collect()} == {"a": 0, "b": 1}
    with pytest.raises(Exception, match="unknown run"):
        merge.set_single_active(r, "c").collect()


def test_empty_table_has_its_columns(spark):
    assert tables.scan_table(spark, scratch_path(spark, "none"), "panel").columns[:3] == ["symbol", "observation_date", "quarter_end"]


@pytest.mark.parametrize("raw,want", [
    ("30-JUN-2026", D(2026, 6, 30)), ("5-June-2024", D(2024, 6, 5)), ("2024-02-29 10:11:12", D(2024, 2, 29)),
    ("01-03-2023", D(2023, 3, 1)), ("", None), ("31-31-2023", None), (None, None)])
def test_dates(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "x string").select(fx.parse_date(F.col("x")).alias("d")).first().d == want


@pytest.mark.parametrize("raw,want", [(" 1,234.5 ", 1234.5), ("-", None), ("NULL", None), ("", None), ("12x", None), ("-3", -3.0), ("nan", None)])
def test_numbers(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "x string").select(fx.clean_number(F.col("x")).alias("v")).first().v == want


@pytest.mark.parametrize("url,want", [("https://h/a/b.xml", "b.xml"), ("https://h/a/b/", "b.xml"), ("x", "x.xml"), ("", "unnamed.xml"), ("h/A.XML", "A.XML")])
def test_basename(spark, url, want):
    assert spark.createDataFrame([(url,)], "x string").select(fx.url_basename(F.col("x")).alias("v")).first().v == want


def test_bands_and_verdicts(spark):
    df = spark.createDataFrame([(0.1,), (0.2,), (0.6,), (1.0,)], "p double")
    bands = (("LOW", 0.2), ("MEDIUM", 0.4), ("HIGH", 0.6), ("CRITICAL", 1.01))
    assert [r.b for r in df.select(fx.risk_band(F.col("p"), bands).alias("b")).collect()] == ["LOW", "MEDIUM", "CRITICAL", "CRITICAL"]
    assert fx.elevated_bands(bands) == ["CRITICAL", "HIGH"]


def test_phrases_and_warnings(spark):
    df = spark.createDataFrame([("pledge_chg_1q", -2.0), ("return_90d", 0.125), ("pledge_accel_missing", 1.0), ("other", 3.0)], "f string, v double")
    got = [r.t for r in df.select(text.phrase(F.col("f"), F.col("v")).alias("t")).collect()]
    assert got == ["pledge fell 2.0pp over one quarter", "90-day return +13%", "pledge_accel was unavailable", "other = 3.0"] or \
        got[1] == "90-day return +12%" and got[0].startswith("pledge fell")
    rows = spark.createDataFrame([(1, None, 0), (0, 1.0, 1)], "is_stale int, a double, label_is_valid int")
    items = text.warning_items(["a"])
    w = rows.select(text.warning_messages(items).alias("all"), text.warning_messages(items, text.DATA_CODES).alias("data")).collect()
    assert [len(w[0]["all"]), len(w[0]["data"]), len(w[1]["all"])] == [3, 2, 0]


def test_domain_violations(spark):
    df = spark.createDataFrame([({"pledge_pct_promoter": -500.0, "odd": 1.0, "trailing_dd_60d": None},)], "v map<string,double>")
    got = df.select(vectors.domain_violations(F.col("v")).alias("p"), vectors.missing_keys(F.col("v"), ["odd", "x"]).alias("m")).first()
    assert got.p == ["pledge_pct_promoter=-500 is below the minimum 0"] and got.m == ["x"]


def write_lines(tmp_path, name, docs):
    path = tmp_path / name
    path.mkdir()
    (path / "a.json").write_text("\n".join(json.dumps(d) for d in docs))
    return str(path)


def chart(adj, stamps=(0, 60, 86400, 2 * 86400)):
    block = {} if adj is None else {"adjclose": [{"adjclose": adj}]}
    return {"chart": {"result": [{"meta": {"symbol": "A"}, "timestamp": list(stamps),
                                  "indicators": {**block, "quote": [{"volume": [1, 2, 3, 4]}]}}]}}


def test_chart(spark, tmp_path):
    path = write_lines(tmp_path, "ok", [chart([10.0, 11.0, None, 0.0])])
    assert [(r.trade_date, r.adj_close) for r in landed.chart_json(spark, path).collect()] == [(D(1970, 1, 1), 10.0)]
    with pytest.raises(Exception, match="no adjusted closes"):
        landed.chart_json(spark, write_lines(tmp_path, "bad", [chart(None)])).collect()


def test_filing_list_drops_placeholders(spark, tmp_path):
    item = lambda d, s, x: {"date": d, "submissionDate": s, "xbrl": x}
    doc = {"symbol": "A", "data": [item("31-MAR-2023", "10-APR-2023", "h/a.xml"), item("31-MAR-2023", "10-APR-2023", "-"),
                                   item("31-MAR-2023", None, "h/b.xml"), item("15-MAR-2023", "10-APR-2023", "h/c.xml"),
                                   item("31-MAR-2010", "10-APR-2010", "h/d.xml")]}
    q = fx.quarter_ends(F.lit(D(2022, 3, 31)), F.lit(D(2024, 3, 31)))
    got = landed.filing_list_json(spark, write_lines(tmp_path, "f", [doc]), q).collect()
    assert [r.xbrl_url for r in got] == ["h/a.xml"]


def test_raw_ledger_knows_what_it_has(spark, tmp_path):
    (tmp_path / "a.xml").write_text("one")
    first = landed.raw_ledger(spark, str(tmp_path), glob="*.xml").collect()
    (tmp_path / "b.xml").write_text("two")
    known = spark.createDataFrame(first)
    new = landed.raw_ledger(spark, str(tmp_path), known, glob="*.xml").collect()
    assert len(first) == 1 and len(new) == 1 and new[0].local_path.endswith("b.xml") and new[0].size_bytes == 3


def test_fallback_and_sorted_csv(spark, tmp_path):
    rows = spark.createDataFrame([("B", "b", None, "x"), ("A", "a", "I", None)], "symbol string, company_name string, isin string, industry string")
    path = str(tmp_path / "u")
    landed.write_universe_csv(rows, path)
    assert [r.symbol for r in landed.stored_universe_csv(spark, path).collect()] == ["A", "B"]
    assert landed.first_non_empty(rows.limit(0), rows).count() == 2
    with pytest.raises(ValueError):
        landed.first_non_empty(rows.limit(0))


def filing(facts: str, members=(parse.PROMOTER, parse.TOTAL)) -> bytes:
    contexts = "".join(
        f'<i:context id="c{n}"><i:entity><i:segment><i:explicitMember dimension="x:CategoryOfShareholdersAxis">x:{m}'
        "</i:explicitMember></i:segment></i:entity></i:context>" for n, m in enumerate(members, 1))
    return f'<xbrl xmlns:x="http://x" xmlns:i="http://i">{contexts}{facts}</xbrl>'.encode()


BASE = ('<x:NumberOfShares contextRef="c1">500</x:NumberOfShares><x:NumberOfShares contextRef="c2">1,000</x:NumberOfShares>'
        '<x:ShareholdingAsAPercentageOfTotalNumberOfShares contextRef="c1">{h}</x:ShareholdingAsAPercentageOfTotalNumberOfShares>'
        '<x:ShareholdingAsAPercentageOfTotalNumberOfShares contextRef="c2">{t}</x:ShareholdingAsAPercentageOfTotalNumberOfShares>')
MODERN, LEGACY = parse.TAXONOMIES["modern"], parse.TAXONOMIES["legacy"]


def derive(spark, payload):
    docs = spark.createDataFrame([("d", payload)], "doc_id string, content binary")
    return parse.state_from_facts(xml.shred_filing_facts(docs)).first()


def test_stray_entities_are_read_as_text_and_truncated_documents_are_not(spark):
    whole = filing(BASE.format(h=50, t=100) + "<x:Name>R&D&nbsp;&amp; more</x:Name>")
    docs = spark.createDataFrame([("a", whole), ("b", whole[:-9]), ("c", filing(BASE.format(h=50, t=100)))], "doc_id string, content binary")
    rows = xml.shred_filing_facts(docs).collect()
    assert [r.value for r in rows if r.tag == "Name"] == ["R&D&nbsp;& more"]
    assert {(r.doc_id, r.recovered, r.error is None) for r in rows} == {("a", True, True), ("b", False, False), ("c", False, True)}


def test_repeated_payload_keys_fail_or_the_last_counts(spark):
    target = spark.createDataFrame([("A", 1)], "symbol string, v int")
    payload = spark.createDataFrame([("A", 2, 10), ("A", 3, 20), ("A", 4, 5)], "symbol string, v int, at int")
    with pytest.raises(Exception, match="repeated payload key"):
        merge.merge_update(target, payload.drop("at"), ["symbol"]).collect()
    assert merge.merge_update(target, payload, ["symbol"], order="at").collect() == [("A", 3)]


def test_a_page_past_the_end_keeps_the_total(spark, sf):
    rows = src.predictions(spark, sf)
    out = scans.page_with_total(rows, 10, 10**6).collect()
    assert len(out) == 1 and out[0].total == rows.count() and out[0].prediction_id is None
    assert len(scans.page_with_total(rows, 900, 0).collect()) == min(900, rows.count())


def test_no_tag_and_no_flag_is_unavailable_never_zero(spark):
    r = derive(spark, filing(BASE.format(h=50, t=100)))
    assert r.pledge_status == "UNAVAILABLE" and r.pledged_shares is None and r.pledge_pct_promoter is None
    assert r.promoter_holding_pct == 50.0 and r.schema_generation == "unknown" and r.reason is None


def test_a_false_flag_is_an_explicit_zero(spark):
    r = derive(spark, filing(BASE.format(h=0.5, t=1.0) + f"<x:{MODERN['flags'][1]}>false</x:{MODERN['flags'][1]}>"))
    assert (r.pledge_status, r.pledge_pct_promoter, r.pledge_pct_equity, r.promoter_holding_pct) == ("NO_PLEDGE", 0.0, 0.0, 50.0)
    assert r.schema_generation == "modern"


def test_fractions_are_scaled_and_reported_values_win(spark):
    tag = MODERN["pct"]
    facts = f'<x:{MODERN["shares"]} contextRef="c1">100</x:{MODERN["shares"]}><x:{tag} contextRef="c1">0.24</x:{tag}>'
    r = derive(spark, filing(BASE.format(h=0.5, t=1.0) + facts))
    assert r.pledge_status == "PLEDGE_PRESENT" and r.pledge_pct_promoter == pytest.approx(24.0)
    assert r.pledge_pct_equity == pytest.approx(10.0)


def test_legacy_percentages_stay(spark):
    facts = f'<x:{LEGACY["shares"]} contextRef="c1">100</x:{LEGACY["shares"]}>'
    r = derive(spark, filing(BASE.format(h=50, t=100) + facts))
    assert r.schema_generation == "legacy" and r.pledge_pct_promoter == pytest.approx(20.0)


def test_no_promoter_is_a_determinate_zero(spark):
    body = '<x:NumberOfShares contextRef="c1">1000</x:NumberOfShares>'
    r = derive(spark, filing(body, members=(parse.TOTAL,)))
    assert r.pledge_status == "NO_PLEDGE" and r.promoter_shares == 0 and r.reason is None
    assert derive(spark, filing(body, members=("Other",))).reason == "missing promoter aggregate context"


@pytest.mark.parametrize("payload,why", [(b"", "empty file"), (b"<a><b>", "malformed"), (b"not xml", "malformed")])
def test_broken_documents_are_rows_with_a_reason(spark, payload, why):
    assert why in derive(spark, payload).reason


def test_out_of_range_is_rejected(spark):
    assert "out of range" in derive(spark, filing(BASE.format(h=150, t=100))).reason


def test_stream_reads_only_what_is_new(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    target, check = str(tmp_path / "out"), str(tmp_path / "check")
    sizes = []
    for name in ("a", "b"):
        (raw / f"{name}.xml").write_bytes(filing(BASE.format(h=50, t=100)) if name == "a" else b"<broken>")
        q = landing.land_filings(spark, str(raw), target, check, fmt="binaryFile")
        q.awaitTermination()
        sizes.append(spark.read.parquet(target).count())
    good, rejected = landing.landed_state(spark, target)
    assert sizes == [1, 2] and good.count() == 1 and rejected.count() == 1
