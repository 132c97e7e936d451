"""Filing facts to one quarterly state row per document, with reasons for what is rejected."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitpanel.functions import scalars as fx
from pitpanel.operators.trajectory import latest_known_filing
from pitpanel.plans.quality import outside
from pitpanel.session import materialise
from pitpanel.sources.filings import CONTEXT, shred_filing_facts

# Names in the two taxonomies, newest first.
PROMOTER, TOTAL = "ShareholdingOfPromoterAndPromoterGroupMember", "ShareholdingPatternMember"
SHARES = "NumberOfShares"
HOLDING = "ShareholdingAsAPercentageOfTotalNumberOfShares"
TAXONOMIES = {
    "modern": {
        "shares": "NumberOfSharesEncumbered",
        "pct": "EncumberedSharesHeldAsPercentageOfTotalNumberOfShares",
        "flags": [
            "WhetherAnySharesHeldByPromotersAreEncumberedUnderPledgedForPromoterAndPromoterGroup",
            "WhetherAnySharesHeldByPromotersAreEncumberedUnderNonDisposalUndertakingForPromoterAndPromoterGroup",
            "WhetherAnySharesHeldByPromotersAreEncumberedOtherThanByWayOfPledgeOrNDUForPromoterAndPromoterGroup",
        ],
    },
    "legacy": {
        "shares": "PledgedOrEncumberedNumberOfShares",
        "pct": "PledgedOrEncumberedSharesHeldAsPercentageOfTotalNumberOfShares",
        "flags": [
            "WhetherAnySharesHeldByPromotersArePledgeOrOtherwiseEncumberedForPromoterAndPromoterGroup",
            "WhetherAnySharesHeldByPromotersArePledgeOrOtherwiseEncumbered",
        ],
    },
}


def _number() -> Column:
    return fx.known(F.trim(F.replace("value", F.lit(","), F.lit(""))).try_cast("double"))


def _first(value: Column, when: Column) -> Column:
    """The first usable value in document order."""
    use = when & value.isNotNull()
    return F.min_by(F.when(use, value), F.when(use, F.col("seq")))


def _fact(tag: str, member: str) -> Column:
    return _first(_number(), (F.col("tag") == tag) & (F.col("member") == member))


def _flag(tag: str) -> Column:
    word = F.lower("value")
    answer = F.when(word.isin("true", "1", "yes"), True).when(word.isin("false", "0", "no"), False)
    return _first(answer, F.col("tag") == tag)


def detect_generation() -> Column:
    """Aggregate over one document's facts: taxonomy by presence of its tags, newest first."""
    found = None
    for name, t in TAXONOMIES.items():
        present = F.bool_or(F.coalesce(F.col("tag").isin(t["shares"], *t["flags"]), F.lit(False)))
        found = F.when(present, name) if found is None else found.when(present, name)
    return found.otherwise("unknown")


def percentage_scale(total: Column) -> Column:
    """100 when all holders together read about 1, meaning the document writes fractions."""
    return F.when(total.between(0.9, 1.1), 100.0).otherwise(1.0)


def document_facts(facts: DataFrame) -> DataFrame:
    """One wide row per document: the few facts that matter, from one partial aggregate."""
    has = lambda m: F.bool_or(F.coalesce((F.col("tag") == CONTEXT) & (F.col("member") == m), F.lit(False)))
    picks = [
        F.max("error").alias("error"), has(PROMOTER).alias("has_promoter"), has(TOTAL).alias("has_total"),
        detect_generation().alias("schema_generation"),
        _fact(SHARES, PROMOTER).alias("promoter_shares"), _fact(SHARES, TOTAL).alias("total_shares"),
        _fact(HOLDING, PROMOTER).alias("holding"), _fact(HOLDING, TOTAL).alias("holding_total")]
    for g, t in TAXONOMIES.items():
        picks += [_fact(t["shares"], PROMOTER).alias(f"{g}_shares"), _fact(t["pct"], PROMOTER).alias(f"{g}_pct"),
                  _fact(t["pct"], TOTAL).alias(f"{g}_pct_total")]
        picks += [_flag(f).alias(f"{g}_flag{i}") for i, f in enumerate(t["flags"])]
    return facts.groupBy("doc_id").agg(*picks)


def state_from_facts(facts: DataFrame, low: float = 0.0, high: float = 100.0) -> DataFrame:
    """One row per document with its state columns and ``reason``; a NULL reason means usable."""
    d = document_facts(facts).withColumn("scale", percentage_scale(F.col("holding_total")))
    gen = F.col("schema_generation")

    def by_generation(suffix: str) -> Column:
        return reduce(lambda c, g: c.when(gen == g, F.col(f"{g}_{suffix}")), TAXONOMIES, F.when(F.lit(False), F.lit(None).cast("double")))

    def any_flag(g: str) -> Column:
        answers = F.array_compact(F.array(*[F.col(f"{g}_flag{i}") for i in range(len(TAXONOMIES[g]["flags"]))]))
        return F.when(F.size(answers) > 0, F.exists(answers, lambda x: x))

    flag = reduce(lambda c, g: c.when(gen == g, any_flag(g)), TAXONOMIES, F.when(F.lit(False), F.lit(None).cast("boolean")))
    bare = ~F.col("has_promoter") & F.col("has_total") & (F.coalesce("total_shares", F.lit(0.0)) != 0)
    zero = F.lit(0.0)
    d = d.select(
        "doc_id", "error", "has_promoter", "schema_generation", "scale", "total_shares", bare.alias("promoterless"), flag.alias("flag"),
        F.when(bare, zero).otherwise(F.col("promoter_shares")).alias("promoter_shares"),
        F.when(bare, zero).otherwise(by_generation("shares")).alias("pledged"),
        F.when(bare, zero).otherwise(F.col("holding") * F.col("scale")).alias("holding"),
        (by_generation("pct") * F.col("scale")).alias("pct"), (by_generation("pct_total") * F.col("scale")).alias("pct_total"))
    d = d.withColumn("pledge_status", fx.pledge_status(F.col("pledged"), F.col("flag"), F.col("promoterless")))
    clean = F.col("pledge_status") == fx.NO_PLEDGE

    def or_zero(value: Column) -> Column:
        return F.coalesce(value, F.when(clean, zero))

    d = d.select(
        "doc_id", "error", "has_promoter", "promoterless", "schema_generation", "scale", "pledge_status",
        "promoter_shares", or_zero(F.col("pledged")).alias("pledged_shares"), "total_shares",
        fx.reported_or_ratio(F.col("holding"), F.col("promoter_shares"), F.col("total_shares")).alias("promoter_holding_pct"),
        or_zero(fx.reported_or_ratio(F.col("pct"), F.col("pledged"), F.col("promoter_shares"))).alias("pledge_pct_promoter"),
        or_zero(fx.reported_or_ratio(F.col("pct_total"), F.col("pledged"), F.col("total_shares"))).alias("pledge_pct_equity"))
    reason = F.when(F.col("error").isNotNull(), F.col("error")).when(
        ~F.col("has_promoter") & ~F.col("promoterless"), "missing promoter aggregate context")
    for c in ("promoter_holding_pct", "pledge_pct_promoter", "pledge_pct_equity"):
        reason = reason.when(outside(F.col(c), low, high), F.concat(F.lit(f"{c} out of range: "), F.col(c).cast("string")))
    reason = reason.when(F.col("promoter_shares").isNull() & (F.col("pledge_status") == fx.UNAVAILABLE), "no usable facts")
    return d.withColumn("reason", reason).drop("error", "has_promoter", "promoterless")


def parse_ledger(ledger: DataFrame, documents: DataFrame, lag_days: int = 30) -> dict[str, DataFrame]:
    """Downloaded filings to state rows.

    ``ledger``: (filing_id, symbol, quarter_end, submission_date, status, local_path); ``documents``:
    (filing_id, content). Returns ``state``, ``rejected`` (with reasons), ``changes`` (new ledger
    statuses) and ``stats``. Only the chosen revision of each quarter is read as XML, once.
    """
    waiting = ledger.where(F.col("status") == "downloaded")
    chosen = latest_known_filing(waiting, lag_days)
    facts = shred_filing_facts(chosen.join(documents, "filing_id"), "filing_id")
    derived = state_from_facts(facts).withColumn("filing_id", F.col("doc_id").cast("bigint")).drop("doc_id")
    parsed = chosen.select("filing_id", "symbol", "quarter_end", "submission_date", "local_path").join(derived, "filing_id", "left")
    parsed = materialise(parsed.withColumn("reason", F.when(
        F.col("schema_generation").isNull() & F.col("reason").isNull(), "missing file").otherwise(F.col("reason"))), "parsed")
    good = F.col("reason").isNull()
    stats = parsed.agg(F.count_if(good).alias("parsed"), F.count_if(~good).alias("quarantined")).withColumn("__one", F.lit(1))
    total = waiting.agg(F.count("*").alias("downloaded")).withColumn("__one", F.lit(1))
    return {
        "state": parsed.where(good).select(
            "symbol", "quarter_end", "submission_date", "promoter_shares", "pledged_shares", "total_shares",
            "promoter_holding_pct", "pledge_pct_promoter", "pledge_pct_equity", "pledge_status", "filing_id", "schema_generation"),
        "rejected": parsed.where(~good).select("filing_id", "symbol", "quarter_end", "local_path", "reason"),
        "changes": parsed.select("filing_id", F.when(good, "parsed").otherwise("quarantined").alias("status"),
                                 F.col("reason").alias("error_message")),
        "stats": total.join(F.broadcast(stats), "__one").drop("__one").withColumn(
            "superseded", F.col("downloaded") - F.col("parsed") - F.col("quarantined")),
    }
