"""Column expressions: cleaning, dates, bands, verdicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted date patterns, tried in this order.
DATE_PATTERNS = ["d-MMM-yyyy", "d-MMMM-yyyy", "yyyy-M-d", "d-M-yyyy"]

# Spellings of the three event types, in matching order.
EVENT_SPELLINGS = [
    ("creation", "creation"), ("created", "creation"),
    ("invocation", "invocation"), ("invoked", "invocation"),
    ("release", "release"), ("released", "release"),
    ("revocation", "release"), ("revoked", "release"),
]

POSITIVE, ZERO, NEGATIVE, UNKNOWN = "POSITIVE", "ZERO", "NEGATIVE", "UNKNOWN"
NO_PLEDGE, PLEDGE_PRESENT, UNAVAILABLE = "NO_PLEDGE", "PLEDGE_PRESENT", "UNAVAILABLE"


def known(value: Column) -> Column:
    """NaN to NULL. Applied at every boundary, because Spark compares NaN as the largest number."""
    return F.when(~F.isnan(value), value)


def rounded(value: Column, places: int = 9) -> Column:
    """Round, and turn minus zero into zero."""
    return F.round(value, places) + F.lit(0.0)


def parse_date(text: Column) -> Column:
    """First pattern that fits, after dropping a time part; else NULL."""
    day = F.split(F.trim(text), " ").getItem(0)
    return F.coalesce(*[F.to_date(F.try_to_timestamp(day, F.lit(p))) for p in DATE_PATTERNS])


def _blank_to_null(text: Column) -> Column:
    raw = text.cast("string")
    return F.when(~raw.isin("", "NULL", "-"), raw)


def clean_number(text: Column) -> Column:
    """Number without thousands commas; placeholders and junk become NULL."""
    stripped = F.trim(F.replace(_blank_to_null(text), F.lit(","), F.lit("")))
    return known(stripped.try_cast("double"))


def clean_text(text: Column) -> Column:
    """Trimmed text; placeholders and blanks become NULL."""
    return F.nullif(F.trim(_blank_to_null(text)), F.lit(""))


def normalise_event(text: Column) -> Column:
    """creation, release or invocation; an unknown word stays as lower-case text."""
    word = F.lower(F.trim(text))
    exact = reduce(lambda c, kv: c.when(word == kv[0], kv[1]), EVENT_SPELLINGS, F.when(F.lit(False), ""))
    inside = reduce(
        lambda c, kv: c.when(word.contains(kv[0]), kv[1]), EVENT_SPELLINGS, F.when(F.lit(False), ""))
    return F.coalesce(exact, inside, F.nullif(word, F.lit("")))


def quarter_ends(first: Column, last: Column) -> Column:
    """Array of calendar quarter ends in [first, last]."""
    start = F.add_months(F.trunc(first, "quarter"), 2)
    days = F.transform(
        F.sequence(start, F.greatest(last, start), F.expr("INTERVAL 3 MONTHS")), F.last_day)
    return F.filter(days, lambda d: d.between(first, last))


def shift_days(date: Column, days: int) -> Column:
    return F.date_add(date, days)


def log_or_null(value: Column) -> Column:
    """Natural logarithm of a positive number, else NULL."""
    return F.when(value > 0, F.ln(value))


def run_id(stamp: Column, model: Column, experiment: Column) -> Column:
    return F.concat_ws("_", stamp, model, experiment)


def session_of(run: Column) -> Column:
    return F.split(run, "_").getItem(0)


def url_basename(url: Column) -> Column:
    """Last path segment with an .xml ending; ``unnamed`` when there is none."""
    tail = F.coalesce(F.nullif(F.regexp_extract(url, r"([^/]*)/*$", 1), F.lit("")), F.lit("unnamed"))
    return F.when(F.lower(tail).endswith(".xml"), tail).otherwise(F.concat(tail, F.lit(".xml")))


def local_path(root: str, symbol: Column, url: Column) -> Column:
    return F.concat_ws("/", F.lit(root), symbol.cast("string"), url_basename(url))


def verdict(low: Column, high: Column) -> Column:
    """A direction only when the interval excludes zero."""
    return (
        F.when(low.isNull() | high.isNull() | F.isnan(low) | F.isnan(high), UNKNOWN)
        .when(low > 0, POSITIVE).when(high < 0, NEGATIVE).otherwise(ZERO)
    )


def risk_band(probability: Column, bands) -> Column:
    """First band, by rising upper bound, that lies above the probability; else the top band."""
    ordered = sorted(bands, key=lambda kv: kv[1])
    picked = reduce(lambda c, kv: c.when(probability < kv[1], kv[0]), ordered, F.when(F.lit(False), ""))
    return picked.otherwise(ordered[-1][0])


def elevated_bands(bands) -> list[str]:
    """Bands that start at or above the HIGH cut, and HIGH itself."""
    cut = dict(bands).get("HIGH", 0.6)
    return sorted({n for n, upper in bands if upper > cut} | {"HIGH"})


def pledge_status(pledged: Column, flag: Column, promoterless: Column) -> Column:
    """Three-way: an unreported pledge is UNAVAILABLE, never zero."""
    return (
        F.when(promoterless, NO_PLEDGE)
        .when(pledged.isNull() & flag.isNull(), UNAVAILABLE)
        .when((F.coalesce(pledged, F.lit(0.0)) > 0) | F.coalesce(flag, F.lit(False)), PLEDGE_PRESENT)
        .otherwise(NO_PLEDGE)
    )


def reported_or_ratio(reported: Column, part: Column, whole: Column) -> Column:
    """The filer's own percentage, else 100 x part / whole."""
    return F.coalesce(reported, F.when(whole != 0, F.lit(100.0) * part / whole))
