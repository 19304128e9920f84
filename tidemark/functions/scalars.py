"""Scalar rules: zones, decision times, plain numbers, codes, freshness, losses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """``a`` over ``b`` as doubles, as IEEE 754 has it: over zero an infinity of ``a``'s sign, or NaN for zero, and no error."""
    return F.when(b == 0, a * F.lit(float("inf"))).otherwise(F.try_divide(a, b))


def rounded(x: Column, digits: int) -> Column:
    """The double ``x`` rounded as the SQL rounds: the product with a power of ten goes to its nearest whole number, halves
    away from zero, and keeps its sign at zero. ``round`` with digits goes by the decimal text and has no negative zero."""
    scale = F.lit(10.0**digits)
    near = F.signum(x) * F.round(F.abs(x * scale)) / scale
    return F.when(F.abs(x * scale) == F.lit(float("inf")), x).otherwise(near)


def mean(x: Column) -> Column:
    """Aggregate: the mean of doubles, the same in any order of the rows. Their parts above 1/1024 add up without error (as long
    as the total stays under 2^43), so that only sums of the small rest are rounded."""
    coarse = F.when(F.abs(x) < 2.0**42, F.rint(x * 1024) / 1024).otherwise(x)
    rest = F.nanvl(x - coarse, F.lit(0.0))
    return F.try_divide(F.sum(coarse) + F.sum(rest), F.count(x))


OFFSET = r"(Z|[+-]\d{2}:\d{2})$"
#: Hours that the exchange's zone is ahead of UTC; it has no summer time.
ZONE_HOURS = 9
DECISION_HOUR = 18


def zoned_utc(text: Column, date_only: bool = False) -> Column:
    """Timestamp of an ISO text that names its offset; null without one. ``date_only`` takes bare dates as 00:00 UTC."""
    out = F.when(text.rlike(OFFSET), F.try_to_timestamp(text))
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(F.concat(text, F.lit("T00:00:00Z")))).otherwise(out) if date_only else out


def utc_stamp(at: Column) -> Column:
    """Microsecond ISO text of a timestamp, in the session's zone, which is UTC."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def exchange_date(at: Column) -> Column:
    return F.to_date(at + F.make_interval(hours=F.lit(ZONE_HOURS)))


def decision_at(session: Column) -> Column:
    """18:00 in the exchange's zone on the session's day, as UTC wall time."""
    return session.cast("timestamp_ntz") + F.make_interval(hours=F.lit(DECISION_HOUR - ZONE_HOURS))


def temporal_use(session: Column, available: Column, ingested: Column) -> Column:
    """How data may be used for a session's decision: past history, same day, or only after the cutoff."""
    cutoff = decision_at(session)
    return F.when(F.to_date(ingested) > session, "historical_exploratory").when(available < cutoff, "same_day_observation_unverified").otherwise("after_cutoff_exploratory")


def delayed_by_plan(session: Column, today: Column) -> Column:
    """Whether a free plan, 12 weeks behind, already shows the session."""
    return F.datediff(today, session) >= 84


def plain_number(value: Column) -> Column:
    """Decimal text without exponent, trailing zeros or a negative zero."""
    text = value.cast("decimal(30,12)").cast("string")
    text = F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(text.rlike(r"^-?0(\.0*)?$|^0E"), "0").otherwise(text)


def code_of(symbol: Column) -> Column:
    """A four-character symbol becomes a five-character code; a five-character one stays; others give null."""
    return F.when(symbol.rlike("^[0-9A-Z]{4}$"), F.concat(symbol, F.lit("0"))).when(symbol.rlike("^[0-9A-Z]{5}$"), symbol)


def week_start(day: Column) -> Column:
    """Monday of the ISO week."""
    return F.date_trunc("week", day).cast("date")


def freshness(at: Column, now: Column, limit_seconds: int) -> Column:
    """unknown, future, fresh (the limit included) or stale."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))
    return F.when(at.isNull(), "unknown").when(age < 0, "future").when(age <= limit_seconds * 1_000_000, "fresh").otherwise("stale")


def sha256_hex(*columns: Column) -> Column:
    """Digest of the columns' texts joined by bars; null is an empty text."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]), 256)


def log_loss(p: Column, y: Column) -> Column:
    """The loss of one prediction, with chances of at least 1e-15."""
    return -F.when(y == 1, F.log(F.greatest(p, F.lit(1e-15)))).otherwise(F.log(F.greatest(1 - p, F.lit(1e-15))))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-35.0), F.least(F.lit(35.0), x))))
