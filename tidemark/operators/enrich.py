"""Events and news that were known at an evaluation, their freshness and flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Days before an event at which it is soon, by type; announcements older than 30 days are stale, events of the last 7 days recent.
SOON_DAYS = {"earnings": 7, "dividend": 7, "stock_split": 14}
FLAGS = {"earnings": "earnings_soon", "dividend": "dividend_soon", "stock_split": "stock_split_upcoming"}
MAX_AGE_DAYS = 30
RECENT_DAYS = 7
#: Articles returned for each symbol, and the hours for which they are fresh.
MAX_ARTICLES = 5
FRESH_HOURS = 72


def events_at(events: DataFrame, at: Column) -> DataFrame:
    """Events announced by ``at`` (a null announcement stays), with days_until, upcoming, recent, freshness, and whether
    each raises its flag, and by which threshold. Days are those of the exchange's zone, ages are exact to the second."""
    known = events.where(F.col("announced_at").isNull() | (F.col("announced_at") <= at))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    age = micros(at) - micros(F.col("announced_at"))
    today = F.to_date(F.from_utc_timestamp(F.to_utc_timestamp(at.cast("timestamp"), F.current_timezone()), "Asia/Tokyo"))
    days = F.datediff(F.col("event_date"), today)
    soon = F.lit(None).cast("int")
    for kind, n in SOON_DAYS.items():
        soon = F.when(F.col("event_type") == kind, n).otherwise(soon)
    out = known.withColumns({
        "days_until": days, "freshness": F.when(F.col("announced_at").isNull(), "unknown").when(age > MAX_AGE_DAYS * 86_400_000_000, "stale").otherwise("fresh"),
        "upcoming": (days >= 0) & F.col("status").isin("scheduled", "announced"), "recent": (days >= -RECENT_DAYS) & (days < 0) & (F.col("status") != "cancelled"),
    })
    return out.withColumn("threshold_days", soon).withColumn("flagged", F.col("upcoming") & (F.col("freshness") == "fresh") & (F.col("days_until") <= soon))


def event_flags(known: DataFrame) -> DataFrame:
    """Per symbol: events, upcoming, recent, the sorted flags, and the reasons of all flagged events: rule, days_until,
    threshold_days, event_date, announced_at, source, status; by date, type, announcement (unknown first), source."""
    flag = F.lit(None).cast("string")
    for kind, name in FLAGS.items():
        flag = F.when(F.col("event_type") == kind, name).otherwise(flag)
    place = [F.col(c).alias(f"o{i}") for i, c in enumerate(("event_date", "event_type", "announced_at", "source"))]
    reason = F.struct(flag.alias("rule"), "days_until", "threshold_days", "event_date", "announced_at", "source", "status")
    listed = F.sort_array(F.collect_list(F.when(F.col("flagged"), F.struct(*place, reason.alias("reason")))))
    return known.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("events"), F.count_if("upcoming").alias("upcoming"), F.count_if("recent").alias("recent"),
        F.transform(listed, lambda x: x["reason"]).alias("reasons"), F.array_join(F.sort_array(F.collect_set(F.when(F.col("flagged"), flag))), ",").alias("flags"),
    )


def news_top(articles: DataFrame, at: Column, k: int = MAX_ARTICLES) -> DataFrame:
    """The first ``k`` articles of each symbol known by ``at``: newest first, unknown times last, ties by source and id.

    Ranked by a bounded window, of which Spark keeps ``k`` rows a symbol before the shuffle.
    """
    known = articles.where(F.col("published_at").isNull() | (F.col("published_at") <= at))
    w = W.partitionBy("symbol").orderBy(F.desc_nulls_last("published_at"), "source", "id")
    return known.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def news_flags(top: DataFrame, at: Column, hours: int = FRESH_HOURS) -> DataFrame:
    """Per symbol with a fresh article among those returned: their number, the latest time, sorted sources, flags."""
    fresh = top.where(F.col("published_at") >= at - F.make_dt_interval(hours=F.lit(hours)))
    out = fresh.groupBy("symbol").agg(F.count(F.lit(1)).alias("article_count"), F.max("published_at").alias("latest"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"))
    return out.withColumn("flags", F.when(F.col("article_count") >= 2, "recent_news,multiple_recent_news").otherwise("recent_news"))
