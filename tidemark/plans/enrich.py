"""Event and news enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import enrich
from tidemark.plans.registry import registry
from tidemark.sources import bindings as b

QUERIES, SQL, query = registry()

AT = "1998-06-01"
KNOWN = f"""known AS (SELECT *, event_date - DATE '{AT}' AS days_until, CASE WHEN announced_at IS NULL THEN 'unknown' WHEN DATE '{AT}' - announced_at > 30 THEN 'stale' ELSE 'fresh' END AS freshness,
  event_date >= DATE '{AT}' AND status IN ('scheduled', 'announced') AS upcoming, event_date < DATE '{AT}' AND event_date >= DATE '{AT}' - 7 AND status <> 'cancelled' AS recent, CASE event_type WHEN 'stock_split' THEN 14 ELSE 7 END AS soon, CASE event_type WHEN 'stock_split' THEN 'stock_split_upcoming' ELSE event_type || '_soon' END AS rule FROM cev WHERE announced_at <= DATE '{AT}')"""


@query("j15_event_enrichment", b.CEV, KNOWN, sql_text="SELECT symbol, id, days_until, freshness, upcoming, recent, upcoming AND freshness = 'fresh' AND days_until <= soon AS flagged FROM known")
def j15(spark, sf):
    return enrich.events_at(b.corporate_events(spark, sf), F.lit(AT).cast("date")).select("symbol", "id", "days_until", "freshness", "upcoming", "recent", "flagged")


@query("j15_event_flags", b.CEV, KNOWN, sql_text="""SELECT symbol, count(*) AS events, count(CASE WHEN upcoming THEN 1 END) AS upcoming, count(CASE WHEN recent THEN 1 END) AS recent,
  coalesce(string_agg(CASE WHEN f THEN concat_ws(' ', rule, days_until, soon, event_date, announced_at, source, status) END, ',' ORDER BY event_date, event_type, announced_at, source), '') AS reasons,
  coalesce(string_agg(DISTINCT CASE WHEN f THEN rule END, ',' ORDER BY CASE WHEN f THEN rule END), '') AS flags FROM (SELECT *, upcoming AND freshness = 'fresh' AND days_until <= soon AS f FROM known) GROUP BY symbol""")
def j15_flags(spark, sf):
    flags = enrich.event_flags(enrich.events_at(b.corporate_events(spark, sf), F.lit(AT).cast("date")))
    names = ("rule", "days_until", "threshold_days", "event_date", "announced_at", "source", "status")
    return flags.withColumn("reasons", F.array_join(F.transform("reasons", lambda r: F.concat_ws(" ", *[r[n].cast("string") for n in names])), ","))


NOW = "2024-01-20 12:00:00"
TOPK = f"topk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY published_at DESC NULLS LAST, source, id) AS rank FROM news WHERE published_at IS NULL OR published_at <= TIMESTAMP '{NOW}') WHERE rank <= 5)"


@query("w14_news_top", b.NEWS, TOPK, sql_text="SELECT symbol, id, source, rank FROM topk")
def w14(spark, sf):
    return enrich.news_top(b.news(spark, sf), F.lit(NOW).cast("timestamp_ntz")).select("symbol", "id", "source", "rank")


@query("a14_news_flags", b.NEWS, TOPK, sql_text=f"SELECT symbol, count(*) AS article_count, strftime(max(published_at), '%Y-%m-%d %H:%M:%S') AS latest, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, CASE WHEN count(*) >= 2 THEN 'recent_news,multiple_recent_news' ELSE 'recent_news' END AS flags FROM topk WHERE published_at >= TIMESTAMP '{NOW}' - INTERVAL 72 HOUR GROUP BY symbol")
def a14(spark, sf):
    at = F.lit(NOW).cast("timestamp_ntz")
    return enrich.news_flags(enrich.news_top(b.news(spark, sf), at), at).withColumn("latest", F.date_format("latest", "yyyy-MM-dd HH:mm:ss"))
