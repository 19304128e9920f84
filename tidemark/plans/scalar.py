"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalars as c
from tidemark.plans.registry import registry
from tidemark.sources import bindings as b

QUERIES, SQL, query = registry()


@query("c01_zoned_utc", sql_text="SELECT event_id, CASE WHEN event_id % 3 = 0 THEN strftime(ts - INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') WHEN event_id % 3 = 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS utc FROM events")
def c01(spark, sf):
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    k = F.col("event_id") % 3
    zoned = F.when(k == 0, F.concat(text, F.lit("+09:00"))).when(k == 1, F.concat(text, F.lit("Z"))).otherwise(text)
    at = F.to_utc_timestamp(c.zoned_utc(zoned), F.current_timezone())
    return b.table(spark, sf, "events").select("event_id", F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("utc"))


@query("c02_utc_stamp", sql_text="SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS stamp FROM events")
def c02(spark, sf):
    return b.table(spark, sf, "events").select("event_id", c.utc_stamp(F.col("ts")).alias("stamp"))


@query("c03_exchange_date", sql_text="SELECT event_id, CAST(ts + INTERVAL 9 HOUR AS DATE) AS day, DATE '2024-02-01' - CAST(ts + INTERVAL 9 HOUR AS DATE) AS days_until FROM events")
def c03(spark, sf):
    day = c.exchange_date(F.col("ts"))
    return b.table(spark, sf, "events").select("event_id", day.alias("day"), F.datediff(F.lit("2024-02-01"), day).cast("long").alias("days_until"))


@query("c04_decision_cutoff", b.OBS, sql_text="SELECT revision, strftime(event_at + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M') AS cutoff, CASE WHEN ingested_at > event_at THEN 'historical_exploratory' WHEN available_at < event_at + INTERVAL 9 HOUR THEN 'same_day_observation_unverified' ELSE 'after_cutoff_exploratory' END AS temporal_use, DATE '1996-01-01' - event_at >= 84 AS delayed FROM obs")
def c04(spark, sf):
    use = c.temporal_use(F.col("event_at"), F.col("available_at"), F.col("ingested_at"))
    return b.observations(spark, sf).select("revision", F.date_format(c.decision_at(F.col("event_at")), "yyyy-MM-dd HH:mm").alias("cutoff"), use.alias("temporal_use"), c.delayed_by_plan(F.col("event_at"), F.lit("1996-01-01").cast("date")).alias("delayed"))


@query("c05_plain_number", sql_text="SELECT p_partkey, regexp_replace(regexp_replace(CAST(CAST(p_retailprice - p_size * 10 AS DECIMAL(30, 12)) AS VARCHAR), '0+$', ''), '\\.$', '') AS plain FROM part")
def c05(spark, sf):
    return b.table(spark, sf, "part").select("p_partkey", c.plain_number(F.col("p_retailprice") - F.col("p_size") * 10).alias("plain"))


@query("c06_symbol_code", sql_text="SELECT event_id, CASE WHEN length(s) = 4 THEN s || '0' WHEN length(s) = 5 THEN s END AS code FROM (SELECT event_id, CAST(event_id * 7 AS VARCHAR) AS s FROM events)")
def c06(spark, sf):
    return b.table(spark, sf, "events").select("event_id", c.code_of((F.col("event_id") * 7).cast("string")).alias("code"))


@query("c07_week_start", sql_text="SELECT o_orderkey, CAST(date_trunc('week', o_orderdate) AS DATE) AS week FROM orders")
def c07(spark, sf):
    return b.table(spark, sf, "orders").select("o_orderkey", c.week_start(F.col("o_orderdate")).alias("week"))


@query("c08_freshness", b.NEWS, sql_text="SELECT id, CASE WHEN published_at IS NULL THEN 'unknown' WHEN published_at > TIMESTAMP '2024-01-20 12:00:00' THEN 'future' WHEN published_at >= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 259200 SECOND THEN 'fresh' ELSE 'stale' END AS freshness FROM news")
def c08(spark, sf):
    return b.news(spark, sf).select("id", c.freshness(F.col("published_at"), F.lit("2024-01-20 12:00:00").cast("timestamp_ntz"), 259200).alias("freshness"))


@query("c09_sha256", sql_text="SELECT event_id, sha256(concat_ws('|', event_id, event_type, coalesce(props, ''))) AS digest FROM events")
def c09(spark, sf):
    return b.table(spark, sf, "events").select("event_id", c.sha256_hex(F.col("event_id"), F.col("event_type"), F.col("props")).alias("digest"))


@query("c10_payload_field", sql_text="SELECT event_id, json_extract_string(props, '$.k') AS field FROM events")
def c10(spark, sf):
    return b.table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("field"))


@query("c11_loss_and_sigmoid", b.PRED, sql_text="SELECT symbol, round(-CASE WHEN y = 1 THEN ln(greatest(p, 1e-15)) ELSE ln(greatest(1 - p, 1e-15)) END, 6) + 0.0 AS loss, round(1 / (1 + exp(-least(35, p * 100 - 50))), 6) AS squashed FROM pred")
def c11(spark, sf):
    return b.predictions(spark, sf).select("symbol", (c.rounded(c.log_loss(F.col("p"), F.col("y")), 6) + 0.0).alias("loss"), c.rounded(c.sigmoid(F.col("p") * 100 - 50), 6).alias("squashed"))
