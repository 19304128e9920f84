"""Contracts, bar rules, coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.scalars import rounded
from tidemark.operators import calendars, quality
from tidemark.plans.registry import registry
from tidemark.sources import bindings as b

QUERIES, SQL, query = registry()


def _contract(spark, sf):
    rows = b.observations(spark, sf)
    k = F.pmod(F.length("revision") + F.dayofmonth("available_at"), F.lit(7))
    return rows.select(
        "revision", F.concat(F.lit("p"), F.col("entity")).alias("entity_id"), "source", F.when(k != 0, F.col("revision")).alias("revision_id"), F.when(k == 1, "[]").otherwise("{}").alias("payload_json"),
        F.when(k == 2, "guess").otherwise(F.col("basis")).alias("basis"), F.when(k == 3, F.date_add("available_at", 1)).when(k != 4, F.col("available_at")).alias("published_at"), "available_at", "ingested_at", F.when(k != 5, "doc").alias("evidence"),
    )


CONTRACT = """contract AS (SELECT *, (length(revision) + day(available_at)) % 7 AS k FROM obs),
c2 AS (SELECT revision, CASE WHEN k <> 0 THEN revision END AS revision_id, k = 1 AS bad_payload, CASE WHEN k = 2 THEN 'guess' ELSE basis END AS basis,
  CASE WHEN k = 3 THEN available_at + 1 WHEN k <> 4 THEN available_at END AS published_at, available_at, ingested_at, CASE WHEN k <> 5 THEN 'doc' END AS evidence FROM contract)"""


@query("f01_observation_contract", b.OBS, CONTRACT, sql_text="""SELECT errors, count(*) AS n FROM (SELECT list_sort(list_filter([
  CASE WHEN revision_id IS NULL THEN 'empty_identifier' END, CASE WHEN bad_payload THEN 'payload_not_object' END, CASE WHEN basis NOT IN ('observed', 'documented', 'estimated') THEN 'unknown_basis' END,
  CASE WHEN published_at > available_at THEN 'published_after_available' END, CASE WHEN basis = 'observed' AND available_at < ingested_at THEN 'available_before_ingestion' END,
  CASE WHEN basis IN ('documented', 'estimated') AND (published_at IS NULL OR evidence IS NULL) THEN 'missing_evidence' END], lambda x: x IS NOT NULL)) AS errors FROM c2) GROUP BY errors""")  # fmt: skip
def f01(spark, sf):
    return quality.observation_errors(_contract(spark, sf)).groupBy("errors").agg(F.count(F.lit(1)).alias("n"))


RAW = """raw AS (SELECT event_id, CASE WHEN event_id % 13 <> 0 THEN event_type END AS code, CASE WHEN event_id % 11 = 0 THEN strftime(ts, '%d/%m/%Y') ELSE strftime(ts, '%Y-%m-%d') END AS date,
  CASE WHEN event_id % 7 = 0 THEN 'true' WHEN event_id % 5 <> 0 THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END AS v FROM events)"""


@query("f02_raw_row_check", RAW, sql_text="""SELECT errors, count(*) AS n FROM (SELECT list_sort(list_filter([CASE WHEN code IS NULL THEN 'invalid_code' END, CASE WHEN TRY_CAST(date AS DATE) IS NULL OR NOT regexp_matches(date, '^\\d{4}-\\d{2}-\\d{2}$') THEN 'invalid_date' END,
  CASE WHEN v = 'true' THEN 'not_a_number:v' END], lambda x: x IS NOT NULL)) AS errors FROM raw) GROUP BY errors""")  # fmt: skip
def f02(spark, sf):
    e = b.table(spark, sf, "events")
    k = F.col("event_id")
    raw = e.select(F.when(k % 13 != 0, F.col("event_type")).alias("code"), F.when(k % 11 == 0, F.date_format("ts", "dd/MM/yyyy")).otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("date"), F.when(k % 7 == 0, "true").when(k % 5 != 0, F.floor("value").cast("string")).alias("v"))
    return quality.daily_row_errors(raw, ["v"]).groupBy("errors").agg(F.count(F.lit(1)).alias("n"))


def _defects(spark, sf):
    """Bars with defects by month."""
    m = F.month("session")
    out = b.bars(spark, sf).withColumn("m", m)
    for c in ("open", "high", "low"):
        out = out.withColumn(c, F.when(m != 2, F.col(c)))
    return out.select(
        "entity", "session", F.when(m == 9, -F.col("open")).otherwise(F.col("open")).alias("open"), F.when(m == 3, F.col("low") - 1).otherwise(F.col("high")).alias("high"), "low", F.when(~m.isin(1, 2), F.col("close")).alias("close"),
        F.when(m.isin(2, 5), 0.0).when(m == 6, -1.0).when(m != 4, F.col("volume")).alias("volume"), F.when(m == 8, -1.0).when(m != 7, 1.0).alias("factor"),
        m.isin(12).alias("_bad"), F.when(m == 11, F.date_sub("session", 1)).when(m == 10, F.col("session")).otherwise(F.date_add("session", 1)).alias("available_at"),
    ).withColumn("schema_ok", ~F.col("_bad")).drop("_bad")


DEFECTS = """defects AS (SELECT entity, session, CASE WHEN m = 2 THEN NULL WHEN m = 9 THEN -open ELSE open END AS open, CASE WHEN m = 2 THEN NULL WHEN m = 3 THEN low - 1 ELSE high END AS high, CASE WHEN m <> 2 THEN low END AS low,
  CASE WHEN m NOT IN (1, 2) THEN close END AS close, CASE WHEN m IN (2, 5) THEN 0.0 WHEN m = 6 THEN -1.0 WHEN m <> 4 THEN volume END AS volume, CASE WHEN m = 8 THEN -1.0 WHEN m <> 7 THEN 1.0 END AS factor,
  CASE WHEN m = 11 THEN session - 1 WHEN m = 10 THEN session ELSE session + 1 END AS available_at, m <> 12 AS schema_ok FROM (SELECT *, month(session) AS m FROM bars))"""

ISSUES = """rules AS (SELECT entity, session, unnest([
  CASE WHEN NOT schema_ok THEN 'error:invalid_schema' END,
  CASE WHEN available_at < session + 1 THEN 'warning:intraday_availability' END, CASE WHEN available_at < session THEN 'error:future_bar' END,
  CASE WHEN nulls = 4 AND coalesce(volume, 0) = 0 THEN 'warning:missing_quotes' WHEN nulls > 0 THEN 'error:partial_quotes' WHEN NOT ok THEN 'error:invalid_price' WHEN NOT (low <= least(open, close) AND greatest(open, close) <= high) THEN 'error:ohlc_order' END,
  CASE WHEN volume IS NULL THEN 'warning:missing_volume' WHEN volume < 0 THEN 'error:invalid_volume' WHEN volume = 0 THEN 'warning:zero_volume' END,
  CASE WHEN factor IS NULL THEN 'warning:missing_adjustment_factor' WHEN factor <= 0 THEN 'error:invalid_adjustment_factor' END]) AS r
  FROM (SELECT *, (open IS NULL)::INT + (high IS NULL)::INT + (low IS NULL)::INT + (close IS NULL)::INT AS nulls, open > 0 AND high > 0 AND low > 0 AND close > 0 AS ok FROM defects)),
issues AS (SELECT entity, session, split_part(r, ':', 1) AS severity, split_part(r, ':', 2) AS code FROM rules WHERE r IS NOT NULL)"""


@query("f03_bar_issues", b.BARS, DEFECTS, ISSUES, sql_text="SELECT * FROM issues")
def f03(spark, sf):
    return quality.bar_issues(_defects(spark, sf))


@query("f04_revision_duplicates", b.OBS, sql_text="""SELECT entity, revision, available_at, code FROM (SELECT *, CASE WHEN lag(kind) OVER w = kind THEN 'duplicate_revision' ELSE 'revision_conflict' END AS code, row_number() OVER w AS n
  FROM (SELECT entity, event_at, source AS revision, basis AS kind, available_at, revision AS rk FROM obs) WINDOW w AS (PARTITION BY entity, event_at, revision ORDER BY available_at, rk)) WHERE n > 1""")  # fmt: skip
def f04(spark, sf):
    rows = b.observations(spark, sf).select("entity", "event_at", F.col("revision").alias("rk"), F.col("source").alias("revision"), F.col("basis").alias("kind"), "available_at")
    return quality.revision_duplicates(rows, ["entity", "event_at"], "kind", ["available_at", "rk"]).select("entity", "revision", "available_at", "code")


DAYS = "days AS (SELECT DISTINCT session FROM ubars)"


@query("f05_expected_coverage", b.UBARS, DAYS, sql_text="SELECT entity, session, 'missing_session' AS code FROM (SELECT DISTINCT entity FROM ubars) CROSS JOIN days EXCEPT SELECT entity, session, 'missing_session' FROM ubars")
def f05(spark, sf):
    bars = b.ubars(spark, sf)
    return quality.coverage_issues(bars, quality.grid(bars.select("session"), bars.select("entity").distinct()))


@query("f06_publish_gate", b.BARS, DEFECTS, ISSUES, sql_text="SELECT entity, session FROM defects WHERE NOT EXISTS (SELECT 1 FROM issues WHERE severity = 'error')")
def f06(spark, sf):
    bars = _defects(spark, sf)
    return quality.gate(bars, quality.bar_issues(bars)).select("entity", "session")


CALENDAR = "cal AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day, CASE WHEN isodow(l_shipdate) >= 6 AND day(l_shipdate) <> 13 THEN 'weekend' WHEN day(l_shipdate) = 20 THEN '' ELSE 'open' END AS state FROM lineitem)"


def _calendar(spark, sf):
    day = F.to_date("l_shipdate")
    state = F.when(F.dayofweek("l_shipdate").isin(1, 7) & (F.dayofmonth("l_shipdate") != 13), "weekend").when(F.dayofmonth("l_shipdate") == 20, "").otherwise("open")
    return b.table(spark, sf, "lineitem").select(day.alias("day"), state.alias("state")).distinct()


@query("f07_calendar_validity", CALENDAR, sql_text="""SELECT day, 'missing_day' AS code FROM (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM cal) WHERE day NOT IN (SELECT day FROM cal)
UNION ALL SELECT day, 'open_on_rest_day' FROM cal WHERE state = 'open' AND (isodow(day) >= 6 OR (month(day) = 1 AND day(day) <= 3) OR (month(day) = 12 AND day(day) = 31)) UNION ALL SELECT day, 'empty_reason' FROM cal WHERE state = ''""")  # fmt: skip
def f07(spark, sf):
    return calendars.calendar_issues(_calendar(spark, sf))


@query("f08_session_completeness", CALENDAR, sql_text="SELECT day AS session, 'not_configured' AS code FROM cal WHERE state = 'open' AND day BETWEEN DATE '1995-01-01' AND DATE '1995-12-31' AND day NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders) UNION ALL SELECT DISTINCT CAST(o_orderdate AS DATE), 'not_open' FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1995-12-31' AND CAST(o_orderdate AS DATE) NOT IN (SELECT day FROM cal WHERE state = 'open')")
def f08(spark, sf):
    sessions = b.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("session")).where("session between date'1995-01-01' and date'1995-12-31'").distinct()
    return calendars.session_set_issues(sessions, _calendar(spark, sf), "1995-01-01", "1995-12-31")


@query("s09_calendar_from_raw", sql_text="SELECT day, CASE WHEN code IN ('1', '2') THEN 'open' WHEN code IN ('0', '3') THEN 'exchange_closed_' || code END AS state, available_at, n = 1 AND code IN ('0', '1', '2', '3') AS valid FROM (SELECT CAST(l_shipdate AS DATE) AS day, count(DISTINCT l_linenumber % 2) AS n, CAST(max(l_linenumber % 2) + isodow(min(l_shipdate)) // 3 AS VARCHAR) AS code, max(CAST(l_shipdate AS DATE) + l_linenumber) AS available_at FROM lineitem GROUP BY 1)")
def s09(spark, sf):
    li = b.table(spark, sf, "lineitem")
    day = F.to_date("l_shipdate")
    iso = F.weekday("l_shipdate") + 1
    raw = li.groupBy(day.alias("day"), (F.col("l_linenumber") % 2).alias("odd")).agg(F.max(F.expr("date_add(to_date(l_shipdate), l_linenumber)")).alias("ingested_at"), F.min(iso).alias("iso"))
    return calendars.calendar_from_raw(raw.select("day", (F.col("odd") + F.floor(F.col("iso") / 3)).cast("string").alias("code"), "ingested_at"))


STUDIES = "studies AS (SELECT o_custkey AS study, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place, CAST(o_orderdate AS DATE) AS start, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 90 AS INT) AS \"end\", CAST(o_orderdate AS DATE) - CAST(o_orderkey % 5 AS INT) AS known_at, [o_orderkey % 3, o_custkey % 3, 7] AS symbols FROM orders)"


@query("f13_study_validity", STUDIES, sql_text="SELECT study, bool_and(start <= \"end\" AND (before IS NULL OR before < start)) AS ordered, bool_and(known_at < start) AS universe_known, bool_and(len(symbols) = len(list_distinct(symbols))) AS symbols_unique FROM (SELECT *, lag(\"end\") OVER (PARTITION BY study ORDER BY place) AS before FROM studies) GROUP BY study")
def f13(spark, sf):
    from pyspark.sql import Window as W

    o = b.table(spark, sf, "orders")
    studies = o.select(F.col("o_custkey").alias("study"), F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")).alias("place"), F.to_date("o_orderdate").alias("start"), F.expr("date_add(to_date(o_orderdate), cast(o_orderkey % 90 as int))").alias("end"), F.expr("date_sub(to_date(o_orderdate), cast(o_orderkey % 5 as int))").alias("known_at"), F.array(F.col("o_orderkey") % 3, F.col("o_custkey") % 3, F.lit(7).cast("long")).alias("symbols"))
    return quality.study_errors(studies)


@query("f15_transaction_contract", b.TX, sql_text="""SELECT errors, count(*) AS n FROM (SELECT list_sort(list_filter([CASE WHEN NOT regexp_matches(id, '^[A-Za-z0-9_.|:-]{1,64}$') THEN 'invalid_id' END, CASE WHEN symbol % 6 = 0 THEN 'invalid_symbol' END, CASE WHEN currency = 'AFRICA' THEN 'unsupported_currency' END, CASE WHEN side NOT IN ('buy', 'sell') THEN 'invalid_side' END,
  CASE WHEN q < 0.5 THEN 'invalid_quantity' END, CASE WHEN fee < 0 THEN 'invalid_fee' END, CASE WHEN executed_at > created_at THEN 'executed_after_created' END, CASE WHEN ctl THEN 'control_characters' END], lambda x: x IS NOT NULL)) AS errors
  FROM (SELECT id, symbol, currency, CASE WHEN l_linenumber = 3 THEN 'hold' ELSE side END AS side, CASE WHEN l_linenumber = 4 THEN 0 ELSE quantity END AS q, CASE WHEN l_linenumber = 5 THEN -fee - 1 ELSE fee END AS fee, executed_at, executed_at - 1 + l_linenumber AS created_at, l_linenumber = 7 AS ctl FROM tx)) GROUP BY errors""")  # fmt: skip
def f15(spark, sf):
    n = F.col("l_linenumber")
    tx = b.transactions(spark, sf).select(
        "id", F.when(F.col("symbol") % 6 == 0, F.concat(F.lit("s-"), F.col("symbol"))).otherwise(F.col("symbol").cast("string")).alias("symbol"),
        F.when(F.col("currency") == "AFRICA", "ZAR").otherwise("JPY").alias("currency"), F.when(n == 3, "hold").otherwise(F.col("side")).alias("side"), F.when(n == 4, 0.0).otherwise(F.col("quantity")).alias("quantity"), "price", F.when(n == 5, -F.col("fee") - 1).otherwise(F.col("fee")).alias("fee"),
        "executed_at", F.expr("date_add(executed_at, l_linenumber - 1)").alias("created_at"), F.when(n == 7, F.lit("a\x01b")).otherwise("note").alias("note"),
    )
    return quality.transaction_errors(tx).groupBy("errors").agg(F.count(F.lit(1)).alias("n"))


@query("f18_article_urls", sql_text="SELECT page_id, regexp_matches(url, '" + quality.URL + "') AND length(url) <= 2048 AS ok FROM pages")
def f18(spark, sf):
    return b.table(spark, sf, "pages").select("page_id", quality.url_ok(F.col("url")).alias("ok"))


ARTICLES = "art AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN '' ELSE 'a' || page_id END AS id, CASE WHEN page_id % 7 = 0 THEN 'low' ELSE 'S' || page_id END AS symbol, CASE WHEN page_id % 3 = 0 THEN repeat('t', 301) ELSE 'title' END AS title, CASE WHEN page_id % 4 = 0 THEN 'x' ELSE 'en-GB' END AS language, url FROM pages)"


@query("f18_article_contract", ARTICLES, sql_text="SELECT page_id, array_to_string(list_sort(list_filter([CASE WHEN id = '' THEN 'invalid_id' END, CASE WHEN symbol = 'low' THEN 'invalid_symbol' END, CASE WHEN length(title) > 300 THEN 'invalid_title' END, CASE WHEN language = 'x' THEN 'invalid_language' END, CASE WHEN NOT (regexp_matches(url, '" + quality.URL + "') AND length(url) <= 2048) THEN 'invalid_url' END, CASE WHEN page_id % 2 = 0 THEN 'invalid_metadata' END], lambda x: x IS NOT NULL)), ',') AS errors FROM art")
def f18_contract(spark, sf):
    k = F.col("page_id")
    name = lambda p: F.concat(F.lit(p), k.cast("string"))
    rows = b.table(spark, sf, "pages").select(
        "page_id", "url", F.when(k % 5 == 0, "").otherwise(name("a")).alias("id"), F.when(k % 7 == 0, "low").otherwise(name("S")).alias("symbol"), F.when(k % 3 == 0, F.repeat(F.lit("t"), F.lit(301))).otherwise("title").alias("title"),
        F.when(k % 4 == 0, "x").otherwise("en-GB").alias("language"), F.lit("s").alias("source"), F.lit("").alias("summary"), F.create_map(F.lit("k"), F.when(k % 2 == 0, F.repeat(F.lit("v"), F.lit(257))).otherwise("v")).alias("metadata"),
    )
    return quality.article_errors(rows).select("page_id", F.array_join("errors", ",").alias("errors"))


#: Raw rows with defects: a third are there twice, a fifth have a revision, closes and volumes are missing, factors change.
RAWBARS = """rb0 AS (SELECT *, day(session) + CAST(entity AS BIGINT) AS k FROM ubars),
rb1 AS (SELECT entity, session, open, high, low, CASE WHEN k % 7 <> 0 THEN close END AS close, CASE WHEN k % 11 <> 0 THEN volume END AS volume, CASE WHEN k % 13 = 0 THEN NULL WHEN k % 4 = 0 THEN 0.5 ELSE 1 END AS factor, k FROM rb0),
rawbars AS (SELECT * FROM rb1 UNION ALL SELECT * FROM rb1 WHERE k % 3 = 0 UNION ALL SELECT entity, session, open, high, low, close + 1, volume, factor, k FROM rb1 WHERE k % 5 = 0),
rawcells AS (SELECT entity, session, count(*) AS n, count(DISTINCT concat_ws('|', CAST(round(open * 1000) AS BIGINT), CAST(round(high * 1000) AS BIGINT), CAST(round(low * 1000) AS BIGINT), coalesce(CAST(CAST(round(close * 1000) AS BIGINT) AS VARCHAR), 'null'), coalesce(CAST(CAST(round(volume * 1000) AS BIGINT) AS VARCHAR), 'null'))) AS kinds,
  bool_or(close IS NOT NULL) AS quoted, bool_or(volume IS NOT NULL) AS traded, count(*) - count(close) AS nc, count(*) - count(volume) AS nv, count(*) - count(factor) AS nf, count(*) FILTER (factor <> 1) AS f FROM rawbars GROUP BY entity, session)"""


@query("a01_coverage_report", b.UBARS, DAYS, RAWBARS, sql_text="""SELECT g.entity, count(*) AS expected_sessions, CAST(coalesce(sum(n), 0) AS BIGINT) AS acquired_rows, count(*) FILTER (quoted) AS price_coverage, count(*) FILTER (traded) AS volume_coverage, count(*) FILTER (n IS NULL) AS missing_sessions,
  CAST(coalesce(sum(n - kinds), 0) AS BIGINT) AS duplicate_rows, CAST(coalesce(sum(kinds - 1), 0) AS BIGINT) AS revisions, CAST(coalesce(sum(f), 0) AS BIGINT) AS factor_events, 0::BIGINT AS null_open, 0::BIGINT AS null_high, 0::BIGINT AS null_low, CAST(coalesce(sum(nc), 0) AS BIGINT) AS null_close, CAST(coalesce(sum(nv), 0) AS BIGINT) AS null_volume, CAST(coalesce(sum(nf), 0) AS BIGINT) AS null_factor
  FROM (SELECT DISTINCT entity FROM ubars) g CROSS JOIN days d LEFT JOIN rawcells u ON u.entity = g.entity AND u.session = d.session GROUP BY g.entity""")  # fmt: skip
def a01(spark, sf):
    bars = b.ubars(spark, sf).withColumn("k", F.dayofmonth("session") + F.col("entity").cast("long"))
    k = F.col("k")
    raw = bars.withColumn("close", F.when(k % 7 != 0, F.col("close"))).withColumn("volume", F.when(k % 11 != 0, F.col("volume")))
    raw = raw.withColumn("factor", F.when(k % 13 == 0, F.lit(None)).when(k % 4 == 0, 0.5).otherwise(1.0))
    raw = raw.unionByName(raw.where(k % 3 == 0)).unionByName(raw.where(k % 5 == 0).withColumn("close", F.col("close") + 1))
    return quality.coverage_report(raw.drop("k"), bars.select("session"))


@query("a01_missing_sessions", b.UBARS, DAYS, sql_text="SELECT entity, string_agg(CAST(session AS VARCHAR), ',' ORDER BY session) AS sessions FROM (SELECT entity, session FROM (SELECT DISTINCT entity FROM ubars) CROSS JOIN days EXCEPT SELECT entity, session FROM ubars) GROUP BY entity")
def a01_missing(spark, sf):
    bars = b.ubars(spark, sf)
    return quality.missing_sessions(bars, bars.select("session")).select("entity", F.array_join(F.transform("sessions", lambda d: d.cast("string")), ",").alias("sessions"))


@query("w08_rebalance_sessions", b.EBARS, sql_text="SELECT CAST(date_trunc('week', session) AS DATE) AS week, min(session) AS session FROM ebars GROUP BY 1")
def w08(spark, sf):
    return calendars.rebalance_sessions(b.ebars(spark, sf))


ORD = "ord AS (SELECT session, row_number() OVER (ORDER BY session) AS o FROM (SELECT DISTINCT session FROM ubars))"


@query("w09_session_shift", b.UBARS, ORD, sql_text="SELECT a.session, z.session AS target FROM ord a LEFT JOIN ord z ON z.o = a.o + 3")
def w09(spark, sf):
    return calendars.shifted(b.ubars(spark, sf).select("session"), 3)


@query("j13_previous_session_close", b.UBARS, ORD, sql_text="SELECT u.entity, u.session, round(u.close, 6) AS close, round(p.close, 6) AS previous_close FROM ubars u JOIN ord USING (session) LEFT JOIN (SELECT entity, o + 1 AS o, close FROM ubars JOIN ord USING (session)) p ON p.entity = u.entity AND p.o = ord.o")
def j13(spark, sf):
    return calendars.previous_session_close(b.ubars(spark, sf)).select("entity", "session", rounded(F.col("close"), 6).alias("close"), rounded(F.col("previous_close"), 6).alias("previous_close"))
