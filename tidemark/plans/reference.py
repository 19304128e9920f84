"""Actions, statuses, masters, contracts, run inventories and streams over the given tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalars import rounded
from tidemark.operators import calendars, ledger, pit, quality, signals
from tidemark.plans.metrics import _bounds_sql
from tidemark.plans.pit import DECISION, ELIGIBLE, _asof_sql
from tidemark.plans.quality import CALENDAR, _calendar
from tidemark.plans.registry import registry
from tidemark.sources import bindings as b
from tidemark.sources import datasets, landed
from tidemark.sources.folders import new_folder, written
from tidemark.streaming import forward

QUERIES, SQL, query = registry()

DAY = "1996-06-01"


def _actions(spark, sf):
    """Corporate actions as observations: customer and month, known when announced."""
    return b.corporate_events(spark, sf).select(
        F.col("symbol").alias("entity"), F.trunc("event_date", "year").alias("event_at"), F.col("announced_at").alias("available_at"), F.col("announced_at").alias("ingested_at"),
        F.col("id").cast("double").alias("value"), F.lpad(F.col("id").cast("string"), 12, "0").alias("revision"), F.col("event_type").alias("source"), F.lit("observed").alias("basis"), F.col("event_date").alias("effective"), F.col("status").alias("payload"),
    )


ACTIONS = "act AS (SELECT symbol AS entity, CAST(date_trunc('year', event_date) AS DATE) AS event_at, announced_at AS available_at, id::DOUBLE AS value, lpad(id::VARCHAR, 12, '0') AS revision, event_type AS source, event_date AS effective, status AS payload FROM cev)"


@query("j05_known_actions", b.CEV, ACTIONS, sql_text=f"""SELECT entity, event_at, revision, (entity, event_at) IN (SELECT (entity, event_at) FROM act WHERE available_at < DATE '{DAY}' GROUP BY entity, event_at, available_at HAVING count(DISTINCT value) > 1) AS duplicate
FROM (SELECT *, row_number() OVER (PARTITION BY entity, event_at ORDER BY available_at DESC, revision DESC) AS k FROM act WHERE available_at < DATE '{DAY}') WHERE k = 1""")  # fmt: skip
def j05(spark, sf):
    return pit.known_actions(_actions(spark, sf).drop("effective", "payload"), F.lit(DAY).cast("date")).select("entity", "event_at", "revision", "duplicate")


@query("v11_action_exceptions", b.CEV, ACTIONS, sql_text="SELECT entity, event_at, min(available_at) > min(effective) AND min(available_at) >= DATE '1995-01-01' AS late, count(DISTINCT payload) > 1 AS revised FROM act GROUP BY entity, event_at")
def v11(spark, sf):
    return signals.action_exceptions(_actions(spark, sf), F.lit("1995-01-01").cast("date"))


@query("v11_delisted_while_held", b.CEV, ACTIONS, b.LIFE, sql_text="""SELECT a.entity, a.event_at, coalesce(q > 0, false) AS delisted_while_held FROM (SELECT DISTINCT entity, event_at FROM act) a LEFT JOIN
  (SELECT l_suppkey AS entity, arg_max(held, session) AS q FROM (SELECT l_suppkey, m AS session, sum(sum(f)) OVER (PARTITION BY l_suppkey ORDER BY m) AS held FROM
    (SELECT l_suppkey, CAST(date_trunc('month', l_shipdate) AS DATE) AS m, CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS f FROM lineitem) GROUP BY l_suppkey, m) JOIN (SELECT entity AS e, delisting FROM life WHERE delisting IS NOT NULL) ON e = l_suppkey WHERE session < delisting GROUP BY l_suppkey) h USING (entity)""")
def v11_held(spark, sf):
    """Actions of entities whose holding, by the ledger's quantities, was positive when they were delisted."""
    signed = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    flows = b.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("entity"), F.trunc("l_shipdate", "month").alias("session")).agg(F.sum(signed).alias("f"))
    holdings = flows.select("entity", "session", F.sum("f").over(W.partitionBy("entity").orderBy("session")).alias("quantity"))
    ends = b.lifecycle(spark, sf).where("delisting IS NOT NULL").select("entity", F.col("delisting").alias("effective"))
    out = signals.action_exceptions(_actions(spark, sf), F.lit("1995-01-01").cast("date"), holdings, ends)
    return out.select("entity", "event_at", "delisted_while_held")


STATUS = "st AS (SELECT user_id AS entity, CAST(ts AS DATE) AS effective, CASE WHEN event_id % 5 = 0 THEN 'halted' WHEN event_id % 5 = 1 THEN 'last_trading_day' ELSE 'tradable' END AS status, CAST(ts AS DATE) AS available_at, CAST(ts AS DATE) + CAST(event_id % 3 AS INT) AS ingested_at, event_id FROM events)"


@query("j08_effective_status", STATUS, sql_text="SELECT entity, status, status IN ('tradable', 'last_trading_day') AS may_trade FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY effective DESC, available_at DESC, event_id DESC) AS k FROM st WHERE effective <= DATE '2024-01-20' AND available_at < DATE '2024-01-21' AND ingested_at < DATE '2024-01-21') WHERE k = 1")
def j08(spark, sf):
    e = b.table(spark, sf, "events")
    k = F.col("event_id") % 5
    day = F.to_date("ts")
    rows = e.select(F.col("user_id").alias("entity"), day.alias("effective"), F.when(k == 0, "halted").when(k == 1, "last_trading_day").otherwise("tradable").alias("status"), F.struct(day.alias("d"), "event_id").alias("available"), F.expr("date_add(to_date(ts), cast(event_id % 3 as int))").alias("ingested_at"))
    latest = rows.groupBy("entity", "effective", "ingested_at", F.col("available.d").alias("available_at")).agg(F.max(F.struct("available.event_id", "status")).alias("s"))
    one = latest.groupBy("entity", "effective", "available_at").agg(F.max_by(F.struct("s", "ingested_at"), F.when(F.col("ingested_at") < F.lit("2024-01-21").cast("date"), F.col("s.event_id"))).alias("x"))
    return signals.effective_status(one.select("entity", "effective", "available_at", F.col("x.s.status").alias("status"), F.col("x.ingested_at").alias("ingested_at")), F.lit("2024-01-20").cast("date"), F.lit("2024-01-21").cast("date"))


CELLS = "cells AS (SELECT l_partkey AS entity, CAST(date_trunc('month', l_shipdate) AS DATE) AS session, max(l_extendedprice) AS close, CASE WHEN sum(l_quantity) > 30 THEN sum(l_quantity) END AS volume FROM lineitem GROUP BY 1, 2), mem AS (SELECT session, entity FROM life JOIN months ON listing <= session AND (delisting IS NULL OR session < delisting))"


def _cells(spark, sf):
    q = F.sum("l_quantity")
    return b.table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("entity"), F.trunc("l_shipdate", "month").alias("session")).agg(F.max("l_extendedprice").alias("close"), F.when(q > 30, q).alias("volume"))


@query("j10_master_agreement", b.LIFE, b.MONTHS, CELLS, sql_text="""SELECT session, code, count(*) AS n FROM (SELECT session, entity, 'member_not_in_master' AS code FROM mem WHERE (session, entity) NOT IN (SELECT (session, entity) FROM cells) UNION ALL SELECT session, entity, 'master_not_member' FROM cells WHERE (session, entity) NOT IN (SELECT (session, entity) FROM mem)
UNION ALL SELECT session, entity, 'member_without_bar' FROM mem WHERE (session, entity) NOT IN (SELECT (session, entity) FROM cells WHERE volume IS NOT NULL)) GROUP BY session, code""")  # fmt: skip
def j10(spark, sf):
    cells = _cells(spark, sf)
    return landed.agreement_issues(pit.membership(b.lifecycle(spark, sf), b.months(spark, sf)), cells, cells).groupBy("session", "code").agg(F.count(F.lit(1)).alias("n"))


@query("j18_listing_coverage", b.LIFE, b.MONTHS, CELLS, sql_text="SELECT entity, count(*) AS listed_sessions FROM cells WHERE (session, entity) IN (SELECT (session, entity) FROM mem) GROUP BY entity")
def j18(spark, sf):
    return landed.listing_coverage(_cells(spark, sf), pit.membership(b.lifecycle(spark, sf), b.months(spark, sf)))


@query("j14_blocked_symbols", sql_text="SELECT symbol, CASE WHEN c THEN 'market_corporate_action_requires_review' ELSE 'market_adjustment_unknown' END AS code FROM (SELECT l_partkey AS symbol, coalesce(bool_or(f <> 1), false) AS c, bool_or(f IS NULL) AS u FROM (SELECT l_partkey, CASE WHEN l_discount > 0.09 THEN 0.5 WHEN l_tax < 0.075 THEN 1.0 END AS f FROM lineitem) GROUP BY l_partkey) WHERE c OR u")
def j14(spark, sf):
    factor = F.when(F.col("l_discount") > 0.09, 0.5).when(F.col("l_tax") < 0.075, 1.0)
    return ledger.blocked_symbols(b.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("symbol"), factor.alias("factor")))


REFS = """refs AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'stock_split' WHEN 1 THEN 'reverse_split' WHEN 2 THEN 'dividend' ELSE 'merger' END AS kind, CAST(o_orderdate AS DATE) AS effective, (o_custkey % 5) / 2.0 AS ratio, (o_custkey % 3)::DOUBLE AS cash, CAST(o_orderdate AS DATE) + CAST(o_custkey % 7 AS INT) - 1 AS payment FROM orders)"""


@query("f09_reference_rules", CALENDAR, REFS, sql_text="""SELECT errors, count(*) AS n FROM (SELECT array_to_string(list_sort(list_filter([CASE WHEN kind = 'merger' THEN 'unknown_kind' END, CASE WHEN effective NOT IN (SELECT day FROM cal WHERE state = 'open') THEN 'effective_day_closed' END, CASE WHEN (kind = 'stock_split' AND ratio <= 1) OR (kind = 'reverse_split' AND NOT (ratio > 0 AND ratio < 1)) THEN 'invalid_ratio' END,
  CASE WHEN kind = 'dividend' AND cash <= 0 THEN 'invalid_cash' END, CASE WHEN kind = 'dividend' AND payment < effective THEN 'payment_before_effective' END], lambda x: x IS NOT NULL)), ',') AS errors FROM refs) GROUP BY errors""")  # fmt: skip
def f09(spark, sf):
    return quality.reference_errors(_references(spark, sf), _calendar(spark, sf)).groupBy(F.array_join("errors", ",").alias("errors")).agg(F.count(F.lit(1)).alias("n"))


def _references(spark, sf):
    k = F.col("o_orderkey") % 4
    return b.table(spark, sf, "orders").select(F.when(k == 0, "stock_split").when(k == 1, "reverse_split").when(k == 2, "dividend").otherwise("merger").alias("kind"), F.to_date("o_orderdate").alias("effective"), ((F.col("o_custkey") % 5) / 2.0).alias("ratio"), (F.col("o_custkey") % 3).cast("double").alias("cash"), F.expr("date_add(to_date(o_orderdate), cast(o_custkey % 7 as int) - 1)").alias("payment"))


@query("f10_tradable_bars", b.UBARS, sql_text="SELECT entity, session FROM ubars WHERE open > 0 AND high > 0 AND low > 0 AND close > 0 AND (day(session) % 3 <> 0 OR day(session) % 6 = 0)")
def f10(spark, sf):
    d = F.dayofmonth("session")
    bars = b.ubars(spark, sf).withColumn("factor", F.when(d % 3 == 0, 0.5).otherwise(1.0)).withColumn("available_at", F.date_add("session", 1))
    splits = bars.where(d % 6 == 0).select("entity", F.col("session").alias("effective"), F.lit(2.0).alias("ratio"))
    return quality.tradable_bars(bars, splits).select("entity", "session")


KNOWN_BARS = """kb AS (SELECT entity, session, 1 AS revision, close, session + 1 AS known FROM ubars UNION ALL SELECT entity, session, 2, close * 2, session + 9 FROM ubars WHERE day(session) % 4 = 0 UNION ALL SELECT entity, session, 3, -close, session + 12 FROM ubars WHERE day(session) % 5 = 0),
kn AS (SELECT entity, session, revision, close FROM kb WHERE known < DATE '2024-01-22' QUALIFY row_number() OVER (PARTITION BY entity, session ORDER BY known DESC) = 1)"""


@query("f10_known_bars", b.UBARS, KNOWN_BARS, sql_text="""SELECT entity, session, revision, round(close, 6) AS close FROM kn WHERE session < DATE '2024-01-22' AND CAST(entity AS BIGINT) % 6 <> 0 AND close > 0
  AND (day(session) % 3 <> 0 OR (day(session) % 6 = 0 AND session + 2 < DATE '2024-01-22'))""")
def f10_known(spark, sf):
    """Bars of most users as known on one day; later revisions are other or impossible prices, splits come two days late."""
    bars, d = b.ubars(spark, sf), F.dayofmonth("session")
    decision = F.lit("2024-01-22").cast("date")

    def revised(factor, days, k):
        known = F.date_add("session", days)
        prices = [(F.col("close") * factor).alias(c) for c in ("open", "high", "low", "close")]
        return F.struct(*prices, "volume", F.when(d % 3 == 0, 0.5).otherwise(1.0).alias("factor"), F.col("close").alias("value"), known.alias("available_at"), known.alias("ingested_at"), F.lit(k).alias("revision"))

    revisions = F.array_compact(F.array(revised(1.0, 1, 1), F.when(d % 4 == 0, revised(2.0, 9, 2)), F.when(d % 5 == 0, revised(-1.0, 12, 3))))
    rows = bars.select("entity", "session", F.inline(revisions))
    told = F.date_add("session", 2)
    splits = bars.where(d % 6 == 0).select("entity", F.col("session").alias("effective"), F.lit(2.0).alias("ratio"), told.alias("available_at"), told.alias("ingested_at"))
    members = bars.where(F.col("entity").cast("long") % 6 != 0)
    return quality.known_bars(rows, decision, members, splits).select("entity", "session", "revision", rounded(F.col("close"), 6).alias("close"))


@query("f16_snapshot_contract", b.TX, b.TXD, b.SNAP, sql_text="SELECT symbol, array_to_string(list_sort(list_filter([CASE WHEN symbol % 5 = 0 THEN 'invalid_price' END, CASE WHEN symbol % 3 = 0 THEN 'invalid_previous_close' END, CASE WHEN symbol % 2 = 0 THEN 'ingested_before_as_of' END, CASE WHEN symbol % 13 = 0 THEN 'identity_mismatch' END], lambda x: x IS NOT NULL)), ',') AS errors FROM snap")
def f16(spark, sf):
    s = F.col("symbol")
    rows = b.snapshots(spark, sf).select("symbol", F.when(s % 5 != 0, F.col("price").cast("double")).otherwise(0.0).alias("price"), F.when(s % 3 == 0, -1.0).alias("previous_close"), "as_of", F.when(s % 2 == 0, F.date_sub("as_of", 1)).otherwise(F.col("as_of")).alias("ingested_at"), "currency", F.when(s % 13 == 0, s + 1).otherwise(s).alias("asked_symbol"), F.col("currency").alias("asked_currency"))
    return quality.snapshot_errors(rows).select("symbol", F.array_join("errors", ",").alias("errors"))


@query("f17_event_contract", b.CEV, sql_text="SELECT array_to_string(list_sort(list_filter([CASE WHEN id % 7 = 0 THEN 'invalid_type' END, CASE WHEN status = 'tentative' THEN 'invalid_status' END, CASE WHEN id % 9 = 0 THEN 'invalid_date' END, CASE WHEN id % 4 = 1 THEN 'announcement_without_zone' END], lambda x: x IS NOT NULL)), ',') AS errors, count(*) AS n FROM cev GROUP BY 1")
def f17(spark, sf):
    rows = b.corporate_events(spark, sf).select(F.when(F.col("id") % 7 == 0, "split").otherwise(F.col("event_type")).alias("event_type"), "status", F.when(F.col("id") % 9 == 0, "soon").otherwise(F.col("event_date").cast("string")).alias("event_date"), F.concat(F.col("announced_at").cast("string"), F.when(F.col("id") % 4 == 1, "T09:00:00").otherwise("T09:00:00+09:00")).alias("announced_at"), F.create_map(F.lit("k"), F.lit("v")).alias("metadata"))
    return quality.event_errors(rows).groupBy(F.array_join("errors", ",").alias("errors")).agg(F.count(F.lit(1)).alias("n"))


MASTER = "master AS (SELECT strftime(ts, '%Y-%m-%d') AS requested, CASE WHEN event_id % 50 = 0 THEN '2000-01-01' ELSE strftime(ts, '%Y-%m-%d') END AS d, CASE WHEN event_id % 70 = 0 THEN '' ELSE user_id::VARCHAR END AS code, event_type = 'click' AS ordinary FROM events)"


#: What each check counts, in SQL: the rules of S10, F08, F09, F12, J10 and of the run's own parameters.
PREFLIGHT = {"lot": 100, "participation": 0.1, "position_cap": 0.2, "cash_reserve": 0.1, "fees": 10.0, "slippage": 5.0}
READY = {
    "master": "SELECT count(*) FROM (SELECT CASE WHEN d <> requested THEN 1 WHEN code = '' THEN 1 WHEN count(*) OVER (PARTITION BY requested, code) > 1 THEN 1 END AS bad FROM master) WHERE bad = 1",
    "calendar": "SELECT count(*) FROM (SELECT day FROM cal WHERE state = 'open' AND year(day) = 1995 AND day NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders) UNION ALL SELECT DISTINCT CAST(o_orderdate AS DATE) FROM orders WHERE year(o_orderdate) = 1995 AND CAST(o_orderdate AS DATE) NOT IN (SELECT day FROM cal WHERE state = 'open'))",
    "references": "SELECT count(*) FROM refs WHERE kind = 'merger' OR effective NOT IN (SELECT day FROM cal WHERE state = 'open') OR (kind = 'stock_split' AND ratio <= 1) OR (kind = 'reverse_split' AND NOT (ratio > 0 AND ratio < 1)) OR (kind = 'dividend' AND (cash <= 0 OR payment < effective))",
    "sealed_periods": "SELECT count(*) FROM obs WHERE (event_at BETWEEN DATE '1992-01-01' AND DATE '1994-12-31' AND ingested_at > DATE '1994-12-31') OR (event_at BETWEEN DATE '1995-01-01' AND DATE '1996-12-31' AND ingested_at > DATE '1996-12-31')",
    "membership": "SELECT (SELECT count(*) FROM mem WHERE (session, entity) NOT IN (SELECT (session, entity) FROM cells)) + (SELECT count(*) FROM cells WHERE (session, entity) NOT IN (SELECT (session, entity) FROM mem)) + (SELECT count(*) FROM mem WHERE (session, entity) NOT IN (SELECT (session, entity) FROM cells WHERE volume IS NOT NULL))",
    "parameters": "SELECT 0",
}


@query("f19_preflight", CALENDAR, REFS, MASTER, b.OBS, b.LIFE, b.MONTHS, CELLS, sql_text=" UNION ALL ".join(f"SELECT '{name}' AS \"check\", CAST(({text}) AS BIGINT) AS failures" for name, text in READY.items()))
def f19(spark, sf):
    """All failures of the inputs of a run, check by check, before anything is computed."""
    calendar, cells = _calendar(spark, sf), _cells(spark, sf)
    sessions = b.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("session")).where("session between date'1995-01-01' and date'1995-12-31'").distinct()
    periods = spark.sql("SELECT * FROM VALUES ('development', date'1992-01-01', date'1994-12-31'), ('validation', date'1995-01-01', date'1996-12-31') AS v(period, a, z)")
    crossing = datasets.rows_by_period(b.observations(spark, sf), periods).where("crossing > 0").select(F.explode(F.sequence(F.lit(1).cast("long"), F.col("crossing"))))
    return landed.preflight([
        ("master", landed.master_issues(_master(spark, sf)).where("code_issue IS NOT NULL")),
        ("calendar", calendars.session_set_issues(sessions, calendar, "1995-01-01", "1995-12-31")),
        ("references", quality.reference_errors(_references(spark, sf), calendar).where(F.size("errors") > 0)),
        ("sealed_periods", crossing),
        ("membership", landed.agreement_issues(pit.membership(b.lifecycle(spark, sf), b.months(spark, sf)), cells, cells)),
        ("parameters", landed.parameter_errors(spark, **PREFLIGHT)),
    ])


DIVIDENDS = "hold AS (SELECT entity, session, volume AS quantity FROM ubars), div AS (SELECT entity, min(session) + 5 AS effective, min(session) + 12 AS payment, 2.0::DOUBLE AS cash FROM ubars GROUP BY entity)"


@query("v10_dividend_receivables", b.UBARS, DIVIDENDS, sql_text="SELECT h.entity, h.session, CASE WHEN h.session >= effective AND h.session < payment THEN coalesce((SELECT arg_max(x.quantity, x.session) FROM hold x WHERE x.entity = h.entity AND x.session < d.effective), 0) * cash ELSE 0 END AS receivable FROM hold h JOIN div d ON d.entity = h.entity")
def v10(spark, sf):
    hold = b.ubars(spark, sf).select("entity", "session", F.col("volume").alias("quantity"))
    div = hold.groupBy("entity").agg(F.date_add(F.min("session"), 5).alias("effective"), F.date_add(F.min("session"), 12).alias("payment"), F.lit(2.0).alias("cash"))
    return signals.dividend_receivables(hold, div)


@query("a19_artifact_inventory", sql_text="SELECT run_id, name, CASE WHEN p IS NULL THEN 'missing' WHEN e IS NULL THEN 'unexpected' ELSE 'digest_differs' END AS code FROM (SELECT o_custkey AS run_id, o_orderkey AS name, o_orderstatus AS e FROM orders WHERE o_orderstatus <> 'P') FULL JOIN (SELECT o_custkey AS run_id, o_orderkey AS name, CASE WHEN o_totalprice > 400000 THEN 'x' ELSE o_orderstatus END AS p FROM orders WHERE o_orderstatus <> 'F') USING (run_id, name) WHERE p IS NULL OR e IS NULL OR p <> e")
def a19(spark, sf):
    o = b.table(spark, sf, "orders").select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("name"), F.col("o_orderstatus").alias("digest"), "o_totalprice")
    present = o.where("digest <> 'F'").withColumn("digest", F.when(F.col("o_totalprice") > 400000, "x").otherwise(F.col("digest")))
    return landed.inventory_issues(o.where("digest <> 'P'"), present)


@query("s10_master_issues", MASTER, sql_text="SELECT requested, code_issue, ordinary, count(*) AS n FROM (SELECT *, CASE WHEN d <> requested THEN 'wrong_date' WHEN code = '' THEN 'invalid_code' WHEN count(*) OVER (PARTITION BY requested, code) > 1 THEN 'repeated_code' END AS code_issue FROM master) GROUP BY ALL")
def s10(spark, sf):
    return landed.master_issues(_master(spark, sf)).groupBy("requested", "code_issue", "ordinary").agg(F.count(F.lit(1)).alias("n"))


def _master(spark, sf):
    day, k = F.date_format("ts", "yyyy-MM-dd"), F.col("event_id")
    return b.table(spark, sf, "events").select(day.alias("requested"), F.when(k % 50 == 0, "2000-01-01").otherwise(day).alias("Date"), F.when(k % 70 == 0, "").otherwise(F.col("user_id").cast("string")).alias("Code"), F.when(F.col("event_type") == "click", "011").otherwise("012").alias("ProdCat"))


@query("s03_pagination", sql_text="""SELECT u AS path, code FROM (WITH p AS (SELECT user_id AS u, lag(event_id) OVER w AS asked, CASE WHEN lead(event_id) OVER w IS NOT NULL THEN CASE WHEN user_id % 10 = 3 AND row_number() OVER w = 2 THEN -event_id ELSE event_id END END AS nxt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT DISTINCT u::VARCHAR AS u, 'dangling_cursor' AS code FROM p a WHERE asked IS NOT NULL AND NOT EXISTS (SELECT 1 FROM p g WHERE g.u = a.u AND g.nxt = a.asked) UNION ALL SELECT DISTINCT u::VARCHAR, 'missing_page' FROM p g WHERE nxt IS NOT NULL AND NOT EXISTS (SELECT 1 FROM p a WHERE a.u = g.u AND g.nxt = a.asked))""")  # fmt: skip
def s03(spark, sf):
    w = W.partitionBy("user_id").orderBy("event_id")
    k = F.col("event_id")
    rows = b.table(spark, sf, "events").select("user_id", F.lag("event_id").over(w).alias("asked"), F.when(F.lead("event_id").over(w).isNotNull(), F.when((F.col("user_id") % 10 == 3) & (F.row_number().over(w) == 2), -k).otherwise(k)).alias("next"))
    none = F.create_map().cast("map<string,string>")
    pages = rows.select(F.col("user_id").cast("string").alias("path"), F.when(F.col("asked").isNotNull(), F.create_map(F.lit("pagination_key"), F.col("asked").cast("string"))).otherwise(none).alias("params"), F.struct(F.col("next").cast("string").alias("pagination_key")).alias("response"))
    return landed.pagination_issues(pages).select("path", "code")


FORWARD = """fw AS (SELECT entity AS run, session, 1000 * close / first_value(close) OVER w AS equity, 1000 * open / first_value(open) OVER w AS base FROM bars WINDOW w AS (PARTITION BY entity ORDER BY session)),
fr AS (SELECT *, equity / lag(equity, 1, 1000.0::DOUBLE) OVER w - base / lag(base, 1, 1000.0::DOUBLE) OVER w AS value, row_number() OVER w - 1 AS i FROM fw WINDOW w AS (PARTITION BY run ORDER BY session)),
series AS (SELECT run, i, value FROM fr)"""


@query("t06_forward_report", b.BARS, FORWARD, _bounds_sql(500, 5, 1, 12, 487), sql_text="SELECT run, sessions, round(rel, 6) AS relative_return, round(CASE WHEN sessions >= 60 THEN lower END, 6) AS lower, round(CASE WHEN sessions >= 60 THEN upper END, 6) AS upper, CASE WHEN sessions < 60 THEN 'insufficient_forward_history' END AS reason FROM (SELECT run, count(*) AS sessions, arg_max(equity, session) / 1000 - arg_max(base, session) / 1000 AS rel FROM fr GROUP BY run) LEFT JOIN bounds USING (run)")
def t06(spark, sf):
    bars = b.bars(spark, sf)
    first = W.partitionBy("entity").orderBy("session")
    path = lambda c: bars.select(F.col("entity").alias("run"), "session", (1000 * F.col(c) / F.first(c).over(first)).alias("equity"))
    out = forward.report(path("close"), path("open"), 1000.0, 5)
    return out.select("run", "sessions", *[rounded(F.col(c), 6).alias(c) for c in ("relative_return", "lower", "upper")], "reason")


def _landed(spark, rows) -> str:
    """``rows`` written as a folder of files, for streams to read."""
    path = f"{new_folder(spark)}/landed"
    rows.write.parquet(path)
    return path


def _stream(spark, sf):
    """The events table as a stream of observation records."""
    events = b.table(spark, sf, "events")
    rows = spark.readStream.schema(events.schema).option("maxBytesPerTrigger", 1 << 30).parquet(_landed(spark, events))
    return rows.select(F.sha2(F.concat_ws("|", "user_id", "event_type", F.to_date("ts")), 256).alias("digest"), F.col("ts").cast("timestamp").alias("ingested_at"), F.to_date("ts").alias("day"), "user_id")


@query("t01_stream_ingest", sql_text="SELECT count(*) AS records, count(DISTINCT digest) AS digests FROM (SELECT DISTINCT sha256(concat_ws('|', user_id, event_type, CAST(ts AS DATE))) AS digest FROM events)")
def t01(spark, sf):
    out = new_folder(spark)
    forward.ingest(_stream(spark, sf), f"{out}/rows", f"{out}/state", "60 days").awaitTermination()
    return spark.read.parquet(f"{out}/rows").agg(F.count(F.lit(1)).alias("records"), F.count_distinct("digest").alias("digests"))


@query("t02_stream_late_data", sql_text="SELECT sum(CASE WHEN d >= DATE '2024-01-10' THEN 1 ELSE 0 END)::BIGINT AS accepted, sum(CASE WHEN d < DATE '2024-01-10' THEN 1 ELSE 0 END)::BIGINT AS rejected FROM (SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS d FROM events)")
def t02(spark, sf):
    out = new_folder(spark)
    forward.ingest_checked(_stream(spark, sf), f"{out}/accepted", f"{out}/rejected", f"{out}/state", F.lit("2024-01-10").cast("timestamp"), "day").awaitTermination()
    counts = [spark.read.parquet(f"{out}/{name}").agg(F.count(F.lit(1)).alias(name)) for name in ("accepted", "rejected")]
    return counts[0].crossJoin(counts[1])  # one row each


@query("t03_stream_revisions", b.OBS, sql_text=_asof_sql(ELIGIBLE))
def t03(spark, sf):
    """Observations come in as a stream; the log is compacted at an earlier decision and then asked for a later one."""
    out, rows = new_folder(spark), b.observations(spark, sf)
    stream = spark.readStream.schema(rows.schema).option("maxBytesPerTrigger", 1 << 30).parquet(_landed(spark, rows))
    forward.latest_revisions(stream, f"{out}/log", f"{out}/state").awaitTermination()
    log = forward.compacted(spark.read.schema(rows.schema).parquet(f"{out}/log"), F.lit("1995-01-01").cast("date"))
    return forward.current_revisions(log, F.lit(DECISION).cast("date"))


DECIDED = f"""days AS (SELECT session, row_number() OVER (ORDER BY session) AS o FROM (SELECT DISTINCT CAST(ts AS DATE) AS session FROM events)),
made AS (SELECT CAST(u.user_id AS VARCHAR) AS series, u.user_id, d.session, d.o, count(e.user_id) AS n,
  epoch_us(CAST(d.session AS TIMESTAMP) + CASE WHEN u.user_id % 10 = 5 AND o = 2 THEN INTERVAL 1 HOUR ELSE INTERVAL 12 HOUR END) AS micros
  FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN days d LEFT JOIN events e ON e.user_id = u.user_id AND CAST(e.ts AS DATE) = d.session WHERE NOT (u.user_id % 10 = 3 AND o = 5) GROUP BY ALL),
sent AS (SELECT *, sha256(concat_ws('|', session, micros, sha256(CAST(n AS VARCHAR)))) AS digest, CASE WHEN user_id % 10 = 3 THEN 4 WHEN user_id % 10 = 5 THEN 1 ELSE 1000000 END AS good FROM made),
link(series, k, head) AS (SELECT DISTINCT series, 0::BIGINT, '{forward.GENESIS}' FROM sent UNION ALL SELECT l.series, s.o, sha256(l.head || '|' || s.o || '|' || s.digest) FROM link l JOIN sent s ON s.series = l.series AND s.o = l.k + 1 AND s.o <= s.good)"""


@query("t04_stream_decisions", DECIDED, sql_text="""SELECT series, max(k) AS entries, arg_max(head, k) AS head, coalesce(any_value(codes), '') AS codes FROM link LEFT JOIN
  (SELECT series, CASE WHEN good = 1 THEN 'not_next_session ' || (count(*) - 2) || ',session_not_closed 1' ELSE 'not_next_session ' || (count(*) - 4) END AS codes FROM sent WHERE good < 1000 GROUP BY series, good) USING (series) WHERE k > 0 GROUP BY series""")
def t04(spark, sf):
    """Each user's count of every day as decisions of a series; the stream is stopped half way and started again.

    One series in ten lacks its fifth session, and one has its second one generated before the day's cutoff.
    """
    out, events = new_folder(spark), b.table(spark, sf, "events").select("user_id", F.to_date("ts").alias("session"))
    days = written(events.select("session").distinct().withColumn("ordinal", F.row_number().over(W.orderBy("session"))), "sessions")  # one row a day
    cutoff = F.to_timestamp(F.concat(F.col("session").cast("string"), F.lit("T18:00:00+09:00")))
    counts = events.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"))
    grid = events.select("user_id").distinct().crossJoin(F.broadcast(days.agg(F.collect_list(F.struct("session", "ordinal")).alias("d"))))  # one row
    grid = grid.select("user_id", F.inline("d")).join(counts, ["user_id", "session"], "left")
    tens = F.col("user_id") % 10
    hours = F.when((tens == 5) & (F.col("ordinal") == 2), 1).otherwise(12)
    made = F.col("session").cast("timestamp") + F.make_dt_interval(hours=hours)
    body = F.sha2(F.coalesce("n", F.lit(0)).cast("string"), 256)
    rows = grid.where((tens != 3) | (F.col("ordinal") != 5)).select(F.col("user_id").cast("string").alias("series"), "session", "ordinal", made.alias("generated_at"), body.alias("body"))
    for half in (F.col("ordinal") <= 15, F.col("ordinal") > 15):
        rows.where(half).write.mode("append").parquet(f"{out}/landed")
        stream = spark.readStream.schema(rows.schema).parquet(f"{out}/landed")
        forward.append_decisions(stream, days.withColumn("cutoff", cutoff), f"{out}/rows", f"{out}/state").awaitTermination()
    done = forward.read_decisions(spark, f"{out}/rows")
    codes = done.where("NOT accepted").groupBy("series", "code").agg(F.concat_ws(" ", "code", F.count(F.lit(1))).alias("c"))
    codes = codes.groupBy("series").agg(F.array_join(F.sort_array(F.collect_list("c")), ",").alias("codes"))
    heads = ledger.chain_heads(done.where("accepted"), "series")
    return heads.join(codes, "series", "left").withColumn("codes", F.coalesce("codes", F.lit("")))
