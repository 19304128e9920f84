"""Ledger, valuation, alerts, account rebuild, chains."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalars import rounded
from tidemark.operators import ledger, pit, signals
from tidemark.plans.pit import DECISION, ELIGIBLE
from tidemark.plans.registry import registry
from tidemark.plans.signals import FILLS, _fills
from tidemark.sources import bindings as b
from tidemark.sources.folders import written

QUERIES, SQL, query = registry()

#: The replay in SQL, in integers of 1e-12: one recursive step a transaction of each symbol.
REPLAY = """n AS (SELECT *, row_number() OVER (PARTITION BY symbol, currency ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, side, q, price_units, fee_units) AS k, max(executed_at) OVER (PARTITION BY symbol, currency) AS last_tx FROM txd),
fold(symbol, currency, k, held, cost, realized, oversold, last_tx) AS (
  SELECT symbol, currency, 0::BIGINT, 0::HUGEINT, 0::HUGEINT, 0::HUGEINT, 0::BIGINT, any_value(last_tx) FROM n GROUP BY symbol, currency
  UNION ALL
  SELECT f.symbol, f.currency, n.k, CASE WHEN n.side = 'buy' THEN held + q WHEN q > held THEN held ELSE held - q END,
    CASE WHEN n.side = 'buy' THEN cost + q * price_units::HUGEINT + fee_units WHEN q > held THEN cost WHEN q = held THEN 0 ELSE cost - (2 * cost * q + held) // (2 * held) END,
    CASE WHEN n.side = 'buy' OR q > held THEN realized ELSE realized + q * price_units::HUGEINT - fee_units - CASE WHEN q = held THEN cost ELSE (2 * cost * q + held) // (2 * held) END END,
    f.oversold + CASE WHEN n.side = 'sell' AND q > held THEN 1 ELSE 0 END, f.last_tx
  FROM fold f JOIN n ON n.symbol = f.symbol AND n.currency = f.currency AND n.k = f.k + 1),
pos AS (SELECT symbol, currency, held, cost, realized, oversold, last_tx FROM fold QUALIFY row_number() OVER (PARTITION BY symbol, currency ORDER BY k DESC) = 1)"""

#: Snapshots older than this are stale; those of every seventh symbol lie in the future.
MAX_AGE = 4000
AS_OF = "2000-01-01"
SNAPS = "snaps AS (SELECT symbol, currency, price_units AS price, CASE WHEN symbol % 7 = 0 THEN as_of + 3000 WHEN symbol % 7 < 4 THEN as_of + 300 ELSE as_of END AS as_of, CASE WHEN symbol % 4 <> 0 THEN price_units // 2 END AS previous_close, CASE WHEN symbol % 11 = 0 THEN DATE '" + AS_OF + "' + 1 END AS ingested_at FROM snap)"
VALUED = f"""valued AS (SELECT *, CASE WHEN status = 'ok' THEN held * price WHEN status = 'closed' THEN 0 END AS market_value FROM (SELECT p.*, s.price, s.previous_close, CASE WHEN p.held = 0 THEN 'closed' WHEN s.price IS NULL THEN 'missing' WHEN s.as_of > DATE '{AS_OF}' OR s.ingested_at > DATE '{AS_OF}' THEN 'future'
  WHEN DATE '{AS_OF}' - s.as_of > {MAX_AGE} THEN 'stale' WHEN s.as_of < p.last_tx THEN 'before_transaction' ELSE 'ok' END AS status FROM pos p LEFT JOIN snaps s USING (symbol, currency))),
u AS (SELECT *, CASE WHEN status = 'closed' THEN 0 ELSE market_value - cost END AS unrealized, CASE WHEN status = 'ok' THEN (market_value - cost)::DOUBLE / nullif(cost, 0)::DOUBLE END AS unrealized_pct, CASE WHEN status = 'ok' THEN (price - previous_close)::DOUBLE / nullif(previous_close, 0)::DOUBLE END AS daily_move FROM valued),
tot AS (SELECT currency, sum(cost) AS total_cost, sum(realized) AS realized_pnl, sum(coalesce(market_value, 0)) AS known, bool_and(NOT (held > 0 AND status <> 'ok')) AS complete, array_to_string(list_sort(list(symbol) FILTER (held > 0 AND status <> 'ok')), ',') AS unpriced FROM u GROUP BY currency),
w AS (SELECT u.*, u.market_value::DOUBLE / CASE WHEN complete AND known > 0 THEN known END::DOUBLE AS portfolio_weight FROM u JOIN tot USING (currency))"""
BASE = (b.TX, b.TXD, b.SNAP, REPLAY, SNAPS, VALUED)
THRESHOLDS = {"take_profit_threshold": 20.0, "loss_warning_threshold": -10.0, "daily_move_threshold": 11.0, "concentration_threshold": 5.0}


def _positions(spark, sf):
    return ledger.positions(b.ledger_rows(spark, sf), b.LINE_ORDER)


def _valued(spark, sf):
    s, k = b.snapshots(spark, sf), F.col("symbol") % 7
    days = F.when(k == 0, 3000).when(k < 4, 300).otherwise(0)
    half = (F.floor(F.col("price").cast("decimal(24,12)") * F.lit(500_000_000_000).cast("decimal(12,0)")).cast("decimal(24,0)") * F.lit("0.000000000001").cast("decimal(13,12)")).cast(ledger.MONEY)
    s = s.withColumn("ingested_at", F.when(F.col("symbol") % 11 == 0, F.date_add(F.lit(AS_OF).cast("date"), 1)))
    s = s.withColumn("as_of", F.date_add("as_of", days)).withColumn("previous_close", F.when(F.col("symbol") % 4 != 0, half))
    return ledger.valued(_positions(spark, sf), s, F.lit(AS_OF).cast("date"), MAX_AGE)


def _r(df, *columns, digits=4):
    return df.withColumns({c: rounded(F.col(c), digits) for c in columns})


def _units(df, *columns):
    """Decimals as whole numbers of 1e-12, written out: they compare digit by digit."""
    return df.withColumns({c: (F.col(c) * F.lit(10**12).cast("decimal(13,0)")).cast("decimal(38,0)").cast("string") for c in columns})


def _text(*columns):
    return ", ".join(f"CAST({c} AS VARCHAR) AS {name}" for c, name in columns)


@query("a04_average_cost_ledger", b.TX, b.TXD, REPLAY, sql_text=f"SELECT symbol, currency, CAST(held AS BIGINT) AS quantity, {_text(('(2 * cost + held) // nullif(2 * held, 0)', 'average_cost'), ('cost', 'total_cost'), ('realized', 'realized_pnl'))}, oversold, last_tx FROM pos")
def a04(spark, sf):
    out = _units(_positions(spark, sf), "average_cost", "total_cost", "realized_pnl")
    return out.withColumn("quantity", F.col("quantity").cast("long"))


@query("a04_segmented_ledger", b.TX, b.TXD, REPLAY, sql_text=f"SELECT symbol, currency, CAST(held AS BIGINT) AS quantity, {_text(('cost', 'total_cost'), ('realized', 'realized_pnl'))}, oversold FROM pos")
def a04_segmented(spark, sf):
    """Every symbol as a hot one: cut where nothing is held, its segments folded apart."""
    out = _units(ledger.positions(b.ledger_rows(spark, sf), b.LINE_ORDER, hot_rows=0), "total_cost", "realized_pnl")
    return out.select("symbol", "currency", F.col("quantity").cast("long").alias("quantity"), "total_cost", "realized_pnl", "oversold")


@query("j12_valuation_status", *BASE, sql_text=f"SELECT symbol, currency, status AS valuation_status, {_text(('market_value', 'market_value'), ('unrealized', 'unrealized'))}, round(unrealized_pct, 9) AS unrealized_pct, round(daily_move, 9) AS daily_move FROM u")
def j12(spark, sf):
    v = _units(_r(_valued(spark, sf), "unrealized_pct", "daily_move", digits=9), "market_value", "unrealized")
    return v.select("symbol", "currency", "valuation_status", "market_value", "unrealized", "unrealized_pct", "daily_move")


@query("a05_currency_totals", *BASE, sql_text=f"SELECT currency, {_text(('total_cost', 'total_cost'), ('realized_pnl', 'realized_pnl'), ('known', 'known_market_value'), ('CASE WHEN complete THEN known END', 'market_value'), ('CASE WHEN complete THEN known - total_cost END', 'unrealized'))}, complete, coalesce(unpriced, '') AS unpriced_symbols FROM tot")
def a05(spark, sf):
    t = _units(ledger.currency_totals(_valued(spark, sf)), "total_cost", "realized_pnl", "known_market_value", "market_value", "unrealized")
    return t.withColumn("unpriced_symbols", F.array_join(F.col("unpriced_symbols").cast("array<string>"), ","))


@query("v14_portfolio_weights", *BASE, sql_text="SELECT symbol, currency, round(portfolio_weight, 6) AS portfolio_weight FROM w")
def v14(spark, sf):
    return _r(ledger.weighted(_valued(spark, sf)), "portfolio_weight", digits=6).select("symbol", "currency", "portfolio_weight")


ALERTS = """al AS (SELECT symbol, currency, status, unnest(['take_profit_threshold', 'loss_warning_threshold', 'daily_move_threshold', 'concentration_threshold']) AS rule, unnest(['info', 'warning', 'warning', 'warning']) AS severity, unnest([1, 2, 3, 4]) AS o, unnest([unrealized_pct, unrealized_pct, daily_move, portfolio_weight]) AS value,
  unnest([unrealized_pct >= 0.2, unrealized_pct <= -0.1, abs(daily_move) >= 0.11, portfolio_weight > 0.05]) AS triggered FROM w WHERE held > 0)"""


@query("v12_rule_alerts", *BASE, ALERTS, sql_text="SELECT symbol, currency, rule, severity, round(value, 4) AS value, triggered, CASE WHEN value IS NULL THEN 'price_or_weight_unavailable' WHEN triggered THEN 'configured_threshold_reached' ELSE 'configured_threshold_not_reached' END AS reason FROM al")
def v12(spark, sf):
    return _r(ledger.alerts(ledger.weighted(_valued(spark, sf)), THRESHOLDS), "value").select("symbol", "currency", "rule", "severity", "value", "triggered", "reason")


ASSESSED = """st AS (SELECT *, CASE WHEN status = 'ok' THEN 'fresh' WHEN status IN ('stale', 'missing') THEN status ELSE 'blocked' END AS state FROM al),
assessed AS (SELECT symbol, currency, state, coalesce(string_agg(CASE WHEN triggered THEN CASE WHEN rule IN ('daily_move_threshold', 'concentration_threshold') THEN replace(rule, '_threshold', '_warning') ELSE replace(rule, '_threshold', '') END END, ',' ORDER BY o), '') AS flags,
  coalesce(string_agg(CASE WHEN triggered IS NULL THEN CASE WHEN state = 'fresh' AND o = 3 THEN 'previous_close_unavailable' WHEN state = 'fresh' AND o = 4 THEN 'currency_valuation_incomplete' ELSE 'market_data_unavailable' END END, ',' ORDER BY o), '') AS reasons,
  CASE WHEN state = 'blocked' THEN 'critical' WHEN state <> 'fresh' OR bool_or(triggered IS NULL OR (triggered AND severity = 'warning')) THEN 'warning' ELSE 'info' END AS severity FROM st GROUP BY symbol, currency, state)"""


@query("v13_assessment", *BASE, ALERTS, ASSESSED, sql_text="SELECT * FROM assessed")
def v13(spark, sf):
    a = ledger.assessment(ledger.weighted(_valued(spark, sf)), THRESHOLDS)
    return a.withColumns({c: F.array_join(c, ",") for c in ("flags", "reasons")})


@query("a06_assessment_summary", *BASE, ALERTS, ASSESSED, sql_text="SELECT currency, count(*) AS positions, count(CASE WHEN state = 'stale' THEN 1 END) AS stale, count(CASE WHEN state = 'missing' THEN 1 END) AS missing, count(CASE WHEN state = 'blocked' THEN 1 END) AS blocked, coalesce(string_agg(CASE WHEN flags LIKE '%concentration%' THEN CAST(symbol AS VARCHAR) END, ',' ORDER BY symbol), '') AS concentrated FROM assessed GROUP BY currency")
def a06(spark, sf):
    s = ledger.assessment_summary(ledger.assessment(ledger.weighted(_valued(spark, sf)), THRESHOLDS))
    return s.withColumn("concentrated", F.array_join(F.col("concentrated").cast("array<string>"), ","))


@query("a20_portfolio_summary", *BASE, sql_text="SELECT (SELECT count(*) FROM tx) AS transactions, count(CASE WHEN held > 0 THEN 1 END) AS open_positions, count(CASE WHEN held = 0 THEN 1 END) AS closed_positions, string_agg(DISTINCT currency, ',' ORDER BY currency) AS currencies, (SELECT bool_and(complete) FROM tot) AS valuation_complete FROM u")
def a20(spark, sf):
    return ledger.portfolio_summary(b.transactions(spark, sf), _valued(spark, sf))


ECONOMIC = ["symbol", "side", "quantity", "executed_at", "l_orderkey", "l_linenumber"]
APPEND = """e AS (SELECT *, concat_ws('|', symbol, side, q, executed_at, l_orderkey, l_linenumber) AS content FROM txd),
old AS (SELECT * FROM e WHERE executed_at < DATE '1996-01-01'),
fresh AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY id) AS ni, row_number() OVER (PARTITION BY content ORDER BY id) AS ne FROM e WHERE executed_at >= DATE '1995-06-01'),
coded AS (SELECT *, CASE WHEN ni > 1 OR id IN (SELECT id FROM old) THEN 'duplicate_id' WHEN ne > 1 OR content IN (SELECT content FROM old) THEN 'duplicate_content' END AS code FROM fresh),
flow AS (SELECT symbol, currency, sum(CASE WHEN side = 'buy' THEN q ELSE -q END) OVER (PARTITION BY symbol, currency ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) AS held FROM (SELECT symbol, currency, side, q, l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM old UNION ALL SELECT symbol, currency, side, q, l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM coded WHERE code IS NULL)),
short AS (SELECT DISTINCT symbol, currency FROM flow WHERE held < 0)"""


@query("s14_ledger_append", b.TX, b.TXD, APPEND, sql_text="SELECT id, coalesce(code, CASE WHEN (symbol, currency) IN (SELECT (symbol, currency) FROM short) THEN 'oversell' END) AS code FROM coded")
def s14(spark, sf):
    """Every row of the batch with what keeps it out, or null."""
    tx = b.ledger_rows(spark, sf).withColumn("quantity", F.col("quantity").cast("long"))
    old, batch = tx.where("executed_at < date'1996-01-01'"), tx.where("executed_at >= date'1995-06-01'")
    return ledger.append_batch(old, batch, ECONOMIC, b.LINE_ORDER).select("id", "code")


@query("j11_trade_history", b.TX, FILLS, sql_text="SELECT f.id, f.symbol, o_orderstatus AS status, CAST(o_orderdate AS DATE) AS ordered_at FROM fills f JOIN orders ON o_orderkey = CAST(split_part(f.id, '|', 1) AS BIGINT)")
def j11(spark, sf):
    fills = _fills(spark, sf).withColumn("order_id", F.split("id", r"\|")[0].cast("long"))
    orders = b.table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_orderstatus").alias("status"), F.to_date("o_orderdate").alias("ordered_at"))
    return ledger.trade_history(fills, orders).select("id", "symbol", "status", "ordered_at")


FLOW = "flow AS (SELECT currency AS run, executed_at AS session, sum(CASE WHEN side = 'buy' THEN -cents ELSE cents END::HUGEINT * 10000000000 - fee_units) AS flow FROM txd GROUP BY 1, 2)"


@query("w15_account_rebuild", b.TX, b.TXD, FLOW, sql_text="SELECT run, session, CAST(1000000000::HUGEINT * 1000000000000 + sum(flow) OVER (PARTITION BY run ORDER BY session) AS VARCHAR) AS cash FROM flow")
def w15(spark, sf):
    fills = b.ledger_rows(spark, sf).select(F.col("currency").alias("run"), F.col("executed_at").alias("session"), "side", "notional", "fee")
    return _units(ledger.account(fills, 10**9), "cash")


EQUITY = """fe AS (SELECT l_returnflag || l_linestatus AS entity, CAST(date_trunc('month', l_shipdate) AS DATE) AS session, CASE WHEN side = 'sell' THEN -1 ELSE 1 END AS sg, q, cents::HUGEINT * 10000000000 AS notional, fee_units AS fee, price_units, l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM txd),
closes AS (SELECT entity, session, arg_max(price_units, {'a': l_shipdate, 'b': l_orderkey, 'c': l_linenumber, 'd': l_partkey, 'e': l_suppkey}) AS close FROM fe GROUP BY 1, 2),
cells AS (SELECT e.entity, d.session, close FROM (SELECT DISTINCT entity FROM closes) e CROSS JOIN (SELECT DISTINCT session FROM closes) d LEFT JOIN closes c ON c.entity = e.entity AND c.session = d.session),
hold AS (SELECT entity, session, last_value(close IGNORE NULLS) OVER (PARTITION BY entity ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS mark, sum(coalesce(q, 0)) OVER (PARTITION BY entity ORDER BY session) AS q FROM cells LEFT JOIN (SELECT entity, session, sum(sg * q) AS q FROM fe GROUP BY 1, 2) h USING (entity, session)),
val AS (SELECT session, sum(q * coalesce(mark, 0)::HUGEINT) AS v FROM hold GROUP BY session), cash AS (SELECT session, sum(-sg * notional - fee) AS f FROM fe GROUP BY session)"""


@query("w16_equity_snapshots", b.TX, b.TXD, EQUITY, sql_text="SELECT session, CAST(1000000000::HUGEINT * 1000000000000 + sum(coalesce(f, 0)) OVER (ORDER BY session) + v AS VARCHAR) AS equity FROM val LEFT JOIN cash USING (session)")
def w16(spark, sf):
    rows = b.ledger_rows(spark, sf, F.concat("l_returnflag", "l_linestatus").alias("entity")).withColumn("session", F.trunc("executed_at", "month"))
    closes = rows.groupBy("entity", "session").agg(F.max_by("price", F.struct(*b.LINE_ORDER)).alias("close"))
    fills = rows.select("entity", "session", "side", "quantity", "notional", "fee")
    return _units(ledger.equity(fills, signals.stale_marks(closes), 10**9), "equity")


CHAIN = f"""chain AS (SELECT user_id, event_id, sha256(event_id || '|' || event_type) AS h, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
link(user_id, k, head) AS (SELECT DISTINCT user_id, 0::BIGINT, '{ledger.GENESIS}' FROM chain UNION ALL SELECT l.user_id, c.k, sha256(l.head || '|' || c.k || '|' || c.h) FROM link l JOIN chain c ON c.user_id = l.user_id AND c.k = l.k + 1),
heads AS (SELECT user_id, max(k) AS entries, arg_max(head, k) AS head FROM link GROUP BY user_id)"""
#: Entries between checkpoints; small, so that every series has several.
EVERY = 8


def _chain(spark, sf):
    return b.table(spark, sf, "events").select("user_id", "event_id", F.sha2(F.concat_ws("|", "event_id", "event_type"), 256).alias("h"))


def _entries(spark, sf):
    return ledger.chain_entries(_chain(spark, sf), "user_id", "event_id", "h")


@query("w12_chain_build", CHAIN, sql_text="SELECT * FROM heads")
def w12(spark, sf):
    return ledger.build_chain(_chain(spark, sf), "user_id", "event_id", "h")


@query("w12_chain_checkpoints", CHAIN, sql_text=f"SELECT user_id, k AS seq, head FROM link WHERE k > 0 AND k % {EVERY} = 0")
def w12_checkpoints(spark, sf):
    return ledger.chain_checkpoints(_entries(spark, sf), "user_id", EVERY)


ENTRIES = """ent AS (SELECT c.user_id, c.k, CASE WHEN c.user_id % 10 = 9 AND c.k = 3 THEN 'forged' ELSE c.h END AS h, CASE WHEN c.user_id % 10 = 3 AND c.k = 4 THEN 'x' ELSE b.head END AS previous, o.head AS entry
  FROM chain c JOIN link o ON o.user_id = c.user_id AND o.k = c.k JOIN link b ON b.user_id = c.user_id AND b.k = c.k - 1 WHERE NOT (c.user_id % 10 = 7 AND c.k = 2)),
judged AS (SELECT *, k = 1 OR coalesce(lag(k) OVER w = k - 1, false) AS s, previous = CASE WHEN k = 1 THEN '""" + ledger.GENESIS + """' ELSE coalesce(lag(entry) OVER w, '') END AS p, entry = sha256(previous || '|' || k || '|' || h) AS again FROM ent WINDOW w AS (PARTITION BY user_id ORDER BY k))"""


@query("w11_chain_verify", CHAIN, ENTRIES, sql_text="SELECT j.*, h.entries + CASE WHEN user_id % 10 = 1 THEN 1 ELSE 0 END = j.entries AS count_right, CASE WHEN user_id % 10 = 5 THEN 'y' ELSE h.head END = j.head AS head_right FROM (SELECT user_id, bool_and(s) AS contiguous, bool_and(p) AS linked, bool_and(again) AS hashes_right, count(*) AS entries, arg_max(entry, k) AS head FROM judged GROUP BY user_id) j JOIN heads h USING (user_id)")
def w11(spark, sf):
    """Chains with an entry that names another one before it, one that is missing, a forged one, and wrong records."""
    tens, entries = F.col("user_id") % 10, _entries(spark, sf)
    record = ledger.chain_heads(entries, "user_id")
    record = record.withColumns({"entries": F.col("entries") + F.when(tens == 1, 1).otherwise(0), "head": F.when(tens == 5, "y").otherwise(F.col("head"))})
    planted = entries.where((tens != 7) | (F.col("seq") != 2))
    planted = planted.withColumn("previous_hash", F.when((tens == 3) & (F.col("seq") == 4), "x").otherwise(F.col("previous_hash")))
    planted = planted.withColumn("digest", F.when((tens == 9) & (F.col("seq") == 3), "forged").otherwise(F.col("digest")))
    return ledger.verify_chain(planted, record, "user_id", EVERY)


@query("w11_chain_segments", CHAIN, sql_text=f"SELECT user_id, CAST(ceil(entries / {EVERY}) AS BIGINT) AS segments, CASE WHEN user_id % 10 = 9 AND entries >= 3 THEN 1 ELSE 0 END::BIGINT AS wrong_segments, entries, true AS count_right, NOT (user_id % 10 = 9 AND entries BETWEEN 3 AND {EVERY}) AS head_right FROM heads")
def w11_segments(spark, sf):
    """The third row of every tenth user is forged: its segment alone is wrong, also the head where it is the last one."""
    entries = written(_entries(spark, sf), "entries")
    forged = F.when((F.col("user_id") % 10 == 9) & (F.col("seq") == 3), "forged").otherwise(F.col("digest"))
    rows, record = entries.select("user_id", "seq", forged.alias("digest")), ledger.chain_heads(entries, "user_id")
    out = ledger.verify_segments(rows, ledger.chain_checkpoints(entries, "user_id", EVERY), record, "user_id", EVERY)
    return out.drop("head")


PAST = f"""past AS (SELECT *, row_number() OVER (PARTITION BY entity, event_at ORDER BY available_at DESC, ingested_at, revision DESC) AS k FROM obs WHERE {ELIGIBLE})"""


@query("t05_past_outputs", b.OBS, PAST, sql_text="SELECT entity, event_at, CAST(round(CASE WHEN side = 'recomputed' THEN value + 1 ELSE value END * 100) AS BIGINT) AS cents, revision, side FROM past CROSS JOIN (VALUES ('stored'), ('recomputed')) s(side) WHERE k = 1 AND entity % 50 = 7")
def t05(spark, sf):
    """A past decision's output, stored when it was made, against the same decision made again over all that came since.

    Rows that came later change nothing; rows that were written over since (every fiftieth entity) do.
    """
    rows, decision = b.observations(spark, sf), F.lit(DECISION).cast("date")
    known = rows.where(F.greatest("available_at", "ingested_at") < decision)
    changed = rows.withColumn("value", F.when(F.col("entity") % 50 == 7, F.col("value") + 1).otherwise(F.col("value")))
    decided = lambda df: pit.as_of(df, decision).select("entity", "event_at", F.round(F.col("value") * 100).cast("long").alias("cents"), "revision")
    stored = written(decided(known), "stored")
    return ledger.same_outputs(stored, decided(changed))
