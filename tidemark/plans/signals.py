"""Signals, features, labels, weights, orders and backtests."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalars import rounded
from tidemark.operators import calendars, signals
from tidemark.plans.registry import registry
from tidemark.sources import bindings as b

QUERIES, SQL, query = registry()

ORD_U = "ord AS (SELECT session, row_number() OVER (ORDER BY session) AS o FROM (SELECT DISTINCT session FROM ubars))"
GRID_U = "grid AS (SELECT e.entity, d.session, d.o, u.close, u.volume, u.entity IS NOT NULL AS there FROM (SELECT DISTINCT entity FROM ubars) e CROSS JOIN ord d LEFT JOIN ubars u ON u.entity = e.entity AND u.session = d.session)"
SPARSE = (b.UBARS, ORD_U, GRID_U)
RET = "ret AS (SELECT *, close / lag(close) OVER (PARTITION BY entity ORDER BY session) - 1 AS ret, row_number() OVER (PARTITION BY entity ORDER BY session) AS o FROM bars)"
RET_E = "ret AS (SELECT *, coalesce(close / lag(close) OVER (PARTITION BY entity ORDER BY session) - 1, 0) AS ret FROM ebars)"


def _r(df, *columns, digits=6):
    return df.withColumns({c: rounded(F.col(c), digits) for c in columns})


SCORE = "score AS (SELECT entity, session, close / lag(close, 3) OVER (PARTITION BY entity ORDER BY session) - 1 AS score FROM bars)"


@query("w01_momentum", b.BARS, SCORE, sql_text="SELECT entity, session, round(score, 6) AS score FROM score WHERE score IS NOT NULL")
def w01(spark, sf):
    return _r(signals.momentum(b.bars(spark, sf), 3), "score")


SPARSE_SCORE = "sparse AS (SELECT entity, session, CASE WHEN count(close) OVER (PARTITION BY entity ORDER BY session ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3 THEN close / lag(close, 2) OVER (PARTITION BY entity ORDER BY session) - 1 END AS score FROM grid)"


@query("w01_momentum_sparse", *SPARSE, SPARSE_SCORE, sql_text="SELECT entity, session, round(score, 6) AS score FROM sparse WHERE score IS NOT NULL")
def w01_sparse(spark, sf):
    return _r(signals.momentum(b.ubars(spark, sf), 2), "score")


TOP = "top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY score DESC, entity) AS rank FROM score WHERE score > 0) WHERE rank <= 2)"


@query("w02_top_n", b.BARS, SCORE, TOP, sql_text="SELECT entity, session, round(score, 6) AS score, rank FROM top")
def w02(spark, sf):
    return _r(signals.top_n(signals.momentum(b.bars(spark, sf), 3), 2), "score")


FEATURES = """features AS (SELECT entity, session, o, close / lag(close, 5) OVER w - 1 AS return_5, close / lag(close, 20) OVER w - 1 AS return_20, close / lag(close, 60) OVER w - 1 AS return_60,
  stddev_samp(ret) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS volatility_20, close / avg(close) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) - 1 AS ma_ratio_20,
  CASE WHEN lag(volume, 5) OVER w > 0 THEN volume / lag(volume, 5) OVER w - 1 END AS volume_change_5, count(close) OVER (w ROWS BETWEEN 60 PRECEDING AND CURRENT ROW) AS n FROM ret WINDOW w AS (PARTITION BY entity ORDER BY session))"""
NAMES = ("return_5", "return_20", "return_60", "volatility_20", "ma_ratio_20", "volume_change_5")


#: Universe and actions of the bars' entities: members from their second session on, one action after 66 months.
MEMBERS = "mem AS (SELECT entity, session FROM (SELECT *, min(session) OVER (PARTITION BY entity) AS a FROM bars) WHERE session > a OR entity LIKE '%F')"
CROSS = "cross_day AS (SELECT entity, CAST(min(session) + INTERVAL 66 MONTH AS DATE) AS effective FROM bars WHERE entity LIKE 'A%' GROUP BY entity)"
BROKEN = "EXISTS (SELECT 1 FROM cross_day x WHERE x.entity = {t}.entity AND x.effective > {t}.{a} AND x.effective <= {t}.{z})"


def _members(bars):
    first = F.min("session").over(W.partitionBy("entity"))
    return bars.withColumn("_a", first).where((F.col("session") > F.col("_a")) | F.col("entity").endswith("F")).select("entity", "session")


def _crossings(bars):
    return bars.where(F.col("entity").startswith("A")).groupBy("entity").agg(F.add_months(F.min("session"), 66).alias("effective"))


@query("w03_features", b.BARS, RET, FEATURES, MEMBERS, CROSS, sql_text=f"""SELECT entity, session, {', '.join(f'round({c}, 6) AS {c}' for c in NAMES)} FROM (SELECT f.*, lag(session, 60) OVER (PARTITION BY entity ORDER BY session) AS a FROM features f) f
WHERE n = 61 AND volume_change_5 IS NOT NULL AND (entity, a) IN (SELECT (entity, session) FROM mem) AND (entity, session) IN (SELECT (entity, session) FROM mem) AND NOT {BROKEN.format(t='f', a='a', z='session')}""")  # fmt: skip
def w03(spark, sf):
    bars = b.bars(spark, sf)
    return _r(signals.features(bars, members=_members(bars), actions=_crossings(bars), volume=True).drop("ord"), *NAMES)


CELLS = "cells AS (SELECT e.entity, d.session, bars.session AS own, sha256(concat_ws('|', bars.entity, bars.session, CAST(round(bars.close * 100) AS BIGINT))) AS digest FROM (SELECT DISTINCT entity FROM bars) e CROSS JOIN (SELECT DISTINCT session FROM bars) d LEFT JOIN bars ON bars.entity = e.entity AND bars.session = d.session)"
LINEAGE = ", ".join(
    f"max(greatest(own + 1, own + CAST(day(own + 400) % 3 AS INT))) OVER (w ROWS BETWEEN {k} PRECEDING AND CURRENT ROW) AS known_{name}, "
    f"sha256(array_to_string(list_filter(list(CASE WHEN own IS NOT NULL THEN concat_ws(':', own, entity || '@' || own, digest) END) OVER (w ROWS BETWEEN {k} PRECEDING AND CURRENT ROW), lambda x: x IS NOT NULL), ',')) AS sources_{name}"
    for name, k in signals.USES.items()
)


@query("w04_feature_lineage", b.BARS, CELLS, sql_text=f"SELECT entity, session, {LINEAGE} FROM cells WINDOW w AS (PARTITION BY entity ORDER BY session)")
def w04(spark, sf):
    bars = b.bars(spark, sf).withColumn("available_at", F.date_add("session", 1)).withColumn("ingested_at", F.expr("date_add(session, day(date_add(session, 400)) % 3)"))
    bars = bars.withColumn("revision", F.concat_ws("@", "entity", "session")).withColumn("digest", F.sha2(F.concat_ws("|", "entity", "session", F.round(F.col("close") * 100).cast("long")), 256))
    listed = lambda c: F.sha2(F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["session"], x["revision"], x["digest"])), ","), 256)
    return signals.feature_lineage(bars).withColumns({f"sources_{c}": listed(f"sources_{c}") for c in signals.USES})


#: Each month's close is known the next day; every third month it is revised two months later.
REVISED = "rev AS (SELECT entity, session, close, session + 1 AS known, 1 AS revision FROM bars UNION ALL SELECT entity, session, close * 1.01::DOUBLE, CAST(session + INTERVAL 2 MONTH AS DATE), 2 FROM bars WHERE month(session) % 3 = 0 UNION ALL SELECT entity, session, close * 1.5::DOUBLE, CAST(session + INTERVAL 6 MONTH AS DATE), 3 FROM bars)"


def _revisions(bars):
    row = lambda rows, close, known, k: rows.select("entity", "session", close.alias("close"), close.alias("value"), known.alias("available_at"), known.alias("ingested_at"), F.lit(k).alias("revision"))
    c = F.col("close")
    out = row(bars, c, F.date_add("session", 1), 1).union(row(bars.where(F.month("session") % 3 == 0), c * 1.01, F.add_months("session", 2), 2))
    return out.union(row(bars, c * 1.5, F.add_months("session", 6), 3))


@query("w05_forward_labels", b.BARS, REVISED, MEMBERS, CROSS, sql_text=f"""SELECT entity, session, "end", round(f, 6) AS forward_return, (f > 0)::INT AS y FROM (SELECT l.entity, l.session, l."end",
  (SELECT arg_max(close, revision) FROM rev WHERE rev.entity = l.entity AND rev.session = l."end" AND known < l."end" + 2) / (SELECT arg_max(close, revision) FROM rev WHERE rev.entity = l.entity AND rev.session = l.session AND known < l."end" + 2) - 1 AS f
  FROM (SELECT entity, session, lead(session, 3) OVER (PARTITION BY entity ORDER BY session) AS "end" FROM bars) l WHERE (l.entity, l.session) IN (SELECT (entity, session) FROM mem) AND (l.entity, l."end") IN (SELECT (entity, session) FROM mem) AND NOT {BROKEN.format(t='l', a='session', z='"end"')}) WHERE f IS NOT NULL""")  # fmt: skip
def w05(spark, sf):
    bars = b.bars(spark, sf)
    return _r(signals.forward_label(bars, 3, _members(bars), _crossings(bars), _revisions(bars), lag_days=2), "forward_return")


@query("w06_daily_returns", *SPARSE, sql_text="SELECT entity, session, round(close / lag(close) OVER (PARTITION BY entity ORDER BY session) - 1, 6) AS ret FROM grid")
def w06(spark, sf):
    return _r(signals.daily_returns(b.ubars(spark, sf)), "ret").select("entity", "session", "ret")


@query("w10_stale_marks", *SPARSE, sql_text="SELECT entity, session, round(last_value(close IGNORE NULLS) OVER (PARTITION BY entity ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS mark, close IS NULL AS stale FROM grid")
def w10(spark, sf):
    return _r(signals.stale_marks(b.ubars(spark, sf)), "mark")


NEXT = "nxt AS (SELECT entity, session, min(CASE WHEN close IS NOT NULL AND volume > 0 THEN session END) OVER (PARTITION BY entity ORDER BY session ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS fill_session FROM grid)"


@query("j07_next_tradable", *SPARSE, NEXT, sql_text="SELECT * FROM nxt")
def j07(spark, sf):
    return signals.next_tradable(b.ubars(spark, sf))


MISS = "miss AS (SELECT entity, session, o, CASE WHEN NOT there THEN 'api_gap' WHEN close IS NULL THEN 'missing_price' WHEN volume IS NULL THEN 'missing_volume' WHEN volume = 0 THEN 'trading_halt' END AS reason FROM grid)"


@query("a12_missing_data_events", *SPARSE, MISS, sql_text="SELECT entity, session, reason FROM miss")
def a12(spark, sf):
    return signals.missing_data_events(b.ubars(spark, sf))


@query("a13_halt_streaks", *SPARSE, MISS, sql_text="SELECT entity, min(session) AS start, count(*) AS length, count(*) > 5 AS stops FROM (SELECT *, o - row_number() OVER (PARTITION BY entity ORDER BY session) AS i FROM miss WHERE reason IS NOT NULL) GROUP BY entity, i")
def a13(spark, sf):
    bars = b.ubars(spark, sf)
    return signals.halt_streaks(signals.missing_data_events(bars), bars.select("session"))


FOLDS = "folds AS (SELECT i AS fold, p AS predict_from, least(p + 4, n - 1) AS predict_to, p - 3 - 5 AS validate_from, p - 4 AS validate_to, p - 6 - 5 - 20 AS train_from, p - 7 - 5 AS train_to FROM (SELECT n, unnest(generate_series(41, n - 1, 5)) AS p, unnest(range(len(generate_series(41, n - 1, 5)))) AS i FROM (SELECT count(DISTINCT session) AS n FROM bars)))"


#: Sessions of training, validation, step, horizon and warm-up.
WALK = {"train": 20, "validation": 5, "step": 5, "horizon": 3, "warmup": 10}


@query("w13_fold_table", b.BARS, FOLDS, sql_text="SELECT * FROM folds")
def w13_table(spark, sf):
    n = b.bars(spark, sf).agg(F.count_distinct("session").alias("n"))
    return n.select(F.inline(signals.walk_forward_folds(F.col("n"), **WALK)))


@query("w13_walk_forward_folds", b.BARS, FOLDS, sql_text="""SELECT fold, role, count(*) AS n, min(session) AS first, max(session) AS last FROM (SELECT f.fold, s.session, CASE WHEN o BETWEEN train_from AND train_to AND o + 3 < validate_from THEN 'train' WHEN o BETWEEN validate_from AND validate_to AND o + 3 < predict_from THEN 'validate' WHEN o BETWEEN predict_from AND predict_to THEN 'predict' END AS role
  FROM (SELECT session, o FROM (SELECT DISTINCT entity FROM bars) CROSS JOIN (SELECT session, row_number() OVER (ORDER BY session) - 1 AS o FROM (SELECT DISTINCT session FROM bars))) s JOIN folds f ON o BETWEEN train_from AND predict_to) WHERE role IS NOT NULL GROUP BY fold, role""")  # fmt: skip
def w13(spark, sf):
    samples = signals.on_grid(b.bars(spark, sf)).select("entity", "session", (F.col("ord") - 1).alias("ord"), (F.col("ord") + 2).alias("label_ord"))
    n = b.bars(spark, sf).agg(F.count_distinct("session").alias("sessions"))
    samples = samples.crossJoin(F.broadcast(n))  # one row
    return signals.fold_samples(samples, F.col("sessions"), **WALK).groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"), F.min("session").alias("first"), F.max("session").alias("last"))


@query("v01_equal_weights", b.UBARS, sql_text="SELECT session, entity, round(1.0::DOUBLE / count(*) OVER (PARTITION BY session), 8) AS weight FROM ubars WHERE close IS NOT NULL")
def v01(spark, sf):
    return _r(signals.equal_weights(b.ubars(spark, sf)), "weight", digits=8)


@query("v01_momentum_weights", b.BARS, SCORE, TOP, sql_text="SELECT session, entity, round(1.0::DOUBLE / count(*) OVER (PARTITION BY session), 8) AS weight FROM top")
def v01_momentum(spark, sf):
    return _r(signals.selected_weights(signals.top_n(signals.momentum(b.bars(spark, sf), 3), 2)), "weight", digits=8)


@query("v01_hold_weights", b.EBARS, sql_text="SELECT session, entity, round(1.0::DOUBLE / count(*) OVER (PARTITION BY session), 8) AS weight FROM ebars WHERE session = (SELECT min(s) FROM (SELECT min(session) AS s FROM ebars GROUP BY date_trunc('week', session)))")
def v01_hold(spark, sf):
    bars = b.ebars(spark, sf)
    return _r(signals.hold_weights(bars, calendars.rebalance_sessions(bars)), "weight", digits=8)


WEIGHTED = "weighted AS (SELECT entity, session, close, 1.0::DOUBLE / count(*) OVER (PARTITION BY session) AS weight FROM bars)"


@query("v02_lot_orders", b.BARS, WEIGHTED, sql_text="SELECT entity, session, target, target - coalesce(lag(target) OVER (PARTITION BY entity ORDER BY session), 0) AS \"order\" FROM (SELECT *, CAST(floor(100000000 * least(weight, 0.25) / close / 100) * 100 AS BIGINT) AS target FROM weighted)")
def v02(spark, sf):
    bars = b.bars(spark, sf)
    weights = signals.equal_weights(bars).join(bars.select("entity", "session", "close"), ["entity", "session"])
    return signals.lot_orders(weights, 100_000_000.0, 0.25, 100).select("entity", "session", F.col("target").cast("long").alias("target"), F.col("order").cast("long").alias("order"))


FILLS = "fills AS (SELECT id, symbol, side, quantity, price AS reference, price * (1 + CASE WHEN side = 'buy' THEN 1 ELSE -1 END * 5.0::DOUBLE / 10000) AS px FROM tx)"


def _fills(spark, sf):
    return signals.execution(b.transactions(spark, sf).select("id", "symbol", "currency", "side", "quantity", F.col("price").alias("reference"), "executed_at"), 5.0, 10.0)


@query("v03_execution_costs", b.TX, FILLS, sql_text="SELECT id, round(px * quantity, 6) AS notional, round(px * quantity * 10 / 10000, 9) AS commission, round(abs(px - reference) * quantity, 6) AS slippage_cost FROM fills")
def v03(spark, sf):
    return _r(_r(_fills(spark, sf), "notional", "slippage_cost"), "commission", digits=9).select("id", "notional", "commission", "slippage_cost")


@query("v04_affordable_lots", sql_text="SELECT o_orderkey, CAST(greatest(0, floor((o_totalprice - 1000 - 10) / ((1000 + o_custkey % 97) * 1.001::DOUBLE * 10))) * 10 AS BIGINT) AS shares FROM orders")
def v04(spark, sf):
    shares = signals.affordable_lots(F.col("o_totalprice"), (1000 + F.col("o_custkey") % 97), F.lit(1000), 10, 0.001, 10)
    return b.table(spark, sf, "orders").select("o_orderkey", shares.cast("long").alias("shares"))


@query("v05_position_headroom", sql_text="SELECT o_orderkey, CAST(greatest(0, floor((0.25::DOUBLE * (o_totalprice - 10) - (o_orderkey % 7) * 10) / ((10 + 0.25::DOUBLE * (0.5 + 10.5 * 0.001::DOUBLE)) * 10))) * 10 AS BIGINT) AS shares FROM orders")
def v05(spark, sf):
    shares = signals.headroom_lots(F.col("o_totalprice"), F.col("o_orderkey") % 7, F.lit(10), F.lit(10.5), 0.25, 10, 0.001, 10)
    return b.table(spark, sf, "orders").select("o_orderkey", shares.cast("long").alias("shares"))


@query("v06_participation", sql_text="""SELECT id, CAST(least(requested, greatest(0, floor((floor(volume * 0.1::DOUBLE) - coalesce(used, 0)) / 10) * 10)) AS BIGINT) AS allowed FROM (SELECT *, sum(requested) OVER (PARTITION BY session, entity ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS used,
  FROM (SELECT concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y-%m-%d')) AS id, l_suppkey AS entity, CAST(date_trunc('month', l_shipdate) AS DATE) AS session, floor(l_quantity / 10) * 10 AS requested, 500.0 AS volume FROM lineitem))""")  # fmt: skip
def v06(spark, sf):
    li = b.transactions(spark, sf).select("id", F.col("symbol").alias("entity"), F.trunc("executed_at", "month").alias("session"), (F.floor(F.col("quantity") / 10) * 10).alias("requested"), F.lit(500.0).alias("volume"))
    return signals.participation(li, 0.1, 10).select("id", F.col("allowed").cast("long").alias("allowed"))


REB = "reb AS (SELECT min(session) AS session FROM ubars GROUP BY date_trunc('week', session))"


EXITS = "exits AS (SELECT entity, session FROM ubars WHERE CAST(entity AS BIGINT) % 3 = 0 AND day(session) % 9 = 0)"


@query("v07_order_life_cycle", *SPARSE, NEXT, REB, EXITS, sql_text="""SELECT entity, session, fill_session, CASE WHEN fill_session IS NOT NULL AND (after IS NULL OR fill_session <= after) AND (x IS NULL OR fill_session < x) THEN 'filled' WHEN after IS NOT NULL OR x IS NOT NULL THEN 'cancelled' ELSE 'pending' END AS status
FROM (SELECT n.*, CASE WHEN CAST(n.entity AS BIGINT) % 5 <> 0 THEN (SELECT min(r.session) FROM reb r WHERE r.session > n.session) END AS after, (SELECT min(e.session) FROM exits e WHERE e.entity = n.entity AND e.session > n.session) AS x FROM nxt n)""")  # fmt: skip
def v07(spark, sf):
    bars = b.ubars(spark, sf)
    fills = signals.next_tradable(bars)
    user = F.col("entity").cast("long")
    exits = bars.where((user % 3 == 0) & (F.dayofmonth("session") % 9 == 0)).select("entity", "session")
    orders = fills.select("entity", "session", (user % 5 == 0).alias("hold"))
    return signals.order_life_cycle(orders, fills, calendars.rebalance_sessions(bars), exits)


BACKTEST = """w AS (SELECT r.entity, r.session, r.ret, CASE WHEN r.session IN (SELECT min(session) FROM ebars GROUP BY date_trunc('week', session)) THEN 0.2 + length(r.entity) / 100.0 ELSE 0.1 END::DOUBLE AS weight FROM ret r),
held AS (SELECT *, coalesce(lag(weight, 2) OVER v, 0) AS held, coalesce(lag(weight, 1) OVER v, 0) AS new FROM w WINDOW v AS (PARTITION BY entity ORDER BY session)),
daily AS (SELECT session, sum(held * ret) - sum(abs(new - held)) * {bps} / 10000 AS daily_return FROM held GROUP BY session),
equity AS (SELECT session, daily_return, 1000000 * exp(sum(ln(1 + daily_return)) OVER (ORDER BY session)) AS equity FROM daily)"""


def weights_of(spark, sf):
    """Made-up weights of event types: higher on rebalance sessions."""
    bars = b.ebars(spark, sf)
    first = calendars.rebalance_sessions(bars).select("session", F.lit(True).alias("_first"))
    joined = bars.join(first, "session", "left")
    return joined.select("entity", "session", F.when(F.col("_first"), 0.2 + F.length("entity") / 100.0).otherwise(0.1).alias("weight"))


@query("v08_weight_backtest", b.EBARS, RET_E, BACKTEST.format(bps=15), sql_text="SELECT session, round(daily_return, 6) AS daily_return, round(ln(equity), 6) AS log_equity FROM equity")
def v08(spark, sf):
    path = signals.weight_backtest(weights_of(spark, sf), b.ebars(spark, sf), 15.0, 1_000_000.0)
    return _r(path.select("session", "daily_return", F.log("equity").alias("log_equity")), "daily_return", "log_equity")


SPLITS = "splits AS (SELECT symbol AS entity, event_date AS effective, CASE WHEN id % 2 = 0 THEN 2.0 ELSE 0.5 END::DOUBLE AS ratio FROM (SELECT symbol, event_date, min(id) AS id FROM cev WHERE event_type = 'stock_split' GROUP BY symbol, event_date))"


def _splits(spark, sf):
    cev = b.corporate_events(spark, sf).where("event_type = 'stock_split'").groupBy("symbol", "event_date").agg(F.min("id").alias("id"))
    return cev.select(F.col("symbol").alias("entity"), F.col("event_date").alias("effective"), F.when(F.col("id") % 2 == 0, 2.0).otherwise(0.5).alias("ratio"))


@query("v09_split_factors", b.CEV, SPLITS, sql_text="SELECT entity, effective, lead(effective) OVER w AS until, round(exp(sum(ln(ratio)) OVER w), 6) AS ratio FROM splits WINDOW w AS (PARTITION BY entity ORDER BY effective)")
def v09(spark, sf):
    return _r(signals.split_factors(_splits(spark, sf)), "ratio")


#: Positions on the ledger's symbols: so many shares as the symbol's number ends in, marked at 100.
HELD_SPLITS = "hs AS (SELECT entity, effective, ratio, (entity % 10)::DOUBLE AS quantity, 100.0::DOUBLE AS mark FROM splits)"


@query("v09_split_positions", b.CEV, SPLITS, HELD_SPLITS, sql_text="SELECT entity, effective, quantity * ratio AS new_quantity, mark / ratio AS new_mark, quantity * ratio <> round(quantity * ratio) AS fractional FROM hs")
def v09_positions(spark, sf):
    """Each entity's holding after each of its splits; a reverse split of an odd number of shares leaves a fraction."""
    splits = _splits(spark, sf)
    held = splits.select("entity", "effective", (F.col("entity") % 10).cast("double").alias("quantity"), F.lit(100.0).alias("mark"))
    return signals.split_positions(held, splits).select("entity", "effective", "new_quantity", "new_mark", "fractional")


CAPITALS = "capitals AS (SELECT unnest([100000.0, 200000.0, 300000.0])::DOUBLE AS capital)"


@query("a07_one_lot_purchases", CAPITALS, sql_text="""SELECT capital, count(CASE WHEN ok THEN 1 END) AS symbol_count, round(capital - coalesce(max(CASE WHEN ok THEN spent END), 0), 4) AS cash_after FROM (SELECT capital, spent, max(CASE WHEN spent > capital * 0.8 OR price * 10 > 0.2 * (capital - loss) THEN 1 ELSE 0 END) OVER (PARTITION BY capital ORDER BY price, code ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) = 0 AS ok
  FROM (SELECT capital, price, code, sum(price * 1.0005::DOUBLE * 10 * 1.001) OVER v AS spent, sum(price * 0.0005::DOUBLE * 10 + price * 1.0005 * 10 * 0.001) OVER v AS loss FROM (SELECT p_partkey AS code, p_retailprice AS price FROM part) CROSS JOIN capitals WINDOW v AS (PARTITION BY capital ORDER BY price, code ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))) GROUP BY capital""")  # fmt: skip
def a07(spark, sf):
    quotes = b.table(spark, sf, "part").select(F.col("p_partkey").alias("code"), F.col("p_retailprice").alias("price"))
    capitals = spark.range(1, 4).select((F.col("id") * 100000.0).alias("capital"))
    return signals.one_lot_purchases(quotes, capitals, 10, 0.2, 0.2, 0.0005, 0.001, 0.0)
