"""Metrics, intervals, comparisons."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalars import mean, ratio, rounded
from tidemark.operators import calendars, metrics, quality, signals
from tidemark.plans.registry import registry
from tidemark.plans.signals import BACKTEST, FILLS, RET_E, _fills, weights_of
from tidemark.sources import bindings as b

QUERIES, SQL, query = registry()

#: An equity path for each entity of the monthly bars: 1000 plus its running volume share.
PATH = "path AS (SELECT entity AS run, session, 1000 * close / first_value(close) OVER (PARTITION BY entity ORDER BY session) AS equity FROM bars)"
METRICS = ("cumulative_return", "cagr", "max_drawdown", "annualized_volatility", "sharpe_ratio", "turnover")


def _path(spark, sf):
    first = F.first("close").over(W.partitionBy("entity").orderBy("session"))
    return b.bars(spark, sf).select(F.col("entity").alias("run"), "session", ratio(1000 * F.col("close"), first).alias("equity"))


def _r(df, *columns, digits=6):
    return df.withColumns({c: rounded(F.col(c), digits) for c in columns})


PERFORMANCE = """steps AS (SELECT *, equity / lag(equity, 1, {initial}) OVER w - 1 AS ret, equity / greatest(max(equity) OVER (w ROWS UNBOUNDED PRECEDING), {initial}) - 1 AS down FROM {path} WINDOW w AS (PARTITION BY run ORDER BY session)),
perf AS (SELECT run, arg_max(equity, session) / {initial} AS ratio, max(session) - min(session) AS days, least(min(down), 0) AS down, coalesce(stddev_samp(ret), 0) AS std, avg(ret) AS mean, avg(equity) AS me FROM steps GROUP BY run)"""
PERFORMANCE_OUT = "round(ratio - 1, 6) AS cumulative_return, round(CASE WHEN days > 0 THEN pow(ratio, 365.25 / days) - 1 END, 6) AS cagr, round(-down, 6) AS max_drawdown, round(std * sqrt(252), 6) AS annualized_volatility, round(CASE WHEN std > 0 THEN mean / std * sqrt(252) END, 6) AS sharpe_ratio"


@query("a02_performance", b.BARS, PATH, PERFORMANCE.format(initial="1000.0::DOUBLE", path="path"), b.TX.replace("tx AS", "tx0 AS"), sql_text=f"SELECT run, {PERFORMANCE_OUT}, round(t / me, 6) AS turnover FROM perf JOIN (SELECT l_returnflag || l_linestatus AS run, sum(l_extendedprice) AS t FROM lineitem GROUP BY 1) USING (run)")
def a02(spark, sf):
    fills = b.table(spark, sf, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("run"), F.col("l_extendedprice").alias("notional"))
    return _r(metrics.performance(_path(spark, sf), 1000.0, fills), *METRICS)


@query("w07_running_drawdown", b.BARS, PATH, sql_text="SELECT run, session, round(equity / max(equity) OVER (PARTITION BY run ORDER BY session) - 1, 6) AS drawdown FROM path")
def w07(spark, sf):
    return _r(metrics.running_drawdown(_path(spark, sf)), "drawdown")


PROB = """prob AS (SELECT session, count(*) AS count, avg(CASE WHEN (p >= 0.5)::INT = y THEN 1.0 ELSE 0.0 END) AS accuracy, sum((p >= 0.5)::INT * y) / nullif(sum((p >= 0.5)::INT), 0) AS precision, sum((p >= 0.5)::INT * y) / nullif(sum(y), 0) AS recall,
  avg(pow(p - y, 2)) AS brier_score, -avg(y * ln(greatest(p, 1e-15)) + (1 - y) * ln(greatest(1 - p, 1e-15))) AS log_loss FROM pred GROUP BY session),
auc AS (SELECT session, sum(pos * (below + neg / 2)) / nullif(sum(pos) * sum(neg), 0) AS roc_auc FROM (SELECT *, coalesce(sum(neg) OVER (PARTITION BY session ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (SELECT session, p, sum(y) AS pos, sum(1 - y) AS neg FROM pred GROUP BY session, p)) GROUP BY session),
bins AS (SELECT session, len(list_filter([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[], lambda t: p >= t)) AS bin, count(*) AS count, avg(p) AS mp, avg(y) AS fr FROM pred GROUP BY 1, 2),
ece AS (SELECT session, sum(count * abs(mp - fr)) / sum(count) AS e FROM bins GROUP BY session)"""
PROB_NAMES = ("accuracy", "precision", "recall", "brier_score", "log_loss", "roc_auc", "expected_calibration_error")


@query("a03_probability_metrics", b.PRED, PROB, sql_text="SELECT session, prob.count, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(brier_score, 6) AS brier_score, round(log_loss, 6) AS log_loss, round(roc_auc, 6) AS roc_auc, round(e, 6) AS expected_calibration_error FROM prob JOIN auc USING (session) JOIN ece USING (session)")
def a03(spark, sf):
    return _r(metrics.probability_metrics(b.predictions(spark, sf), ["session"]), *PROB_NAMES)


@query("a03_calibration", b.PRED, PROB, sql_text="SELECT session, bin, count, round(mp, 6) AS mean_probability, round(fr, 6) AS observed_frequency FROM bins")
def a03_bins(spark, sf):
    return _r(metrics.calibration(b.predictions(spark, sf), ["session"]), "mean_probability", "observed_frequency")


@query("j09_prediction_labels", b.PRED, sql_text="SELECT session, count(*) AS predictions, count(y) AS scored, count(*) - count(y) AS unscored FROM (SELECT doc_id, doc_id % 20 AS session FROM documents) LEFT JOIN (SELECT symbol, y FROM pred) ON symbol = doc_id GROUP BY session")
def j09(spark, sf):
    docs = b.table(spark, sf, "documents").select(F.col("doc_id").alias("symbol"), (F.col("doc_id") % 20).alias("session"))
    scored = b.predictions(spark, sf).select("symbol", "y")
    return docs.join(scored, "symbol", "left").groupBy("session").agg(F.count(F.lit(1)).alias("predictions"), F.count("y").alias("scored"), F.count_if(F.col("y").isNull()).alias("unscored"))


def _bootstrap_sql(series: str, replicates: int, block: int, seed: int, statistic: str, lo: int, hi: int) -> str:
    return f"""series AS ({series}), num AS (SELECT count(*) AS n FROM series),
draws AS (SELECT r, ((r * 7919 + k * 104729 + {seed}) % n + j) % n AS i FROM num, range({replicates}) a(r), range(1000) c(k), range({block}) d(j) WHERE k * {block} + j < n),
stats AS (SELECT r, {statistic} AS s FROM draws JOIN series USING (i) GROUP BY r),
ranked AS (SELECT s, row_number() OVER (ORDER BY s, r) - 1 AS rk FROM stats)
SELECT round(max(CASE WHEN rk = {lo} THEN s END), 6) AS lower, round(max(CASE WHEN rk = {hi} THEN s END), 6) AS upper, CAST(NULL AS VARCHAR) AS reason FROM ranked"""


DAILY = "SELECT row_number() OVER (ORDER BY session) - 1 AS i, avg(close) / 100 AS value FROM ebars GROUP BY session"


@query("a08_bootstrap_interval", b.EBARS, sql_text="SELECT * FROM (WITH " + _bootstrap_sql(DAILY, 500, 5, 17, "sum(value) / count(*)", 12, 487) + ")")
def a08(spark, sf):
    daily = b.ebars(spark, sf).groupBy("session").agg((F.avg("close") / 100).alias("value"))
    series = daily.select((F.row_number().over(W.orderBy("session")) - 1).alias("i"), "value")  # one row a session
    return _r(metrics.bootstrap_interval(series, 500, 5, 0.95, 17), "lower", "upper")


SESSIONS = "SELECT session AS i, sum(CASE WHEN (p >= 0.5)::INT = y THEN 1 ELSE 0 END)::DOUBLE AS value, count(*) AS weight FROM pred GROUP BY session"


@query("a09_clustered_interval", b.PRED, sql_text="SELECT * FROM (WITH " + _bootstrap_sql(SESSIONS, 500, 3, 5, "sum(value) / sum(weight)", 12, 487) + ")")
def a09(spark, sf):
    hit = ((F.col("p") >= 0.5).cast("int") == F.col("y")).cast("double")
    series = b.predictions(spark, sf).groupBy(F.col("session").alias("i")).agg(F.sum(hit).alias("value"), F.count(F.lit(1)).alias("weight"))
    return _r(metrics.bootstrap_interval(series, 500, 3, 0.95, 5, "ratio"), "lower", "upper")


@query("a10_cost_totals", b.TX, FILLS, sql_text="SELECT symbol, round(sum(px * quantity * 10 / 10000 + abs(px - reference) * quantity), 2) AS cost FROM fills GROUP BY symbol")
def a10(spark, sf):
    return _r(metrics.cost_totals(_fills(spark, sf), ["symbol"]), "cost", digits=2)


#: Daily returns of every user, and of the mean over all users.
USER_RETURNS = "r AS (SELECT entity AS run, session, close / lag(close) OVER (PARTITION BY entity ORDER BY session) - 1 AS ret FROM ubars), d AS (SELECT session, avg(close) AS m FROM ubars GROUP BY session), m AS (SELECT session, m / lag(m) OVER (ORDER BY session) - 1 AS ret FROM d)"


@query("j17_return_difference", b.UBARS, USER_RETURNS, sql_text="SELECT run, session, round(r.ret - m.ret, 6) AS difference, r.session IS NULL AS mismatch FROM (SELECT DISTINCT run FROM r) CROSS JOIN m LEFT JOIN (SELECT run, session, ret FROM r) r USING (run, session)")
def j17(spark, sf):
    bars = b.ubars(spark, sf)
    own = bars.select(F.col("entity").alias("run"), "session", (ratio(F.col("close"), F.lag("close").over(W.partitionBy("entity").orderBy("session"))) - 1).alias("ret"))
    daily = bars.groupBy("session").agg(mean(F.col("close")).alias("m"))
    daily = daily.select("session", (ratio(F.col("m"), F.lag("m").over(W.orderBy("session"))) - 1).alias("ret"))  # one row a session
    other = own.select("run").distinct().crossJoin(daily)
    return _r(metrics.return_difference(own, other, ("run",)), "difference")


RUNS = "runs AS (SELECT entity AS name, year(session) AS period, round(arg_max(close, session) / arg_min(close, session) - 1, 6) AS ret, month(max(session)) AS condition FROM bars GROUP BY 1, 2)"


def _runs(spark, sf):
    return b.bars(spark, sf).groupBy(F.col("entity").alias("name"), F.year("session").cast("long").alias("period")).agg(rounded(ratio(F.max_by("close", "session"), F.min_by("close", "session")) - 1, 6).alias("ret"), F.month(F.max("session")).alias("condition"))


@query("a15_run_comparison", b.BARS, RUNS, sql_text="SELECT period, count(DISTINCT condition) = 1 AS comparable, count(*) AS runs FROM runs GROUP BY period")
def a15(spark, sf):
    return metrics.comparable_runs(_runs(spark, sf), ["period"])


@query("a16_best_candidate", b.BARS, RUNS, sql_text="SELECT period, arg_min(name, {'r': -ret, 'name': name}) AS name, max(ret) AS ret FROM runs GROUP BY period")
def a16(spark, sf):
    return metrics.best_candidate(_runs(spark, sf), ["period"])


SCENARIOS = (("optimistic", 0.0), ("base", 15.0), ("conservative", 75.0))
COST_PATHS = ",\n".join(
    f"p_{name} AS (SELECT '{name}' AS run, * FROM (WITH {BACKTEST.format(bps=bps)} SELECT * FROM equity))" for name, bps in SCENARIOS
) + ",\npaths AS (" + " UNION ALL ".join(f"SELECT * FROM p_{name}" for name, _ in SCENARIOS) + ")"
PAIRED = "series AS (SELECT p.run, row_number() OVER (PARTITION BY p.run ORDER BY session) - 1 AS i, p.daily_return - o.daily_return AS value FROM paths p JOIN p_optimistic o USING (session) WHERE p.run <> 'optimistic')"


def _bounds_sql(replicates: int, block: int, seed: int, lo: int, hi: int) -> str:
    """bounds (run, mean_difference, lower, upper, n) of each run of ``series``."""
    return f"""num AS (SELECT run, count(*) AS n, avg(value) AS mean_difference FROM series GROUP BY run),
draws AS (SELECT run, r, ((r * 7919 + k * 104729 + {seed}) % n + j) % n AS i FROM num, range({replicates}) a(r), range(1000) c(k), range({block}) d(j) WHERE n >= {2 * block} AND k * {block} + j < n),
stats AS (SELECT run, r, sum(value) / count(*) AS s FROM draws JOIN series USING (run, i) GROUP BY run, r),
ranked AS (SELECT run, s, row_number() OVER (PARTITION BY run ORDER BY s, r) - 1 AS rk FROM stats),
bounds AS (SELECT run, any_value(mean_difference) AS mean_difference, any_value(n) AS n, max(CASE WHEN rk = {lo} THEN s END) AS lower, max(CASE WHEN rk = {hi} THEN s END) AS upper FROM num LEFT JOIN ranked USING (run) GROUP BY run)"""


@query("a17_cost_sensitivity", b.EBARS, RET_E, COST_PATHS, PERFORMANCE.format(initial="1000000.0::DOUBLE", path="paths"), PAIRED, _bounds_sql(500, 5, 7, 12, 487), sql_text="SELECT run, round(ln(ratio), 6) AS log_growth, round(-down, 6) AS max_drawdown, round(std * sqrt(252), 6) AS annualized_volatility, round(CASE WHEN std > 0 THEN mean / std * sqrt(252) END, 6) AS sharpe_ratio, round(mean_difference, 6) AS mean_difference, round(lower, 6) AS lower, round(upper, 6) AS upper FROM perf LEFT JOIN bounds USING (run)")
def a17(spark, sf):
    """Each scenario's metrics, and the interval of its mean daily return difference against the one without costs."""
    weights, bars = weights_of(spark, sf), b.ebars(spark, sf)
    runs = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(n).alias("run"), F.lit(1e6).alias("initial"), F.lit(c).alias("cost_bps")) for n, c in SCENARIOS])))
    paths = signals.weight_backtests(weights.crossJoin(F.broadcast(runs.select("run"))), bars, runs)  # three rows
    own = paths.where("run <> 'optimistic'").select("run", "session", F.col("daily_return").alias("ret"))
    free = paths.where("run = 'optimistic'").select("session", F.col("daily_return").alias("ret"))
    free = free.crossJoin(F.broadcast(runs.where("run <> 'optimistic'").select("run")))
    interval = metrics.difference_interval(metrics.return_difference(own, free, ("run",)), 500, 5, 0.95, 7)
    out = metrics.performance(paths, "initial").join(interval, "run", "left").withColumn("log_growth", F.log1p("cumulative_return"))
    names = ("log_growth", "max_drawdown", "annualized_volatility", "sharpe_ratio", "mean_difference", "lower", "upper")
    return _r(out.select("run", *names), *names)


CAPITALS = (100_000.0, 200_000.0, 300_000.0)
LOT = 10.0
#: Three strategies over the bars of event types: equal weights each day, the best by momentum, equal weights held.
STRATEGIES = """strat AS (SELECT 'equal' AS strategy, entity, session, 1.0::DOUBLE / count(*) OVER (PARTITION BY session) AS weight FROM ebars WHERE close IS NOT NULL
  UNION ALL SELECT 'hold', entity, session, 1.0::DOUBLE / count(*) OVER (PARTITION BY session) FROM ebars WHERE close IS NOT NULL AND session = (SELECT min(s) FROM (SELECT min(session) AS s FROM ebars GROUP BY date_trunc('week', session)))
  UNION ALL SELECT 'momentum', entity, session, 1.0::DOUBLE / count(*) OVER (PARTITION BY session) FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY score DESC, entity) AS k FROM (SELECT entity, session, close / lag(close, 3) OVER (PARTITION BY entity ORDER BY session) - 1 AS score FROM ebars) WHERE score > 0) WHERE k <= 2),
lots AS (SELECT strategy || ':' || CAST(capital AS BIGINT) AS run, capital, entity, session, floor(capital * weight / (close * 10)) * 10 * close / capital AS weight FROM strat JOIN ebars USING (entity, session), (SELECT unnest([100000.0, 200000.0, 300000.0])::DOUBLE AS capital)),
cellw AS (SELECT r.run, r.capital, e.entity, e.session, e.ret, coalesce(l.weight, 0) AS weight FROM (SELECT DISTINCT run, capital FROM lots) r CROSS JOIN ret e LEFT JOIN lots l ON l.run = r.run AND l.entity = e.entity AND l.session = e.session),
heldw AS (SELECT *, coalesce(lag(weight, 2) OVER v, 0) AS held, coalesce(lag(weight, 1) OVER v, 0) AS new FROM cellw WINDOW v AS (PARTITION BY run, entity ORDER BY session)),
dayw AS (SELECT run, capital, session, sum(held * ret) - sum(abs(new - held)) * 15 / 10000 AS dr FROM heldw GROUP BY run, capital, session),
pathw AS (SELECT run, capital, session, dr, exp(sum(ln(1 + dr)) OVER (PARTITION BY run ORDER BY session)) AS growth FROM dayw),
downw AS (SELECT *, growth / greatest(max(growth) OVER (PARTITION BY run ORDER BY session), 1) - 1 AS down FROM pathw),
ready AS (SELECT count(*) AS failures FROM ebars WHERE NOT (least(open, high, low, close) > 0 AND low <= least(open, close) AND greatest(open, close) <= high AND volume > 0))"""


def _strategies(bars):
    equal = signals.equal_weights(bars)
    hold = signals.hold_weights(bars, calendars.rebalance_sessions(bars))
    best = signals.selected_weights(signals.top_n(signals.momentum(bars, 3), 2))
    frames = [w.select(F.lit(name).alias("strategy"), "entity", "session", "weight") for name, w in (("equal", equal), ("hold", hold), ("momentum", best))]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query("a18_capital_grid", b.EBARS, RET_E, STRATEGIES, sql_text="SELECT run, capital, round(ln(arg_max(growth, session)), 6) AS log_growth, round(-least(min(down), 0), 6) AS max_drawdown FROM downw, ready WHERE failures = 0 GROUP BY run, capital")
def a18(spark, sf):
    """Every capital with every strategy, in whole lots of its own capital, where the bars pass one readiness check."""
    bars = b.ebars(spark, sf)
    capitals = F.explode(F.array(*[F.lit(c) for c in CAPITALS])).alias("initial")
    weights = _strategies(bars).select("*", capitals).withColumn("run", F.concat_ws(":", "strategy", F.col("initial").cast("long")))
    runs = spark.range(1).select(F.explode(F.array(*[F.lit(s) for s in ("equal", "hold", "momentum")])).alias("strategy")).select("strategy", capitals)
    runs = runs.select(F.concat_ws(":", "strategy", F.col("initial").cast("long")).alias("run"), "initial", F.lit(15.0).alias("cost_bps"))
    paths = signals.weight_backtests(signals.lot_weights(weights, bars, LOT), bars, runs)
    checked = quality.bar_issues(bars.withColumn("available_at", F.date_add("session", 1)).withColumn("factor", F.lit(1.0)))
    out = metrics.performance(quality.gate(paths, checked), "initial").withColumn("log_growth", F.log1p("cumulative_return"))
    out = out.join(runs.select("run", F.col("initial").alias("capital")), "run")
    return _r(out.select("run", "capital", "log_growth", "max_drawdown"), "log_growth", "max_drawdown")
