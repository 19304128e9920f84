"""Ledger, metrics and weights on rows with known answers."""

import datetime as dt
import math
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import ledger, metrics, model, signals

D = lambda n: dt.date(2025, 1, n)
TX = "symbol string, currency string, side string, quantity double, price double, fee double, executed_at date, seq int"


def ledger_of(spark, *rows):
    tx = spark.createDataFrame([("A", "JPY", s, float(q), float(p), float(f), D(i + 1), i) for i, (s, q, p, f) in enumerate(rows)], TX)
    return ledger.positions(tx, ["executed_at", "seq"]).first()


def test_buys_average_with_fees(spark):
    p = ledger_of(spark, ("buy", 10, 100, 10), ("buy", 10, 200, 30))
    assert (p["quantity"], p["average_cost"], p["total_cost"]) == (20, 152, 3040)


def test_sell_allocates_cost(spark):
    p = ledger_of(spark, ("buy", 10, 100, 10), ("sell", 4, 150, 2))
    assert (p["quantity"], p["average_cost"], p["total_cost"], p["realized_pnl"]) == (6, 101, 606, 194)


def test_full_close_and_rebuy(spark):
    p = ledger_of(spark, ("buy", 10, 100, 0), ("sell", 10, 120, 0), ("buy", 10, 200, 0))
    assert (p["average_cost"], p["realized_pnl"]) == (200, 200)


def test_oversell_is_flagged_and_skipped(spark):
    p = ledger_of(spark, ("sell", 1, 100, 0), ("buy", 10, 100, 0), ("sell", 11, 100, 0))
    assert (p["quantity"], p["oversold"]) == (10, 2)


def test_valuation_priority_and_exact_threshold(spark):
    pos = spark.createDataFrame([("A", "JPY", 10.0, 1000.0, 0.0, D(1)), ("B", "JPY", 1.0, 1.0, 0.0, D(1)), ("C", "JPY", 1.0, 1.0, 0.0, D(9)), ("E", "USD", 0.0, 0.0, 5.0, D(1))], "symbol string, currency string, quantity double, total_cost double, realized_pnl double, last_tx date")
    snaps = spark.createDataFrame([("A", "JPY", 120.0, 100.0, D(8)), ("B", "JPY", 1.0, 1.0, D(20)), ("C", "JPY", 1.0, 1.0, D(8))], "symbol string, currency string, price double, previous_close double, as_of date")
    v = ledger.valued(pos, snaps, F.lit("2025-01-10").cast("date"), 5)
    assert {r["symbol"]: r["valuation_status"] for r in v.collect()} == {"A": "ok", "B": "future", "C": "before_transaction", "E": "closed"}
    a = v.where("symbol = 'A'").first()
    assert (a["market_value"], round(a["unrealized_pct"], 9)) == (1200.0, 0.2)
    hit = {r["symbol"]: r["triggered"] for r in ledger.alerts(ledger.weighted(v), {"take_profit_threshold": 20.0}).collect()}
    assert hit == {"A": True, "B": None, "C": None}
    states = {r["symbol"]: (r["state"], r["severity"]) for r in ledger.assessment(ledger.weighted(v), {"take_profit_threshold": 20.0}).collect()}
    assert states == {"A": ("fresh", "info"), "B": ("blocked", "critical"), "C": ("blocked", "critical")}
    totals = {r["currency"]: r for r in ledger.currency_totals(v).collect()}
    assert totals["JPY"]["market_value"] is None and totals["JPY"]["unpriced_symbols"] == ["B", "C"] and totals["USD"]["market_value"] == 0


def test_late_snapshots_are_of_the_future_and_leave_the_portfolio_incomplete(spark):
    pos = spark.createDataFrame([("A", "JPY", 10.0, 1000.0, 0.0, D(1)), ("B", "JPY", 1.0, 1.0, 0.0, D(1)), ("C", "USD", 0.0, 0.0, 1.0, D(1))], "symbol string, currency string, quantity double, total_cost double, realized_pnl double, last_tx date")
    snaps = spark.createDataFrame([("A", "JPY", 120.0, 100.0, D(8), D(11)), ("B", "JPY", 1.0, 1.0, D(8), D(10))], "symbol string, currency string, price double, previous_close double, as_of date, ingested_at date")
    v = ledger.valued(pos, snaps, F.lit("2025-01-10").cast("date"), 5)
    assert {r["symbol"]: r["valuation_status"] for r in v.collect()} == {"A": "future", "B": "ok", "C": "closed"}
    tx = spark.createDataFrame([(1,), (2,)], "id int")
    assert tuple(ledger.portfolio_summary(tx, v).first()) == (2, 2, 1, "JPY,USD", False)
    assert ledger.portfolio_summary(tx, v.where("symbol <> 'A'")).first()["valuation_complete"] is True
    assert ledger.portfolio_summary(tx, v.limit(0)).first()["valuation_complete"] is True


def test_delisting_while_held(spark):
    acts = spark.createDataFrame([(e, D(1), D(1), D(1), D(1), "x") for e in "ABC"], "entity string, event_at date, effective date, available_at date, ingested_at date, payload string")
    held = spark.createDataFrame([("A", D(5), 3.0), ("B", D(5), 3.0), ("B", D(8), 0.0), ("A", D(12), 0.0)], "entity string, session date, quantity double")
    ends = spark.createDataFrame([("A", D(10)), ("B", D(10))], "entity string, effective date")
    got = signals.action_exceptions(acts, F.lit(D(1)), held, ends).collect()
    assert {r["entity"]: r["delisted_while_held"] for r in got} == {"A": True, "B": False, "C": False}


def test_performance_on_a_known_path(spark):
    days = [dt.date(2024, 1, 1), dt.date(2024, 7, 1), dt.date(2025, 1, 1)]
    eq = spark.createDataFrame([("r", d, e) for d, e in zip(days, (100.0, 120.0, 90.0))], "run string, session date, equity double")
    fills = spark.createDataFrame([("r", 50.0)], "run string, notional double")
    m = metrics.performance(eq, 100.0, fills).first()
    returns = [0, 0.2, -0.25]
    mean = sum(returns) / 3
    std = math.sqrt(sum((x - mean) ** 2 for x in returns) / 2)
    assert m["cumulative_return"] == pytest.approx(-0.1) and m["cagr"] == pytest.approx(0.9 ** (365.25 / 366) - 1)
    assert m["max_drawdown"] == pytest.approx(0.25) and m["annualized_volatility"] == pytest.approx(std * math.sqrt(252))
    assert m["turnover"] == pytest.approx(50 / (310 / 3))
    one = metrics.performance(eq.where("equity = 100"), 100.0).first()
    assert (one["annualized_volatility"], one["sharpe_ratio"], one["cagr"]) == (0, None, None)


def pairs(spark, *rows):
    return spark.createDataFrame([(1, float(p), y) for p, y in rows], "g int, p double, y int")


def test_probability_metrics_degenerate(spark):
    m = metrics.probability_metrics(pairs(spark, (0.1, 0), (0.9, 1)), ["g"]).first()
    assert (m["accuracy"], m["roc_auc"]) == (1, 1) and m["brier_score"] == pytest.approx(0.01)
    assert metrics.probability_metrics(pairs(spark, (0.5, 0), (0.5, 1)), ["g"]).first()["roc_auc"] == 0.5
    m = metrics.probability_metrics(pairs(spark, (0.1, 0)), ["g"]).first()
    assert (m["recall"], m["roc_auc"], m["precision"]) == (None, None, None)
    assert {r["bin"] for r in metrics.calibration(pairs(spark, (0.3, 1), (1.0, 1), (0.7, 0)), ["g"]).collect()} == {3, 7, 9}


def test_bootstrap_needs_two_blocks(spark):
    series = spark.createDataFrame([(0, 1.0), (1, 2.0)], "i int, value double")
    row = metrics.bootstrap_interval(series, 10, 5, 0.9, 1).first()
    assert (row["lower"], row["upper"], row["reason"]) == (None, None, "insufficient_blocks")


def test_identical_runs_differ_by_nothing(spark):
    a = spark.createDataFrame([(D(1), 0.1), (D(2), -0.1)], "session date, ret double")
    assert {r["difference"] for r in metrics.return_difference(a, a).collect()} == {0.0}
    assert metrics.return_difference(a, a.where("ret > 0")).where("mismatch").count() == 1


BARS = "entity string, session date, close double, volume double"


def test_momentum_ties_and_gaps(spark):
    bars = spark.createDataFrame([("A", D(1), 100.0, 1.0), ("A", D(2), 110.0, 1.0), ("B", D(1), 100.0, 1.0), ("B", D(2), 110.0, 1.0), ("C", D(1), 100.0, 1.0), ("C", D(2), 99.0, 1.0), ("E", D(2), 5.0, 1.0)], BARS)
    top = signals.top_n(signals.momentum(bars, 1), 1).collect()
    assert [r["entity"] for r in top] == ["A"]
    assert signals.selected_weights(signals.top_n(signals.momentum(bars, 1), 1)).first()["weight"] == 1


def test_next_session_and_streaks(spark):
    bars = spark.createDataFrame([("A", D(n), None if n in (3, 4) else 1.0, 1.0) for n in range(1, 6)], BARS)
    fills = {r["session"].day: r["fill_session"] and r["fill_session"].day for r in signals.next_tradable(bars).collect()}
    assert fills == {1: 2, 2: 5, 3: 5, 4: 5, 5: None}
    streak = signals.halt_streaks(signals.missing_data_events(bars), bars.select("session"), 1).collect()
    assert [(r["start"].day, r["length"], r["stops"]) for r in streak] == [(3, 2, True)]


def test_execution_price_and_fee(spark):
    f = signals.execution(spark.createDataFrame([("buy", 98.0, 100.0)], "side string, quantity double, reference double"), 100.0, 100.0, 2.0).first()
    assert (f["price"], round(f["commission"], 6)) == (101.0, 100.98)


def test_one_lot_affordability(spark):
    capitals = spark.createDataFrame([(100000.0,)], "capital double")
    count = lambda price, reserve, cap: signals.one_lot_purchases(spark.createDataFrame([("x", price)], "code string, price double"), capitals, 100, reserve, cap, 0.0, 0.0, 0.0).first()["symbol_count"]
    assert (count(200.0, 0.4, 0.2), count(199.0, 0.4, 0.2), count(601.0, 0.4, 1.0)) == (1, 1, 0)


def test_splits_and_dividends(spark):
    pos = spark.createDataFrame([("A", 100.0, 100.0), ("B", 99.0, 10.0)], "entity string, quantity double, mark double")
    splits = spark.createDataFrame([("A", 2.0), ("B", 0.5)], "entity string, ratio double")
    got = {r["entity"]: (r["new_quantity"], r["new_mark"], r["fractional"]) for r in signals.split_positions(pos, splits).collect()}
    assert got == {"A": (200.0, 50.0, False), "B": (49.5, 20.0, True)}
    held = spark.createDataFrame([("A", D(n), 100.0) for n in range(1, 7)], "entity string, session date, quantity double")
    dividends = spark.createDataFrame([("A", D(3), D(5), 2.0)], "entity string, effective date, payment date, cash double")
    due = {r["session"].day: r["receivable"] for r in signals.dividend_receivables(held, dividends).collect()}
    assert due == {1: 0, 2: 0, 3: 200, 4: 200, 5: 0, 6: 0}


def test_descent_matches_by_hand(spark):
    import numpy as np

    x, y = np.array([-1.0, 0.5, 1.0, 2.0]), np.array([0, 0, 1, 1])
    rows = spark.createDataFrame([(0, float(a), int(b)) for a, b in zip(x, y)], "fold int, f double, y int")
    fit = model.fit_descent(rows, ["f"], [0.1], epochs=5).first()
    w = np.zeros(2)
    for _ in range(5):
        e = 1 / (1 + np.exp(-(w[0] + w[1] * x))) - y
        w = w - 0.1 * np.array([e.mean(), (e * x).mean() + 0.1 * w[1]])
    assert fit["intercept"] == pytest.approx(w[0]) and fit["weights"][0] == pytest.approx(w[1])


def test_samples_read_bars_that_were_made_once(spark):
    from tidemark.plans import model as plans

    for rows in (plans._samples, plans._roles):
        files = rows(spark, "/root/testdata/sf0.001").inputFiles()
        assert files and not any("lineitem" in f for f in files)


def test_append_is_idempotent_and_refuses_overselling(spark):
    kind = "id string, what string, symbol string, currency string, side string, quantity int, at int"
    old = spark.createDataFrame([("1", "a", "A", "JPY", "buy", 5, 1), ("2", "b", "B", "JPY", "buy", 5, 1)], kind)
    batch = [("2", "z", "A", "JPY", "buy", 1, 2), ("3", "a", "A", "JPY", "buy", 1, 2), ("4", "c", "A", "JPY", "sell", 5, 2), ("4", "c", "A", "JPY", "sell", 5, 2), ("5", "d", "B", "JPY", "sell", 6, 2), ("6", "e", "B", "JPY", "buy", 9, 3)]
    got = sorted((r["id"], r["code"] or "") for r in ledger.append_batch(old, spark.createDataFrame(batch, kind), ["what"], ["at"]).collect())
    assert got == [("2", "duplicate_id"), ("3", "duplicate_content"), ("4", ""), ("4", "duplicate_id"), ("5", "oversell"), ("6", "oversell")]
    assert {r["code"] for r in ledger.append_batch(old, spark.createDataFrame(batch, kind), ["what"]).collect()} == {None, "duplicate_id", "duplicate_content"}


def test_ledger_is_exact(spark):
    p = ledger_of(spark, ("buy", 3, 0.1, 0), ("sell", 1, 0.2, 0.01))
    assert (p["total_cost"], p["realized_pnl"]) == (Decimal("0.2"), Decimal("0.09"))
    third = ledger_of(spark, ("buy", 3, 100, 0), ("buy", 4, 0.1, 0.1), ("sell", 1, 1, 0))
    assert third["total_cost"] == Decimal("300.5") - Decimal("42.928571428571")


def test_dividends_of_one_day_all_count(spark):
    hold = spark.createDataFrame([("A", D(1), 10.0), ("A", D(3), 20.0), ("A", D(5), 0.0), ("A", D(9), 5.0)], "entity string, session date, quantity double")
    div = spark.createDataFrame([("A", D(3), D(6), 1.0), ("A", D(3), D(6), 1.0), ("A", D(4), D(9), 2.0)], "entity string, effective date, payment date, cash double")
    got = [r["receivable"] for r in signals.dividend_receivables(hold, div).orderBy("session").collect()]
    assert got == [0.0, 20.0, 60.0, 0.0]


def test_equal_paths_give_equal_returns_whatever_the_capital(spark):
    paths = spark.createDataFrame([(str(c), D(k), float(c), c * (1 + k / 10)) for c in (100, 200, 300) for k in (1, 2, 3)], "run string, session date, initial double, equity double")
    assert {round(r["cumulative_return"], 9) for r in metrics.performance(paths, "initial").collect()} == {0.3}


def test_a_close_of_zero_gives_infinite_returns(spark):
    day = lambda n: dt.date(2024, 1, n)
    bars = spark.createDataFrame([("a", day(1), 0.0, 1.0), ("a", day(2), 3.0, 1.0), ("a", day(3), 0.0, 1.0), ("a", day(4), 0.0, 1.0)], "entity string, session date, close double, volume double")
    found = [r.ret for r in signals.daily_returns(bars).orderBy("session").collect()]
    assert found[:3] == [None, math.inf, -1.0] and math.isnan(found[3])
    assert math.isnan({r.session: r.score for r in signals.momentum(bars, 2).collect()}[day(3)])
    paths = bars.select(F.lit("r").alias("run"), "session", F.col("close").alias("equity"))
    assert metrics.returns(paths, 1.0).where("ret = double('infinity')").count() == 1


def test_returns_over_closes_of_zero_equal_sql(spark, tmp_path):
    import pandas as pd
    from helpers import TABLES, by_sql, rows

    from tidemark import plans

    values = [0.0, 5.0, 0.0, 0.0, 7.0, 8.0, 9.0, 0.0, 3.0]
    events = [(i, pd.Timestamp(2024, 1, 1 + i % 9), i // 9, "click", v if i < 9 else v + 1) for i, v in enumerate(values * 2)]
    for t in TABLES:
        pd.DataFrame(events, columns=["event_id", "ts", "user_id", "event_type", "value"]).to_parquet(tmp_path / f"{t}.parquet", coerce_timestamps="us")
    for name in ("j17_return_difference", "w01_momentum_sparse", "w06_daily_returns"):
        assert rows(plans.QUERIES[name](spark, str(tmp_path)).toPandas()) == rows(by_sql(plans.SQL[name], str(tmp_path))), name


def sql_text_of(spark, tmp_path, name, closes):
    """Rows of a query and of its SQL over one event a user and day, doubles as text: each digit and a zero's sign count."""
    import pandas as pd
    from helpers import TABLES, by_sql

    from tidemark import plans

    events = [(i, pd.Timestamp(2024, 1, 1 + day), user, "click", v) for i, (day, user, v) in enumerate((d, u, v) for d, of in enumerate(closes) for u, v in enumerate(of))]
    for t in TABLES:
        pd.DataFrame(events, columns=["event_id", "ts", "user_id", "event_type", "value"]).to_parquet(tmp_path / f"{t}.parquet", coerce_timestamps="us")
    text = lambda df: sorted(tuple(repr(float(v)) if isinstance(v, float) else str(v)[:10] for v in r) for r in df[sorted(df.columns)].itertuples(index=False))
    return text(plans.QUERIES[name](spark, str(tmp_path)).toPandas()), text(by_sql(plans.SQL[name], str(tmp_path)))


def test_return_differences_at_ties_and_under_zero_equal_sql(spark, tmp_path):
    # The mean stands still while 59.01 / 19.2 - 1 = 2.0734375 lies between two roundings; then a difference of -1e-7.
    own, by_sql = sql_text_of(spark, tmp_path, "j17_return_difference", [(19.2, 59.01), (59.01, 19.2), (100.0, 100.0), (100.0, 100.00002)])
    assert own == by_sql and {"2.073437", "-0.0"} <= {v for r in own for v in r}


@pytest.mark.parametrize("name", ["w06_daily_returns", "w01_momentum_sparse"])
def test_returns_at_ties_equal_sql(spark, tmp_path, name):
    # 59.01 / 19.2 - 1 = 2.0734375 and 36.84 / 76.8 - 1 = -0.5203125, over one day and over two
    own, by_sql = sql_text_of(spark, tmp_path, name, [(19.2, 76.8), (59.01, 36.84), (59.01, 36.84), (0.0, 1.0), (1.0, 0.0)])
    assert own == by_sql and {"2.073437", "-0.520312"} <= {v for r in own for v in r}


def test_rounding_equals_sql_in_every_bit(spark):
    import duckdb

    values = [a / b - 1 for a, b in ((59.01, 19.2), (36.84, 76.8), (129.1, 64.0), (32.39, 6.4))] + [-1e-7, -5e-7, 5e-7, 2.5, -0.0, 1e300, 1.9e302, math.inf, -math.inf, math.nan, 1e15 + 0.5]
    frame = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (0, 2, 6, 9):
        own = [repr(r[0]) for r in frame.select(scalars.rounded(F.col("x"), digits)).collect()]
        assert own == [repr(duckdb.execute("SELECT round(?::DOUBLE, ?::INT)", [v, digits]).fetchone()[0]) for v in values]


def test_mean_does_not_depend_on_the_order(spark):
    values = [(k * 7919 % 56021) / 100 for k in range(50_000)]
    for of in (values, sorted(values), sorted(values, reverse=True)):
        assert spark.createDataFrame([(v,) for v in of], "x double").coalesce(1).select(scalars.mean(F.col("x"))).first()[0] == math.fsum(values) / len(values)
    odd = lambda *of: spark.createDataFrame([(v,) for v in of], "x double").select(scalars.mean(F.col("x"))).first()[0]
    assert (odd(None, None), odd(1.0, None, 2.0), odd(math.inf, 1.0), odd(-1e300, 1e299)) == (None, 1.5, math.inf, -4.5e299)
    assert math.isnan(odd(math.nan, 1.0)) and math.isnan(odd(math.inf, -math.inf))
