"""Point-in-time rules: strict boundaries, late ingestion, ambiguity, invariance."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import pit

D = lambda n: dt.date(2024, 1, n)
SCHEMA = "entity string, event_at date, available_at date, ingested_at date, value double, revision string, source string, basis string"


def obs(spark, *rows):
    return spark.createDataFrame([("A", D(1), a, i, v, r, "s", b) for a, i, v, r, b in rows], SCHEMA)


def at(day):
    return F.lit(day).cast("date")


def test_availability_is_strict(spark):
    rows = obs(spark, (D(5), D(5), 1.0, "a", "observed"))
    assert pit.as_of(rows, at("2024-01-05")).count() == 0
    assert pit.as_of(rows, at("2024-01-06")).first()["value"] == 1.0


def test_late_ingestion_doesnt_hide_the_older_revision(spark):
    rows = obs(spark, (D(2), D(2), 1.0, "a", "observed"), (D(3), D(9), 2.0, "b", "observed"))
    decisions = spark.createDataFrame([(D(n),) for n in (2, 3, 5, 9, 10)], "decision date")
    found = {r["decision"].day: r["value"] for r in pit.as_of_many(rows, decisions).collect()}
    assert found == {3: 1.0, 5: 1.0, 9: 1.0, 10: 2.0}
    for day in (3, 5, 9, 10):
        assert pit.as_of(rows, at(f"2024-01-{day:02}")).first()["value"] == found[day]


def test_equal_content_keeps_the_earliest_ingestion(spark):
    rows = obs(spark, (D(2), D(4), 1.0, "a", "observed"), (D(2), D(3), 1.0, "b", "observed"))
    row = pit.as_of(rows, at("2024-01-10")).first()
    assert row["ingested_at"] == D(3) and not row["ambiguous"]


def test_ambiguity_is_reported_also_when_superseded(spark):
    rows = obs(spark, (D(2), D(2), 1.0, "a", "observed"), (D(2), D(2), 5.0, "b", "observed"), (D(3), D(3), 2.0, "c", "observed"))
    assert pit.as_of(rows, at("2024-01-10")).first()["ambiguous"]
    assert pit.ambiguous_revisions(rows).first()["contents"] == 2


def test_modes_and_estimates(spark):
    rows = obs(spark, (D(2), D(8), 1.0, "a", "documented"), (D(1), D(1), 3.0, "b", "estimated"))
    assert pit.as_of(rows, at("2024-01-05")).first()["value"] == 3.0
    assert pit.as_of(rows, at("2024-01-05"), allow_estimated=False).count() == 0
    assert pit.as_of(rows, at("2024-01-05"), "historical", at("2024-01-08")).first()["value"] == 1.0


def test_future_rows_and_order_change_nothing(spark):
    base = [(D(2), D(2), 1.0, "a", "observed"), (D(4), D(5), 2.0, "b", "observed")]
    before = pit.as_of(obs(spark, *base), at("2024-01-06")).collect()
    assert pit.as_of(obs(spark, *reversed(base), (D(6), D(6), 9.0, "z", "observed")), at("2024-01-06")).collect() == before


def test_membership_is_half_open(spark):
    life = spark.createDataFrame([("A", D(2), D(4)), ("B", D(3), None)], "entity string, listing date, delisting date")
    sessions = spark.createDataFrame([(D(n),) for n in range(1, 6)], "session date")
    got = {(r["session"].day, r["entity"]) for r in pit.membership(life, sessions).collect()}
    assert got == {(2, "A"), (3, "A"), (3, "B"), (4, "B"), (5, "B")}


def test_action_crossing_boundaries(spark):
    windows = spark.createDataFrame([("A", D(1), D(3)), ("A", D(3), D(5)), ("A", D(5), D(7))], 'entity string, start date, end date')
    actions = spark.createDataFrame([("A", D(3))], "entity string, effective date")
    assert {r["start"].day for r in pit.without_crossing(windows, actions).collect()} == {3, 5}


@pytest.mark.parametrize("cutoff,n", [("2024-01-05", 1), ("2024-01-02", 0)])
def test_backdated_rows(spark, cutoff, n):
    first = spark.createDataFrame([("d1", D(1))], "digest string, ingested_at date")
    later = spark.createDataFrame([("d1", D(1)), ("d2", D(3)), ("d3", D(9))], "digest string, ingested_at date")
    assert pit.backdated(first, later, at(cutoff)).count() == n
    assert pit.missing_history(first, later).count() == 0


def test_bars_known_at_a_decision(spark):
    """Of the newest known revision, of members, undone by a split that is known; later knowledge changes nothing."""
    from tidemark.operators import quality

    t = lambda n: dt.date(2025, 1, n)
    bar = lambda e, day, close, factor, known, k: (e, t(day), close, close, close, close, 1.0, factor, close, t(known), t(known), k)
    rows = spark.createDataFrame([
        bar("A", 6, 100.0, 1.0, 7, 1), bar("A", 6, 101.0, 1.0, 9, 2), bar("A", 6, 99.0, 1.0, 20, 3), bar("A", 7, 50.0, 0.5, 8, 1), bar("A", 8, 50.0, 0.5, 9, 1), bar("A", 9, -1.0, 1.0, 10, 1),
        bar("B", 6, 10.0, 1.0, 7, 1), bar("A", 12, 10.0, 1.0, 11, 1),
    ], "entity string, session date, open double, high double, low double, close double, volume double, factor double, value double, available_at date, ingested_at date, revision int")
    splits = spark.createDataFrame([("A", t(7), 2.0, t(7), t(7)), ("A", t(8), 2.0, t(12), t(12))], "entity string, effective date, ratio double, available_at date, ingested_at date")
    members = spark.createDataFrame([("A", t(n)) for n in (6, 7, 8, 9, 12)], "entity string, session date")
    got = quality.known_bars(rows, F.lit(t(12)), members, splits).collect()
    assert sorted((r["session"].day, r["close"], r["revision"]) for r in got) == [(6, 101.0, 2), (7, 50.0, 1)]


def test_tradable_bars_are_alone_and_without_errors(spark):
    """Each bar is judged where it lies; the bars are not joined with themselves."""
    from tidemark.operators import quality

    t = lambda n: dt.date(2025, 1, n)
    bar = lambda e, day, close, factor, volume=1.0, known=10: (e, day and t(day), close, close, close, close, volume, factor, t(known))
    bars = spark.createDataFrame([
        bar("A", 1, 5.0, 1.0), bar("A", 2, 5.0, 1.0), bar("A", 2, -5.0, 1.0), bar("A", 3, 5.0, 1.0), bar("A", 3, 6.0, 1.0), bar("A", 4, -5.0, 1.0), bar("A", 5, 5.0, 0.5), bar("A", 6, 5.0, 0.5), bar("A", 7, 5.0, None),
        bar("A", 8, 5.0, 1.0, -1.0), bar("A", 9, None, 1.0, 0.0), bar("A", 11, 5.0, 1.0), bar("B", 5, 5.0, 0.5), bar(None, 1, 5.0, 1.0), bar("A", None, 5.0, 1.0), bar("B", 1, None, 1.0),
    ], "entity string, session date, open double, high double, low double, close double, volume double, factor double, available_at date")
    splits = spark.createDataFrame([("A", t(5), 2.0), ("A", t(6), 2.0), ("A", t(6), 2.0), ("B", t(5), 3.0)], "entity string, effective date, ratio double")
    out = quality.tradable_bars(bars, splits)
    assert sorted((r["entity"], r["session"].day) for r in out.collect()) == [("A", 1), ("A", 5), ("A", 9)]
    assert "open" in out.columns and "_n" not in out.columns
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_snapshot_of_another_symbol(spark):
    from tidemark.operators import quality

    row = lambda asked, c: ("A", "JPY", 1.0, None, dt.date(2025, 1, 2), dt.date(2025, 1, 2), asked, c)
    rows = spark.createDataFrame([row("A", "JPY"), row("B", "JPY"), row("A", "USD"), row(None, "JPY")], "symbol string, currency string, price double, previous_close double, as_of date, ingested_at date, asked_symbol string, asked_currency string")
    assert [r["errors"] for r in quality.snapshot_errors(rows).collect()] == [[], *[["identity_mismatch"]] * 3]


def test_decisions_of_an_entity_are_added_up_where_its_rows_lie(spark):
    """The expanded rows aren't sent on, and no text is kept for their greatest revision."""
    from tidemark import plans

    out = plans.QUERIES["j01_asof_many"](spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(decision" not in plan and "max(revision" not in plan
