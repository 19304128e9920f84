"""Landed pages, documents, calendars, contracts and streams on small files."""

import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import calendars, enrich, ledger, quality, signals
from tidemark.sources import datasets, landed
from tidemark.streaming import forward

D = lambda n: dt.date(2025, 1, n)


def page(cursor, following, code, close):
    params = {"date": "2025-01-06"} | ({"pagination_key": cursor} if cursor else {})
    return {"path": "/daily", "params": params, "ingested_at": "2025-01-06T17:00:00+09:00", "response": {"data": [{"Date": "2025-01-06", "Code": code, "O": 100.0, "H": 110.0, "L": 95.0, "C": close, "Vo": 10000.0, "AdjFactor": 1.0}], "pagination_key": following}}


def land(folder, *pages):
    folder.mkdir()
    for i, p in enumerate(pages):
        (folder / f"{i}.json").write_text(json.dumps(p))
    return str(folder)


def test_pages_chain_and_become_observations(spark, tmp_path):
    pages = landed.read_pages(spark, land(tmp_path / "a", page(None, "page-2", "90001", 105.0), page("page-2", None, "90002", 210.0)))
    assert landed.pagination_issues(pages).count() == 0
    rows = landed.normalise_daily(landed.page_rows(pages), "vendor").orderBy("code").collect()
    assert [(r["entity_id"], r["close"], r["session"]) for r in rows] == [("vendor:90001", 105.0, D(6)), ("vendor:90002", 210.0, D(6))]
    assert rows[0]["event_at"] == dt.datetime(2025, 1, 5, 15) and rows[0]["available_at"] == dt.datetime(2025, 1, 6, 8)
    broken = landed.read_pages(spark, land(tmp_path / "b", page(None, "page-2", "90001", 1.0), page("page-3", None, "90002", 1.0)))
    assert {r["code"] for r in landed.pagination_issues(broken).collect()} == {"dangling_cursor", "missing_page"}


def test_body_integrity(spark, tmp_path):
    body = b'{"data": []}'
    (tmp_path / f"{hashlib.sha256(body).hexdigest()}.json").write_bytes(body)
    (tmp_path / f"{'0' * 64}.json").write_bytes(body)
    assert sorted(r["intact"] for r in landed.body_integrity(spark, str(tmp_path)).collect()) == [False, True]


def test_strict_documents(spark, tmp_path):
    doc = {"schema_version": 1, "events": [{"symbol": "A", "event_type": "earnings", "event_date": "2025-01-15", "announced_at": "2025-01-01T00:00:00Z", "source": "s", "status": "scheduled", "metadata": {}}] * 2}
    (tmp_path / "e.json").write_text(json.dumps(doc))
    rows = landed.read_document(spark, str(tmp_path), landed.EVENTS, ["symbol", "event_type", "event_date", "source"])
    assert rows.where("duplicate").count() == 2
    assert quality.event_errors(rows).first()["errors"] == []


def test_bodies_are_stored_once_and_meet_their_receipts(spark, tmp_path):
    path, texts = str(tmp_path / "bodies"), ["a\n", "b\nb\n", "é\n", "a\n"]
    names = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
    for _ in range(2):
        landed.store_bodies(spark.createDataFrame([(t,) for t in [*texts, None]], "body string"), path)
    found = landed.body_integrity(spark, path).collect()
    assert sorted(r["expected"] for r in found) == sorted(set(names)) and all(r["intact"] for r in found)
    receipts = spark.createDataFrame([(n, k) for k, n in enumerate([names[0], names[0], names[2], "f" * 64])], "body_sha256 string, k int")
    file = next((tmp_path / "bodies" / f"body_sha256={names[2]}").glob("part*"))
    assert [r["body"] for r in landed.verified_bodies(spark, path, receipts.where("k < 3")).orderBy("k").collect()] == ["a\n", "a\n", "é\n"]
    (file.parent / f".{file.name}.crc").unlink()
    file.write_text("è\n")
    status = landed.receipt_integrity(spark, path, receipts)
    assert sorted((str(r["k"]), r["status"]) for r in status.collect()) == [("0", "intact"), ("1", "intact"), ("2", "corrupt"), ("3", "missing"), ("None", "unreceipted")]
    for k in (2, 3):
        with pytest.raises(Exception, match="missing or corrupt"):
            landed.verified_bodies(spark, path, receipts.where(f"k = {k}")).collect()


def test_packed_bodies_meet_their_receipts(spark, tmp_path):
    path, texts = str(tmp_path / "packs"), ["a\n", "b\nb\n", "é\n", "a\n"]
    names = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
    for _ in range(2):
        landed.store_packs(spark.createDataFrame([(t,) for t in [*texts, None]], "body string"), path)
    assert sorted(r["body_sha256"] for r in landed.read_packs(spark, path).collect()) == sorted(set(names))
    bad = [(names[2], b"\xe8\n"), ("e" * 64, b"\xff"), (names[2], None)]  # a second content of one, another's, none
    spark.createDataFrame(bad, landed.PACK).write.mode("append").parquet(path)
    receipts = spark.createDataFrame([(n, k) for k, n in enumerate([names[0], names[0], names[2], "f" * 64])], "body_sha256 string, k int")
    status = landed.pack_integrity(spark, path, receipts, size=F.length("body")).collect()
    assert sorted((str(r["k"]), r["status"], str(r["size"])) for r in status) == [
        ("0", "intact", "2"), ("1", "intact", "2"), ("2", "corrupt", "None"), ("3", "missing", "None"), ("None", "unreceipted", "None"), ("None", "unreceipted", "None"),
    ]


def test_stored_bodies_make_no_folder_each(spark, tmp_path, monkeypatch):
    from tidemark.plans import landing

    monkeypatch.setattr(landing, "new_folder", lambda _, name: f"{tmp_path}/{name}")
    landing.QUERIES["s02_body_integrity"](spark, "/root/testdata/sf0.001")
    assert (tmp_path / "bodies").is_dir() and not [p for p in (tmp_path / "bodies").iterdir() if p.is_dir()]


def test_sink_is_create_only_and_verified(spark, tmp_path):
    rows = spark.range(50).select(F.sha2(F.col("id").cast("string"), 256).alias("digest"), F.when(F.col("id") > 3, F.col("id") / 7).alias("x"), F.lit("d").alias("dataset"))
    path = str(tmp_path / "o")
    digest = datasets.save_observations(rows, path)
    again = datasets.save_observations(rows.orderBy(F.rand()).repartition(3), str(tmp_path / "p"))
    assert digest == again  # in any order and partitions
    schema = "digest string, x double, dataset string"
    copy = datasets.load_observations(spark, path, schema, digest)
    assert copy.count() == 50
    with pytest.raises(Exception, match="(?i)exists"):
        datasets.save_observations(rows, path)
    changed = {
        "value": rows.withColumn("x", F.when(F.col("x") == 1, 2.0).otherwise(F.col("x"))),
        "null": rows.withColumn("x", F.coalesce("x", F.lit(0.0))),
        "lost": rows.limit(49),
        "twice": rows.union(rows.limit(1)),
    }
    for name, other in changed.items():
        datasets.save_observations(other, str(tmp_path / name))
        with pytest.raises(ValueError, match="digest differs"):
            datasets.load_observations(spark, str(tmp_path / name), schema, digest)


RUN = "value double, run_id string"


def test_runs_are_committed_whole(spark, tmp_path):
    path = str(tmp_path / "runs")
    fine = spark.createDataFrame([(1.0, "a"), (2.0, "b")], RUN)
    crash = fine.withColumn("value", F.when(F.col("run_id") == "b", F.raise_error(F.lit("crash")).cast("double")).otherwise(F.col("value")))
    with pytest.raises(Exception, match="crash"):
        landed.save_run({"orders": fine, "fills": crash}, path, "one")
    assert landed.read_run(spark, path, "orders", RUN) is None  # what was written before the crash isn't there
    landed.save_run({"orders": fine, "fills": fine.limit(0)}, path, "one")
    landed.save_run({"orders": fine.withColumn("run_id", F.lit("c"))}, path, "two")
    assert sorted(map(tuple, landed.read_run(spark, path, "orders", RUN).collect())) == [(1.0, "a"), (1.0, "c"), (2.0, "b"), (2.0, "c")]
    assert landed.read_run(spark, path, "fills", RUN).count() == 0
    for commit, rows in (("one", fine.withColumn("run_id", F.lit("d"))), ("three", fine)):
        with pytest.raises(ValueError, match="there already"):
            landed.save_run({"orders": rows}, path, commit)
    agree = lambda: {(r["commit"], r["name"]): r["digest"] == r["found_digest"] for r in landed.run_inventory(spark, path, {"orders": RUN, "fills": RUN}).collect()}
    assert agree() == {("one", "orders"): True, ("one", "fills"): True, ("two", "orders"): True}
    for part in (tmp_path / "runs" / "data").glob("orders-*/run_id=b/*"):
        part.unlink()
    assert agree()["one", "orders"] is False


def test_calendar_and_shift_over_a_holiday(spark):
    open_days = [D(n) for n in (6, 7, 8, 9, 10, 14, 15)]
    sessions = spark.createDataFrame([(d,) for d in open_days], "session date")
    target = {r["session"]: r["target"] for r in calendars.shifted(sessions, 1).collect()}
    assert target[D(10)] == D(14) and target[D(15)] is None
    raw = spark.createDataFrame([(D(6), "1", D(1)), (D(7), "0", D(2)), (D(7), "1", D(2)), (D(8), "9", D(1))], "day date, code string, ingested_at date")
    got = {r["day"].day: (r["state"], r["valid"]) for r in calendars.calendar_from_raw(raw).collect()}
    assert got[6] == ("open", True) and not got[7][1] and not got[8][1]


def test_reference_rules(spark):
    cal = spark.createDataFrame([(D(6), "open"), (D(13), "holiday")], "day date, state string")
    actions = spark.createDataFrame([("stock_split", D(6), 2.0, None, None), ("stock_split", D(13), 0.5, None, None), ("dividend", D(6), None, 1.0, D(5))], "kind string, effective date, ratio double, cash double, payment date")
    assert [r["errors"] for r in quality.reference_errors(actions, cal).orderBy("payment", "effective").collect()] == [[], ["effective_day_closed", "invalid_ratio"], ["payment_before_effective"]]
    life = spark.createDataFrame([(D(2), D(2), D(2))], "listing date, delisting date, event_at date")
    assert quality.lifecycle_errors(life).first()["errors"] == ["listing_not_before_delisting"]


def test_tradable_bars_need_an_explained_factor(spark):
    bars = spark.createDataFrame([("A", D(6), 1.0, 1.0, 1.0, 1.0, 1.0, 0.5, D(7)), ("B", D(6), 1.0, 1.0, 1.0, 1.0, 1.0, 0.5, D(7)), ("C", D(6), 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, D(7))], "entity string, session date, open double, high double, low double, close double, volume double, factor double, available_at date")
    splits = spark.createDataFrame([("A", D(6), 2.0)], "entity string, effective date, ratio double")
    assert {r["entity"] for r in quality.tradable_bars(bars, splits).collect()} == {"A", "C"}


def test_status_and_agreement_and_inventory(spark):
    st = spark.createDataFrame([("A", D(1), "halted", D(1), D(1)), ("A", D(3), "tradable", D(9), D(9)), ("B", D(1), "tradable", D(1), D(1))], "entity string, effective date, status string, available_at date, ingested_at date")
    got = {r["entity"]: r["may_trade"] for r in signals.effective_status(st, F.lit(D(5)), F.lit(D(6))).collect()}
    assert got == {"A": False, "B": True}
    one = spark.createDataFrame([(D(6), "A"), (D(6), "B")], "session date, entity string")
    bars = spark.createDataFrame([(D(6), "A", 1.0, None)], "session date, entity string, close double, volume double")
    assert {(r["entity"], r["code"]) for r in landed.agreement_issues(one, one.where("entity = 'A'"), bars).collect()} == {("B", "member_not_in_master"), ("A", "member_without_bar"), ("B", "member_without_bar")}
    e = spark.createDataFrame([("r", "a", "1"), ("r", "b", "2")], "run_id string, name string, digest string")
    p = spark.createDataFrame([("r", "a", "9"), ("r", "c", "2")], "run_id string, name string, digest string")
    assert {(r["name"], r["code"]) for r in landed.inventory_issues(e, p).collect()} == {("a", "digest_differs"), ("b", "missing"), ("c", "unexpected")}
    assert {r["check"]: r["failures"] for r in landed.preflight([("x", e), ("y", e.where("false"))]).collect()} == {"x": 2, "y": 0}
    assert landed.listing_coverage(bars, one).first()["listed_sessions"] == 1
    m = spark.createDataFrame([("2025-01-06", "2025-01-06", "1", "011"), ("2025-01-06", "2025-01-07", "2", "9")], "requested string, Date string, Code string, ProdCat string")
    assert [r["code_issue"] for r in landed.master_issues(m).orderBy("Code").collect()] == [None, "wrong_date"]


def test_blocked_and_exceptions(spark):
    from tidemark.operators import ledger

    f = spark.createDataFrame([("A", 0.5), ("A", None), ("B", None), ("C", 1.0)], "symbol string, factor double")
    assert {r["symbol"]: r["code"] for r in ledger.blocked_symbols(f).collect()} == {"A": "market_corporate_action_requires_review", "B": "market_adjustment_unknown"}
    a = spark.createDataFrame([("A", D(1), D(3), D(5), D(5), "x"), ("A", D(1), D(3), D(6), D(6), "y"), ("B", D(1), D(9), D(2), D(2), "x")], "entity string, event_at date, effective date, available_at date, ingested_at date, payload string")
    assert {r["entity"]: (r["late"], r["revised"]) for r in signals.action_exceptions(a, F.lit(D(1))).collect()} == {"A": (True, True), "B": (False, False)}


def test_event_days_and_news_order(spark):
    ev = spark.createDataFrame([("A", "earnings", D(15), D(1), "scheduled"), ("A", "dividend", D(10), D(1), "announced"), ("A", "stock_split", D(22), D(1), "scheduled"), ("A", "stock_split", D(22), D(20), "scheduled"), ("A", "stock_split", D(23), D(1), "scheduled")], "symbol string, event_type string, event_date date, announced_at date, status string").withColumn("source", F.lit("s"))
    flags = enrich.event_flags(enrich.events_at(ev, F.lit(D(8)))).first()
    assert (flags["events"], flags["flags"]) == (4, "dividend_soon,earnings_soon,stock_split_upcoming")
    assert [(r["rule"], r["days_until"], r["threshold_days"]) for r in flags["reasons"]] == [("dividend_soon", 2, 7), ("earnings_soon", 7, 7), ("stock_split_upcoming", 14, 14)]
    # To the second, and by the exchange's day: 15:00 UTC is the next day there.
    old = spark.createDataFrame([("A", "earnings", D(15), dt.datetime(2025, 1, 1, 12), "scheduled", "s")], "symbol string, event_type string, event_date date, announced_at timestamp, status string, source string")
    seen = lambda at: enrich.events_at(old, F.lit(at)).select("days_until", "freshness").first()
    assert tuple(seen(dt.datetime(2025, 1, 31, 12))) == (-16, "fresh") and tuple(seen(dt.datetime(2025, 1, 31, 12, 0, 1))) == (-16, "stale")
    assert seen(dt.datetime(2025, 1, 10, 14, 59))["days_until"] == 5 and seen(dt.datetime(2025, 1, 10, 15))["days_until"] == 4
    t = lambda h: dt.datetime(2025, 1, 8, h)
    news = spark.createDataFrame([("A", "u", "s", None), ("A", "b", "s", t(8)), ("A", "a", "s", t(8)), ("A", "f", "s", t(20))], "symbol string, id string, source string, published_at timestamp")
    top = enrich.news_top(news, F.lit(t(9)))
    assert [r["id"] for r in top.orderBy("rank").collect()] == ["a", "b", "u"]
    assert enrich.news_flags(top, F.lit(t(9))).first()["flags"] == "recent_news,multiple_recent_news"


ROWS = "digest string, entity string, event_at date, available_at date, ingested_at timestamp, value double, revision string, source string, basis string"


def observations(spark, *days):
    return spark.createDataFrame([(f"d{n}", "A", D(1), D(n), dt.datetime(2025, 1, n), float(n), f"r{n}", "s", "observed") for n in days], ROWS)


def test_streams_equal_batches(spark, tmp_path):
    source = str(tmp_path / "in")
    observations(spark, 2, 3).write.parquet(source)
    observations(spark, 3, 5).write.mode("append").parquet(source)
    stream = lambda: spark.readStream.schema(ROWS).parquet(source)
    forward.ingest(stream(), str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination(120)
    assert sorted(r["digest"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["d2", "d3", "d5"]
    for _ in range(2):
        forward.ingest_checked(stream(), str(tmp_path / "ok"), str(tmp_path / "late"), str(tmp_path / "c2"), F.lit(D(3))).awaitTermination(120)
    assert sorted(r["digest"] for r in spark.read.parquet(str(tmp_path / "ok")).collect()) == ["d3", "d5"]
    assert [r["digest"] for r in spark.read.parquet(str(tmp_path / "late")).collect()] == ["d2"]
    forward.latest_revisions(stream(), str(tmp_path / "log"), str(tmp_path / "c3")).awaitTermination(120)
    log = spark.read.schema(ROWS).parquet(str(tmp_path / "log"))
    assert forward.current_revisions(log, F.lit(D(9))).first()["value"] == 5.0


def test_compacted_logs_answer_later_decisions_alike(spark):
    """Rows not yet available, and a second content of a superseded availability, still count."""
    from tidemark.operators import pit

    row = lambda k, at, ing, v, r: (f"{k}{r}", k, D(1), D(at), dt.datetime(2025, 1, ing), v, r, "s", "observed")
    rows = [row("A", 2, 2, 1.0, "a"), row("A", 4, 4, 2.0, "b"), row("A", 2, 8, 9.0, "c"), row("B", 7, 7, 5.0, "d"), row("B", 3, 3, 4.0, "e"), row("C", 2, 3, 1.0, "f"), row("C", 2, 2, 1.0, "g"), row("D", 2, 3, 1.0, "h"), row("D", 2, 2, 3.0, "i"), row("D", 5, 5, 3.0, "j")]
    log = spark.createDataFrame(rows, ROWS)
    for early in (1, 3, 5, 8, 12):
        kept = forward.compacted(log, F.lit(D(early)))
        for late in range(early, 13):
            whole = sorted(pit.as_of(log, F.lit(D(late))).select("entity", "value", "ambiguous").collect())
            assert sorted(forward.current_revisions(kept, F.lit(D(late))).select("entity", "value", "ambiguous").collect()) == whole
    assert forward.compacted(log, F.lit(D(12))).count() < log.count()


DECISIONS = "series string, session date, generated_at timestamp, body string"


def decision(series, day, body="b", hour=12, late=0):
    return series, D(day), dt.datetime(2025, 1, day + late, hour), body


def decided(spark, folder, batches, first=1):
    """Rows of ``path`` after each batch has been landed and the stream run again; an empty batch is a plain restart."""
    calendar = spark.createDataFrame([(D(n), k, dt.datetime(2025, 1, n, 9)) for k, n in enumerate((6, 7, 8, 9, 10, 14), 1)], "session date, ordinal int, cutoff timestamp")
    for rows in batches:
        if rows:
            spark.createDataFrame(rows, DECISIONS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(DECISIONS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        forward.append_decisions(stream, calendar, f"{folder}/out", f"{folder}/state", first).awaitTermination(120)
    return forward.read_decisions(spark, f"{folder}/out")


def test_decisions_of_several_batches_equal_those_of_one(spark, tmp_path):
    """A batch that comes again and a restart add nothing but their refusals; the head is the built chain's."""
    whole = [decision(s, n) for s in "AB" for n in (6, 7, 8, 9, 10, 14)]
    once = decided(spark, str(tmp_path / "one"), [whole]).where("accepted").drop("accepted")
    parts = [[r for r in whole if r[1] <= D(7)], [r for r in whole if r[1] == D(8)], [], [r for r in whole if r[1] == D(8)], [r for r in whole if r[1] > D(8)]]
    several = decided(spark, str(tmp_path / "many"), parts)
    assert sorted(several.where("accepted").drop("accepted").collect()) == sorted(once.collect()) and once.count() == 12
    assert [(r["code"], r["n"]) for r in several.where("NOT accepted").groupBy("code").agg(F.count(F.lit(1)).alias("n")).collect()] == [("already_recorded", 2)]
    built = ledger.build_chain(once.select("series", "session", "digest"), "series", "session", "digest")
    assert sorted(map(tuple, built.collect())) == sorted(map(tuple, ledger.chain_heads(once, "series").collect()))


def test_a_decision_goes_to_its_series_as_one_text(spark, tmp_path):
    """One column of a series passes through Python, whatever its texts hold; times far off keep their microseconds."""
    far = dt.datetime(2400, 1, 1, 0, 0, 0, 123457)
    rows = [("A", D(6), far, "x"), ("A", D(7), None, "y"), ('B"\n|é', D(6), dt.datetime(2025, 1, 6, 12), '{"é\\'), ("C", None, far, None)]
    spark.createDataFrame(rows, DECISIONS).coalesce(1).write.parquet(f"{tmp_path}/in")
    calendar = spark.createDataFrame([(D(n), k, dt.datetime(2025, 1, n, 9)) for k, n in enumerate((6, 7), 1)], "session date, ordinal int, cutoff timestamp")
    job = forward.append_decisions(spark.readStream.schema(DECISIONS).parquet(f"{tmp_path}/in"), calendar, f"{tmp_path}/out", f"{tmp_path}/state")
    job.awaitTermination(120)
    found = sorted(map(tuple, forward.read_decisions(spark, f"{tmp_path}/out").select("series", "session", "generated_at", "body", "code").collect()))
    assert found == sorted([(*rows[0], None), (*rows[1], "session_not_closed"), (*rows[2], None), (*rows[3], "unknown_session")])
    assert "step(series#" in (plan := job._jsq.explainInternal(False)) and plan.split("step(series#")[1].split(")")[0].count(",") == 1


def test_decisions_take_strictly_the_next_session(spark, tmp_path):
    rows = [decision("A", 6), decision("A", 8), decision("B", 7), decision("C", 6, hour=8), decision("C", 6), decision("D", 11), decision("E", 6, late=3), decision("E", 7, late=1), decision("F", 6, "x"), decision("F", 6, "y"), decision("G", 10), decision("G", 14), (None, D(6), dt.datetime(2025, 1, 6, 12), "b")]
    found = decided(spark, str(tmp_path / "a"), [rows])
    codes = sorted((str(r["series"]), r["session"].day, r["body"], str(r["code"])) for r in found.where("series <> 'G' OR series IS NULL").collect())
    assert codes == [
        ("A", 6, "b", "None"), ("A", 8, "b", "not_next_session"), ("B", 7, "b", "not_next_session"), ("C", 6, "b", "None"), ("C", 6, "b", "session_not_closed"), ("D", 11, "b", "unknown_session"),
        ("E", 6, "b", "None"), ("E", 7, "b", "generated_not_increasing"), ("F", 6, "x", "None"), ("F", 6, "y", "already_recorded"), ("None", 6, "b", "None"),
    ]
    later = decided(spark, str(tmp_path / "b"), [[decision("G", 10), decision("G", 14)]], first=5)
    assert later.where("accepted").count() == 2  # a series may begin late; the next session skips closed days


def test_short_forward_report(spark):
    eq = spark.createDataFrame([("r", D(n), 100.0 + n) for n in (6, 7, 8)], "run string, session date, equity double")
    row = forward.report(eq, eq, 100.0, 2).first()
    assert (row["reason"], row["relative_return"], row["lower"]) == ("insufficient_forward_history", 0.0, None)
