"""Operators that cut one large group into parts side by side, against plain Python on one group."""

import bisect
import datetime as dt
import hashlib
import math
import random

from pyspark.sql import functions as F

from tidemark.operators import ledger, metrics, ordered, pit, signals

DAY = dt.date(2020, 1, 1)
TX = "symbol string, currency string, side string, quantity double, price double, fee double, executed_at date, seq int"


def ledger_rows(n, oversell):
    """A symbol that is sold out again and again, and a quiet one."""
    rng, held, rows = random.Random(3), 0, []
    for i in range(n):
        sell = held and rng.random() < 0.6
        q = held if sell and rng.random() < 0.5 else rng.randint(1, held) if sell else rng.randint(1, 9)
        if oversell and i in oversell:
            sell, q = True, held + 3
        held += 0 if oversell and i in oversell else -q if sell else q
        rows.append(("HOT", "JPY", "sell" if sell else "buy", float(q), rng.randint(1, 500) / 7, 0.25, DAY + dt.timedelta(i // 9), i))
    return rows + [("QUIET", "JPY", "buy", 2.0, 3.0, 0.0, DAY, 0)]


def test_a_hot_symbol_is_folded_in_segments(spark):
    for oversell in ((), (700,), (0, 40, 41)):
        tx = spark.createDataFrame(ledger_rows(900, oversell), TX)
        whole = ledger.positions(tx, ["executed_at", "seq"], hot_rows=10**9)
        parts = ledger.positions(tx, ["executed_at", "seq"], hot_rows=100)
        assert sorted(whole.collect()) == sorted(parts.select(*whole.columns).collect())
        assert whole.where("symbol = 'HOT'").first()["oversold"] == len(oversell)
        cut = ledger.segments(tx.where("symbol = 'HOT'"), ["executed_at", "seq"])
        counts = [r["count"] for r in cut.groupBy("segment").count().collect()]
        assert sum(counts) == 900 and (oversell[:1] == (0,) or len(counts) > 50)


def test_running_sums_go_over_ranges(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aab"), rng.randint(0, 400), i, rng.randint(-5, 9)) for i in range(3000)]
    cut = ordered.ranged(spark.createDataFrame(rows, "k string, o int, i int, v long").repartition(7), ["k"], ["o", "i"])
    got = ordered.running_before(cut, ["k"], ["o", "i"], {"s": F.col("v"), "n": F.lit(1).cast("long")})
    want, sums = {}, {}
    for k, o, i, v in sorted(rows):
        want[i] = tuple(sums.get(k, (0, 0)))
        s, n = want[i]
        sums[k] = (s + v, n + 1)
    assert {r["i"]: (r["s"], r["n"]) for r in got.collect()} == want


def test_area_of_many_scores(spark):
    rng = random.Random(9)
    pairs = [("f", round(rng.random(), 3), int(rng.random() < 0.4)) for _ in range(2500)] + [("g", 0.5, 1), ("g", 0.5, 0), ("h", 0.1, 0)]
    rows = metrics.probability_metrics(spark.createDataFrame(pairs, "fold string, p double, y int"), ["fold"]).collect()
    got = {r["fold"]: r["roc_auc"] for r in rows}
    pos, neg = [p for f, p, y in pairs if f == "f" and y], sorted(p for f, p, y in pairs if f == "f" and not y)
    won = sum(bisect.bisect_left(neg, p) + (bisect.bisect_right(neg, p) - bisect.bisect_left(neg, p)) / 2 for p in pos)
    assert math.isclose(got["f"], won / len(pos) / len(neg)) and got["g"] == 0.5 and got["h"] is None


def test_bootstrap_equals_drawing_row_by_row(spark):
    rng = random.Random(2)
    data = {"a": [(rng.gauss(0, 1), rng.randint(1, 4)) for _ in range(23)], "b": [(rng.random(), 1) for _ in range(8)], "c": [(1.0, 1)] * 7}
    rows = [(k, i, v, w) for k, own in data.items() for i, (v, w) in enumerate(own)]
    series = spark.createDataFrame(rows, "run string, i int, value double, weight int")
    for statistic in ("mean", "ratio"):
        got = {r["run"]: r for r in metrics.bootstrap_interval(series, 40, 4, 0.9, 3, statistic, ("run",)).collect()}
        for k, own in data.items():
            n, stats = len(own), []
            for r in range(40):
                drawn = [own[((r * 7919 + b * 104729 + 3) % n + j) % n] for b in range(-(-n // 4)) for j in range(4) if b * 4 + j < n]
                stats.append(sum(v for v, _ in drawn) / (sum(w for _, w in drawn) if statistic == "ratio" else len(drawn)))
            stats.sort()
            if n < 8:
                assert (got[k]["lower"], got[k]["reason"]) == (None, "insufficient_blocks")
            else:
                a = (1 - 0.9) / 2
                assert math.isclose(got[k]["lower"], stats[math.floor(a * 39)]) and math.isclose(got[k]["upper"], stats[math.ceil((1 - a) * 39)])


def test_windows_are_swept_past_actions(spark):
    rng = random.Random(7)
    day = lambda: DAY + dt.timedelta(rng.randint(0, 60))
    windows = [(rng.choice("AB"), *sorted((day(), day())), i) for i in range(300)]
    windows += [("A", None, DAY, 300), ("A", DAY, None, 301), (None, DAY, DAY + dt.timedelta(90), 302), windows[0]]
    actions = [(rng.choice("AC"), day()) for _ in range(12)] + [("B", DAY), ("A", None), (None, DAY + dt.timedelta(5))]
    got = pit.without_crossing(spark.createDataFrame(windows, "entity string, start date, end date, effective int"), spark.createDataFrame(actions, "entity string, effective date"))
    crossed = lambda e, s, t: any(e is not None and e == x and None not in (s, t, d) and s < d <= t for x, d in actions)
    want = [w for w in windows if not crossed(*w[:3])]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr) and 0 < len(want) < len(windows)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan  # one window over one shuffle


def test_folds_of_a_sample_follow_from_its_ordinal(spark):
    for n, train, validation, step, horizon, warmup in ((40, 6, 3, 4, 2, 1), (25, 5, 2, 1, 3, 0), (9, 6, 3, 4, 2, 1), (30, 4, 4, 7, 0, 2)):
        folds = spark.range(1).select(F.inline(signals.walk_forward_folds(n, train, validation, step, horizon, warmup))).collect()
        want = []
        for o in range(n):
            for f in folds:
                known = o + horizon
                if f["train_from"] <= o <= f["train_to"] and known < f["validate_from"]:
                    want.append((o, f["fold"], "train"))
                elif f["validate_from"] <= o <= f["validate_to"] and known < f["predict_from"]:
                    want.append((o, f["fold"], "validate"))
                elif f["predict_from"] <= o <= f["predict_to"]:
                    want.append((o, f["fold"], "predict"))
        samples = spark.range(n).select(F.col("id").alias("ord"), (F.col("id") + horizon).alias("label_ord"))
        got = signals.fold_samples(samples, n, train, validation, step, horizon, warmup)
        assert sorted(tuple(r) for r in got.select("ord", "fold", "role").collect()) == sorted(want)
        assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_one_chain_is_verified_in_segments(spark):
    digests = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(100)]
    entries = ledger.chain_entries(spark.createDataFrame(list(zip("s" * 100, range(100), digests)), "series string, at int, d string"), "series", "at", "d").cache()
    head = "0" * 64
    for i, d in enumerate(digests, 1):
        head = hashlib.sha256(f"{head}|{i}|{d}".encode()).hexdigest()
    record = ledger.chain_heads(entries, "series")
    assert record.first()["head"] == head and record.first()["entries"] == 100
    marks = ledger.chain_checkpoints(entries, "series", 10)
    fine = {"contiguous": True, "linked": True, "hashes_right": True, "count_right": True, "head_right": True}

    def verdict(changed, kept=record):
        row = ledger.verify_chain(changed, kept, "series", 10).first()
        return {k for k, v in fine.items() if row[k] != v}

    def wrong(changed, at=marks):
        row = ledger.verify_segments(changed.select("series", "seq", "digest"), at, record, "series", 10).first()
        return row["segments"], row["wrong_segments"], row["count_right"], row["head_right"]

    assert verdict(entries) == set() and wrong(entries) == (10, 0, True, True)
    lost = entries.where("seq <> 30")
    assert verdict(lost) == {"contiguous", "linked", "count_right"} and wrong(lost) == (10, 1, False, True)
    forged = entries.withColumn("digest", F.when(F.col("seq") == 95, "x").otherwise(F.col("digest")))
    assert verdict(forged) == {"hashes_right"} and wrong(forged) == (10, 1, True, False)
    # Two rows that change places: the number is hashed.
    swapped = entries.withColumn("seq", F.when(F.col("seq") == 5, 6).when(F.col("seq") == 6, 5).otherwise(F.col("seq")))
    assert verdict(swapped) == {"linked", "hashes_right"} and wrong(swapped)[1] == 1
    assert verdict(entries.where("seq < 100")) == {"count_right", "head_right"}
    assert verdict(entries.union(entries.where("seq = 50"))) >= {"contiguous", "count_right"}
    assert wrong(entries, marks.where("seq <> 20"))[1] == 1  # the segment that has nothing to start from


def test_an_appended_batch_passes_few_exchanges(spark):
    """Each row of a batch is sent for its id, its content and its symbol, and the existing rows as often: six exchanges."""
    old = spark.createDataFrame([("a", 1, "X", "buy", 5, 1), ("b", 1, "X", "sell", 2, 2), (None, 2, "X", "buy", 1, 1)], "id string, symbol int, currency string, side string, quantity long, at int")
    rows = [("a", 1, "X", "buy", 7, 3), ("c", 1, "X", "sell", 2, 2), ("d", 1, "X", "buy", 1, 4), ("d", 1, "X", "buy", 2, 5), (None, 2, "X", "buy", 9, 9), ("e", 3, "X", "sell", 1, 1), ("f", 4, "X", "buy", 6, 6), ("g", 4, "X", "buy", 6, 6)]
    out = ledger.append_batch(old, spark.createDataFrame(rows, old.schema), ["symbol", "side", "quantity", "at"], ["at"])
    found = sorted((r.id or "", r.quantity, r.code or "") for r in out.collect())
    codes = {(i, q): c for i, q, c in found}
    assert len(found) == 8 and {c for (i, _), c in codes.items() if i == "d"} == {"", "duplicate_id"}
    assert [codes[k] for k in (("", 9), ("a", 7), ("c", 2), ("e", 1), ("f", 6), ("g", 6))] == ["", "duplicate_id", "duplicate_content", "oversell", "", "duplicate_content"]
    assert out._jdf.queryExecution().sparkPlan().toString().count("Join") == 0
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 6


def test_ledger_lines_meet_few_suppliers_without_being_sent(spark):
    from tidemark.sources import bindings

    plan = bindings.ledger_rows(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def test_weights_replay_the_ledger_once(spark):
    from tidemark import plans

    plan = plans.QUERIES["v12_rule_alerts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan and "lineitem" not in plan
