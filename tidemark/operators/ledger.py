"""The average-cost ledger, valuation, alerts, assessment, account rebuild and hash chains."""

from __future__ import annotations

import decimal
import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import ordered
from tidemark.sources.folders import written

MONEY = "decimal(38,12)"
SUM = "decimal(36,12)"  # can be added to without losing digits


#: A symbol of more rows than these is cut into segments, which are folded side by side.
HOT_ROWS = 1_000_000


def positions(tx: DataFrame, order: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """symbol, currency, quantity, average_cost, total_cost, realized_pnl, oversold, last_tx: the ledger replayed.

    Exact: decimals of 12 digits, each product and share rounded half up once. Buys add cost, sells take their share of
    it, all on a full close; a sell of more than is held is counted and skipped. A ledger is ordered by nature: a
    symbol's rows are sorted into one task, which spills to disk, and the fold holds one state. But nothing of what came
    before is left where the holding is zero, so a symbol of more than ``hot_rows`` rows is cut there (``segments``),
    its parts are folded as if they were symbols of their own, and their sums are added.
    """
    tx = tx.select(*dict.fromkeys(["symbol", "currency", "executed_at", *_place(order)]))  # no more than the fold reads
    size = tx.groupBy("symbol", "currency").agg(F.count(F.lit(1)).alias("_n"))
    hot = size.where(F.col("_n") > hot_rows).select("symbol", "currency")
    if hot.isEmpty():
        return _folded(tx.withColumn("segment", F.lit(0).cast("long")), order).drop("segment")
    hot = F.broadcast(hot)  # at most a row for each hot_rows rows
    rest = tx.join(hot, ["symbol", "currency"], "left_anti").withColumn("segment", F.lit(0).cast("long"))
    cut = segments(tx.join(hot, ["symbol", "currency"], "left_semi"), order)
    parts = _folded(rest.unionByName(cut), order)
    # Only a symbol's last segment can hold anything.
    add = lambda c: F.sum(c).cast(MONEY).alias(c)
    return parts.groupBy("symbol", "currency").agg(
        add("quantity"), F.max("average_cost").alias("average_cost"), add("total_cost"), add("realized_pnl"), F.sum("oversold").alias("oversold"), F.max("last_tx").alias("last_tx"),
    )


def _place(order: list[str]) -> list[str]:
    return [*order, "side", "quantity", "price", "fee"]


def segments(tx: DataFrame, order: list[str]) -> DataFrame:
    """``tx`` with ``segment``: how often its symbol's holding was zero before the row.

    Prefix sums over ranges of the order find the places, so no task holds a symbol. They are right as long as nothing
    was oversold; from a symbol's first oversell on its rows stay in one segment, from the last zero before it.
    """
    by, place = ["symbol", "currency"], _place(order)
    amount = F.col("quantity").cast("decimal(30,12)")
    signed = F.when(F.col("side") == "buy", amount).otherwise(-amount)
    cut = ordered.ranged(tx, by, place)
    held = ordered.running_before(cut, by, place, {"_before": signed.cast("decimal(28,12)")})
    held = held.withColumn("_held", F.col("_before") + signed)
    zero, short = (F.col("_held") == 0).cast("long"), (F.col("_held") < 0).cast("long")
    marked = ordered.running_before(held, by, place, {"_zeros": zero, "_short": short})
    first = marked.where("_short = 0 AND _held < 0").groupBy(*by).agg(F.max("_zeros").alias("_last"))
    own = marked.join(F.broadcast(first), by, "left")  # some of the hot symbols
    return own.withColumn("segment", F.least("_zeros", F.coalesce("_last", "_zeros"))).select(*tx.columns, "segment")


def _folded(tx: DataFrame, order: list[str]) -> DataFrame:
    """The positions that each segment of each symbol leaves, from nothing."""
    kinds = {f.name: f.dataType.simpleString() for f in tx.schema}
    money = [f"{c} {MONEY}" for c in ("quantity", "average_cost", "total_cost", "realized_pnl")]
    key_kinds = [f"{c} {kinds[c]}" for c in ("symbol", "currency", "segment")]
    out = ", ".join([*key_kinds, *money, "oversold long", f"last_tx {kinds['executed_at']}"])

    unit = 10**12

    def half_up(a: int, b: int) -> int:
        """a / b for positive b."""
        return (2 * a + b) // (2 * b)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decimal.getcontext().prec = 60
        key, state, last = None, [0, 0, 0, 0], None
        columns = [x.split()[0] for x in out.split(", ")]

        def closed() -> tuple:
            held, cost, realized, oversold = state
            money = lambda x: decimal.Decimal(x).scaleb(-12)
            return (*key, money(held), money(half_up(cost * unit, held)) if held else None, money(cost), money(realized), oversold, last)

        for batch in batches:
            rows = []
            for *own, side, q, q12, p, p12, f, f12, at in zip(*(batch[c].tolist() for c in batch.columns)):
                if own != key:
                    if key is not None:
                        rows.append(closed())
                    key, state, last = own, [0, 0, 0, 0], at
                held, cost, realized, oversold = state
                q, fee = q * unit + q12, f * unit + f12
                value = half_up(q * (p * unit + p12), unit)
                if side == "buy":
                    state = [held + q, cost + value + fee, realized, oversold]
                elif q <= held:
                    share = cost if q == held else half_up(cost * q, held)
                    state = [held - q, cost - share, realized + value - fee - share, oversold]
                else:
                    state[3] += 1
                last = max(last, at)
            if rows:
                yield pd.DataFrame(rows, columns=columns)
        if key is not None:
            yield pd.DataFrame([closed()], columns=columns)

    by = ["symbol", "currency", "segment"]
    sorted_rows = tx.repartition(*by).sortWithinPartitions(*by, *_place(order))

    def halves(c: str) -> list[Column]:
        """Whole part and 12 digits as integers, which cost the fold a fraction of what decimals do."""
        amount = F.col(c).cast("decimal(30,12)")
        digits = F.pmod(amount, F.lit(1).cast("decimal(1,0)")) * F.lit(unit).cast("decimal(13,0)")
        return [F.floor(amount).cast("long").alias(c), digits.cast("long").alias(f"{c}_12")]

    amounts = [x for c in ("quantity", "price", "fee") for x in halves(c)]
    return sorted_rows.select(*by, "side", *amounts, "executed_at").mapInPandas(fold, out)


def append_batch(existing: DataFrame, batch: DataFrame, economic: list[str], order: list[str] | None = None) -> DataFrame:
    """``batch`` with ``code``: null for rows to append, else duplicate_id, duplicate_content or oversell.

    Of rows of the batch with one id or one economic content the least (id, then digest of all columns) counts. With
    ``order`` a symbol whose ledger would then sell more than it holds at any point is refused as a whole: running
    quantities over the existing and the new rows show it.
    """
    # The existing rows bring to each step only what it compares; the batch passes three exchanges, each row once.
    content = F.unhex(F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in economic]), 256), 1, 32))
    everything = F.unhex(F.substring(F.sha2(F.to_json(F.struct(*batch.columns)), 256), 1, 32))
    rows = batch.withColumns({"_old": F.lit(False), "_d": everything})

    def marked(rows: DataFrame, known: DataFrame, key: str, order: str, name: str) -> DataFrame:
        """``rows`` with ``name``: an existing row has the key, or a row of the batch before it has."""
        group = W.partitionBy(key)
        again = (F.row_number().over(group.orderBy("_old", "id", order)) > 1) | (F.max("_old").over(group) & F.col(key).isNotNull())
        return rows.unionByName(known.withColumn("_old", F.lit(True)), allowMissingColumns=True).withColumn(name, again).where("NOT _old")

    rows = marked(rows, existing.select("id"), "id", "_d", "_known_id").drop("_d")
    # Of one id's rows all but the least digest are known by now.
    rows = marked(rows.withColumn("_e", content), existing.select(content.alias("_e")), "_e", "_known_id", "_known_e")
    rows = rows.withColumn("code", F.when(F.col("_known_id"), "duplicate_id").when(F.col("_known_e"), "duplicate_content"))
    rows = rows.drop("_e", "_known_id", "_known_e")
    if order is None:
        return rows.drop("_old")
    signed = F.when(F.col("side") == "buy", F.col("quantity")).otherwise(-F.col("quantity"))
    both = rows.withColumn("_q", F.when(F.col("code").isNull(), signed)).unionByName(existing.select("symbol", "currency", *order, signed.alias("_q"), F.lit(True).alias("_old")), allowMissingColumns=True)
    group = W.partitionBy("symbol", "currency")
    running = both.withColumn("_held", F.sum("_q").over(group.orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
    short = F.col("symbol").isNotNull() & F.col("currency").isNotNull() & (F.min("_held").over(group) < 0)
    rows = running.withColumn("_short", short).where("NOT _old")
    return rows.withColumn("code", F.coalesce("code", F.when(F.col("_short"), "oversell"))).drop("_old", "_q", "_held", "_short")


def valued(pos: DataFrame, snapshots: DataFrame, as_of: Column, max_age_days: int) -> DataFrame:
    """``pos`` with valuation_status in this priority: closed, missing, future (observed or ingested after ``as_of``), stale,
    before_transaction, ok; and value, unrealized, unrealized_pct, daily_move where ok."""
    late = F.col("ingested_at") if "ingested_at" in snapshots.columns else F.lit(None).cast("timestamp")
    s = snapshots.select(F.col("symbol").alias("_s"), F.col("currency").alias("_c"), F.col("price").alias("current_price"), F.col("as_of").alias("snapshot_at"), late.alias("_ingested"), *([F.col("previous_close")] if "previous_close" in snapshots.columns else [F.lit(None).cast(MONEY).alias("previous_close")]))
    j = pos.join(s, (pos["symbol"] == s["_s"]) & (pos["currency"] == s["_c"]), "left").drop("_s", "_c")
    status = (
        F.when(F.col("quantity") == 0, "closed").when(F.col("current_price").isNull(), "missing").when((F.col("snapshot_at") > as_of) | F.coalesce(F.col("_ingested") > as_of, F.lit(False)), "future")
        .when(F.datediff(as_of, F.col("snapshot_at")) > max_age_days, "stale").when(F.col("snapshot_at") < F.col("last_tx"), "before_transaction").otherwise("ok")
    )
    ok = F.col("valuation_status") == "ok"
    # 12 whole digits of shares with 4 decimals, 9 of a price with 12: their product fits a decimal without loss.
    product = (F.col("quantity").cast("decimal(16,4)") * F.col("current_price").cast("decimal(21,12)")).cast(MONEY)
    zero = F.lit(0).cast(MONEY)
    value = F.when(ok, product).when(F.col("valuation_status") == "closed", zero)
    j = j.withColumn("valuation_status", status).withColumn("market_value", value).drop("_ingested")
    unrealized = F.when(F.col("valuation_status") == "closed", zero).otherwise((F.col("market_value") - F.col("total_cost")).cast(MONEY))
    ratio = lambda a, b: F.when(ok, F.try_divide((F.col(a) - F.col(b)).cast("double"), F.col(b).cast("double")))
    j = j.withColumn("unrealized", unrealized).withColumn("unrealized_pct", ratio("market_value", "total_cost"))
    return j.withColumn("daily_move", ratio("current_price", "previous_close"))


def currency_totals(v: DataFrame) -> DataFrame:
    """Per currency: cost, realized, known value, completeness, unpriced symbols; value and unrealized are null unless all open positions are priced."""
    unpriced = (F.col("quantity") > 0) & (F.col("valuation_status") != "ok")
    t = v.groupBy("currency").agg(
        F.sum("total_cost").alias("total_cost"), F.sum("realized_pnl").alias("realized_pnl"), F.sum(F.coalesce("market_value", F.lit(0).cast(MONEY))).alias("known_market_value"),
        (~F.bool_or(unpriced)).alias("complete"), F.sort_array(F.collect_list(F.when(unpriced, F.col("symbol")))).alias("unpriced_symbols"),
    )
    return t.withColumn("market_value", F.when(F.col("complete"), F.col("known_market_value"))).withColumn("unrealized", F.col("market_value") - F.col("total_cost"))


def weighted(v: DataFrame) -> DataFrame:
    """``v`` with portfolio_weight inside its currency, null where that isn't complete or worth nothing."""
    v = written(v, "valued")  # a row a symbol; else the ledger is replayed for the totals and again for the rows
    t = currency_totals(v).select("currency", F.when(F.col("market_value") > 0, F.col("market_value")).alias("_total"))
    return v.join(t, "currency").withColumn("portfolio_weight", F.col("market_value").cast("double") / F.col("_total").cast("double")).drop("_total")


RULES = (("take_profit_threshold", "info", "unrealized_pct", "ge"), ("loss_warning_threshold", "warning", "unrealized_pct", "le"), ("daily_move_threshold", "warning", "daily_move", "abs_ge"), ("concentration_threshold", "warning", "portfolio_weight", "gt"))
#: The concise names of triggered rules.
FLAGS = {"take_profit_threshold": "take_profit", "loss_warning_threshold": "loss_warning", "daily_move_threshold": "daily_move_warning", "concentration_threshold": "concentration_warning"}


def alerts(w: DataFrame, thresholds_pct: dict[str, float | None]) -> DataFrame:
    """A row for each open position and enabled rule; triggered stays null where the value is unknown."""
    rows = []
    for rule, severity, column, how in RULES:
        if (pct := thresholds_pct.get(rule)) is None:
            continue
        v, t = F.col(column), F.lit(pct / 100)
        hit = {"ge": v >= t, "le": v <= t, "abs_ge": F.abs(v) >= t, "gt": v > t}[how]
        reason = F.when(v.isNull(), "price_or_weight_unavailable").when(hit, "configured_threshold_reached").otherwise("configured_threshold_not_reached")
        rows.append(F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), v.alias("value"), t.alias("threshold"), hit.alias("triggered"), reason.alias("reason")))
    return w.where("quantity > 0").select("symbol", "currency", "valuation_status", F.inline(F.array(*rows)))


def assessment(w: DataFrame, thresholds_pct: dict[str, float | None]) -> DataFrame:
    """Per open position: state (fresh, stale, missing, blocked), severity, flags in rule order, and reason codes of what couldn't be evaluated."""
    state = F.when(F.col("valuation_status") == "ok", "fresh").when(F.col("valuation_status").isin("stale", "missing"), F.col("valuation_status")).otherwise("blocked")
    a = alerts(w, thresholds_pct).withColumn("state", state)
    order = F.lit(0)
    for i, (rule, *_) in enumerate(RULES):
        order = F.when(F.col("rule") == rule, i).otherwise(order)
    flag = F.lit(None).cast("string")
    for rule, name in FLAGS.items():
        flag = F.when(F.col("rule") == rule, name).otherwise(flag)
    code = F.when(F.col("triggered").isNull(), F.when((F.col("state") == "fresh") & (F.col("rule") == "daily_move_threshold"), "previous_close_unavailable").when((F.col("state") == "fresh") & (F.col("rule") == "concentration_threshold"), "currency_valuation_incomplete").otherwise("market_data_unavailable"))
    names = lambda c: F.transform(F.sort_array(F.collect_list(F.when(c.isNotNull(), F.struct(order.alias("o"), c.alias("n"))))), lambda s: s["n"])
    warn = F.bool_or(F.col("triggered").isNull() | (F.col("triggered") & (F.col("severity") == "warning")))
    out = a.groupBy("symbol", "currency", "state").agg(names(F.when(F.col("triggered"), flag)).alias("flags"), names(code).alias("reasons"), warn.alias("_warn"))
    return out.withColumn("severity", F.when(F.col("state") == "blocked", "critical").when((F.col("state") != "fresh") | F.col("_warn"), "warning").otherwise("info")).drop("_warn")


def assessment_summary(assessed: DataFrame) -> DataFrame:
    return assessed.groupBy("currency").agg(
        F.count(F.lit(1)).alias("positions"), F.count_if(F.col("state") == "stale").alias("stale"), F.count_if(F.col("state") == "missing").alias("missing"),
        F.count_if(F.col("state") == "blocked").alias("blocked"), F.sort_array(F.collect_list(F.when(F.array_contains("flags", "concentration_warning"), F.col("symbol")))).alias("concentrated"),
    )


def portfolio_summary(tx: DataFrame, v: DataFrame) -> DataFrame:
    """One row: transactions, open_positions, closed_positions, currencies, and whether all open positions are priced."""
    unpriced = (F.col("quantity") > 0) & (F.col("valuation_status") != "ok")
    n = tx.agg(F.count(F.lit(1)).alias("transactions"))
    p = v.agg(F.count_if(F.col("quantity") > 0).alias("open_positions"), F.count_if(F.col("quantity") == 0).alias("closed_positions"), F.array_join(F.sort_array(F.collect_set("currency")), ",").alias("currencies"), F.coalesce(~F.bool_or(unpriced), F.lit(True)).alias("valuation_complete"))
    return n.crossJoin(p)  # one row each


def blocked_symbols(factors: DataFrame) -> DataFrame:
    """symbol, code: any factor that isn't 1 asks for review; else any unknown one."""
    codes = factors.groupBy("symbol").agg(F.bool_or(F.col("factor") != 1).alias("c"), F.bool_or(F.col("factor").isNull()).alias("u"))
    return codes.select("symbol", F.when(F.col("c"), "market_corporate_action_requires_review").when(F.col("u"), "market_adjustment_unknown").alias("code")).where("code IS NOT NULL")


def trade_history(fills: DataFrame, orders: DataFrame) -> DataFrame:
    return fills.join(orders, "order_id")


def _flow() -> Column:
    """What a fill (side, notional, fee) does to cash."""
    return F.when(F.col("side") == "buy", -F.col("notional")).otherwise(F.col("notional")) - F.col("fee")


def account(fills: DataFrame, initial: int, by: str = "run") -> DataFrame:
    """run, session, cash: the initial cash less buys, plus sells, less fees, summed up to each session, as decimals."""
    daily = fills.groupBy(by, "session").agg(F.sum(_flow().cast(MONEY)).alias("flow"))
    return daily.select(by, "session", (F.lit(initial) + F.sum("flow").over(W.partitionBy(by).orderBy("session")).cast(SUM)).cast(MONEY).alias("cash"))


def equity(fills: DataFrame, marks: DataFrame, initial: int) -> DataFrame:
    """session, equity: cash plus the held quantities at their marks, as decimals; ``marks`` (entity, session, mark) on
    the whole grid. Whole shares of 16 digits, marks of 9 whole and 12 other digits."""
    held = fills.groupBy("entity", "session").agg(F.sum(F.when(F.col("side") == "buy", F.col("quantity")).otherwise(-F.col("quantity"))).alias("q"))
    w = W.partitionBy("entity").orderBy("session")
    upto = F.sum(F.coalesce("q", F.lit(0).cast(MONEY))).over(w)
    value = F.col("_q").cast("decimal(16,0)") * F.coalesce(F.col("mark").cast("decimal(21,12)"), F.lit(0).cast("decimal(21,12)"))
    value = marks.join(held, ["entity", "session"], "left").withColumn("_q", upto).groupBy("session").agg(F.sum(value).alias("held_value"))
    cash = fills.groupBy("session").agg(F.sum(_flow().cast(MONEY)).alias("flow"))
    both = value.join(cash, "session", "left")
    running = F.sum(F.coalesce("flow", F.lit(0).cast(MONEY))).over(W.orderBy("session"))  # one row a session
    return both.select("session", (F.lit(initial) + running.cast(SUM) + F.col("held_value").cast(SUM)).cast(MONEY).alias("equity"))


GENESIS = "0" * 64


#: Entries between two checkpoints of a chain.
EVERY = 100_000


def chain_entries(rows: DataFrame, series: str, order: str, digest: str) -> DataFrame:
    """series, seq (from 1), digest, previous_hash, entry_hash: h(i) = sha256(h(i-1) | i | digest(i)) from the genesis.

    A hash needs the one before it, so a series is built in one task: sorted there, which spills, and streamed over
    with the running hash as the only state. Rows that tie in ``order`` stand by their digests.
    """
    genesis, kind = GENESIS, rows.schema[series].dataType.simpleString()  # the tasks need no package of their own

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, n, head, started = None, 0, genesis, False
        for batch in batches:
            seqs, before, after = [], [], []
            for name, d in zip(batch["series"], batch["digest"]):
                if not started or name != key:
                    key, n, head, started = name, 0, genesis, True
                n += 1
                seqs.append(n)
                before.append(head)
                head = hashlib.sha256(f"{head}|{n}|{d}".encode()).hexdigest()
                after.append(head)
            yield batch.assign(seq=seqs, previous_hash=before, entry_hash=after)

    sorted_rows = rows.repartition(series).sortWithinPartitions(series, order, digest)
    held = sorted_rows.select(F.col(series).alias("series"), F.col(digest).alias("digest"))
    entries = held.mapInPandas(fold, f"series {kind}, digest string, seq long, previous_hash string, entry_hash string")
    return entries.select(F.col("series").alias(series), "seq", "digest", "previous_hash", "entry_hash")


def chain_checkpoints(entries: DataFrame, series: str, every: int = EVERY) -> DataFrame:
    """series, seq, head: the hash after each ``every`` entries; what ``verify_segments`` starts and ends at."""
    return entries.where(F.col("seq") % every == 0).select(series, "seq", F.col("entry_hash").alias("head"))


def chain_heads(entries: DataFrame, series: str) -> DataFrame:
    """series, entries, head: what a chain is recorded as."""
    return entries.groupBy(series).agg(F.max("seq").alias("entries"), F.max_by("entry_hash", "seq").alias("head"))


def build_chain(rows: DataFrame, series: str, order: str, digest: str) -> DataFrame:
    """The recorded heads of the chains that ``rows`` make."""
    return chain_heads(chain_entries(rows, series, order, digest), series)


def _compared(found: DataFrame, record: DataFrame, series: str) -> DataFrame:
    """``found`` (series, entries, head, ...) with count_right and head_right; a series that one side lacks is wrong."""
    kept = record.select(series, F.col("entries").alias("_n"), F.col("head").alias("_h"))
    both = found.join(kept, series, "full_outer")
    right = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    return both.withColumns({"count_right": right("entries", "_n"), "head_right": right("head", "_h")}).drop("_n", "_h")


def verify_chain(entries: DataFrame, record: DataFrame, series: str, every: int = EVERY) -> DataFrame:
    """Per series: contiguous (seq 1, 2, ... without gap or repeat), linked (each names the hash before it), hashes_right
    (each recomputes), and count_right, head_right against ``record`` (series, entries, head).

    Each entry is compared with the one before it inside its segment of ``every`` numbers; the last of a segment goes to
    the next one too, so a long series is verified in many tasks and none of them sorts a series.
    """
    number = F.floor(F.col("seq") / every)
    edge = F.col("seq") % every == every - 1
    held = entries.withColumn("_segment", F.explode(F.when(edge, F.array(number, number + 1)).otherwise(F.array(number))))
    w = W.partitionBy(series, "_segment").orderBy("seq")
    again = F.sha2(F.concat_ws("|", "previous_hash", F.col("seq").cast("string"), "digest"), 256)
    start = F.col("seq") == 1
    before = lambda c: F.lag(c).over(w)
    contiguous = F.when(before("seq").isNull(), start).otherwise(before("seq") == F.col("seq") - 1)
    link = F.when(start, F.lit(GENESIS)).otherwise(before("entry_hash"))
    linked = F.coalesce(F.col("previous_hash") == link, F.lit(False))
    e = held.select(series, "seq", "entry_hash", contiguous.alias("_s"), linked.alias("_p"), (F.col("entry_hash") == again).alias("_h"), (F.col("_segment") == number).alias("_own"))
    e = e.where("_own")  # an edge is judged in its own segment
    found = e.groupBy(series).agg(
        F.bool_and("_s").alias("contiguous"), F.bool_and("_p").alias("linked"), F.bool_and("_h").alias("hashes_right"),
        F.count(F.lit(1)).alias("entries"), F.max_by("entry_hash", "seq").alias("head"),
    )
    return _compared(found, record, series)


def verify_segments(rows: DataFrame, checkpoints: DataFrame, record: DataFrame, series: str, every: int = EVERY) -> DataFrame:
    """Per series: segments, wrong_segments, entries, count_right, head_right, from ``rows`` (series, seq, digest) alone.

    Hashes are made again, each segment from the checkpoint before it to the one after it, side by side; a segment is
    wrong where the numbers have a gap, the checkpoint before it is missing, or the hash isn't the one that the
    checkpoint after it holds (the record's head for the last segment).
    """
    genesis, kind = GENESIS, rows.schema[series].dataType.simpleString()

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None  # head, next number, entries, right

        def closed() -> tuple:
            return (*key, state[2], state[0], state[3])

        for batch in batches:
            out = []
            for name, segment, role, seq, value in batch.itertuples(index=False, name=None):
                if (name, segment) != key:
                    if key is not None:
                        out.append(closed())
                    key, state = (name, segment), [genesis if segment == 0 else None, segment * every + 1, 0, True]
                if role == 0:
                    state[0] = value
                elif role == 1:
                    state[3] = state[3] and seq == state[1] and state[0] is not None
                    state[0] = hashlib.sha256(f"{state[0]}|{seq}|{value}".encode()).hexdigest()
                    state[1], state[2] = seq + 1, state[2] + 1
                else:
                    state[3] = state[3] and state[0] == value
            yield pd.DataFrame(out, columns=["series", "segment", "entries", "head", "right"])
        if key is not None:
            yield pd.DataFrame([closed()], columns=["series", "segment", "entries", "head", "right"])

    def part(df: DataFrame, number: Column, role: int, value: str) -> DataFrame:
        return df.select(F.col(series).alias("series"), F.floor(number / every).alias("segment"), F.lit(role).alias("role"), "seq", F.col(value).alias("value"))

    ends = checkpoints.union(record.select(series, F.col("entries"), "head")).distinct()
    held = part(rows, F.col("seq") - 1, 1, "digest").union(part(checkpoints, F.col("seq"), 0, "head")).union(part(ends, F.col("seq") - 1, 2, "head"))
    held = held.repartition("series", "segment").sortWithinPartitions("series", "segment", "role", "seq", "value")
    each = held.mapInPandas(fold, f"series {kind}, segment long, entries long, head string, right boolean")
    each = each.where("entries > 0")  # the last checkpoint begins a segment that may be empty
    found = each.groupBy(F.col("series").alias(series)).agg(
        F.count(F.lit(1)).alias("segments"), F.count_if(~F.col("right")).alias("wrong_segments"), F.sum("entries").alias("entries"), F.max_by("head", "segment").alias("head"),
    )
    return _compared(found, record, series)


def same_outputs(stored: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Rows of one that the other lacks, with the side that has them; empty where past outputs are unchanged."""
    return reduce(DataFrame.union, (stored.exceptAll(recomputed).withColumn("side", F.lit("stored")), recomputed.exceptAll(stored).withColumn("side", F.lit("recomputed"))))
