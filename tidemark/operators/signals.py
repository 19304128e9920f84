"""Signals and vectorised portfolios over (run, session, entity) tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalars import ratio, rounded
from tidemark.operators import pit
from tidemark.operators.calendars import ordinals
from tidemark.operators.ordered import uncrossed
from tidemark.operators.quality import grid


def by_entity():
    return W.partitionBy("entity").orderBy("session")


def on_grid(bars: DataFrame) -> DataFrame:
    """``bars`` on every session of the calendar, with ``ord``; missing cells are null."""
    sessions = bars.select("session")
    full = grid(sessions, bars.select("entity").distinct())
    return full.join(bars, ["entity", "session"], "left").join(F.broadcast(ordinals(sessions)), "session")  # one row a session


def momentum(bars: DataFrame, lookback: int) -> DataFrame:
    """entity, session, score: close over the close ``lookback`` sessions before, minus 1, if no close between is missing."""
    w = by_entity()
    ready = F.count("close").over(w.rowsBetween(-lookback, 0)) == lookback + 1
    return on_grid(bars).withColumn("score", F.when(ready, ratio(F.col("close"), F.lag("close", lookback).over(w)) - 1)).where("score IS NOT NULL").select("entity", "session", "score")


def top_n(scores: DataFrame, n: int) -> DataFrame:
    """Positive scores only, best first, ties by entity."""
    w = W.partitionBy("session").orderBy(F.desc("score"), "entity")
    return scores.where("score > 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def daily_returns(bars: DataFrame) -> DataFrame:
    return on_grid(bars).withColumn("ret", ratio(F.col("close"), F.lag("close").over(by_entity())) - 1)


def features(bars: DataFrame, history: int = 61, members: DataFrame | None = None, actions: DataFrame | None = None, volume: bool = False) -> DataFrame:
    """return_5/20/60, volatility_20, ma_ratio_20, volume_change_5 where the last ``history`` closes are all there.

    ``members`` (session, entity): the entity belongs to the universe on the first and on the last of these sessions.
    ``actions`` (entity, effective): none takes effect after the first and up to the last. ``volume``: rows without a
    positive volume five sessions before, or without one now, are left out.
    """
    w = by_entity()
    f = daily_returns(bars)
    base = F.lag("volume", 5).over(w)
    f = f.select(
        "entity", "session", "ord", F.lag("session", history - 1).over(w).alias("_first"), F.count("close").over(w.rowsBetween(1 - history, 0)).alias("_n"),
        *[(ratio(F.col("close"), F.lag("close", k).over(w)) - 1).alias(f"return_{k}") for k in (5, 20, 60)],
        F.stddev_samp("ret").over(w.rowsBetween(-19, 0)).alias("volatility_20"), (ratio(F.col("close"), F.avg("close").over(w.rowsBetween(-19, 0))) - 1).alias("ma_ratio_20"),
        F.when(base > 0, F.col("volume") / base - 1).alias("volume_change_5"),
    )
    f = f.where(F.col("_n") == history).drop("_n")
    if volume:
        f = f.where("volume_change_5 IS NOT NULL")
    return _unbroken(f, "_first", "session", members, actions).drop("_first")


def _unbroken(rows: DataFrame, start: str, end: str, members: DataFrame | None, actions: DataFrame | None) -> DataFrame:
    """``rows`` (entity, ...) whose entity is a member at both ends and that no action crosses: start < effective <= end."""
    if members is not None:
        for side in (start, end):
            rows = rows.join(members.select("entity", F.col("session").alias(side)).distinct(), ["entity", side], "left_semi")
    if actions is not None:
        rows = uncrossed(rows, start, end, actions)
    return rows


#: Rows that a feature uses: the session's own and so many before it.
USES = {"return_5": 5, "return_20": 20, "return_60": 60, "volatility_20": 20, "ma_ratio_20": 19, "volume_change_5": 5}


def feature_lineage(bars: DataFrame, uses: dict[str, int] = USES) -> DataFrame:
    """entity, session, and for each feature known_<name>, the latest availability and ingestion of the rows that it
    uses, and sources_<name>, those rows in order: (session, revision, digest).

    ``bars``: entity, session, available_at, ingested_at, revision, digest. A list holds as many rows as the feature uses.
    """
    own = by_entity()
    row = F.when(F.col("revision").isNotNull(), F.struct("session", "revision", "digest"))
    columns = []
    for name, k in uses.items():
        used = own.rowsBetween(-k, 0)
        columns += [F.max(F.greatest("available_at", "ingested_at")).over(used).alias(f"known_{name}"), F.collect_list(row).over(used).alias(f"sources_{name}")]
    return on_grid(bars).select("entity", "session", *columns)


def forward_label(bars: DataFrame, horizon: int, members: DataFrame | None = None, actions: DataFrame | None = None, revisions: DataFrame | None = None, lag_days: int = 0) -> DataFrame:
    """entity, session, end, forward_return, y: over ``horizon`` sessions, where both closes are there.

    With ``members`` the entity belongs at both ends; with ``actions`` none takes effect after the first and up to the
    last day. With ``revisions`` (entity, session, close, available_at, ingested_at, revision, value) both closes are
    those known before the endpoint's cutoff, ``lag_days`` after the end: later revisions change no label.
    """
    w = by_entity()
    cells = on_grid(bars).select("entity", "session", "close", F.lead("session", horizon).over(w).alias("end"), F.lead("close", horizon).over(w).alias("_last"))
    if revisions is None:
        out = cells.withColumnRenamed("close", "_first")
    else:
        seen = pit.validity(revisions, ("entity", "session")).select("entity", F.col("session").alias("_day"), F.col("close").alias("_close"), "visible", "superseded")
        out = cells.select("entity", "session", "end").where("end IS NOT NULL").withColumn("_cutoff", F.date_add("end", lag_days))
        for day, name in (("session", "_first"), ("end", "_last")):
            known = (F.col("visible") < F.col("_cutoff")) & (F.col("superseded").isNull() | (F.col("_cutoff") <= F.col("superseded")))
            out = out.join(seen.withColumnRenamed("_day", day), ["entity", day]).where(known).withColumnRenamed("_close", name).drop("visible", "superseded")
    out = out.withColumn("forward_return", ratio(F.col("_last"), F.col("_first")) - 1).where("forward_return IS NOT NULL")
    out = _unbroken(out, "session", "end", members, actions)
    return out.select("entity", "session", "end", "forward_return", (F.col("forward_return") > 0).cast("int").alias("y"))


def stale_marks(bars: DataFrame) -> DataFrame:
    """entity, session, mark, stale: the last close so far, and whether it isn't the session's own; null before any."""
    return on_grid(bars).select("entity", "session", F.last("close", ignorenulls=True).over(by_entity().rowsBetween(W.unboundedPreceding, 0)).alias("mark"), F.col("close").isNull().alias("stale"))


def next_tradable(bars: DataFrame) -> DataFrame:
    """entity, session, fill_session: the first later session with a close and volume."""
    tradable = F.when(F.col("close").isNotNull() & (F.col("volume") > 0), F.col("session"))
    return on_grid(bars).select("entity", "session", F.min(tradable).over(by_entity().rowsBetween(1, W.unboundedFollowing)).alias("fill_session"))


def missing_data_events(bars: DataFrame) -> DataFrame:
    """entity, session, reason of each cell that can't trade: api_gap, missing_price, missing_volume, trading_halt."""
    full = grid(bars.select("session"), bars.select("entity").distinct()).join(bars.withColumn("_there", F.lit(True)), ["entity", "session"], "left")
    reason = F.when(F.col("_there").isNull(), "api_gap").when(F.col("close").isNull(), "missing_price").when(F.col("volume").isNull(), "missing_volume").when(F.col("volume") == 0, "trading_halt")
    return full.select("entity", "session", reason.alias("reason"))


def halt_streaks(events: DataFrame, sessions: DataFrame, limit: int = 5) -> DataFrame:
    """entity, start, length, stops of each run of consecutive sessions with a reason."""
    halted = events.where("reason IS NOT NULL").join(F.broadcast(ordinals(sessions)), "session")  # one row a session
    island = F.col("ord") - F.row_number().over(W.partitionBy("entity").orderBy("session"))
    runs = halted.withColumn("_i", island).groupBy("entity", "_i").agg(F.min("session").alias("start"), F.count(F.lit(1)).alias("length"))
    return runs.select("entity", "start", "length", (F.col("length") > limit).alias("stops"))


def walk_forward_folds(n_sessions: int | Column, train: int, validation: int, step: int, horizon: int, warmup: int = 60) -> Column:
    """Array of folds by session ordinal from 0: each trains, skips ``horizon``, validates, skips, then predicts ``step``."""
    first = warmup + train + validation + 2 * horizon
    last = (n_sessions if isinstance(n_sessions, Column) else F.lit(n_sessions)) - 1
    starts = F.when(last >= first, F.sequence(F.lit(first).cast("long"), last.cast("long"), F.lit(step).cast("long")))
    return F.transform(starts, lambda p, i: F.struct(
        i.alias("fold"), p.alias("predict_from"), F.least(p + step - 1, last).alias("predict_to"),
        (p - horizon - validation).alias("validate_from"), (p - horizon - 1).alias("validate_to"),
        (p - 2 * horizon - validation - train).alias("train_from"), (p - 2 * horizon - validation - 1).alias("train_to"),
    ))


def fold_samples(samples: DataFrame, n_sessions: int | Column, train: int, validation: int, step: int, horizon: int, warmup: int = 60) -> DataFrame:
    """``samples`` (ord from 0, label_ord) with fold and role in each of ``walk_forward_folds`` that they belong to; a
    label must be known strictly before what comes next.

    The folds that hold a sample follow from its ordinal, at most (train + validation + 2 horizon) / step + 2 of them,
    so there is nothing to join. ``n_sessions`` may be a column of the samples.
    """
    first = warmup + train + validation + 2 * horizon
    n = n_sessions if isinstance(n_sessions, Column) else F.lit(n_sessions)
    o, known = F.col("ord").cast("long"), F.col("label_ord")
    back = 2 * horizon + validation + train  # from the training's start to the prediction's
    low = F.greatest(F.floor((o - first) / step), F.lit(0))
    high = F.least(F.floor((o + back - first) / step), F.floor((n - 1 - first) / step))
    p = F.lit(first) + F.col("fold") * step
    role = (
        F.when(o.between(p - back, p - 2 * horizon - validation - 1) & (known < p - horizon - validation), "train")
        .when(o.between(p - horizon - validation, p - horizon - 1) & (known < p), "validate")
        .when(o.between(p, p + step - 1), "predict")
    )
    each = samples.withColumn("fold", F.explode(F.when((low <= high) & (n > first), F.sequence(low, high))))
    return each.withColumn("role", role).where("role IS NOT NULL")


def equal_weights(bars: DataFrame) -> DataFrame:
    """session, entity, weight: 1/n over the entities with a price that day."""
    return bars.where("close IS NOT NULL").select("session", "entity", (1 / F.count(F.lit(1)).over(W.partitionBy("session"))).alias("weight"))


def selected_weights(selected: DataFrame) -> DataFrame:
    return selected.select("session", "entity", (1 / F.count(F.lit(1)).over(W.partitionBy("session"))).alias("weight"))


def hold_weights(bars: DataFrame, rebalances: DataFrame) -> DataFrame:
    """Buy and hold: equal weights once, at the first rebalance session with any price."""
    first = bars.where("close IS NOT NULL").join(rebalances.select("session"), "session", "left_semi").agg(F.min("session").alias("session"))
    return equal_weights(bars.join(F.broadcast(first), "session", "left_semi"))  # one row


def lot_orders(weights: DataFrame, equity: float, cap: float, lot: int) -> DataFrame:
    """``weights`` (entity, session, weight, close) with target shares in lots under the cap, and the order against the last target."""
    target = F.floor(equity * F.least(F.col("weight"), F.lit(cap)) / F.col("close") / lot) * lot
    return weights.withColumn("target", target).withColumn("order", F.col("target") - F.coalesce(F.lag("target").over(by_entity()), F.lit(0)))


def execution(fills: DataFrame, slip_bps: float, fee_bps: float, fixed: float = 0.0) -> DataFrame:
    """``fills`` (side, quantity, reference) with price, notional, commission and slippage_cost."""
    sign = F.when(F.col("side") == "buy", 1).otherwise(-1)
    price = F.col("reference") * (1 + sign * slip_bps / 10_000)
    return fills.withColumn("price", price).withColumn("notional", F.col("price") * F.col("quantity")).withColumn("commission", F.col("notional") * fee_bps / 10_000 + fixed).withColumn("slippage_cost", F.abs(F.col("price") - F.col("reference")) * F.col("quantity"))


def affordable_lots(cash: Column, price: Column, floor: Column, fixed: float, rate: float, lot: int) -> Column:
    return F.greatest(F.lit(0), F.floor((cash - floor - fixed) / (price * (1 + rate) * lot))) * lot


def headroom_lots(equity: Column, held: Column, reference: Column, price: Column, cap: float, fixed: float, rate: float, lot: int) -> Column:
    """Lots that still fit under the position cap once fees and slippage have lowered equity."""
    room = cap * (equity - fixed) - held * reference
    share = reference + cap * ((price - reference) + price * rate)
    return F.greatest(F.lit(0), F.floor(room / (share * lot))) * lot


def participation(orders: DataFrame, part: float, lot: int) -> DataFrame:
    """``orders`` (session, entity, id, requested, volume) with allowed: several orders share one session's capacity in id order."""
    used = F.coalesce(F.sum("requested").over(W.partitionBy("session", "entity").orderBy("id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    room = F.greatest(F.lit(0), F.floor((F.floor(F.col("volume") * part) - used) / lot) * lot)
    return orders.withColumn("allowed", F.least("requested", room))


def next_day(sessions: DataFrame, days: DataFrame) -> DataFrame:
    """session, next_day: the first of ``days`` after each session, or null; over one row a session and day."""
    both = sessions.select("session").distinct().withColumn("_own", F.lit(True)).unionByName(days.select("session").distinct().withColumn("_own", F.lit(False)))
    ordered = both.withColumn("_day", F.unix_date("session"))
    later = W.orderBy("_day").rangeBetween(1, W.unboundedFollowing)
    return ordered.withColumn("next_day", F.min(F.when(~F.col("_own"), F.col("session"))).over(later)).where("_own").select("session", "next_day")


def order_life_cycle(orders: DataFrame, fills: DataFrame, rebalances: DataFrame, exits: DataFrame | None = None) -> DataFrame:
    """entity, session, fill_session, status: filled at the first tradable session unless it is cancelled before.

    An order is cancelled at the next rebalance, unless its column ``hold`` (buy and hold) says otherwise, or on the
    first later day in ``exits`` (entity, session): an action or the end of membership. An exit comes before a fill of
    the same day, a rebalance after it.
    """
    orders = orders if "hold" in orders.columns else orders.withColumn("hold", F.lit(False))
    joined = orders.join(fills, ["entity", "session"], "left").join(next_day(orders, rebalances), "session")
    after = F.when(~F.col("hold"), F.col("next_day"))
    joined = joined.withColumn("_after", after).drop("next_day", "hold")
    if exits is None:
        joined = joined.withColumn("_exit", F.lit(None).cast("date"))
    else:
        e = exits.select(F.col("entity").alias("_e"), F.col("session").alias("_x"))
        first = joined.join(e, (F.col("entity") == F.col("_e")) & (F.col("_x") > F.col("session"))).groupBy("entity", "session").agg(F.min("_x").alias("_exit"))
        joined = joined.join(first, ["entity", "session"], "left")
    fill = F.col("fill_session")
    filled = fill.isNotNull() & (F.col("_after").isNull() | (fill <= F.col("_after"))) & (F.col("_exit").isNull() | (fill < F.col("_exit")))
    status = F.when(filled, "filled").when(F.col("_after").isNotNull() | F.col("_exit").isNotNull(), "cancelled").otherwise("pending")
    return joined.withColumn("status", status).drop("_after", "_exit")


def weight_backtest(weights: DataFrame, bars: DataFrame, cost_bps: float, initial: float) -> DataFrame:
    """``weight_backtests`` of one run: session, daily_return, equity."""
    runs = weights.sparkSession.range(1).select(F.lit("").alias("run"), F.lit(float(initial)).alias("initial"), F.lit(float(cost_bps)).alias("cost_bps"))
    return weight_backtests(weights.withColumn("run", F.lit("")), bars, runs).select("session", "daily_return", "equity")


def weight_backtests(weights: DataFrame, bars: DataFrame, runs: DataFrame) -> DataFrame:
    """run, session, initial, daily_return, equity: weights decided at t earn from t+2's return (filled at t+1's close),
    turnover costs at t+1.

    ``weights``: run, entity, session, weight; ``runs``: run, initial, cost_bps, a table of parameters. The running
    products are over one row a run and session.
    """
    rets = daily_returns(bars).select("entity", "session", F.coalesce("ret", F.lit(0.0)).alias("ret"))
    cells = rets.crossJoin(runs.select("run", "cost_bps", "initial"))  # every run holds every cell
    w = cells.join(weights.select("run", "entity", "session", "weight"), ["run", "entity", "session"], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    own = W.partitionBy("run", "entity").orderBy("session")
    held = w.select("*", F.coalesce(F.lag("weight", 2).over(own), F.lit(0.0)).alias("held"), F.coalesce(F.lag("weight", 1).over(own), F.lit(0.0)).alias("new"))
    cost = F.sum(F.abs(F.col("new") - F.col("held"))) * F.max("cost_bps") / 10_000
    daily = held.groupBy("run", "session").agg(F.max("initial").alias("initial"), (F.sum(F.col("held") * F.col("ret")) - cost).alias("daily_return"))
    path = F.exp(F.sum(F.log1p("daily_return")).over(W.partitionBy("run").orderBy("session")))
    return daily.withColumn("equity", F.col("initial") * path)


def lot_weights(weights: DataFrame, bars: DataFrame, lot: float) -> DataFrame:
    """``weights`` (run, initial, entity, session, weight) as far as whole lots of the initial capital allow."""
    priced = weights.join(bars.select("entity", "session", "close"), ["entity", "session"])
    return priced.withColumn("weight", F.floor(F.col("initial") * F.col("weight") / (F.col("close") * lot)) * lot * F.col("close") / F.col("initial")).drop("close")


def split_factors(actions: DataFrame) -> DataFrame:
    """entity, effective, until, ratio: the cumulative split ratio that holds from an effective day until the next."""
    w = W.partitionBy("entity").orderBy("effective")
    return actions.select("entity", "effective", F.lead("effective").over(w).alias("until"), F.exp(F.sum(F.log("ratio")).over(w)).alias("ratio"))


def split_positions(positions: DataFrame, splits: DataFrame) -> DataFrame:
    """``positions`` (entity, quantity, mark[, effective]) after the splits of the day; a fractional quantity is flagged.

    With ``effective`` a position meets the splits of its own day; else ``splits`` holds one day's.
    """
    key = ["entity", *[c for c in ("effective",) if c in positions.columns]]
    out = positions.join(splits.select(*key, "ratio"), key, "left").withColumn("ratio", F.coalesce("ratio", F.lit(1.0)))
    q = F.col("quantity") * F.col("ratio")
    return out.withColumn("new_quantity", q).withColumn("new_mark", F.col("mark") / F.col("ratio")).withColumn("fractional", F.abs(q - F.round(q)) > 1e-9)


def dividend_receivables(holdings: DataFrame, dividends: DataFrame) -> DataFrame:
    """entity, session, receivable: quantity held before the effective session times cash, from then until it is paid.

    Two windows over an entity's rows in order: one finds the last quantity before each dividend's effective day, one
    adds up what becomes due and what is paid. Every dividend counts, equal ones too.
    """
    due = dividends.select("entity", F.col("effective").alias("_t"), F.lit(0).alias("_k"), F.lit(None).cast("double").alias("quantity"), "effective", "payment", "cash")
    own = holdings.select("entity", F.col("session").alias("_t"), F.lit(1).alias("_k"), F.col("quantity").cast("double").alias("quantity"))
    both = own.unionByName(due, allowMissingColumns=True)
    before = W.partitionBy("entity").orderBy("_t", "_k").rowsBetween(W.unboundedPreceding, -1)
    amount = F.coalesce(F.last("quantity", ignorenulls=True).over(before), F.lit(0.0)) * F.col("cash")
    entitled = both.withColumn("_amount", amount).where("_k = 0 AND payment > effective")
    steps = entitled.select("entity", F.inline(F.array(F.struct(F.col("effective").alias("_t"), F.col("_amount").alias("_d")), F.struct(F.col("payment").alias("_t"), (-F.col("_amount")).alias("_d")))))
    steps = steps.groupBy("entity", "_t").agg(F.sum("_d").alias("_d"))
    days = holdings.select("entity", F.col("session").alias("_t"), F.lit(True).alias("_own"))
    rows = days.join(steps, ["entity", "_t"], "full_outer")
    upto = W.partitionBy("entity").orderBy("_t").rangeBetween(W.unboundedPreceding, 0)
    return rows.withColumn("receivable", F.coalesce(F.sum("_d").over(upto), F.lit(0.0))).where("_own").select("entity", F.col("_t").alias("session"), "receivable")


def action_exceptions(actions: DataFrame, start: Column, holdings: DataFrame | None = None, delistings: DataFrame | None = None) -> DataFrame:
    """entity, event_at, late, revised[, delisted_while_held]: reasons to stop a run.

    An action is late if it became known after its effective day, and revised if it has several versions. With
    ``holdings`` (entity, session, quantity) and ``delistings`` (entity, effective), the last quantity held before an
    entity's delisting counts too.
    """
    known = actions.groupBy("entity", "event_at").agg(F.min("effective").alias("effective"), F.min(F.greatest("available_at", "ingested_at")).alias("known"), F.count_distinct("payload").alias("versions"))
    out = known.select("entity", "event_at", ((F.to_date("known") > F.col("effective")) & (F.to_date("known") >= start)).alias("late"), (F.col("versions") > 1).alias("revised"))
    if holdings is None or delistings is None:
        return out
    ends = delistings.groupBy("entity").agg(F.min("effective").alias("_end"))
    held = holdings.join(ends, "entity").where("session < _end").groupBy("entity").agg((F.max_by("quantity", "session") > 0).alias("delisted_while_held"))
    return out.join(held, "entity", "left").withColumn("delisted_while_held", F.coalesce("delisted_while_held", F.lit(False)))


def effective_status(statuses: DataFrame, session: Column, cutoff: Column) -> DataFrame:
    """entity, status, may_trade: the latest status effective by the session and known before the cutoff."""
    known = statuses.where((F.col("effective") <= session) & (F.col("available_at") < cutoff) & (F.col("ingested_at") < cutoff))
    return known.groupBy("entity").agg(F.max_by("status", F.struct("effective", "available_at")).alias("status")).withColumn("may_trade", F.col("status").isin("tradable", "last_trading_day"))


def one_lot_purchases(quotes: DataFrame, capitals: DataFrame, lot: int, reserve: float, cap: float, slip: float, rate: float, fixed: float) -> DataFrame:
    """capital, symbol_count, cash_after: one lot each by rising price until the cash reserve or position cap is passed.

    A capital buys at most capital / (lot * price) symbols, so quotes above a capital's cash are left out before
    the running sums; capitals are a handful of rows.
    """
    c = F.broadcast(capitals)
    pairs = quotes.join(c, F.col("price") * lot <= F.col("capital"))
    by = W.partitionBy("capital").orderBy("price", "code").rowsBetween(W.unboundedPreceding, 0)
    fill = F.col("price") * (1 + slip)
    notional, fee = fill * lot, fill * lot * rate + fixed
    run = pairs.withColumn("_spent", F.sum(notional + fee).over(by)).withColumn("_loss", F.sum((fill - F.col("price")) * lot + fee).over(by))
    broken = (F.col("_spent") > F.col("capital") * (1 - reserve)) | (F.col("price") * lot > cap * (F.col("capital") - F.col("_loss")))
    kept = run.withColumn("_broken", F.max(broken.cast("int")).over(by)).where("_broken = 0")
    bought = kept.groupBy("capital").agg(F.count(F.lit(1)).alias("n"), F.max("_spent").alias("s"))
    return capitals.join(bought, "capital", "left").select("capital", F.coalesce("n", F.lit(0)).alias("symbol_count"), rounded(F.col("capital") - F.coalesce("s", F.lit(0.0)), 4).alias("cash_after"))
