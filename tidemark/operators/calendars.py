"""Trading calendars and session grids: states, ordinals, shifts, weekly rebalances, exact previous sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def calendar_from_raw(days: DataFrame) -> DataFrame:
    """day, state, available_at, valid from (day, code, ingested_at): codes 1, 2 are open, 0, 3 closures of their kind; others and repeated days aren't valid."""
    code = F.col("code")
    states = days.groupBy("day").agg(F.count(F.lit(1)).alias("_n"), F.max("code").alias("code"), F.max("ingested_at").alias("available_at"))
    state = F.when(code.isin("1", "2"), "open").when(code.isin("0", "3"), F.concat(F.lit("exchange_closed_"), code))
    return states.select("day", state.alias("state"), "available_at", ((F.col("_n") == 1) & state.isNotNull()).alias("valid"))


def calendar_issues(calendar: DataFrame) -> DataFrame:
    """day, code: days missing between the ends, empty reasons, and open days on weekends or at the turn of the year."""
    ends = calendar.agg(F.min("day").alias("a"), F.max("day").alias("z"))
    missing = ends.select(F.explode(F.sequence("a", "z")).alias("day")).join(calendar.select("day"), "day", "left_anti").select("day", F.lit("missing_day").alias("code"))
    rest = F.dayofweek("day").isin(1, 7) | ((F.month("day") == 1) & (F.dayofmonth("day") <= 3)) | ((F.month("day") == 12) & (F.dayofmonth("day") == 31))
    return missing.union(calendar.where((F.col("state") == "open") & rest).select("day", F.lit("open_on_rest_day"))).union(calendar.where(F.coalesce(F.trim("state") == "", F.lit(True))).select("day", F.lit("empty_reason")))


def session_set_issues(sessions: DataFrame, calendar: DataFrame, start: str, end: str) -> DataFrame:
    """Sessions and open days of an interval that the other lacks."""
    open_days = calendar.where((F.col("state") == "open") & F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).select(F.col("day").alias("session"))
    return open_days.exceptAll(sessions).withColumn("code", F.lit("not_configured")).union(sessions.exceptAll(open_days).withColumn("code", F.lit("not_open")))


def ordinals(sessions: DataFrame) -> DataFrame:
    """session, ord from 1; the window is over the calendar alone, one row a session."""
    return sessions.select("session").distinct().withColumn("ord", F.row_number().over(W.orderBy("session")))


def shifted(sessions: DataFrame, n: int) -> DataFrame:
    """session, target: the n-th session after (before, if negative); null outside the calendar."""
    o = ordinals(sessions)
    return o.join(o.select(F.col("session").alias("target"), (F.col("ord") - n).alias("ord")), "ord", "left").select("session", "target")


def rebalance_sessions(sessions: DataFrame) -> DataFrame:
    """First session of each ISO week."""
    return sessions.groupBy(F.date_trunc("week", "session").cast("date").alias("week")).agg(F.min("session").alias("session"))


def previous_session_close(bars: DataFrame) -> DataFrame:
    """entity, session, close, previous_close: that of exactly the previous calendar session, else null."""
    o = ordinals(bars.select("session"))
    own = bars.join(F.broadcast(o), "session").select("entity", "session", "ord", "close")  # one row a session
    before = own.select("entity", (F.col("ord") + 1).alias("ord"), F.col("close").alias("previous_close"))
    return own.join(before, ["entity", "ord"], "left").select("entity", "session", "close", "previous_close")


def indexed(days: DataFrame, column: str) -> DataFrame:
    """One row: _days, the sorted days; _first, the first; _upto, how many lie before each day from it on.

    A row a day of history at most. ``between`` looks both ends of an interval up in it.
    """
    each = days.select(F.col(column).alias("_d")).distinct()
    ends = each.agg(F.to_date(F.min("_d")).alias("a"), F.to_date(F.max("_d")).alias("z"))
    counts = each.groupBy(F.to_date("_d").alias("_day")).agg(F.count(F.lit(1)).alias("_n"))
    calendar = ends.select(F.explode(F.sequence("a", F.date_add("z", 1))).alias("_day")).join(counts, "_day", "left")
    upto = calendar.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_day").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    upto = upto.agg(F.transform(F.sort_array(F.collect_list(F.struct("_day", "_before"))), lambda x: x["_before"].cast("int")).alias("_upto"), F.min("_day").alias("_first"))
    return each.agg(F.sort_array(F.collect_list("_d")).alias("_days")).crossJoin(upto)


def between(low: Column, high: Column, exact) -> Column:
    """The days of ``indexed`` in the joined row from ``low``'s day up to ``high``'s (null: no end), as far as
    ``exact`` (a predicate on a day) holds: both ends are looked up, so only days of the result are touched."""
    size = F.size("_upto")

    def before(day: Column) -> Column:
        at = F.datediff(F.to_date(day), F.col("_first"))
        return F.when(at < 0, F.lit(0)).when(at >= size, F.size("_days")).otherwise(F.element_at("_upto", F.least(F.greatest(at, F.lit(0)), size - 1) + 1))

    start = before(low)
    stop = F.when(high.isNull(), F.size("_days")).otherwise(before(F.date_add(F.to_date(high), 1)))
    return F.filter(F.slice("_days", start + 1, F.greatest(stop - start, F.lit(0))), exact)
