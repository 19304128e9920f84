"""Point-in-time operators: the newest revision strictly known before a decision, intervals, ambiguity, history checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.calendars import between, indexed
from tidemark.operators.ordered import uncrossed

KEY = ("entity", "event_at")
INDEX = ("_days", "_upto", "_first")


def _micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def _order() -> Column:
    """Newer availability wins; equal content ties to the earliest ingestion, then to the greater revision."""
    return F.struct(F.col("available_at"), (-_micros("ingested_at")).alias("early"), F.col("revision"))


def as_of(rows: DataFrame, decision: Column, mode: str = "observed", knowledge_at: Column | None = None, allow_estimated: bool = True, key: tuple[str, ...] = KEY) -> DataFrame:
    """Per key the newest row with ``available_at`` before ``decision``, strictly.

    observed: it must have been ingested before the decision too. historical: one frozen ``ingested_at <=
    knowledge_at`` takes that test's place. ``ambiguous``: an eligible availability of the key has several contents,
    also a superseded one.
    """
    known = F.col("ingested_at") < decision if mode == "observed" else F.col("ingested_at") <= knowledge_at
    eligible = rows.where((F.col("available_at") < decision) & known)
    if not allow_estimated:
        eligible = eligible.where(F.col("basis") != "estimated")
    rest = [c for c in rows.columns if c not in key]
    contents = eligible.groupBy(*key, "available_at").agg(F.max_by(F.struct(*rest), _order()).alias("row"), F.max(_order()).alias("order"), (F.min("value") < F.max("value")).alias("split"))
    newest = contents.groupBy(*key).agg(F.max_by("row", "order").alias("row"), F.bool_or("split").alias("ambiguous"))
    return newest.select(*key, "row.*", "ambiguous")


def validity(rows: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """``rows`` with ``visible`` and ``superseded``: a row is the newest one for decisions d, visible < d <= superseded.

    A newer revision may be ingested late, so the end is the first time at which any newer row is visible.
    """
    visible = F.greatest("available_at", "ingested_at")
    later = W.partitionBy(*key).orderBy(_order()).rowsBetween(1, W.unboundedFollowing)
    return rows.withColumn("visible", visible).withColumn("superseded", F.min("visible").over(later))


def as_of_many(rows: DataFrame, decisions: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """``as_of`` for every ``decision`` of a calendar: each interval is expanded to the decisions inside it.

    The calendar is one row of arrays (a day of history each); a row looks up both ends of its interval, so the work is
    in proportion to the result.
    """
    inside = between(F.col("visible"), F.col("superseded"), lambda d: (d > F.col("visible")) & (F.col("superseded").isNull() | (d <= F.col("superseded"))))
    joined = validity(rows, key).crossJoin(F.broadcast(indexed(decisions, "decision")))  # one row
    return joined.withColumn("decision", F.explode(inside)).drop(*INDEX, "visible", "superseded")


def ambiguous_revisions(rows: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Keys and availabilities with different contents, and how many."""
    return rows.groupBy(*key, "available_at").agg(F.count_distinct("value").alias("contents")).where("contents > 1")


def membership(life: DataFrame, sessions: DataFrame) -> DataFrame:
    """(session, entity) with listing <= session < delisting, or open-ended; both ends are looked up in the calendar."""
    inside = between(F.col("listing"), F.col("delisting"), lambda d: (F.col("listing") <= d) & (F.col("delisting").isNull() | (d < F.col("delisting"))))
    return life.crossJoin(F.broadcast(indexed(sessions, "session"))).select(F.explode(inside).alias("session"), "entity")  # one row


def known_actions(actions: DataFrame, decision: Column) -> DataFrame:
    """Actions known at the decision, and whether an (entity, event) has two of them, which is an error."""
    return as_of(actions, decision).withColumn("duplicate", F.col("ambiguous"))


def without_crossing(windows: DataFrame, actions: DataFrame) -> DataFrame:
    """Windows (entity, start, end) that no action of the entity crosses: start < effective <= end."""
    return uncrossed(windows, "start", "end", actions)


def missing_history(earlier: DataFrame, later: DataFrame, digest: str = "digest") -> DataFrame:
    """Rows of an earlier observation set that a later one lacks."""
    return earlier.join(later.select(digest).distinct(), digest, "left_anti")


def backdated(earlier: DataFrame, later: DataFrame, cutoff: Column, digest: str = "digest") -> DataFrame:
    """New rows of ``later`` that claim an ingestion before the previous cutoff."""
    return later.join(earlier.select(digest).distinct(), digest, "left_anti").where(F.col("ingested_at") < cutoff)
