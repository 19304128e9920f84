"""The forward ledger as streams: incremental ingest, late data, current revisions, one decision a session, reports."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators import metrics, pit

LEAST_FORWARD = 60


def ingest(stream: DataFrame, path: str, checkpoint: str, delay: str = "7 days") -> StreamingQuery:
    """Append new observation records to ``path``; identical ones (by ``digest``) inside the delay are ignored."""
    new = stream.withWatermark("ingested_at", delay).dropDuplicatesWithinWatermark(["digest"])
    return new.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def _read(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows below ``path``, none where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def ingest_checked(stream: DataFrame, accepted: str, rejected: str, checkpoint: str, cutoff: Column, partition: str | None = None) -> StreamingQuery:
    """Append new records to ``accepted``; those that claim an ingestion before the previous decision's cutoff go to ``rejected``.

    A batch that is retried adds nothing: records that either side holds are left out. Both sides are laid out by
    ``partition`` (equal records agree in it), and a batch reads only the partitions that it touches.
    """

    def step(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        by = [partition] if partition else []
        known = _read(spark, accepted, batch.schema).select("digest", *by).union(_read(spark, rejected, batch.schema).select("digest", *by))
        if partition:
            known = known.join(F.broadcast(batch.select(partition).distinct()), partition, "left_semi")  # a few partitions
        new = batch.dropDuplicates(["digest"]).join(known.select("digest"), "digest", "left_anti").select(*batch.columns)
        late = F.coalesce(F.col("ingested_at") < cutoff, F.lit(True))
        for path, rows in ((rejected, new.where(late)), (accepted, new.where(~late))):
            rows.write.mode("append").partitionBy(*by).parquet(path)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_revisions(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append every observation to the log ``path``, each once. Nothing is dropped, so what is not yet available, or comes
    late for a superseded availability, counts when its decision comes."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def current_revisions(log: DataFrame, decision: Column, key: tuple[str, ...] = pit.KEY) -> DataFrame:
    """Per key the revision that holds at ``decision``, and whether any eligible availability is ambiguous."""
    return pit.as_of(log, decision, key=key)


def compacted(log: DataFrame, decision: Column, key: tuple[str, ...] = pit.KEY) -> DataFrame:
    """The rows of ``log`` that decisions from ``decision`` on can depend on.

    Of the rows that are eligible by then, each key and availability keeps its winner and one row of another value, if
    there is one; rows that aren't eligible yet stay.
    """
    known = (F.col("available_at") < decision) & (F.col("ingested_at") < decision)
    rest = [c for c in log.columns if c not in (*key, "available_at")]
    order = F.struct((-F.unix_micros(F.col("ingested_at").cast("timestamp"))).alias("early"), F.col("revision"))
    row = F.struct(*rest)
    kept = log.where(known).groupBy(*key, "available_at").agg(F.max_by(row, order).alias("won"), F.min_by(row, F.struct("value", "revision")).alias("least"), F.max_by(row, F.struct("value", "revision")).alias("most"))
    other = F.when(F.col("least.value") != F.col("won.value"), F.col("least")).when(F.col("most.value") != F.col("won.value"), F.col("most"))
    kept = kept.select(*key, "available_at", F.explode(F.array_compact(F.array("won", other))).alias("row")).select(*key, "available_at", "row.*")
    return kept.unionByName(log.where(F.coalesce(~known, F.lit(True))).select(*kept.columns)).select(*log.columns)


#: What the stream keeps of each series: entries and the last one's place in the calendar, time and hash.
SERIES_STATE = "entries long, ordinal long, generated_at long, head string"
GENESIS = "0" * 64
#: What ``append_decisions`` writes.
DECISIONS = (
    "series string, session date, body string, digest string, seq long, previous_hash string, entry_hash string, "
    "code string, generated_at timestamp, accepted boolean"
)


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DECISIONS).parquet(path)


def decision_digest(session: Column, generated_at: Column, body: Column) -> Column:
    """What a decision's hash covers: its session, its time in microseconds, and the digest of its body."""
    return F.sha2(F.concat_ws("|", session.cast("string"), F.unix_micros(generated_at).cast("string"), body), 256)


def append_decisions(stream: DataFrame, sessions: DataFrame, path: str, checkpoint: str, first: int = 1) -> StreamingQuery:
    """Append each series' decisions to ``path``, strictly the next session each time, chained by hash.

    ``stream``: series (string), session (date), generated_at (timestamp), body (a digest). ``sessions``: the frozen
    calendar (session, ordinal from 1, cutoff); a series begins at ordinal ``first``. The state of a series is its
    number of entries, the last one's ordinal and time, and the chain's head. Rows of one batch are taken in the order
    of (session, generated_at, body). ``path`` gets every row with seq, previous_hash, entry_hash and ``code``, by
    ``accepted``: null code for an entry, else why it is none: unknown_session, session_not_closed (generated before
    the cutoff), already_recorded, not_next_session, generated_not_increasing. A restart goes on from the state, and a
    batch that comes again finds its sessions recorded; h(i) = sha256(h(i-1) | i | ``decision_digest``).
    """
    genesis = GENESIS  # the tasks need no package of their own

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        entries, ordinal, generated, head = state.get if state.exists else (0, first - 1, None, genesis)
        rows = [json.loads(row) for frame in frames for row in frame["row"]]
        at = lambda r, c, none: (c not in r, r.get(c, none))  # noqa: E731; nulls last
        rows.sort(key=lambda r: (at(r, "place", 0), at(r, "micros", 0), at(r, "body", "")))
        for r in rows:
            place, micros = r.pop("place", None), r.get("micros")
            closed = r.pop("closed")
            if place is None:
                r["code"] = "unknown_session"
            elif not closed:
                r["code"] = "session_not_closed"
            elif place <= ordinal:
                r["code"] = "already_recorded"
            elif place != ordinal + 1:
                r["code"] = "not_next_session"
            elif generated is not None and micros <= generated:
                r["code"] = "generated_not_increasing"
            else:
                entries, ordinal, generated, before = entries + 1, place, micros, head
                head = hashlib.sha256(f"{before}|{entries}|{r['digest']}".encode()).hexdigest()
                r.update(seq=entries, previous_hash=before, entry_hash=head)
        if entries:
            state.update((entries, ordinal, generated, head))
        yield pd.DataFrame({"row": [json.dumps(r) for r in rows]})

    calendar = sessions.select("session", F.col("ordinal").cast("long").alias("place"), "cutoff")
    known = stream.select("series", "session", "generated_at", "body").join(calendar, "session", "left")
    digest = decision_digest(F.col("session"), F.col("generated_at"), F.col("body"))
    closed = F.coalesce(F.col("generated_at") >= F.col("cutoff"), F.lit(False))
    # A row goes to Python and back as one text: for a series of a few rows each column costs more there than the rows do.
    row = F.struct("series", F.unix_date("session").alias("day"), F.unix_micros("generated_at").alias("micros"), "body", digest.alias("digest"), "place", closed.alias("closed"))
    known = known.select("series", F.to_json(row, {"ignoreNullFields": "true"}).alias("row"))
    chained = known.groupBy("series").applyInPandasWithState(step, "row string", SERIES_STATE, "append", GroupStateTimeout.NoTimeout)
    made = "series string, day int, micros long, body string, digest string, seq long, previous_hash string, entry_hash string, code string"
    chained = chained.select(F.from_json("row", made, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    chained = chained.select(
        "series", F.date_from_unix_date("day").alias("session"), "body", "digest", "seq", "previous_hash", "entry_hash", "code",
        F.timestamp_micros("micros").alias("generated_at"), F.col("code").isNull().alias("accepted"),
    )
    written = chained.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return written.partitionBy("accepted").outputMode("append").trigger(availableNow=True).start()


def report(equity: DataFrame, benchmark: DataFrame, initial: float, block: int, replicates: int = 500, confidence: float = 0.95, seed: int = 1) -> DataFrame:
    """One row a run: its metrics, benchmark-relative return, interval of the mean return difference, or why there is none.

    ``equity`` and ``benchmark``: run, session, equity; each run has a benchmark path of its own.
    """
    difference = metrics.return_difference(metrics.returns(equity, initial), metrics.returns(benchmark, initial), ("run",))
    interval = metrics.difference_interval(difference, replicates, block, confidence, seed)
    own, other = metrics.performance(equity, initial), metrics.performance(benchmark, initial).select("run", F.col("cumulative_return").alias("benchmark_return"))
    n = equity.groupBy("run").agg(F.count(F.lit(1)).alias("sessions"))
    short = F.col("sessions") < max(LEAST_FORWARD, 2 * block)
    out = own.join(other, "run").join(n, "run").join(interval, "run", "left")
    return out.select(
        "run", "sessions", "cumulative_return", "max_drawdown", (F.col("cumulative_return") - F.col("benchmark_return")).alias("relative_return"),
        F.when(~short, F.col("lower")).alias("lower"), F.when(~short, F.col("upper")).alias("upper"), F.when(short, "insufficient_forward_history").otherwise(F.col("reason")).alias("reason"),
    )
