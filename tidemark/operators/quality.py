"""Data quality: contracts as arrays of error codes, bar rules, revision duplicates, coverage, gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import pit

QUOTES = ("open", "high", "low", "close")
COUNTED = (*QUOTES, "volume", "turnover", "factor")
#: Currencies of the ledger and the form of its symbols (fixed values).
CURRENCIES = "JPY USD EUR GBP CHF CAD AUD NZD HKD SGD CNY SEK NOK DKK INR KRW TWD".split()
SYMBOL = r"^[A-Z0-9][A-Z0-9.\-]{0,31}$"
CONTROL = r"[\x00-\x1F\x7F]"


def _no_text(c: str, limit: int, empty: bool = False) -> Column:
    """Whether ``c`` isn't a text of at most ``limit`` characters without control characters, blank only if ``empty``."""
    text = F.col(c)
    good = (F.length(text) <= limit) & ~text.rlike(CONTROL)
    return ~F.coalesce(good if empty else good & (F.length(F.trim(text)) > 0), F.lit(False))


def _codes(*rules: tuple[Column, str]) -> Column:
    """Sorted array of the codes whose condition holds; an unknown condition doesn't."""
    return F.sort_array(F.array_compact(F.array(*[F.when(c, F.lit(code)) for c, code in rules])))


def observation_errors(rows: DataFrame) -> DataFrame:
    """``rows`` with ``errors``: what the observation contract forbids."""
    empty = reduce(lambda a, c: a | F.coalesce(F.trim(F.col(c)) == "", F.lit(True)), ("entity_id", "source", "revision_id"), F.lit(False))
    return rows.withColumn("errors", _codes(
        (empty, "empty_identifier"),
        (~F.coalesce(F.trim("payload_json").rlike(r"^\{.*\}$"), F.lit(False)), "payload_not_object"),
        (~F.coalesce(F.col("basis").isin("observed", "documented", "estimated"), F.lit(False)), "unknown_basis"),
        (F.col("published_at") > F.col("available_at"), "published_after_available"),
        ((F.col("basis") == "observed") & (F.col("available_at") < F.col("ingested_at")), "available_before_ingestion"),
        (F.col("basis").isin("documented", "estimated") & (F.col("published_at").isNull() | F.col("evidence").isNull()), "missing_evidence"),
    ))


def daily_row_errors(rows: DataFrame, numeric: list[str]) -> DataFrame:
    """``rows`` of raw texts with ``errors``: code, ISO date and numbers (null, or finite and no boolean)."""
    bad = [(F.col(c).isNotNull() & (F.col(c).try_cast("double").isNull() | ~F.col(c).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")), f"not_a_number:{c}") for c in numeric]
    return rows.withColumn("errors", _codes((~F.coalesce(F.length("code") > 0, F.lit(False)), "invalid_code"), (F.col("date").try_cast("date").isNull() | ~F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$"), "invalid_date"), *bad))


def bar_issues(bars: DataFrame) -> DataFrame:
    """entity, session, severity, code: a row for each rule that a bar breaks; ``bars`` has available_at and factor."""
    issues = F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(s).alias("severity"), F.lit(code).alias("code"))) for cond, s, code in _bar_rules(bars)]))
    return bars.select("entity", "session", F.inline(issues))


def _bar_rules(bars: DataFrame) -> list[tuple[Column, str, str]]:
    """Condition, severity and code of each rule."""
    o, h, lo, c = (F.col(x) for x in QUOTES)
    nulls = reduce(lambda a, x: a + F.col(x).isNull().cast("int"), QUOTES, F.lit(0))
    quiet = (nulls == 4) & (F.coalesce(F.col("volume"), F.lit(0.0)) == 0)
    positive = reduce(lambda a, x: a & (F.col(x) > 0) & ~F.isnan(F.col(x)), QUOTES, F.lit(True))
    v, f = F.col("volume"), F.col("factor")
    # Columns that came as texts of a payload and hold no number, or no session: the payload has another schema.
    broken = F.col("schema_ok") == F.lit(False) if "schema_ok" in bars.columns else F.lit(False)
    return [
        (broken | F.col("session").isNull(), "error", "invalid_schema"),
        (F.col("available_at") < F.date_add("session", 1), "warning", "intraday_availability"),
        (F.col("available_at") < F.col("session"), "error", "future_bar"),
        (quiet, "warning", "missing_quotes"),
        ((nulls > 0) & ~quiet, "error", "partial_quotes"),
        ((nulls == 0) & ~positive, "error", "invalid_price"),
        ((nulls == 0) & positive & ~((lo <= F.least(o, c)) & (F.greatest(o, c) <= h)), "error", "ohlc_order"),
        (v.isNull(), "warning", "missing_volume"),
        ((v < 0) | F.isnan(v), "error", "invalid_volume"),
        (v == 0, "warning", "zero_volume"),
        (f.isNull(), "warning", "missing_adjustment_factor"),
        ((f <= 0) | F.isnan(f), "error", "invalid_adjustment_factor"),
    ]


def revision_duplicates(rows: DataFrame, key: list[str], payload: str, order: list[str]) -> DataFrame:
    """Rows that repeat an earlier (key, revision): duplicate_revision if the payload is the previous one's, else revision_conflict."""
    w = W.partitionBy(*key, "revision").orderBy(*order)
    marked = rows.withColumn("_n", F.row_number().over(w)).withColumn("_before", F.lag(payload).over(w)).where("_n > 1")
    return marked.withColumn("code", F.when(F.col("_before").eqNullSafe(F.col(payload)), "duplicate_revision").otherwise("revision_conflict")).drop("_n", "_before")


def coverage_issues(observed: DataFrame, expected: DataFrame) -> DataFrame:
    """entity, session, code: missing_session where only expected, unexpected_session where only observed."""
    a = observed.select("entity", "session").distinct().withColumn("_o", F.lit(1))
    e = expected.select("entity", "session").distinct().withColumn("_e", F.lit(1))
    return a.join(e, ["entity", "session"], "full_outer").where("_o IS NULL OR _e IS NULL").select("entity", "session", F.when(F.col("_o").isNull(), "missing_session").otherwise("unexpected_session").alias("code"))


def grid(sessions: DataFrame, entities: DataFrame) -> DataFrame:
    """Every entity on every session; the calendar side is one row a session of history."""
    calendar = sessions.agg(F.sort_array(F.collect_set("session")).alias("_days"))
    return entities.crossJoin(F.broadcast(calendar)).select("entity", F.explode("_days").alias("session"))


def gate(rows: DataFrame, issues: DataFrame) -> DataFrame:
    """``rows`` if no issue is an error, else no rows."""
    errors = issues.where("severity = 'error'").limit(1).agg(F.count(F.lit(1)).alias("_errors"))
    return rows.crossJoin(F.broadcast(errors)).where("_errors = 0").drop("_errors")


def study_errors(studies: DataFrame) -> DataFrame:
    """Per study: whether its periods are ordered and disjoint, its universe known before, its symbols unique."""
    w = W.partitionBy("study").orderBy("place")
    checked = studies.withColumn("_before", F.lag("end").over(w))
    return checked.groupBy("study").agg(
        F.bool_and((F.col("start") <= F.col("end")) & (F.col("_before").isNull() | (F.col("_before") < F.col("start")))).alias("ordered"),
        F.bool_and(F.col("known_at") < F.col("start")).alias("universe_known"),
        F.bool_and(F.size("symbols") == F.size(F.array_distinct("symbols"))).alias("symbols_unique"),
    )


def transaction_errors(tx: DataFrame) -> DataFrame:
    """``tx`` with ``errors`` by the ledger's contract; amounts have at most 18 whole and 12 fraction digits."""
    def amount(c: str, least: str) -> Column:
        x = F.col(c).try_cast("decimal(30,12)")
        return x.isNull() | (x < F.lit(least).cast("decimal(30,12)"))

    return tx.withColumn("errors", _codes(
        (~F.coalesce(F.col("id").rlike(r"^[A-Za-z0-9_.|:-]{1,64}$"), F.lit(False)), "invalid_id"),
        (~F.coalesce(F.col("symbol").cast("string").rlike(SYMBOL), F.lit(False)), "invalid_symbol"),
        (~F.coalesce(F.col("currency").isin(*CURRENCIES), F.lit(False)), "unsupported_currency"),
        (~F.coalesce(F.col("side").isin("buy", "sell"), F.lit(False)), "invalid_side"),
        (amount("quantity", "0.000000000001"), "invalid_quantity"),
        (amount("price", "0.000000000001"), "invalid_price"),
        (amount("fee", "0"), "invalid_fee"),
        (F.col("executed_at") > F.col("created_at"), "executed_after_created"),
        (F.length("note") > 2000, "note_too_long"),
        (F.col("note").rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]"), "control_characters"),
    ))


def snapshot_errors(snapshots: DataFrame) -> DataFrame:
    """``snapshots`` with the codes of broken rules; where asked_symbol and asked_currency are there, it must be theirs."""
    asked = {"asked_symbol", "asked_currency"} <= set(snapshots.columns)
    other = ~(F.col("symbol").eqNullSafe(F.col("asked_symbol")) & F.col("currency").eqNullSafe(F.col("asked_currency"))) if asked else F.lit(False)
    return snapshots.withColumn("errors", _codes(
        (~F.coalesce(F.col("price") > 0, F.lit(False)), "invalid_price"),
        (F.col("previous_close") <= 0, "invalid_previous_close"),
        (F.col("ingested_at") < F.col("as_of"), "ingested_before_as_of"),
        (other, "identity_mismatch"),
    ))


def event_errors(events: DataFrame) -> DataFrame:
    return events.withColumn("errors", _codes(
        (~F.coalesce(F.col("event_type").isin("earnings", "dividend", "stock_split"), F.lit(False)), "invalid_type"),
        (~F.coalesce(F.col("status").isin("scheduled", "announced", "confirmed", "completed", "cancelled"), F.lit(False)), "invalid_status"),
        (F.col("event_date").try_cast("date").isNull(), "invalid_date"),
        (~F.coalesce(F.col("announced_at").cast("string").rlike(r"(Z|[+-]\d{2}:?\d{2})$"), F.lit(False)) if dict(events.dtypes).get("announced_at") == "string" else F.col("announced_at").isNull(), "announcement_without_zone"),
        (F.size("metadata") > 16, "too_much_metadata"),
    ))


URL = r"^https?://([A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)*[A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?(:([1-9][0-9]{0,3}|[1-5][0-9]{4}|6[0-4][0-9]{3}|65[0-4][0-9]{2}|655[0-2][0-9]|6553[0-5]))?([/?#][^\s]*)?$"


def url_ok(url: Column) -> Column:
    """An absolute http or https address without credentials, with ASCII host labels and a port of 1 to 65535."""
    return F.coalesce(url.rlike(URL) & (F.length(url) <= 2048), F.lit(False))


def article_errors(articles: DataFrame) -> DataFrame:
    """``articles`` with ``errors``; a missing time of publication is allowed."""
    keys = F.exists(F.map_keys("metadata"), lambda k: (F.length(k) > 64) | (F.length(F.trim(k)) == 0))
    values = F.exists(F.map_values("metadata"), lambda v: F.length(v) > 256)
    return articles.withColumn("errors", _codes(
        (_no_text("id", 128), "invalid_id"),
        (~F.coalesce(F.col("symbol").cast("string").rlike(SYMBOL), F.lit(False)), "invalid_symbol"),
        (_no_text("title", 300), "invalid_title"),
        (_no_text("source", 120), "invalid_source"),
        (_no_text("summary", 600, empty=True), "invalid_summary"),
        (~F.coalesce(F.col("language").rlike("^[A-Za-z]{2,8}(-[A-Za-z0-9]{1,8})*$") & (F.length("language") <= 35), F.lit(False)), "invalid_language"),
        (~url_ok(F.col("url")), "invalid_url"),
        ((F.size("metadata") > 8) | keys | values, "invalid_metadata"),
    ))


def reference_errors(actions: DataFrame, calendar: DataFrame) -> DataFrame:
    """``actions`` (kind, effective, ratio, cash, payment) with ``errors``; ``calendar`` has day and state."""
    days = calendar.select(F.col("day").alias("_day"), F.col("state").alias("_state"))
    joined = actions.join(days, actions["effective"] == days["_day"], "left")
    return joined.withColumn("errors", _codes(
        (~F.coalesce(F.col("kind").isin("stock_split", "reverse_split", "dividend"), F.lit(False)), "unknown_kind"),
        (~F.coalesce(F.col("_state") == "open", F.lit(False)), "effective_day_closed"),
        ((F.col("kind") == "stock_split") & ~F.coalesce(F.col("ratio") > 1, F.lit(False)), "invalid_ratio"),
        ((F.col("kind") == "reverse_split") & ~F.coalesce((F.col("ratio") > 0) & (F.col("ratio") < 1), F.lit(False)), "invalid_ratio"),
        ((F.col("kind") == "dividend") & ~F.coalesce(F.col("cash") > 0, F.lit(False)), "invalid_cash"),
        ((F.col("kind") == "dividend") & ~F.coalesce(F.col("payment") >= F.col("effective"), F.lit(False)), "payment_before_effective"),
    )).drop("_day", "_state")


def lifecycle_errors(life: DataFrame) -> DataFrame:
    return life.withColumn("errors", _codes((F.col("delisting") <= F.col("listing"), "listing_not_before_delisting"), (F.col("event_at") != F.col("listing"), "event_is_not_listing")))


def known_bars(rows: DataFrame, decision: Column, members: DataFrame, splits: DataFrame) -> DataFrame:
    """The bars that a run may use at ``decision``: the newest revision known by then of each (entity, session) before it,
    of ``members`` (entity, session) alone, tradable by the splits known by then.

    ``rows``: bars with value, revision, available_at and ingested_at; ``splits``: entity, effective, ratio,
    available_at, ingested_at. Ambiguous revisions stay, marked by ``ambiguous``.
    """
    known = pit.as_of(rows, decision, key=("entity", "session")).where(F.col("session") < decision)
    own = known.join(members.select("entity", "session").distinct(), ["entity", "session"], "left_semi")
    told = splits.where((F.col("available_at") < decision) & (F.col("ingested_at") < decision))
    return _undone(own.where(~_any_error(own)), told)  # a key has one bar by now


def tradable_bars(bars: DataFrame, splits: DataFrame) -> DataFrame:
    """Bars without error issues, unique, whose factor is 1 or undone by exactly one known split of that day (factor * ratio = 1)."""
    counted = bars.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("entity", "session")))
    once = counted.where((F.col("_n") == 1) & F.col("entity").isNotNull() & F.col("session").isNotNull() & ~_any_error(bars))
    return _undone(once.drop("_n"), splits)


def _any_error(bars: DataFrame) -> Column:
    """Whether a bar breaks a rule that is an error; told from its own row, without a join with ``bar_issues``."""
    return reduce(lambda a, c: a | F.coalesce(c, F.lit(False)), [c for c, severity, _ in _bar_rules(bars) if severity == "error"], F.lit(False))


def _undone(bars: DataFrame, splits: DataFrame) -> DataFrame:
    """Bars whose factor is 1 or undone by exactly one split of that day."""
    known = splits.groupBy("entity", F.col("effective").alias("session")).agg(F.count(F.lit(1)).alias("_splits"), F.max("ratio").alias("_ratio"))
    undone = (F.col("_splits") == 1) & (F.abs(F.col("factor") * F.col("_ratio") - 1) < 1e-9)
    return bars.join(known, ["entity", "session"], "left").where((F.col("factor") == 1) | undone).drop("_splits", "_ratio")


def coverage_report(bars: DataFrame, sessions: DataFrame) -> DataFrame:
    """Per entity over the calendar: rows, sessions with quotes and with volume, missing
    sessions, duplicates, revisions, days whose factor isn't 1, and the nulls of every column in COUNTED that is there."""
    quoted = reduce(lambda a, c: a & F.col(c).isNotNull(), QUOTES, F.lit(True))
    content = F.sha2(F.concat_ws("|", *[F.coalesce(F.round(F.col(c) * 1000).cast("long").cast("string"), F.lit("null")) for c in (*QUOTES, "volume")]), 256)
    cells = bars.withColumn("_c", content).groupBy("entity", "session").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("_c").alias("kinds"), F.bool_or(quoted).alias("quoted"), F.bool_or(F.col("volume").isNotNull()).alias("traded"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in COUNTED if c in bars.columns],
        F.count_if(F.col("factor") != 1).alias("factors") if "factor" in bars.columns else F.lit(0).alias("factors"),
    )
    full = grid(sessions, bars.select("entity").distinct()).join(cells, ["entity", "session"], "left")
    return full.groupBy("entity").agg(
        F.count(F.lit(1)).alias("expected_sessions"), F.coalesce(F.sum("n"), F.lit(0)).alias("acquired_rows"),
        F.count_if("quoted").alias("price_coverage"), F.count_if("traded").alias("volume_coverage"),
        F.count_if(F.col("n").isNull()).alias("missing_sessions"), F.coalesce(F.sum(F.col("n") - F.col("kinds")), F.lit(0)).alias("duplicate_rows"),
        F.coalesce(F.sum(F.col("kinds") - 1), F.lit(0)).alias("revisions"), F.coalesce(F.sum("factors"), F.lit(0)).alias("factor_events"),
        *[F.coalesce(F.sum(f"null_{c}"), F.lit(0)).alias(f"null_{c}") for c in COUNTED if c in bars.columns],
    )


def missing_sessions(bars: DataFrame, sessions: DataFrame) -> DataFrame:
    """entity, sessions: the sorted array of sessions without a bar."""
    full = grid(sessions, bars.select("entity").distinct()).join(bars.select("entity", "session").distinct(), ["entity", "session"], "left_anti")
    return full.groupBy("entity").agg(F.sort_array(F.collect_list("session")).alias("sessions"))
