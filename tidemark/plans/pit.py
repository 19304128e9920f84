"""Point-in-time joins and dataset lineage."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalars import sha256_hex
from tidemark.operators import pit
from tidemark.plans.registry import registry
from tidemark.sources import bindings as b
from tidemark.sources import datasets

QUERIES, SQL, query = registry()

DECISION = "1996-06-01"
ORDER = "available_at DESC, ingested_at, revision DESC"
ELIGIBLE = f"available_at < DATE '{DECISION}' AND ingested_at < DATE '{DECISION}'"


def _asof_sql(where: str) -> str:
    return f"""SELECT entity, event_at, available_at, ingested_at, value, revision, source, basis,
  (entity, event_at) IN (SELECT (entity, event_at) FROM obs WHERE {where} GROUP BY entity, event_at, available_at HAVING count(DISTINCT value) > 1) AS ambiguous
FROM (SELECT *, row_number() OVER (PARTITION BY entity, event_at ORDER BY {ORDER}) AS k FROM obs WHERE {where}) WHERE k = 1"""


@query("j01_asof_single", b.OBS, sql_text=_asof_sql(ELIGIBLE))
def j01_asof_single(spark, sf):
    return pit.as_of(b.observations(spark, sf), F.lit(DECISION).cast("date"))


@query("j01_asof_no_estimates", b.OBS, sql_text=_asof_sql(ELIGIBLE + " AND basis <> 'estimated'"))
def j01_no_estimates(spark, sf):
    return pit.as_of(b.observations(spark, sf), F.lit(DECISION).cast("date"), allow_estimated=False)


@query("j01_asof_many", b.OBS, b.MONTHS, sql_text=f"""SELECT decision, entity, count(*) AS keys, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents, max(revision) AS last_revision FROM (
  SELECT d.session AS decision, o.*, row_number() OVER (PARTITION BY d.session, entity, event_at ORDER BY {ORDER}) AS k
  FROM months d JOIN obs o ON o.available_at < d.session AND o.ingested_at < d.session) WHERE k = 1 GROUP BY decision, entity""")  # fmt: skip
def j01_asof_many(spark, sf):
    """Every month as a decision; the rows known at each are added up by entity."""
    place = F.row_number().over(W.partitionBy("entity").orderBy("revision"))
    rows = b.observations(spark, sf).repartition("entity").withColumn("place", place)  # all that follows is inside an entity
    known = pit.as_of_many(rows, b.months(spark, sf).withColumnRenamed("session", "decision"))
    # Numbers are added up in place; the greatest revision is looked up by its place once the expanded rows are gone.
    totals = known.groupBy("decision", "entity").agg(F.count(F.lit(1)).alias("keys"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"), F.max("place").alias("place"))
    names = rows.select(F.col("entity").alias("_e"), F.col("place").alias("_p"), F.col("revision").alias("last_revision"))
    found = totals.join(names, F.col("entity").eqNullSafe(F.col("_e")) & (F.col("place") == F.col("_p")))
    return found.select("decision", "entity", "keys", "cents", "last_revision")


@query("j02_ambiguous_revisions", b.OBS, sql_text="SELECT entity, available_at, count(DISTINCT value) AS contents FROM obs GROUP BY ALL HAVING count(DISTINCT value) > 1")
def j02(spark, sf):
    return pit.ambiguous_revisions(b.observations(spark, sf), ("entity",))


@query("j03_asof_historical", b.OBS, sql_text=_asof_sql(f"available_at < DATE '{DECISION}' AND ingested_at <= DATE '1997-01-01'"))
def j03(spark, sf):
    return pit.as_of(b.observations(spark, sf), F.lit(DECISION).cast("date"), mode="historical", knowledge_at=F.lit("1997-01-01").cast("date"))


@query("j04_membership", b.LIFE, b.MONTHS, sql_text="SELECT session, count(*) AS members, sum(entity)::BIGINT AS entity_sum FROM life JOIN months ON listing <= session AND (delisting IS NULL OR session < delisting) GROUP BY session")
def j04(spark, sf):
    return pit.membership(b.lifecycle(spark, sf), b.months(spark, sf)).groupBy("session").agg(F.count(F.lit(1)).alias("members"), F.sum("entity").alias("entity_sum"))


WINDOWS = "windows AS (SELECT DISTINCT l_partkey AS entity, CAST(date_trunc('month', l_shipdate) AS DATE) AS start, CAST(date_trunc('month', l_shipdate) + INTERVAL 3 MONTH AS DATE) AS \"end\" FROM lineitem)"


@query("j06_without_crossing", b.CEV, WINDOWS, sql_text="SELECT entity, start, \"end\" FROM windows w WHERE NOT EXISTS (SELECT 1 FROM cev c WHERE c.event_type = 'stock_split' AND c.symbol = w.entity AND c.event_date > w.start AND c.event_date <= w.\"end\")")
def j06(spark, sf):
    start = F.trunc("l_shipdate", "month")
    windows = b.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("entity"), start.alias("start"), F.add_months(start, 3).alias("end")).distinct()
    actions = b.corporate_events(spark, sf).where("event_type = 'stock_split'").select(F.col("symbol").alias("entity"), F.col("event_date").alias("effective"))
    return pit.without_crossing(windows, actions)


DIGEST = "sha256(concat_ws('|', entity, event_at, available_at, ingested_at, CAST(round(value * 100) AS BIGINT), revision)) AS digest"


def _digests(spark, sf):
    rows = b.observations(spark, sf)
    return rows.withColumn("digest", sha256_hex(*[F.col(c) for c in ("entity", "event_at", "available_at", "ingested_at")], F.round(F.col("value") * 100).cast("long"), F.col("revision")))


@query("s04_normalise_observations", b.OBS, sql_text="SELECT entity, event_at, available_at, ingested_at, value, revision, source, basis FROM obs")
def s04(spark, sf):
    return b.observations(spark, sf)


@query("s05_row_digests", b.OBS, sql_text=f"SELECT revision, {DIGEST} FROM obs")
def s05(spark, sf):
    return _digests(spark, sf).select("revision", "digest")


@query("s06_dataset_digest", b.OBS, sql_text=f"SELECT bucket, count(*) AS n, sha256(string_agg(digest, '' ORDER BY digest)) AS bucket_digest FROM (SELECT substr(digest, 1, 4) AS bucket, digest FROM (SELECT {DIGEST} FROM obs)) GROUP BY bucket")
def s06(spark, sf):
    return datasets.bucket_digests(_digests(spark, sf), levels=2)


@query("s08_incremental_merge", b.OBS, sql_text=f"SELECT digest, min(bundle) AS bundle, count(*) AS copies FROM (SELECT DISTINCT 1 AS bundle, {DIGEST} FROM obs WHERE available_at < DATE '1997-01-01' UNION ALL SELECT DISTINCT 2, {DIGEST} FROM obs WHERE available_at >= DATE '1996-01-01') GROUP BY digest")
def s08(spark, sf):
    rows = _digests(spark, sf)
    first, second = rows.where("available_at < date'1997-01-01'"), rows.where("available_at >= date'1996-01-01'")
    return datasets.merge_bundles([first, second]).select("digest", "bundle", "copies")


@query("x03_exact_duplicates", b.OBS, sql_text="SELECT entity, source, CAST(sum(n - 1) AS BIGINT) AS duplicates FROM (SELECT entity, source, event_at, count(*) AS n FROM obs GROUP BY entity, source, event_at) GROUP BY entity, source")
def x03(spark, sf):
    return datasets.exact_duplicates(b.observations(spark, sf), ["entity", "source", "event_at"], ["entity", "source"])


@query("j16_backdated_rows", b.OBS, sql_text=f"SELECT revision, ingested_at FROM (SELECT *, {DIGEST} FROM obs WHERE available_at < DATE '1997-01-01') WHERE ingested_at < DATE '1996-01-01' AND digest NOT IN (SELECT {DIGEST} FROM obs WHERE available_at < DATE '1995-06-01')")
def j16(spark, sf):
    rows = _digests(spark, sf)
    return pit.backdated(rows.where("available_at < date'1995-06-01'"), rows.where("available_at < date'1997-01-01'"), F.lit("1996-01-01").cast("date")).select("revision", "ingested_at")


@query("j16_missing_history", b.OBS, sql_text=f"SELECT revision FROM (SELECT *, {DIGEST} FROM obs) WHERE source <> 'R' AND digest NOT IN (SELECT {DIGEST} FROM obs WHERE basis = 'observed')")
def j16_missing(spark, sf):
    rows = _digests(spark, sf)
    return pit.missing_history(rows.where("source <> 'R'"), rows.where("basis = 'observed'")).select("revision")


@query("f11_split_filter", b.OBS, sql_text="SELECT entity, event_at, revision FROM obs WHERE event_at BETWEEN DATE '1995-01-01' AND DATE '1995-12-31' AND available_at BETWEEN DATE '1995-01-01' AND DATE '1995-12-31' AND ingested_at BETWEEN DATE '1995-01-01' AND DATE '1995-12-31' AND source <> 'R'")
def f11(spark, sf):
    return datasets.in_period(b.observations(spark, sf), "1995-01-01", "1995-12-31").where("source <> 'R'").select("entity", "event_at", "revision")


PERIODS = "periods AS (SELECT * FROM (VALUES ('development', DATE '1992-01-01', DATE '1994-12-31'), ('validation', DATE '1995-01-01', DATE '1996-12-31'), ('holdout', DATE '1997-01-01', DATE '1998-12-31')) v(period, a, z))"


@query("f12_sealed_period", b.OBS, PERIODS, sql_text="SELECT period, count(entity) AS n_rows, count(CASE WHEN ingested_at > z THEN 1 END) AS crossing FROM periods LEFT JOIN obs ON event_at BETWEEN a AND z GROUP BY period")
def f12(spark, sf):
    periods = spark.sql("SELECT * FROM VALUES ('development', date'1992-01-01', date'1994-12-31'), ('validation', date'1995-01-01', date'1996-12-31'), ('holdout', date'1997-01-01', date'1998-12-31') AS v(period, a, z)")
    return datasets.rows_by_period(b.observations(spark, sf), periods)


@query("f14_raw_lineage", b.OBS, sql_text=f"SELECT revision FROM (SELECT *, {DIGEST} FROM obs) WHERE digest NOT IN (SELECT {DIGEST} FROM obs WHERE basis = 'observed')")
def f14(spark, sf):
    rows = _digests(spark, sf)
    return datasets.without_lineage(rows, rows.where("basis = 'observed'")).select("revision")


@query("a11_knowledge_time", b.OBS, sql_text="SELECT source, max(greatest(available_at, ingested_at)) AS data_available_at, max(ingested_at) AS collected_at FROM obs GROUP BY source")
def a11(spark, sf):
    return datasets.knowledge_time(b.observations(spark, sf), "source")


@query("x01_key_sets", b.OBS, sql_text="SELECT count(*) AS n_union, count(CASE WHEN a AND b THEN 1 END) AS n_common, count(CASE WHEN a AND NOT b THEN 1 END) AS only_first, count(CASE WHEN b AND NOT a THEN 1 END) AS only_second FROM (SELECT entity, bool_or(basis = 'observed') AS a, bool_or(source = 'N') AS b FROM obs WHERE basis = 'observed' OR source = 'N' GROUP BY entity)")
def x01(spark, sf):
    rows = b.observations(spark, sf)
    return datasets.compare_keys(rows.where("basis = 'observed'"), rows.where("source = 'N'"), "entity")


@query("x02_ordering", b.TX, sql_text="SELECT id, symbol, side, executed_at FROM tx")
def x02(spark, sf):
    return datasets.execution_order(b.transactions(spark, sf)).select("id", "symbol", "side", "executed_at")
