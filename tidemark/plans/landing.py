"""Landed pages, documents, datasets and runs: the given tables written out in these forms and read back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.functions.scalars import sha256_hex
from tidemark.plans.pit import DIGEST
from tidemark.plans.registry import registry
from tidemark.sources import bindings as b
from tidemark.sources import datasets, landed
from tidemark.sources.folders import new_folder, written

QUERIES, SQL, query = registry()

LANDED_AT = "2024-03-01T08:00:00Z"


def _pages(spark, sf):
    """The users' daily bars as response pages: one for each user and week, an array of them in each file."""
    bars = b.ubars(spark, sf)
    row = F.struct(
        F.col("session").cast("string").alias("Date"), F.col("entity").alias("Code"), F.col("open").alias("O"), F.col("high").alias("H"), F.col("low").alias("L"), F.col("close").alias("C"),
        F.col("volume").alias("Vo"), F.lit(1.0).alias("AdjFactor"), *[F.col(c).alias(f"Adj{x}") for x, c in (("O", "open"), ("H", "high"), ("L", "low"), ("C", "close"), ("Vo", "volume"))],
    )
    week = F.date_trunc("week", "session").cast("date").cast("string")
    pages = bars.select("entity", week.alias("week"), row.alias("row")).groupBy("entity", "week").agg(F.sort_array(F.collect_list("row")).alias("data"))
    pages = pages.select(
        F.concat(F.lit("/daily/"), "entity").alias("path"), F.create_map(F.lit("week"), "week").alias("params"), F.lit(LANDED_AT).alias("ingested_at"),
        F.struct("data", F.lit(None).cast("string").alias("pagination_key")).alias("response"),
    )
    path = new_folder(spark, "pages")
    landed.write_pages(pages, path, F.floor(F.substring_index("path", "/", -1).cast("long") / 50))
    return landed.read_pages(spark, path)


PAGES = "pg AS (SELECT entity, CAST(date_trunc('week', session) AS DATE) AS week, count(*) AS n FROM ubars GROUP BY 1, 2)"


@query("s01_read_pages", b.UBARS, PAGES, sql_text=f"SELECT '/daily/' || entity AS path, CAST(week AS VARCHAR) AS week, '{LANDED_AT}' AS ingested_at, n AS n_rows, true AS parsed FROM pg")
def s01(spark, sf):
    pages = _pages(spark, sf)
    return pages.select("path", F.col("params")["week"].alias("week"), "ingested_at", F.size("response.data").cast("long").alias("n_rows"), F.col("_corrupt_record").isNull().alias("parsed"))


@query("s02_page_rows", b.UBARS, sql_text='SELECT \'/daily/\' || entity AS path, CAST(session AS VARCHAR) AS "Date", entity AS "Code", open AS "O", high AS "H", low AS "L", close AS "C", volume AS "Vo" FROM ubars')
def s02(spark, sf):
    return landed.page_rows(_pages(spark, sf)).select("path", "Date", "Code", "O", "H", "L", "C", "Vo")


BODIES = "bd AS (SELECT CAST(entity AS BIGINT) // 10 AS bucket, CAST(date_trunc('week', session) AS DATE) AS week, count(*) AS n FROM ubars GROUP BY 1, 2)"


@query("s02_body_integrity", b.UBARS, BODIES, sql_text="SELECT bucket, week, CASE WHEN bucket % 5 = 3 THEN 'corrupt' WHEN bucket % 5 = 4 THEN 'missing' ELSE 'intact' END AS status, CASE WHEN bucket % 5 < 3 THEN n END AS n_rows FROM bd UNION ALL SELECT NULL, NULL, 'unreceipted', NULL")
def s02_integrity(spark, sf):
    """Bodies of daily rows, one for ten users and a week, stored in packs under their digests and received with receipts.

    Some bodies change afterwards, some are lost, and one has no receipt; rows are read of the intact ones.
    """
    bars = b.ubars(spark, sf)
    bucket = F.floor(F.col("entity").cast("long") / 10).alias("bucket")
    row = F.struct(F.col("session").cast("string").alias("Date"), F.col("entity").alias("Code"), F.col("close").alias("C"))
    whole = bars.select(bucket, F.date_trunc("week", "session").cast("date").alias("week"), row.alias("row")).groupBy("bucket", "week").agg(F.sort_array(F.collect_list("row")).alias("data"))
    body = F.concat(F.to_json(F.struct(F.col("week").cast("string").alias("week"), F.col("bucket"), "data")), F.lit("\n"))
    landed_bodies = written(whole.select("bucket", "week", body.alias("body"), F.sha2(body, 256).alias("body_sha256")), "receipts")
    path, fifth = new_folder(spark, "bodies"), F.col("bucket") % 5
    landed.store_packs(landed_bodies.where(fifth < 3).select("body"), path)
    landed.store_packs(landed_bodies.where(fifth < 3).select("body"), path)  # changes nothing
    extra = landed_bodies.limit(1).select(F.lit("of no receipt\n").alias("body"))
    landed.store_packs(extra, path)
    changed = landed_bodies.where(fifth == 3).select("body_sha256", F.encode(F.concat(F.lit(" "), "body"), "UTF-8").alias("content"))
    changed.write.mode("append").parquet(path)
    receipts = landed_bodies.select("bucket", "week", "body_sha256")
    n_rows = F.size(F.from_json("body", "data array<struct<Date: string>>")["data"]).cast("long")
    return landed.pack_integrity(spark, path, receipts, n_rows=n_rows).select("bucket", "week", "status", "n_rows")


@query("s04_normalise_daily", b.UBARS, sql_text="""SELECT 'daily_bars' AS dataset, 'vendor:' || entity AS entity_id, strftime(CAST(session AS TIMESTAMP) - INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') AS event_at, '2024-03-01 08:00:00' AS available_at, 'observed' AS basis, session, entity AS code, open, high, low, close, volume, 1.0::DOUBLE AS factor, true AS revised FROM ubars""")
def s04(spark, sf):
    """Observations of the landed pages; a revision id is a digest."""
    rows = landed.normalise_daily(landed.page_rows(_pages(spark, sf)), "vendor")
    at = lambda c: F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM-dd HH:mm:ss").alias(c)
    return rows.select("dataset", "entity_id", at("event_at"), at("available_at"), "basis", "session", "code", "open", "high", "low", "close", "volume", "factor", F.col("revision_id").rlike("^[0-9a-f]{64}$").alias("revised"))


def _digested(spark, sf):
    rows = b.observations(spark, sf)
    digest = sha256_hex(*[F.col(c) for c in ("entity", "event_at", "available_at", "ingested_at")], F.round(F.col("value") * 100).cast("long"), F.col("revision"))
    return rows.select("entity", "revision", F.col("source").alias("dataset"), digest.alias("digest"))


@query("s07_saved_dataset", b.OBS, sql_text=f"SELECT entity, revision, source AS dataset, {DIGEST} FROM obs")
def s07(spark, sf):
    """Written once, by dataset, and read back under the digest that it was written with."""
    rows = _digested(spark, sf)
    path = new_folder(spark, "dataset")
    expected = datasets.save_observations(rows, path)
    schema = StructType([f for f in rows.schema if f.name != "dataset"] + [rows.schema["dataset"]])
    return datasets.load_observations(spark, path, schema, expected).select("entity", "revision", "dataset", "digest")


@query("s06_whole_digest", b.OBS, sql_text=f"""SELECT CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(d, '' ORDER BY bucket)) AS dataset_digest FROM (
  SELECT substr(bucket, 1, 2) AS bucket, sum(n) AS n, sha256(string_agg(d, '' ORDER BY bucket)) AS d FROM (
    SELECT substr(digest, 1, 4) AS bucket, count(*) AS n, sha256(string_agg(digest, '' ORDER BY digest)) AS d FROM (SELECT {DIGEST} FROM obs) GROUP BY 1) GROUP BY 1)""")  # fmt: skip
def s06(spark, sf):
    """One row: the digest of the whole dataset, by two levels of buckets."""
    return datasets.dataset_digest(_digested(spark, sf), levels=2)


def _documents(spark, rows, name, schema, key, bucket):
    path = new_folder(spark, name)
    landed.write_documents(rows, path, name, bucket)
    return landed.read_document(spark, path, schema, key)


@query("s11_snapshot_documents", b.TX, b.TXD, b.SNAP, sql_text="SELECT 'S' || symbol AS symbol, CAST(price_units AS VARCHAR) AS price, 'JPY' AS currency, as_of, symbol % 3 = 0 AS dated, true AS paired, false AS duplicate FROM snap")
def s11(spark, sf):
    s = b.snapshots(spark, sf)
    dated = F.col("symbol") % 3 == 0
    rows = s.select(
        F.concat(F.lit("S"), "symbol").alias("symbol"), "price", F.lit("JPY").alias("currency"), F.col("as_of").cast("timestamp").alias("as_of"), F.lit("feed").alias("source"),
        F.when(dated, "XTKS").alias("market"), F.when(dated, F.col("as_of")).alias("data_date"), F.when(dated, F.col("as_of").cast("timestamp")).alias("ingested_at"),
    )
    read = _documents(spark, rows, "snapshots", landed.SNAPSHOTS, ["symbol", "currency"], F.floor(F.substring("symbol", 2, 20).cast("long") / 500))
    units = (F.col("price") * F.lit(10**12).cast("decimal(13,0)")).cast("decimal(38,0)").cast("string")
    return read.select("symbol", units.alias("price"), "currency", F.to_date("as_of").alias("as_of"), F.col("data_date").isNotNull().alias("dated"), landed.paired_optionals(read).alias("paired"), "duplicate")


@query("s12_event_documents", b.CEV, sql_text="SELECT 'S' || symbol AS symbol, event_type, CAST(event_date AS VARCHAR) AS event_date, status, count(*) OVER (PARTITION BY symbol, event_type, event_date) > 1 AS duplicate FROM cev")
def s12(spark, sf):
    rows = b.corporate_events(spark, sf).select(
        F.concat(F.lit("S"), "symbol").alias("symbol"), "event_type", F.col("event_date").cast("string").alias("event_date"), F.col("announced_at").cast("timestamp").alias("announced_at"),
        F.lit("feed").alias("source"), "status",
    )
    read = _documents(spark, rows, "events", landed.EVENTS, ["symbol", "event_type", "event_date", "source"], F.floor(F.substring("symbol", 2, 20).cast("long") / 200))
    return read.select("symbol", "event_type", "event_date", "status", "duplicate")


ARTICLES = "ar AS (SELECT CAST(page_id % 100 AS VARCHAR) AS id, 'S' || (page_id % 50) AS symbol, 's' || (page_id % 7) AS source, url FROM pages)"


@query("s13_article_documents", ARTICLES, sql_text="SELECT *, count(*) OVER (PARTITION BY symbol, source, id) > 1 AS duplicate FROM (SELECT * FROM ar UNION ALL SELECT * FROM ar WHERE CAST(id AS BIGINT) % 9 = 0)")
def s13(spark, sf):
    """An id is unique only inside its symbol and source; every ninth article comes twice."""
    pages = b.table(spark, sf, "pages")
    number = F.col("page_id")
    rows = pages.select((number % 100).cast("string").alias("id"), F.concat(F.lit("S"), number % 50).alias("symbol"), F.lit("title").alias("title"), F.concat(F.lit("s"), number % 7).alias("source"), "url", F.lit("en").alias("language"))
    rows = rows.union(rows.where(F.col("id").cast("long") % 9 == 0))
    path = new_folder(spark, "articles")
    landed.write_documents(rows, path, "articles", F.pmod(F.xxhash64("url"), F.lit(max(1, rows.count() // 2000))))
    read = landed.read_document(spark, path, landed.ARTICLES, ["symbol", "source", "id"])
    return read.select("id", "symbol", "source", "url", "duplicate")


RUN_TABLES = {
    "orders": "order_id long, amount double, run_id string",
    "metrics": "orders long, total double, run_id string",
}


def _runs(spark, sf):
    """Where the orders' priorities were committed as runs: all but one in a first commit, that one in a second."""
    path = new_folder(spark, "runs")
    orders = b.table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_totalprice").alias("amount"), F.col("o_orderpriority").alias("run_id"))
    for commit, own in (("first", F.col("run_id") < "5"), ("second", F.col("run_id") >= "5")):
        mine = orders.where(own)
        figures = mine.groupBy("run_id").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("amount"), 2).alias("total"))
        landed.save_run({"orders": mine, "metrics": figures.select("orders", "total", "run_id")}, path, commit)
    return path


@query("s15_run_tables", sql_text="SELECT o_orderpriority AS run_id, o_orderkey AS order_id, o_totalprice AS amount FROM orders")
def s15(spark, sf):
    """The runs' orders as their manifests have them."""
    return landed.read_run(spark, _runs(spark, sf), "orders", RUN_TABLES["orders"]).select("run_id", "order_id", "amount")


@query("s15_run_inventory", sql_text="SELECT c.name AS commit, t.name, CASE WHEN t.name = 'orders' THEN n ELSE k END AS n_rows, true AS rows_right, true AS digest_right FROM (SELECT CASE WHEN o_orderpriority < '5' THEN 'first' ELSE 'second' END AS name, count(*) AS n, count(DISTINCT o_orderpriority) AS k FROM orders GROUP BY 1) c CROSS JOIN (VALUES ('orders'), ('metrics')) t(name)")
def s15_inventory(spark, sf):
    """What the manifests say of each table, and whether the data still agree."""
    found = landed.run_inventory(spark, _runs(spark, sf), RUN_TABLES)
    return found.select("commit", "name", "n_rows", (F.col("n_rows") == F.col("found_rows")).alias("rows_right"), (F.col("digest") == F.col("found_digest")).alias("digest_right"))
