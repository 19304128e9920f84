"""Landed pages and strict documents: scans, integrity, pagination, contracts, run results."""

from __future__ import annotations

import hashlib
import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.sources.datasets import content_digest, content_sums, write_observed

DAILY_ROW = "Date string, Code string, O double, H double, L double, C double, Vo double, AdjFactor double, AdjO double, AdjH double, AdjL double, AdjC double, AdjVo double"
PAGE = f"path string, params map<string,string>, ingested_at string, response struct<data: array<struct<{DAILY_ROW.replace(' double', ': double').replace(' string', ': string')}>>, pagination_key: string>"
MOST_PAGES = 1000


def read_pages(spark: SparkSession, path: str, schema: str = PAGE) -> DataFrame:
    """Landed response pages, a row each; bodies that don't parse are kept in ``_corrupt_record``."""
    return spark.read.schema(f"{schema}, _corrupt_record string").json(path, multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")


def page_rows(pages: DataFrame) -> DataFrame:
    """A row for each row of each page, with the page's request and ingestion."""
    return pages.select("path", "params", "ingested_at", F.explode("response.data").alias("row")).select("path", "params", "ingested_at", "row.*")


def store_bodies(bodies: DataFrame, path: str) -> None:
    """Bodies (``body``, text that ends in a line feed) below ``path``, each in a folder named by its SHA-256.

    Create-only: a digest that is there already is not written again, whatever its file holds.
    """
    named = bodies.where("body IS NOT NULL").select(F.sha2("body", 256).alias("body_sha256"), F.expr("left(body, length(body) - 1)").alias("value"))
    named = named.dropDuplicates(["body_sha256"])
    try:
        there = bodies.sparkSession.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(_named().alias("body_sha256"))
        named = named.join(there.distinct(), "body_sha256", "left_anti")  # reads names alone
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    named.repartition("body_sha256").write.mode("append").partitionBy("body_sha256").text(path)


def _named() -> Column:
    """The last SHA-256 in a file's path, which names its body."""
    return F.regexp_extract("path", r"([0-9a-f]{64})(?!.*[0-9a-f]{64})", 1)


def body_integrity(spark: SparkSession, path: str) -> DataFrame:
    """file, expected, found, intact: SHA-256 of every landed body against the one that its path names."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "[!_]*").load(path)
    found = F.sha2("content", 256)
    return files.select(F.col("path").alias("file"), _named().alias("expected"), found.alias("found"), (found == _named()).alias("intact"))


def receipt_integrity(spark: SparkSession, path: str, receipts: DataFrame) -> DataFrame:
    """``receipts`` (body_sha256, ...) with status: intact, corrupt or missing; bodies of no receipt as unreceipted.

    Bodies meet receipts by digest. A digest of several files is intact only if all are.
    """
    bodies = body_integrity(spark, path).groupBy(F.col("expected").alias("body_sha256")).agg(F.bool_and("intact").alias("_intact"))
    return _with_status(receipts, bodies)


def _with_status(receipts: DataFrame, bodies: DataFrame) -> DataFrame:
    both = receipts.withColumn("_receipt", F.lit(True)).join(bodies, "body_sha256", "full_outer")
    status = F.when(F.col("_receipt").isNull(), "unreceipted").when(F.col("_intact").isNull(), "missing").when(F.col("_intact"), "intact").otherwise("corrupt")
    return both.withColumn("status", status).drop("_receipt", "_intact")


def verified_bodies(spark: SparkSession, path: str, receipts: DataFrame) -> DataFrame:
    """``receipts`` with ``body`` as text; a receipt whose body is missing or doesn't hash to it fails the query."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "[!_]*").load(path)
    files = files.select(_named().alias("body_sha256"), "content").dropDuplicates(["body_sha256", "content"])
    both = receipts.join(files, "body_sha256", "left")
    right = F.coalesce(F.sha2("content", 256) == F.col("body_sha256"), F.lit(False))
    wrong = F.raise_error(F.concat(F.lit("body missing or corrupt: "), "body_sha256"))
    return both.withColumn("body", F.when(right, F.decode("content", "UTF-8")).otherwise(wrong)).drop("content")


PACK = "body_sha256 string, content binary"


def read_packs(spark: SparkSession, path: str) -> DataFrame:
    """body_sha256, content: what packs below ``path`` hold under each digest, no rows where nothing was stored yet."""
    try:
        return spark.read.schema(PACK).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.range(0).select(F.lit("").alias("body_sha256"), F.lit(b"").alias("content"))


def store_packs(bodies: DataFrame, path: str) -> None:
    """Bodies (``body``, text) below ``path`` as rows under their SHA-256, many to a file.

    Files go with the bytes stored, where ``store_bodies`` has a folder and a file for each body. Create-only: a digest
    that is there already is not written again, whatever is stored under it.
    """
    named = bodies.where("body IS NOT NULL").select(F.sha2("body", 256).alias("body_sha256"), F.encode("body", "UTF-8").alias("content"))
    there = read_packs(bodies.sparkSession, path).select("body_sha256").distinct()  # reads digests alone
    named.dropDuplicates(["body_sha256"]).join(there, "body_sha256", "left_anti").write.mode("append").parquet(path)


def pack_integrity(spark: SparkSession, path: str, receipts: DataFrame, **figures: Column) -> DataFrame:
    """``receipts`` (body_sha256, ...) with status as in ``receipt_integrity``, and ``figures`` (of ``body``, the text) of intact bodies.

    One scan hashes every stored body and reads it where it lies; digests and figures alone meet the receipts.
    """
    intact = F.coalesce(F.sha2("content", 256) == F.col("body_sha256"), F.lit(False))
    text = read_packs(spark, path).select("body_sha256", intact.alias("_intact"), F.when(intact, F.decode("content", "UTF-8")).alias("body"))
    text = text.select("body_sha256", "_intact", *[F.when(F.col("_intact"), c).alias(name) for name, c in figures.items()])
    bodies = text.groupBy("body_sha256").agg(F.bool_and("_intact").alias("_intact"), *[F.any_value(name, F.lit(True)).alias(name) for name in figures])
    found = _with_status(receipts, bodies)
    return found.withColumns({name: F.when(F.col("status") == "intact", F.col(name)) for name in figures})


def pagination_issues(pages: DataFrame) -> DataFrame:
    """path, base, code for request series whose pages don't chain.

    ``pages`` has path, params and response.pagination_key. A series is a path with its parameters but the cursor: it
    starts at the one page without a cursor, each cursor was the response of exactly one page, none repeats, one page
    ends it, and it has at most MOST_PAGES pages.
    """
    base = F.to_json(F.map_filter("params", lambda k, _: k != "pagination_key"))
    p = pages.select("path", base.alias("base"), F.col("params")["pagination_key"].alias("asked"), F.col("response.pagination_key").alias("next"))
    asked, given = p.where("asked IS NOT NULL"), p.where("next IS NOT NULL")
    key = ["path", "base"]
    dangling = asked.join(given.select(*key, F.col("next").alias("asked")), [*key, "asked"], "left_anti").select(*key, F.lit("dangling_cursor").alias("code"))
    unfetched = given.select(*key, F.col("next").alias("asked")).join(asked, [*key, "asked"], "left_anti").select(*key, F.lit("missing_page").alias("code"))
    repeated = asked.groupBy(*key, "asked").count().where("count > 1").select(*key, F.lit("repeated_cursor").alias("code"))
    ends = p.groupBy(*key).agg(F.count_if(F.col("asked").isNull()).alias("first"), F.count_if(F.col("next").isNull()).alias("last"), F.count(F.lit(1)).alias("n"))
    ends = ends.select(*key, F.explode(F.array_compact(F.array(F.when(F.col("first") != 1, "first_page"), F.when(F.col("last") != 1, "last_page"), F.when(F.col("n") > MOST_PAGES, "too_many_pages")))).alias("code"))
    return dangling.union(unfetched).union(repeated).union(ends).distinct()


def normalise_daily(rows: DataFrame, source: str) -> DataFrame:
    """Observations of daily rows: midnight in the exchange's zone, available when ingested, revision by content."""
    columns = sorted(c for c in rows.columns if c not in ("path", "params", "ingested_at"))
    content = F.concat_ws("|", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("null"))) for c in columns])
    at = F.to_timestamp("ingested_at")
    return rows.select(
        F.lit("daily_bars").alias("dataset"), F.concat(F.lit(f"{source}:"), "Code").alias("entity_id"), F.to_timestamp(F.concat("Date", F.lit("T00:00:00+09:00"))).alias("event_at"), F.lit(None).cast("timestamp").alias("published_at"),
        at.alias("available_at"), at.alias("ingested_at"), F.sha2(content, 256).alias("revision_id"), F.lit(source).alias("source"), F.lit("observed").alias("basis"),
        F.to_date("Date").alias("session"), F.col("Code").alias("code"), F.col("O").alias("open"), F.col("H").alias("high"), F.col("L").alias("low"), F.col("C").alias("close"), F.col("Vo").alias("volume"), F.col("AdjFactor").alias("factor"),
    )


def master_issues(rows: DataFrame) -> DataFrame:
    """Rows of dated masters (requested, Date, Code, ProdCat) that are misdated, lack a code or repeat one; and whether each is an ordinary share."""
    n = F.count(F.lit(1)).over(W.partitionBy("requested", "Code"))
    code = F.when(F.coalesce(F.col("Date") != F.col("requested"), F.lit(True)), "wrong_date").when(F.coalesce(F.col("Code") == "", F.lit(True)), "invalid_code").when(n > 1, "repeated_code")
    return rows.select("*", code.alias("code_issue"), (F.col("ProdCat") == "011").alias("ordinary"))


SNAPSHOTS = "schema_version int, snapshots array<struct<symbol: string, price: decimal(30,12), previous_close: decimal(30,12), currency: string, as_of: timestamp, source: string, market: string, data_date: date, ingested_at: timestamp>>"
EVENTS = "schema_version int, events array<struct<symbol: string, event_type: string, event_date: string, announced_at: timestamp, source: string, status: string, metadata: map<string,string>>>"
ARTICLES = "schema_version int, articles array<struct<id: string, symbol: string, title: string, published_at: timestamp, source: string, url: string, summary: string, language: string, metadata: map<string,string>>>"


def read_document(spark: SparkSession, path: str, schema: str, key: list[str]) -> DataFrame:
    """Rows of strict documents {schema_version: 1, <name>: [...]}, failing on bodies that don't parse; ``duplicate`` marks a repeated key."""
    docs = spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST")
    name = docs.columns[1]
    version = F.when(F.col("schema_version") == 1, F.col(name)).otherwise(F.raise_error(F.lit("unknown schema version")))
    rows = docs.select(F.explode(version).alias("row")).select("row.*")
    return rows.withColumn("duplicate", F.count(F.lit(1)).over(W.partitionBy(*key)) > 1)


def paired_optionals(snapshots: DataFrame) -> Column:
    """Whether market, data_date and ingested_at are all there or all absent."""
    there = F.col("market").isNotNull().cast("int") + F.col("data_date").isNotNull().cast("int") + F.col("ingested_at").isNotNull().cast("int")
    return there.isin(0, 3)


def agreement_issues(members: DataFrame, master: DataFrame, bars: DataFrame) -> DataFrame:
    """session, entity, code where membership, the dated master and bars with close and volume disagree."""
    key = ["session", "entity"]
    m, c = members.select(*key).distinct().withColumn("_m", F.lit(1)), master.select(*key).distinct().withColumn("_c", F.lit(1))
    sets = m.join(c, key, "full_outer").where("_m IS NULL OR _c IS NULL").select(*key, F.when(F.col("_c").isNull(), "member_not_in_master").otherwise("master_not_member").alias("code"))
    full = bars.where("close IS NOT NULL AND volume IS NOT NULL").select(*key)
    return sets.union(members.select(*key).distinct().join(full, key, "left_anti").select(*key, F.lit("member_without_bar")))


def listing_coverage(bars: DataFrame, master: DataFrame) -> DataFrame:
    """Per entity the sessions whose master lists it."""
    return bars.select("session", "entity").distinct().join(master.select("session", "entity").distinct(), ["session", "entity"], "left_semi").groupBy("entity").agg(F.count(F.lit(1)).alias("listed_sessions"))


def preflight(violations: list[tuple[str, DataFrame]]) -> DataFrame:
    """check, failures: every check with how many rows fail it, also those with none."""
    out = [v.agg(F.count(F.lit(1)).alias("failures")).select(F.lit(name).alias("check"), "failures") for name, v in violations]
    return out[0] if len(out) == 1 else out[0].unionByName(preflight(violations[1:]))


def parameter_errors(spark: SparkSession, lot: int, participation: float | None, position_cap: float, cash_reserve: float, fees: float, slippage: float) -> DataFrame:
    """code: a row for each parameter of a run that isn't set as a real comparison asks."""
    rules = [
        (lot == 100, "lot_size"), (participation is not None and 0 < participation <= 1, "volume_participation"), (0 < position_cap < 1, "position_cap"),
        (0 < cash_reserve < 1, "cash_reserve"), (fees > 0, "fees"), (slippage > 0, "slippage"),
    ]
    return spark.createDataFrame([(code,) for good, code in rules if not good], "code string")


def write_documents(rows: DataFrame, path: str, name: str, bucket: Column) -> None:
    """Strict documents {schema_version: 1, <name>: [rows]} below ``path``, one for each ``bucket``, which bounds them."""
    whole = rows.select(bucket.alias("bucket"), F.struct(*rows.columns).alias("row")).groupBy("bucket").agg(F.sort_array(F.collect_list("row")).alias(name))
    body = F.to_json(F.struct(F.lit(1).alias("schema_version"), F.col(name)))
    whole.select("bucket", body.alias("value")).write.partitionBy("bucket").text(path)


def write_pages(pages: DataFrame, path: str, bucket: Column) -> None:
    """Response pages below ``path``, an array of them in one file for each ``bucket``, which bounds it."""
    whole = pages.select(bucket.alias("bucket"), F.struct(*pages.columns).alias("page")).groupBy("bucket").agg(F.to_json(F.collect_list("page")).alias("value"))
    whole.write.partitionBy("bucket").text(path)


MANIFEST = "commit string, name string, location string, n_rows long, digest string"


def _manifests(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(MANIFEST).option("recursiveFileLookup", "true").parquet(f"{path}/manifests")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def save_run(tables: dict[str, DataFrame], path: str, commit: str) -> None:
    """Commit the tables of one run, or of a batch of them (each with run_id), together, below ``path``.

    Every table goes to a folder of its own under ``data``, by run_id; the write gathers its row count and digest. Last
    comes the manifest, one small file: readers go by manifests, so a job that dies before shows nothing, and can be
    repeated. A commit, or a run of a table, that is there already is an error.
    """
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([], MANIFEST).write.mode("ignore").parquet(f"{path}/manifests/none")  # a folder to look into
    if not _manifests(spark, path).where(F.col("commit") == commit).isEmpty():
        raise ValueError(f"run is there already: {commit}")
    rows = []
    for name, df in tables.items():
        old = read_run(spark, path, name, df.schema)
        if old is not None and not df.select("run_id").distinct().join(old.select("run_id").distinct(), "run_id", "left_semi").isEmpty():
            raise ValueError(f"a run of {name} is there already")
        location = f"{path}/data/{name}-{uuid.uuid4().hex}"
        n, digest = write_observed(df, location, ("run_id",))
        rows.append((commit, name, location, n, digest))
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("errorifexists").parquet(f"{path}/manifests/{hashlib.sha256(commit.encode()).hexdigest()}")


def read_run(spark: SparkSession, path: str, name: str, schema) -> DataFrame | None:
    """The rows of a table in all commits; None where there is no commit."""
    places = [r["location"] for r in _manifests(spark, path).where(F.col("name") == name).select("location").collect()]  # a row a commit
    if not places:
        return None
    parts = [spark.read.schema(schema).parquet(place) for place in places]
    return reduce(DataFrame.unionByName, parts)


def run_inventory(spark: SparkSession, path: str, schemas: dict) -> DataFrame:
    """commit, name, n_rows, digest as the manifests have them, and found_rows, found_digest as the data have them.

    One scan a table and commit; a table whose folder is gone, or holds other rows, shows.
    """
    rows = []
    for m in _manifests(spark, path).collect():  # a row a table and commit
        try:
            found = spark.read.schema(schemas[m["name"]]).parquet(m["location"])
            sums = found.agg(*content_sums(found.columns)).head().asDict()
            rows.append((m["commit"], m["name"], m["n_rows"], m["digest"], sums["n"], content_digest(sums)))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            rows.append((m["commit"], m["name"], m["n_rows"], m["digest"], None, None))
    return spark.createDataFrame(rows, "commit string, name string, n_rows long, digest string, found_rows long, found_digest string")


def inventory_issues(expected: DataFrame, present: DataFrame) -> DataFrame:
    """run_id, name, code: artifacts that are missing, not expected, or of another digest."""
    e, p = expected.select("run_id", "name", F.col("digest").alias("_e")), present.select("run_id", "name", F.col("digest").alias("_p"))
    code = F.when(F.col("_p").isNull(), "missing").when(F.col("_e").isNull(), "unexpected").when(F.col("_e") != F.col("_p"), "digest_differs")
    return e.join(p, ["run_id", "name"], "full_outer").select("run_id", "name", code.alias("code")).where("code IS NOT NULL")
