"""Datasets of observations: digests, sinks and verified reads, merges, periods, lineage, key sets."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.folders import written


def bucket_digests(rows: DataFrame, levels: int = 2) -> DataFrame:
    """bucket (leading hex digits of ``digest``), n, bucket_digest: digests of sorted digests, independent of order.

    ``levels`` two-digit steps fan the rows out into 256 ** levels buckets, so no task gathers them all; coarser
    digests follow from these with ``fold_digests``.
    """
    out = rows.groupBy(F.substring("digest", 1, 2 * levels).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list("digest")), ""), 256).alias("bucket_digest"))
    return out


def fold_digests(buckets: DataFrame) -> DataFrame:
    """One level up: at most 256 buckets make one."""
    up = buckets.select(F.expr("substr(bucket, 1, length(bucket) - 2)").alias("up"), "bucket", "bucket_digest", "n")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("bucket", "bucket_digest"))), lambda s: s["bucket_digest"]), "")
    return up.groupBy(F.col("up").alias("bucket")).agg(F.sum("n").alias("n"), F.sha2(joined, 256).alias("bucket_digest"))


def dataset_digest(rows: DataFrame, levels: int = 2) -> DataFrame:
    """One row: n and the digest of the whole dataset."""
    return reduce(lambda d, _: fold_digests(d), range(levels), bucket_digests(rows, levels)).select("n", F.col("bucket_digest").alias("dataset_digest"))


LANES = 4


def content_sums(columns: list[str]) -> list:
    """n and ``LANES`` sums of the rows' digests, as aggregates: equal for the same rows in any order and partitions.

    A lane sums 60 bits of each row's SHA-256 exactly, so rows that repeat count, and lost or changed rows show.
    """
    row = F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)
    lane = lambda i: F.sum(F.conv(F.substring(row, 15 * i + 1, 15), 16, 10).cast("decimal(28,0)"))
    return [F.count(F.lit(1)).alias("n"), *[F.coalesce(lane(i), F.lit(0)).alias(f"lane{i}") for i in range(LANES)]]


def content_digest(found: dict) -> str:
    """The digest of what ``content_sums`` found."""
    return hashlib.sha256("|".join(str(int(found[c])) for c in ("n", *[f"lane{i}" for i in range(LANES)])).encode()).hexdigest()


def write_observed(rows: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> tuple[int, str]:
    """Write ``rows`` to the new ``path``; their number and digest, which the write itself has gathered."""
    seen = Observation()
    rows.observe(seen, *content_sums(rows.columns)).write.mode("errorifexists").partitionBy(*partition_by).parquet(path)
    return seen.get["n"], content_digest(seen.get)


def save_observations(rows: DataFrame, path: str, partition_by: tuple[str, ...] = ("dataset", "session")) -> str:
    """Create-only write, whose digest is returned; an existing path is an error."""
    return write_observed(rows, path, tuple(c for c in partition_by if c in rows.columns))[1]


def load_observations(spark: SparkSession, path: str, schema=None, expected_digest: str | None = None) -> DataFrame:
    """The rows below ``path``. With ``expected_digest`` a verified read: the one scan that copies the rows into the
    shared folder gathers their digest too, and an error tells that it differs; what is returned is the copy."""
    rows = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    if expected_digest is None:
        return rows
    seen = Observation()
    copy = written(rows.observe(seen, *content_sums(rows.columns)), "verified")
    if content_digest(seen.get) != expected_digest:
        raise ValueError(f"dataset digest differs: {path}")
    return copy


def merge_bundles(bundles: list[DataFrame]) -> DataFrame:
    """Union of bundles, one row a digest, of the first bundle that has it; ``copies`` counts the bundles that do."""
    marked = [x.dropDuplicates(["digest"]).withColumn("bundle", F.lit(i)) for i, x in enumerate(bundles, 1)]
    rest = [c for c in bundles[0].columns if c != "digest"]
    out = reduce(DataFrame.unionByName, marked).groupBy("digest").agg(F.min_by(F.struct(*rest), "bundle").alias("row"), F.min("bundle").alias("bundle"), F.count(F.lit(1)).alias("copies"))
    return out.select("digest", "row.*", "bundle", "copies")


def exact_duplicates(rows: DataFrame, identity: list[str], by: list[str]) -> DataFrame:
    """How many rows repeat another one's ``identity``, by ``by``."""
    return rows.groupBy(*identity).agg((F.count(F.lit(1)) - 1).alias("extra")).groupBy(*by).agg(F.sum("extra").alias("duplicates"))


def in_period(rows: DataFrame, start: str, end: str) -> DataFrame:
    """Rows whose event, availability and ingestion all fall in the period."""
    return reduce(lambda d, c: d.where(F.col(c).between(F.lit(start).cast("date"), F.lit(end).cast("date"))), ("event_at", "available_at", "ingested_at"), rows)


def rows_by_period(rows: DataFrame, periods: DataFrame) -> DataFrame:
    """Rows in each period and those ingested only after its end; ``periods`` (period, a, z) has a row a period."""
    own = rows.join(F.broadcast(periods), F.col("event_at").between(F.col("a"), F.col("z")), "inner").groupBy("period").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ingested_at") > F.col("z")).alias("c"))
    return periods.join(own, "period", "left").select("period", F.coalesce("n", F.lit(0)).alias("n_rows"), F.coalesce("c", F.lit(0)).alias("crossing"))


def without_lineage(rows: DataFrame, raw: DataFrame) -> DataFrame:
    """Processed rows without an identical raw row."""
    return rows.join(raw.select("digest").distinct(), "digest", "left_anti")


def knowledge_time(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.max(F.greatest("available_at", "ingested_at")).alias("data_available_at"), F.max("ingested_at").alias("collected_at"))


def compare_keys(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Sizes of the union, intersection and both differences of two key sets."""
    marked = first.select(key, F.lit(True).alias("a"), F.lit(False).alias("b")).union(second.select(key, F.lit(False), F.lit(True)))
    keys = marked.groupBy(key).agg(F.bool_or("a").alias("a"), F.bool_or("b").alias("b"))
    return keys.agg(F.count(F.lit(1)).alias("n_union"), F.count_if(F.expr("a AND b")).alias("n_common"), F.count_if(F.expr("a AND NOT b")).alias("only_first"), F.count_if(F.expr("b AND NOT a")).alias("only_second"))


def execution_order(orders: DataFrame) -> DataFrame:
    """Sells before buys, then by symbol and id, within a session; a presentation order only."""
    return orders.orderBy("executed_at", F.when(F.col("side") == "sell", 0).otherwise(1), "symbol", "id")
