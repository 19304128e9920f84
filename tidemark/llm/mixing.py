"""Mixing sources to target weights: hash-random order, distributed prefix sums, an exact cut for each source.

Main path: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import documents, hex_int, n_words, packed, row_key, running_start, stash

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Words to take of each source; ``sources`` has one row (source, source_size, rows) a source.

    Sources in code point order, null last, weigh ``weights`` in turn and share ``share`` times all words. A target
    stops at ``max_epochs`` times its source's size and the excess is shared again by weight: target = min(cap,
    level * weight), where level is what is left by the sources that stop, over the weights of the others. Sources of
    no words get 0. ``turn`` numbers the sources. The windows run over one row a source, in one task: fine for thousands
    of sources, not for one a host or page.
    """
    turned = sources.withColumn("turn", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weighed = turned.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("turn") % len(weights) + 1).cast("int")))
    weighed = weighed.withColumn("cap", F.col("source_size") * max_epochs)
    order = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    everything = W.partitionBy()
    levelled = weighed.select(
        "*",
        F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("stopped"),
        F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)).alias("open_weight"),
        (F.sum("source_size").over(everything) * share).alias("wanted"),
    )
    levelled = levelled.withColumn("level", (F.col("wanted") - F.col("stopped")) / F.col("open_weight"))
    # Assuming too few or too many stopped sources gives a lower level, so the true one is the highest.
    levelled = levelled.withColumn("level", F.max("level").over(everything))
    return levelled.select("source", "turn", "source_size", "rows", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def _placed(docs: DataFrame, weights: tuple[int, ...], share: float, max_epochs: int, whole: bool) -> DataFrame:
    """doc_id, size, source_size, target, copies, and where ``whole`` the row of ``docs`` as a struct."""
    base = packed(docs, F.col("source").alias("source"), n_words(F.col("text")).alias("size"), row_key().alias("digest"))
    base = base if whole else base.withColumn("row", F.struct("row.doc_id"))
    base = stash(base.withColumn("key", hex_int(F.col("digest"), 1, 10)), "mix")
    per_source = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    plan = targets(per_source, weights, share, max_epochs).withColumnRenamed("source", "_source")
    rows = base.join(plan, base["source"].eqNullSafe(plan["_source"])).drop("source", "_source")
    placed = running_start(rows, "turn", ["digest"], "key", "size", "start", F.ceil(F.sqrt(F.col("rows"))))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    left = F.col("target") - passes * F.col("source_size")
    once_more = (F.col("start") * 2 + F.col("size") <= left * 2) & (passes < max_epochs)
    return placed.withColumn("copies", (passes + once_more.cast("long")).cast("long"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """doc_id, size, source_size, target, taken: a row for each row of ``docs`` (doc_id, text, source).

    Each source's rows stand in a random order given by a digest of (doc_id, text); whole passes over the source are
    taken while they fit its target, then the rows whose middle word lies before the remaining budget. So a source
    misses its target by at most half of one document, and no row is taken more than ``max_epochs`` times. Rows that
    agree in doc_id and text tie and get what their places give, the same at each run. Null texts have size 0 and take
    0 words; a null source is a source; long texts are taken whole; other columns aren't read; an empty table gives no
    rows.
    """
    placed = _placed(docs, weights, share, max_epochs, False)
    return placed.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as ``mix`` takes it, in the columns of ``docs``.

    Texts without words weigh nothing: they come with the passes and the place that they stand at, like others. Columns
    keep their values, whatever their names; an empty table stays empty.
    """
    placed = _placed(docs, weights, share, max_epochs, True).where("copies > 0")
    return placed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


OP2_SQL = r"""
WITH base AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(text, chr(0))) AS digest
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY source),
w AS (SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight, source_size * 2 AS cap FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
        - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
        / (sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM w),
t AS (SELECT source, source_size, least(cap::DOUBLE, weight * max(level) OVER ()) AS target FROM l),
p AS (SELECT b.doc_id, b.size, t.source_size, t.target,
        coalesce(sum(b.size) OVER (PARTITION BY b.source ORDER BY digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
        CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes
      FROM base b JOIN t ON b.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(size * (passes + CASE WHEN start * 2 + size <= (target - passes * source_size) * 2 AND passes < 2 THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM p
"""
