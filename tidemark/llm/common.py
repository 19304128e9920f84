"""What several training-data operators share."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.folders import new_folder as new_path

#: A word is a run of anything but the six ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once a session, as ``--py-files`` would."""
    context = spark.sparkContext
    if getattr(context, "_tidemark_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="tidemark-"), "tidemark.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(archive)
    context._tidemark_shipped = True


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: cuts the lineage and outlives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that one operator writes on its way; ``clear`` empties them once its result is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def stash(self, df: DataFrame, name: str) -> DataFrame:
        path = new_path(self.spark, name)
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        for path in self.paths:
            self.spark.range(0).write.mode("overwrite").parquet(path)
        self.paths = []


class Folder(Scratch):
    """Tables of one folder, which is emptied at once."""

    def __init__(self, spark: SparkSession, name: str):
        super().__init__(spark)
        self.root = new_path(spark, name)

    def stash(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{len(self.paths)}-{name}"
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        self.spark.range(0).write.mode("overwrite").parquet(self.root)
        self.paths = []


def packed(docs: DataFrame, *columns: Column) -> DataFrame:
    """Each row of ``docs`` as one struct ``row`` beside ``columns``: no name of an operator can meet one of the table's."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *columns)


def text_key(text: str = "text") -> list[Column]:
    """one, two: 128 bits that tell texts apart; null is as empty."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(whole).alias("one"), F.xxhash64(F.lit(1), whole).alias("two")]


def n_words(text: Column) -> Column:
    """Words in ``text``; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_key() -> Column:
    """Digest of (doc_id, text); rows that agree in both share it. Nulls and empty strings differ."""
    return F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce(F.col("text"), F.lit("\x00"))))


def hex_int(digest: Column, first: int, digits: int) -> Column:
    """Hex digits ``first .. first + digits - 1`` (from 1) of a digest, as a long."""
    return F.conv(F.substring(digest, first, digits), 16, 10).cast("long")


def running_start(rows: DataFrame, group: str, order: list[str], key: str, size: str, name: str, buckets: Column) -> DataFrame:
    """``name`` = sum of ``size`` over the rows of ``group`` before this one, in the order of (``key``, ``order``).

    ``group`` is never null and ``key`` is a uniform 40-bit integer. Each group is cut into ``buckets`` equal key ranges
    (about the square root of its rows), so one task holds neither a whole group nor all range sums of more than that
    many ranges. The rows are dealt once: the range sums come to where the rows already lie.
    """
    from pyspark.sql import Window as W

    ranged = rows.withColumn("_range", F.floor(F.col(key) * buckets / F.lit(float(1 << 40))).cast("long"))
    sums = ranged.groupBy(group, "_range").agg(F.sum(size).alias("_sum"))
    before = W.partitionBy(group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(group, "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = W.partitionBy(group, "_range").orderBy(key, *order).rowsBetween(W.unboundedPreceding, -1)
    placed = ranged.withColumn(name, F.coalesce(F.sum(size).over(inside), F.lit(0))).join(sums, [group, "_range"])
    return placed.withColumn(name, (F.col(name) + F.col("_base")).cast("long")).drop("_range", "_base")
