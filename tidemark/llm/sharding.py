"""K-d tree sharding: weighted medians along the widest metadata dimension, until leaves reach their bytes.

Main path: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import Folder, documents, hex_int, row_key, running_start, stash

#: Metadata dimensions in order of precedence; each gives a 32-bit coordinate.
DIMENSIONS = ("chars", "lang", "source")
#: A point's place along a dimension: its 32-bit coordinate, then 20 bits of its digest, so ties can be split anywhere.
TIE_BITS = 20
STEP_BITS = 18
#: Equal texts of more bytes than a shard's share over WHOLE are dealt into SALTS points; fewer are one point.
WHOLE = 16
SALTS = 256


def points_of(rows: DataFrame) -> DataFrame:
    """text_digest, salt, size, n, at: the points of ``rows``, each of the least metadata of its rows."""
    tie = hex_int(F.md5(F.concat_ws(":", "text_digest", F.col("salt").cast("string"))), 1, 5)
    sums = rows.groupBy("text_digest", "salt").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"), *[F.min(d).alias(d) for d in DIMENSIONS])
    return sums.select("text_digest", "salt", "size", "n", F.array(*[F.shiftleft(F.col(d), TIE_BITS) + tie for d in DIMENSIONS]).alias("at"))


def _placed(points: DataFrame, level: DataFrame) -> DataFrame:
    """``points`` with first and many, the shards that are still open for a point, after one more level of the tree.

    A node is known by its first shard. A level's splits (first, dim, cut) are a row a node; Spark broadcasts them
    while they are small and joins them by shuffle beyond.
    """
    joined = points.join(level, "first", "left")
    half, split = F.floor(F.col("many") / 2).cast("int"), F.col("dim").isNotNull()
    high = split & (F.element_at("at", F.col("dim") + 1) > F.col("cut"))
    many = F.when(~split, F.col("many")).when(high, F.col("many") - half).otherwise(half)
    return joined.withColumns({"first": F.when(high, F.col("first") + half).otherwise(F.col("first")), "many": many}).drop("dim", "cut")


def _splits(rows: DataFrame, whole: list[int], scratch: Folder) -> DataFrame:
    """first, dim, cut of each node of several shards: its widest dimension, and the least place there at which the bytes
    up to it reach the share of its lower shards.

    Exact: a histogram of the leading bits finds the bin that holds the median, the next one looks inside that bin. A
    node's bins are at most 2**STEP_BITS sums; nothing but the tree's depth comes to the driver.
    """
    wide = [(F.max(F.shiftright(F.col("at")[i], TIE_BITS)) - F.min(F.shiftright(F.col("at")[i], TIE_BITS))) / max(1, whole[i]) for i in range(len(DIMENSIONS))]
    widest = F.array_max(F.array(*[F.struct(w.alias("w"), F.lit(-i).alias("i")) for i, w in enumerate(wide)]))
    state = rows.groupBy("first", "many").agg(F.sum("size").alias("total"), (-widest["i"]).alias("dim"))
    state = state.select("*", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"))
    exact = lambda c: c.cast("decimal(38,0)")
    for left in range(STEP_BITS * ((32 + TIE_BITS - 1) // STEP_BITS), -1, -STEP_BITS):
        place = F.element_at("at", F.col("dim") + 1)
        inside = rows.join(state, ["first", "many"]).withColumn("place", place).where(F.shiftright("place", left + STEP_BITS) == F.col("prefix"))
        sums = inside.groupBy("first", "many", "total", "dim", "below", F.shiftright("place", left).alias("bin")).agg(F.sum("size").alias("b"))
        upto = F.col("below") + F.sum("b").over(W.partitionBy("first").orderBy("bin").rowsBetween(W.unboundedPreceding, 0))
        reached = sums.withColumn("upto", upto).where(exact(F.col("upto")) * F.col("many") >= exact(F.col("total")) * F.floor(F.col("many") / 2))
        found = reached.groupBy("first", "many", "total", "dim").agg(F.min(F.struct("bin", (F.col("upto") - F.col("b")).alias("below"))).alias("s"))
        state = found.select("first", "many", "total", "dim", F.col("s.bin").alias("prefix"), F.col("s.below").alias("below"))
    return scratch.stash(state.select("first", "dim", F.col("prefix").alias("cut")), "splits")


def kd_shards(docs: DataFrame, shards: int = 8, target_bytes: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (and the columns ``keep``).

    The law is ``bytes``: each split halves a node's bytes (in proportion to the leaves on either side where their
    number is odd). With ``target_bytes`` the number of shards follows from the table's bytes instead: leaves of about
    that many. Equal texts share a shard, whatever their ids, languages and sources (the least count as theirs), unless
    they hold more than a WHOLE-th of a shard's bytes: those are dealt into SALTS parts, so that shards stay even. Ties
    along a dimension are cut by digest, so equal values never force an uneven split. Slots number a shard's rows
    without gaps in digest order. Null texts have size 1 and the checksum of no bytes; null languages and sources are
    values; repeated rows are rows; a text of any length is one row of a shard; an empty table gives no rows. Columns in
    ``keep`` keep their values, whatever their names (a name of a result comes twice).
    """
    scratch, digest, whole = Folder(docs.sparkSession, "shards"), row_key(), F.coalesce("text", F.lit("\x00"))
    chars = F.least(F.coalesce(F.length("text"), F.lit(0)), F.lit((1 << 32) - 1)).cast("long").alias("chars")
    metadata = [hex_int(F.md5(F.coalesce(F.col(c), F.lit("\x00"))), 1, 8).alias(c) for c in ("lang", "source")]
    base = docs.select(
        F.struct("doc_id", *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)]).alias("row"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"), digest.alias("digest"), F.md5(whole).alias("text_digest"), chars, *metadata,
    )
    base = scratch.stash(base.withColumn("key", hex_int(F.col("digest"), 1, 10)), "shards")
    total = base.agg(F.coalesce(F.sum("size"), F.lit(0))).head()[0]
    if target_bytes:
        shards = max(1, -(-total // target_bytes))
    exact = F.sum("size").cast("decimal(38,0)") * (WHOLE * shards)
    large = base.groupBy("text_digest").agg(exact.alias("_s")).where(F.col("_s") > F.lit(total))  # fewer than WHOLE * shards
    large = scratch.stash(large.select("text_digest", F.lit(True).alias("_large")), "large")
    salt = F.when(F.col("_large"), hex_int(F.col("digest"), 1, 2)).otherwise(F.lit(0).cast("long"))
    rows = base.join(large, "text_digest", "left").withColumn("salt", salt).drop("_large")
    points = points_of(rows).withColumn("first", F.lit(0)).withColumn("many", F.lit(shards))
    points = scratch.stash(points, "points")
    spread = [F.max(F.shiftright(F.col("at")[i], TIE_BITS)) - F.min(F.shiftright(F.col("at")[i], TIE_BITS)) for i in range(len(DIMENSIONS))]
    wide = list(points.agg(*[F.coalesce(x, F.lit(0)) for x in spread]).head())
    for _ in range((shards - 1).bit_length()):  # the depth of the tree; each level reads the one before
        level = _splits(points.where("many > 1").select("first", "many", "size", "at"), wide, scratch)
        points = scratch.stash(_placed(points, level), "points")
    placed = rows.join(points.select("text_digest", "salt", F.col("first").alias("shard")), ["text_digest", "salt"])
    placed = placed.select("row", "size", "text_crc32", "digest", "key", "shard", F.lit(1).alias("one"))
    rows_of = points.groupBy(F.col("first").alias("shard")).agg(F.sum("n").alias("rows"))
    out = running_start(placed.join(rows_of, "shard"), "shard", ["digest"], "key", "one", "slot", F.ceil(F.sqrt(F.col("rows"))))
    out = stash(out.select("row", "size", "text_crc32", "shard", "slot"), "shards")
    scratch.clear()
    kept = [F.col(f"row.k{i}").alias(c) for i, c in enumerate(keep)]
    return out.select("row.doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), *kept)


def op9_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards(documents(spark, sf_dir))


def _sql() -> str:
    """The tree level by level, and CRC-32 from its table, for eight shards."""
    dims = DIMENSIONS

    def level(i: int) -> str:
        spread = ", ".join(f"(max({d} >> {TIE_BITS}) - min({d} >> {TIE_BITS}))::DOUBLE / greatest(1, (SELECT max({d} >> {TIE_BITS}) - min({d} >> {TIE_BITS}) FROM n0)) AS {d}" for d in dims)
        return f"""w{i} AS (SELECT node, sum(size) AS total, {spread} FROM n{i} GROUP BY node),
p{i} AS (SELECT n.*, w.total, CASE WHEN w.{dims[0]} >= w.{dims[1]} AND w.{dims[0]} >= w.{dims[2]} THEN n.{dims[0]} WHEN w.{dims[1]} >= w.{dims[2]} THEN n.{dims[1]} ELSE n.{dims[2]} END AS place FROM n{i} n JOIN w{i} w USING (node)),
c{i} AS (SELECT *, sum(size) OVER (PARTITION BY node ORDER BY place) AS upto FROM p{i}),
k{i} AS (SELECT node, min(place) AS cut FROM c{i} WHERE upto * 2 >= total GROUP BY node),
n{i + 1} AS (SELECT td, salt, size, {', '.join(dims)}, CASE WHEN place <= cut THEN 2 * node + 1 ELSE 2 * node + 2 END AS node FROM c{i} JOIN k{i} USING (node))"""

    step = "CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    eight = "i"
    for _ in range(8):
        eight = f"list_transform([{eight}], lambda c: {step})[1]"
    coordinate = {"chars": "length(coalesce(text, ''))", "lang": "('0x' || substr(md5(coalesce(lang, chr(0))), 1, 8))::BIGINT", "source": "('0x' || substr(md5(coalesce(source, chr(0))), 1, 8))::BIGINT"}
    own = ", ".join(f"{coordinate[d]}::BIGINT AS c_{d}" for d in dims)
    places = ", ".join(f"(min(c_{d}) << {TIE_BITS}) + any_value(('0x' || substr(md5(td || ':' || salt), 1, 5))::BIGINT) AS {d}" for d in dims)
    return f"""
WITH t AS (SELECT list({eight} ORDER BY i) AS t FROM range(256) r(i)),
b AS (SELECT *, hex(encode(coalesce(text, ''))) AS h, md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(text, chr(0))) AS digest, md5(coalesce(text, chr(0))) AS td, {own} FROM documents),
g AS (SELECT *, length(h) // 2 + 1 AS size, sum(length(h) // 2 + 1) OVER (PARTITION BY td) AS alike, sum(length(h) // 2 + 1) OVER () AS total FROM b),
r AS (SELECT doc_id, size, digest, td, c_chars, c_lang, c_source, CASE WHEN alike * {WHOLE * 8} > total THEN ('0x' || substr(digest, 1, 2))::BIGINT ELSE 0 END AS salt,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(h) // 2), lambda k: ('0x' || substr(h, 2 * k + 1, 2))::BIGINT)), lambda c, x: xor(c >> 8, t[xor(c, x) % 256 + 1])), 4294967295) AS crc FROM g, t),
n0 AS (SELECT td, salt, sum(size) AS size, 0 AS node, {places} FROM r GROUP BY td, salt),
{level(0)},
{level(1)},
{level(2)}
SELECT doc_id, CAST(r.size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'bytes' AS law, CAST(node - 7 AS INT) AS shard, CAST(row_number() OVER (PARTITION BY node ORDER BY digest) - 1 AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard FROM r JOIN n3 USING (td, salt)
"""


OP9_SQL = _sql()
