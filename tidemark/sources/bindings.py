"""The given tables in the roles of bars, observations, transactions, news and so on, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ohlc(rows: DataFrame, order: list[str]) -> DataFrame:
    place = F.struct(*order)
    return rows.groupBy("entity", "session").agg(
        F.min_by("price", place).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", place).alias("close"), F.sum("volume").alias("volume"),
    )


def _sql_ohlc(order: str) -> str:
    place = ", ".join(f"'{c}': {c}" for c in order.split(", "))
    return f"arg_min(price, {{{place}}}) AS open, max(price) AS high, min(price) AS low, arg_max(price, {{{place}}}) AS close, sum(volume) AS volume"


LINE_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly bars of six entities (return flag and line status): a complete grid."""
    rows = table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("entity"), F.trunc("l_shipdate", "month").alias("session"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("volume"), *LINE_ORDER)
    return _ohlc(rows, LINE_ORDER)


BARS = f"bars AS (SELECT entity, session, {_sql_ohlc(', '.join(LINE_ORDER))} FROM (SELECT l_returnflag || l_linestatus AS entity, CAST(date_trunc('month', l_shipdate) AS DATE) AS session, l_extendedprice / l_quantity AS price, l_quantity AS volume, * FROM lineitem) GROUP BY entity, session)"


def _event_bars(spark: SparkSession, sf_dir: str, entity: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col(entity).cast("string").alias("entity"), F.to_date("ts").alias("session"), F.col("value").alias("price"), F.lit(1.0).alias("volume"), "ts", "event_id")
    return _ohlc(rows, ["ts", "event_id"])


def ebars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars by event type."""
    return _event_bars(spark, sf_dir, "event_type")


def ubars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars by user: a sparse grid."""
    return _event_bars(spark, sf_dir, "user_id")


def _sql_event_bars(name: str, entity: str) -> str:
    return f"{name} AS (SELECT entity, session, {_sql_ohlc('ts, event_id')} FROM (SELECT CAST({entity} AS VARCHAR) AS entity, CAST(ts AS DATE) AS session, value AS price, 1.0::DOUBLE AS volume, ts, event_id FROM events) GROUP BY entity, session)"


EBARS = _sql_event_bars("ebars", "event_type")
UBARS = _sql_event_bars("ubars", "user_id")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bitemporal rows: entity and event month, available when shipped, ingested up to three days later."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    rows = li.join(o, li["l_orderkey"] == o["o_orderkey"]).where("l_shipdate > o_orderdate")
    return rows.select(
        F.col("l_partkey").alias("entity"), F.trunc("o_orderdate", "month").alias("event_at"), F.to_date("l_shipdate").alias("available_at"),
        F.expr("date_add(to_date(l_shipdate), cast(pmod(l_orderkey, 4) as int))").alias("ingested_at"), F.col("l_extendedprice").alias("value"),
        F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyy-MM-dd")).alias("revision"),
        F.col("l_returnflag").alias("source"), F.when(F.col("l_linestatus") == "O", "observed").otherwise("estimated").alias("basis"),
    )


OBS = """obs AS (SELECT l_partkey AS entity, CAST(date_trunc('month', o_orderdate) AS DATE) AS event_at, CAST(l_shipdate AS DATE) AS available_at,
  CAST(l_shipdate AS DATE) + CAST(l_orderkey % 4 AS INT) AS ingested_at, l_extendedprice AS value,
  concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y-%m-%d')) AS revision,
  l_returnflag AS source, CASE WHEN l_linestatus = 'O' THEN 'observed' ELSE 'estimated' END AS basis
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate > o_orderdate)"""


def transactions(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """A ledger: buys and sells of suppliers' symbols in their region's currency, as doubles; ``more`` columns of the line."""
    li, s = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    place = n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"]).select("n_nationkey", F.col("r_name").alias("currency"))
    # Suppliers come first and alone: Spark knows a table's size, but not a join's, and sends the lines for nothing.
    rows = li.join(s, li["l_suppkey"] == s["s_suppkey"]).join(F.broadcast(place), s["s_nationkey"] == place["n_nationkey"])  # 25 nations
    return rows.select(
        F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyy-MM-dd")).alias("id"),
        F.col("l_suppkey").alias("symbol"), "currency", F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"),
        F.col("l_quantity").alias("quantity"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), (F.col("l_tax") * F.col("l_extendedprice")).alias("fee"),
        F.to_date("l_shipdate").alias("executed_at"), *LINE_ORDER, *more,
    )


TX = """tx AS (SELECT concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y-%m-%d')) AS id, l_suppkey AS symbol, r_name AS currency,
  CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side, l_quantity AS quantity, l_extendedprice / l_quantity AS price, l_tax * l_extendedprice AS fee,
  CAST(l_shipdate AS DATE) AS executed_at, l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_tax, l_returnflag, l_linestatus
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

#: Money as integers of 1e-12: prices are rounded half up to 12 digits, fees are exact.
UNITS = {
    "cents": "CAST(round(l_extendedprice * 100) AS BIGINT)",
    "price_units": "(2 * CAST(round(l_extendedprice * 100) AS BIGINT) * 10000000000 + CAST(l_quantity AS BIGINT)) {div} (2 * CAST(l_quantity AS BIGINT))",
    "fee_units": "CAST(round(l_tax * 100) AS BIGINT) * CAST(round(l_extendedprice * 100) AS BIGINT) * 100000000",
}
MONEY = "decimal(38,12)"


def money(units: str) -> Column:
    return (F.col(units).cast("decimal(24,0)") * F.lit("0.000000000001").cast("decimal(13,12)")).cast(MONEY)


def ledger_rows(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """``transactions`` with quantity, price, notional and fee as decimals of 12 digits."""
    tx = transactions(spark, sf_dir, *more, *[F.expr(x.format(div="div")).alias(c) for c, x in UNITS.items()])
    return tx.withColumns({"quantity": F.col("quantity").cast(MONEY), "price": money("price_units"), "fee": money("fee_units"), "notional": (F.col("cents").cast("decimal(20,0)") * F.lit("0.01").cast("decimal(3,2)")).cast(MONEY)}).drop(*UNITS)


TXD = "txd AS (SELECT tx.*, CAST(quantity AS BIGINT) AS q, " + ", ".join(x.format(div="//") + f" AS {c}" for c, x in UNITS.items()) + " FROM tx)"

AS_OF = "1998-06-01"


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last price of each symbol before a fixed day, as a decimal."""
    before = ledger_rows(spark, sf_dir).where(F.col("executed_at") < F.lit(AS_OF).cast("date"))
    place = F.struct(*LINE_ORDER)
    last = before.groupBy("symbol", "currency").agg(F.max(F.struct(place.alias("o"), "price", "executed_at")).alias("a"))
    return last.select("symbol", "currency", F.col("a.price").alias("price"), F.col("a.executed_at").alias("as_of"))


SNAP = f"""snap AS (SELECT symbol, currency, price_units, executed_at AS as_of FROM (SELECT *, row_number() OVER (PARTITION BY symbol, currency ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, price_units DESC) AS k FROM txd WHERE executed_at < DATE '{AS_OF}') WHERE k = 1)"""


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("symbol"), F.col("event_id").alias("id"), F.col("event_type").alias("source"), F.when(F.col("event_id") % 17 != 0, F.col("ts")).alias("published_at"))


NEWS = "news AS (SELECT user_id AS symbol, event_id AS id, event_type AS source, CASE WHEN event_id % 17 <> 0 THEN ts END AS published_at FROM events)"


def corporate_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("symbol"), F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("event_date"),
        F.expr("date_sub(to_date(o_orderdate), cast(pmod(o_orderkey, 60) as int))").alias("announced_at"),
        F.when(F.col("o_orderpriority").rlike("^[12]"), "earnings").when(F.col("o_orderpriority").rlike("^3"), "dividend").otherwise("stock_split").alias("event_type"),
        F.when(F.col("o_orderstatus") == "F", "confirmed").when(F.col("o_orderstatus") == "O", "scheduled").otherwise("tentative").alias("status"),
        F.concat(F.lit("feed"), (F.col("o_orderkey") % 3).cast("string")).alias("source"),
    )


CEV = """cev AS (SELECT o_custkey AS symbol, o_orderkey AS id, CAST(o_orderdate AS DATE) AS event_date, CAST(o_orderdate AS DATE) - CAST(o_orderkey % 60 AS INT) AS announced_at,
  CASE WHEN regexp_matches(o_orderpriority, '^[12]') THEN 'earnings' WHEN regexp_matches(o_orderpriority, '^3') THEN 'dividend' ELSE 'stock_split' END AS event_type,
  CASE o_orderstatus WHEN 'F' THEN 'confirmed' WHEN 'O' THEN 'scheduled' ELSE 'tentative' END AS status, 'feed' || o_orderkey % 3 AS source FROM orders)"""


def lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing intervals of parts: from the first to the last ship month, open-ended for every fifth size."""
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    months = li.groupBy("l_partkey").agg(F.trunc(F.min("l_shipdate"), "month").alias("listing"), F.trunc(F.max("l_shipdate"), "month").alias("last"))
    return months.join(p, months["l_partkey"] == p["p_partkey"]).select(F.col("l_partkey").alias("entity"), "listing", F.when(F.col("p_size") % 5 != 0, F.col("last")).alias("delisting"))


LIFE = "life AS (SELECT l_partkey AS entity, CAST(date_trunc('month', min(l_shipdate)) AS DATE) AS listing, CASE WHEN any_value(p_size) % 5 <> 0 THEN CAST(date_trunc('month', max(l_shipdate)) AS DATE) END AS delisting FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_partkey)"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored predictions: y is the label, p a fixed function of doc_id, 20 sessions."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    return table(spark, sf_dir, "labels").join(d, "doc_id").select(F.col("doc_id").alias("symbol"), (F.col("doc_id") % 20).alias("session"), ((F.col("doc_id") * 37 % 101) / F.lit(100.0)).alias("p"), F.col("quality").cast("int").alias("y"))


PRED = "pred AS (SELECT doc_id AS symbol, doc_id % 20 AS session, (doc_id * 37 % 101) / 100.0::DOUBLE AS p, CAST(quality AS INT) AS y FROM labels JOIN documents USING (doc_id))"


def months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ship months as sessions."""
    return table(spark, sf_dir, "lineitem").select(F.trunc("l_shipdate", "month").alias("session")).distinct()


MONTHS = "months AS (SELECT DISTINCT CAST(date_trunc('month', l_shipdate) AS DATE) AS session FROM lineitem)"
