"""Ranked lexical search by dense blocked multiplication.

The vocabulary is that of the items alone. Items are taken in blocks, and each block's vocabulary in tiles: a dense
matrix of term weights by item. Documents come in tiles of rows: a dense matrix of their impacts of the terms. Both hold
whole numbers in float64, and a tile of the vocabulary ends before the sum of any item's weights times the largest
impact could reach 2^53, so every sum that the multiplication makes is exact whatever its order; sums of tiles are added
as 64-bit integers. Of each product only the best documents of an item go on: those that score more than the last of
them, and of equals the ones of least doc_id.

A document is read once: its terms of the vocabulary and their counts are written, and the multiplication reads these.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, documents, new_path, ship, stash

TOP = 10
#: An impact is (SCALE * tf) div (1000 * tf + 8 * m), so less than IMPACT.
SCALE = 1_000_000_000
IMPACT = SCALE // 1000
EXACT = 1 << 53
#: A block of items holds about so many items and terms; the driver and each task hold one block at a time.
BLOCK_ITEMS = 2048
BLOCK_TERMS = 1 << 18
#: Terms of a vocabulary tile, at most, and numbers of a document tile.
TILE_TERMS = 4096
TILE_NUMBERS = 1 << 20
#: A vocabulary of so many terms at most filters the documents' terms before they are written.
VOCABULARY = 1 << 20
#: Groups in which the tasks' best documents of an item meet first.
GROUPS = 64

_KEPT = {*range(48, 58), *range(97, 123), *range(128, 256)}
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c in _KEPT else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and characters beyond ASCII, with A-Z in lower case."""
    return (text or "").encode().translate(_FOLD).split()


def weight(documents_: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents_ + 2) / (2 * holding + 1)))


def measure(n: np.ndarray, documents_: int, terms_: int) -> np.ndarray:
    """m of documents of ``n`` terms."""
    return 100 - 90 + (90 * n * documents_) // max(1, terms_)


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (SCALE * tf) // (1000 * tf + 8 * m)


def item_terms(items: DataFrame) -> DataFrame:
    """item (a number of the row), item_id, terms (distinct)."""
    ship(items.sparkSession)

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[["item", "item_id"]].assign(terms=[sorted(set(terms(t))) for t in batch["text"]])

    kind = items.schema["item_id"].dataType.simpleString()
    own = items.select(F.monotonically_increasing_id().alias("item"), "item_id", "text")
    return own.mapInPandas(apply, f"item long, item_id {kind}, terms array<binary>")


class Block:
    """A block of items, with its vocabulary cut into tiles: each the terms' columns and a matrix of weights."""

    def __init__(self, rows: list, holding: dict[bytes, int], n_documents: int):
        self.items = [r["item"] for r in rows]
        place: dict[bytes, int] = {}
        for r in rows:
            for t in r["terms"]:
                if holding.get(bytes(t)):  # a term that no document has adds nothing
                    place.setdefault(bytes(t), len(place))
        self.terms = list(place)
        weights = [weight(n_documents, holding[t]) for t in place]
        held = [[place[bytes(t)] for t in r["terms"] if bytes(t) in place] for r in rows]
        owners: list[list[int]] = [[] for _ in place]
        for i, own in enumerate(held):
            for j in own:
                owners[j].append(i)
        self.ends, sums = [0], Counter()
        for j, w in enumerate(weights):
            if j - self.ends[-1] >= TILE_TERMS or any((sums[i] + w) * IMPACT >= EXACT for i in owners[j]):
                self.ends.append(j)
                sums.clear()
            for i in owners[j]:
                sums[i] += w
        self.ends = sorted({*self.ends, len(place)})
        self.weights, self.owners = weights, owners

    def tiles(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first term, end, weights of these terms by item)."""
        for start, end in zip(self.ends, self.ends[1:]):
            matrix = np.zeros((end - start, len(self.items)))
            for j in range(start, end):
                matrix[j - start, self.owners[j]] = self.weights[j]
            yield start, end, matrix


def best(scores: np.ndarray, none: np.ndarray, ids: np.ndarray, rows: np.ndarray, top: int) -> np.ndarray:
    """Places of the ``top`` best positive ``scores``: highest first, then least id (``none``: last), then least row."""
    found = np.flatnonzero(scores > 0)
    if len(found) > top:
        least = np.partition(scores[found], len(found) - top)[len(found) - top]
        found = found[scores[found] >= least]  # all ties stay until ids tell them apart
    return found[np.lexsort((rows[found], ids[found], none[found], -scores[found]))[:top]]


def _counts(docs: DataFrame, vocabulary: DataFrame, scratch: Scratch) -> tuple[DataFrame, int, int]:
    """Documents with terms: row, none, doc_id, n, and those of the vocabulary with their counts; how many, and all terms.

    ``vocabulary`` (term) is held by each task while it is small (VOCABULARY terms); a larger one is no filter.
    """
    known = vocabulary.select("term").limit(VOCABULARY + 1).collect()
    wanted = {bytes(r["term"]) for r in known} if len(known) <= VOCABULARY else None

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for none, doc, text in zip(batch["none"], batch["doc_id"], batch["text"]):
                own = Counter(terms(text))
                if own:
                    held = own if wanted is None else {t: own[t] for t in own.keys() & wanted}
                    keys = sorted(held)
                    rows.append((none, doc, sum(own.values()), keys, [held[k] for k in keys]))
            yield pd.DataFrame(rows, columns=["none", "doc_id", "n", "terms", "tf"])

    doc = F.col("doc_id").cast("long")
    own = docs.select(doc.isNull().alias("none"), F.coalesce(doc, F.lit(0)).alias("doc_id"), "text")
    counted = own.mapInPandas(apply, "none boolean, doc_id long, n long, terms array<binary>, tf array<long>")
    counted = scratch.stash(counted.withColumn("row", F.monotonically_increasing_id()), "counts")
    total = counted.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).head()
    return counted, total["n"], total["l"]


def _scored(counted: DataFrame, block: Block, n_documents: int, n_terms: int, top: int) -> DataFrame:
    """SCORES: each task's ``top`` best documents of each item of the block."""
    shared = counted.sparkSession.sparkContext.broadcast(block)  # BLOCK_ITEMS and BLOCK_TERMS bound it

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        place = {t: j for j, t in enumerate(own.terms)}
        tiles = list(own.tiles())
        width = max([e - s for s, e, _ in tiles], default=1)
        step = max(16, TILE_NUMBERS // max(width, len(own.items)))
        kept: list[list[tuple[int, bool, int, int]]] = [[] for _ in own.items]  # (- score, none, doc_id, row)
        for batch in batches:
            for i in range(0, len(batch), step):
                part = batch.iloc[i : i + step]
                found = [[place.get(bytes(t), -1) for t in held] for held in part["terms"]]
                sizes = [len(x) for x in found]
                line = np.repeat(np.arange(len(part)), sizes)
                column = np.fromiter((j for x in found for j in x), np.int64, sum(sizes))
                tf = np.concatenate([np.asarray(x, np.int64) for x in part["tf"]]) if sum(sizes) else np.empty(0, np.int64)
                m = measure(part["n"].to_numpy(np.int64), n_documents, n_terms)
                value = impacts(tf, m[line])
                scores = np.zeros((len(part), len(own.items)), np.int64)
                for start, end, weights in tiles:
                    inside = (column >= start) & (column < end)
                    dense = np.zeros((len(part), end - start))
                    dense[line[inside], column[inside] - start] = value[inside]
                    scores += (dense @ weights).astype(np.int64)
                none, ids, rows = (part[c].to_numpy() for c in ("none", "doc_id", "row"))
                least = np.array([-k[-1][0] if len(k) == top else 1 for k in kept])
                for item in np.flatnonzero((scores >= least).any(axis=0)).tolist():
                    at = best(scores[:, item], none, ids, rows, top)
                    new = zip((-scores[at, item]).tolist(), none[at].tolist(), ids[at].tolist(), rows[at].tolist())
                    kept[item] = sorted([*kept[item], *new])[:top]
        flat = [(own.items[i], -s, none, d, r) for i, k in enumerate(kept) for s, none, d, r in k]
        out = pd.DataFrame(flat, columns=["item", "score", "none", "doc_id", "row"])
        yield out.assign(task=TaskContext.get().partitionId())

    return counted.mapInPandas(apply, SCORES)


SCORES = "item long, score long, none boolean, doc_id long, row long, task int"


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` best documents of each row of ``items`` (item_id, text).

    ``docs`` has doc_id (an integer) and text. Null texts have no terms; an item without terms, or whose terms no
    document has, gives no rows, and so do empty tables. Each row of ``items`` is an item of its own, so repeated rows
    give repeated results. Rows of ``docs`` count and rank each for itself: repeated ones have equal scores. A null
    doc_id comes after all others of its score. Texts are read whole at any length; other columns aren't read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    own = scratch.stash(item_terms(items), "items")
    size = own.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("t")).head()
    vocabulary = own.select(F.explode("terms").alias("term")).distinct()
    counted, n_documents, n_terms = _counts(docs, vocabulary, scratch)
    blocks = max(1, -(-size["n"] // BLOCK_ITEMS), -(-size["t"] // BLOCK_TERMS))
    dealt = own.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
    holding = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    if blocks > 1:
        holding = scratch.stash(holding.join(vocabulary, "term", "left_semi"), "df")
    parts = []
    for k in range(blocks):  # a pass over the documents' counts each; one block at a time is held
        rows = dealt.where(F.col("block") == k).select("item", "terms").sort("item").collect()
        if not rows:
            continue
        mine = dealt.where(F.col("block") == k).select(F.explode("terms").alias("term")).distinct()
        df = {bytes(r["term"]): r["df"] for r in holding.join(mine, "term", "left_semi").collect()}
        block = Block(rows, df, n_documents)
        found = _scored(counted, block, n_documents, n_terms, top)
        path = new_path(spark, "scores")
        found.write.parquet(path)
        parts.append(path)
    scores = spark.read.schema(SCORES).parquet(*parts) if parts else spark.createDataFrame([], SCORES)
    place = [F.desc("score"), "none", "doc_id", "row"]
    first = W.partitionBy("item", F.pmod("task", F.lit(GROUPS))).orderBy(*place)
    scores = scores.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top)
    scores = scores.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(*place))).where(F.col("rank") <= top)
    doc = F.when(~F.col("none"), F.col("doc_id")).alias("doc_id")
    out = stash(scores.join(own.select("item", "item_id"), "item").select("item_id", "rank", doc, "score"), "ranked")
    scratch.paths += parts
    scratch.clear()
    return out


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP12_SQL = f"""
WITH dt AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_TERM}')) AS term FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_TERM}')) AS term FROM benchmark),
dl AS (SELECT doc_id, count(*) AS n FROM dt GROUP BY doc_id),
st AS (SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM dl),
tf AS (SELECT doc_id, term, count(*) AS tf FROM dt GROUP BY doc_id, term),
w AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), st),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // ll))))::BIGINT AS score
  FROM q JOIN tf USING (term) JOIN w USING (term) JOIN dl USING (doc_id), st GROUP BY item_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 10
"""
