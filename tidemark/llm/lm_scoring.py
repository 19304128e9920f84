"""Language-model scoring by cross-entropy difference: a target and a background bigram model over one vocabulary.

Every word and every pair of words is counted by itself, as bytes; no entries are shared. Documents are dealt into chunks
by a hash of their id. Each chunk sends its distinct words and pairs with their counts to the hash ranges that add them
up, and gets the whole corpus's counts back in the order it sent them: just the part of both models that its own
documents need. A gram travels once a chunk, however often it occurs, so a hot word is an entry a chunk. Chunks and
ranges both grow with the corpus, so not every chunk writes to every range: beyond FAN chunks the grams go in several
steps, through nodes that add up the grams of FAN senders each, and come back the same way (``Exchange``).

A document that a model was fitted to is scored by that model without it (leave one out): its own counts are taken
from the sums first. So both losses are those of texts not seen before, for target documents as for all others, and a
text that stands twice in the corpus shows in the background's loss.

The models are matched: order, vocabulary, smoothing and size agree. The background is counted over the whole corpus,
then all its counts are brought to the target's number of words, so a word that neither model knows costs the same in
both, whatever the corpus has.
"""

from __future__ import annotations

import dataclasses
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import documents, n_words, ship, stash

WORDS = 1 << 18  # the size that smoothing gives the vocabulary
ADD = 0.1  # what it adds to the count of each word
CHUNK = 1 << 24  # bytes of text in a chunk, about
FAN = 2048  # packs that a chunk, or a node of the exchange, sends at most
PRIOR = 20.0  # words of the unigram model that back up each context


def pack(counts: np.ndarray) -> bytes:
    kind = np.min_scalar_type(int(counts.max(initial=0)))
    return kind.char.encode() + zstandard.compress(counts.astype(kind).tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data[1:]), data[:1].decode()).astype(np.int64)


class Grams:
    """The distinct words and pairs of some texts, in an order that the order of the texts doesn't change.

    ``words`` and ``first``, ``second`` (word numbers of each pair; 0 is the start of a text), ``word`` and ``pair``
    (the number of each occurrence, text after text) and ``lengths`` (words of each text).
    """

    def __init__(self, texts: list[bytes | None]):
        number = _Numbers({b"": 0})
        parts = []
        for text in texts:
            words = text.split() if text else []
            parts.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
        self.lengths = np.array([len(p) for p in parts], np.int64)
        self.words = sorted(number)
        rank = np.empty(len(self.words), np.int64)
        rank[np.fromiter(map(number.__getitem__, self.words), np.int64, len(self.words))] = np.arange(len(self.words))
        self.word = rank[np.concatenate([*parts, np.zeros(0, np.int64)])]
        before = np.concatenate([[0], self.word[:-1]]) if len(self.word) else self.word
        ends = np.cumsum(self.lengths)
        before[(ends - self.lengths)[self.lengths > 0]] = 0
        codes, self.pair = np.unique(before << 32 | self.word, return_inverse=True)
        self.first, self.second = codes >> 32, codes & 0xFFFFFFFF

    def dealt(self, ranges: int) -> tuple[np.ndarray, np.ndarray]:
        """The order of words then pairs by hash range, and the ranges in that order."""
        h = np.fromiter(map(zlib.crc32, self.words), np.uint64, len(self.words))
        mixed = (h[self.first] * np.uint64(0x9E3779B97F4A7C15) ^ h[self.second]) * np.uint64(0xC2B2AE3D27D4EB4F)
        place = (np.concatenate([h * np.uint64(0xD6E8FEB86659FD93), mixed]) >> np.uint64(32)) % np.uint64(ranges)
        place = place.astype(np.uint16 if ranges < 1 << 16 else np.uint32)
        order = np.argsort(place, kind="stable")
        return order, place[order]

    def keys(self, order: np.ndarray) -> pa.Array:
        """A word's bytes, or a pair's with a space between (no word has one), in that order."""
        words = pa.array(self.words, pa.large_binary())
        pairs = pc.binary_join_element_wise(words.take(pa.array(self.first)), words.take(pa.array(self.second)), pa.scalar(b" ", pa.large_binary()))
        return pa.concat_arrays([words, pairs]).take(pa.array(order))

    def counts(self, weight: np.ndarray) -> np.ndarray:
        """Occurrences of words then pairs in texts of weight 1."""
        w = np.repeat(weight, self.lengths)
        return np.concatenate([np.bincount(x, w, n) for x, n in ((self.word, len(self.words)), (self.pair, len(self.first)))]).astype(np.int64)


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


@dataclasses.dataclass
class Model:
    """The documents that both models are fitted to, the ids of the target's, and the sizes that scoring needs."""

    docs: DataFrame
    good: DataFrame
    totals: np.ndarray  # [2, 1]: words of target and background
    size: int  # bytes of text

    def __getitem__(self, key) -> np.ndarray:
        return self.totals[key]


def text_size() -> Column:
    return F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size")


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The target is fitted to documents that ``labels`` calls good (``quality`` 1 in any of its rows), the background
    to all documents, whole texts. Only totals are counted here; ``score`` counts the words and pairs. Null texts and
    labels of unknown or null ids add nothing; repeated rows and repeated labels count by the rows of ``docs``; an empty
    table gives models without words."""
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("_good")).distinct()
    sizes = docs.select("doc_id", n_words(F.col("text")).alias("n"), F.octet_length("text").alias("b")).join(good, F.col("doc_id") == F.col("_good"), "left")
    row = sizes.agg(F.sum(F.when(F.col("_good").isNotNull(), F.col("n"))).alias("t"), F.sum("n").alias("a"), F.sum("b").alias("b")).first()
    return Model(docs, good, np.array([[row["t"] or 0], [row["a"] or 0]], np.int64), row["b"] or 0)


SENT = pa.schema(
    [("group", pa.int64()), ("place", pa.int64()), ("child", pa.int64()), ("answered", pa.bool_())]
    + [(c, pa.binary()) for c in ("grams", "lengths", "ranges", "target", "background")]
)
SENT_DDL = (
    "group long, place long, child long, answered boolean, "
    "grams binary, lengths binary, ranges binary, target binary, background binary"
)
BACK = pa.schema([("group", pa.int64()), ("parent", pa.int64()), ("place", pa.int64()), ("target", pa.binary()), ("background", pa.binary())])
BACK_DDL = "group long, parent long, place long, target binary, background binary"


@dataclasses.dataclass(frozen=True)
class Exchange:
    """How ``n`` chunks reach ``n`` hash ranges in ``levels`` steps, each node sending at most ``fan`` packs a step.

    After step l, node (group, place) holds chunks group * fan^l .. and of their grams those whose range is in
    place * fan^(levels - l) .. : the more chunks a node has met, the fewer ranges it keeps, so all nodes hold about a
    chunk's worth, and the packs of all steps are n * fan * levels instead of n * n.
    """

    n: int
    fan: int
    levels: int

    @classmethod
    def of(cls, n: int, most: int) -> Exchange:
        levels = 1
        while most**levels < n:
            levels += 1
        fan = max(1, math.ceil(n ** (1 / levels)))
        return cls(n, fan + (fan**levels < n), levels)

    def packs(self, level: int, group: int, answered: bool, keys: pa.Array, ranges: np.ndarray, counts: list[np.ndarray]) -> pa.Table:
        """SENT of a node to the nodes of ``level``; ``keys`` are ordered by ``ranges``."""
        width = self.fan ** (self.levels - level)
        places = range(int(ranges[0]) // width, int(ranges[-1]) // width + 1) if len(ranges) else range(0)
        starts = np.searchsorted(ranges, np.array([p * width for p in places], ranges.dtype)).tolist()
        offsets = np.frombuffer(keys.buffers()[1], np.int64)[keys.offset : keys.offset + len(keys) + 1]
        values, lengths = memoryview(keys.buffers()[2]), np.diff(offsets)
        rows = []
        for place, a, b in zip(places, starts, [*starts[1:], len(ranges)]):
            if a == b:
                continue
            inner = pack(ranges[a:b].astype(np.int64) - place * width) if width > 1 else None
            grams = zstandard.compress(values[offsets[a] : offsets[b]], 1)
            rows.append((group // self.fan, place, group, answered, grams, pack(lengths[a:b]), inner, *(pack(c[a:b]) for c in counts)))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), SENT)], schema=SENT) if rows else SENT.empty_table()


class Node:
    """What one node of a step has received: its grams once each, their sums, and who asked for which."""

    def __init__(self, rows: pa.Table, exchange: Exchange, level: int):
        rows = rows.sort_by([("child", "ascending"), ("answered", "ascending")])
        lengths = [unpack(x) for x in rows["lengths"].to_pylist()]
        self.ends = np.cumsum([len(x) for x in lengths])
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(lengths))])
        values = b"".join(map(zstandard.decompress, rows["grams"].to_pylist()))
        keys = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values)])
        coded = keys.dictionary_encode()
        self.rows = rows.select(["group", "place", "child", "answered"])
        self.keys, self.number = coded.dictionary, coded.indices.to_numpy()
        counts = (np.concatenate([unpack(x) for x in rows[c].to_pylist()]) for c in ("target", "background"))
        self.sums = [np.bincount(self.number, c).astype(np.int64) for c in counts]
        if level < exchange.levels:
            width = exchange.fan ** (exchange.levels - level)
            self.ranges = np.empty(len(self.keys), np.int64)
            self.ranges[self.number] = np.concatenate([unpack(x) for x in rows["ranges"].to_pylist()]) + rows["place"][0].as_py() * width
            self.order = np.argsort(self.ranges, kind="stable")

    def onward(self, exchange: Exchange, level: int) -> pa.Table:
        answered = pc.any(self.rows["answered"]).as_py()
        o = self.order
        return exchange.packs(level + 1, self.rows["group"][0].as_py(), answered, self.keys.take(pa.array(o)), self.ranges[o], [c[o] for c in self.sums])

    def answers(self, exchange: Exchange, level: int, sums: list[np.ndarray]) -> pa.Table:
        """BACK: ``sums``, for each child in the order of its own grams."""
        out, place = [], self.rows["place"][0].as_py()
        parent = place // exchange.fan if level > 1 else 0
        whole = [s[self.number] for s in sums]
        for child, answered, a, b in zip(self.rows["child"].to_pylist(), self.rows["answered"].to_pylist(), [0, *self.ends[:-1]], self.ends):
            if answered:
                out.append((child, parent, place, *(pack(s[a:b]) for s in whole)))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), BACK)], schema=BACK) if out else BACK.empty_table()


def received(back: pa.Table) -> Iterator[np.ndarray]:
    """Target and background counts of a node's grams, in the order in which it sent them."""
    back = back.sort_by("place")
    for c in ("target", "background"):
        yield np.concatenate([np.zeros(0, np.int64), *(unpack(x) for x in back[c].to_pylist())])


def chunked(docs: DataFrame, n: int) -> DataFrame:
    """Rows without an id are dealt by their text."""
    h = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    return docs.select(F.pmod(h, F.lit(n)).alias("_chunk"), "doc_id", F.col("text").cast("binary").alias("text"))


def good_ids(good: DataFrame, n: int) -> DataFrame:
    return good.select(F.pmod(F.xxhash64("_good"), F.lit(n)).alias("_chunk"), "_good")


def sent(docs: DataFrame, good: DataFrame, exchange: Exchange, counted: bool, answered: bool) -> DataFrame:
    """SENT: each chunk's grams and counts, to the first step; zero counts unless ``counted``."""

    def count(mine: pa.Table, marks: pa.Table) -> pa.Table:
        grams = Grams(mine["text"].to_pylist())
        if not mine.num_rows or not len(grams.word):
            return SENT.empty_table()
        order, ranges = grams.dealt(exchange.n)
        known = np.array(pc.is_in(mine["doc_id"], pc.unique(marks["_good"])).to_pylist(), np.int64)
        counts = [grams.counts(w if counted else 0 * w)[order] for w in (known, np.ones_like(known))]
        return exchange.packs(1, mine["_chunk"][0].as_py(), answered, grams.keys(order), ranges, counts)

    return docs.groupBy("_chunk").cogroup(good_ids(good, exchange.n).groupBy("_chunk")).applyInArrow(count, SENT_DDL)


def added_up(rows: DataFrame, exchange: Exchange) -> DataFrame:
    """BACK for the chunks: the sums over all chunks, for each chunk in the order of its own grams.

    Steps before the last are written, as their nodes are asked again on the way back.
    """

    def onward(level: int):
        return lambda rows: Node(rows, exchange, level).onward(exchange, level)

    def returned(level: int):
        def step(rows: pa.Table, back: pa.Table) -> pa.Table:
            if not back.num_rows:
                return BACK.empty_table()
            node = Node(rows, exchange, level)
            sums = [np.empty_like(s) for s in node.sums]
            for s, known in zip(sums, received(back)):
                s[node.order] = known
            return node.answers(exchange, level, sums)

        return step

    def last(rows: pa.Table) -> pa.Table:
        node = Node(rows, exchange, exchange.levels)
        return node.answers(exchange, exchange.levels, node.sums)

    steps = []
    for level in range(1, exchange.levels):
        steps.append(stash(rows, "packs"))
        rows = steps[-1].groupBy("group", "place").applyInArrow(onward(level), SENT_DDL)
    back = rows.groupBy("group", "place").applyInArrow(last, BACK_DDL)
    for level in range(exchange.levels - 1, 0, -1):
        asked, answers = steps[level - 1].groupBy("group", "place"), back.groupBy("group", "parent")
        back = asked.cogroup(answers).applyInArrow(returned(level), BACK_DDL)
    return back


def own_counts(text: np.ndarray, number: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """How often each of ``wanted`` stands among the ``number`` of its own text (all of one length, text by text)."""
    span = int(max(number.max(initial=0), wanted.max(initial=0))) + 1
    codes, counts = np.unique(text * span + number, return_counts=True)
    at = np.minimum(np.searchsorted(codes, text * span + wanted), len(codes) - 1)
    return np.where(codes[at] == text * span + wanted, counts[at], 0)


def losses(grams: Grams, counts: np.ndarray, totals: np.ndarray, fitted: np.ndarray) -> np.ndarray:
    """[2, occurrences]: the loss of each word in nats under the target and the background model.

    A word's chance is (pair count + PRIOR * unigram chance) / (context count + PRIOR), the unigram chance smoothed
    by ADD; a first word has no context. ``counts`` [2, words + pairs] and ``totals`` [2, 1] are the whole corpus's;
    ``fitted`` [2, texts] is 1 where a model counted that text, whose own counts are then left out. The background's
    counts are taken ``scale`` times.
    """
    scale = np.array([[1.0], [totals[0, 0] / max(1, totals[1, 0])]])
    text = np.repeat(np.arange(len(grams.lengths)), grams.lengths)
    out = fitted[:, text]
    first, second = grams.first[grams.pair], grams.word
    inside = first > 0
    pairs = np.where(inside, counts[:, len(grams.words) :][:, grams.pair] - out * own_counts(text, grams.pair, grams.pair), 0)
    uni = counts[:, second] - out * own_counts(text, second, second)
    context = np.where(inside, counts[:, first] - out * own_counts(text, second, first), 0)
    words = totals - out * grams.lengths[text]
    return -np.log((pairs * scale + PRIOR * (uni * scale + ADD) / (words * scale + ADD * WORDS)) / (context * scale + PRIOR))


SCORES = "n_tokens long, target_loss double, background_loss double, difference double"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, difference: means over the words of each whole text.

    A low difference means like the target. Scoring the very table that the models are fitted to leaves each row out of
    its own score; other tables meet the whole models. Texts without words (null too) have 0 tokens and null losses;
    each row is scored, repeated ones too; other columns aren't read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    own = docs is model.docs
    size = model.size if own else max(model.size, docs.agg(text_size()).first()["size"])
    n = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // CHUNK))
    exchange = Exchange.of(n, FAN)
    mine = chunked(docs, n)
    rows = sent(mine, model.good, exchange, own, True)
    if not own:
        rows = rows.unionAll(sent(chunked(model.docs, n), model.good, exchange, True, False))
    totals = model.totals
    id_type = docs.schema["doc_id"].dataType

    back = added_up(rows, exchange).select(F.col("group").alias("chunk"), "place", "target", "background", F.lit(None).cast(id_type).alias("_good"))
    none = F.lit(None).cast("binary")
    back = back.unionByName(good_ids(model.good, n).select(F.col("_chunk").alias("chunk"), F.lit(-1).cast("long").alias("place"), none.alias("target"), none.alias("background"), "_good"))

    def apply(mine: pa.Table, back: pa.Table) -> pa.Table:
        grams = Grams(mine["text"].to_pylist())
        n_tokens = grams.lengths
        means = np.full((2, len(n_tokens)), np.nan)
        if len(grams.word):
            good = pc.unique(back["_good"].drop_null())
            fitted = np.stack([np.array(pc.is_in(mine["doc_id"], good).to_pylist(), np.int64), np.ones(mine.num_rows, np.int64)]) * int(own)
            order, _ = grams.dealt(n)
            counts = np.empty((2, len(order)), np.int64)
            for i, known in enumerate(received(back.filter(pc.greater_equal(back["place"], 0)))):
                counts[i, order] = known
            loss = losses(grams, counts, totals, fitted)
            text = np.repeat(np.arange(len(n_tokens)), n_tokens)
            with np.errstate(invalid="ignore"):
                means = np.stack([np.bincount(text, x, len(n_tokens)) for x in loss]) / n_tokens
        columns = [pa.array(x, pa.float64(), from_pandas=True) for x in (*means, means[0] - means[1])]
        return pa.table([mine["doc_id"], pa.array(n_tokens), *columns], ["doc_id", "n_tokens", "target_loss", "background_loss", "difference"])

    return mine.groupBy("_chunk").cogroup(back.groupBy("chunk")).applyInArrow(apply, f"doc_id {id_type.simpleString()}, {SCORES}")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
