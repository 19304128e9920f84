"""Near duplicates by Order MinHash, verified by banded alignment.

Of a text's k-mers (SHINGLE words each, labelled by their occurrence) every sketch element keeps the LENGTH that are
least under a hash function of its own, in the order of the text. Texts that share an element are candidates: k-mers
and their order must both agree, so the chance follows edit similarity. An alignment inside the band that the wanted
similarity leaves then gives similarity = aligned k-mers / (all k-mers of both - aligned), at least SIMILARITY.

Classes are the connected components of the links. A first round compares each bucket's members with the one that
shares most buckets, its pivot. Up to ROUNDS more compare, in each bucket that still holds several classes, a member of
its largest class with the members of the others, and relabel. The candidates that are then still in two classes are
compared too, but for those whose k-mers rule similarity out: a similar pair has at least SIMILARITY / (1 + SIMILARITY)
of its k-mers in common, so it shares one among the rarest few of either text (a prefix filter, which loses no pair).
K-mers that lie in one class only can't be in common, so members of a large group that differ from it in more than that
share meet nobody. Pairs inside one class need no comparing: a large group of copies costs a few comparisons a member.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, documents, packed, row_key, ship, stash, text_key

SHINGLE = 5
SIMILARITY = 0.8
ELEMENTS = 80
LENGTH = 7
#: Rounds with new pivots, at most, before all candidates that are left are compared.
ROUNDS = 4
#: Texts of fewer k-mers than SHORT / SIMILARITY also get elements of SHORT_LENGTH; those of SHORT * SIMILARITY or
#: more get the long ones. Any pair that is similar enough then shares one kind.
SHORT = 20
SHORT_LENGTH = 2
#: Hash values that a sketch holds at once.
BLOCK = 1 << 21
#: Texts whose arrays a task holds at once.
SLICE = 500
#: Partners of one text that are compared with it in one group.
PARTNERS = 200
#: Numbers of k-mers are dealt into bins that grow by this ratio, for the prefix filter.
RATIO = 1.03

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SEEDS = np.random.default_rng(11).integers(1, 1 << 63, ELEMENTS, dtype=np.uint64)[:, None]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _A
    return (x ^ (x >> np.uint64(29))) * _B


def shingles(text: str | None) -> np.ndarray:
    """Hashes of the runs of SHINGLE words in order; a shorter text is one run of its own length."""
    words = (text or "").encode().split()
    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words)) ^ np.fromiter(map(zlib.adler32, words), np.uint64, len(words)) << np.uint64(32)
    n = max(1, len(h) - SHINGLE + 1)
    out = np.full(n, len(h) if len(h) < SHINGLE else 0, np.uint64)
    for i in range(min(SHINGLE, len(h))):
        out = _mix(out * np.uint64(3) + h[i : i + n])
    return out


def labelled(h: np.ndarray) -> np.ndarray:
    """``h`` with each hash changed by how often it came before, so that no two agree."""
    order = np.argsort(h, kind="stable")
    ranked = h[order]
    if not (ranked[1:] == ranked[:-1]).any():
        return h
    first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    at = np.arange(len(h))
    label = np.empty(len(h), np.uint64)
    label[order] = at - np.maximum.accumulate(np.where(first, at, 0))
    return np.where(label > 0, _mix(h + label * _B), h)


def kmers(text: str | None) -> np.ndarray:
    """Hashes of the text's k-mers in order, each labelled by its occurrence."""
    return labelled(shingles(text))


def sketch(text: str | None) -> tuple[int, np.ndarray]:
    """(k-mers, bucket of each sketch element). Long texts take few elements at a time: BLOCK hash values at most."""
    h = kmers(text)
    n = len(h)
    kinds = [x for x, wanted in ((LENGTH, n >= SHORT * SIMILARITY), (SHORT_LENGTH, n < SHORT / SIMILARITY)) if wanted]
    buckets: dict[int, list[np.ndarray]] = {x: [] for x in kinds}
    step = max(1, BLOCK // n)
    for start in range(0, ELEMENTS, step):
        seeds = _SEEDS[start : start + step]
        values = _mix(h[None, :] ^ seeds)
        for length in kinds:
            if length < n:
                at = np.argpartition(values, length - 1, axis=1)[:, :length]
                at.sort(axis=1)
            else:
                at = np.broadcast_to(np.arange(n), (len(seeds), n))
            key = _mix(seeds[:, 0] + np.uint64(length))
            for column in h[at].T:
                key = _mix(key * np.uint64(5) + column)
            buckets[length].append(key.view(np.int64))
    return n, np.concatenate([x for found in buckets.values() for x in found])


def aligned(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Longest common subsequence of ``a`` and ``b`` over matches at most ``band`` places apart.

    Bit-parallel rows that hold the band's places only: a place below the band never changes again.
    """
    m = min(len(a), len(b))
    differ = np.flatnonzero(a[:m] != b[:m])
    lo = int(differ[0]) if len(differ) else m
    differ = np.flatnonzero(a[len(a) - (m - lo) :][::-1] != b[len(b) - (m - lo) :][::-1])
    hi = int(differ[0]) if len(differ) else m - lo
    places: dict[int, list[int]] = {}
    for i, x in enumerate(a[lo : len(a) - hi].tolist()):
        places.setdefault(x, []).append(i)
    n, base, top, row, found = len(a) - hi - lo, 0, 0, 0, lo + hi
    for j, x in enumerate(b[lo : len(b) - hi].tolist()):
        low, high = min(n, max(0, j - band)), min(n, j + band + 1)
        if low > base:
            found += low - base - (row & ((1 << (low - base)) - 1)).bit_count()
            row, base = row >> (low - base), low
        if high > top:
            row |= ((1 << (high - top)) - 1) << (top - base)
            top = high
        match = 0
        for i in places.get(x, ()):
            if base <= i < top:
                match |= 1 << (i - base)
        if match:
            both = row & match
            row = ((row + both) | (row - both)) & ((1 << (top - base)) - 1)
    return found + top - base - row.bit_count()


def _rising(places: list[int]) -> int:
    """Length of the longest rising subsequence."""
    ends: list[int] = []
    for x in places:
        at = bisect_left(ends, x)
        ends[at : at + 1] = [x]
    return len(ends)


def _prepared(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The text's k-mers in order, without and with their occurrence."""
    plain = shingles(text)
    return plain, labelled(plain)


def _compared(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray], least: float = SIMILARITY, exact: bool = False) -> float:
    """``compare`` of two prepared texts."""
    (x, known_x), (y, known_y) = one, two
    _, i, j = np.intersect1d(known_x, known_y, assume_unique=True, return_indices=True)
    total, common = len(x) + len(y), len(i)
    if common / (total - common) < least:
        return 0.0
    need = least * total / (1 + least)  # aligned k-mers that the similarity takes
    along = j[np.argsort(i)]
    found = common if (along[1:] > along[:-1]).all() else 0 if exact else _rising(along.tolist())
    if found < need and found < common:
        found = aligned(x, y, int(total - 2 * need) + 1)
    similarity = found / (total - found)
    return similarity if similarity >= least else 0.0


def compare(a: str | None, b: str | None, least: float = SIMILARITY, exact: bool = False) -> float:
    """Aligned k-mers over all k-mers of both; 0 where it is below ``least``.

    Labelled k-mers that agree rise in both texts unless passages moved, and then the alignment is known at once. So
    unless ``exact`` is wanted, an alignment of labelled k-mers that reaches ``least`` is enough.
    """
    return _compared(_prepared(a), _prepared(b), least, exact)


def similarity(a: str | None, b: str | None) -> float:
    """Aligned k-mers over all k-mers of both; 0 where it is below SIMILARITY."""
    return compare(a, b, exact=True)


def _fits(a: Column, b: Column) -> Column:
    """Similar texts have about as many k-mers."""
    return F.least(a, b) >= F.greatest(a, b) * SIMILARITY


def _slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SLICE rows at a time, so that a task holds the arrays of few texts."""
    for batch in batches:
        for i in range(0, len(batch), SLICE):
            yield batch.iloc[i : i + SLICE]


def _pairs(rows: DataFrame, node: str, hub: str) -> DataFrame:
    """a, b, hub: each pair of ``node`` and ``hub`` once, the lesser first."""
    rows = rows.select(F.least(node, hub).alias("a"), F.greatest(node, hub).alias("b"), F.col(hub).alias("hub"))
    return rows.groupBy("a", "b").agg(F.min("hub").alias("hub"))


def _with_hubs(pairs: DataFrame) -> DataFrame:
    """a, b, hub: the hub of a pair is the one that stands in more of ``pairs``."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    one, two = (ends.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}")) for x in "ab")
    return pairs.join(one, "a").join(two, "b").select("a", "b", F.when(F.col("n_a") >= F.col("n_b"), F.col("a")).otherwise(F.col("b")).alias("hub"))


def _linked(pairs: DataFrame, texts: DataFrame, exact: bool = False) -> DataFrame:
    """a, b, similarity: the pairs (a, b, hub) that are similar enough; ``texts`` has node and text.

    A hub's partners are dealt into parts of about PARTNERS. Sorted, each part begins with the hub's text, whose k-mers
    are found once and are all that a task keeps while the partners pass. So a hub's text is sent once a part and not
    once a pair, and many tasks share a large hub.
    """

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head = None
        for batch in batches:
            found = []
            for hub, other, text in zip(batch["hub"].tolist(), batch["other"].tolist(), batch["text"]):
                if other < 0:
                    head = _prepared(text)
                    continue
                value = _compared(head, _prepared(text), exact=exact)
                if value >= SIMILARITY:
                    found.append((min(hub, other), max(hub, other), value))
            yield pd.DataFrame(found, columns=["a", "b", "similarity"])

    sizes = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).alias("parts")).where("parts > 1")
    other = (F.col("a") + F.col("b") - F.col("hub")).alias("other")
    dealt = pairs.select("hub", other).join(sizes, "hub", "left")
    dealt = dealt.select("hub", "other", F.pmod(F.xxhash64("other"), F.coalesce("parts", F.lit(1))).alias("part"))
    heads = dealt.select("hub", "part").distinct().join(texts.withColumnRenamed("node", "hub"), "hub")
    heads = heads.select("hub", "part", F.lit(-1).cast("long").alias("other"), "text")  # nodes are 0 or more
    partners = dealt.join(texts.withColumnRenamed("node", "other"), "other").select("hub", "part", "other", "text")
    rows = heads.union(partners).repartition("hub", "part").sortWithinPartitions("hub", "part", "other")
    return rows.select("hub", "other", "text").mapInPandas(apply, "a long, b long, similarity double")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, label (least node of its component) for the nodes of ``edges`` (a, b).

    Each round takes the least label around a node and then that label's label; it ends when nothing changes.
    """
    both = scratch.stash(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = scratch.stash(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        around = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("_n")).agg(F.min("label").alias("_l"))
        own = labels.join(around, labels["node"] == around["_n"]).select("node", F.col("label").alias("old"), F.least("label", "_l").alias("label"))
        up = labels.select(F.col("node").alias("_up"), F.col("label").alias("_far"))
        new = own.join(up, own["label"] == up["_up"], "left").select("node", "old", F.least("label", F.coalesce("_far", "label")).alias("label"))
        new = scratch.stash(new, "labels")
        if not new.where("label <> old").head(1):
            return new.select("node", "label")
        labels = new.select("node", "label")


def _mixed(rows: DataFrame, key: list[str]) -> DataFrame:
    """The rows of those keys that hold several classes."""
    group = W.partitionBy(*key)
    return rows.withColumn("_mixed", F.min("label").over(group) < F.max("label").over(group)).where("_mixed").drop("_mixed")


def _bin(n: Column) -> Column:
    return F.floor(F.log(n) / math.log(RATIO) + 1e-9).cast("int")


def _open_pairs(left: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """a, b: pairs of nodes of different classes whose k-mers leave it open that they are similar.

    ``left`` has a row (node, n, label) a node. Of a node's k-mers those that lie in other classes too are put in order
    of rarity. A node emits, for every bin of partner sizes, as many of them as a pair that misses them all couldn't
    spare; similar nodes emit one in common. Classes meet first and then their nodes, so nodes of one class don't meet.
    """

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _slices(batches):
            yield batch[["node", "label", "n"]].assign(kmer=[kmers(t).view(np.int64) for t in batch["text"]])

    share = SIMILARITY / (1 + SIMILARITY)
    whole = left.join(texts, "node").select("node", "label", "n", "text").mapInPandas(apply, "node long, label long, n long, kmer array<long>")
    grams = scratch.stash(whole.withColumn("kmer", F.explode("kmer")), "grams")
    shared = grams.groupBy("kmer").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi"), F.count(F.lit(1)).alias("df")).where("_lo < _hi")
    rare = grams.join(shared.select("kmer", "df"), "kmer").groupBy("node", "label", "n").agg(F.sort_array(F.collect_list(F.struct("df", "kmer"))).alias("rare"))
    rare = rare.withColumn("m", F.size("rare")).where(F.col("m") >= F.ceil(F.col("n") * SIMILARITY - 1e-9))
    rare = rare.withColumn("bin", _bin(F.col("n"))).withColumn("to", F.explode(F.sequence(_bin(F.ceil(F.col("n") * SIMILARITY - 1e-9)), _bin(F.floor(F.col("n") / SIMILARITY + 1e-9)))))
    least = F.ceil(F.pow(F.lit(RATIO), F.col("to")) - 1e-6)  # of a partner in that bin
    take = (F.col("m") - F.ceil((F.col("n") + least) * share - 1e-9) + 1).cast("int")
    sent = rare.withColumn("take", take).where("take > 0").select("node", "label", "n", "m", "bin", F.least("bin", "to").alias("lo"), F.greatest("bin", "to").alias("hi"), F.explode(F.slice("rare", 1, F.col("take"))).alias("r"))
    sent = sent.select(F.col("r.kmer").alias("kmer"), "lo", "hi", "bin", "label", "node", "n", "m")
    key = ["kmer", "lo", "hi"]
    sent = scratch.stash(_mixed(sent, key), "sent")
    kinds = sent.select(*key, "bin", "label").distinct()
    one = kinds.where("bin = lo").select(*key, F.col("label").alias("l1"))
    two = kinds.where("bin = hi").select(*key, F.col("label").alias("l2"))
    meet = one.join(two, key).where("l1 <> l2 AND (lo < hi OR l1 < l2)")
    one = sent.where("bin = lo").select(*key, F.col("label").alias("l1"), F.col("node").alias("n1"), F.col("n").alias("size1"), F.col("m").alias("m1"))
    two = sent.where("bin = hi").select(*key, F.col("label").alias("l2"), F.col("node").alias("n2"), F.col("n").alias("size2"), F.col("m").alias("m2"))
    pairs = meet.join(one, [*key, "l1"]).join(two, [*key, "l2"])
    pairs = pairs.where(_fits(F.col("size1"), F.col("size2")) & (F.least("m1", "m2") >= (F.col("size1") + F.col("size2")) * share - 1e-9))
    return pairs.select(F.least("n1", "n2").alias("a"), F.greatest("n1", "n2").alias("b")).distinct()


def _links(docs: DataFrame, scratch: Scratch, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """(a, b, similarity: links that join each class of near duplicates; node, one, two: the different texts).

    one and two are ``text_key``.
    """
    ship(docs.sparkSession)
    keep = scratch.stash

    def sketched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _slices(batches):
            found = [sketch(t) for t in batch["text"]]
            yield batch[["one", "two"]].assign(n=[x[0] for x in found], buckets=[x[1] for x in found])

    own = docs.select(*text_key(), "text")
    sketches = own.mapInPandas(sketched, "one long, two long, n long, buckets array<long>")
    sketches = sketches.groupBy("one", "two").agg(F.first("n").alias("n"), F.first("buckets").alias("buckets"))
    # Numbers can't collide as hashes do, and stay as written.
    sketches = keep(sketches.withColumn("node", F.monotonically_increasing_id()), "sketches")
    rows = sketches.select("node", "n", F.explode("buckets").alias("bucket"))
    bucket = W.partitionBy("bucket")
    members = keep(rows.withColumn("size", F.count(F.lit(1)).over(bucket)).where("size > 1"), "members")
    nodes = members.groupBy("node").agg(F.sum("size").alias("degree"))
    wanted = sketches.join(nodes, "node", "left_semi").select("one", "two", "node")
    texts = keep(own.join(wanted, ["one", "two"]).groupBy("node").agg(F.first("text").alias("text")), "texts")

    pivot = F.min(F.struct((-F.col("degree")).alias("d"), "node", "n")).over(bucket)
    around = members.join(nodes, "node").withColumn("p", pivot)
    around = keep(around.select("bucket", "node", "n", F.col("p.node").alias("pivot"), F.col("p.n").alias("pivot_n")), "around")
    pairs = around.where((F.col("node") != F.col("pivot")) & _fits(F.col("n"), F.col("pivot_n")))
    tried = keep(_pairs(pairs, "node", "pivot"), "pairs")
    links = keep(_linked(tried, texts, exact), "links")

    def relabelled(rows: DataFrame) -> DataFrame:
        rows = rows.drop("label").join(components(links, scratch), "node", "left").withColumn("label", F.coalesce("label", "node"))
        return keep(_mixed(rows, ["bucket"]), "around")

    left = relabelled(around.select("bucket", "node", "n", (F.col("node") == F.col("pivot")).alias("was")))
    for k in range(ROUNDS):
        # The first pivot comes last, as all were compared with it.
        place = F.struct("was", F.xxhash64("node", F.lit(k)).alias("h"), "node", "n")
        own = W.partitionBy("bucket", "label")
        held = left.withColumns({"size": F.count(F.lit(1)).over(own), "p": F.min(place).over(own)})
        tops = held.withColumn("top", F.max(F.struct("size", "label", "p")).over(bucket))
        tops = tops.select("bucket", "node", "n", "label", F.col("top.label").alias("_label"), F.col("top.p.node").alias("_node"), F.col("top.p.n").alias("_n"))
        pairs = tops.where((F.col("label") != F.col("_label")) & _fits(F.col("n"), F.col("_n")))
        pairs = keep(_pairs(pairs, "node", "_node").join(tried, ["a", "b"], "left_anti"), "pairs")
        found = keep(_linked(pairs, texts, exact), "links")
        tried = tried.union(pairs)
        if not found.head(1):
            break
        links = links.union(found)
        left = relabelled(left)
    more = _open_pairs(left.select("node", "n", "label").distinct(), texts, scratch).join(tried, ["a", "b"], "left_anti")
    one = sketches.select(F.col("node").alias("a"), F.col("buckets").alias("_x"))
    two = sketches.select(F.col("node").alias("b"), F.col("buckets").alias("_y"))
    more = more.join(one, "a").join(two, "b").where(F.arrays_overlap("_x", "_y")).select("a", "b")  # candidates only
    links = links.union(keep(_linked(_with_hubs(keep(more, "pairs")), texts, exact), "links"))
    return links, sketches.select("node", "one", "two")


def near_classes(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """one, two, label: the class of each different text that has a near duplicate; one and two are ``text_key``."""
    links, nodes = _links(docs, scratch)
    return components(links, scratch).join(nodes, "node").select("one", "two", "label")


def _classes(docs: DataFrame) -> DataFrame:
    """``near_classes``, written, without its tables."""
    scratch = Scratch(docs.sparkSession)
    classes = stash(near_classes(docs, scratch), "classes")
    scratch.clear()
    return classes


CLASS = ("alone", "c1", "c2")


def _class_key() -> list[Column]:
    """CLASS: a class is named by its label, or by its text where that is alone."""
    alone = F.col("label").isNull()
    return [alone.alias("alone"), F.coalesce("label", "one").alias("c1"), F.when(alone, F.col("two")).otherwise(0).alias("c2")]


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id: one row for each row of ``docs``.

    ``class_id`` is the least doc_id of the document's class: equal texts and all texts linked to them, directly or
    over others (null only if no member has a doc_id). Texts without words are one class; null is as empty. Repeated
    rows are of one class and each give a row. Columns but doc_id and text aren't read. An empty table gives no rows.
    Very long texts are sketched in blocks of BLOCK values.
    """
    own = docs.select("doc_id", *text_key()).join(_classes(docs), ["one", "two"], "left")
    own = stash(own.select("doc_id", *_class_key()), "classes")
    least = own.groupBy(*CLASS).agg(F.min("doc_id").alias("class_id"))
    return own.join(least, list(CLASS)).select("doc_id", "class_id")


def near_pairs(docs: DataFrame) -> DataFrame:
    """a, b, similarity: links between different texts that make the classes of ``near_duplicates``.

    Each text is named by the least doc_id of its rows (null if none has one), a before b (null first); ``similarity`` is exact.
    The links join all members of a class; which of its other pairs are among them depends on the pivots that a run
    takes. Equal texts are one text here. Odd rows count as in ``near_duplicates``; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    links, nodes = _links(docs, scratch, exact=True)
    named = docs.groupBy(*text_key()).agg(F.min("doc_id").alias("doc_id")).join(nodes, ["one", "two"])
    named = scratch.stash(named.select("node", "doc_id"), "names")
    one, two = (named.select(F.col("node").alias(x), F.col("doc_id").alias(f"id_{x}")) for x in "ab")
    ends = F.sort_array(F.array("id_a", "id_b"))
    found = links.join(one, "a").join(two, "b").select(ends[0].alias("a"), ends[1].alias("b"), "similarity")
    found = stash(found, "pairs")
    scratch.clear()
    return found


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class: the one of least doc_id (null last), then least digest of all columns.

    Null texts are as empty, and all texts without words are one class. Rows equal in all columns count once. Columns
    keep their values, whatever their names; an empty table stays empty.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    tie = F.md5(F.to_json(F.struct(F.lit(0).alias("_"), *others))).alias("tie")
    marked = packed(docs, *text_key(), row_key().alias("key"), tie)
    own = marked.select("one", "two", "key", "tie", F.col("row.doc_id").alias("doc_id")).join(_classes(docs), ["one", "two"], "left")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "tie").alias("place")
    kept = own.select(*_class_key(), place).groupBy(*CLASS).agg(F.min("place").alias("place")).select("place.key", "place.tie")
    return marked.join(kept, ["key", "tie"], "left_semi").dropDuplicates(["key", "tie"]).select("row.*")


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
