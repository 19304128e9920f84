"""Token-id files: each document's ids in a zstandard frame of its own, under one dictionary trained on id arrays.

A store is a folder with two Parquet datasets. ``dictionary``: one row with the dictionary, its kind and SHA-256, and the
width of an id in bytes. ``blocks``: rows in ascending doc_id order, by ``shard`` (a range of doc_ids) and ``block``; each
holds up to BLOCK_BYTES of frames laid end to end (``payload``), the offset index ``ends``, the documents' ``doc_ids``
and ``n_tokens``, ``first_token`` (ids before it in its shard) and ``dictionary_sha256``. One short document is read
by the block's doc_id range, the offset index and the dictionary, without touching its neighbours' frames.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.bpe import codec, vocabulary_path
from tidemark.llm.common import Scratch, documents, new_path, ship

END_ID = 2
BLOCK_BYTES = 1 << 20
#: A task sorts, writes and reads back one shard: SHARD_BYTES at least, as many as there are shuffle partitions, and
#: more where a shard would pass MOST_SHARD_BYTES.
SHARD_BYTES = 8 << 20
MOST_SHARD_BYTES = 256 << 20
SLICE = 1000  # documents compressed at a time
#: The dictionary is fitted to the SAMPLE_ROWS documents of least digest of (doc_id, text), fewer only where there are
#: fewer different ones, of SAMPLE_TOKENS ids each at most. Of a longer text it takes SAMPLE_TOKENS ids that follow each
#: other, from a place that their checksum gives.
SAMPLE_ROWS = 500
SAMPLE_TOKENS = 4096
LEAST_SAMPLES = 8  # fewer can't be trained on; their arrays themselves then are the dictionary
DICTIONARY_BYTES = 64 << 10
LEVEL = 3

BLOCKS = "shard int, block int, first_doc long, last_doc long, first_token long, doc_ids array<long>, n_tokens array<long>, ends array<long>, payload binary, dictionary_sha256 string"


def _width(path: str) -> int:
    return 2 if len(codec(path).bytes_of) <= 1 << 16 else 4


def _serial(text: str | None, path: str, width: int) -> bytes:
    ids = np.frombuffer(codec(path).encode_plain((text or "").encode()), "<u4")
    return np.append(ids, END_ID).astype(f"<u{width}").tobytes()


def sampled(array: bytes, width: int) -> bytes:
    """``array``, or SAMPLE_TOKENS of its ids where it has more."""
    spare = len(array) // width - SAMPLE_TOKENS
    if spare <= 0:
        return array
    start = zlib.crc32(array) % (spare + 1) * width
    return array[start : start + SAMPLE_TOKENS * width]


def train_dictionary(docs: DataFrame, path: str) -> tuple[bytes, str]:
    """A zstandard dictionary of the sample's id arrays, and its kind: trained, raw (of few or tiny arrays: these
    themselves), or none (no rows). The same rows give the same bytes, in any order and partitions."""
    import zstandard

    width = _width(path)
    rows = docs.withColumn("digest", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    least = rows.select("digest").distinct().orderBy("digest").limit(SAMPLE_ROWS).agg(F.max("digest")).head()[0]

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()  # SAMPLE_ROWS at most
        for batch in batches:
            own = batch[~batch["digest"].isin(seen)].drop_duplicates("digest")
            seen.update(own["digest"])
            yield pd.DataFrame({"digest": own["digest"], "ids": [sampled(_serial(t, path, width), width) for t in own["text"]]})

    sample = rows.where(F.col("digest") <= F.lit(least)).select("digest", "text").mapInPandas(apply, "digest long, ids binary")
    sample = sample.groupBy("digest").agg(F.min("ids").alias("ids"))  # copies of a document count once
    arrays = [bytes(r["ids"]) for r in sorted(sample.collect(), key=lambda r: r["digest"])]  # bounded by the parameters
    size = sum(map(len, arrays))
    if not size:
        return b"", "none"
    if len(arrays) >= LEAST_SAMPLES and size >= 100 * 256:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, size // 8), arrays).as_bytes(), "trained"
    return b"".join(arrays)[-DICTIONARY_BYTES:], "raw"


def _dictionary(data: bytes, kind: str):
    import zstandard

    if kind == "none":
        return None
    return zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_FULLDICT if kind == "trained" else zstandard.DICT_TYPE_RAWCONTENT)


def write_store(docs: DataFrame, folder: str, path: str | None = None) -> None:
    """Encode ``docs`` (doc_id, an integer, and text) and write the store to ``folder``.

    Null and empty texts hold the end id alone. Rows of one doc_id stand in the order of their frames' digests; null
    doc_ids come first. A text of any length is one frame, in a block of its own where it passes BLOCK_BYTES. Other
    columns aren't read. An empty table gives a store without blocks.
    """
    spark = docs.sparkSession
    ship(spark)
    path = path or vocabulary_path()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    (dictionary, kind), width = train_dictionary(docs, path), _width(path)
    sha = hashlib.sha256(dictionary).hexdigest()
    spark.range(1).select(F.lit(sha).alias("dictionary_sha256"), F.lit(bytearray(dictionary)).alias("dictionary"), F.lit(kind).alias("kind"), F.lit(width).alias("width")).write.parquet(f"{folder}/dictionary")

    def compress(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary, kind), write_content_size=True)
        for batch in batches:
            for i in range(0, len(batch), SLICE):
                part = batch.iloc[i : i + SLICE]
                arrays = [_serial(t, path, width) for t in part["text"]]
                yield part[["doc_id"]].assign(n_tokens=[len(a) // width for a in arrays], frame=[packer.compress(a) for a in arrays])

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, block, before = TaskContext.get().partitionId(), 0, 0
        rows: list[tuple] = []

        def flush() -> pd.DataFrame:
            nonlocal block, before, rows
            ids, counts, frames = zip(*rows)
            known = [i for i in ids if i is not None]
            out = {"shard": shard, "block": block, "first_doc": min(known, default=None), "last_doc": max(known, default=None), "first_token": before, "doc_ids": list(ids), "n_tokens": list(counts), "ends": np.cumsum([len(f) for f in frames]).tolist(), "payload": b"".join(frames), "dictionary_sha256": sha}
            block, before, rows = block + 1, before + sum(counts), []
            return pd.DataFrame([out])

        size = 0
        for batch in batches:
            for doc, n, frame in zip(batch["doc_id"], batch["n_tokens"], batch["frame"]):
                rows.append((None if pd.isna(doc) else int(doc), int(n), bytes(frame)))
                size += len(frame)
                if size >= BLOCK_BYTES:
                    size = 0
                    yield flush()
        if rows:
            yield flush()

    frames = docs.mapInPandas(compress, "doc_id long, n_tokens long, frame binary").withColumn("_tie", F.xxhash64("frame")).withColumn("_row", F.monotonically_increasing_id())
    scratch = Scratch(spark)
    frames = scratch.stash(frames, "frames")
    total = frames.agg(F.coalesce(F.sum(F.octet_length("frame")), F.lit(0))).head()[0]
    order = ["doc_id", "_tie", "_row"]
    shards = max(1, min(total // SHARD_BYTES, int(spark.conf.get("spark.sql.shuffle.partitions"))), -(-total // MOST_SHARD_BYTES))
    ranged = frames.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    ranged.select("doc_id", "n_tokens", "frame").mapInPandas(pack, BLOCKS).write.parquet(f"{folder}/blocks")
    scratch.clear()


def _unpacked(spark: SparkSession, folder: str, doc_ids: list[int] | None, last: str, finish) -> DataFrame:
    """A row for each document wanted; ``finish`` makes its last column (``last``: name and type) of its ids."""
    ship(spark)
    head = spark.read.parquet(f"{folder}/dictionary").head()
    dictionary, kind, width, sha = bytes(head["dictionary"]), head["kind"], head["width"], head["dictionary_sha256"]
    wanted = None if doc_ids is None else set(doc_ids)

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        reader = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary, kind))
        for batch in batches:
            for b in batch.itertuples(index=False):
                if b.dictionary_sha256 != sha:
                    raise ValueError(f"block {b.shard}/{b.block} was written under another dictionary")
                payload, begin, start, rows = memoryview(b.payload), 0, int(b.first_token), []
                for doc, n, end in zip(b.doc_ids, b.n_tokens, b.ends):
                    if wanted is None or doc in wanted:
                        ids = np.frombuffer(reader.decompress(payload[begin : int(end)]), f"<u{width}").astype("<u4")
                        rows.append((doc, b.shard, start, len(ids), finish(ids.tobytes())))
                    begin, start = int(end), start + int(n)
                out = pd.DataFrame(rows, columns=["doc_id", "shard", "start_in_shard", "n_tokens", last.split()[0]])
                yield out.assign(doc_id=out["doc_id"].astype("Int64"))

    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    if wanted is not None:
        if not wanted:
            blocks = blocks.limit(0)
        else:
            each = F.lit(sorted(wanted))
            blocks = blocks.where((F.col("first_doc") <= max(wanted)) & (F.col("last_doc") >= min(wanted)))
            blocks = blocks.where(F.exists(each, lambda i: (F.col("first_doc") <= i) & (F.col("last_doc") >= i)))
    return blocks.mapInPandas(unpack, f"doc_id long, shard int, start_in_shard long, n_tokens long, {last}")


def read_store(spark: SparkSession, folder: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, shard, start_in_shard, n_tokens, ids (binary, little-endian unsigned 32-bit) of all documents or some.

    With ``doc_ids`` only blocks whose doc_id range holds one are read, and only those documents' frames are unpacked
    (none for an empty list; rows without an id only where all are read).
    """
    return _unpacked(spark, folder, doc_ids, "ids binary", bytes)


def store_index(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, from the files: the ids read back, and starts over all shards.

    A row for each row written, in any number; an empty store gives none.
    """
    own = _unpacked(spark, folder, None, "ids_crc32 long", zlib.crc32)
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    shards = blocks.groupBy("shard").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("tokens"))
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)  # over one row a shard
    shards = shards.select("shard", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    return own.join(shards, "shard").select("doc_id", (F.col("base") + F.col("start_in_shard")).cast("long").alias("start"), "n_tokens", "ids_crc32")


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "tokens")
    write_store(documents(spark, sf_dir), folder)
    return store_index(spark, folder)
