"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the bytes cuts every text into chunks at places that depend on the bytes alone, so a passage that
many documents share gives the same chunks in each. A chunk is encoded once and its ids are reused. A cut may fall
inside a word: of each chunk only the part between its first and its last safe boundary is encoded with it, and the
join is repaired by re-encoding what lies between the safe boundaries on either side, over further chunks where one
has none. The ids then agree exactly with those of the whole text.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import documents, ship

CHUNK_BITS = 11  # a chunk has about 2**CHUNK_BITS bytes
LEAST_CHUNK = 256
CACHE_BYTES = 48 << 20  # of chunks, in each task

#: A safe boundary: a single space after and before characters that are surely no white space. The vocabulary's split
#: pattern always cuts here, and nothing before the space changes the ids of what follows.
SAFE = re.compile(rb"(?:(?<=[\x21-\x7e])|(?<=[\xc3-\xdf][\x80-\xbf])) (?=[\x21-\x7e\xc3-\xdf])")
#: The split pattern of byte-level vocabularies of this kind (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Beyond these characters the two libraries' tables of letters might differ, so the slower one decides.
LATIN = re.compile("[\x00-ɏ‐-‧€]*")

_GEAR = np.random.default_rng(7).integers(0, 1 << 32, 256, dtype=np.uint32)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cuts(raw: bytes, bits: int = CHUNK_BITS, least: int = LEAST_CHUNK) -> list[int]:
    """Ends of chunks: places where a rolling hash of the last 32 bytes has its low bits 0, never inside a character."""
    data = np.frombuffer(raw, np.uint8)
    h = _GEAR[data]
    for shift in (1, 2, 4, 8, 16):  # h[i] = sum of gear[data[i - j]] << j for j < 32
        h[shift:] = h[shift:] + (h[:-shift] << np.uint32(shift))
    ends, last = [], 0
    for at in np.flatnonzero((h >> np.uint32(32 - bits)) == 0).tolist():
        at += 1
        while at < len(raw) and raw[at] & 0xC0 == 0x80:
            at += 1
        if at - last >= least:
            ends.append(at)
            last = at
    if last < len(raw):
        ends.append(len(raw))
    return ends


def refuse_other_kinds(file: dict, path: str) -> None:
    """Raise unless the vocabulary splits by PATTERN alone: byte-level BPE that changes no text before it."""
    split, model = file.get("pre_tokenizer") or {}, file.get("model") or {}
    plain = file.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges") if model.get(k)]
    stripped = [t["content"] for t in file.get("added_tokens", []) if t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized")]
    if not plain or model.get("type") != "BPE" or odd or stripped:
        raise ValueError(f"{path}: only byte-level BPE with the usual split, no normaliser and plain added tokens is encoded here")


class Codec:
    """Encodes and decodes as the tokenizers library does, one text at a time; memory is bounded by the parameters."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            refuse_other_kinds(json.load(f), path)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.specials = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.bytes_of = self._table()
        self.fast = self._fast()
        self.young: dict[bytes, tuple[bytes, bytes, bytes]] = {}
        self.old: dict[bytes, tuple[bytes, bytes, bytes]] = {}
        self.young_bytes = 0
        self.reused = self.encoded = 0

    def _table(self) -> list[bytes]:
        """Bytes of each id. Byte-level vocabularies write byte b as chr(b), or as chr(256 + its rank) where b isn't printable."""
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(printable)]
        byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
        added = {i: t.content.encode() for i, t in self.library.get_added_tokens_decoder().items()}
        table = [b""] * self.library.get_vocab_size()
        for token, i in self.library.get_vocab().items():
            table[i] = added[i] if i in added else bytes(byte[c] for c in token)
        return table

    def _fast(self):
        """The same merges in the faster library: ids are ranks. It takes plain text."""
        import tiktoken

        added = self.library.get_added_tokens_decoder()
        return tiktoken.Encoding("same", pat_str=PATTERN, mergeable_ranks={b: i for i, b in enumerate(self.bytes_of) if i not in added}, special_tokens={})

    def encode_plain(self, raw: bytes) -> bytes:
        """Ids of a text's UTF-8 bytes, or of a part between safe boundaries, without reuse."""
        text = raw.decode()
        if any(s in raw for s in self.specials) or not (text.isascii() or LATIN.fullmatch(text)):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()

    def _chunk(self, raw: bytes) -> tuple[bytes, bytes, bytes] | None:
        """(before the first safe boundary, ids up to the last, after it), None without two boundaries."""
        found = self.young.get(raw)
        if found is None and (found := self.old.get(raw)) is None:
            first = SAFE.search(raw)
            last = raw.rfind(b" ")
            while last > 0 and SAFE.match(raw, last) is None:
                last = raw.rfind(b" ", 0, last)
            if first is None or last <= first.start():
                return None
            self.encoded += 1
            found = raw[: first.start()], self.encode_plain(raw[first.start() : last]), raw[last:]
            if self.young_bytes > CACHE_BYTES // 2:
                self.old, self.young, self.young_bytes = self.young, {}, 0
            self.young[raw] = found
            self.young_bytes += 2 * len(raw) + len(found[1]) + 400
        else:
            self.reused += 1
        return found

    def encode(self, text: str | None) -> bytes:
        """Ids of the text as little-endian unsigned 32-bit integers."""
        raw = (text or "").encode()
        if not raw:
            return b""
        parts, open_join, start = [], b"", 0
        for end in cuts(raw):
            chunk = self._chunk(raw[start:end])
            if chunk is None:  # no safe boundary: the join goes on
                open_join += raw[start:end]
            else:
                head, ids, tail = chunk
                open_join += head
                if open_join:
                    parts.append(self.encode_plain(open_join))
                parts.append(ids)
                open_join = tail
            start = end
        if open_join:
            parts.append(self.encode_plain(open_join))
        return b"".join(parts)

    def decode(self, ids: bytes) -> str:
        raw = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return self.library.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One a Python worker and vocabulary."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, path: str | None = None, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``carry`` of ``docs``, with n_tokens and ids (binary, little-endian unsigned 32-bit).

    Null and empty texts give no ids. Rows are encoded alone, so repeated rows repeat; chunks are reused within a
    task, in a bounded cache. A column of ``docs`` named like a result is replaced; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    path = path or vocabulary_path()
    carry = [c for c in carry if c not in ("n_tokens", "ids")]

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(path)
        for batch in batches:
            ids = [own.encode(t) for t in batch.pop("text")]
            yield batch.assign(n_tokens=[len(x) // 4 for x in ids], ids=ids)

    return _carried(docs, carry, F.col("text").alias("text"), apply, "n_tokens long, ids binary")


def _carried(rows: DataFrame, carry: list[str], own: Column, apply, made: str) -> DataFrame:
    """``apply`` over ``own`` beside the columns ``carry`` under numbers, and those columns again before what is made."""
    held = [f"c{i}" for i in range(len(carry))]
    kinds = [f"{h} {rows.schema[c].dataType.simpleString()}" for h, c in zip(held, carry)]
    out = rows.select(*[F.col(f"`{c}`").alias(h) for h, c in zip(held, carry)], own).mapInPandas(apply, ", ".join([*kinds, made]))
    return out.select(*[F.col(h).alias(c) for h, c in zip(held, carry)], *out.columns[len(held) :])


def decode(encoded: DataFrame, path: str | None = None, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``carry``, with the text that the ids stand for; null ids give the empty text. A column named text is
    replaced; repeated rows repeat; an empty table gives no rows."""
    ship(encoded.sparkSession)
    path = path or vocabulary_path()

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(path)
        for batch in batches:
            yield batch.assign(text=[own.decode(bytes(x or b"")) for x in batch.pop("ids")])

    return _carried(encoded, [c for c in carry if c != "text"], F.col("ids").alias("ids"), apply, "text string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text encoded, and decoded from those ids in the same task.

    Null texts are as empty; a row for each row, whatever its length; other columns aren't read; an empty table gives
    no rows.
    """
    ship(docs.sparkSession)
    path = path or vocabulary_path()

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(path)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                ids = own.encode(text)
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(own.decode(ids).encode()).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"], index=batch.index)
            yield pd.concat([batch[["doc_id"]], out], axis=1)

    kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInPandas(apply, kinds)


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir))
