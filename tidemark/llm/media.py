"""Media columns by signature sniffing: an Aho-Corasick automaton finds magic bytes, validators confirm structure and
length, declared types are corrected and embedded media carved out."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import documents, ship

RATE = 8000  # samples a second of stored payloads
BLOCK = 64

# --- Validators: bytes and the place of the signature, to the length of the whole item, or 0 if it isn't one. ---


def _riff(b: bytes, at: int) -> int:
    """RIFF: the declared size must hold whole chunks, each padded to an even length."""
    if at + 12 > len(b):
        return 0
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    p = at + 12
    if end > len(b) or end < p:
        return 0
    while p + 8 <= end:
        size = struct.unpack_from("<I", b, p + 4)[0]
        p += 8 + size + (size & 1)
    return end - at if p in (end, end + 1) else 0


def _png(b: bytes, at: int) -> int:
    """PNG: chunks with right checksums, IHDR first, up to IEND."""
    p, first = at + 8, True
    while p + 12 <= len(b):
        n, kind = struct.unpack_from(">I", b, p)[0], b[p + 4 : p + 8]
        if p + 12 + n > len(b) or first and kind != b"IHDR" or zlib.crc32(b[p + 4 : p + 8 + n]) != struct.unpack_from(">I", b, p + 8 + n)[0]:
            return 0
        p, first = p + 12 + n, False
        if kind == b"IEND":
            return p - at
    return 0


def _gif(b: bytes, at: int) -> int:
    """GIF: screen, then extension and image blocks, up to the trailer."""
    if at + 13 > len(b):
        return 0
    p = at + 13 + (3 << ((b[at + 10] & 7) + 1) if b[at + 10] & 0x80 else 0)

    def blocks(p: int) -> int:
        while p < len(b) and b[p]:
            p += 1 + b[p]
        return p + 1

    while p < len(b):
        if b[p] == 0x3B:
            return p + 1 - at
        if b[p] == 0x21:
            p = blocks(p + 2)
        elif b[p] == 0x2C and p + 10 <= len(b):
            p = blocks(p + 11 + (3 << ((b[p + 9] & 7) + 1) if b[p + 9] & 0x80 else 0))
        else:
            return 0
    return 0


def _jpeg(b: bytes, at: int) -> int:
    """JPEG: marker segments, then scan data, up to the end marker."""
    p = at + 2
    while p + 4 <= len(b) and b[p] == 0xFF:
        kind = b[p + 1]
        if kind == 0xD9:
            return p + 2 - at
        n = struct.unpack_from(">H", b, p + 2)[0]
        if n < 2 or not 0xC0 <= kind <= 0xFE:
            return 0
        p += 2 + n
        if kind == 0xDA:
            m = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]").search(b, p)
            if not m:
                return 0
            p = m.start()
    return p + 2 - at if b[p : p + 2] == b"\xff\xd9" else 0


def _bmp(b: bytes, at: int) -> int:
    """BMP: size, reserved zeros and offsets that agree."""
    if at + 54 > len(b):
        return 0
    size, zero, offset, header = struct.unpack_from("<IIII", b, at + 2)
    return size if not zero and header in (40, 108, 124) and 14 + header <= offset <= size <= len(b) - at else 0


class Content(bytes):
    """Bytes that find a mark's places once, however many signatures ask."""

    def places(self, mark: bytes) -> list[int]:
        found = self.__dict__.setdefault("found", {})
        if mark not in found:
            found[mark] = [m.start() for m in re.finditer(re.escape(mark), self)]
        return found[mark]

    def archives(self) -> dict[int, int]:
        """Start of each ZIP archive whose end record points at its directory, to its end."""
        if "ends" not in self.__dict__:
            self.ends: dict[int, int] = {}
            for p in self.places(b"PK\x05\x06"):
                if p + 22 > len(self):
                    continue
                size, start, note = struct.unpack_from("<IIH", self, p + 12)
                at = p - size - start
                if at >= 0 and self[at + start : at + start + 4] == b"PK\x01\x02" and p + 22 + note <= len(self):
                    self.ends.setdefault(at, p + 22 + note)
        return self.ends


def _pdf(b: Content, at: int) -> int:
    """PDF: a version, a cross-reference pointer and an end mark."""
    ends, pointers = b.places(b"%%EOF"), b.places(b"startxref")
    i, j = bisect_left(ends, at), bisect_left(pointers, at)
    good = i < len(ends) and j < len(pointers) and pointers[j] < ends[i] and b[at + 5 : at + 6].isdigit()
    return ends[i] + 5 - at if good else 0


def _gzip(b: bytes, at: int) -> int:
    """gzip: the stream inflates and its checksum and length agree."""
    stream, p = zlib.decompressobj(31), at
    try:
        while p < len(b) and not stream.eof:
            piece = b[p : p + 65536]
            data = stream.decompress(piece, 1 << 20)
            while stream.unconsumed_tail and not stream.eof:
                data = stream.decompress(stream.unconsumed_tail, 1 << 20)
            p += len(piece)
        del data
        return p - len(stream.unused_data) - at if stream.eof else 0
    except zlib.error:
        return 0


def _zip(b: Content, at: int) -> int:
    """ZIP: a first local header, and an end record whose directory starts and ends where it says."""
    return b.archives().get(at, at) - at


def _ogg(b: bytes, at: int) -> int:
    """Ogg: pages of one stream in sequence, up to the page that ends it."""
    p, serial, n = at, None, 0
    while b[p : p + 5] == b"OggS\x00" and p + 27 <= len(b):
        flags, own, seq, segments = b[p + 5], b[p + 14 : p + 18], struct.unpack_from("<I", b, p + 18)[0], b[p + 26]
        if serial not in (None, own) or seq != n or p + 27 + segments > len(b):
            return 0
        serial, n = own, n + 1
        p += 27 + segments + sum(b[p + 27 : p + 27 + segments])
        if p > len(b):
            return 0
        if flags & 4:
            return p - at
    return 0


def _wav(b: bytes, at: int) -> int:
    return _riff(b, at) if b[at + 8 : at + 12] == b"WAVE" else 0


def _webp(b: bytes, at: int) -> int:
    return _riff(b, at) if b[at + 8 : at + 12] == b"WEBP" else 0


def _avi(b: bytes, at: int) -> int:
    return _riff(b, at) if b[at + 8 : at + 12] == b"AVI " else 0


#: Signature (fixed values), media type, validator.
FORMATS = [
    (b"RIFF", "audio/wav", _wav),
    (b"RIFF", "image/webp", _webp),
    (b"RIFF", "video/avi", _avi),
    (b"\x89PNG\r\n\x1a\n", "image/png", _png),
    (b"GIF87a", "image/gif", _gif),
    (b"GIF89a", "image/gif", _gif),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg),
    (b"BM", "image/bmp", _bmp),
    (b"%PDF-", "application/pdf", _pdf),
    (b"\x1f\x8b\x08", "application/gzip", _gzip),
    (b"PK\x03\x04", "application/zip", _zip),
    (b"OggS", "audio/ogg", _ogg),
]

_automaton = None


def automaton():
    global _automaton
    if _automaton is None:
        import ahocorasick

        found = ahocorasick.Automaton()
        by: dict[str, list] = {}
        for magic, kind, check in FORMATS:
            by.setdefault(magic.decode("latin-1"), []).append((len(magic), kind, check))
        for magic, formats in by.items():
            found.add_word(magic, formats)
        found.make_automaton()
        _automaton = found
    return _automaton


def sniff(content: bytes | None) -> tuple[str | None, int, list[tuple[str, int, int]]]:
    """(type of the whole content or null, its length, embedded items as (type, offset, length)).

    The content is of a type if an item of it starts at 0; trailing bytes are allowed. Items inside an item that was
    found are embedded ones too; of items at one place the first format in FORMATS counts.
    """
    content = Content(content or b"")
    whole, length, inside = None, 0, []
    for end, formats in automaton().iter(content.decode("latin-1")):
        for n, kind, check in formats:
            at = end + 1 - n
            if size := check(content, at):
                if at == 0:
                    whole, length = kind, size
                else:
                    inside.append((kind, at, size))
                break
    return whole, length, inside


SNIFFED = "media_type string, media_length long, declared_right boolean, embedded array<struct<media_type:string, offset:long, length:long, content:binary>>"


def sniff_media(items: DataFrame, content: str = "content", declared: str | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """The columns ``carry``, with the sniffed type (the declared one where no signature holds), its length, whether
    the declaration was right (null without one) and the embedded items with their bytes.

    Null and empty contents have no type and nothing embedded. Rows are judged alone, repeated ones too, contents of any
    length whole; an empty table gives no rows. Carried columns keep their values, whatever their names.
    """
    ship(items.sparkSession)
    held = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)]
    said = F.col(f"`{declared}`") if declared else F.lit(None)

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for x, said in zip(batch.pop("content"), batch.pop("said")):
                raw = bytes(x) if x is not None else b""
                kind, length, inside = sniff(raw)
                said = None if pd.isna(said) else said
                right = None if said is None else bool(kind == said) if kind else None
                rows.append((kind or said, length, right, [{"media_type": k, "offset": a, "length": n, "content": raw[a : a + n]} for k, a, n in inside]))
            out = pd.DataFrame(rows, columns=["media_type", "media_length", "declared_right", "embedded"], index=batch.index)
            yield pd.concat([batch, out], axis=1)

    kinds = ", ".join([*(f"c{i} {items.schema[c].dataType.simpleString()}" for i, c in enumerate(carry)), SNIFFED])
    out = items.select(*held, F.col(f"`{content}`").alias("content"), said.cast("string").alias("said")).mapInPandas(apply, kinds)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], *out.columns[len(carry) :])


def to_wav(payload: bytes) -> bytes:
    """The payload as 8-bit mono samples in a WAV container."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload


def from_wav(media: bytes) -> bytes:
    """The samples of a WAV container, by its chunks."""
    p = 12
    while media[p : p + 4] != b"data":
        p += 8 + struct.unpack_from("<I", media, p + 4)[0]
    return media[p + 8 : p + 8 + struct.unpack_from("<I", media, p + 4)[0]]


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media, declared: each text as UTF-8, with zeros up to a positive multiple of 64, as a WAV file.

    Null texts are empty: 64 zeros. The type is declared as plain bytes, as pipelines that don't look do. Repeated rows
    give repeated rows, texts of any length are stored whole, other columns aren't read; an empty table gives no rows.
    """
    ship(docs.sparkSession)

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raw = [(t or "").encode() for t in batch["text"]]
            media = [to_wav(r + bytes(-len(r) % BLOCK if r else BLOCK)) for r in raw]
            yield batch[["doc_id"]].assign(n_bytes=[len(r) for r in raw], media=media, declared="application/octet-stream")

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(apply, f"doc_id {kind}, n_bytes long, media binary, declared string")


def media_features(stored: DataFrame) -> DataFrame:
    """Sniffs the stored media, reads the payload back by its confirmed structure, sniffs that too, and computes features.

    A row for each row of ``stored``; media that isn't a whole WAV file is an error, null media too. The feature names
    the type of the container and of what it holds, and every item inside. An empty table gives no rows.
    """
    ship(stored.sparkSession)

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for x, said in zip(batch["media"], batch["declared"]):
                media = bytes(x)
                kind, length, inside = sniff(media)
                if kind != "audio/wav" or length != len(media):
                    raise ValueError(f"stored media is {kind} of {length} bytes, not a WAV file of {len(media)}")
                payload = from_wav(media)
                held = sniff(payload)[0] or "no known media"
                carved = ",".join(f"{k}@{a}+{n}" for k, a, n in inside) or "none"
                feature = f"{kind}; declared {'right' if kind == said else 'wrong'}; holds {held}; {len(payload)} samples; mean {int(np.frombuffer(payload, np.uint8).sum(dtype=np.int64)) / len(payload):.6f}; zeros {payload.count(0)}; embedded {carved}"
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            out = pd.DataFrame(rows, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"], index=batch.index)
            yield pd.concat([batch[["doc_id", "n_bytes"]], out], axis=1)

    kind = stored.schema["doc_id"].dataType.simpleString()
    return stored.mapInPandas(apply, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op5_media_sniffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(store_texts(documents(spark, sf_dir)))
