"""Line dedup: winnowing over line hashes, positions joined, matches extended both ways, later repeated runs deleted.

A line here is a line of the text, cut after sentence ends too, so that a passage is found wherever its sentences stand
in longer lines. A run of consecutive lines that holds at least MIN_WORDS words and stands at an earlier place too,
without overlapping it, is deleted.

Windows are the shortest runs of MIN_WORDS words from a line on, and those up to a line. The least line hash of each,
with that of the line beside it in the window, is its fingerprint. Equal windows have equal least hashes at the same
place, so every repeated run shares a fingerprint with its earlier place. First the fingerprints alone meet; only windows whose fingerprint stands at several positions go on. Each meets
the earliest place of its own content, and there the lines are compared, from the window outwards on both sides, as far
as they agree. Windows reach from both ends, so a run is found whole even where its parts first stand in other texts.
A text whose lines all equal those of an earlier one, in order, is one match at once and brings no windows of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, documents, packed, row_key, ship, stash

MIN_WORDS = 50
#: A line ends after these marks, where a space follows.
MARKS = ".!?…。！？।؟۔։"

_MARKS = [m.encode() for m in MARKS]
_ASCII_MARKS = [m for m in _MARKS if m.isascii()]
_CUT = b"\x01"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def _with_cuts(raw: bytes) -> bytes:
    """``raw``, byte for byte as long, with _CUT for the spaces after sentence ends."""
    for mark in _ASCII_MARKS if raw.isascii() else _MARKS:
        raw = raw.replace(mark + b" ", mark + _CUT)
    return raw


def line_hashes(text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Hash (uint64) and number of words of each line that has words, in order, and the number of all lines (null: 0).

    A line's content is its words.
    """
    import xxhash

    lines = _with_cuts((text or "").encode()).replace(b"\n", _CUT).split(_CUT)
    own = [w for w in map(bytes.split, lines) if w]
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(b" ".join(w)) for w in own), np.uint64, len(own))
    return hashes, np.fromiter(map(len, own), np.int64, len(own)), 0 if text is None else len(lines)


def windows(hashes: list[np.ndarray], words: list[np.ndarray], min_words: int) -> dict[str, np.ndarray]:
    """The windows of some texts at once: of, first, last (text, and lines in it), mark, at (fingerprint, its line), one, two.

    The two digests tell windows apart by 128 bits.
    """
    lengths = np.array([len(x) for x in hashes], np.int64)
    ends = np.cumsum(lengths)
    h = np.concatenate([*hashes, np.empty(0, np.uint64)])
    of = np.repeat(np.arange(len(lengths)), lengths)
    begin, end = (ends - lengths)[of], ends[of]
    upto = np.concatenate([[0], np.cumsum(np.concatenate([*words, np.empty(0, np.int64)]))])
    at = np.arange(len(h))
    right = np.searchsorted(upto, upto[:-1] + min_words, "left") - 1
    left = np.searchsorted(upto, upto[1:] - min_words, "right") - 1
    pairs = np.unique(np.concatenate([(at << 32 | right)[right < end], (left << 32 | at)[left >= begin]]))
    a, b = pairs >> 32, pairs & 0xFFFFFFFF
    low, low_at, one, two = h[a].copy(), a.copy(), _mix(h[a]), _mix(h[a] + _MIX)
    on = np.arange(len(a))
    for step in range(1, int((b - a).max(initial=0)) + 1):
        on = on[a[on] + step <= b[on]]
        x = h[a[on] + step]
        less = x <= low[on]
        low[on[less]], low_at[on[less]] = x[less], a[on[less]] + step
        one[on] = _mix(one[on] * np.uint64(3) + x)
        two[on] = _mix(two[on] * np.uint64(5) + x + _MIX)
    near = h[np.where(low_at < b, low_at + 1, np.maximum(a, low_at - 1))]
    mark = _mix(low * np.where(low_at < b, np.uint64(3), np.uint64(5)) + near)
    base = begin[a] if len(a) else a
    return {"of": of[a], "first": a - base, "last": b - base, "mark": mark.view(np.int64), "at": low_at - base, "one": one.view(np.int64), "two": two.view(np.int64)}


LINES = "row binary, doc long, n_lines long, whole binary, n int, hashes array<long>, words array<int>, marks array<long>, places array<int>"
#: Texts worked on at once, beside each other.
SLICE = 500


def _slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for i in range(0, len(batch), SLICE):
            yield batch.iloc[i : i + SLICE]


def _line_rows(docs: DataFrame, min_words: int) -> DataFrame:
    """LINES of each text: its lines with their digest and number, its fingerprints and at how many positions each
    stands; hashes, words and the digest only where it has a window."""
    import xxhash

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _slices(batches):
            found = [line_hashes(text) for text in batch["text"]]
            w = windows([x[0] for x in found], [x[1] for x in found], min_words)
            chosen = pd.DataFrame({k: w[k] for k in ("of", "mark", "at")}).drop_duplicates()
            chosen = chosen.groupby(["of", "mark"], sort=True).size()
            of, marks, places = (np.asarray(x, np.int64) for x in (chosen.index.get_level_values(0), chosen.index.get_level_values(1), chosen))
            ends = np.searchsorted(of, np.arange(len(batch) + 1))
            out = batch[["row"]].assign(doc=batch["doc"].astype("Int64"), n_lines=[x[2] for x in found])
            some = ends[1:] > ends[:-1]
            out["whole"] = [xxhash.xxh3_128_digest(x[0].tobytes()) if s else None for x, s in zip(found, some)]
            out["n"] = [len(x[0]) for x in found]
            out["hashes"] = [x[0].view(np.int64) if s else [] for x, s in zip(found, some)]
            out["words"] = [x[1] if s else [] for x, s in zip(found, some)]
            out["marks"] = [marks[a:b] for a, b in zip(ends, ends[1:])]
            out["places"] = [places[a:b] for a, b in zip(ends, ends[1:])]
            yield out

    return docs.mapInPandas(apply, LINES)


def _window_rows(lines: DataFrame, min_words: int) -> DataFrame:
    """The windows whose fingerprint is in ``again``."""

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _slices(batches):
            hashes = [np.asarray(x, np.int64).view(np.uint64) for x in batch["hashes"]]
            w = pd.DataFrame(windows(hashes, [np.asarray(x, np.int64) for x in batch["words"]], min_words))
            again = pd.DataFrame({"of": np.repeat(np.arange(len(batch)), batch["again"].map(len)), "mark": np.concatenate(batch["again"].tolist())})
            w = w.merge(again.astype(np.int64), on=["of", "mark"])
            of = w.pop("of").to_numpy()
            w.insert(0, "doc", batch["doc"].astype("Int64").array[of])
            w.insert(0, "row", batch["row"].to_numpy()[of])
            yield w[["row", "doc", "first", "last", "one", "two"]]

    return lines.mapInPandas(apply, "row binary, doc long, first int, last int, one long, two long")


def extend(mine: np.ndarray, source: np.ndarray | None, seeds: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Runs (first, last) of lines of ``mine`` that agree with ``source`` (None: with an earlier run of ``mine``).

    ``seeds`` are windows (first, last, first in the source). Lines are compared over the whole window, then outwards to
    both sides while they agree and no run holds them yet. Inside one text the window alone counts, as more would
    overlap its source.
    """
    mine = mine.tolist()
    other = mine if source is None else source.tolist()
    covered = bytearray(len(mine))
    reached: dict[int, tuple[int, int]] = {}  # by place in the text less that in the source: where it was compared
    for first, last, start in sorted(seeds):
        low, high = reached.get(first - start, (0, -1))
        if low <= first and last <= high:
            continue
        stop = start + last - first + 1
        if stop > len(other) or mine[first : last + 1] != other[start:stop]:
            continue
        covered[first : last + 1] = b"\1" * (last + 1 - first)
        low, high = first, last
        if source is not None:
            shift = start - first
            while low > 0 and low + shift > 0 and not covered[low - 1] and mine[low - 1] == other[low - 1 + shift]:
                low -= 1
                covered[low] = 1
            while high + 1 < len(mine) and high + 1 + shift < len(other) and not covered[high + 1] and mine[high + 1] == other[high + 1 + shift]:
                high += 1
                covered[high] = 1
        reached[first - start] = (low, high)
    edges = np.flatnonzero(np.diff(np.frombuffer(b"\0" + covered + b"\0", np.int8)))
    return list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist()))


def _extended(seeds: DataFrame) -> DataFrame:
    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _slices(batches):
            rows = []
            for x in batch.itertuples(index=False):
                own = list(zip(x.first.tolist(), x.last.tolist(), x.start.tolist()))
                rows += [(x.row, *run) for run in extend(np.asarray(x.mine), None if x.source is None else np.asarray(x.source), own)]
            yield pd.DataFrame(rows, columns=["row", "first", "last"])

    return seeds.mapInPandas(apply, "row binary, first int, last int")


def repeated_runs(docs: DataFrame, scratch: Scratch, min_words: int = MIN_WORDS) -> DataFrame:
    """row (digest of doc_id and text), n_lines, and runs: the sorted runs (first, last) of lines to delete, or null.

    Runs don't count lines without words. Places are ordered by doc_id (null first), row digest and line. Rows that
    agree in doc_id and text are one document.
    """
    ship(docs.sparkSession)
    own = docs.select(F.unhex(row_key()).alias("row"), F.col("doc_id").cast("long").alias("doc"), "text")
    once = _line_rows(own, min_words).groupBy("row").agg(*[F.first(c).alias(c) for c in ("doc", "n_lines", "whole", "n", "hashes", "words", "marks", "places")])
    lines = scratch.stash(once, "lines")
    own = lines.select("whole", "row", "doc", "n").where("whole IS NOT NULL")
    firsts = own.groupBy("whole").agg(F.min(F.struct("doc", "row")).alias("s"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("whole", "s")
    copies = scratch.stash(own.join(firsts, "whole").where(F.col("row") != F.col("s.row")).select("row", F.lit(0).alias("first"), (F.col("n") - 1).alias("last")), "copies")
    prints = lines.select("row", F.explode(F.arrays_zip("marks", "places")).alias("p")).select("row", F.col("p.marks").alias("mark"), F.col("p.places").alias("places"))
    again = prints.groupBy("mark").agg(F.sum("places").alias("places")).where("places > 1").select("mark")
    again = prints.join(again, "mark").groupBy("row").agg(F.collect_list("mark").alias("again"))
    again = again.join(copies.select("row"), "row", "left_anti")
    found = scratch.stash(_window_rows(lines.select("row", "doc", "hashes", "words").join(again, "row"), min_words), "windows")
    sources = found.groupBy("one", "two").agg(F.min(F.struct("doc", "row", "first", "last")).alias("s"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = found.join(sources, ["one", "two"]).where((F.col("row") != F.col("s.row")) | (F.col("s.last") < F.col("first")))
    seeds = later.groupBy("row", F.col("s.row").alias("from")).agg(F.collect_list(F.struct("first", "last", F.col("s.first").alias("start"))).alias("s"))
    seeds = seeds.select("row", "from", *[F.col(f"s.{c}").alias(c) for c in ("first", "last", "start")])
    seeds = seeds.join(lines.select("row", F.col("hashes").alias("mine")), "row").join(lines.select(F.col("row").alias("from"), F.col("hashes").alias("source")), "from")
    runs = _extended(seeds.withColumn("source", F.when(F.col("row") != F.col("from"), F.col("source"))))
    runs = runs.union(copies).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs"))
    return lines.select("row", "n_lines").join(runs, "row", "left")


def without_runs(text: str, runs: list) -> tuple[str, int]:
    """``text`` without the lines of ``runs``, and how many those are.

    A line of the text that loses all its words goes; what is left of another is joined by single spaces. Lines without
    words stay.
    """
    raw = text.encode()
    n = len(runs) and max(r["last"] for r in runs) + 1
    gone = np.zeros(n + 1, bool)
    for r in runs:
        gone[r["first"] : r["last"] + 1] = True
    kept, k, start = [], 0, 0
    for line in _with_cuts(raw).split(b"\n"):
        left, lost, place = [], 0, start
        for part in line.split(_CUT):
            worded = bool(part.split())
            if worded and k < n and gone[k]:
                lost += 1
            else:
                left.append((worded, raw[place : place + len(part)]))
            k += worded
            place += len(part) + 1
        if not lost:
            kept.append(raw[start : start + len(line)])
        elif any(worded for worded, _ in left):
            kept.append(b" ".join(part for _, part in left))
        start += len(line) + 1
    return b"\n".join(kept).decode(), int(gone.sum())


def _shortened(docs: DataFrame, min_words: int) -> DataFrame:
    """row (the row of ``docs``), text, n_lines, deleted_lines."""
    scratch = Scratch(docs.sparkSession)
    runs = stash(repeated_runs(docs, scratch, min_words), "runs")
    scratch.clear()

    @F.pandas_udf("text string, gone long")
    def cut(text: pd.Series, own: pd.Series) -> pd.DataFrame:
        rows = [(None, None) if t is None or r is None else without_runs(t, r) for t, r in zip(text, own)]
        return pd.DataFrame(rows, columns=["text", "gone"]).astype({"gone": "Int64"})

    joined = packed(docs, F.unhex(row_key()).alias("key")).join(runs.withColumnRenamed("row", "key"), "key")
    text = F.col("row.text")
    joined = joined.withColumn("cut", cut(F.when(F.col("runs").isNotNull(), text), F.col("runs")))
    return joined.select("row", F.coalesce("cut.text", text).alias("text"), "n_lines", F.coalesce("cut.gone", F.lit(0)).cast("long").alias("deleted_lines"))


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with ``text`` without the deleted lines, n_lines (lines of the text, as they were, each sentence end
    ending one) and deleted_lines; columns named so are replaced.

    Null texts stay null with 0 lines; lines without words stay; of two equal places in the order of doc_id (null
    first), digest and line the first stays; repeated rows get equal results; a text of any length takes time in
    proportion to its lines; an empty table gives no rows.
    """
    figures = ("n_lines", "deleted_lines")
    columns = [F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns if c not in figures]
    return _shortened(docs, min_words).select(*columns, *figures)


def deduped(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without the deleted lines, in its own columns; ``n_chars`` follows the text. Else as ``line_dedup``."""
    own = {c: F.col(f"row.`{c}`") for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in own:
        own["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return _shortened(docs, min_words).select(*[c.alias(name) for name, c in own.items()])


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(documents(spark, sf_dir)).select("doc_id", "n_lines", "deleted_lines", "text")


#: By another way: all pairs of equal lines, the diagonals on which they follow each other, and the words on these.
OP3_SQL = rf"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
c AS (SELECT doc_id, pos, string_split(regexp_replace(line, '([{MARKS}]) ', '\1' || chr(1), 'g'), chr(1)) AS parts FROM l),
p AS (SELECT doc_id, pos, unnest(parts) AS part, unnest(range(len(parts))) AS i FROM c),
n AS (SELECT doc_id, pos, i, part, len(regexp_extract_all(part, '[^\x20\x09-\x0D]+')) AS words, array_to_string(regexp_extract_all(part, '[^\x20\x09-\x0D]+'), ' ') AS content FROM p),
w AS (SELECT *, row_number() OVER v AS k, sum(words) OVER v AS upto FROM n WHERE words > 0 WINDOW v AS (PARTITION BY doc_id ORDER BY pos, i)),
d AS (SELECT a.doc_id, b.doc_id AS src, a.k, a.k - b.k AS diagonal, a.words FROM w a JOIN w b ON a.content = b.content AND (b.doc_id < a.doc_id OR (b.doc_id = a.doc_id AND b.k < a.k))),
g AS (SELECT *, k - row_number() OVER (PARTITION BY doc_id, src, diagonal ORDER BY k) AS island FROM d),
r AS (SELECT doc_id, src, diagonal, min(k) AS a, max(k) AS z FROM g GROUP BY doc_id, src, diagonal, island HAVING sum(words) >= {MIN_WORDS}),
o AS (SELECT doc_id, a, z FROM r WHERE src <> doc_id
  UNION SELECT doc_id, k, least(z, k + diagonal - 1) FROM (SELECT *, unnest(range(a, z + 1)) AS k FROM r WHERE src = doc_id)),
long AS (SELECT o.doc_id, o.a, o.z FROM o JOIN w x ON x.doc_id = o.doc_id AND x.k = o.a JOIN w y ON y.doc_id = o.doc_id AND y.k = o.z WHERE y.upto - x.upto + x.words >= {MIN_WORDS}),
gone AS (SELECT DISTINCT w.doc_id, w.pos, w.i FROM long JOIN w ON w.doc_id = long.doc_id AND w.k BETWEEN long.a AND long.z),
m AS (SELECT n.*, gone.i IS NOT NULL AS gone FROM n LEFT JOIN gone ON gone.doc_id = n.doc_id AND gone.pos = n.pos AND gone.i = n.i),
by_line AS (SELECT doc_id, pos, count(*) AS n, count(*) FILTER (gone) AS lost, count(*) FILTER (words > 0 AND NOT gone) AS worded, coalesce(string_agg(part, ' ' ORDER BY i) FILTER (NOT gone), '') AS line FROM m GROUP BY doc_id, pos)
SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_lines, CAST(sum(lost) AS BIGINT) AS deleted_lines, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (lost = 0 OR worded > 0), '') AS text
FROM by_line GROUP BY doc_id
"""
