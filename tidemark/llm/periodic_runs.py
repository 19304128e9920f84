"""Periodic runs: stretches of words that repeat with one period, found by block convolution at dyadic scales.

At scale b (a power of two) a text is cut into blocks of b words. A number-theoretic transform, exact in integers, gives
for each block and each distance d of b to 2b - 1 the sum of the squared differences between the block and the words d
further on, all distances of a block at once. The sum is 0 exactly where the block recurs. A run of period d and length
4 d or more holds two blocks side by side that recur at distance d, so chains of such blocks are the seeds; a chain is
then extended by less than a block on either side, word by word.

The sums are taken modulo as many primes as make their product larger than any sum, so 0 is no accident. Before that,
words that occur less than four times are cut out, again and again in what is left: no run can hold them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, documents, ship

#: A run has LEAST_POWER periods and LEAST_WORDS words at least.
LEAST_POWER = 4
LEAST_WORDS = 6
#: Primes 1 + k 2^m with m of 25 or more, and a generator of each.
PRIMES = ((2013265921, 31), (469762049, 3), (167772161, 3))
#: Words and transformed numbers that a task holds at once, but for a longer text.
SLICE_WORDS = 1 << 17
SLICE_NUMBERS = 1 << 17

RUN = "struct<start:long,length:long,period:long>"


@lru_cache(maxsize=128)
def _twiddles(prime: int, generator: int, size: int, inverse: bool) -> np.ndarray:
    """Powers 0 to size / 2 - 1 of a root of unity of order ``size``, by doubling."""
    root = pow(generator, (prime - 1) // size, prime)
    root = pow(root, -1, prime) if inverse else root
    out = np.ones(1, np.uint64)
    while len(out) < size // 2:
        out = np.concatenate([out, out * np.uint64(pow(root, len(out), prime)) % np.uint64(prime)])
    return out


@lru_cache(maxsize=64)
def _negated(size: int) -> np.ndarray:
    """Where frequency -k stands, for each k, both in bit-reversed order."""
    order = np.zeros(1, np.int64)
    while len(order) < size:
        order = np.concatenate([2 * order, 2 * order + 1])
    place = np.empty(size, np.int64)
    place[order] = np.arange(size)
    return place[-order % size]


def _added(x: np.ndarray, y: np.ndarray, prime: np.uint64) -> np.ndarray:
    out = x + y
    return np.minimum(out, out - prime)  # an unsigned difference below 0 is huge


def _transform(rows: np.ndarray, prime: int, generator: int) -> np.ndarray:
    """Transforms of the rows, each followed by as many zeros, in bit-reversed order."""
    p, width = np.uint64(prime), rows.shape[1]
    out = np.stack([rows, rows * _twiddles(prime, generator, 2 * width, False) % p], axis=1)
    while width > 1:
        parts = out.reshape(len(rows), -1, 2, width // 2)
        x, y = parts[:, :, 0], parts[:, :, 1]
        low, high = _added(x, y, p), (x + (p - y)) * _twiddles(prime, generator, width, False) % p
        out, width = np.stack([low, high], axis=2), width // 2
    return out.reshape(len(rows), -1)


def _back(rows: np.ndarray, prime: int, generator: int) -> np.ndarray:
    """First halves of what ``rows`` are the transforms of."""
    p, size, width = np.uint64(prime), rows.shape[1], 1
    while 2 * width < size:
        parts = rows.reshape(len(rows), -1, 2, width)
        x, y = parts[:, :, 0], parts[:, :, 1] * _twiddles(prime, generator, 2 * width, True) % p
        rows, width = np.stack([_added(x, y, p), _added(x, p - y, p)], axis=2), 2 * width
    parts = rows.reshape(len(rows), 2, width)
    out = parts[:, 0] + parts[:, 1] * _twiddles(prime, generator, size, True) % p
    return out % p * np.uint64(pow(size, -1, prime)) % p


def recurrences(blocks: np.ndarray, largest: int) -> np.ndarray:
    """Whether row i's words stand again at distance b + d (column d) of row i's start, for all rows but the last two.

    ``blocks`` has b words a row, numbers up to ``largest``; the rows follow each other.
    """
    n, b = len(blocks) - 2, blocks.shape[1]
    found, product = np.ones((n, b), bool), 1
    for prime, generator in PRIMES:
        p = np.uint64(prime)
        x = blocks % p
        f = _transform(x, prime, generator)
        half = f.shape[1] // 2
        window = np.empty((n, 2 * half), np.uint64)  # of two rows: even frequencies come first
        window[:, :half] = f[1:-1, :half] + f[2:, :half]
        window[:, half:] = f[1:-1, half:] + (p - f[2:, half:])
        both = _back(f[:n, _negated(2 * half)] * (window % p) % p, prime, generator)
        squares = x * x % p
        own = squares[:n].sum(axis=1, dtype=np.uint64)[:, None]
        sums = np.zeros((n, 2 * b + 1), np.uint64)
        np.cumsum(np.concatenate([squares[1:-1], squares[2:]], axis=1), axis=1, out=sums[:, 1:])
        found &= (own + sums[:, b : 2 * b] - sums[:, :b] + np.uint64(2) * (p - both)) % p == 0
        product *= prime
        if product > b * largest * largest:
            return found
    raise ValueError("a text of more words than the primes allow")


def _segments(words: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(first place, words) of the longest stretches in which every word stands LEAST_POWER times, numbered from 1."""
    found, left = [], [(0, words)]
    while left:
        base, part = left.pop()
        numbers, own = np.unique(part, return_inverse=True)
        often = np.bincount(own, minlength=len(numbers))[own] >= LEAST_POWER
        if often.all():
            if len(part) >= LEAST_WORDS:
                found.append((base, own.astype(np.uint64) + np.uint64(1)))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[False], often, [False]]).astype(np.int8)))
        left += [(base + s, part[s:e]) for s, e in edges.reshape(-1, 2).tolist() if e - s >= LEAST_WORDS]
    return found


def _chains(segments: list[np.ndarray], b: int) -> Iterator[tuple[int, int, int, int]]:
    """(segment, distance, first block, number of blocks) of the chains that recur, of all segments.

    Blocks of several segments are transformed together; of a long segment as many as SLICE_NUMBERS allow, and the
    chains are put together where it was cut.
    """
    most = max(4, SLICE_NUMBERS // (2 * b))
    group: list[tuple[int, int, np.ndarray]] = []
    held = 0
    pieces: list[np.ndarray] = []

    def flush() -> None:
        table = np.concatenate([rows for _, _, rows in group])
        found = recurrences(table, int(table.max()))
        at = 0
        for number, first, rows in group:
            own = found[at : at + len(rows) - 2]
            at += len(rows)
            d, j = np.nonzero(own.T)
            pieces.append(np.stack([np.full(len(d), number), d + b, j + first]))

    for number, words in enumerate(segments):
        whole = len(words) // b
        table = np.zeros((whole + 2, b), np.uint64)
        table.reshape(-1)[: len(words)] = words[: (whole + 2) * b]
        for first in range(0, whole - 1, most - 2):
            rows = table[first : min(first + most, whole + 2)]
            group.append((number, first, rows))
            held += len(rows)
            if held >= most:
                flush()
                group, held = [], 0
    if group:
        flush()
    number, d, j = np.concatenate(pieces, axis=1) if pieces else np.empty((3, 0), np.int64)
    if not len(j):
        return
    order = np.lexsort((j, d, number))
    number, d, j = number[order], d[order], j[order]
    new = np.concatenate([[True], (np.diff(number) != 0) | (np.diff(d) != 0) | (np.diff(j) != 1)])
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(j)))
    # A run's words that recur are LEAST_POWER - 1 periods; a chain lacks less than a block of them on either side.
    fit = (sizes >= 2) & ((sizes + 2) * b - 2 >= (LEAST_POWER - 1) * d[starts])
    yield from zip(number[starts][fit].tolist(), d[starts][fit].tolist(), j[starts][fit].tolist(), sizes[fit].tolist())


def _run(words: np.ndarray, d: int, start: int, end: int, b: int) -> tuple[int, int]:
    """(start, end) of the longest stretch of period ``d`` around the words start to end - 1, which recur."""
    low = max(0, start - b)
    differ = np.flatnonzero(words[low:start] != words[low + d : start + d])
    start = low + int(differ[-1]) + 1 if len(differ) else low
    high = min(len(words) - d, end + b)
    differ = np.flatnonzero(words[end:high] != words[end + d : high + d])
    return start, (end + int(differ[0]) if len(differ) else high) + d


def runs_of(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text (word numbers), by start, then period."""
    held = [(i, base, part) for i, words in enumerate(texts) for base, part in _segments(words)]
    found: list[dict[tuple[int, int], int]] = [{} for _ in held]
    b = 1
    while held:
        alive = [k for k, (_, _, part) in enumerate(held) if len(part) >= LEAST_POWER * b]
        if not alive:
            break
        for number, d, first, size in _chains([held[k][2] for k in alive], b):
            k = alive[number]
            at = first * b
            # Inside a run whose period divides d, d is no smallest period.
            if any(d % p == 0 and s <= at and at + d <= s + n for (s, n), p in found[k].items()):
                continue
            start, end = _run(held[k][2], d, at, at + size * b, b)
            if end - start >= max(LEAST_WORDS, LEAST_POWER * d):
                found[k].setdefault((start, end - start), d)
        b *= 2
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for (i, base, _), runs in zip(held, found):
        out[i] += [(base + s, n, p) for (s, n), p in runs.items()]
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def numbered(words: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """The words without those that any run holds after its first period, joined by one space."""
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    gone = np.cumsum(edges)[:-1] > 0
    return b" ".join(w for w, g in zip(words, gone.tolist()) if not g).decode()


def _slices(texts: list[str | None]) -> Iterator[list[list[bytes]]]:
    held, size = [], 0
    for text in texts:
        held.append((text or "").encode().split())  # of bytes: splits at exactly the six ASCII characters
        size += len(held[-1])
        if size >= SLICE_WORDS:
            yield held
            held, size = [], 0
    if held:
        yield held


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period by start, then period), collapsed: a row for each of ``docs``.

    Null and empty texts have no words and no runs; ``collapsed`` is then empty. Words are compared as they are. Each
    row is judged alone, whole at any length, so repeated rows give repeated results; a text needs memory of a few times
    its size. Columns but doc_id and text aren't read. An empty table gives none.
    """
    ship(docs.sparkSession)

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = 0
            for words in _slices(batch["text"].tolist()):
                runs = runs_of([numbered(w) for w in words])
                part = batch[["doc_id"]].iloc[at : at + len(words)]
                at += len(words)
                records = [[{"start": s, "length": n, "period": p} for s, n, p in found] for found in runs]
                yield part.assign(n_words=[len(w) for w in words], runs=records, collapsed=list(map(collapsed, words, runs)))

    held = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")  # numbers beside nulls would turn to floats
    found = held.mapInPandas(apply, f"doc_id string, n_words long, runs array<{RUN}>, collapsed string")
    return found.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def planted(doc_id: Column, text: Column) -> Column:
    """``text`` made periodic in about a tenth of the documents, as a checksum of doc_id (null: none) says."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))

    def cut(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = F.pmod(g, n)
        p = F.lit(1) + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        again = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int")))
        return F.when(n > 0, F.array_join(again, " ")).otherwise("")

    once = F.element_at(F.transform(F.array(words), cut), 1)  # binds the words, so they are found once
    return F.when(F.pmod(h, F.lit(10)) == 0, once).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, some of them made periodic; figures of the longest run, digests of all and of the rest."""
    docs = documents(spark, sf_dir).select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic_runs(docs)
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = found.withColumn("best", best)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.s").alias("start"),
        (-F.col("best.l")).alias("length"),
        F.col("best.p").alias("period"),
        F.floor(-F.col("best.l") * 1000 / F.col("best.p")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
