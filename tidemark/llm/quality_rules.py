"""Line-first quality rules: judge every line, remove the lines that fail, then reject documents that lost too much."""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import documents, ship

MIN_WORDS = 20
MAX_REPEAT = 30  # per cent of words in repeated windows
MAX_LOSS = 40  # per cent of words in removed lines
WINDOW = 8

ASCII_UPPER, ASCII_LOWER = re.compile("[A-Z]"), re.compile("[a-z]")
UPPER, LOWER = regex.compile(r"\p{Lu}"), regex.compile(r"\p{Ll}")
SYMBOLS = b"#*$%&|<>"
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Stock phrases of the table's languages (fixed values).
PHRASES = {
    "en": ["licensed under", "under the mit license", "all rights reserved", "copyright", "terms of (use|service)", "privacy policy", "cookies", "subscribe", "click here", "sign up", "log in", "share this", "read more"],
    "fr": ["tous droits réservés", "sous licence", "politique de confidentialité", "conditions d.utilisation", "mentions légales", "cliquez ici", "inscrivez-vous", "abonnez-vous", "se connecter", "lire la suite", "partager cet article"],
    "de": ["alle rechte vorbehalten", "lizenziert unter", "datenschutzerklärung", "nutzungsbedingungen", "impressum", "klicken sie hier", "jetzt anmelden", "abonnieren", "einloggen", "weiterlesen", "artikel teilen"],
    "es": ["todos los derechos reservados", "bajo licencia", "política de privacidad", "condiciones de uso", "términos de uso", "aviso legal", "haga clic aquí", "haz clic aquí", "suscríbete", "suscribirse", "iniciar sesión", "leer más", "compartir este"],
}
BOILERPLATE_WORDS = "|".join(p for phrases in PHRASES.values() for p in phrases)
BOILERPLATE = re.compile(BOILERPLATE_WORDS)
#: Sentence ends of several scripts, and what may close a quotation or bracket after them (fixed values).
MARKS = ".!?:;…。！？：；।॥؟۔։።၊။។"
CLOSERS = "\"')]»”’」』）"
ENDINGS = tuple(MARKS + CLOSERS)
#: Rules in the order in which they claim a line.
RULES = ("navigation", "symbols", "shouting", "repetition", "boilerplate", "unended")


def cases(line: str) -> tuple[int, int]:
    """Upper and lower case letters, of any script."""
    if line.isascii():
        return len(ASCII_UPPER.findall(line)), len(ASCII_LOWER.findall(line))
    return len(UPPER.findall(line)), len(LOWER.findall(line))


def ended(line: str) -> bool:
    return line.rstrip(" \t\n\v\f\r").endswith(ENDINGS)


def line_rule(line: str, raw: bytes, words: list[bytes], goes_on: bool = False) -> int:
    """1 + the place in RULES of the first rule that the line fails, 0 for none. Lines of no words pass.

    navigation: a quarter or more of its words are bare separators. symbols: more than a tenth of its word characters
    are of ``#*$%&|<>``. shouting: three words or more, more upper than lower case letters. repetition: more than a
    quarter of its words equal the word before. boilerplate: at most 30 words with a stock phrase. unended: 12 words
    or more, and neither it nor a later line of its block (``goes_on``; lines up to the next without words) ends as a
    sentence does, so text that is wrapped at line ends passes.
    """
    n = len(words)
    if not n:
        return 0
    if 4 * sum(w in (b"|", b"-", b"/", b">", b"*") for w in words) >= n and n >= 3:
        return 1
    marks = len(raw) - len(raw.translate(None, SYMBOLS))
    letters = len(line) - sum(map(line.count, " \t\n\v\f\r"))
    if 10 * marks > letters:
        return 2
    if n >= 3:
        upper, lower = cases(line)
        if upper > lower:
            return 3
    if n >= 4 and 4 * sum(a == b for a, b in zip(words, words[1:])) > n:
        return 4
    if n <= 30 and BOILERPLATE.search(line.lower()):
        return 5
    if n >= 12 and not goes_on and not ended(line):
        return 6
    return 0


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that occur twice or more in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words)).astype(np.uint64)
    rolled = np.zeros(n, np.uint64)
    for i in range(window):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + (ids[i : i + n] ^ (ids[i : i + n] >> np.uint64(29)))
    order = np.argsort(rolled, kind="stable")
    same = rolled[order][1:] == rolled[order][:-1]
    if not same.any():
        return 0
    again = np.zeros(n, bool)
    groups: dict[tuple[bytes, ...], int] = {}  # compares the words themselves wherever digests agree
    for i in np.flatnonzero(np.concatenate([same, [False]]) | np.concatenate([[False], same])):
        at = int(order[i])
        first = groups.setdefault(tuple(words[at : at + window]), at)
        if first != at:
            again[first] = again[at] = True
    edges = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(again)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int((np.cumsum(edges) > 0).sum())


def judge(text: str | None) -> tuple:
    """Figures of one text, and the text without its failing lines."""
    text = text or ""
    raw = text.encode()
    words = raw.split()  # of bytes: splits at exactly the six ASCII characters
    word_chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    repeats, seen, kept, lost, failed = 0, set(), [], 0, 0
    lines = [(line, encoded, encoded.split()) for line in text.split("\n") for encoded in (line.encode(),)]
    goes_on, later = [], False  # whether a later line of the block is ended
    for line, _, own in reversed(lines):
        later = later and bool(own)
        goes_on.append(later)
        later = later or bool(own) and ended(line)
    for (line, encoded, own), on in zip(lines, reversed(goes_on)):
        if own:
            repeats += line in seen
            seen.add(line)
        if line_rule(line, encoded, own, on):
            lost += len(own)
            failed += 1
        else:
            kept.append(line)
    repeat = repeated_words(words)
    base = len(words) < MIN_WORDS or 100 * repeat > MAX_REPEAT * len(words)
    keep = not base and 100 * lost <= MAX_LOSS * len(words)
    clean = "\n".join(kept)
    return len(words), word_chars, symbols, repeats, repeat, base, keep, failed, lost, md5(clean.encode()).hexdigest(), clean


FIGURES = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "kept": "boolean", "n_failed_lines": "long", "n_lost_words": "long", "clean_md5": "string", "clean_text": "string"}


def _judged(docs: DataFrame, carry: list[str], figures: list[str]) -> DataFrame:
    """``figures`` of ``text`` beside the columns ``carry``, held as c0, c1, ... so that no name meets another."""
    ship(docs.sparkSession)

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            judged = pd.DataFrame([judge(t) for t in batch.pop("text")], columns=list(FIGURES), index=batch.index)
            yield pd.concat([batch, judged[figures]], axis=1)

    kinds = [f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carry)] + [f"{c} {FIGURES[c]}" for c in figures]
    held = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)]
    return docs.select(*held, F.col("text").alias("text")).mapInPandas(apply, ", ".join(kinds))


def quality_rules(docs: DataFrame, texts: bool = True) -> DataFrame:
    """``docs`` with FIGURES; a column of ``docs`` with such a name is replaced. ``texts=False`` leaves out both texts.

    Null and empty texts have no words, fail the base rule and are not kept. Each row is judged alone, texts of any
    length whole: repeated rows give repeated results, and an empty table gives none.
    """
    carry = [c for c in docs.columns if c not in FIGURES and (texts or c != "text")]
    figures = [c for c in FIGURES if texts or c != "clean_text"]
    return _judged(docs, carry, figures).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], *figures)


def cleaned(docs: DataFrame) -> DataFrame:
    """The kept documents without their failing lines, in the columns of ``docs``; ``n_chars`` follows the text."""
    others = [c for c in docs.columns if c != "text"]
    kept = _judged(docs, others, ["kept", "clean_text"]).where("kept")
    own = {c: F.col(f"c{i}") for i, c in enumerate(others)} | {"text": F.col("clean_text")}
    if "n_chars" in own:
        own["n_chars"] = F.length("clean_text").cast(docs.schema["n_chars"].dataType)
    return kept.select(*[own[c].alias(c) for c in docs.columns])


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir).select("doc_id", "text"), texts=False)


def _closers() -> str:
    return CLOSERS.replace("'", "''").replace("]", r"\]")


OP1_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
ws AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
base AS (SELECT r, doc_id, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
           length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols FROM ws),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM d),
lw AS (SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w, row_number() OVER (PARTITION BY r, line ORDER BY pos) AS nth,
    regexp_matches(line, '[{MARKS}{_closers()}][\x20\x09-\x0D]*$') AS ended,
    count(*) FILTER (NOT regexp_matches(line, '[^\x20\x09-\x0D]')) OVER (PARTITION BY r ORDER BY pos) AS block FROM lines),
judged AS (SELECT *, len(w) AS n,
    len(list_filter(w, lambda x: x IN ('|', '-', '/', '>', '*'))) AS bars,
    length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g')) AS marks,
    length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS letters,
    length(line) - length(regexp_replace(line, '\p{{Lu}}', '', 'g')) AS up,
    length(line) - length(regexp_replace(line, '\p{{Ll}}', '', 'g')) AS low,
    len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) AS twice FROM lw),
failed AS (SELECT *, n > 0 AND ((n >= 3 AND 4 * bars >= n) OR 10 * marks > letters OR (n >= 3 AND up > low) OR (n >= 4 AND 4 * twice > n)
    OR (n <= 30 AND regexp_matches(lower(line), '{BOILERPLATE_WORDS}'))
    OR (n >= 12 AND NOT ended AND NOT coalesce(max(ended) OVER (PARTITION BY r, block ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), false))) AS bad FROM judged),
by_doc AS (SELECT r, coalesce(sum(CASE WHEN n > 0 AND nth > 1 THEN 1 ELSE 0 END), 0) AS n_dup_lines,
    coalesce(sum(CASE WHEN bad THEN 1 ELSE 0 END), 0) AS n_failed_lines, coalesce(sum(CASE WHEN bad THEN n ELSE 0 END), 0) AS n_lost_words,
    md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT bad), '')) AS clean_md5 FROM failed GROUP BY r),
win AS (SELECT r, unnest(range(1, len(w) - 6)) AS i, w FROM ws WHERE len(w) >= 8),
keyed AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS k FROM win),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM keyed) WHERE c > 1),
cov AS (SELECT r, sum(least(8, nxt - i)) AS n_repeat_words FROM (SELECT r, i, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i), i + 8) AS nxt FROM twice) GROUP BY r),
f AS (SELECT b.*, y.n_dup_lines, y.n_failed_lines, y.n_lost_words, y.clean_md5, coalesce(c.n_repeat_words, 0) AS n_repeat_words FROM base b JOIN by_doc y USING (r) LEFT JOIN cov c USING (r))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * n_lost_words <= 40 * n_words AS kept,
  n_failed_lines::BIGINT AS n_failed_lines, n_lost_words::BIGINT AS n_lost_words, clean_md5
FROM f
"""
