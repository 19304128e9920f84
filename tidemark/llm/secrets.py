"""Secret scan: trigram queries derived from each rule's pattern, answered by an inverted index, candidates verified.

Every rule's pattern gives a Boolean query of trigrams that any text it matches must hold (letters folded to lower
case). Texts are indexed in segments of SEGMENT_BYTES: for each trigram that some rule asks for, the postings are the
texts of the segment that hold it. A rule's query joins and intersects postings, and only the texts that are left are
searched by the pattern itself. A rule whose pattern needs no trigram searches every text. The index holds only what
the rules ask for, lies beside its texts and is dropped with them, so no text or posting is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from re import _constants as sre
from re import _parser as sre_parser
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import documents, ship

SEGMENT_BYTES = 4 << 20
#: Strings that the derivation follows side by side, and characters of a class that it spells out.
MOST_STRINGS = 64
MOST_CHARACTERS = 8


class Rule(NamedTuple):
    """A pattern of ASCII rules; matches whose ``group`` is shorter than ``least`` characters are dropped."""

    kind: str
    pattern: str
    any_case: bool = False
    group: int = 0
    least: int = 1


_KEY = r"(password|passwd|secret|token|api_?key)"
#: The base rules, then public token forms (fixed values), in the order in which equal starts are listed.
RULES = (
    Rule("assign", _KEY + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", any_case=True, group=2, least=12),
    Rule("access", r"AKIA[A-Z0-9]+", least=18),
    Rule("hex", r"[0-9a-f]{16,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("github_pat", r"github_pat_[A-Za-z0-9_]{22,}"),
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]{20,}"),
    Rule("slack", r"xox[abeoprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_(live|test)_[A-Za-z0-9]{16,}"),
    Rule("sendgrid", r"SG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43}"),
    Rule("npm", r"npm_[A-Za-z0-9]{36}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z\x20]*PRIVATE KEY-----[A-Za-z0-9+/=\x20\x0A\x0D]*(-----END [A-Z\x20]*PRIVATE KEY-----)?"),
    Rule("url_password", r"""[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\x20\x09-\x0D/:@"'<>]+:[^\x20\x09-\x0D/:@"'<>]{3,}@"""),
    Rule("bearer", r"[Bb]earer\x20+[A-Za-z0-9_.~+/-]{20,}=*"),
)
BASE = ("assign", "access", "hex")

SPAN = "struct<kind:string,start:long,end:long>"


def compiled(rule: Rule) -> re.Pattern:
    return re.compile(rule.pattern, re.ASCII | (re.IGNORECASE if rule.any_case else 0))


# A query is True (holds for any text), a trigram (bytes), or a tuple of "and" or "or" and queries.


def _joined(how: str, parts: list):
    """The query of ``parts`` under ``how``, without needless parts."""
    if how == "and":
        parts = [p for p in parts if p is not True]
    elif any(p is True for p in parts):
        return True
    parts = sorted(set(parts), key=repr)
    return (True if how == "and" else False) if not parts else parts[0] if len(parts) == 1 else (how, *parts)


def _holding(strings: set[bytes]):
    """Query of the texts that hold one of ``strings``."""
    if not strings:
        return False
    return _joined("or", [_joined("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in strings])


def _characters(node) -> set[bytes] | None:
    """Folded characters that a class allows; None where they are too many."""
    found = set()
    for kind, value in node:
        if kind is sre.LITERAL:
            found.add(chr(value).lower().encode() if value < 128 else chr(value).encode())
        elif kind is sre.RANGE and value[1] - value[0] < 2 * MOST_CHARACTERS:
            found |= {chr(c).lower().encode() if c < 128 else chr(c).encode() for c in range(value[0], value[1] + 1)}
        else:
            return None  # negated, a category, or a long range
    return found if len(found) <= MOST_CHARACTERS else None


def _derived(nodes) -> tuple[set[bytes], list]:
    """(strings, queries): a match holds all the queries and ends in one of the strings, which began it or follow a gap.

    The strings are exact while no gap was met; then queries is empty.
    """
    strings, queries = {b""}, []

    def gap() -> None:
        nonlocal strings
        queries.append(_holding(strings))
        strings = {b""}

    def follow(ends: set[bytes]) -> None:
        nonlocal strings
        if len(strings) * len(ends) > MOST_STRINGS:
            gap()
        if len(ends) > MOST_STRINGS:
            queries.append(_holding(ends))
        else:
            strings = {a + b for a in strings for b in ends}

    for kind, value in nodes:
        if kind is sre.LITERAL:
            follow({chr(value).lower().encode() if value < 128 else chr(value).encode()})
        elif kind is sre.IN and (own := _characters(value)) is not None:
            follow(own)
        elif kind is sre.SUBPATTERN or kind is sre.BRANCH:
            branches = [value[-1]] if kind is sre.SUBPATTERN else value[1]
            each = [_derived(b) for b in branches]
            if all(not own for _, own in each):
                follow(set().union(*[ends for ends, _ in each]))
            else:
                gap()
                queries.append(_joined("or", [_joined("and", [*own, _holding(ends)]) for ends, own in each]))
        elif kind in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            least, most, inner = value
            ends, own = _derived(inner)
            if own or most > 1 and not (least == most and least <= 4):
                gap()
                if least:
                    queries.append(_joined("and", [*own, _holding(ends)]))
            elif most == 1 and least == 0:
                follow(ends | {b""})
            else:
                for _ in range(least):
                    follow(ends)
        elif kind is not sre.AT:
            gap()
    return strings, queries


def trigram_query(pattern: str, any_case: bool = False):
    """Boolean query of folded trigrams that every text holds which ``pattern`` matches; True where there is none."""
    nodes = sre_parser.parse(pattern, re.ASCII | (re.IGNORECASE if any_case else 0))
    strings, queries = _derived(nodes)
    return _joined("and", [*queries, _holding(strings)])


def trigrams(query) -> set[bytes]:
    if isinstance(query, bytes):
        return {query}
    return set().union(*map(trigrams, query[1:])) if isinstance(query, tuple) else set()


def _code(trigram: bytes) -> int:
    return int.from_bytes(trigram, "big")


class Segment:
    """An inverted index of some texts (folded bytes) for the trigrams of ``table``: their number by code, 0 for none."""

    def __init__(self, texts: list[bytes], table: np.ndarray):
        self.n = len(texts)
        joined = np.frombuffer(b"\0\0".join([*texts, b""]), np.uint8).astype(np.int32)
        found = table[(joined[:-2] << 16) | (joined[1:-1] << 8) | joined[2:]] if len(joined) > 2 else table[:0]
        at = np.flatnonzero(found)
        text = np.searchsorted(np.cumsum([len(t) + 2 for t in texts]), at, "right")
        pairs = np.unique(found[at].astype(np.int64) * max(1, self.n) + text)
        number, text = pairs // max(1, self.n), pairs % max(1, self.n)
        edges = np.searchsorted(number, np.arange(int(table.max()) + 2))
        self.postings = [text[s:e] for s, e in zip(edges, edges[1:])]
        self.table = table

    def answer(self, query) -> np.ndarray:
        """Places of the texts that fulfil ``query``, in order."""
        if isinstance(query, bool):
            return np.arange(self.n if query else 0)
        if isinstance(query, bytes):
            return self.postings[self.table[_code(query)]]
        if query[0] == "or":
            return np.unique(np.concatenate([self.answer(q) for q in query[1:]]))
        lists = sorted((self.answer(q) for q in query[1:]), key=len)
        out = lists[0]
        for other in lists[1:]:
            out = np.intersect1d(out, other, assume_unique=True)
        return out


def table_of(queries: list) -> np.ndarray:
    """Numbers, from 1, of the queries' trigrams by their code."""
    table = np.zeros(1 << 24, np.int16)
    for number, t in enumerate(sorted(set().union(*map(trigrams, queries))), 1):
        table[_code(t)] = number
    return table


def scan(texts: list[str], rules: tuple[Rule, ...], queries: list, table: np.ndarray) -> tuple[list[list[tuple]], int]:
    """Spans (kind, start, end) of each text by start, then the order of the rules; and how often a pattern was run."""
    segment, found, runs = Segment([t.encode().lower() for t in texts], table), [[] for _ in texts], 0
    for place, (rule, query) in enumerate(zip(rules, queries)):
        pattern = compiled(rule)
        candidates = segment.answer(query).tolist()
        runs += len(candidates)
        for i in candidates:
            for m in pattern.finditer(texts[i]):
                if len(m[rule.group]) >= rule.least:
                    found[i].append((m.start(), place, m.end()))
    return [[(rules[p].kind, s, e) for s, p, e in sorted(own)] for own in found], runs


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and spans (array of kind, start, end; code points, end exclusive) by start, then the order of ``rules``.

    A row for each of ``docs``; null and empty texts hold no spans, and repeated rows give repeated results. Matches of
    one rule don't overlap; those of different rules may. Texts are searched whole at any length; columns but doc_id
    and text aren't read. An empty table gives none.
    """
    ship(docs.sparkSession)

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queries = [trigram_query(r.pattern, r.any_case) for r in rules]
        table = table_of(queries)
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            cuts = np.cumsum([len(t) for t in texts]) // SEGMENT_BYTES
            for own in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(cuts)) + 1):
                spans, _ = scan([texts[i] for i in own], rules, queries, table)
                records = [[{"kind": k, "start": s, "end": e} for k, s, e in found] for found in spans]
                yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[own].to_numpy(), "spans": records})

    held = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")  # numbers beside nulls would turn to floats
    found = held.mapInPandas(apply, f"doc_id string, spans array<{SPAN}>")
    return found.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, F.lit(k).__eq__)).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def _sql_pattern(rule: Rule) -> str:
    pattern = rule.pattern
    if rule.any_case:  # ASCII letters alone have two cases
        pattern = pattern.replace(_KEY, "(?:" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word) for word in ("password", "passwd", "secret", "token", "api_?key")) + ")")
    return pattern.replace("'", "''")


def _rule_sql(place: int, rule: Rule) -> str:
    pattern = _sql_pattern(rule)
    value = f"regexp_extract(m, '{pattern}', {rule.group - 1})" if rule.group else "m"  # the key's group is no group here
    return f"""SELECT r, {place} AS place, '{rule.kind}' AS kind, start, start + length(m) AS stop FROM (
  SELECT r, unnest(ms) AS m, unnest(list_transform(range(1, len(ms) + 1), lambda i: list_sum(list_transform(ps[1:i], lambda p: length(p))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda p: length(p))), 0)))::BIGINT AS start
  FROM (SELECT r, regexp_extract_all(text, '{pattern}') AS ms, string_split_regex(text, '{pattern}') AS ps FROM d))
  WHERE length({value}) >= {rule.least}"""


OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
s AS ({" UNION ALL ".join(_rule_sql(i, rule) for i, rule in enumerate(RULES))}),
a AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place) FILTER (place < 3) AS base,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place) AS spans FROM s GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (r)
"""
