"""Licence scan: canonical digests of entire texts, and of entire lines, hash-joined to digests of known licences.

Main path: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import documents, row_key, stash
from tidemark.llm.license_texts import known

#: Spellings that mean the same (fixed values), applied to lower case text in this order.
SPELLINGS = [
    (r"licenc", "licens"),
    (r"\b(organi|authori|recogni|utili)s(e|ing|ation)", "$1z$2"),
    (r"behaviour", "behavior"),
    (r"acknowledgement", "acknowledgment"),
    (r"sub-licens", "sublicens"),
    (r"non-infring", "noninfring"),
    (r"\bper cent\b", "percent"),
    (r"\bmerchantibility\b", "merchantability"),
    (r"\bhttps:", "http:"),
]
#: A copyright line names a year, a sign, a placeholder or who holds it; a wrapped line that only begins with the word stays.
COPYRIGHT_LINE = r"^[^\p{L}\p{N}]*(copyright[\s:,]*(\(c\)|©|[0-9]{4}|[<\[{]|by\b)|\(c\)\s*(copyright|[0-9]{4})|©).*$"
RIGHTS_LINE = r"^[^\p{L}\p{N}]*all rights reserved[^\p{L}\p{N}]*$"


def canonical(line: Column) -> Column:
    """A line in lower case, empty if it is a copyright or all-rights-reserved line, in one spelling, words with single
    spaces between them."""
    out = F.regexp_replace(F.regexp_replace(F.lower(line), COPYRIGHT_LINE, ""), RIGHTS_LINE, "")
    for pattern, to in SPELLINGS:
        out = F.regexp_replace(out, pattern, to)
    return F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))


def digests(text: Column) -> Column:
    """The digest of the entire text, then those of its lines: each line is made canonical once, and the text's form is
    that of its lines with single spaces between them."""
    lines = F.transform(F.split(text, "\n"), canonical)
    whole = F.md5(F.array_join(F.filter(lines, lambda x: x != ""), " "))
    return F.concat(F.array(whole), F.transform(lines, lambda x: F.when(x != "", F.md5(x))))


def known_digests(spark: SparkSession) -> DataFrame:
    """licence, digest; a fixed few hundred rows. Two licences never share a digest: the first in order would win."""
    rows = F.array(*[F.struct(F.lit(i).alias("licence"), F.lit(t).alias("known_text")) for i, t in known()])
    table = spark.range(1).select(F.inline(rows))
    return table.groupBy(digests(F.col("known_text"))[0].alias("digest")).agg(F.min("licence").alias("licence"))


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, digest, license_id, notices, n_notice_lines: a row for each row of ``docs``.

    ``license_id``: the known licence whose canonical text is the entire document's, else null. ``notices``: the sorted
    licences whose canonical text is an entire line of it. Null texts count as empty; texts without a word match none.
    Rows that agree in doc_id and text get equal results; long texts are scanned whole; other columns aren't read; an
    empty table gives no rows.
    """
    known_ones = F.broadcast(known_digests(docs.sparkSession))  # a fixed number of rows
    own = docs.select("doc_id", row_key().alias("row"), digests(F.coalesce("text", F.lit(""))).alias("found"))
    own = stash(own.select("doc_id", "row", F.col("found")[0].alias("digest"), F.slice("found", 2, F.size("found")).alias("lines")), "digests")
    whole = own.join(known_ones, "digest", "left").select("doc_id", "row", "digest", F.col("licence").alias("license_id"))
    lines = own.select("row", F.posexplode("lines").alias("place", "digest"))
    found = lines.join(known_ones, "digest").groupBy("row", "licence").agg(F.count_distinct("place").alias("n"))  # repeated rows count once
    notices = found.groupBy("row").agg(F.sort_array(F.collect_list("licence")).alias("notices"), F.sum("n").alias("n_notice_lines"))
    return whole.join(notices, "row", "left").select("doc_id", "digest", "license_id", F.coalesce("notices", F.array().cast("array<string>")).alias("notices"), F.coalesce("n_notice_lines", F.lit(0)).cast("long").alias("n_notice_lines"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def canon(line: str) -> str:
        out = f"lower({line})"
        for pattern, to in [(COPYRIGHT_LINE, ""), (RIGHTS_LINE, ""), *SPELLINGS]:
            out = f"regexp_replace({out}, {quote(pattern)}, {quote(to.replace('$', chr(92)))}, 'g')"
        return f"trim(regexp_replace({out}, {quote('[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}]+')}, ' ', 'g'))"

    values = ", ".join(f"({quote(i)}, {quote(t)})" for i, t in known())
    whole = "md5(coalesce(string_agg(line, ' ' ORDER BY pos) FILTER (line <> ''), ''))"
    return f"""
WITH kt AS (SELECT row_number() OVER () AS r, licence, t FROM (VALUES {values}) v(licence, t)),
kl AS (SELECT r, licence, {canon('line')} AS line, pos FROM (SELECT r, licence, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS pos FROM kt)),
k AS (SELECT digest, min(licence) AS licence FROM (SELECT licence, {whole} AS digest FROM kl GROUP BY r, licence) GROUP BY digest),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT r, doc_id, {canon('line')} AS line, pos FROM (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM d)),
w AS (SELECT r, doc_id, {whole} AS digest FROM l GROUP BY r, doc_id),
n AS (SELECT r, list_sort(list(DISTINCT licence)) AS notices, count(*) AS n_notice_lines FROM (SELECT r, md5(line) AS digest FROM l WHERE line <> '') JOIN k USING (digest) GROUP BY r)
SELECT doc_id, w.digest, k.licence AS license_id, coalesce(notices, CAST([] AS VARCHAR[])) AS notices, CAST(coalesce(n_notice_lines, 0) AS BIGINT) AS n_notice_lines
FROM w LEFT JOIN k USING (digest) LEFT JOIN n USING (r)
"""


OP4_SQL = _sql()
