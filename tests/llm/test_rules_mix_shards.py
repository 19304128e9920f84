"""Quality rules, mixing, sharding and licences on odd rows, against plain Python."""

import collections
import hashlib
import itertools
import os
import zlib

import pytest
from helpers import by_sql, rows

from tidemark.llm import licenses, mixing, quality_rules, registry, sharding
from tidemark.llm.license_texts import MIT, known

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLEAN = "This sentence has quite a few ordinary words in it and ends well. Another one follows it here, and it ends too."
ODD = [
    (1, CLEAN, "en", "a", 5),
    (1, CLEAN, "en", "a", 5),
    (2, None, None, None, None),
    (3, "", "en", "b", 0),
    (None, "\t \n", "en", "b", 0),
    (4, "word " * 5000, "en", "c", 0),
    (5, "é ü  x\x0bz\r\n#|<>\n", "fr", "é", 0),
    (6, CLEAN + "\n" + CLEAN + "\n" + CLEAN, "en", "a", 5),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def given(spark):
    if not os.path.isdir(FOLDER):
        pytest.skip("no tables")
    return FOLDER


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, given, name):
    assert rows(registry.QUERIES[name](spark, given).toPandas()) == rows(by_sql(registry.SQL[name], given))


def repeats(words, n=8):
    seen = collections.Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    return len({i + j for i in range(len(words) - n + 1) if seen[tuple(words[i : i + n])] > 1 for j in range(n)})


def test_rules_on_odd_rows(spark, odd):
    import re

    got = quality_rules.quality_rules(odd.withColumn("kept", odd["doc_id"])).collect()
    assert len(got) == len(ODD)
    for r in got:
        words = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        assert (r["n_words"], r["word_chars"]) == (len(words), sum(map(len, words)))
        assert r["n_repeat_words"] == repeats(words)
        assert r["base_failed"] == (len(words) < 20 or 100 * repeats(words) > 30 * len(words))
    assert {r["doc_id"] for r in got if r["kept"]} == {1}
    assert quality_rules.quality_rules(odd.limit(0)).count() == 0
    assert [r["text"] for r in quality_rules.cleaned(odd).collect()] == [CLEAN, CLEAN]
    clash = quality_rules.cleaned(odd.withColumn("kept", odd["doc_id"] + 7).withColumn("clean_text", odd["lang"]))
    assert [(r["kept"], r["clean_text"], r["n_chars"]) for r in clash.collect()] == [(8, "en", len(CLEAN))] * 2


def test_wrapped_and_other_scripts_stay(spark):
    wrapped = "\n".join(["the first line of a paragraph that is wrapped at the end of each line and"] * 3 + ["Häuser und anderes stehen groß am Anfang, wie es in der Sprache üblich ist."])
    hindi = "यह एक साफ वाक्य है जिसमें कई शब्द हैं और जो ठीक से समाप्त होता है।\n" * 3
    arabic = "هذه جملة واضحة فيها كلمات كثيرة جدا وهي تنتهي كما ينتهي السؤال في هذه اللغة أليس كذلك؟"
    greek = "ΟΛΑ ΤΑ ΓΡΑΜΜΑΤΑ ΜΕΓΑΛΑ"
    for text, lost in ((wrapped, 0), (hindi, 0), (arabic, 0), (greek, 4), ("Tous droits réservés.\n" + wrapped, 3), ("Alle Rechte vorbehalten.", 3), ("Lea la política de privacidad.", 5), (wrapped + "\n\n" + " ".join(["menu"] + ["item", "x"] * 8), 17)):
        assert quality_rules.judge(text)[8] == lost, text


def test_rules_on_a_very_long_text(spark):
    text = (CLEAN + "\n") * 20_000 + "a | b | c | d\n" + " ".join(f"w{k}" for k in range(600_000)) + "."
    r = quality_rules.quality_rules(spark.createDataFrame([(1, text, 3, "x")], "doc_id long, text string, c0 int, clean_md5 string")).head()
    assert r["n_words"] == 20_000 * 22 + 7 + 600_000 and r["n_lost_words"] == 7 and r["n_failed_lines"] == 1 and r["c0"] == 3


@pytest.mark.parametrize("line,rule", [("a | b | c | d", 1), ("x### y$$$ z%%%", 2), ("STOP IT NOW!!", 3), ("so so so so so", 4), ("Licensed under the MIT License.", 5), ("one two three four five six seven eight nine ten eleven twelve", 6), (CLEAN, 0), ("  ", 0)])
def test_line_rules(line, rule):
    assert quality_rules.line_rule(line, line.encode(), line.encode().split()) == rule


def test_mix_of_odd_rows(spark, odd):
    got = mixing.mix(odd).collect()
    again = mixing.mix(odd.repartition(3)).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["taken"], r["size"])
    assert len(got) == len(ODD) and sorted(got, key=key) == sorted(again, key=key)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert mixing.mix(odd.limit(0)).count() == 0


def test_mix_keeps_clashing_columns_and_long_texts(spark, odd):
    docs = odd.union(spark.createDataFrame([(9, "word " * 1_000_000, "en", "c", 1)], odd.schema))
    for c in ("row", "turn", "target", "rows", "start", "copies", "copy", "size", "digest", "key", "_range"):
        docs = docs.withColumn(c, docs["n_chars"])
    taken = collections.Counter()
    for r in mixing.mix(docs).collect():
        taken[r["doc_id"]] += r["taken"]
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    got = collections.Counter()
    for r in mixed.collect():
        got[r["doc_id"]] += len((r["text"] or "").encode().split())
        assert r["row"] == r["turn"] == r["copies"] == r["digest"] == r["n_chars"]
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in taken.items() if v} and taken[9] in (0, 10**6, 2 * 10**6)


def water(sizes, weights):
    """Share 150 % of all by weight; what passes a cap is shared again."""
    left, target, open_ = 1.5 * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        total = sum(weights[i] for i in open_)
        full = {i for i in open_ if left * weights[i] / total >= 2 * sizes[i]}
        if not full:
            for i in open_:
                target[i] = left * weights[i] / total
            break
        for i in full:
            target[i] = 2.0 * sizes[i]
        left -= sum(2 * sizes[i] for i in full)
        open_ -= full
    return target


@pytest.mark.parametrize("sizes", [[100, 100, 100], [1, 1000, 1000, 5], [10, 0, 3000, 7, 9, 11]])
def test_targets(spark, sizes):
    sources = spark.createDataFrame([(f"s{i}", s, 1) for i, s in enumerate(sizes)], "source string, source_size long, rows long")
    got = [r["target"] for r in mixing.targets(sources).orderBy("source").collect()]
    assert got == pytest.approx(water(sizes, list(itertools.islice(itertools.cycle((5, 2, 1)), len(sizes)))))


def test_mixed_documents_repeat_what_mix_takes(spark, given):
    docs = spark.read.parquet(f"{given}/documents.parquet")
    copies = collections.Counter(r["doc_id"] for r in mixing.mixed_documents(docs).select("doc_id").collect())
    for r in mixing.mix(docs).collect():
        assert r["taken"] == r["size"] * copies[r["doc_id"]]


def shard_points(docs, shards):
    """{doc_id: point}, and the points' (size, places) by plain Python."""
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    size = {d["doc_id"]: len((d["text"] or "").encode()) + 1 for d in docs}
    alike = collections.Counter()
    for d in docs:
        alike[d["text"]] += size[d["doc_id"]]
    total, of, sums, places = sum(size.values()), {}, collections.Counter(), {}
    for d in docs:
        text = "\0" if d["text"] is None else d["text"]
        large = alike[d["text"]] * sharding.WHOLE * shards > total
        point = md5(text), int(md5(f"{d['doc_id']}:{text}")[:2], 16) if large else 0
        own = [len(d["text"] or ""), int(md5(d["lang"])[:8], 16), int(md5(d["source"])[:8], 16)]
        of[d["doc_id"]] = point
        sums[point] += size[d["doc_id"]]
        places[point] = [min(x) for x in zip(own, places.get(point, own))]
    tie = {p: int(md5(f"{p[0]}:{p[1]}")[:5], 16) for p in sums}
    return of, {p: (sums[p], [(x << 20) + tie[p] for x in places[p]]) for p in sums}


def test_shards_by_brute_force(spark, given):
    docs = spark.read.parquet(f"{given}/documents.parquet")
    rows = docs.collect()
    total = sum(len((r["text"] or "").encode()) + 1 for r in rows)

    def expected_of(shards):
        of, points = shard_points(rows, len(shards))
        spread = lambda part, d: max(points[p][1][d] >> 20 for p in part) - min(points[p][1][d] >> 20 for p in part)
        whole = [max(1, spread(points, d)) for d in range(3)]

        def cut(part, shards):
            if len(shards) == 1:
                return {p: shards[0] for p in part}
            d = max(range(3), key=lambda d: spread(part, d) / whole[d])
            part, half, low, sums = sorted(part, key=lambda p: points[p][1][d]), len(shards) // 2, [], 0
            for p in part:
                if sums * len(shards) >= sum(points[q][0] for q in part) * half:
                    break
                low.append(p)
                sums += points[p][0]
            return cut(low, shards[:half]) | cut(part[len(low) :], shards[half:])

        placed = cut(list(points), shards)
        return {i: placed[p] for i, p in of.items()}

    many = 21  # leaves of about as many bytes, an odd number of them
    target = -(-total // many)
    got = sharding.kd_shards(docs, target_bytes=target, keep=("lang", "source")).toPandas()
    assert dict(zip(got["doc_id"], got["shard"])) == expected_of(list(range(many))) and set(got["shard"]) == set(range(many))
    expected = expected_of(list(range(8)))
    got = sharding.kd_shards(docs).toPandas()
    assert dict(zip(got["doc_id"], got["shard"])) == expected
    for _, s in got.groupby("shard"):
        assert sorted(s["slot"]) == list(range(len(s)))
    assert got["size"].sum() / 8 * 0.8 < got.groupby("shard")["size"].sum().min()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(zlib.crc32(texts[i].encode()) == c for i, c in zip(got["doc_id"], got["text_crc32"]))


def test_equal_texts_share_a_shard_unless_they_are_large(spark):
    """Whatever their ids and metadata; a group of a third of all bytes is dealt out, and shards stay even."""
    rows = [(i, f"text {i // 4} " * 30, "abcd"[i % 4], "xyz"[i % 3], 1) for i in range(1600)] + [(5000 + i, "hot " * 80, "e", "x", 1) for i in range(800)]
    got = sharding.kd_shards(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).toPandas()
    shard = dict(zip(got["doc_id"], got["shard"]))
    assert all(len({shard[4 * k + j] for j in range(4)}) == 1 for k in range(400))
    assert len({shard[5000 + i] for i in range(800)}) > 1
    sums = got.groupby("shard")["size"].sum()
    assert len(sums) == 8 and sums.max() < 1.15 * sums.min()


def test_shards_of_odd_rows(spark, odd):
    got = sharding.kd_shards(odd).collect()
    assert len(got) == len(ODD) and {r["size"] for r in got if r["doc_id"] == 2} == {1}
    assert sharding.kd_shards(odd.limit(0)).count() == 0
    assert {r["shard"] for r in sharding.kd_shards(odd, target_bytes=10**9).collect()} == {0}
    clash = odd.union(spark.createDataFrame([(9, "word " * 1_000_000, "en", "c", 1)], odd.schema))
    for c in ("row", "at", "first", "many", "dim", "cut", "digest", "key", "rows", "one", "_range", "k0"):
        clash = clash.withColumn(c, clash["n_chars"])
    got = sharding.kd_shards(clash, keep=("row", "at", "first", "n_chars")).collect()
    assert len(got) == len(ODD) + 1 and all(r["row"] == r["at"] == r["first"] == r["n_chars"] for r in got)


def test_licences(spark):
    texts = [MIT, MIT.upper().replace("<YEAR> <OWNER>", "2020 Some One").replace("SUBLICENSE", "sub-license"), "x\nReleased under the MIT Licence!\n" * 2, None, "", "MIT is a place."]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(2, texts[2])], "doc_id long, text string")
    got = sorted(licenses.license_scan(docs).collect(), key=lambda r: r["doc_id"])
    assert [r["license_id"] for r in got] == ["MIT", "MIT", None, None, None, None, None]
    assert [(r["notices"], r["n_notice_lines"]) for r in got[2:4]] == [(["MIT"], 2)] * 2 and got[5]["notices"] == []
    by_digest = collections.defaultdict(set)
    for r in licenses.known_digests(spark).collect():
        by_digest[r["digest"]].add(r["licence"])
    assert len(by_digest) > 100 and all(len(v) == 1 for v in by_digest.values()) and len(known()) < 400


def test_whole_licences_in_usual_forms(spark):
    import textwrap

    from tidemark.llm import license_texts as t

    def wrapped(text, width=60):
        return "\n".join(textwrap.fill(p, width, break_on_hyphens=False) for p in text.split("\n"))

    isc = "ISC License\n\nCopyright (c) 2019, Some One <some@one.org>\n\n" + wrapped(t._ISC, 79)
    bodies = [
        ("MIT", "MIT License\n\nCopyright (c) 2021 Some One\nCopyright 2022-2024 Others\n\n" + wrapped(t._MIT_BODY.split("\n", 2)[2])),
        ("ISC", isc), ("BSD-3-Clause", "BSD 3-Clause License\n\nCopyright (c) 2020, Some One\nAll rights reserved.\n\n" + wrapped(t._BSD_3.split("\n", 2)[2])),
        ("Apache-2.0", wrapped(t.APACHE, 72)), ("Unlicense", wrapped(t.UNLICENSE).replace("recognize", "recognise")), ("GPL-3.0-or-later", wrapped(t.GPL_HEADER.format(kind=""))),
        (None, t.MIT + "\nand one more sentence"), (None, t.APACHE.replace("perpetual", "temporary")),
    ]
    docs = spark.createDataFrame([(i, x, i, "k") for i, (_, x) in enumerate(bodies)], "doc_id long, text string, row long, digest string")
    got = {r["doc_id"]: r["license_id"] for r in licenses.license_scan(docs).collect()}
    assert [got[i] for i in range(len(bodies))] == [licence for licence, _ in bodies]
    assert "copyright notice and this permission notice appear" in " ".join(isc.split())  # a wrapped line may begin so
    long = spark.createDataFrame([(1, "some words\n" * 200_000 + "MIT License\n")], "doc_id long, text string")
    assert [(r["notices"], r["n_notice_lines"]) for r in licenses.license_scan(long).collect()] == [(["MIT"], 1)]
    assert licenses.license_scan(long.limit(0)).count() == 0


def test_licence_files(spark):
    """Full texts match whole, rewrapped, under another address and without instructions; a changed word or a part doesn't."""
    from tidemark.llm import license_texts as t

    whole = {}
    for licence, text in t.files():
        whole.setdefault(licence, text)
    assert len(whole) == 12
    texts, expected = [], []
    for licence, text in whole.items():
        texts += [text, " ".join(text.split()[:200]), text.replace("License", "Lizenz", 1), text.replace("\n", "\r\n").upper()]
        expected += [licence, None, None, licence]
    texts.append(whole["GPL-2.0"].replace("51 Franklin Street, Fifth Floor, Boston, MA 02110-1301", "59 Temple Place, Suite 330, Boston, MA 02111-1307"))
    texts.append(whole["GPL-3.0"][: whole["GPL-3.0"].index("How to Apply")])
    texts.append(whole["MPL-2.0"].replace("https:", "http:").replace("  ", " "))
    expected += ["GPL-2.0", "GPL-3.0", "MPL-2.0"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["license_id"] for r in licenses.license_scan(docs).collect()}
    assert [got[i] for i in range(len(texts))] == expected
