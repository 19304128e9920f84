"""Line dedup, BPE, the token store, media, LM scoring and near duplicates on odd rows, against plain Python."""

import collections
import gzip
import hashlib
import io
import os
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe, line_dedup, lm_scoring, media, near_dedup, token_store
from tidemark.llm.common import new_path

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def given(spark):
    if not os.path.isdir(FOLDER):
        pytest.skip("no tables")
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in zip(ids or range(len(texts)), texts)], SCHEMA)


ODD = [None, "", " ", "x" * 20000, "é" * 50, "a  b\n\n c\t'sé日本 <|endoftext|> don't", "word " * 3000, None]


# --- Line dedup ---


def cut_lines(text):
    """(line of the text, content) of each line that has words."""
    parts = [(i, part) for i, line in enumerate(text.split("\n")) for part in re.split(f"(?<=[{line_dedup.MARKS}]) ", line)]
    return [(i, " ".join(part.split())) for i, part in parts if part.split()]


def brute_lines(docs, least=line_dedup.MIN_WORDS):
    """Lines to delete: of all runs of lines with ``least`` words or more that stand at an earlier place, without overlap."""
    seen, gone = {}, collections.defaultdict(set)
    for doc, text in sorted(docs.items()):
        lines = [x for _, x in cut_lines(text)]
        for a in range(len(lines)):
            words, key = 0, hashlib.md5()
            for b in range(a, len(lines)):
                words += len(lines[b].split())
                key.update((lines[b] + "\n").encode())
                if words >= least:
                    first = seen.setdefault(key.digest(), (doc, b))
                    if first[0] != doc or first[1] < a:
                        gone[doc].update(range(a, b + 1))
    return gone


def left_over(text, gone):
    k, out = 0, []
    for line in text.split("\n"):
        parts = re.split(f"(?<=[{line_dedup.MARKS}]) ", line)
        kept, lost = [], False
        for part in parts:
            if part.split():
                k += 1
                if k - 1 in gone:
                    lost = True
                    continue
            kept.append(part)
        if not lost or any(x.split() for x in kept):
            out.append(" ".join(kept))
    return "\n".join(out)


def test_line_dedup_by_brute_force(spark):
    rng = random.Random(3)
    pool = [" ".join(rng.choices("abcdefgh", k=rng.choice([1, 5, 20, 60]))) + rng.choice(["", "", ".", "!", "؟"]) for _ in range(14)]
    docs = {i: "".join(rng.choice([*pool, "", " ", f"own line {i}"]) + rng.choice(["\n", "\n", " "]) for _ in range(rng.randint(0, 12))) for i in range(80)}
    gone = brute_lines(docs)
    got = {r["doc_id"]: r for r in line_dedup.line_dedup(frame(spark, list(docs.values()))).collect()}
    assert sum(map(len, gone.values())) > 20
    for i, text in docs.items():
        assert got[i]["text"] == left_over(text, gone[i]) and got[i]["deleted_lines"] == len(gone[i])
        assert got[i]["n_lines"] == sum(len(re.split(f"(?<=[{line_dedup.MARKS}]) ", x)) for x in text.split("\n"))


def test_the_first_copy_of_a_run_stays(spark):
    line = "ten words stand in each of all these equal lines"
    long = " ".join(f"w{k}" for k in range(60))
    texts = ["\n".join([line + " x"] * 10), "start. " + "A b c. " * 20 + long + ". end", "other\nhead. " + "A b c. " * 20 + long + ".\ntail"]
    got = {r["doc_id"]: (r["text"], r["deleted_lines"]) for r in line_dedup.line_dedup(frame(spark, texts)).collect()}
    assert got[0] == ("\n".join([line + " x"] * 5), 5)
    assert got[1] == (texts[1], 0)  # 60 words of short lines hold no two runs of 50
    assert got[2] == ("other\nhead.\ntail", 21)


def test_line_dedup_is_linear_in_a_long_text(spark):
    lines = [f"line number {k} of a long text that stands twice in the table" for k in range(60_000)]
    docs = frame(spark, ["\n".join(lines), "\n".join(["first"] + lines + ["last"]), "same line again and again\n" * 40_000])
    got = {r["doc_id"]: r for r in line_dedup.line_dedup(docs).collect()}
    assert got[0]["deleted_lines"] == 0 and got[1]["text"] == "first\nlast" and got[2]["deleted_lines"] == 40_000 - 10


def test_extension_needs_equal_lines():
    mine, source = np.array([9, 1, 2, 3, 4, 8]), np.array([7, 1, 2, 3, 4, 7])
    assert line_dedup.extend(mine, source, [(2, 3, 2)]) == [(1, 4)]
    assert line_dedup.extend(mine, source, [(2, 3, 1)]) == [] and line_dedup.extend(mine, source, [(4, 5, 5)]) == []


def test_line_dedup_on_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(60))
    docs = frame(spark, [*ODD, long, long, "head\n" + long + "\ntail"], [*range(len(ODD)), None, 90, 91])
    docs = docs.union(docs.where("doc_id = 91"))
    for c in ("n_lines", "row", "runs", "key", "cut", "_row", "_lines"):
        docs = docs.withColumn(c, docs["doc_id"])
    got = line_dedup.line_dedup(docs).collect()
    assert len(got) == docs.count()
    by = collections.defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r["text"])
        assert r["row"] == r["runs"] == r["key"] == r["cut"] == r["doc_id"]
    assert by[90] == [""] and by[91] == ["head\ntail"] * 2 and by[None] == [long] and by[0] == [None]
    assert line_dedup.line_dedup(docs.limit(0)).count() == 0
    out = line_dedup.deduped(docs)
    assert out.columns == docs.columns and all(r["n_lines"] == r["doc_id"] for r in out.collect())


# --- BPE and the token store ---


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(bpe.vocabulary_path())


def library_ids(codec, text):
    return codec.library.encode(text or "", add_special_tokens=False).ids


def test_bpe_on_odd_rows_and_the_table(spark, codec, given):
    texts = [*ODD, *(r["text"] for r in given.collect())]
    got = {r["doc_id"]: r for r in bpe.round_trip(frame(spark, texts)).collect()}
    for i, text in enumerate(texts):
        ids = library_ids(codec, text)
        assert got[i]["n_tokens"] == len(ids) and got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(codec.library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.round_trip(frame(spark, texts).limit(0)).count() == 0
    back = bpe.decode(bpe.encode(frame(spark, texts)))
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {i: t or "" for i, t in enumerate(texts)}


def test_bpe_joins_and_reuse(codec):
    rng = random.Random(5)
    bits = ["a", "é", " ", "  ", "\n", "'s", " ", "日本", "<|endoftext|>", "1", "!", "x" * 300, "\r\n", "\x1c", "😀", "don't", " "]
    for _ in range(400):
        text = "".join(rng.choice(bits) for _ in range(rng.choice([3, 30, 600])))
        assert codec.encode(text) == np.array(library_ids(codec, text), "<u4").tobytes()
    before = codec.reused
    shared = " ".join(rng.choice(["some", "words", "here,", "again"]) + str(rng.random()) for _ in range(2000))
    codec.encode("First " + shared)
    codec.encode("Another beginning. " + shared)
    assert codec.reused > before


def test_token_store(spark, codec, given):
    docs = frame(spark, [*ODD, *(r["text"] for r in given.limit(100).collect())])
    docs = docs.union(frame(spark, ["twice", "twice", "no id"], [7, 7, None]))
    folder = new_path(spark, "tokens")
    token_store.write_store(docs, folder)
    index = token_store.store_index(spark, folder).orderBy("start").collect()
    texts = collections.defaultdict(list)
    for r in docs.collect():
        texts[r["doc_id"]].append(r["text"])
    assert [r["doc_id"] for r in index] == sorted((i for i, v in texts.items() for _ in v), key=lambda i: (i is not None, i))
    start = 0
    for r in index:
        assert r["start"] == start
        start += r["n_tokens"]
        arrays = [np.array([*library_ids(codec, t), token_store.END_ID], "<u4").tobytes() for t in texts[r["doc_id"]]]
        assert (r["n_tokens"], r["ids_crc32"]) in [(len(a) // 4, zlib.crc32(a)) for a in arrays]
    one = token_store.read_store(spark, folder, [5]).collect()
    assert len(one) == 1 and codec.decode(bytes(one[0]["ids"])[:-4]) == ODD[5]
    empty = new_path(spark, "tokens")
    token_store.write_store(docs.limit(0), empty)
    assert token_store.store_index(spark, empty).count() == 0


def test_token_store_of_long_texts_has_a_dictionary(spark, codec):
    rng = random.Random(6)
    words = [f"word{k}" for k in range(300)]
    docs = frame(spark, [" ".join(rng.choices(words, k=10_000)) for _ in range(40)])
    folder = new_path(spark, "tokens")
    token_store.write_store(docs, folder)
    head = spark.read.parquet(f"{folder}/dictionary").head()
    assert head["kind"] == "trained" and len(head["dictionary"]) > 4096
    back = {r["doc_id"]: bytes(r["ids"]) for r in token_store.read_store(spark, folder, [3, 39, 77]).collect()}
    assert {i: codec.decode(x[:-4]) for i, x in back.items()} == {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] in (3, 39)}
    assert token_store.read_store(spark, folder, []).count() == 0
    few = new_path(spark, "tokens")
    token_store.write_store(docs.limit(3), few)
    assert spark.read.parquet(f"{few}/dictionary").head()["kind"] == "raw" and token_store.store_index(spark, few).count() == 3


def test_dictionary_is_trained_whatever_the_ids(spark):
    """One id for all documents, thousands of copies of one of them, and any order give a trained, equal dictionary."""
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(60)) for _ in range(300)] + ["copy of a text " * 20] * 2000
    docs = frame(spark, texts, [7] * len(texts))
    path = bpe.vocabulary_path()
    one, two = token_store.train_dictionary(docs, path), token_store.train_dictionary(docs.repartition(9).orderBy(F.rand(3)), path)
    assert one == two and one[1] == "trained"
    assert token_store.train_dictionary(docs.limit(0), path) == (b"", "none")
    folder = new_path(spark, "same")
    token_store.write_store(docs, folder)
    assert token_store.store_index(spark, folder).count() == len(texts)


def test_dictionary_saves_bytes_of_short_documents(spark, codec, given):
    import zstandard

    folder = new_path(spark, "tokens")
    docs = given.where("n_chars < 2000")
    token_store.write_store(docs, folder)
    stored = spark.read.parquet(f"{folder}/blocks").agg(F.sum(F.octet_length("payload"))).head()[0]
    plain = sum(len(zstandard.compress(token_store._serial(r["text"], bpe.vocabulary_path(), 2), token_store.LEVEL)) for r in docs.collect())
    assert stored < 0.8 * plain


def test_only_known_kinds_of_vocabulary_are_encoded(codec):
    import json

    with open(bpe.vocabulary_path(), encoding="utf-8") as f:
        file = json.load(f)
    bpe.refuse_other_kinds(file, "here")
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": file["pre_tokenizer"] | {"add_prefix_space": True}}, {"model": file["model"] | {"type": "Unigram"}}, {"model": file["model"] | {"dropout": 0.1}}):
        with pytest.raises(ValueError):
            bpe.refuse_other_kinds(file | change, "here")


def test_encoding_keeps_clashing_columns_and_long_texts(spark, codec):
    long = "A clean sentence, once more. " * 100_000
    docs = frame(spark, [long, "b", None]).withColumnRenamed("lang", "_text").withColumn("c0", F.lit(7)).withColumn("ids", F.lit("own")).withColumn("frame", F.lit("f"))
    got = bpe.encode(docs, carry=tuple(docs.columns))
    rows = {r["doc_id"]: r for r in got.collect()}
    assert bytes(rows[0]["ids"]) == np.array(library_ids(codec, long), "<u4").tobytes() and rows[2]["n_tokens"] == 0
    assert all((r["_text"], r["c0"], r["source"]) == ("en", 7, "s") for r in rows.values())
    back = bpe.decode(got, carry=("doc_id", "text", "_text"))
    assert {r["doc_id"]: (r["text"], r["_text"]) for r in back.collect()} == {0: (long, "en"), 1: ("b", "en"), 2: ("", "en")}
    assert {r["doc_id"]: r["n_tokens"] for r in bpe.round_trip(docs).collect()} == {i: r["n_tokens"] for i, r in rows.items()}
    folder = new_path(spark, "tokens")
    token_store.write_store(docs, folder)
    assert {r["doc_id"]: r["n_tokens"] - 1 for r in token_store.store_index(spark, folder).collect()} == {i: r["n_tokens"] for i, r in rows.items()}


# --- Media ---


def png():
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def bmp():
    return struct.pack("<2sIIIIiiHHIIiiII", b"BM", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + bytes(4)


GIF = b"GIF89a\x01\x00\x01\x00\x80\x00\x00\x00\x00\x00\xff\xff\xff!\xf9\x04\x01\x00\x00\x00\x00,\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x02D\x01\x00;"
PDF = b"%PDF-1.4\n1 0 obj\n<<>>\nendobj\nstartxref\n9\n%%EOF"


def zipped():
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "hello")
    return out.getvalue()


KINDS = [("image/png", png()), ("image/bmp", bmp()), ("image/gif", GIF), ("application/pdf", PDF), ("application/zip", zipped()), ("application/gzip", gzip.compress(b"x" * 5000)), ("audio/wav", media.to_wav(bytes(64)))]


@pytest.mark.parametrize("kind,data", KINDS)
def test_formats_whole_embedded_and_broken(kind, data):
    assert media.sniff(data + b"tail")[:2] == (kind, len(data))
    whole, _, inside = media.sniff(b"junk" + data + b"tail")
    assert whole is None and (kind, 4, len(data)) in inside
    assert media.sniff(data[: len(data) - 3])[0] != kind
    assert media.sniff(b"BM RIFF GIF89a %PDF- PK\x03\x04 \xff\xd8\xff OggS") == (None, 0, [])


def test_sniffing_column(spark):
    items = spark.createDataFrame([(1, bytearray(png()), "image/gif"), (2, bytearray(b"x" + GIF), "text/plain"), (3, None, None), (4, bytearray(b""), "a/b")], "id int, content binary, declared string")
    got = {r["id"]: r for r in media.sniff_media(items, declared="declared", carry=("id",)).collect()}
    assert (got[1]["media_type"], got[1]["declared_right"]) == ("image/png", False)
    assert bytes(got[2]["embedded"][0]["content"]) == GIF and got[2]["media_type"] == "text/plain"
    assert got[3]["media_type"] is None and got[4]["embedded"] == []


def test_sniffing_is_linear_and_keeps_names(spark):
    many = b"%PDF-1 PK\x03\x04 " * 60_000
    assert media.sniff(many) == (None, 0, [])
    assert [k for k, _, _ in media.sniff(many + PDF + zipped())[2]].count("application/zip") == 1
    items = spark.createDataFrame([(1, bytearray(png()), "image/gif", "x")], "content_id int, said binary, media_type string, c0 string")
    r = media.sniff_media(items, content="said", declared="media_type", carry=("content_id", "c0")).head()
    assert (r["content_id"], r["c0"], r["media_type"], r["declared_right"]) == (1, "x", "image/png", False)
    held = media.media_features(media.store_texts(frame(spark, ["GIF89a" + "x" * 3_000_000, None]).withColumn("media", F.lit(1)).withColumn("payload_bytes", F.lit(2)))).collect()
    assert sorted(r["payload_bytes"] for r in held) == [64, 3_000_064]


def test_media_round_trip(spark, given):
    texts = [*ODD, *(r["text"] for r in given.limit(50).collect())]
    got = {r["doc_id"]: r for r in media.media_features(media.store_texts(frame(spark, texts))).collect()}
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r["media_sha256"] == hashlib.sha256(media.to_wav(payload)).hexdigest()
    assert media.media_features(media.store_texts(frame(spark, texts).limit(0))).count() == 0


# --- Language models ---


def test_scores_by_brute_force(spark):
    texts = ["good words are good words", "bad bad bad", None, "", "good words", "good words"]
    docs = frame(spark, texts, [1, 2, 3, 4, 5, 5])
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1)], "doc_id long, quality int")
    model = lm_scoring.fit(docs, labels)
    ids = [1, 2, 3, 4, 5, 5]
    assert model[:, : lm_scoring.WORDS].sum(axis=1).tolist() == [5, 5 + 3 + 2 + 2]
    got = sorted(lm_scoring.score(docs, model).collect(), key=lambda r: r["doc_id"])
    for k, r in enumerate(got):
        words = (texts[k] or "").split()
        assert r["doc_id"] == ids[k] and r["n_tokens"] == len(words)
        if words:  # each model without this row
            means = [brute_loss(words, [t for i, t in enumerate(texts) if i != k and (m or ids[i] == 1)], 5 / 12 if m else 1) for m in (0, 1)]
            assert [r["target_loss"], r["background_loss"], r["difference"]] == pytest.approx([*means, means[0] - means[1]])
        else:
            assert r["difference"] is None
    assert lm_scoring.score(docs.limit(0), lm_scoring.fit(docs.limit(0), labels)).count() == 0
    clash = docs.withColumn("_good", F.lit(1)).withColumn("_chunk", F.lit(1)).withColumn("n_tokens", F.lit(1))
    again = lm_scoring.score(clash, lm_scoring.fit(clash, labels.withColumn("_good", F.lit(0))))
    assert sorted(again.collect(), key=lambda r: r["doc_id"]) == got


def brute_loss(words, texts, scale=1.0):
    count, pair = collections.Counter(), collections.Counter()
    for t in texts:
        count.update((t or "").split())
        pair.update(zip((t or "").split(), (t or "").split()[1:]))
    total, out = count.total() * scale, []
    for v, w in zip([None, *words], words):
        out.append(-np.log((pair[v, w] * scale + lm_scoring.PRIOR * (count[w] * scale + lm_scoring.ADD) / (total + lm_scoring.ADD * lm_scoring.WORDS)) / (count[v] * scale + lm_scoring.PRIOR)))
    return np.mean(out)


@pytest.mark.parametrize("n, most, fan, levels", [(1, 8, 1, 1), (8, 8, 8, 1), (9, 8, 3, 2), (64, 8, 8, 2), (65, 8, 5, 3), (10**6, 2048, 1000, 2)])
def test_exchange_of_many_chunks(n, most, fan, levels):
    got = lm_scoring.Exchange.of(n, most)
    assert (got.levels, got.fan <= most + 1, got.fan**got.levels >= n) == (levels, True, True)
    assert got.fan - fan in (0, 1)  # roots are rounded up


def test_scores_are_the_same_in_any_number_of_steps(spark, given, monkeypatch):
    """Both ways of scoring: the fitted table, and a table that the models haven't seen."""
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    docs = given.where("doc_id % 2 = 0").unionByName(frame(spark, ODD, [10**6 + i for i in range(len(ODD))]))
    other = given.where("doc_id % 2 = 1")

    def scores():
        model = lm_scoring.fit(docs, labels)
        rows = [lm_scoring.score(x, model).collect() for x in (docs, other)]
        return [sorted(map(tuple, x), key=lambda r: r[0]) for x in rows]

    once = scores()
    assert len(once[0]) == docs.count() and len(once[1]) == other.count()
    for fan in (3, 2):  # eight chunks: two steps, three steps
        monkeypatch.setattr(lm_scoring, "FAN", fan)
        assert scores() == once


def test_packs_grow_with_the_chunks(spark, given):
    """Doubling the chunks at most doubles the packs of each chunk's step."""
    labels = spark.createDataFrame([(0,)], "_good long")
    for n in (16, 64, 256):
        exchange = lm_scoring.Exchange.of(n, 4)
        packs = lm_scoring.sent(lm_scoring.chunked(given, n), lm_scoring.good_ids(labels, n), exchange, True, True)
        assert 0 < packs.count() <= n * exchange.fan


def test_a_text_that_stands_twice_is_scored_apart(spark):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(200)]
    texts = [" ".join(rng.choices(words, k=120)) for _ in range(60)]
    docs = frame(spark, [*texts, texts[7]])
    labels = spark.createDataFrame([(k, 1) for k in range(20, 40)], "doc_id long, quality int")
    got = {r["doc_id"]: r["background_loss"] for r in lm_scoring.score(docs, lm_scoring.fit(docs, labels)).collect()}
    assert max(got[7], got[60]) < min(v for k, v in got.items() if k not in (7, 60))


def test_scores_of_a_long_text(spark):
    long = " ".join(f"w{k % 5000}" for k in range(400_000))
    docs = frame(spark, [long, "w1 w2 w3", long])
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    got = {r["doc_id"]: (r["n_tokens"], r["difference"]) for r in lm_scoring.score(docs, lm_scoring.fit(docs, labels)).collect()}
    assert got[0] == got[2] and got[0][0] == 400_000 and got[1][0] == 3


def test_scores_tell_held_out_quality(spark):
    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no tables")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = lm_scoring.fit(docs, labels.where("doc_id % 2 = 0"))
    once = docs.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).where("n = 1").select("doc_id")  # copies are scored apart
    held = lm_scoring.score(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").join(once, "doc_id").where("n_tokens > 0").toPandas()
    good, bad = held[held.quality == 1].difference.to_numpy(), held[held.quality == 0].difference.to_numpy()
    assert (good[:, None] < bad[None, :]).mean() > 0.8


def test_scores_share_no_counts(spark):
    """Words whose hashes agree, in documents of other fits too, against exact counts."""
    seen = {}
    a, b = next((seen[h], w) for w in map("w{}".format, range(10**6)) if seen.setdefault(h := zlib.crc32(w.encode()) % lm_scoring.WORDS, w) != w)
    texts = [f"{a} {a} x {a} {a} x", "x y", f"{b} {b} x"]
    docs, labels = frame(spark, texts), spark.createDataFrame([(0, 1)], "doc_id long, quality int")
    held = frame(spark, [f"{b} {b} x {b} unseen", None], [None, 2**60 + 1])
    model = lm_scoring.fit(docs, labels)
    scale = len(texts[0].split()) / sum(len(t.split()) for t in texts)
    for k, r in enumerate(sorted(lm_scoring.score(docs, model).collect(), key=lambda r: r["doc_id"])):
        rest = [t for i, t in enumerate(texts) if i != k]
        assert [r["target_loss"], r["background_loss"]] == pytest.approx([brute_loss(texts[k].split(), texts[:1] if k else []), brute_loss(texts[k].split(), rest, scale)])
    for r in lm_scoring.score(held, model).collect():
        words = (f"{b} {b} x {b} unseen" if r["doc_id"] is None else "").split()
        assert [r["target_loss"], r["background_loss"]] == (pytest.approx([brute_loss(words, texts[:1]), brute_loss(words, texts, scale)]) if words else [None, None])


# --- Near duplicates ---


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def brute_similarity(a, b):
    x, y = (list(zip(*(w[i:] for i in range(5)))) if len(w) >= 5 else [tuple(w)] for w in ((a or "").split(), (b or "").split()))
    n = lcs(x, y)
    return n / (len(x) + len(y) - n)


def mutated(rng, words, n):
    words = list(words)
    for _ in range(n):
        k = rng.randrange(len(words))
        words[k : k + 1] = rng.choice([[], ["new" + str(rng.random())], [words[k], "put"]])
    return words


def test_alignment_by_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        words = [rng.choice("abcdefghij") + rng.choice("xyz") for _ in range(rng.randint(1, 80))]
        a, b = " ".join(words), " ".join(mutated(rng, words, rng.randint(0, 3)))
        exact = brute_similarity(a, b)
        assert near_dedup.similarity(a, b) == pytest.approx(exact if exact >= 0.8 else 0)
        assert (near_dedup.compare(a, b) >= 0.8) == (exact >= 0.8)
        for band in (1, 3, 200):
            x, y = near_dedup.shingles(a), near_dedup.shingles(b)
            assert near_dedup.aligned(x, y, band) <= lcs(x.tolist(), y.tolist())
        assert near_dedup.aligned(x, y, 200) == lcs(x.tolist(), y.tolist())


def test_moved_and_repeated_passages_align():
    words = [f"w{k}" for k in range(200)]
    twice = ["the same six words once more"] * 9
    for a, b in ((words[100:] + words[:100], words), (words + twice, twice[:4] + words + twice), (twice + words, words + twice), (words, words[:90] + ["x"] + words[90:])):
        a, b = " ".join(a), " ".join(b)
        exact = brute_similarity(a, b)
        assert near_dedup.similarity(a, b) == pytest.approx(exact if exact >= 0.8 else 0) and (near_dedup.compare(a, b) >= 0.8) == (exact >= 0.8)


def classes(texts, same):
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if same(texts[i], texts[j]):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {}
    for i, x in enumerate(label):
        least.setdefault(x, i)
    return [least[x] for x in label]


def test_classes_by_brute_force(spark):
    rng = random.Random(2)
    texts = []
    for size in (6, 12, 30, 80, 200):
        for _ in range(6):
            base = [f"w{rng.randrange(5000)}" for _ in range(size)]
            texts += [" ".join(mutated(rng, base, n)) for n in (0, 1, 2, size // 30, size // 12)]
    texts += [texts[0], texts[0].replace(" ", "\n"), "", " ", "one two", "two one"]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(frame(spark, texts)).collect()}
    expected = classes([t for t in texts], lambda a, b: brute_similarity(a, b) >= 0.8)
    assert [got[i] for i in range(len(texts))] == expected


def test_a_large_star_of_copies_is_one_class(spark):
    rng = random.Random(4)
    base = [f"w{k}" for k in range(150)]
    texts = [" ".join(base)] + [" ".join(mutated(rng, base, 2)) for _ in range(120)] + [" ".join(f"v{k}" for k in range(100))]
    docs = frame(spark, texts)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs).collect()}
    assert [got[i] for i in range(len(texts))] == classes(texts, lambda a, b: near_dedup.similarity(a, b) >= 0.8)
    kept = near_dedup.without_near_duplicates(docs).collect()
    assert {r["doc_id"] for r in kept} == set(got.values()) and len(kept) == len(set(got.values()))


def test_pairs_that_share_one_bucket_are_compared(spark, monkeypatch):
    """Two similar texts whose only common bucket has a third as its pivot."""
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(words), " ".join(words[:-2]), " ".join(f"v{k}" for k in range(60)), " ".join(f"u{k}" for k in range(60))]
    buckets = dict(zip(texts, ([1, 11], [1, 12], [1, 2, 3], [2, 3])))
    monkeypatch.setattr(near_dedup, "sketch", lambda t: (len(near_dedup.shingles(t)), buckets[t]))
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(frame(spark, texts)).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3}


def test_recall_of_all_similar_pairs_of_the_table(spark, given):
    """Every pair of ``documents`` that brute force finds similar lies in one class, and no class holds an unlinked text."""
    texts = {r["doc_id"]: r["text"] for r in given.collect()}
    ids = sorted(texts)
    label = {i: i for i in ids}
    grams = {i: set(near_dedup.kmers(texts[i]).tolist()) for i in ids}
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if 9 * len(grams[a] & grams[b]) >= 4 * (len(grams[a]) + len(grams[b])) - 1e-9]
    links = [(a, b) for a, b in links if brute_similarity(texts[a], texts[b]) >= 0.8]
    for a, b in links:
        old, new = max(label[a], label[b]), min(label[a], label[b])
        label = {i: new if x == old else x for i, x in label.items()}
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(given).collect()}
    found = sum(got[a] == got[b] for a, b in links)
    assert links and found >= 0.9 * len(links) and got == label


def test_prefix_filter_loses_no_similar_pair(spark):
    """A group whose members mostly stay apart: the pairs left open hold every similar pair of different classes."""
    rng = random.Random(7)
    base = [f"w{k}" for k in range(120)]
    texts = [" ".join(mutated(rng, base, rng.choice([1, 2, 3, 4, 5, 8]))) for _ in range(90)]
    nodes = spark.createDataFrame([(i, len(near_dedup.kmers(t)), i, t) for i, t in enumerate(texts)], "node long, n long, label long, text string")
    scratch = near_dedup.Scratch(spark)
    got = {(r["a"], r["b"]) for r in near_dedup._open_pairs(nodes.drop("text"), nodes.select("node", "text"), scratch).collect()}
    scratch.clear()
    similar = {(a, b) for b in range(90) for a in range(b) if brute_similarity(texts[a], texts[b]) >= 0.8}
    assert similar and similar <= got and len(got) < 90 * 89 // 4


def test_near_duplicates_keep_columns_and_long_texts(spark):
    rng = random.Random(8)
    words = [f"w{rng.randrange(10**6)}" for _ in range(120_000)]
    long = [" ".join(words), " ".join(words[:60_000] + ["put", "in"] + words[60_000:]), " ".join(words[60_000:] + words[:60_000])]
    rows = [(i, t, f"n{i}", f"k{i}", i) for i, t in enumerate([*long, "a b", "a b", None])]
    docs = spark.createDataFrame(rows + [(3, "a b", "n9", "k9", 9), (3, "a b", "n3", "k3", 3)], "doc_id long, text string, _node string, key string, row long")
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3, 4: 3, 5: 5}
    kept = [sorted((r["doc_id"], r["_node"], r["key"], r["row"]) for r in near_dedup.without_near_duplicates(d).collect()) for d in (docs, docs.repartition(5, "row"))]
    assert kept[0] == kept[1] and [x[0] for x in kept[0]] == [0, 2, 3, 5] and all(x[1:] in [(f"n{k}", f"k{k}", k) for k in (x[0], 9)] for x in kept[0])
    assert near_dedup.without_near_duplicates(docs).columns == docs.columns


def test_near_duplicates_on_odd_rows(spark):
    docs = frame(spark, ODD, [5, 5, 1, None, 2, 3, 4, 5])
    docs = docs.union(docs)
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == 2 * len(ODD)
    assert {r["class_id"] for r in got if r["doc_id"] in (5, 1)} == {1} and {r["class_id"] for r in got if r["doc_id"] is None} == {None}
    kept = near_dedup.without_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == 5
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_near_pairs(spark, monkeypatch):
    """The links have the similarity of their texts and make the classes; a large group meets its hub in several parts."""
    monkeypatch.setattr(near_dedup, "PARTNERS", 3)
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    bases = [rng.choice(words, 120).tolist() for _ in range(3)]
    texts = []
    for k in range(40):
        edited = list(bases[k % 3] if k % 10 else rng.choice(words, 60).tolist())
        edited[int(rng.integers(len(edited)))] = f"x{k}"
        texts.append(" ".join(edited))
    texts += [texts[1], texts[2], "", None, "one"]
    docs = frame(spark, texts)
    found = near_dedup.near_pairs(docs).collect()
    for r in found:
        assert r["a"] < r["b"] and r["similarity"] == pytest.approx(near_dedup.similarity(texts[r["a"]], texts[r["b"]])) and r["similarity"] >= 0.8
    assert len({(r["a"], r["b"]) for r in found}) == len(found) >= 30
    label = list(range(len(texts)))
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs).collect()}
    first = {t or "": i for i, t in reversed(list(enumerate(texts)))}
    for _ in range(len(texts)):
        for r in found:
            label[r["b"]] = label[r["a"]] = min(label[r["a"]], label[r["b"]])
    assert [got[i] for i in range(len(texts))] == [label[first[t or ""]] for t in texts]
    assert near_dedup.near_pairs(docs.limit(0)).count() == 0


def test_pipeline_stages(spark):
    folder = FOLDER
    if not os.path.isdir(folder):
        pytest.skip("no tables")
    import corpus_pipeline
    from tidemark.llm import mixing, quality_rules
    from tidemark.llm.common import stash

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(stash(stage(spark, steps[-1], folder), "stage"))
    texts = [{r["doc_id"]: r["text"] for r in d.collect()} for d in steps[:4]]
    judged = {i: quality_rules.judge(t) for i, t in texts[0].items()}
    assert texts[1] == {i: j[-1] for i, j in judged.items() if j[6]}
    gone = brute_lines(texts[1])
    assert texts[2] == {i: left_over(t, gone[i]) for i, t in texts[1].items()}
    ids = sorted(texts[2])
    sets = [set(near_dedup.shingles(texts[2][i]).tolist()) for i in ids]
    index = collections.defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            index[x].append(k)
    close = {(a, b) for group in index.values() if len(group) < 40 for a in group for b in group if a < b and near_dedup.similarity(texts[2][ids[a]], texts[2][ids[b]]) >= 0.8}
    close |= {(a, b) for a in range(len(ids)) for b in range(a + 1, len(ids)) if sets[a] == sets[b]}
    label = list(range(len(ids)))
    for a, b in sorted(close):
        old, new = max(label[a], label[b]), min(label[a], label[b])
        label = [new if x == old else x for x in label]
    assert sorted(texts[3]) == [ids[k] for k in sorted(set(label))]
    taken = {r["doc_id"]: r for r in mixing.mix(steps[3]).collect()}
    mixed = collections.Counter(r["doc_id"] for r in steps[4].collect())
    assert all(r["taken"] == r["size"] * mixed[i] for i, r in taken.items())
    own = bpe.codec(bpe.vocabulary_path())
    for r in steps[5].collect():
        assert r["ids_sha256"] == hashlib.sha256(own.encode(texts[3][r["doc_id"]])).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((texts[3][r["doc_id"]] or "").encode()).hexdigest()
    assert steps[5].count() == sum(mixed.values())


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Null, empty and repeated rows, a null id and source, and columns named as the operators name theirs."""
    import corpus_pipeline

    words = [f"stem{i}" for i in range(400)]
    prose = [". ".join(" ".join(random.Random(100 * k + i).sample(words, 12)).capitalize() for i in range(9)) + "." for k in range(4)]
    given = [
        (1, prose[0], "a"), (1, prose[0], "a"), (2, prose[1], None), (None, prose[2], "b"),
        (4, prose[0], "b"), (5, None, "a"), (6, "", "b"), (7, "too short.", None), (8, prose[3], "a"),
    ]
    schema = "doc_id long, text string, source string"
    plain = spark.createDataFrame(given, schema)
    names = ["row", "label", "node", "one", "two", "_range", "taken", "size", "n_words", "kept", "copy", "key"]
    clash = plain.withColumns({c: F.lit("own") for c in names})
    found = []
    for k, docs in enumerate((plain, clash, plain.limit(0))):
        docs.coalesce(1).write.parquet(f"{tmp_path}/{k}/documents.parquet")
        rows = corpus_pipeline.run(spark, f"{tmp_path}/{k}").select("doc_id", "n_tokens", "decoded_sha256").collect()
        found.append(collections.Counter(map(tuple, rows)))
    assert found[0] == found[1] and not found[2]
    # Rejected rows go, equal rows leave one, and document 4 has lost its lines to document 1: it stays, as an empty text.
    left = {1: prose[0], 2: prose[1], None: prose[2], 4: "", 8: prose[3]}
    left = {(i, hashlib.sha256(t.encode()).hexdigest()) for i, t in left.items()}
    assert found[0] and {(i, digest) for i, _, digest in found[0]} <= left
    assert all(n <= 2 for n in found[0].values())


def test_classes_of_a_key_are_found_without_a_join(spark):
    rows = spark.createDataFrame([(b, i, i % 2 if b else 0) for b in range(2) for i in range(50)], "bucket long, node long, label long")
    mixed = near_dedup._mixed(rows, ["bucket"])
    assert {r["bucket"] for r in mixed.collect()} == {1} and mixed.count() == 50 and mixed.columns == rows.columns
    assert "Join" not in mixed._jdf.queryExecution().optimizedPlan().toString()
