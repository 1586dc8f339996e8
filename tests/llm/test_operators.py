"""The corpus operators against brute force, exact round trips and held-out accuracy, and their edge cases."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weekloom.llm import contamination, language, licenses, linefreq, minhash, neurallm, pieces, quality, tokenbin, warc
from weekloom.llm import wordbytes as wb
from weekloom.llm.queries import BYTE_VOCABULARY, PIECE_MODEL

DATA = "/root/testdata/sf0.001"
LONG = "word another thing here " * 5000
ODD = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (4, "one"), (None, "one two three four five six"), (5, LONG), (6, "été ÇA 日本語 x 😀"), (7, "A B\x0bC\x0cD\rE")]


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")


def shingles(text, width=5):
    w = split(lower(text))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names the operators use."""
    rows = spark.createDataFrame(ODD, "doc_id long, text string")
    return rows.withColumns({"source": F.lit("s"), "n_words": F.lit("x"), "component_id": F.lit(1.5), "row": F.lit(0), "host": F.lit(None).cast("string"), "lines": F.lit(3), "score": F.lit("s"), "ids": F.lit(2)})


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


def test_word_hashes_follow_the_words():
    text = "Aa bB\tcc\n\n dd aa é É"
    w = wb.words(next(wb.slices(pa.array([text]))))
    words = split(lower(text))
    assert [text.encode()[a:b].decode().lower()[:1] for a, b in zip(w.start, w.end, strict=True)] == [x[:1].lower() for x in words]
    assert (w.hash[0] == w.hash[4]) and len(set(w.hash.tolist())) == len(set(words))


def test_shingles_of_a_slice_are_those_of_its_rows():
    texts = ["a b c d e f a b c d e f", "", "x y", None, "a b c d e f"]
    part = next(wb.slices(pa.array(texts)))
    doc, _ = wb.shingle_keys(wb.words(part), len(texts))
    assert np.bincount(doc, minlength=5).tolist() == [len(shingles(t)) for t in texts]


def test_base_counts_equal_brute_force(spark, documents, odd):
    extra = [(50, " ".join(random.Random(3).choices("abcd", k=400))), (51, "a b c a b c"), (52, "x\nx\n \n\nx y\n"), (53, "a a a a")]
    rows = documents.select("doc_id", "text").union(odd.select("doc_id", "text").where("doc_id IS NOT NULL").distinct()).union(spark.createDataFrame(extra, "doc_id long, text string"))
    want = {}
    for i, t in rows.withColumn("doc_id", F.xxhash64("doc_id", "text")).collect():
        w = split(t)
        seen = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {k + j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if split(x)]
        want[i] = (len(w), sum(map(len, w)), sum((t or "").count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
    got = {r[0]: tuple(r)[1:6] for r in quality.parsed(rows.withColumn("doc_id", F.xxhash64("doc_id", "text")), 64).collect()}
    assert got == want


def test_quality_scores_equal_brute_force(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "a c"), (3, "z z z z"), (4, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (3, 0), (None, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.quality_rules(docs, labels, buckets=1 << 16, min_words=1, threshold=0.0).collect()}
    grams = {1: ["a", "b", "a", "ab", "ba"], 2: ["a", "c", "ac"], 3: ["z"] * 4 + ["zz"] * 3}
    raw, target, n = Counter(sum(grams.values(), [])), Counter(grams[1]), 1 << 16
    for i, g in grams.items():
        s = sum(math.log((target[x] + 1) / (5 + n)) - math.log((raw[x] + 1) / (15 + n)) for x in g) / len(g)
        assert got[i].score == pytest.approx(s, abs=1e-8)
    assert got[4].score == 0 and got[4].base_failed and not got[4].kept


def test_quality_separates_labelled_documents(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.quality_rules(docs, labels).join(labels, "doc_id").where("not base_failed")
    r = rows.agg(F.avg(F.when(F.col("quality") == 1, F.col("kept").cast("int"))).alias("good"), F.avg(F.when(F.col("quality") == 0, F.col("kept").cast("int"))).alias("bad")).first()
    assert r.good > 0.99 and r.bad < 0.2


def brute_components(texts, percent=85):
    sets = {i: shingles(t) for i, t in texts.items()}
    label = {i: i for i in sets}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return {i: (len(sets[i]), label[i]) for i in sets}


def test_near_duplicates_equal_brute_force(spark, documents):
    draw = random.Random(9)
    base = [f"w{draw.randrange(10**6)}" for _ in range(150)]
    texts = {r.doc_id: r.text for r in documents.collect()}
    for k in range(60):  # a group of near copies of many grades
        w = list(base)
        for _ in range(k % 7):
            w[draw.randrange(len(w))] = f"e{draw.randrange(10**6)}"
        texts[10_000 + k] = " ".join(w)
    texts |= {20_000: "Same Short", 20_001: "same short", 20_002: "", 20_003: None, 20_004: "one"}
    got = minhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute_components(texts)
    assert got.where("kept <> (doc_id = component_id)").count() == 0


def test_unlike_texts_of_one_document(spark):
    rows = [(1, "a b c d e f"), (5, "a b c d e f"), (5, "u v w x y z"), (9, "u v w x y z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.near_duplicates(docs).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(1, 1, True), (5, 1, False), (5, 5, True), (9, 5, False)]
    assert sorted(map(tuple, minhash.drop_near_duplicates(docs).collect())) == [(1, "a b c d e f"), (5, "u v w x y z")]


def test_a_hub_with_many_partners(spark, monkeypatch):
    monkeypatch.setattr(minhash, "HUB_PAIRS", 4)
    draw = random.Random(2)
    base = [f"w{draw.randrange(10**6)}" for _ in range(300)]
    texts = {k: " ".join([*base[: 150 + k % 3], f"e{k}", *base[151 + k % 3 :]]) for k in range(40)}
    got = minhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute_components(texts)


def test_near_duplicates_of_odd_rows(odd, nothing):
    got = minhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD)
    assert all(r.kept and r.component_id == r.doc_id for r in got)
    assert minhash.near_duplicates(nothing).count() == 0


def test_language_on_held_out_documents(spark):
    from weekloom.llm.queries import op3_language_id

    d = "/root/testdata/sf0.01"
    rows = op3_language_id(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 150 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_ranks_equal_brute_force():
    text = "Été été! the 1st THE"
    owner, _, count, rank, letters = language.ranked_grams(next(wb.slices(pa.array([text]))), None)
    runs = ["été", "été", "the", "st", "the"]
    grams = Counter(("_" + w + "_")[i : i + n] for w in runs for n in (1, 2, 3) for i in range(len(w) + 3 - n))
    del grams["_"]
    assert sorted(count, reverse=True) == sorted(grams.values(), reverse=True) and letters[0] == 14
    assert (np.diff(count) <= 0).all() and rank.tolist() == list(range(len(grams))) and set(owner) == {0}


def test_language_of_odd_rows(spark, documents, odd, nothing):
    profiles = language.fit_profiles(documents)
    got = [(r.doc_id, r.lang_pred) for r in language.identify(odd, profiles).collect()]
    assert len(got) == len(ODD) and {x for i, x in got if i in (1, 2, 3)} == {"und"}
    assert language.keep_identified(odd, profiles).columns == odd.columns
    assert language.identify(nothing, profiles).count() == 0
    empty = language.fit_profiles(nothing)
    assert {r.lang_pred for r in language.identify(odd, empty).collect()} == {"und"}
    assert language.keep_identified(odd, empty).count() == 0


@pytest.fixture(scope="module")
def table():
    return pieces.PieceTable(PIECE_MODEL)


def test_ids_equal_the_library(table):
    import pyarrow.parquet as pq
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()
    texts += ["  a  b ", "日本語\n\tx", "😀é", "y" * 70, "abcdefghij" * 700, "", None, "a\u2581b"]
    draw = random.Random(6)
    texts += ["".join(draw.choices("aeinrst ▁", k=300)) for _ in range(100)]
    for k in range(0, len(texts), 200):
        ids, counts = table.encode(pa.array(texts[k : k + 200]))
        ends = np.r_[0, np.cumsum(counts)]
        assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == model.encode([t or "" for t in texts[k : k + 200]])


def test_decoding_gives_the_text_back(odd, nothing, documents):
    rows = odd.select("doc_id", "text").union(documents.select("doc_id", "text")).where("text IS NOT NULL")
    assert pieces.encode_pieces(rows.withColumn("before", F.col("text")), PIECE_MODEL).select("decoded").exceptAll(rows.select("text")).count() == 0
    null = pieces.encode_pieces(odd.where("doc_id = 1"), PIECE_MODEL).first()
    assert list(null.ids) == [] and null.decoded == ""
    assert pieces.encode_pieces(nothing, PIECE_MODEL).count() == 0


def test_remembered_runs_change_nothing(documents):
    texts = pa.array([r.text for r in documents.limit(20).collect()])
    fresh, known = pieces.PieceTable(PIECE_MODEL), pieces.PieceTable(PIECE_MODEL)
    fresh.remembered = 0
    known.encode(texts)
    for a, b in zip(fresh.encode(texts), known.encode(texts), strict=True):
        assert (a == b).all()


def test_contained_items_equal_brute_force(spark, documents):
    items = spark.read.parquet(f"{DATA}/benchmark.parquet")
    extra = spark.createDataFrame([(900, "three little words"), (901, None), (902, ""), (None, "x y z"), (903, "lonely")], "item_id long, text string")
    long = spark.createDataFrame([(7000, LONG + " Three little WORDS " + LONG), (7001, "lonely"), (7002, None)], "doc_id long, text string")
    docs = documents.select("doc_id", "text").union(long)
    got = {(r.doc_id, r.item_id): (r.n_item_shingles, r.n_shared) for r in contamination.contained_items(docs, items.union(extra)).collect()}
    want = {}
    for i, t in [tuple(r) for r in items.union(extra).collect()]:
        width = min(5, len(split(t)))
        mine = shingles(t, width) if width else set()
        for d, x in [tuple(r) for r in docs.collect()]:
            w = split(lower(x))
            both = mine & {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if mine else set()
            if i is not None and mine and len(both) >= 0.8 * len(mine):
                want[d, i] = (len(mine), len(both))
    assert got == want and (7000, 900) in got and (7001, 903) in got
    kept = contamination.drop_contaminated(docs, items.union(extra))
    assert kept.columns == docs.columns and kept.count() == docs.count() - len({d for d, _ in want})


def test_contamination_of_odd_rows(spark, odd, nothing):
    none = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    assert contamination.contained_items(odd, none).count() == 0 and contamination.contained_items(nothing, one).count() == 0
    assert [(r.doc_id, r.item_id) for r in contamination.contained_items(odd, one).collect()] == [(None, 1)]
    assert contamination.drop_contaminated(odd, none).count() == len(ODD)


PAGES = [(5, "http://www.b.org/x?b=2&a=1#f", "<p>é</p>"), (3, "http://a.org/", "<p>é</p>"), (9, None, None), (8, "nonsense \n here", ""), (20, "http://h:99999/a\tb", "t"), (21, "http://[open\r\n/x", "u"), (22, "\x00\x7f", "v"), (23, "http://a.org/", "one"), (23, "http://a.org/", "two"), (4, "http://a.org:8080/Q", "other"), (None, "http://n.org", "<p>é</p>"), (12, "http://a.org/", "<p>é</p>"), (12, "http://a.org/", "<p>é</p>")]


def test_archives_give_every_page_back(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("key", F.lit(1)).withColumn("sha1", F.lit("x"))
    parts = warc.write_index(warc.write_archives(pages), block_lines=2)
    got = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.read_back(pages, parts).collect()}
    want = set()
    for i, _, html in PAGES:
        raw = (html or "").encode()
        first = min((j for j, _, h in PAGES if (h or "") == (html or "") and j is not None), default=None)
        again = i is not None and first != i
        want.add((i, "revisit" if again else "response", first if again else None, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode()))
    assert got == want
    index = warc.CaptureIndex(parts)
    assert index.find(b"zz") is None and index.find(warc.capture_key("http://a.org/", 77)) is None
    assert warc.parse_record(warc.record(1, "http://u", b"ab\r\n\r\nc", "D", None, "t"))[2] == b"ab\r\n\r\nc"


def test_no_pages_no_archive(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    parts = warc.write_index(warc.write_archives(pages))
    assert parts == [] and warc.read_back(pages, parts).count() == 0


def test_url_keys_reverse_the_host():
    assert warc.url_key("http://www.B.example.com/a?z=1&b=2#t") == "com,example,b)/a?b=2&z=1"
    assert warc.url_key("https://a.org:8080/") == "org,a:8080)/" and warc.url_key(None) == "-"


@pytest.mark.parametrize("values", [[], [0], [0, 0, 0], [5, 5, 900, 901, 10**6], sorted(random.Random(1).choices(range(10**5), k=3000)), list(range(1000))])
def test_elias_fano_selects_what_was_stored(values):
    v = np.array(values, np.int64)
    e = tokenbin.EliasFano.load(tokenbin.EliasFano.build(v, int(v[-1]) + 1 if len(v) else 1).dump())
    for a, b in ((0, len(v)), (0, 1), (255, 257), (256, 600), (len(v) - 1, len(v))):
        a, b = max(0, min(a, len(v))), max(0, min(b, len(v)))
        assert e.select(a, b).tolist() == v[a:b].tolist()


def test_token_files_equal_the_library(spark, documents, odd, nothing):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTE_VOCABULARY)
    rows = documents.select("doc_id", "text").union(odd.where("doc_id IS NOT NULL").select(F.col("doc_id") + 100_000, "text")).union(spark.createDataFrame([(999_999, "it's <|endoftext|> x  y　 z \n\n a")], "doc_id long, text string"))
    got = [tuple(r) for r in tokenbin.read_tokens(tokenbin.write_tokens(rows, BYTE_VOCABULARY), docs_per_read=50).orderBy("start").collect()]
    want, at = [], 0
    for i, t in sorted(map(tuple, rows.collect()), key=lambda r: (r[0], r[1] or "")):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    assert [r[0] for r in tokenbin.read_tokens(tokenbin.write_tokens(odd, BYTE_VOCABULARY)).orderBy("start").collect()][:2] == [None, 1]
    assert tokenbin.read_tokens(tokenbin.write_tokens(nothing, BYTE_VOCABULARY)).count() == 0


def test_patience_alignment():
    assert licenses.patience([1, 2, 3, 4], [9, 1, 2, 8, 3, 4]) == [(0, 1), (1, 2), (2, 4), (3, 5)]
    assert licenses.patience([1, 1, 2, 1], [1, 1, 5, 2, 1]) == [(0, 0), (1, 1), (2, 3), (3, 4)]
    assert licenses.patience([], [1]) == [] and licenses.patience([1], []) == []
    draw = random.Random(2)
    for _ in range(200):
        a, b = ([draw.randrange(6) for _ in range(draw.randrange(9))] for _ in range(2))
        met = licenses.patience(a, b)
        assert all(a[i] == b[j] for i, j in met) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(met, met[1:]))


def test_licenses_are_found_where_they_stand(spark, odd, nothing):
    mit = licenses.TEMPLATES["mit"]
    changed = mit.replace("deal in", "handle in")
    docs = spark.createDataFrame([(1, LONG + mit + LONG), (2, changed), (3, "released under the mit license"), (4, "the the under mit a license"), (5, "All rights reserved. " * 3), (6, mit + " " + mit)], "doc_id long, text string")
    got = {(r.doc_id, r.license): r for r in licenses.license_scan(docs).collect()}
    assert got[1, "mit"].coverage == 1 and got[1, "mit"].first_word == 20000
    assert 0.9 < got[2, "mit"].coverage < 1
    assert got[3, "mit-notice"].coverage == 1 and not [k for k in got if k[0] == 4]
    assert got[5, "all-rights-reserved"].first_word == 0
    assert got[6, "mit"].coverage == 1 and got[6, "mit"].first_word == 0
    assert licenses.license_scan(odd).count() == 0 and licenses.license_scan(nothing).count() == 0 and licenses.license_scan(docs, {}).count() == 0


@pytest.mark.parametrize("inserted", [1, 60, 120, 500])
def test_licenses_with_text_in_their_middle(inserted):
    known = licenses.make_templates({"mit": licenses.TEMPLATES["mit"]})
    words = re.findall(r"\w+", licenses.TEMPLATES["mit"].lower())
    assert len(words) == len(known[0].words)
    for at in range(len(words) + 1):
        for pad in (0, 43, 80):
            text = " ".join([f"p{k}" for k in range(pad)] + words[:at] + [f"x{k}" for k in range(inserted)] + words[at:])
            ((_, _, n, covered, first, _),) = licenses.find_licenses(known, next(wb.slices(pa.array([text]))), 0.85)
            # one or two words alone at an end are no stretch
            lost = min(at, len(words) - at) if min(at, len(words) - at) < 3 else 0
            assert (covered, first) == (n - lost, pad + (inserted + at if 0 < at < 3 or at == 0 else 0))


def test_alignment_covers_what_the_longest_common_run_of_stretches_does():
    """On texts whose words are unique the alignment is the exact longest rising run."""
    draw = random.Random(5)
    for _ in range(100):
        a = list(range(40))
        b = a[: draw.randrange(40)] + draw.sample(range(100, 200), 10) + a[draw.randrange(40) :]
        met = licenses.patience(a, b)
        grid = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                grid[i + 1][j + 1] = grid[i][j] + 1 if x == y else max(grid[i][j + 1], grid[i + 1][j])
        assert len(met) <= grid[-1][-1]
        if len(set(b)) == len(b):
            assert len(met) == grid[-1][-1]


def test_whole_license_texts_of_a_folder(tmp_path):
    (tmp_path / "Own-1.txt").write_text("one two three four five six")
    assert licenses.whole_templates(tmp_path) == {"own-1": "one two three four five six"}
    known = licenses.whole_templates()
    assert len(known) == 14 and known["gpl-3"].rstrip().endswith("why-not-lgpl.html>.")


def most_covered(a, b, run):
    """The most words of ``a`` that stretches of ``run`` or more words, in order in both, can cover; by the whole table."""
    f, g, length = (np.zeros((len(a) + 1, len(b) + 1), np.int64) for _ in range(3))
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            if a[i - 1] == b[j - 1]:
                length[i, j] = length[i - 1, j - 1] + 1
                if length[i, j] >= run:
                    g[i, j] = max(f[i - run, j - run] + run, g[i - 1, j - 1] + 1 if length[i, j] > run else 0)
            f[i, j] = max(f[i - 1, j], f[i, j - 1], g[i, j])
    return int(f[-1, -1])


def test_license_query_equals_the_whole_table(spark, documents):
    """Every document and template of the smallest table: the same licenses as the best alignment has, as many words."""
    from weekloom.llm.queries import op8_license_scan

    words = lambda text: re.findall(r"[^\x20\x09-\x0D!-/:-@\[-`{-~]+", lower(text))
    want = {}
    for name, text in (licenses.TEMPLATES | licenses.whole_templates()).items():
        a = words(text)
        run = min(3, len(a))
        grams = [tuple(a[i : i + run]) for i in range(len(a) - run + 1)]
        for r in documents.collect():
            b = words(r.text)
            has = {tuple(b[i : i + run]) for i in range(len(b) - run + 1)}
            covered = {i + k for i, g in enumerate(grams) if g in has for k in range(run)}
            if len(covered) >= 0.85 * len(a):
                best = most_covered(a, b, run)
                if best >= 0.85 * len(a):
                    want[r.doc_id, name] = (len(a), best)
    got = {(r.doc_id, r.license): (r.template_words, r.covered_words) for r in op8_license_scan(spark, DATA).collect()}
    assert got == want and len(want) > 5


def test_license_notices_of_the_table(documents):
    plain = {(r.doc_id, n) for r in documents.collect() for n in ("mit-notice", "apache-2.0-notice", "gpl-3.0-notice", "cc-by-nc-4.0-notice", "all-rights-reserved") if licenses.TEMPLATES[n] in r.text}
    assert {(r.doc_id, r.license) for r in licenses.license_scan(documents).where("coverage = 1").collect()} >= plain


def test_boilerplate_lines_go(spark, odd, nothing):
    rows = [(i, "h", f"top\nline {i}\n top \n\nend") for i in range(30)] + [(100, None, "top\nx"), (101, "few", "top"), (102, "h", None), (103, "h", "top"), (104, "h", "twice\na"), (105, "h", "twice\nb"), (106, "h", "twice\nb")]
    rows += [(200 + i, "small", f"head\n{i}") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumns({c: F.lit(1) for c in ("host_of", "often", "hits", "page")})
    got = {r.doc_id: r.text for r in linefreq.drop_boilerplate(docs).collect()}
    assert got[3] == "line 3\n" and got[100] == "top\nx" and got[101] == "top" and got[102] is None and got[103] == ""
    assert got[106] == "twice\nb" and got[201] == "1"  # two distinct pages, three distinct pages
    joined = {r.doc_id: r.text for r in linefreq.drop_boilerplate(docs, broadcast_lines=0).collect()}
    assert joined == got
    assert linefreq.drop_boilerplate(odd).columns == odd.columns and linefreq.drop_boilerplate(nothing).count() == 0
    assert linefreq.drop_boilerplate(odd).exceptAll(odd).count() == 0


def test_identify_without_learned_letters(spark):
    """Labelled texts without a letter teach no n-gram: a text with letters is as far as can be from every language."""
    profiles = language.fit_profiles(spark.createDataFrame([(1, "123 456", "en"), (2, "7", "de")], "doc_id long, text string, lang string"))
    docs = spark.createDataFrame([(1, "hello"), (2, "123"), (3, None)], "doc_id long, text string")
    assert {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs, profiles).collect()} == {1: ("de", 0.0), 2: ("und", 0.0), 3: ("und", 0.0)}
    assert language.keep_identified(docs, profiles).count() == 0


def test_token_files_of_widely_spread_ids(spark):
    """Ids from end to end of 64 bits in one file, nulls, and repeated ones."""
    ids = [-(2**63), -(2**63) + 5, -3, 0, 0, 7, 2**63 - 5, 2**63 - 1, None]
    docs = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string")
    for partitions in (1, 3):
        rows = tokenbin.read_tokens(tokenbin.write_tokens(docs, BYTE_VOCABULARY, partitions=partitions), docs_per_read=4).orderBy("start").collect()
        assert [r.doc_id for r in rows] == [None, *sorted(x for x in ids if x is not None)]
        assert [r.start for r in rows] == list(np.cumsum([0, *(r.n_tokens for r in rows)])[:-1])


@pytest.mark.parametrize("values", [[0], [0, 2**64 - 1], [5, 5, 5], list(range(0, 2**40, 2**30)), []])
def test_elias_fano_of_64_bits(values):
    coded = tokenbin.EliasFano.load(tokenbin.EliasFano.build(np.array(values, np.uint64), max(values, default=0) + 1).dump())
    assert coded.select(0, len(values)).tolist() == values
    assert [coded.select(k, k + 1).tolist() for k in range(len(values))] == [[v] for v in values]


def test_contamination_over_several_blocks(spark, documents, monkeypatch):
    """Blocks of ten items, of which a worker keeps none, one or all, give the result of one block."""
    items = spark.read.parquet(f"{DATA}/benchmark.parquet")
    whole = {tuple(r) for r in contamination.contained_items(documents, items).collect()}
    kept = contamination.drop_contaminated(documents, items).count()
    monkeypatch.setitem(contamination.write_blocks.__kwdefaults__, "block", 10)
    assert len(contamination.write_blocks(items)) > 2
    assert {tuple(r) for r in contamination.contained_items(documents, items).collect()} == whole and whole
    assert contamination.drop_contaminated(documents, items).count() == kept < documents.count()


def test_recall_of_items_by_containment(spark):
    """Items whole, edited, and in two pieces far apart in long documents: all of those that hold 0.8 are found."""
    draw = random.Random(17)
    word = lambda: "".join(draw.choices("abcdefghijklmnop", k=draw.randint(2, 8)))
    items, docs, want = [], [], set()
    for k in range(240):
        item = [word() for _ in range(draw.choice([20, 60, 200]))]
        text = list(item)
        for _ in range(draw.choice([0, 0, len(item) // 60, len(item) // 30])):
            text[draw.randrange(len(text))] = word()
        filler = [word() for _ in range(4000)]
        at = draw.randrange(1000)
        if k % 3 == 0:
            cut = draw.randrange(5, len(text) - 5)
            doc = filler[:at] + text[:cut] + filler[at : at + 2000] + text[cut:] + filler[at + 2000 :]
        else:
            doc = filler[:at] + text + filler[at:]
        items.append((k, " ".join(item)))
        docs.append((k, " ".join(doc)))
        share = len(shingles(items[-1][1]) & shingles(docs[-1][1])) / len(shingles(items[-1][1]))
        if share >= 0.8:
            want.add(k)
    got = contamination.contained_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.doc_id for r in got} == want and all(r.doc_id == r.item_id for r in got) and len(want) > 120


def test_archives_with_a_least_size_of_revisits(spark):
    """Payloads under the least size are all responses, however often they occur."""
    pages = spark.createDataFrame([(1, "http://a.example/1", "same long page"), (2, "http://a.example/2", "same long page"), (3, "http://a.example/3", "x"), (4, "http://a.example/4", "x"), (5, "http://a.example/5", None), (6, None, "")], "page_id long, url string, html string")
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.read_back(pages, warc.write_index(warc.write_archives(pages, min_revisit_bytes=5)), strict=True).collect()}
    assert got == {1: ("response", None), 2: ("revisit", 1), 3: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("response", None)}
