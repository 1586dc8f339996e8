"""Main text, ranked search and periodic runs against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from html.parser import HTMLParser

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weekloom.llm import lexical, pagetext, periodic, queries

DATA = "/root/testdata/sf0.001"
LONG = "word another thing here " * 5000
ODD = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (4, "one"), (None, "one two three four five six"), (5, LONG), (6, "été ÇA 日本語 x 😀"), (7, "A B\x0bC\x0cD\rE"), (8, "one one"), (9, "two one")]


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names the operators use."""
    rows = spark.createDataFrame(ODD, "doc_id long, text string")
    return rows.withColumns({"text_hash": F.lit("s"), "item": F.lit("x"), "items": F.lit(1.5), "score": F.lit(0), "rank": F.lit(None).cast("string"), "runs": F.lit(3), "words": F.lit("s"), "n": F.lit(2), "a": F.lit(1), "p": F.lit(0)})


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string")


class ArticleParser(HTMLParser):
    """The paragraphs of the article, by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.inside, self.blocks = False, [[]]

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag in ("p", "h1", "article"):
            self.blocks.append([])

    def handle_endtag(self, tag):
        self.inside &= tag != "article"
        if tag in ("p", "h1", "article"):
            self.blocks.append([])

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1].append(data)


def article(page):
    parser = ArticleParser()
    parser.feed(page or "")
    parser.close()
    return "\n\n".join(x for x in (" ".join("".join(b).split()) for b in parser.blocks) if x)


def test_main_text_of_all_pages(spark):
    got = {r.page_id: r for r in queries.op11_main_text(spark, DATA).collect()}
    pages = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    assert len(got) == len(pages)
    for page in pages:
        assert got[page.page_id].text == article(page.html)
        assert (got[page.page_id].url, got[page.page_id].n_chars) == (page.url, len(article(page.html)))


PAGES = {
    # Semantic markup with everything that isn't the article.
    """<html><head><title>T</title></head><body class="no-sidebar"><header><h1>Site name</h1><p>A slogan of the site</p></header><nav><a href=1>Home</a> <a href=2>News</a></nav>
<div id="cookie-banner">We use cookies to make this site better for all of our readers. <button>OK</button></div>
<main><article class="post with-comments"><header><h1>Rain at last</h1></header><p>It rained.</p><p>The farmers of the valley were glad to see water in the fields after eleven weeks of drought &amp; heat.<p>Yes.</p><figure><img src=x><figcaption>A field</figcaption></figure><div class="ad-slot">Buy seed now at half price, today only, friends.</div><p>More at <a href=3>the ministry</a>.</p></article>
<section id="comments"><h2>Comments</h2><p>I disagree with the article because the drought has been longer than eleven weeks in my village.</p></section>
<aside><h3>Related</h3><p>Another story which is long enough to be taken for a paragraph of main text by its length.</p></aside><form><label>Name</label><input><textarea>abc</textarea><select><option>One<option>Two</select><p>Send us your opinion by this form</p></form></main><footer><p>Copyright 2020 by the site. All rights reserved to the owner of it.</p></footer></body></html>""": ["Rain at last", "It rained.", "The farmers of the valley were glad to see water in the fields after eleven weeks of drought & heat.", "Yes.", "A field", "More at the ministry."],
    # Neither containers nor end tags.
    """<p>Lone text about a thing that is long enough to be the text of this very small page, is it not<script>var a="<p>no</p>";</script><p>And a second paragraph that goes on for quite a while so that it counts as text <b>bold <i>words</b> here""": ["Lone text about a thing that is long enough to be the text of this very small page, is it not", "And a second paragraph that goes on for quite a while so that it counts as text bold words here"],
    # A form around the page isn't a form in it.
    "<body><form><div class=menu>Start</div><article><h2>A</h2><p>Short one.</p></article><div class=sidebar>Side words here</div></form>": ["A", "Short one."],
    "<nav>x y</nav><article><h1>Recipe</h1><ul><li>two eggs<li>milk<li>salt</ul><p>Mix.</p><pre>a  b\nc</pre></article><footer>f</footer>": ["Recipe", "two eggs", "milk", "salt", "Mix.", "a b c"],
    """<article><p>a&nbsp;b &lt;p&gt; &#65;&#x42; &copy &unknown; 1 < 2 <3<!-- c > --> d<![CDATA[x]]></p><p title="a>b" class='x'>e<br>f</p></article>""": ["a b <p> AB © &unknown; 1 < 2 <3 d", "e f"],
    """<div role="alert" class="notice">This site will be closed on Monday for repair of the machines in the cellar.</div><article><p>Body text.</p><div class="newsletter">Sign up for our letter and read it each day with your coffee.</div><p>End.</p><div class="comments"><article class="comment"><p>Nice text, I liked it a lot, thanks to the writer of it.</p></article></div></article>""": ["Body text.", "End."],
    # By length and links alone.
    """<table><tr><td><a href=a>Home</a></td><td><a href=b>About</a></td></tr></table><h1>The history of glass</h1><p>Glass has been made for more than four thousand years, first as beads and then as vessels, in Egypt and in Mesopotamia, where sand and soda were at hand.</p><p>Romans blew it.</p><p>Later it was made in Venice, where the makers were forbidden to leave the island on pain of death, and their secrets stayed there for hundreds of years.</p><p><a href=c>Next</a> <a href=d>Previous</a></p>""": [
        "The history of glass", "Glass has been made for more than four thousand years, first as beads and then as vessels, in Egypt and in Mesopotamia, where sand and soda were at hand.", "Romans blew it.", "Later it was made in Venice, where the makers were forbidden to leave the island on pain of death, and their secrets stayed there for hundreds of years."],
    "<nav><a href=a>Home</a></nav><article><h1>Cut</h1><p>This page stops in the mid": ["Cut", "This page stops in the mid"],
    "<article><p>Text.</p><p>More <a hre": ["Text.", "More"],
    "<article><p>Text.</p><!-- never closed <p>More": ["Text."],
    "<title>Nope</title><style>p{}</style><article><h1>H</h1><p>ok then</p></article>": ["H", "ok then"],
    "<ul><li><a href=a>One</a><li><a href=b>Two</a></ul>": [],
    "no markup": [],
}


def test_main_text_of_odd_pages(spark):
    rows = [(k, str(k), page) for k, page in enumerate(PAGES)] + [(None, None, None), (90, "u", ""), (90, "u", ""), (91, "v", "<article><p>" + "x " * 200_000 + "</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit(1), "blocks": F.lit("b"), "label": F.lit(0)})
    got = {}
    for r in pagetext.main_text(df).select("page_id", "url", "text").collect():
        got.setdefault(r.page_id, []).append(r.text)
    for k, want in enumerate(PAGES.values()):
        assert got[k] == ["\n\n".join(want)]
    assert got[None] == [""] and got[90] == ["", ""] and len(got[91][0]) == 399_999
    assert pagetext.main_text(df.limit(0)).count() == 0


def test_labelled_pages_are_learned(spark):
    """The tree agrees with all but a few of the labels, and each labelled line is one block."""
    table = pagetext.labelled_features(spark)
    model = pagetext.fit_tree(table)
    wrong = table.withColumn("kept", pagetext.tree_column(model, [F.col(x) for x in pagetext.FEATURES])).where("kept <> (label > 0.5)").count()
    assert wrong <= 0.05 * table.count()


def terms(text):
    folded = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", folded)


def searched(docs, items, top=10):
    """All results of a search by scoring every row."""
    counted = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs if terms(t)]
    total, words = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, tf, _ in counted for t in tf)
    out = []
    for item_id, text in set(items):
        scores = []
        for doc_id, tf, n in counted:
            m = 25 + 75 * n * total // words
            score = sum(k * math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t, k in Counter(terms(text)).items() if tf[t])
            if score > 0 and doc_id is not None:
                scores.append((-score, doc_id))
        out += [(item_id, k + 1, doc_id, -s) for k, (s, doc_id) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_search_equals_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    want = sorted(con.execute(queries.oracle_sql()["op12_lexical_search"]).fetchall(), key=repr)
    assert rows_of(queries.op12_lexical_search(spark, DATA)) == want and want


def test_search_of_odd_rows(spark, odd, nothing):
    """Nulls, repeated rows, ties, items without terms, unknown terms and repeated items."""
    items = [(1, "one two"), (1, "one two"), (1, "word"), (2, None), (3, "..."), (4, "nowhere"), (None, "ÇA 日本語"), (5, "one one ONE thing-word"), (6, "")]
    asked = spark.createDataFrame(items, "item_id long, text string").withColumns({"doc_id": F.lit(1), "rank": F.lit("r")})
    want = searched(ODD, [x for x in items if x[1] is not None])
    assert rows_of(lexical.lexical_search(odd, asked)) == want and len(want) > 8
    assert rows_of(lexical.lexical_search(odd, asked, top=1)) == searched(ODD, [x for x in items if x[1] is not None], top=1)
    assert lexical.lexical_search(nothing, asked).count() == 0 and lexical.lexical_search(odd, asked.limit(0)).count() == 0


def test_search_in_blocks_of_items_and_documents(spark, monkeypatch):
    """Skewed words, many copies, several blocks of items, and blocks of few documents."""
    draw = random.Random(3)
    words = [f"w{k}" for k in range(60)]
    docs = [(k, " ".join(draw.choices(words, [1 / (j + 1) for j in range(60)], k=draw.choice([1, 3, 20, 300])))) for k in range(300)]
    docs += [(1000 + k, docs[7][1]) for k in range(150)]
    items = [(k, " ".join(draw.choices(words, k=draw.randint(1, 12)))) for k in range(25)]
    monkeypatch.setattr(lexical, "ITEM_ROWS", 10)
    monkeypatch.setattr(lexical, "BLOCK_ROWS", 16)
    got = lexical.lexical_search(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), top=5)
    assert rows_of(got) == searched(docs, items, top=5)


def test_bounds_hold_and_exclude(spark):
    """No score is above its bound, and few bounds reach an item's tenth score."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    index = lexical.build_index(docs)
    texts = {r.doc_id: r.text for r in docs.collect()}
    documents, words = sum(bool(terms(t)) for t in texts.values()), sum(len(terms(t)) for t in texts.values())
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    query = lexical._query(index, items, documents, words)
    exact = {(i, d): s for i, _, d, s in searched(list(texts.items()), items, top=10**6)}
    assert exact
    tenth = {i: s for i, rank, _, s in searched(list(texts.items()), items) if rank == 10}
    reached = total = 0
    for row in index.collect():
        bound = lexical._bounds(query, row.asDict())
        for k, doc_id in enumerate(row.doc_ids):
            for i, item_id in enumerate(query.item_ids):
                assert bound[i, k] >= exact.get((item_id, doc_id), 0)
                total += 1
                reached += bound[i, k] >= tenth.get(item_id, 1)
    assert reached < 0.2 * total


def runs(words):
    """(start, length, period) of all runs, trying every period at every place."""
    best = {}
    for q in range(len(words) // 4, 0, -1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(6, 4 * q):
                best[start, i - start + q] = q
            i += i == start
    return sorted(((s, n, q) for (s, n), q in best.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_runs_of_random_words():
    draw = random.Random(5)
    docs = []
    for _ in range(600):
        words, letters = [], draw.choice(["a", "ab", "abc", "abcdefghijklmnop"])
        for _ in range(draw.randint(0, 6)):
            part = [draw.choice(letters) for _ in range(draw.randint(1, 70))]
            words += part if draw.random() < 0.5 else [part[i % len(part)] for i in range(draw.randint(2 * len(part), 6 * len(part)))]
        docs.append(words)
    # Thue-Morse words have squares of all sizes and no run; a long period needs the higher scales.
    docs += [[str(bin(i).count("1") % 2) for i in range(4096)], [str(i % 1500) for i in range(6100)], [], ["a"] * 6, ["a"] * 5, list("ab" * 4), list("ab" * 3)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(docs))), pa.array([" ".join(d) for d in docs], pa.string())], ["doc_id", "text"])
    got = [r for out in periodic._run_rows([batch]) for r in out.to_pylist()]
    for r, words in zip(got, docs, strict=True):
        want = runs(words)
        assert [(x["start"], x["length"], x["period"]) for x in r["runs"]] == want
        assert r["collapsed"] == collapsed(words, want) and r["n_words"] == len(words)


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def test_runs_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op13_periodic_runs(spark, DATA).collect()}
    assert set(got) == set(texts)
    for doc_id, text in texts.items():
        words = planted(doc_id, split(text))
        want = runs(words)
        r = got[doc_id]
        best = max(want, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=None)
        assert r.n_runs == len(want)
        assert (r.start, r.length, r.period, r.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in want).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(words, want).encode()).hexdigest()
    assert sum(r.n_runs > 0 for r in got.values()) > 5


def test_runs_of_odd_rows(spark, odd, nothing):
    got = periodic.periodic_runs(odd).collect()
    assert len(got) == len(ODD)
    for doc_id, text in ODD:
        want = runs(split(text)) if text != LONG else [(0, 20_000, 4)]
        same = [r for r in got if r.doc_id == doc_id and r.n_words == len(split(text))]
        assert same and all([tuple(x) for x in r.runs] == want and r.collapsed == collapsed(split(text), want) for r in same)
    changed = {r.doc_id: r.text for r in periodic.with_planted_runs(odd).collect()}
    assert all(split(changed[d]) == planted(d, split(t)) for d, t in ODD if d is not None)
    assert changed[1] is None and periodic.periodic_runs(nothing).count() == 0


def test_strongest_is_exact(spark):
    """Ratios that doubles can't tell apart, and ties."""
    kind = "runs array<struct<start:long,length:long,period:long>>"
    big = 10**9
    rows = [([(5, 3 * big + 1, big), (9, 3 * big + 4, big + 1), (2, 8, 2), (1, 12, 3)],), ([],), ([(3, 8, 2), (3, 12, 3), (4, 8, 2)],)]
    got = [tuple(r.best) if r.best else None for r in spark.createDataFrame(rows, kind).select(periodic.strongest("runs").alias("best")).collect()]
    assert got == [(2, 8, 2), None, (3, 8, 2)]


def test_windowed_best():
    values = np.random.default_rng(1).integers(0, 50, 200)
    assert (periodic._windowed(values, 8, np.minimum) == [values[i : i + 8].min() for i in range(193)]).all()
