"""Main text of web pages: flat text blocks, classified by a decision tree over their own and their neighbours' features.

A page is cut at its block-level tags into blocks of text. A block's features
are its words and link density, those of the blocks before and after it, and
what encloses it. A decision tree, trained on the labelled pages below, says
which blocks are main text; its nodes become one SQL expression, so pages are
classified in place, without a shuffle.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weekloom.llm.tables import arrow_map

BLOCK = pa.struct([("text", pa.string()), ("words", pa.int32()), ("linked", pa.int32()), ("marked", pa.bool_()), ("main", pa.bool_()), ("heading", pa.bool_())])
BLOCKS = "page_id long, url string, blocks array<struct<text:string,words:int,linked:int,marked:boolean,main:boolean,heading:boolean>>"
FEATURES = ["words", "density", "words_before", "density_before", "words_after", "density_after", "marked", "main", "heading"]

# HTML's element names by kind.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = set("canvas iframe math noembed noframes noscript object script style svg template textarea title xmp".split())
BREAKS = set("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: An element that ends an open one of the same list when it starts, up to one of ``SCOPES``.
SIBLINGS = {name: group for group in ({"li"}, {"dd", "dt"}, {"tr"}, {"td", "th"}, {"option"}, {"a"}) for name in group}
SCOPES = set("article aside body div dl main nav ol section table td th tr ul".split())
ASIDE, CONTROLS = set("aside dialog footer menu nav search".split()), set("button fieldset form label legend optgroup option select".split())

#: Words of class, id and role that mark what isn't the article, such as reader comments, and those that mark the article.
MARKS = set(
    "ad ads advert advertisement advertisements adverts banner banners breadcrumb breadcrumbs byline comment commentlist comments complementary consent contentinfo cookie cookies copyright dialog disclaimer discussion disqus donate foot footer gdpr head header hidden legal login masthead menu menus modal nav navbar navigation"
    " newsletter notice notices overlay pager pagination paywall popup promo promoted promotion recommended related replies reply responses rss search share sharing sidebar signin signup skip social sponsor sponsored sponsors subscribe subscription tags teaser toolbar tools widget widgets".split()
)
ARTICLE = set("article articlebody content entry hentry main maincontent post story".split())

_MARKUP = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)(?:>|\Z)|<(?:[!?]|/(?![a-zA-Z]))[^>]*+(?:>|\Z)""", re.S)
_NAMES = re.compile(r"""(?:^|[\s"'/])(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_ABOUT = re.compile(r"(?:has|is|js|no|with|without)[-_]", re.I)
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")


@lru_cache(maxsize=4096)
def _own(name: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element's name, class, id or role mark it as aside, and as the article."""
    if name in ("html", "body", "main", "article") and not re.search(r"\bcomment\b", attributes):
        return False, name in ("main", "article")
    named = [x for found in _NAMES.findall(attributes) for x in "".join(found[1:]).split() if not _ABOUT.match(x)]
    tokens = {t for x in named for t in re.findall("[a-z]+", _HUMP.sub(" ", x).lower())}
    return name in ASIDE or bool(tokens & MARKS), name == "article" or bool(tokens & ARTICLE)


@lru_cache(maxsize=64)
def _end_of(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>])[^>]*+(?:>|\Z)|\Z", re.I)


def text_blocks(page: str) -> list[tuple[str, int, int, bool, bool, bool]]:
    """(text, words, linked words, marked, main, heading) of each block with text, in page order.

    Character references are decoded and white space becomes one space. Scripts,
    styles, the head's title, comments and other unseen content leave nothing.
    Markup may be broken: tags left open end with what encloses them, an unknown
    end tag means nothing, and a page may stop anywhere.
    """
    # Open elements: name and whether a text inside is marked, of the article, in a control, linked, a heading.
    stack: list[tuple[str, bool, bool, bool, bool, bool]] = [("", False, False, False, False, False)]
    out, parts, state, linked = [], [], stack[0], 0

    def add(text: str) -> None:
        nonlocal state, linked
        if text and not (text.isspace() and not parts):
            text = html.unescape(text) if "&" in text else text
            if not parts:
                state = stack[-1]
            parts.append(text)
            if stack[-1][4]:
                linked += len(text.split())

    def close() -> None:
        nonlocal linked
        words = "".join(parts).split()
        if words:
            out.append((" ".join(words), len(words), min(linked, len(words)), state[1] or state[3], state[2], state[5]))
        parts.clear()
        linked = 0

    def end(names: set[str] | frozenset[str], scopes: set[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in names:
                del stack[k:]
                return
            if stack[k][0] in scopes:
                return

    at = 0
    while (m := _MARKUP.search(page, at)) is not None:
        add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if name in BREAKS:
            close()
        elif name == "br":
            add(" ")
        if m[1]:
            # An inline element doesn't end the block that it stands in.
            end({name}, set() if name in BREAKS else SCOPES | {"p"})
            continue
        if name in UNSEEN:
            if not m[3].endswith("/"):
                at = _end_of(name).search(page, at).end()
            continue
        if name in VOID:
            continue
        if name in BREAKS:
            end({"p"} | (HEADINGS if name in HEADINGS else set()), SCOPES)
        if name in SIBLINGS:
            end(SIBLINGS[name], SCOPES - SIBLINGS[name])
        _, marked, main, control, link, heading = stack[-1]
        own, article = _own(name, m[3] if "=" in m[3] else "")
        own = own or (name == "header" and not main)
        control = name in CONTROLS or (control and name not in ("article", "main"))
        stack.append((name, marked or own, main or article, control, link or name == "a", heading or name in HEADINGS))
    add(page[at:])
    close()
    return out


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.name for f in BLOCK]
    for batch in batches:
        for first in range(0, batch.num_rows, 256):
            part = batch.slice(first, 256)
            blocks = [[dict(zip(names, b, strict=True)) for b in text_blocks(page.as_py() or "")] for page in part.column(2)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(blocks, pa.list_(BLOCK))], ["page_id", "url", "blocks"])


def _features(block: Column, before: Column, after: Column) -> list[Column]:
    def pair(x: Column) -> list[Column]:
        words = F.coalesce(x["words"], F.lit(0)).cast("double")
        return [words, F.coalesce(x["linked"] / x["words"], F.lit(0.0))]

    return [*pair(block), *pair(before), *pair(after), *(block[k].cast("double") for k in ("marked", "main", "heading"))]


# Labelled pages, a line for each block: "+" is main text, "-" isn't, and other
# lines are markup alone. {n} stands for n words and [n] for n words of a link.
LABELLED = (
    """
 <body><nav><ul>
-<li>[1]
-<li>[2]
-<li>[1]
 </ul></nav>
-<div class="ad">{12}</div>
 <article>
+<h1>{8}</h1>
+<p>{9}
+<p>{60}
+<p>{1}
+<p>{35} [3] {20}
+<p>{4}
 </article>
-<footer>{9}</footer>
""",
    """
 <body><header>
-<div class="logo">{3}</div>
 <ul class="menu">
-<li>[2]
-<li>[1]
 </ul></header>
-<div class="cookie-notice">{25} [2]</div>
 <main><article>
+<h1>{6}</h1>
+<p>{40}
+<h2>{3}</h2>
+<p>{2}
 <ul>
+<li>{4}
+<li>{7} [1]
 </ul>
+<blockquote>{15}</blockquote>
-<p>[9]
-<p>[4]
-<aside>{30}</aside>
 <section class="comments">
-<h3>{2}</h3>
-<p>{45}
-<p>{6}
 </section></article>
 <form action="/in">
-<label>{2}</label>
-<p>{11}
 </form></main>
 <footer>
-<p>{22} [2]
-<p>[3]
 </footer>
""",
    """
 <body><table><tr>
-<td>[1]
-<td>[2]
-<td>[1]
-<td>[2]
 </table>
+<h1>{7}</h1>
+<p>{55}
+<p>{48} [2]
+<p>{12}
+<p>{70}
-<p>{5} [2]
-<p>{3}
""",
    """
 <body><div>
-<div>[2] [1] [2]</div>
-<div>{2} [1]</div>
 </div><div>
+<h1>{5}</h1>
-<div>{2}</div>
+<div>{33}</div>
+<div>{80} [4]</div>
+<div>{14}</div>
+<div>{41}</div>
 </div><div>
-<div>{3}</div>
-<div>[4]</div>
-<div>[6]</div>
-<div>[5]</div>
 </div>
-<div>{4} [1]</div>
""",
    """
 <body>
-<p>[3]
-<p>[5]
-<p>[4]
-<p>[7]
-<p>{2} [6]
-<p>[3]
-<p>{4}
""",
    """
 <body><div class="content">
 <ul>
-<li>[1]
-<li>[1]
 </ul>
+<h1>{4}</h1>
+<p>{3}
+<p>{28}
+<p>{6}
+<h2>{2}</h2>
+<p>{17}
 </div><div class="sidebar">
-<h3>{2}</h3>
-<p>{38}
-<p>[4]
 </div>
-<div id="footer">{14}</div>
""",
    """
 <body><article>
+<h1>{2}</h1>
+<p>{5}
 </article>
 <div class="comment">
-<p>{3}
-<p>{64}
 </div><div class="promo">
-<h2>{5}</h2>
-<p>{19}
 </div>
""",
    """
 <body><article>
+<p>{90}
+<p>{10} [2]
+<p>{1}
+<p>{2}
+<h3>{1}</h3>
+<p>{3} [1] {30}
 </article>
-<div>{5}</div>
-<div>{2} [3]</div>
 <nav>
-<p>{8}
-<p>{26}
 </nav>
""",
    """
 <body><article>
+<h1>{5}</h1>
+<p>{3}
+<p>{44}
+<p>{2}
+<p>{1}
 </article>
""",
    """
 <body><nav>
-<a href="x">{1}</a>
 </nav><article>
+<h1>{3}</h1>
+<p>{4} [3] {3}
+<p>{2} [2]
+<p>{30} [12] {8}
+<p>{3}
 <ul>
+<li>{3} [2] {2}
+<li>{1} [1]
-<li>[5]
-<li>[3]
 </ul>
+<p>{2}
-<p>[6]
 </article><footer>
-<p>[2]
-<p>[2] {1} [2]
 </footer>
""",
    """
 <body><div>
-<div>[2]</div>
-<div>[3]</div>
-<div>{1}</div>
+<h1>{6}</h1>
+<p>{66}
+<p>{24}
+<p>{9} [2] {14}
+<p>{52}
""",
    """
 <body><main>
+<h1>{2}</h1>
+<p>{7}
 <div class="share">
-<p>{3}
-<p>[1]
 </div></main>
 <section id="related">
-<h2>{2}</h2>
-<p>{21}
-<p>{9}
-<p>[5]
 </section>
""",
    """
 <body>
-<div class="header">{6}</div>
 <div class="post"><div class="entry-content">
+<p>{1}
+<p>{2}
+<p>{13}
+<p>{1}
 </div></div>
-<div class="advert">{1}</div>
-<div class="advert">{31}</div>
""",
    """
 <body>
-<div>{3}</div>
-<div>{2}</div>
-<div>[2] {1}</div>
-<div>[1]</div>
-<div>{1}</div>
-<div>{4}</div>
""",
    """
 <body><article>
+<p>{75}
-<div class="ad">{12}</div>
+<p>{90}
-<div class="ad">{40}</div>
-<aside>{3}</aside>
+<p>{20}
-<div class="notice">{18}</div>
+<p>{6}
-<div class="newsletter">{9}</div>
+<p>{110}
 </article><footer>
-<p>{10}
-<p>{16}
 </footer>
-<div class="footer">{80}</div>
""",
    """
 <body><article>
+<p>{85}
+<p>{120}
 </article>
-<footer>{13}</footer>
""",
    """
 <body><nav>
-<p>{12}
 </nav>
-<div class="banner">{24}</div>
 <article>
+<p>{66}
 </article>
-<footer>{20}</footer>
""",
    """
 <body>
-<div>[2]</div>
-<div>{2}</div>
+<h1>{5}</h1>
+<p>{22}
+<p>{5}
+<p>{29}
+<p>{3}
+<p>{19}
+<p>{25}
-<div>{3} [2]</div>
-<div>{4}</div>
""",
    """
 <body>
+<p>{18}
+<p>{16}
+<p>{24}
""",
    """
 <body>
-<div>{4}</div>
+<h2>{4}</h2>
+<p>{21}
+<p>{17} [3]
+<p>{8}
+<p>{31}
-<p>[1] [1]
-<p>{2} [4]
""",
)


def labelled_features(spark: SparkSession, pages: tuple[str, ...] = LABELLED) -> DataFrame:
    """label (1.0 is main text) and the features of each labelled block."""
    rows, names = [], [f.name for f in BLOCK]
    for page in pages:
        lines = [x for x in page.split("\n") if x]
        source = re.sub(r"\{(\d+)\}|\[(\d+)\]", lambda m: "word " * int(m[1]) if m[1] else f'<a href="x">{"word " * int(m[2])}</a>', "\n".join(x[1:] for x in lines))
        blocks = [dict(zip(names, b, strict=True)) for b in text_blocks(source)]
        labels = [float(x[0] == "+") for x in lines if x[0] != " "]
        rows += [(y, b, p, n) for y, b, p, n in zip(labels, blocks, [None, *blocks[:-1]], [*blocks[1:], None], strict=True)]
    kind = BLOCKS.partition("array<")[2].rstrip(">") + ">"
    table = spark.createDataFrame(rows, f"label double, block {kind}, before {kind}, after {kind}").coalesce(1)
    return table.select("label", *(x.alias(name) for x, name in zip(_features(F.col("block"), F.col("before"), F.col("after")), FEATURES, strict=True)))


def fit_tree(labelled: DataFrame, *, depth: int = 6):
    """A decision tree over labelled blocks (label and ``FEATURES``)."""
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(labelled)
    return DecisionTreeClassifier(maxDepth=depth, maxBins=128, seed=1).fit(rows)


def tree_column(model, values: list[Column]) -> Column:
    """The tree's decision as nested conditions on the feature columns."""

    def branch(node) -> Column:
        if not node.subtreeDepth():
            return F.lit(node.prediction() > 0.5)
        cut = node.split()
        return F.when(values[cut.featureIndex()] <= cut.threshold(), branch(node.leftChild())).otherwise(branch(node.rightChild()))

    return branch(model._call_java("rootNode"))


def main_text(pages: DataFrame, *, labelled: DataFrame | None = None) -> DataFrame:
    """page_id, url, text and blocks for every row of ``pages`` (page_id, url, html).

    text joins the blocks that the tree takes for main text by two line ends;
    blocks lists all of them (text, words, linked, marked, main, heading, kept).
    ``labelled`` trains the tree, by default ``labelled_features``.

    Null and empty html, and pages without main text, give an empty text. A null
    page_id or url stays null, repeated rows give repeated results, other columns
    are ignored, whatever their names, and an empty table gives an empty result.
    """
    model = fit_tree(labelled_features(pages.sparkSession) if labelled is None else labelled)
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    found = arrow_map(source, _block_rows, BLOCKS)

    def judged(block: Column, at: Column) -> Column:
        values = _features(block, F.get("blocks", at - 1), F.get("blocks", at + 1))
        return block.withField("kept", tree_column(model, values))

    found = found.withColumn("blocks", F.transform("blocks", judged))
    text = F.array_join(F.transform(F.filter("blocks", lambda b: b["kept"]), lambda b: b["text"]), "\n\n")
    return found.select("page_id", "url", text.alias("text"), "blocks")
