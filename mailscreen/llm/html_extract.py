"""Main text of web pages by classifying flat text blocks.

A page is cut into text blocks at block-level tags. A block is described by its words, the
share of them in links and the number of these, by words and link density of the blocks
before and after it, and more weakly by what encloses it: an article or main element, a
navigation, header, footer, sidebar or form inside of that, class or id names that say advert,
notice, comments and the like. A decision tree, trained by Spark on the labelled table of
`html_samples`, tells main text from the rest; its rules travel to the tasks as a list of
nodes. Pages without class names, or without an article element, are told by words and links.

Scripts, styles and comments never reach a block. Character references are decoded, white
space in a block becomes one space, blocks are joined in page order by one newline.

Defined results: null or empty html gives an empty text; broken or unclosed markup is read
as far as it can be; texts of any length are read whole; pages are judged each by itself,
so ids and urls may be null or repeat and repeated rows come back as often as they occur; an
empty table gives no rows; further columns of the input, however named, are ignored.
"""

from __future__ import annotations

import html
import re
import sys
from collections import Counter

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailscreen.llm import html_samples
from mailscreen.session import work_folder

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# fixed values: element names of HTML
BLOCK_TAGS = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl "
    "dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html label "
    "legend li main menu nav ol optgroup option p pre section select summary table tbody td "
    "tfoot th thead title tr ul".split()
)
VOID_TAGS = set("area base br col embed hr img input link meta source track wbr".split())
HIDDEN_TAGS = "script style template noscript textarea svg math iframe object canvas".split()
BOILER_TAGS = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select"}
MAIN_TAGS = {"article", "main"}
# parts of class and id names that mark what is not main text
BOILER_NAMES = set(
    "ad ads adv advert advertisement adverts banner breadcrumb breadcrumbs comment comments "
    "consent cookie cookies footer header login masthead menu nav navbar navigation newsletter "
    "notice pagination popup promo promotion related respond share sharing sidebar signup "
    "social sponsor sponsored subscribe tags toolbar widget".split()
)

# on the page or its article such names tell of its layout, not of what it is
LAYOUT_NAMES = set(
    "ad ads banner breadcrumb breadcrumbs cookie cookies footer header masthead menu nav navbar "
    "navigation share sharing sidebar social tags toolbar widget".split()
)
# parts that may stand beside those in a name without giving it another sense
PLACE_NAMES = set(
    "area bar block bottom box button buttons container form inner item items left links list outer "
    "page panel right section site slot text top wrap wrapper".split()
)

# place: 0 no article or main element on the page, 1 outside of it, 2 inside
FEATURES = (
    "words", "link_density", "words_before", "link_density_before", "words_after",
    "link_density_after", "links", "place", "in_boiler", "named_boiler", "is_heading", "in_head",
)

_HIDDEN = "|".join(HIDDEN_TAGS)
# A self-closed svg or math holds nothing; other hidden elements cannot close themselves in
# HTML. Every other alternative also ends at the end of the page, so that none is tried and given up
# over a long rest. Quotes hold a value only after an equals sign.
TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)
    |<(?:svg|math)(?=[\s/>])(?:=\s*+"[^"]*+(?:"|\Z)|=\s*+'[^']*+(?:'|\Z)|[^>])*+(?<=/)>
    |<({_HIDDEN})(?=[\s/>])[^>]*+(?:>|\Z).*?(?:</\1\s*>|\Z)
    |<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+"[^"]*+(?:"|\Z)|=\s*+'[^']*+(?:'|\Z)|[^>])*+)(?:>|\Z)
    |<[!?/][^>]*+(?:>|\Z)
    |([^<]++|<)""",
    re.VERBOSE | re.DOTALL | re.IGNORECASE,
)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
NAME_PART = re.compile(r"[a-z]+")


def _named_boiler(tag: str, attributes: str) -> int:
    """2 if a name says boilerplate, 1 if only layout names do, 0 if none.

    All parts of a name have to go with it: `cookie-notice` and `ad-slot` do, but not
    `related-work`, `comments-open` or `has-sidebar`.
    """
    if tag in ("html", "body"):
        return 0
    found = 0
    for m in NAMES.finditer(attributes):
        for name in "".join(m.groups("")).lower().split():
            parts = set(NAME_PART.findall(name))
            if parts <= BOILER_NAMES | PLACE_NAMES and not parts.isdisjoint(BOILER_NAMES):
                found = max(found, 1 if parts.isdisjoint(BOILER_NAMES - LAYOUT_NAMES) else 2)
    return 0 if tag in MAIN_TAGS and found == 1 else found


def blocks(page: str) -> list[tuple[str, list[float]]]:
    """(text, own features) of every block that has a word: words, link density, links, in
    main, in boiler, named, heading, in head."""
    out: list[tuple[str, list[float]]] = []
    # open elements: (tag, in main, in boiler, named, in link, heading, in head)
    stack: list[tuple] = [("", 0, 0, 0, 0, 0, 0)]
    still_open: Counter[str] = Counter()
    open_blocks: list[int] = []  # places of block elements in the stack
    parts: list[str] = []
    linked: list[str] = []
    n_links = 0

    def end_block() -> None:
        nonlocal n_links
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                words = text.count(" ") + 1
                in_links = len(html.unescape("".join(linked)).split())
                _, main, boiler, named, _, heading, head = stack[-1]
                density = min(1.0, in_links / words)
                out.append((text, [words, density, n_links, main, boiler, int(named > 0), heading, head]))
            parts.clear()
            linked.clear()
        n_links = int(stack[-1][4])  # a link that stays open goes on

    def close(k: int) -> None:
        still_open.subtract(x[0] for x in stack[k:])
        del stack[k:]
        while open_blocks and open_blocks[-1] >= k:
            open_blocks.pop()

    for m in TOKEN.finditer(page):
        text = m[5]
        if text is not None:
            parts.append(text)
            if stack[-1][4]:
                linked.append(text + " ")
            continue
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in BLOCK_TAGS:
            end_block()
        elif tag == "br":
            parts.append(" ")
        if m[2]:
            if still_open[tag] > 0:
                close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag))
            continue
        if tag in VOID_TAGS:  # no other element of HTML closes itself
            continue
        # a paragraph ends where a block begins, an item where the next one does
        if open_blocks and tag in BLOCK_TAGS:
            above = stack[open_blocks[-1]][0]
            if above == "p" or above == tag == "li":
                close(open_blocks[-1])
        _, main, boiler, named, link, heading, head = stack[-1]
        named = max(named, _named_boiler(tag, m[4]) if m[4] else 0)
        if tag in MAIN_TAGS:
            # layout names of what encloses an article are forgiven
            main, boiler, named = 1, 0, 2 * (named == 2)
        elif tag in BOILER_TAGS:
            # an article's own header holds its title
            boiler = int(boiler or not (tag == "header" and main))
        still_open[tag] += 1
        n_links += tag == "a"
        if tag in BLOCK_TAGS:
            open_blocks.append(len(stack))
        stack.append((
            tag, main, boiler, named, int(link or tag == "a"),
            int(heading or tag in ("h1", "h2", "h3", "h4", "h5", "h6")),
            int(head or tag in ("head", "title")),
        ))
    end_block()
    return out


def described(page: str) -> list[tuple[str, list[float]]]:
    """(text, FEATURES) of every block."""
    found = blocks(page)
    none = [0.0, 0.0]
    some = any(own[3] for _, own in found)
    out = []
    for i, (text, own) in enumerate(found):
        before = found[i - 1][1][:2] if i else none
        after = found[i + 1][1][:2] if i + 1 < len(found) else none
        place = 2 if own[3] else int(some)
        out.append((text, [*own[:2], *before, *after, own[2], place, *own[4:]]))
    return out


def labelled_table(spark: SparkSession) -> DataFrame:
    """(features, label) of the sample blocks."""
    rows = []
    for page in html_samples.PAGES:
        marks = [text.startswith("[+]") for text, _ in described(page)]
        clean = described(page.replace("[+]", ""))
        rows += [([float(v) for v in x], float(y)) for (_, x), y in zip(clean, marks)]
    return spark.createDataFrame(rows, "x array<double>, label double").select(
        array_to_vector("x").alias("features"), "label"
    )


Node = tuple[int, float, int, int, float]  # feature or -1, threshold, left, right, prediction


def trained_tree(spark: SparkSession) -> list[Node]:
    """Nodes of the tree, the root first, from Spark's saved form of the model."""
    model = DecisionTreeClassifier(maxDepth=10, maxBins=128, seed=1).fit(
        labelled_table(spark).coalesce(1)
    )
    path = work_folder(spark, "html-tree")
    model.save(path)
    rows = spark.read.parquet(f"{path}/data").select(
        "id", "prediction", "leftChild", "rightChild", F.col("split.featureIndex").alias("f"),
        F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("t"),
    ).orderBy("id").collect()
    return [
        (-1 if r.leftChild < 0 else r.f, r.t or 0.0, r.leftChild, r.rightChild, r.prediction)
        for r in rows
    ]


def is_main(x: list[float], tree: list[Node]) -> bool:
    node = tree[0]
    while node[0] >= 0:
        node = tree[node[2] if x[node[0]] <= node[1] else node[3]]
    return node[4] > 0.5


def main_text(page: str, tree: list[Node]) -> str:
    return "\n".join(text for text, x in described(page) if is_main(x, tree))


def extracted(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    tree = trained_tree(pages.sparkSession)

    @F.arrow_udf(T.StringType())
    def text_of(column: pa.Array) -> pa.Array:
        return pa.array([main_text(x.as_py() or "", tree) for x in column], pa.string())

    rows = pages.select("page_id", "url", text_of("html").alias("text"))
    return rows.withColumn("n_chars", F.char_length("text").cast("long"))
