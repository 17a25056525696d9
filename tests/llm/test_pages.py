"""HTML extraction and WARC archives."""

import base64
import hashlib
import html
import io
import random
import re
import struct

import pytest
import zstandard

from mailscreen.llm import html_extract, html_samples, warc
from tests.llm.odd import clashing

SCHEMA = "page_id long, url string, html string"
LONG = "<article>" + "".join(f"<p>Paragraph {i} &amp; more</p>" for i in range(20_000)) + "</article>"
ROWS = [
    (1, "http://a", "<article><p>One</p></article>"), (2, "http://b", None), (3, None, ""),
    (None, "http://c", "<article><p>One</p></article>"), (None, None, None), (4, "u\r\nX: y%", LONG),
    (5, "http://e", "<article><p>One</p></article>"), (5, "http://e", "<article><p>One</p></article>"),
    (1, "http://a", "<article><p>One</p></article>"), (6, "http://f", "\U0001F600 <b>unclosed"),
]


@pytest.fixture(scope="module")
def tree(spark):
    return html_extract.trained_tree(spark)


def article_by_hand(page):
    inside = re.search(r"<article>(.*)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1)>", inside)
    lines = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in parts]
    return "\n".join(x for x in lines if x)


def test_article_of_every_given_page(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r for r in html_extract.extracted(clashing(pages, "text")).collect()}
    for p in pages.collect():
        assert got[p.page_id].text == article_by_hand(p.html)
        assert got[p.page_id].n_chars == len(got[p.page_id].text)


def without_names(page):
    return re.sub(r"""\s(?:class|id)=("[^"]*"|'[^']*'|[^\s>]+)""", "", page)


def test_given_pages_without_names(spark, sf_dir, tree):
    for p in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        assert html_extract.main_text(without_names(p.html), tree) == article_by_hand(p.html)


def test_tree_fits_its_labelled_table(tree):
    def fits(page):
        marked = [t.removeprefix("[+]") for t, _ in html_extract.described(page) if t.startswith("[+]")]
        return html_extract.main_text(page.replace("[+]", ""), tree) == "\n".join(marked)

    rules = len(html_samples.layouts())
    assert all(map(fits, html_samples.PAGES[:-rules]))
    # pages by rule hold blocks that words and links cannot tell apart
    assert sum(map(fits, html_samples.PAGES)) >= 0.95 * len(html_samples.PAGES)
    assert sum(len(html_extract.described(p)) for p in html_samples.PAGES) > 1000


def test_words_and_links_of_blocks_and_neighbours_decide(tree):
    names = html_extract.FEATURES
    used = {names[f] for f, *_ in tree if f >= 0}
    assert {"words", "link_density", "words_before", "words_after", "link_density_after"} <= used
    assert names[tree[0][0]] == "link_density"
    place = dict.fromkeys(names, 0.0)
    # nothing encloses these blocks: the same words among links, and between long paragraphs
    short = place | {"words": 6.0, "words_before": 60.0, "words_after": 60.0}
    assert html_extract.is_main(list(short.values()), tree)
    listed = short | {"words_before": 4.0, "link_density_before": 1.0, "words_after": 2.0, "link_density_after": 1.0}
    assert not html_extract.is_main(list(listed.values()), tree)
    assert not html_extract.is_main(list((short | {"link_density": 1.0, "links": 3.0}).values()), tree)


LONG_TEXT = " ".join("It took the whole of that year before anyone asked where the money had come from.".split() * 3)
TWELVE = "".join(f'<a href="/{i}">Three small words</a> ' for i in range(12))


@pytest.mark.parametrize("page, want", [
    (f"<body><div>{TWELVE}</div><p>{LONG_TEXT}</p></body>", LONG_TEXT),
    (f"<body><p>{LONG_TEXT}</p><div>{TWELVE}</div></body>", LONG_TEXT),
    (f"<article><p>{LONG_TEXT}</p><div>{TWELVE}</div><p>{LONG_TEXT}</p></article>", f"{LONG_TEXT}\n{LONG_TEXT}"),
    (f'<article class="post comments-open"><p>{LONG_TEXT}</p></article>', LONG_TEXT),
    (f'<div class="comments-closed"><article><p>{LONG_TEXT}</p></article></div>', LONG_TEXT),
    (f'<article><header class="entry-header"><h1>Title</h1></header><p>{LONG_TEXT}</p></article>', f"Title\n{LONG_TEXT}"),
    (f'<article><div class="related-work"><p>{LONG_TEXT}</p></div></article>', LONG_TEXT),
    (f'<article><div class="notice-board-report">{LONG_TEXT}</div></article>', LONG_TEXT),
    ("<body><p>One short paragraph only.</p></body>", "One short paragraph only."),
    (f"<body><div><a href=/x/>One two</a> <a href=/y/>three four</a></div><p>{LONG_TEXT}</p></body>", LONG_TEXT),
])
def test_common_shapes(tree, page, want):
    assert html_extract.main_text(page, tree) == want
    assert html_extract.main_text(without_names(page), tree) == want


def test_unseen_layouts(tree):
    long = "It took the whole of that year before anyone asked where the money had come from. " * 3
    page = f"""<body class="has-sidebar"><div role="navigation"><a href=/>Home</a></div>
    <main id="content"><h1>Money</h1><p>{long}</p><p>Short.<!-- {long} --></p>
    <div class="ad-slot">{long}</div><form><p>{long}</p></form></main>
    <div class="comments"><p>{long}</p></div><aside>{long}</aside><script>{long}</script>"""
    text = " ".join(long.split())
    assert html_extract.main_text(page, tree) == f"Money\n{text}\nShort."


def test_layout_names_around_an_article_are_forgiven(tree):
    page = """<body><div class="page with-header"><div class="content has-sidebar"><article><h1>Title</h1>
    <p>One</p><div class="share">Two</div></article></div></div>
    <div class="comments"><article><p>Three</p></article></div></body>"""
    assert html_extract.main_text(page, tree) == "Title\nOne"


def test_self_closed_icons_hide_nothing(tree):
    for icon in ('<svg class="i"/>', "<math/>", '<SVG a="x>y" />', '<svg><path d="M0"/></svg>',
                 "<svg>hidden</svg>", '<a href="/"><svg class="i"/></a>'):
        page = f"<body>{icon}<article><h1>Title</h1><p>One</p></article></body>"
        assert html_extract.main_text(page, tree) == "Title\nOne", icon
    assert html_extract.blocks("<script src=x />hidden</script>") == []
    for page in ("<svg " * 30_000, "<svg>" * 30_000, '<svg a="' * 30_000, "<svg/>" * 30_000):
        html_extract.described(page)


def test_blocks_of_broken_markup():
    page = '<p class="x"">one &amp; two<br>three<p>four <a href=/x>five</a><div title="a>b">six &nbsp; 7'
    assert [t for t, _ in html_extract.blocks(page)] == ["one & two three", "four five", "six 7"]
    # inline elements end with the paragraph they stand in; a slash closes no element of HTML
    page = "<p><b><i><u><s>one<p>two</b></i></u></s><div/>three<li>four<li>five</div>"
    assert [t for t, _ in html_extract.blocks(page)] == ["one", "two", "three", "four", "five"]
    html_extract.described("<p><div>" + "<b>" * 30_000 + "<p>x</p>" * 30_000)
    for page in ("<" * 50_000, "<a " * 30_000, "<!--" * 30_000, '<a href="' * 30_000, "</p>" * 30_000):
        html_extract.described(page)


def test_extraction_of_odd_rows(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    got = html_extract.extracted(rows).collect()
    assert len(got) == len(ROWS)
    assert all(r.text is not None for r in got)
    long = next(r for r in got if r.page_id == 4)
    assert long.text.count("\n") == 19_999
    assert html_extract.extracted(spark.createDataFrame([], SCHEMA)).count() == 0


# ------------------------------------------------------------------ WARC


def by_hand(rows):
    first = {}
    for i, _, page in rows:
        if i is not None:
            first[page or ""] = min(first.get(page or "", i), i)
    out = []
    for i, url, page in rows:
        data = (page or "").encode()
        origin = first.get(page or "")
        again = origin is not None and i != origin
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((i, url, len(data), digest, "revisit" if again else "response",
                    origin if again else None, None if again else page or ""))
    return sorted(out, key=repr)


def test_round_trip(spark):
    pages = clashing(spark.createDataFrame(ROWS, SCHEMA), "digest", "first_id", "refers_to", "path")
    got = [tuple(r) for r in warc.archived(pages).collect()]
    assert sorted(got, key=repr) == by_hand(ROWS)
    assert warc.archived(spark.createDataFrame([], SCHEMA)).count() == 0


def test_round_trip_of_given_pages_in_many_archives(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").repartition(3)
    params = warc.ArchiveParams(archive_bytes=20_000, sample_bytes=10_000)
    got = sorted((tuple(r) for r in warc.archived(pages, params).collect()), key=repr)
    assert got == by_hand([tuple(r) for r in pages.select("page_id", "url", "html").collect()])


def test_small_payloads_are_never_revisits(spark):
    params = warc.ArchiveParams(least_bytes=1000)
    got = warc.archived(spark.createDataFrame(ROWS, SCHEMA), params).collect()
    assert {r.record_type for r in got} == {"response"}


@pytest.fixture
def archive(tmp_path):
    archive = warc.Archive(str(tmp_path), warc.ArchiveParams(sample_bytes=2000))
    data = [warc.record(i, f"http://x/{i}", b"<p>page %d</p>" % i * 9, None, False, archive.params)
            for i in range(60)]
    for x in data:
        archive.add(x)
    with open(archive.close()[0], "rb") as file:
        return file.read(), data


def test_layout_and_other_readers(archive):
    raw, data = archive
    magic, size = struct.unpack("<II", raw[:8])
    assert magic == 0x184D2A5D
    content = zstandard.ZstdCompressionDict(raw[8 : 8 + size])
    rest, seen = raw[8 + size :], []
    while rest:  # one frame for every record
        frame = zstandard.ZstdDecompressor(dict_data=content).decompressobj()
        seen.append(frame.decompress(rest))
        rest = frame.unused_data
    assert seen == data == list(warc.frames(io.BytesIO(raw)))
    padded = raw[: 8 + size] + struct.pack("<II", 0x184D2A50, 3) + b"abc" + raw[8 + size :]
    assert list(warc.frames(io.BytesIO(padded))) == data


def test_faults_are_found(archive):
    raw, data = archive
    for broken in (raw[:-5], raw[8:], raw[:20], b""):
        with pytest.raises(ValueError):
            list(warc.frames(io.BytesIO(broken)))
    good = data[0]
    for broken in (
        good.replace(b"WARC/1.1", b"HTTP/1.1"), good[:-1], good + good, good.replace(b"page", b"pane"),
        good.replace(b"Content-Length: ", b"Content-Length: 1", 1), good.replace(b"WARC-Type:", b"WARC-Type"),
        good.replace(b"response\r\nWARC-R", b"metadata\r\nWARC-R"),
    ):
        with pytest.raises(ValueError):
            warc.parsed(broken)
