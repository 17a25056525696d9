"""The labelled table of the block classifier: invented pages whose main blocks are marked.

Each page is a list of lines of HTML; a text that starts with [+] belongs to the main
text, every other text does not.
"""

from __future__ import annotations

import random

_LONG = (
    "The council met on Tuesday to weigh the plan for a new bridge over the river, and "
    "after four hours of talk it put the question off until spring, when the survey of "
    "the banks should be ready and its cost known to all who have to pay for it."
)
_MIDDLE = "Engineers expect the work to take two summers, one for each side of the river."
_SHORT = "Nobody disagreed."

ARTICLE = f"""
<html><head><title>Bridge put off</title></head><body>
<header><a href="/">The Daily Record</a><p>News from the valley since 1902</p></header>
<nav><ul><li><a href="/news">News</a></li><li><a href="/sport">Sport</a></li>
<li><a href="/about">About us</a></li></ul></nav>
<div class="ad">Fresh bread every morning at the corner shop.</div>
<article><h1>[+]Bridge put off until spring</h1><p>[+]{_LONG}</p><p>[+]{_SHORT}</p>
<p>[+]{_MIDDLE} <a href="/plan">See the plan.</a></p><p>[+]{_LONG}</p></article>
<aside><h3>Most read</h3><ul><li><a href="/1">Mill reopens</a></li>
<li><a href="/2">Flood of 1953 remembered by those who saw it</a></li></ul></aside>
<footer>&copy; The Daily Record &middot; All rights reserved by the publisher.</footer>
</body></html>
"""

SHORT_ARTICLE = f"""
<body><nav><a href="/a">Home</a> <a href="/b">Archive</a></nav>
<div class="advert">{_MIDDLE}</div>
<article><h1>[+]Notes</h1><p>[+]{_SHORT}</p><p>[+]Rain.</p></article>
<div class="ad">{_SHORT} {_SHORT}</div>
<footer>{_MIDDLE}</footer></body>
"""

MAIN = f"""
<body><div id="menu"><ul><li><a href="/x">Start</a></li><li><a href="/y">Shop</a></li></ul></div>
<div class="cookie-notice"><p>{_MIDDLE} We use cookies to count visits.</p>
<button>Accept</button></div>
<main><h1>[+]How to mend a net</h1><p>[+]{_LONG}</p><h2>[+]What you need</h2>
<ul><li>[+]A needle of hard wood</li><li>[+]Twine</li></ul><p>[+]{_MIDDLE}</p>
<blockquote>[+]{_SHORT}</blockquote>
<form action="/subscribe"><p>Enter your address to get one letter a month from us.</p>
<label>Address</label></form>
<div class="related"><h3>Read on</h3><a href="/r1">How to splice a rope</a></div></main>
<section id="comments"><h2>Comments</h2><article class="comment"><p>{_LONG}</p></article>
<article class="comment"><p>{_SHORT}</p></article></section>
<footer><p>{_LONG}</p></footer></body>
"""

PLAIN = f"""
<body><div><a href="/">Home</a> | <a href="/list">List</a> | <a href="/map">Map</a></div>
<div><h1>[+]A walk along the coast</h1></div>
<div>[+]{_LONG}</div><div>[+]{_LONG} <a href="/photo">A photo</a> {_MIDDLE}</div>
<div>[+]{_MIDDLE} {_MIDDLE}</div><div>[+]{_LONG}</div>
<div><a href="/p">Previous</a> <a href="/n">Next</a></div>
<div>Contact</div><div>Printed in the town</div></body>
"""

TABLES = f"""
<body><table><tr><td><a href="/1">One</a></td><td><a href="/2">Two</a></td></tr></table>
<td>[+]{_LONG}</td><td>[+]{_LONG} {_MIDDLE}</td><td>[+]{_MIDDLE} {_SHORT}</td>
<table><tr><td><a href="/9">{_MIDDLE}</a></td></tr></table>
<p>Last change: May</p></body>
"""

SIDEBAR = f"""
<body><div class="site-header"><p>{_MIDDLE}</p></div>
<div class="sidebar"><h2>About</h2><p>{_LONG}</p><a href="/more">More</a></div>
<article><header><h1>[+]The mill</h1><p>[+]{_SHORT}</p></header>
<p>[+]{_LONG}</p><figure><figcaption>[+]The wheel in winter</figcaption></figure>
<p>[+]{_MIDDLE}</p><div class="share"><a href="/s">Share</a> this page</div>
<aside class="promo">{_MIDDLE} {_SHORT}</aside>
<div class="newsletter"><p>{_MIDDLE}</p></div><p>[+]{_SHORT}</p></article>
<div class="banner">{_LONG}</div><div id="footer">{_MIDDLE}</div></body>
"""

STACKED = f"""
<body><div><h1>[+]A new roof</h1></div><div>[+]{_LONG}</div><div>[+]{_LONG}</div>
<div class="comments"><p>{_LONG}</p><p>{_LONG} {_MIDDLE}</p></div><aside>{_LONG}</aside>
<div>[+]{_LONG} {_MIDDLE}</div><div class="cookie-banner">{_LONG}</div><div>[+]{_LONG}</div>
<form><p>{_LONG}</p></form><div>[+]{_MIDDLE} {_LONG}</div><nav>{_LONG}</nav>
<div>[+]{_LONG}</div><footer>{_LONG}</footer><div class="ad">{_LONG}</div></body>
"""

FRAMED = f"""
<body><main><p>[+]{_LONG}</p><p>[+]{_LONG}</p></main>
<div class="comments"><p>{_LONG}</p></div><aside>{_LONG}</aside><footer>{_LONG}</footer>
<section class="newsletter"><p>{_LONG}</p></section></body>
"""

WRAPPED = f"""
<body><div class="content has-sidebar"><article><h1>[+]The weir</h1><p>[+]{_LONG}</p>
<div class="share">{_MIDDLE}</div><p>[+]{_SHORT}</p></article><p>{_MIDDLE}</p></div>
<div class="comments"><article><p>{_LONG}</p></article></div></body>
"""

# articles with nothing after them, of few words, or of a linked sentence
BARE = [
    f"<article><p>[+]{_LONG}</p><p>[+]{_SHORT}</p></article>",
    f"<article><h1>[+]One</h1><p>[+]{_MIDDLE}</p></article>",
    "<main><h1>[+]Sources</h1><p>[+]<a href=/x>The whole list</a></p><p>[+]Maps</p></main>",
    "<article><h1>[+]Closed</h1></article>",
    f"<article><p>[+]<a href=/a>{_MIDDLE}</a></p></article>",
]


def words(n: int, mark: str = "") -> str:
    """The first n words of a text without end."""
    return mark + " ".join((f"{_LONG} {_MIDDLE} " * (n // 50 + 1)).split()[:n])


def links(n: int, each: int, tag: str = "") -> str:
    """n links of so many words, in one block or each in one of its own."""
    opened, closed = (f"<{tag}>", f"</{tag}>") if tag else ("", " ")
    return "".join(f"{opened}<a href=/{i}>{words(each)}</a>{closed}" for i in range(n))


def _text(draw: random.Random, least: int, most: int) -> int:
    """A length between two bounds, short ones as likely as long ones."""
    return round(least * (most / least) ** draw.random())


def _links(draw: random.Random) -> str:
    if draw.random() < 0.4:
        return f"<div>{links(draw.randrange(2, 15), draw.randrange(1, 5))}</div>"
    return f"<ul>{links(draw.randrange(2, 9), draw.randrange(1, 9), 'li')}</ul>"


def _outside(draw: random.Random, most: int) -> str:
    """Blocks around an article; without an element around it, only short text among links."""
    out = ""
    for _ in range(draw.randrange(0, 4)):
        text = words(_text(draw, 1, most))
        out += draw.choice([
            _links(draw), f"<div>{text}</div>", f"<p>{text}</p>",
            f"<header><p>{words(_text(draw, 1, 60))}</p></header>", f"<aside>{words(_text(draw, 2, 90))}</aside>",
        ])
    return out


def _inside(draw: random.Random, enclosed: bool) -> str:
    """An article's blocks; where nothing encloses it, short paragraphs stand between long ones."""
    out = f"<h1>{words(_text(draw, 1, 30), '[+]')}</h1>" if draw.random() < 0.8 else ""
    if draw.random() < 0.3:
        out = f"<header>{out}</header>" if enclosed else f"<div>{out}</div>"
    n = draw.randrange(1, 9)
    for i in range(n):
        least = 1 if enclosed or 0 < i < n - 1 and draw.random() < 0.4 else 25
        tag = draw.choice(["p", "p", "p", "div", "blockquote"])
        text = words(_text(draw, least, 250), "[+]")
        if draw.random() < 0.15:  # a link or two in a sentence
            text += " " + links(draw.randrange(1, 3), 1)
        out += f"<{tag}>{text}</{tag}>"
        if i < n - 1 and draw.random() < 0.15:
            out += draw.choice([
                _links(draw), f"<aside>{words(40)}</aside>", f"<nav>{links(3, 2, 'li')}</nav>",
                f"<form><p>{words(12)}</p></form>", f"<div class='related'>{words(_text(draw, 3, 60))}</div>",
            ])
    return out


def layouts(n: int = 400) -> list[str]:
    """Pages by rule: link lists, side texts and paragraphs of all lengths, so that words and
    links of a block and of those beside it tell main text from the rest."""
    draw, pages = random.Random(7), []
    for i in range(n):
        tag = ["", "article", "main", ""][i % 4]
        before, after = _outside(draw, 60 if tag else 5), _outside(draw, 60 if tag else 9)
        if not tag:
            before = before and before + _links(draw)  # the article follows links
            after = after and _links(draw) + after
        inside = _inside(draw, bool(tag))
        footer = f"<footer>{words(_text(draw, 2, 60))}</footer>" if draw.random() < 0.7 else ""
        opened, closed = (f"<{tag}>", f"</{tag}>") if tag else ("", "")
        pages.append(f"<body>{before}{opened}{inside}{closed}{after}{footer}</body>")
    # whole pages of one paragraph, and short articles
    pages += [f"<body><p>{words(n, '[+]')}</p></body>" for n in (1, 2, 4, 7, 12, 30, 90)]
    pages += [f"<body><div>{links(n, 2)}</div></body>" for n in (2, 5, 12)]
    pages += [
        f"<nav>{links(4, 1, 'li')}</nav><div>{words(a)}</div><article><p>{words(b, '[+]')}</p><p>{words(c, '[+]')}</p></article><footer>{words(c + 9)}</footer>"
        for a in (3, 9, 40) for b in (1, 6, 20) for c in (1, 4)
    ]
    return pages


PAGES = [
    ARTICLE, SHORT_ARTICLE, MAIN, PLAIN, TABLES, SIDEBAR, STACKED, FRAMED, WRAPPED, *BARE, *layouts(),
]
