"""URL and domain extraction as native array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailscreen import lexicons as lx
from mailscreen.functions.text import let, strip_unescaped_html, unescape


def clean_url(c: Column) -> Column:
    """Drop closing punctuation that belongs to the sentence, not to the URL."""
    return F.regexp_replace(c, lx.URL_TRAILING, "")


def find_urls(c: Column) -> Column:
    """Cleaned URLs of a text in order of appearance, repeats included."""
    found = F.transform(F.regexp_extract_all(c, F.lit(lx.URL), F.lit(0)), clean_url)
    return F.filter(found, lambda u: u != "")


def nested_urls(urls: Column) -> Column:
    """URLs carried inside the query part of other URLs (open-redirect targets)."""
    with_query = F.filter(urls, lambda u: F.contains(u, F.lit("?")))
    return F.flatten(F.transform(with_query, lambda u: find_urls(F.substr(u, F.locate("?", u)))))


def outer_urls(unescaped: Column, stripped: Column) -> Column:
    """Distinct URLs that stand in a mail, given its decoded body and its visible text.

    The decoded body shows link targets inside markup, the visible text whatever only
    appears once markup is gone. Without markup or a second layer of references the
    visible text holds no other URLs.
    """
    visible = F.when(
        F.contains(unescaped, F.lit("<")) | F.contains(unescaped, F.lit("&")),
        find_urls(stripped),
    ).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(find_urls(unescaped), visible))


def urls_of(unescaped: Column, stripped: Column) -> Column:
    """Distinct URLs of a mail: those that stand in it, then those that they carry."""
    outer = outer_urls(unescaped, stripped)
    return let(outer, lambda urls: F.array_distinct(F.concat(urls, nested_urls(urls))))


def extract_urls(body: Column) -> Column:
    return let(
        let(F.coalesce(body, F.lit("")), unescape),
        lambda decoded: let(
            strip_unescaped_html(decoded), lambda stripped: urls_of(decoded, stripped)
        ),
    )


def extract_domains(urls: Column) -> Column:
    """Distinct lower-case hosts of the URLs that carry a scheme, in order."""
    hosts = F.transform(urls, lambda u: F.lower(F.regexp_extract(u, lx.URL_HOST, 1)))
    return F.array_distinct(F.filter(hosts, lambda h: h != ""))


def has_ip_url(urls: Column) -> Column:
    return F.exists(urls, lambda u: u.rlike(lx.IP_URL))


def has_shortener(domains: Column) -> Column:
    return F.arrays_overlap(domains, F.split(F.lit("\n".join(lx.SHORTENER_HOSTS)), "\n"))


def count_risky_tlds(domains: Column) -> Column:
    return F.size(F.filter(domains, lambda d: d.rlike(lx.RISKY_TLD_HOST)))


def count_redirects(urls: Column) -> Column:
    return F.size(F.filter(urls, lambda u: u.rlike(lx.REDIRECT_PARAM)))


def avg_url_length(urls: Column) -> Column:
    total = F.aggregate(urls, F.lit(0), lambda acc, u: acc + F.length(u))
    return F.when(F.size(urls) > 0, F.round(total / F.size(urls), 2)).otherwise(F.lit(0.0))


def max_url_length(urls: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(urls, lambda u: F.length(u))), F.lit(0))
