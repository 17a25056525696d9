from pyspark.sql import functions as F

from mailscreen.functions import urls


def test_extract_urls(one):
    cases = {
        "visit http://ejemplo.com/login.": ["http://ejemplo.com/login"],
        "(https://phish.net/page).": ["https://phish.net/page"],
        '<a href="http://a.com/x">http://b.com</a> http://a.com/x': ["http://a.com/x", "http://b.com"],
        "see www.site.org/a, xwww.no.org éwww.no.org": ["www.site.org/a"],
        '<a href="http://ok.com?u=1&amp;r=http://evil.tk/p">': [
            "http://ok.com?u=1&r=http://evil.tk/p", "http://evil.tk/p"],
        "<!-- ftp://h.example/x; -->": ["ftp://h.example/x"],
        "&amp;#104;ttp://late.com": ["http://late.com"],
        "HTTPS://UP.COM!!": ["HTTPS://UP.COM"],
        "http://": [],
        "": [],
    }
    assert one(urls.extract_urls, *cases) == list(cases.values())


def test_long_url_is_cut_at_the_pattern_limit(one):
    found = one(urls.extract_urls, "http://" + "a" * 3000)[0]
    assert found == ["http://" + "a" * 3000]


def test_extract_domains(one):
    build = lambda c: urls.extract_domains(F.split(c, " "))
    cases = {
        "https://evil.com/login http://bank.com:8080/": ["evil.com", "bank.com"],
        "http://A.com HTTP://a.COM/x www.b.org ftp://c.net#f": ["a.com", "c.net"],
        "http://user@host.com/": ["user@host.com"],
        "nothing": [],
    }
    assert one(build, *cases) == list(cases.values())


def test_url_predicates(one):
    many = lambda f: lambda c: f(F.filter(F.split(c, " "), lambda u: u != ""))
    sample = ["http://10.0.0.1/x", "http://10.0.0.1.evil.com", "http://1.2.3.4", "www.1.2.3.4", ""]
    assert one(many(urls.has_ip_url), *sample) == [True, False, True, False, False]
    assert one(many(urls.has_shortener), "bit.ly", "www.bit.ly", "x.com t.co", "") == [
        True, False, True, False]
    assert one(many(urls.count_risky_tlds), "a.tk b.xyz c.com", "tk", "a.tk.com") == [2, 0, 0]
    assert one(many(urls.count_redirects), "a?next=1 b?x=1&return_to=2 c?nexta=1 d?URL_url=3", "") == [3, 0]
    assert one(many(urls.avg_url_length), "ab abcd abcd", "") == [3.33, 0.0]
    assert one(many(urls.max_url_length), "ab abcd", "") == [4, 0]
