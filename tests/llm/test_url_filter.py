import pytest

from tamarind.llm import url_filter as U


def lower(x):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in x)


def plain(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
        host, rest = lower(rest[:end]), rest[end:]
        path = rest[: min([i for i in map(rest.find, "?#") if i >= 0], default=len(rest))]
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


URLS = [
    None, "", "no scheme", "http://", "http://ORG", "http://org/", "https://a.example.ORG/es/x?y=/z", "http://example.org/es", "http://example.org/en/12#t",
    "http://badexample.org/es/1", "ftp://x.com/fr/../de/", "http://x.com/de/1", "http://com/de/", "http://x.com?/de/", "a://b://c.com/fr/", "http://É.com/de/", "http://x.com:80/de/",
    "http://.org/", "http://..com/de/a", "HTTP://X.Example.Org/EN/1", "http://x.net/de/\n1", "http://x.com/de/" + "y" * 50_000,
] * 2


@pytest.mark.parametrize("blocks", [1 << 18, 1])
def test_against_plain(spark, monkeypatch, blocks):
    monkeypatch.setattr(U, "MAX_BLOCKS", blocks)
    rules = U.RULES + [("h%d.net" % i, "/p%d" % (i % 7), "block") for i in range(300)] + [("dup.net", "/", "allow"), ("dup.net", "/", "block")]
    urls = URLS + ["http://s.h%d.net/p%d/x" % (i, i % 9) for i in range(300)]
    pages = spark.createDataFrame([(i // 2, u, "h", "v") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string")
    got = U.judge(pages, spark.createDataFrame([*rules, (None, "/", "block")], "host string, path string, verdict string")).collect()
    want = [(i // 2, *plain(u, rules)) for i, u in enumerate(urls)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_empty(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    rules = spark.createDataFrame(U.RULES, "host string, path string, verdict string")
    assert U.judge(none, rules).collect() == []
    one = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    assert [tuple(r) for r in U.judge(one, rules.filter("false")).collect()] == [(1, "a.org", "/", None, "allow")]
