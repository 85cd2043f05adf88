"""Url rules: trie, join and brute force agree."""

import random
from urllib.parse import urlsplit

import pytest

from cardwatch.llm import url_filter

SCHEMA = "page_id long, url string"
RULES = "host string, path string, verdict string"


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, path = rest[:cut].lower(), rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(h.split(".")), len(p), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, 0, None, "allow"))
    return host, path, best[3], best[4]


def cases():
    r = random.Random(2)
    hosts = ["com", "a.com", "b.a.com", "xa.com", "org", "www.org"]
    paths = ["/", "/en", "/en/", "/en/x", "/english", "/e", "", "/en//x"]
    rules = sorted({(r.choice(hosts), r.choice(paths)): r.choice(["allow", "block"]) for _ in range(14)}.items())
    rules = [(h, p, v) for (h, p), v in rules]
    urls = [f"{r.choice(['http', 'X'])}://{h.upper() if r.random() < 0.3 else h}{p}{t}" for h in hosts for p in paths for t in ("", "?q=/en/", "#/x", "y")]
    urls += [None, "", "a.com/en/", "http://", "http://a.com://en/", "://com/", urls[0]]
    return list(enumerate(urls)), rules


@pytest.mark.parametrize("trie_rules", [1000, 0])
def test_equals_brute_force(frame, trie_rules):
    urls, rules = cases()
    found = url_filter.judge_urls(frame(urls, SCHEMA), frame(rules, RULES), trie_rules=trie_rules).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in found} == {k: brute(u, rules) for k, u in urls}


def test_host_and_path_like_the_standard_library(frame):
    found = url_filter.judge_urls(frame([(1, "https://A.example.com/x/y?z#q")], SCHEMA), frame([], RULES)).first()
    parts = urlsplit("https://a.example.com/x/y?z#q")
    assert (found.host, found.path, found.rule, found.verdict) == (parts.netloc, parts.path, None, "allow")


def test_empty_table_and_further_columns(frame):
    pages = frame([], "page_id long, url string, host string, rule string")
    assert url_filter.judge_urls(pages, frame([("com", "/", "block")], RULES)).collect() == []
