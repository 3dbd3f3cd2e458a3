import random

import pytest

from echoline.llm import url_filter


def brute(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        for c in "?#":
            path = path.split(c)[0]
    fit = [(len(h) + len(p), len(h), v == "block", h + p) for v, h, p in rules if (host == h or host.endswith("." + h) or not h) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[3], default if best is None else ("block" if best[2] else "allow")


@pytest.mark.parametrize("most", [2, 500_000])
def test_against_brute_force(spark, most):
    rng = random.Random(2)
    hosts = ["net", "example.net", "a.example.net", "example.com", "org", "x.org", "NET", "badexample.net", "net.", ""]
    paths = ["", "/", "/en/", "/en", "/de/x", "/fr/a/b", "/en/../de/", "?q=/en/", "#/en/", "/fr/?x#y"]
    rules = url_filter.RULES + [(rng.choice(["allow", "block"]), rng.choice(hosts[:6]), rng.choice(["", "/", "/e", "/en/", "/fr/a", "/d"])) for _ in range(12)]
    urls = [f"{rng.choice(['http', 'HTTPS', 'a/b'])}://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(400)]
    urls += [None, "", "no scheme", "://", "x://y://z/", "http://ex\n.org/fr/", "http://example.net/en/" + "a/" * 50_000]
    pages = spark.createDataFrame([(i, u, "r", i) for i, u in enumerate(urls)] + [(0, urls[0], "r", 0)], "page_id long, url string, rule string, url_host int")
    for given in (rules, url_filter.RULES, []):
        found = url_filter.judged(pages, given, max_rules=most).collect()
        assert len(found) == len(urls) + 1
        for r in found:
            assert (r.host, r.path, r.rule, r.verdict) == brute(urls[r.page_id], given), urls[r.page_id][:80]
    assert url_filter.judged(pages.limit(0)).count() == 0
