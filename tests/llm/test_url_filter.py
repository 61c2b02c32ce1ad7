import random
import re

from txnwatch.llm.url_filter import BLOCKED, RULES, Automaton, filter_urls, split_url


def matches(glob, data):
    body = b"".join(b".*" if c == ord("*") else b"." if c == ord("?") else re.escape(bytes([c])) for c in glob.encode())
    return re.fullmatch(body, data, re.S) is not None


def test_automaton_is_every_glob():
    rng = random.Random(2)
    globs = ["".join(rng.choices("ab*?.#", k=rng.randint(0, 12))) for _ in range(60)] + ["*", "", "a" * 70, "*" + "ab" * 40]
    rows = ["".join(rng.choices("ab.#c", k=rng.randint(0, 14))).encode() for _ in range(300)] + [b"", b"a" * 70, b"c" + b"ab" * 40, b"a" * 5000]
    hit = Automaton(globs).matches(rows)
    for i, row in enumerate(rows):
        assert [matches(g, row) for g in globs] == hit[i].tolist()


def brute(url):
    host, path = split_url(None if url is None else url.encode())
    h, p = host.decode(), path.decode()
    fits = [(len(rh + rp), k, rh + rp, v) for k, (v, rh, rp) in enumerate(RULES) if (h == rh or h.endswith("." + rh)) and p.startswith(rp)]
    if fits:
        return h, p, max(fits)[2], max(fits)[3]
    return h, p, None, "block" if any(matches(g, f".{h}#{p}".encode()) for g in BLOCKED) else "allow"


def test_urls(spark):
    urls = [
        None, "", "no scheme.org/", "http://x.org", "http://x.org/", "http://ORG/a", "https://a.example.org/es/1", "https://example.org/en/1x?y=/es/",
        "https://example.org/en/2", "http://my-example.org/es/1", "http://a.com/de/x#/fr/", "http://a.com?x=/fr/", "http://com/fr/", "http://free-bets.example.net/a",
        "http://a.net/x.org/", "http://é.net/login?x", "http://a://b.org/", "http://u@h.com:80/fr/é", "http://a.net/" + "x" * 20000 + "/ads/y",
    ]
    rows = [(i, u, "x", 1) for i, u in enumerate(urls)] + [(None, urls[5], "x", 1), (5, urls[5], "x", 1)]
    got = filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string, rule int")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == brute(r.url)


def test_empty_table(spark):
    assert filter_urls(spark.createDataFrame([], "page_id long, url string")).collect() == []
