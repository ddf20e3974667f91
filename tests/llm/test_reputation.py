import math

import pytest
from helpers import empty

from weekwatch.llm import reputation as R

PAGES, LABELS = "page_id long, url string", "doc_id long, quality int, toxic int"


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([i for i, c in enumerate(rest) if c in "/?#"], default=len(rest))
    host, rest = rest[:end], rest[end:]
    path = rest[: min([i for i, c in enumerate(rest) if c in "?#"], default=len(rest))]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def plain_domain(host):
    w = host.split(".")
    if w[-1].split(":")[0].isdigit() and w[-1].count(":") <= 1 and (":" not in w[-1] or w[-1].split(":")[1].isdigit()):
        return host, ""
    two = ".".join(w[-2:])
    if two in R.DOUBLE_SUFFIXES and two != host:
        return ".".join(w[-3:]), two
    return two, w[-1]


def plain_shrink(level):
    """{key: (n, x, mean of the parent)} -> ({key: mean}, strength)."""
    top = sum(x * (x - 1) - n * (n - 1) * m * m for n, x, m in level.values())
    low = sum(n * (n - 1) * m * (1 - m) for n, x, m in level.values())
    k = 1 / min(max(top / low if low else 0, 1 / 1001), 1 / 3) - 1
    return {key: (x + k * m) / (n + k) for key, (n, x, m) in level.items()}, k


def plain(pages, labels, limit=R.LIMIT, error=R.ERROR):
    bad = {}
    for i, q, t in labels:
        if i is not None and (q is not None or t is not None):
            bad[i] = max(bad.get(i, 0), int(q == 0 or t == 1))
    hosts = {}
    for i, url in pages:
        n, x = hosts.get(plain_parts(url)[0], (0, 0))
        hosts[plain_parts(url)[0]] = (n + (i in bad), x + bad.get(i, 0))
    domains, suffixes = {}, {}
    for h, (n, x) in hosts.items():
        d, s = plain_domain(h)
        a, b, _ = domains.get(d, (0, 0, s))
        domains[d] = (a + n, b + x, s)
        a, b = suffixes.get(s, (0, 0))
        suffixes[s] = (a + n, b + x)
    mean = (sum(x for _, x in hosts.values()) + 0.5) / (sum(n for n, _ in hosts.values()) + 1)
    m_s, _ = plain_shrink({s: (n, x, mean) for s, (n, x) in suffixes.items()})
    m_d, _ = plain_shrink({d: (n, x, m_s[s]) for d, (n, x, s) in domains.items()})
    m_h, k = plain_shrink({h: (n, x, m_d[plain_domain(h)[0]]) for h, (n, x) in hosts.items()})
    out = []
    for i, url in pages:
        host, path = plain_parts(url)
        fits = [(len(h + p), h + p, v) for h, p, v in R.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        m, n = m_h[host], hosts[host][0]
        bound = m - math.sqrt(m * (1 - m) / (n + k + 1) * (1 - error) / error)
        rule, verdict = max(fits)[1:] if fits else (None, "block" if bound > limit else "allow")
        out.append((i, host, path, rule, verdict))
    return sorted(out, key=str)


def check(spark, pages, labels, **k):
    got = R.judge(spark.createDataFrame(pages, PAGES).repartition(5), R.outcomes(spark.createDataFrame(labels, LABELS)), **k)
    got = sorted((tuple(r) for r in got.select("page_id", "host", "path", "rule", "verdict").collect()), key=str)
    assert got == plain(pages, labels, **k)
    return got


def test_pages_against_a_plain_version(spark, sf):
    pages = [(r.page_id, r.url) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    check(spark, pages, labels)
    assert {r[4] for r in check(spark, pages, [(i, 0, 0) for i, _ in pages])} == {"allow", "block"}


@pytest.mark.parametrize("hot", [1, 4000])
def test_hosts_domains_and_suffixes(spark, hot, monkeypatch):
    monkeypatch.setattr(R, "HOT_SHARE", 50)
    pages, labels = [], []
    for h in range(120):
        host = ("bad" if h % 4 == 0 else "good") + f"{h}.{'spam' if h % 8 == 0 else 'site'}{h % 6}.{('org', 'co.uk', 'info')[h % 3]}"
        for j in range(3 * (1 + h % 23)):
            i = len(pages)
            pages.append((i, f"https://{host}/{j}?x=://y"))
            if j % 2 == 0:
                labels.append((i, int(h % 4 != 0), 0))
    pages += [(10_000 + i, f"http://hot.host.org/{i}") for i in range(hot)]
    labels += [(10_000 + i, 1, 0) for i in range(0, hot, 3)]
    got = check(spark, pages, labels)
    blocked = {r[1] for r in got if r[4] == "block"}
    assert blocked and all(h.startswith("bad") for h in blocked)


def test_rules(spark):
    verdict = lambda url: check(spark, [(1, url)], [])[0][3:]
    assert verdict("http://www.Example.com/en/1") == ("www.example.com/en/", "allow")
    assert verdict("http://m.example.com/en/1") == ("example.com/en/", "block")
    assert verdict("http://a.www.example.com/en/") == ("www.example.com/en/", "allow")
    assert verdict("http://example.com/fr/en/") == ("com/", "allow")
    assert verdict("http://notexample.com/en/") == ("com/", "allow")
    assert verdict("http://x.net/es/?a") == ("net/es/", "block") and verdict("http://x.net/es") == (None, "allow")
    assert verdict("http://x.com?/en/") == (None, "allow")


def test_awkward_rows(spark):
    pages = [(1, None), (2, ""), (3, "no scheme.com/en/"), (None, "http://a.com/"), (None, None), (4, "http:///path"), (5, "x://1.2.3.4:80/a#b"), (5, "x://1.2.3.4:80/a#b"),
             (6, "http://co.uk/"), (7, "http://a.b.co.uk"), (8, "HTTP://ÜBER.Example.COM/en/\n/x"), (9, "a\nb://host.net/fr/" + "y" * 70_000), (10, "http://com/")]
    labels = [(1, None, None), (2, 0, None), (5, 1, 0), (5, None, 1), (None, 0, 1), (7, 1, None)]
    check(spark, pages, labels)
    df = spark.createDataFrame(pages, PAGES).selectExpr("*", "'x' as host", "2 as rule", "3 as n", "true as __hot")
    assert R.judge(df, R.outcomes(spark.createDataFrame(labels, LABELS))).count() == len(pages)
    assert R.judge(empty(spark, PAGES), R.outcomes(empty(spark, LABELS))).count() == 0
    assert check(spark, pages, [])
