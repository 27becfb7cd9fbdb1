import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import url_reputation as U

SF = "/root/testdata/sf0.01"


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    n = min([len(rest), *(rest.find(c) for c in "/?#" if c in rest)])
    tail = rest[n:]
    end = min([len(tail), *(tail.find(c) for c in "?#" if c in tail)])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:n]), tail[:end]


def rule(host, path):
    fit = [r for r in U.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: len(r.name), default=None)


def domain(host):
    bare = host.rsplit("@", 1)[-1]
    head, sep, port = bare.rpartition(":")
    if sep and all(c in "0123456789" for c in port):
        bare = head
    parts = bare.split(".")
    if bare.startswith("[") or len(parts) == 4 and all(x.isdigit() for x in parts):
        return bare, "address"
    two = ".".join(parts[-2:])
    double = len(parts) > 1 and parts[-2] in U.SECOND_LEVEL and len(parts[-1]) == 2 and parts[-1].isascii() and parts[-1].isalpha()
    return (".".join(parts[-3:]), two) if double or two in U.PRIVATE_SUFFIXES else (two, parts[-1])


def quantile(a, b, q):
    """By summing the density of the log odds over a fine grid."""
    t = np.linspace(-150, 150, 600_001)
    f = -a * np.logaddexp(0, -t) - b * np.logaddexp(0, t)
    total = np.cumsum(np.exp(f - f.max()))
    return float(1 / (1 + np.exp(-t[np.searchsorted(total, q * total[-1])])))


@pytest.mark.parametrize(("a", "b"), [(2.5, 7), (0.8, 3), (50, 150), (260.5, 740.25), (3000, 9000), (1.2, 900), (7, 0.9), (0.3, 0.7)])
def test_quantile(spark, a, b):
    df = spark.createDataFrame([(float(a), float(b))], "a double, b double")
    for q in (0.05, 0.2, 0.5):
        assert U.beta_quantile(df, q).first().bound == pytest.approx(quantile(a, b, q), abs=1e-3)


def test_domains(spark):
    hosts = ["a.b.co.kr", "b.com.sg", "x.github.io", "github.io", "10.0.3.4", "192.168.3.4:80", "[::1]:8080", "u@a.example.org:1", "co.uk", "", "single", "a.co.museum", "1.2.3"]
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    got = [tuple(r) for r in df.select(*U.domain_and_suffix(F.col("host"))).collect()]
    assert got == [domain(h) for h in hosts] and got[4] == ("10.0.3.4", "address") and got[0] == ("b.co.kr", "co.kr")


def brute(pages, labels, confidence=0.8):
    outcome = {}
    for key, q, t in labels:
        if key is not None and (q is not None or t is not None):
            outcome[key] = max(outcome.get(key, 0), int(q == 0 or t == 1))
    hosts = {}
    for key, url in pages:
        c = hosts.setdefault(split(url)[0], [0, 0])
        if key in outcome:
            c[0] += 1
            c[1] += outcome[key]
    rate = (sum(c[1] for c in hosts.values()) + 1) / (sum(c[0] for c in hosts.values()) + 2)

    def grouped(key):
        out = {}
        for h, (n, b) in hosts.items():
            c = out.setdefault(key(h), [0, 0])
            c[0] += n
            c[1] += b
        return out

    def strength(groups):
        g = [c for c in groups.values() if c[0]]
        if not g:
            return 1000.0
        total = sum(n for n, _ in g)
        size = total - sum(n * n for n, _ in g) / total - (len(g) - 1)
        excess = sum(n * (b / n - rate) ** 2 for n, b in g) / (rate * (1 - rate)) - (len(g) - 1)
        return 1 / max(1 / 1001, min(0.5, excess / size if size > 0 else 0.0)) - 1

    suffixes, domains = grouped(lambda h: domain(h)[1]), grouped(domain)
    ks, kd, kh = map(strength, (suffixes, domains, hosts))
    sm = {s: (b + ks * rate) / (n + ks) for s, (n, b) in suffixes.items()}
    dm = {d: (b + kd * sm[d[1]]) / (n + kd) for d, (n, b) in domains.items()}
    bound = {}
    for h, (n, b) in hosts.items():
        m = dm[domain(h)]
        bound[h] = quantile(b + kh * m, n - b + kh * (1 - m), 1 - confidence)
    out = []
    for key, url in pages:
        h, p = split(url)
        r = rule(h, p)
        out.append((key, h, p, r and r.name, r.verdict if r else "block" if bound[h] > rate else "allow", bound[h]))
    return out


def same(got, want):
    got, want = sorted(got, key=repr), sorted(want, key=repr)
    assert [x[:5] for x in got] == [x[:5] for x in want]
    assert [x[5] for x in got] == pytest.approx([x[5] for x in want], abs=2e-3)


def test_equals_brute_force(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/A?x://y", "http://example.com/en/", "http://a.example.com/en/x", "http://www.example.com/en/x#y", "http://example.com", "http://x.net/es/1", "http://x.net/fr/", "http://net/es/", "http://xnet/es/", "http://u:p@bad.co.uk:80/q", "ftp://bad.co.uk/é?q", "a://b.org#f/", "://ÄB.org/x/y\nz"]
    pages = [(i, u) for i, u in enumerate(urls)] + [(100 + i, f"http://h{i % 7}.spam.org/{i}") for i in range(300)] + [(None, "http://x.org/"), (101, "http://x.org/")]
    labels = [(100 + i, int(i % 7 != 0), 0) for i in range(250)] + [(3, 0, None), (101, 0, 1), (None, 0, 0), (5, None, None)]
    p = spark.createDataFrame([(*x, "h") for x in pages], "page_id long, url string, host string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = [tuple(r) for r in U.filter_urls(p, lab).collect()]
    same(got, brute(pages, labels))
    assert any(r[4] == "block" and r[3] is None for r in got)
    same([tuple(r) for r in U.filter_urls(p, lab.limit(0)).collect()], brute(pages, []))
    assert U.filter_urls(p.limit(0), lab).collect() == []


def test_query_and_sql(spark):
    pages = [(r.page_id, r.url) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    got = [tuple(r) for r in U.op8_url_reputation(spark, SF).collect()]
    same([(*r[:5], round(r[5], 6)) for r in brute(pages, labels)], got)
    c = duckdb.connect()
    for t in ("pages", "labels"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert sorted(map(tuple, c.sql(U.SQL).fetchall())) == sorted(got)
    assert any(r[4] == "block" and r[3] is None for r in got)
