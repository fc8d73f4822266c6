"""URL filters on generated pages: against a plain version, and the registered SQL against both."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import url_filter
from loomgraph.llm.sql import ORACLES

from llm_plain import joined

SCHEMA = "page_id long, url string, html string"
HOSTS = ["a.com", "example.com", "x.Example.com", "n.net", "example.net", "sub.example.net", "b.org", "h.io", "k.io", "notcom", "com"]


def generated(seed, pages=500):
    rng = np.random.default_rng(seed)
    pick = lambda x: x[int(rng.integers(0, len(x)))]
    url = lambda: f"{pick(['http', 'https'])}://{pick(HOSTS)}/{pick(['en', 'de', 'es', 'fr'])}/{int(rng.integers(0, 90))}{pick(['', '', '?q=1', '#top'])}"
    rows = []
    for i in range(pages):
        u, html = url(), "<p>canonical text</p>"
        if rng.random() < 0.5:
            v = pick([url(), url(), "/en/5", "other", "//k.io/en/3", "", "?x"])
            html += pick([f'<link rel="canonical" href="{v}">', f"<LINK\nhref='{v}'\n rel=canonical >", f"<meta http-equiv=refresh content='0; url={v}'>", f"<meta\n content='5;URL={v}' HTTP-EQUIV=\"refresh\">", f'<link rel=icon href="{v}">'])
        rows.append((i, u, html))
    odd = [(9000, None, '<link rel=canonical href="http://a.com/en/1">'), (9001, "", None), (9002, "com/en/", None), (9003, "http:///en/", None), (9004, "http://a.com/en/1", None), (9004, "http://a.com/en/1", None)]
    chain = [(9100 + i, f"http://c{i}.io/", f'<link rel=canonical href="http://c{i + 1}.io/">') for i in range(30)] + [(9130, "http://c30.io/", "<meta http-equiv=refresh content='0;url=http://a.com/en/zz'>")]
    return rows + odd + chain


def parts(url):
    if url is None or "://" not in url:
        return "", "", None
    host, path, query = re.match(r"([^/?#]*)([^?#]*)([^#]*)", url.split("://", 1)[1], re.S).groups()
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    return host, path, (host + path + query) if host else None


def rule(host, path, rules):
    fit = [(-len(h + p), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return min(fit)[1:] if fit else (None, None)


def target(base, t):
    scheme, rest = base.split("://", 1)
    root, path = f"{scheme}://{re.match('[^/?#]*', rest)[0]}", parts(base)[1]
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*://", t):
        return t
    if t.startswith("//"):
        return f"{scheme}:{t}"
    return root + t if t.startswith("/") else root + (path[: path.rfind("/") + 1] or "/") + t


def plain(rows, rules=url_filter.RULES, log=(), joins=True):
    links = list(log)
    for _, url, html in rows:
        for tag in re.findall(r"<(?:link|meta)\b[^>]*>", html or "", re.I):
            m = None
            if re.search(r"""^<link\b.*\brel\s*=\s*["']?canonical\b""", tag, re.I | re.S):
                m = re.search(r"""\bhref\s*=\s*["']?([^"'\s>]+)""", tag, re.I)
            elif re.search(r"""^<meta\b.*\bhttp-equiv\s*=\s*["']?refresh\b""", tag, re.I | re.S):
                m = re.search(r"""\burl\s*=\s*["']?([^"'\s>]+)""", tag, re.I)
            if m and url is not None and "://" in url:
                links.append((url, target(url, m[1])))
    ends = {u: parts(u) for pair in links for u in pair}
    nodes = sorted({p[2] for p in ends.values() if p[2]})
    index = {n: i for i, n in enumerate(nodes)}
    comp = joined(range(len(nodes)), [(index[ends[a][2]], index[ends[b][2]]) for a, b in links if joins and ends[a][2] and ends[b][2]])
    verdict = {}
    for host, path, node in ends.values():
        if node and (v := rule(host, path, rules)[0]):
            verdict.setdefault(comp[index[node]], set()).add(v)
    out = []
    for i, url, _ in rows:
        host, path, node = parts(url)
        v, r = rule(host, path, rules)
        out.append((i, host, path, r, v or min(verdict.get(comp[index[node]], {"allow"}) if node in index else {"allow"})))
    return sorted(out, key=str)


def judged(df):
    return sorted((tuple(r)[:5] for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", [0, 1])
def test_components_against_a_plain_version_and_the_sql(spark, tmp_path, seed):
    import duckdb

    rows = generated(seed)
    d = spark.createDataFrame(rows, SCHEMA)
    want = plain(rows)
    assert want != plain(rows, joins=False)
    assert dict((r[0], r[4]) for r in want)[9100] == "block"
    clash = d.repartition(5)
    for c in ("host", "path", "node", "rule", "verdict", "component", "id", "from_url", "to", "v", "__r"):
        clash = clash.withColumn(c, F.lit("x"))
    assert judged(url_filter.judge(clash)) == want
    d.write.parquet(str(tmp_path / "pages.parquet"))
    got = duckdb.sql(f"WITH pages AS (SELECT * FROM '{tmp_path}/pages.parquet/*.parquet') SELECT page_id, host, path, rule, verdict FROM ({ORACLES['op5_url_filters']})").fetchall()
    assert sorted(got, key=str) == want


def test_redirect_log(spark):
    rows = [(0, "http://h.io/d", None), (1, "http://h.io/f", None), (2, "http://h.io/g", None)]
    log = [("http://h.io/d", "http://h.io/e"), ("http://h.io/e", "http://b.org/es/1"), ("https://h.io/f#x", "http://h.io/g"), ("http://h.io/g", "http://n.net/de/1"), ("http://h.io/g", "http://h.io/d")]
    d = spark.createDataFrame(rows, SCHEMA)
    for some in (log[:2], log[2:4], log):
        got = url_filter.judge(d, redirects=spark.createDataFrame(some, "from_url string, to_url string"))
        assert judged(got) == plain(rows, log=some)


def test_many_rules_are_joined(spark):
    rng = np.random.default_rng(4)
    rules = sorted({(["allow", "block"][int(rng.integers(0, 2))], HOSTS[int(rng.integers(0, len(HOSTS)))].lower(), ["", "/", "/en", "/en/", "/de/1", "/es/2", "/fr/"][int(rng.integers(0, 7))]) for _ in range(300)})
    rows = generated(7)
    d = spark.createDataFrame(rows, SCHEMA)
    assert len(rules) > url_filter.INLINE and judged(url_filter.judge(d, rules)) == plain(rows, rules)
    assert judged(url_filter.judge(d, spark.createDataFrame(rules[:9], "verdict string, host string, path string"))) == plain(rows, rules[:9])
    assert judged(url_filter.judge(d, [])) == plain(rows, [])


def test_an_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert url_filter.judge(empty).collect() == [] and url_filter.judge(empty.select("html", "url", "page_id")).collect() == []


def test_url_links_in_tags_broken_over_lines(spark):
    rows = [
        (0, "http://a.com/en/1", None), (1, "http://n.net/de/8", None),
        (2, "http://h.io/a", '<link\nrel="canonical"\nhref="http://a.com/en/1">'),
        (3, "http://h.io/b", '<LINK href="http://a.com/en/1"\r\n  rel=canonical>'),
        (4, "http://h.io/c", "<meta\n http-equiv=refresh\n content='0;\n url=http://org/es/x'>"),
        (5, "http://h.io/d", '<link\nrel="stylesheet" href="http://a.com/en/1">'),
    ]
    got = {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {0: "block", 1: "allow", 2: "block", 3: "block", 4: "block", 5: "allow"}
