import re

import duckdb

from fathomline.llm import sql, urlfilter

URLS = [None, "", "no scheme", "http://A.Example.NET/en/1?x#y", "https://x.example.com/de/9", "http://example.org/fr/7/", "ftp://net/", "http://net", "http://xnet/a", "http://b.net?/en/", "http://É.COM/Ü/1.html#://", "a://b://c/d", "http://h.com/" + "/".join("abcdefg"), "http://h.com/" + "x" * 80, "http://example.net/en/4", "http://example.net/en", "http://h.com/a\nb/c"]


def plain(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(h + p, v) for v, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *max(fits, key=lambda x: len(x[0]), default=(None, None))


def test_rules_on_edge_urls(spark):
    rows = [(i, u, "x") for i, u in enumerate(URLS)] + [(None, URLS[3], "x"), (3, URLS[3], "x")]
    got = urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string, template string")).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, rule, verdict = plain(URLS[3 if r.page_id is None else r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict in ("block", "allow") and verdict in (None, r.verdict)
    assert urlfilter.judge(spark.createDataFrame([], "page_id long, url string")).collect() == []


def test_variable_segments_become_wildcards(spark):
    rows = [(i, f"http://h.com/user/name{chr(97 + i)}/posts") for i in range(20)] + [(100, "http://h.com/about/us")]
    got = {r.page_id: r.template for r in urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[0] == "/user/*/posts" and got[100] == "/about/us"


def test_purity_decides_what_rules_do_not(spark):
    rows = [(i, f"http://a.net/bad/{i}") for i in range(40)] + [(100 + i, f"http://example.net/en/{i}") for i in range(40)] + [(900, "http://x.com/bad/1"), (901, "http://x.com/en/1"), (902, "http://x.com/new/1")]
    got = {r.page_id: r.verdict for r in urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert (got[900], got[901], got[902]) == ("block", "allow", "allow")


def test_sql_gives_the_same(spark, small, tmp_path):
    rows = [(i, u) for i, u in enumerate(URLS)]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    for where in (f"{small}/pages.parquet", f"{tmp_path}/pages.parquet/*.parquet"):
        con = duckdb.connect()
        con.sql(f"create view pages as select * from '{where}'")
        want = sorted(map(str, con.sql(f"select page_id, host, path, rule, verdict, template, purity from ({sql.url_filter()})").fetchall()))
        got = sorted(str(tuple(r)) for r in urlfilter.judge(spark.read.parquet(where.removesuffix("/*.parquet"))).collect())
        assert got == want


def test_very_long_urls_and_repeated_rows(spark):
    long = "http://h.net/" + "/".join("x" * 50 for _ in range(40_000))
    rows = [(1, long), (1, long), (2, "http://" + "a" * 1_000_000 + "/p"), (2, None)]
    got = urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert len(got) == 4 and {r.verdict for r in got if r.page_id == 1} == {"block"} and max(len(r.path) for r in got) > 2_000_000
