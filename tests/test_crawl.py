import pytest
from pyspark.sql import functions as F

from lexispark.functions import urls as U
from lexispark.operators import crawl
from lexispark.sources.readers import read_config

NORMAL = {
    "HTTPS://Ex.COM": "https://ex.com/", "https://ex.com/A/?q=1#f": "https://ex.com/A", " http://ex.com:80/a// ": "http://ex.com:80/a/", "https://ex.com/#a?b": "https://ex.com/",
    "http://ex.com?x=/y/": "http://ex.com/", "ftp://ex.com/a": "", "mailto:a@b.c": "", "http:///x": "", "": "",
}
JOINED = {"/c": "https://ex.com/c", "c/": "https://ex.com/a/c", "../d?x#y": "https://ex.com/d", "//O.com/z": "https://o.com/z", "#top": "https://ex.com/a/b", "mailto:q@x.y": "", "": ""}
ALLOWED = {"https://ex.com/": True, "https://m.ex.com/": True, "https://notex.com/": False, "https://ex.com:80/": False}
USEFUL = {"https://e/a": True, "https://e/login": False, "https://e/docsify": False, "https://e/A.PDF": False, "https://e/x/blob/y": False, "https://e/" + "a" * 171: False, "": False}


def run(spark, values, column):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return {r.v: r.x for r in df.select("v", column(F.col("v")).alias("x")).collect()}


def test_urls(spark):
    assert run(spark, NORMAL, U.normalize_url) == NORMAL
    assert run(spark, JOINED, lambda c: U.join_url(spark, F.lit("https://ex.com/a/b"), c)) == JOINED
    assert run(spark, ALLOWED, lambda c: U.is_allowed_domain(c, ["ex.com"])) == ALLOWED
    assert run(spark, USEFUL, U.is_useful_url) == USEFUL
    assert run(spark, ["http://A.b:8/x?y"], U.host) == {"http://A.b:8/x?y": "a.b:8"}
    assert run(spark, ["http://A.b"], U.path) == {"http://A.b": "/"}
    assert run(spark, ["X: 1\r\nETag:  \"q\" \r\n"], lambda c: U.header(c, "etag")) == {"X: 1\r\nETag:  \"q\" \r\n": '"q"'}


def test_links(spark):
    html = '<a href="/b">x<p><A HREF="c?x=1&amp;y">y</a><a>z</a><a href="http://o.com/">o</a><!-- <a href="/no"> --><a href="/b#f">again<a href="/login">'
    df = spark.createDataFrame([("https://ex.com/a/", html), ("https://ex.com/", None)], "u string, h string")
    got = [r[0] for r in df.select(U.extract_links(spark, F.col("u"), F.col("h"), ["ex.com"])).collect()]
    assert got == [["https://ex.com/a/c", "https://ex.com/b"], []] or got == [sorted(["https://ex.com/a/c", "https://ex.com/b"]), []]


FETCHES = {
    "https://ex.com/1": (200, "new", "text/html", False, True, "failed_request"),
    "https://ex.com/2": (304, "", "", False, False, "not_modified"),
    "https://ex.com/3": (404, "", "text/html", False, False, "failed_http_404"),
    "https://ex.com/4": (200, "x", "Application/PDF", False, False, "skipped_content_type_application/pdf"),
    "https://ex.com/5": (200, "x", "text/html", True, False, "skipped_too_large"),
    "https://ex.com/6": (200, '<a href="/new">', "Text/HTML; charset=utf-8", False, False, "changed"),
    "https://ex.com/7": (200, '<a href="/old">', "text/html", False, False, "unchanged"),
}


def test_round(spark):
    config = crawl.Config(["ex.com"], recrawl_interval_seconds=100)
    frontier = crawl.seed(crawl.empty(spark, crawl.FRONTIER), spark.createDataFrame([(u,) for u in [*FETCHES, "https://no.com/"]], "url string"), ["ex.com"], 10)
    assert frontier.count() == 7
    stored = spark.createDataFrame([(u, '<a href="/old">', "ex.com", 1, "e", "", __import__("hashlib").md5(b'<a href="/old">').hexdigest(), 200) for u in FETCHES], crawl.DOCUMENTS)
    fetched = spark.createDataFrame([(u, f[0], f[1], f[2], "etag", "", f[3], f[4]) for u, f in FETCHES.items()], crawl.FETCHED)
    documents, frontier, out = crawl.apply_fetch(stored, frontier, fetched, config, 50)
    assert {r.url: r.outcome for r in out.collect()} == {u: f[5] for u, f in FETCHES.items()}
    f = {r.url: r for r in frontier.collect()}
    for u, (*_, outcome) in FETCHES.items():
        good = outcome in ("not_modified", "changed", "unchanged")
        assert (f[u].status, f[u].fail_count, f[u].last_crawled_at, f[u].next_crawl_at) == ("done" if good else "failed", 0 if good else 1, 50, 150)
    assert f["https://ex.com/new"].discovered_from == "https://ex.com/6" and f["https://ex.com/old"].status == "pending"
    d = {r.url: r for r in documents.collect()}
    assert d["https://ex.com/6"].html == '<a href="/new">' and d["https://ex.com/6"].crawl_timestamp == 50
    assert d["https://ex.com/7"].html == '<a href="/old">' and d["https://ex.com/7"].etag == "etag"
    assert d["https://ex.com/2"].crawl_timestamp == 1


def test_loop(spark, tmp_path):
    pages = {"https://ex.com/": '<a href="/a"><a href="/b">', "https://ex.com/a": '<a href="/c">', "https://ex.com/b": "", "https://ex.com/c": ""}
    n = [0]

    def keep(df, name):
        n[0] += 1
        df.write.parquet(f"{tmp_path}/{name}-{n[0]}")
        return spark.read.parquet(f"{tmp_path}/{name}-{n[0]}")

    table = spark.createDataFrame(list(pages.items()), "url string, body string")
    fetch = lambda asked: asked.select("url").join(table, "url").selectExpr("url", "200L as status_code", "body", "'text/html' as content_type", "'' as etag", "'' as last_modified", "false as too_large", "false as request_failed")
    frontier = crawl.seed(crawl.empty(spark, crawl.FRONTIER), spark.createDataFrame([("https://ex.com",)], "url string"), ["ex.com"], 1)
    documents, frontier = crawl.crawl(crawl.empty(spark, crawl.DOCUMENTS), frontier, fetch, crawl.Config(["ex.com"], max_pages_per_run=3), 5, 2, keep)
    assert documents.count() == 3 and frontier.count() == 4
    assert {r.status: r.n for r in crawl.status_counts(frontier).collect()} == {"done": 3, "pending": 1}


@pytest.mark.parametrize("text", ['{"allowed_domains": ["ex.com"], "max_pages_per_run": 7}', '{"logic": {"allowed_domains": ["ex.com"], "max_pages_per_run": 7}, "db": {"path": "x"}}', "# c\nmax_pages_per_run: 7\nallowed_domains:\n  - ex.com\nseed_urls_file: x\n"])
def test_config(tmp_path, text):
    (tmp_path / "c").write_text(text)
    got = read_config(str(tmp_path / "c"))
    assert list(got.allowed_domains) == ["ex.com"] and got.max_pages_per_run == 7


def test_config_with_an_unknown_key(tmp_path):
    (tmp_path / "c").write_text("max_page: 7\nallowed_domains:\n  - ex.com\n")
    with pytest.raises(ValueError, match="max_page"):
        read_config(str(tmp_path / "c"))
