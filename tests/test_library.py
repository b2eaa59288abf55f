"""Fixture cases that the given tables do not hold."""

import zipfile
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from siteloom.functions import urls as U
from siteloom.operators import brand as B
from siteloom.operators import estimate as T
from siteloom.operators import evaluate as E
from siteloom.operators import pages as P
from siteloom.operators import relational as R
from siteloom.operators import signals as S
from siteloom.sources import lists as L
from siteloom.sources import sinks as K
from siteloom.streaming import jobs as J


def test_domains_and_reasons(spark):
    cases = {
        "HTTPS://www.Example.com/path?x=1": "example.com", "example.com.": "example.com", "user@sub.example.co.uk:80/x": "example.co.uk", "bücher.de": "xn--bcher-kva.de", "my.blog.github.io": "blog.github.io", "foo.bar.ck": "foo.bar.ck", "www.ck": "www.ck",
        "github.io": None, "1.2.3.4": None, "[::1]": None, "a::b": None, "localhost": None, "-a.com": None, "x.unknownzz": None, "": None, None: None,
    }
    rows = U.normalize_domains(spark.createDataFrame([(k,) for k in cases], "raw string"), "raw", U.suffix_table(spark)).collect()
    assert {r["raw"]: r["name"] for r in rows} == cases and all((r["name"] is None) == (r["error"] is not None) for r in rows)


def test_path_kinds_and_languages(spark):
    cases = [("/", "home", None), ("/a/b.JPG", "media", None), ("/shop/x", "product", None), ("/2024/05/x/", "article", None), ("/c/shoes", "category", None), ("/about", "page", None), ("/de-at/blog", "article", "de-at"), ("/id/x", "page", None), ("/fr/", "page", "fr"), ("/js/app", "page", None)]
    rows = spark.createDataFrame([(p,) for p, _, _ in cases], "p string").select("p", U.path_kind(F.col("p")).alias("k"), U.language_prefix(F.col("p")).alias("l")).collect()
    assert [(r["p"], r["k"], r["l"]) for r in rows] == cases


def test_url_screening(spark):
    cases = {"http://10.0.0.1/": "BLOCKED_URL", "http://[::1]/": "BLOCKED_URL", "https://u:p@a.com/": "UNSUPPORTED_URL", "ftp://a.com": "UNSUPPORTED_URL", "http://a.com:22/": "BLOCKED_URL", "http://redis/": "BLOCKED_URL", "https://a.com/x": None, "nonsense": "INVALID_URL", "http://8.8.8.8/": None, "http://x.internal/": "BLOCKED_URL", "": "INVALID_URL"}
    rows = spark.createDataFrame([(u,) for u in cases], "u string").select("u", U.screen_url(F.col("u")).alias("c")).collect()
    assert {r["u"]: r["c"] for r in rows} == cases
    assert spark.createDataFrame([("http://redis/",)], "u string").select(U.screen_url(F.col("u"), trusted=["redis"])).first()[0] is None


HTML = """<html lang="en"><head><title> A  title </title><meta name="description" content="d"><meta name="robots" content="NOINDEX"><meta property="og:title" content="o"><link rel="canonical" href="/c"><link rel="alternate" hreflang="FR" href="/f">
<link rel="alternate" type="application/rss+xml" href="/r"><script type="application/ld+json">{"@graph":[{"@type":["Article","Thing"],"author":{"@type":"Person"}}]}</script><script src="/A.js"></script></head>
<body><h1>Hi</h1><h2>x</h2><div itemtype="https://schema.org/Product"></div><form><input type="search"></form><img src=x><a href="/in#f">in</a><a href="https://other.org/x">out</a><a href="mailto:a@b">m</a><style>no{}</style></body></html>"""


def test_page_facts_and_edges(spark):
    pages = spark.createDataFrame([("https://www.site.com/a/b", "site.com", HTML), ("https://site.com/", "site.com", None), ("https://site.com/x", "site.com", "<p")], "url string, domain string, html string")
    facts = {r["url"]: r for r in P.page_facts(pages, extra=["domain"]).collect()}
    f = facts["https://www.site.com/a/b"]
    assert (f["title"], f["noindex"], f["n_h1"], f["n_h2"], f["n_images"], f["n_forms"], f["search_form"], f["n_feeds"], f["canonical"], f["hreflang"], f["scripts"]) == ("A title", True, 1, 1, 1, 1, True, 1, "/c", ["fr"], ["/a.js"])
    assert f["schema_types"] == ["Article", "Person", "Product", "Thing"] and f["og"] == {"og:title": "o"} and f["text"] == "Hi x in out m" and facts["https://site.com/"]["word_count"] == 0
    edges = {r["dst"]: r["internal"] for r in P.link_edges(pages.where("html is not null"), P.html_links(F.col("html"))).collect()}
    assert edges == {"https://www.site.com/in": True, "https://other.org/x": False}


def test_visible_text_is_whole(spark):
    import hashlib
    import html
    import os
    import re

    from siteloom.plans.web import p9_page_facts

    page = "<title>t</title><h1>Title</h1><p>a <b>b</b>c &amp; <a href='/x'>Link</a><img alt=no></p><script>x()</script><style>y{}</style><noscript>z</noscript>" + "<p>word</p>" * 1000
    f = P.page_facts(spark.createDataFrame([("u", page), ("v", None)], "url string, html string")).orderBy("url").collect()
    assert f[0]["visible_text"] == "Title a bc & Link z" + " word" * 1000 and len(f[0]["text"]) == 2000 and f[1]["visible_text"] == ""
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    pages = {r["page_id"]: r["html"] or "" for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in p9_page_facts(spark, sf).collect():
        bare = re.sub(r"(?is)<(script|style|title)\b.*?</\1\s*>|<!--.*?-->|<!doctype[^>]*>", "", pages[r["page_id"]])
        bare = re.sub(r"(?i)</?(a|abbr|b|code|em|i|img|label|small|span|strong|sub|sup|time|u|input|link|meta|noscript|svg|path)\b[^>]*>", "", bare)
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", bare)).split())
        assert (r["text_length"], r["text_sha256"]) == (len(want), hashlib.sha256(want.encode()).hexdigest())


def test_technologies_close_and_demote(spark):
    rows = [("a", "/wp-content/ add-to-cart woocommerce", {"server": "nginx"}, ["PHPSESSID"]), ("b", "cart/add /_next/static/", {"x-bc-store": "1"}, []), ("c", "cart/add", {}, [])]
    d = S.detect_technologies(spark.createDataFrame(rows, "domain string, html string, headers map<string,string>, cookies array<string>"))
    t = S.demote_generic_cart(S.add_implied(d))
    got = {(r["domain"], r["tech"]) for r in t.collect()}
    assert got == {("a", "WordPress"), ("a", "WooCommerce"), ("a", "PHP"), ("a", "nginx"), ("b", "Next.js"), ("b", "React"), ("b", "BigCommerce"), ("c", "Generic shopping cart")}
    assert {r["domain"]: r["ecommerce_platform"] for r in S.technology_summary(t, ["cms"]).collect()} == {"a": "WooCommerce", "b": "BigCommerce", "c": "Generic shopping cart"}


def test_all_signatures_are_detected(spark):
    rows = [
        ("a", "<script src=https://js.stripe.com/v3></script> fbq('init', '1') /_nuxt/ x", "TYPO3 CMS", {"server": "LiteSpeed", "x-magento-tags": "1"}, ["laravel_session"], ["/js/jquery-3.7.min.js"], ["x.HEROKUDNS.com"]),
        ("b", "gtag('config', 'G-AB12') wpb_row", None, {"via": "1.1 varnish"}, ["csrftoken"], [], ["a.azureedge.net"]), ("c", None, None, {}, [], [], []),
    ]
    d = S.detect_technologies(spark.createDataFrame(rows, "domain string, html string, generator string, headers map<string,string>, cookies array<string>, scripts array<string>, dns array<string>"))
    got = {(r["domain"], r["tech"]) for r in d.collect()}
    assert got == {("a", t) for t in ("Stripe", "Meta Pixel", "Nuxt", "Typo3", "LiteSpeed", "Magento", "Laravel", "Ruby on Rails", "jQuery", "Heroku")} | {("b", t) for t in ("Google Analytics", "Google Analytics 4", "WPBakery", "Varnish", "Django", "Microsoft Azure")}
    assert len({s[0] for s in S.SIGNATURES}) == 138
    assert {("b", "WordPress"), ("b", "PHP"), ("a", "Vue"), ("a", "PHP")} <= {(r["domain"], r["tech"]) for r in S.add_implied(d).collect()}


def test_estimates_follow_the_rules(spark):
    features = spark.createDataFrame(
        [("big", 100.0, 4e6, True, False, True, False, None, None), ("none", None, 4e6, False, False, False, True, "not_found", None), ("parked", 1000.0, 4e6, True, True, True, False, None, None), ("absent", None, 4.6e6, True, False, True, False, None, 1e5)],
        "domain string, tranco_rank double, tranco_list_size double, crawl_reachable boolean, crawl_parked boolean, dns_resolves boolean, dns_nxdomain boolean, rdap_status string, opr_ref_domains double",
    )
    seen = spark.createDataFrame([("big", "tranco", True), ("absent", "tranco", False), ("parked", "tranco", True)], "domain string, source string, found boolean").withColumn("blocked", F.lit(False)).withColumn("reachable", F.lit(True))
    status = T.source_status(features, seen, list(T.V2["source_weights"]))
    got = {r["domain"]: r for r in T.estimate(features, status).collect()}
    assert got["big"]["details"]["log10_estimate"] == 8.6 and got["none"]["details"]["log10_estimate"] == 1.5 and got["parked"]["bucket"] == "<1K" and got["absent"]["details"]["log10_estimate"] == 4.3
    assert all(r["lower"] <= r["visits"] <= r["upper"] and r["confidence"] in ("low", "medium", "high") for r in got.values())
    with pytest.raises(ValueError):
        T.estimate(features, status, "trained_v9")


def test_correlation_edge_cases(spark):
    rows = [("lin", i, 2.0 * i + 1) for i in range(5)] + [("flat", 1.0, float(i)) for i in range(5)] + [("few", 1.0, 1.0), ("few", 2.0, 2.0)]
    df = spark.createDataFrame([(k, float(x), float(y)) for k, x, y in rows], "k string, x double, y double")
    rho = {r["k"]: r["rho"] for r in E.spearman(df, "k", "x", "y").collect()}
    fit = {r["k"]: (r["intercept"], r["slope"]) for r in E.least_squares(df, "k", "x", "y").collect()}
    assert rho == {"lin": pytest.approx(1.0), "flat": None, "few": None} and fit["lin"] == (pytest.approx(1.0), pytest.approx(2.0)) and fit["flat"] == (None, None)


def test_robots_groups(spark):
    body = "User-agent: a\nUser-agent: loom\nDisallow: /private\nAllow: /private/ok\nCrawl-delay: 120\n\nUser-agent: *\nDisallow: /\nSitemap: https://h.com/s.xml"
    rules, facts = S.robots_rules(spark.createDataFrame([("h.com", body)], "host string, body string"), "LoomBot")
    urls = spark.createDataFrame([(f"https://h.com{p}",) for p in ("/", "/private/x", "/private/ok", "/privat")], "url string")
    assert {r["url"][13:]: r["allowed"] for r in S.robots_allowed(urls, rules).collect()} == {"/": True, "/private/x": False, "/private/ok": True, "/privat": True}
    f = facts.first()
    assert f["delay"] == 10.0 and f["sitemaps"] == ["https://h.com/s.xml"] and not f["disallow_all"]


def test_zip_lists_and_schema(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "t.zip", "w") as z:
        z.writestr("folder/", "")
        z.writestr("top.csv", "1,Example.com\n2,no domain\n3,b.co.uk\nx,c.com\n0,d.com")
    (tmp_path / "crux.csv").write_text("origin,rank\nhttps://www.a.com,5000\nhttp://b.a.com,1000\n")
    rows = L.read_lists(spark, {"tranco": ("t1", str(tmp_path / "t.zip")), "crux_top": ("c1", str(tmp_path / "crux.csv"))}).collect()
    assert sorted((r["provider"], r["domain"], r["rank"]) for r in rows) == [("crux_top", "a.com", 1000), ("tranco", "b.co.uk", 3), ("tranco", "example.com", 1)]
    with pytest.raises(ValueError):
        L.open_page_rank(spark.createDataFrame([("a",)], "Domain string"))


def test_upsert_needs_features(spark):
    schema = "domain string, source string, measurement_date date, actual_monthly_visits double, notes string, period_start date, period_end date"
    new = spark.createDataFrame([("x.com", "s", date(2024, 1, 1), 1.0, None, None, None)], schema)
    with pytest.raises(ValueError):
        K.upsert_ground_truth(new.limit(0), new, spark.createDataFrame([], "domain string"))


def test_size_budget_holds(spark):
    rows = [(1, "é" * 500, "t" * 500, "m" * 500, ["u"] * 1500, "logo"), (2, "a", "b", "c", [], None)]
    got = P.fit_budget(spark.createDataFrame(rows, "id int, html string, text string, markdown string, links array<string>, logo string"), 5200).collect()
    assert all(r["content_bytes"] <= 5200 for r in got) and got[0]["truncated"] and not got[1]["truncated"] and got[1]["html"] == "a"


def test_colours_and_roles(spark):
    css = ["#fff", "#FF880080", "#ff880070", "rgb(10%, 20, 300)", "rgba(1,2,3,0.4)", "red", None, "#1234"]
    got = {r["c"]: r["hex"] for r in B.colour_columns(spark.createDataFrame([(c,) for c in css], "c string"), "c").collect()}
    assert got == {"#fff": "#FFFFFF", "#FF880080": "#FF8800", "rgb(10%, 20, 300)": "#1A14FF", "#1234": "#112233"}
    rows = [("s", "buttons", "#0050ff", 3.0), ("s", "logo", "#0052fe", 1.0), ("s", "links", "#ff8800", 1.0), ("s", "background", "#ffffff", 9.0)]
    r = B.brand_roles(B.colour_clusters(B.scaled_weights(B.colour_columns(spark.createDataFrame(rows, "site string, source string, c string, weight double"), "c")))).first()
    assert (r["primary"], r["secondary"], r["background"], r["confidence"]) in [("#0050FF", "#FF8800", "#FFFFFF", "high"), ("#0052FE", "#FF8800", "#FFFFFF", "high")]


def test_stream_windows_equal_batch(spark, tmp_path):
    rows = [(datetime(2024, 1, 1, h, m), f"s{m % 2}", float(h * m)) for h in range(6) for m in range(0, 60, 7)]
    df = spark.createDataFrame(rows, "at timestamp, source string, value double")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    batch = {(r["hour"], r["source"], r["n"]) for r in J.attempt_metrics(df, "at", "source", "value", F.col("value") > 50).collect()}
    q = J.attempt_metrics(J.read_stream(spark, f"{tmp_path}/in"), "at", "source", "value", F.col("value") > 50, "1 hour").writeStream.format("memory").queryName("hours").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r["hour"], r["source"], r["n"]) for r in spark.table("hours").collect()} == batch


def test_order_and_partitions_do_not_change_picks(spark):
    df = spark.createDataFrame([(i % 7, i, (i * 31) % 50) for i in range(200)], "k int, i int, v int")
    key = lambda d: sorted(map(tuple, d.collect()))
    for f in (lambda d: R.latest_per_key(d, "k", "v", "i"), lambda d: R.hash_sample(d, "k", "i", 5, 1), lambda d: R.spread_pick(d, "k", "i", 4), lambda d: R.top_counts(d, "k", "v", 3, "m").selectExpr("k", "to_json(m)")):
        assert key(f(df)) == key(f(df.orderBy(F.desc("v")).repartition(7)))
