"""Cases of single rows against plain Python forms of the same rules."""

import json
import math
import random
import statistics
from urllib.parse import urldefrag, urljoin

import pytest
from pyspark.sql import functions as F

from siteloom.functions import urls as U
from siteloom.operators import brand as B
from siteloom.operators import estimate as T
from siteloom.operators import evaluate as V
from siteloom.operators import pages as P
from siteloom.operators import relational as R
from siteloom.operators import signals as S
from siteloom.sources import sinks as K


def test_links_resolve_like_urljoin(spark):
    bases = ["http://a.com/b/c/d?q=1", "http://a.com", "https://a.com/x/"]
    hrefs = ["../x", "./y", "?page=2", "z", "/r/../s", "../../../t", ".", "..", "a/./b/../c?k=1#f", "//o.com/p", "http://e.com/a/../b", "#f", "mailto:x", "javascript:0", "/", "", "g/"]
    rows = spark.createDataFrame([(b, h) for b in bases for h in hrefs], "b string, h string")
    for r in rows.select("b", "h", P.resolved(F.col("b"), F.col("h")).alias("r")).collect():
        gone = r["h"] == "" or r["h"].startswith(("#", "mailto:", "javascript:"))
        assert r["r"] == (None if gone else urldefrag(urljoin(r["b"], r["h"]))[0]), (r["b"], r["h"])
    html = """<a href="/x">1</a> <A class=k HREF='/y z'>2</A> <a
      href=/w>3</a> <abbr href="/no">4</abbr> <a data-href="/no2">5</a>"""
    assert spark.createDataFrame([(html,)], "h string").select(P.html_links(F.col("h"))).first()[0] == ["/x", "/y z", "/w"]


def size_of(c):
    return len(json.dumps(c, ensure_ascii=False, separators=(",", ":")).encode())


def fitted(c, budget):
    """The rules of P18 in plain Python."""
    if size_of(c) <= budget:
        return c, False
    c = dict(c)
    c["links"] = c["links"][:1000]
    if size_of(c) > budget:
        c["logo"] = None
    for f in ("html", "text", "markdown"):
        over = size_of(c) - budget
        if over > 0 and c[f]:
            c[f] = c[f].encode()[: max(0, len(c[f].encode()) - over - 64)].decode("utf-8", "ignore")
    if size_of(c) > budget:
        c["links"] = []
    return c, True


def test_budget_gives_way_in_order(spark):
    random.seed(3)
    text = lambda n: "".join(random.choice("abc é😀ü") for _ in range(n))
    rows = [dict(html=text(a), text=text(b), markdown=text(c), links=[f"l{i}" for i in range(d)], logo=e) for a, b, c, d, e in (
        (10, 10, 10, 3, "x"), (10, 10, 10, 1500, "x"), (3000, 10, 10, 3, "x" * 50), (3000, 3000, 10, 3, None), (3000, 3000, 5000, 3, "x"), (5, 5, 5, 3000, "x" * 3000), (100, 0, 0, 999, "y" * 900), (2000, 0, 2000, 1200, None),
    )]
    schema = "id int, html string, text string, markdown string, links array<string>, logo string"
    for budget in (900, 5000, 20_000):
        df = spark.createDataFrame([(i, *r.values()) for i, r in enumerate(rows)], schema)
        for r in P.fit_budget(df, budget).collect():
            want, truncated = fitted(rows[r["id"]], budget)
            assert {k: r[k] for k in want} == want and r["truncated"] == truncated and r["content_bytes"] == size_of(want)


def test_json_metadata_is_bounded(spark):
    meta = {"a": "x" * 1200, "n": 5, "f": 1.5, "b": True, "z": None, "s": ["p", 1, 'q"r', "y" * 1100] + ["k"] * 30, "e": [1], "o": {"k": 1}, "k" * 101: "gone"}
    many = {f"k{i:02}": i for i in range(60)}
    rows = spark.createDataFrame([(json.dumps(meta),), (json.dumps(many),), (None,), ("{}",)], "m string")
    got = [r[0] and {k: json.loads(v) for k, v in r[0].items()} for r in rows.select(P.bound_json_metadata(F.col("m"))).collect()]
    assert got[0] == {"a": "x" * 1000, "n": 5, "f": 1.5, "b": True, "z": None, "s": ["p", 'q"r', "y" * 1000] + ["k"] * 17}
    assert len(got[1]) == 40 and all(many[k] == v for k, v in got[1].items()) and not got[2] and not got[3]


def test_grade_tells_of_failures_redirects_and_brands(spark):
    schema = (
        "id int, markdown string, ok boolean, error_code string, status_code int, url string, final_url string, "
        "branding struct<logo: struct<confidence: string, source: string>, favicon: struct<source: string>, colors: struct<primary: string, confidence: string, basis: string>>, branding_error string"
    )
    good = "word " * 200
    brand = (("high", "img"), ("link",), ("#000", "high", "css"))
    rows = [(1, good, True, None, 200, "http://www.a.com/", "http://a.com/x", brand, None), (2, good, False, "HTTP_ERROR", 404, "http://a.com/", "http://b.com/", None, "TIMEOUT"),
            (3, good, True, None, 200, "http://a.com/", None, (("low", "svg"), ("default",), (None, "low", "css")), None), (4, good, True, None, 200, "http://a.com/", None, (None, None, ("#1", "low", "css")), None),
            (5, "\n".join("[x](y)" for _ in range(12)), True, None, 200, "http://a.com/", None, brand, None)]
    got = {r["id"]: r for r in P.grade(spark.createDataFrame(rows, schema), success=F.col("ok")).collect()}
    assert got[1]["issues"] == [] and got[1]["verdict"] == "GOOD"
    assert got[2]["issues"] == ["failed: HTTP_ERROR 404", "redirected off-host to b.com", "branding failed: TIMEOUT"] and got[2]["verdict"] == "BAD"
    assert got[3]["issues"] == ["logo low confidence (svg)", "favicon not declared (guessed /favicon.ico)", "no primary color"] and got[3]["verdict"] == "CHECK"
    assert got[4]["issues"] == ["no logo", "favicon not declared (guessed /favicon.ico)", "colors low confidence (css)"]
    assert "mostly links (12/12 lines)" in got[5]["issues"]


def test_addresses_of_both_families_meet_their_ranges(spark):
    import ipaddress

    feeds = [("Cloudflare", "2606:4700::/32"), ("Hetzner", "2a01:4f8::/29"), ("Fastly", "2600::/12"), ("Hetzner", "5.0.0.0/8"), ("Cloudflare", "5.1.0.0/16")]
    ips = ["2606:4700::1111", "2606:4700:0:0:0:0:0:1", "2a01:4fb:abcd::2", "2607::", "::1", "::", "5.1.2.3", "6.1.2.3", "2A01:4F8::FF"]
    got = {r["ip"]: r["provider"] for r in S.ip_providers(spark.createDataFrame([("d", x) for x in [*ips, "x", "1::2::3", None]], "domain string, ip string"), S.ranges_table(spark, feeds)).collect()}
    want = {}
    for ip in ips:
        a = ipaddress.ip_address(ip)
        hits = [p for p, c in feeds if a in ipaddress.ip_network(c, strict=False)]
        want |= {ip: hits[0]} if hits else {}
    assert got == want


def test_implied_closure_ends_on_a_cycle(spark):
    got = {(r["tech"], r["implied"]) for r in S.implied_closure(spark, [("a", "b", "x"), ("b", "c", "y"), ("c", "a", "z"), ("d", "a", "z")]).collect()}
    assert got == {(x, y) for x in "abcd" for y in "abc" if x != y}


def test_running_counts_give_ranks_and_percentiles(spark):
    random.seed(9)
    rows = [(k, random.choice([random.gauss(0, 1), float(random.randrange(4))])) for k in ("a", None, "c") for _ in range({"a": 4000, None: 301, "c": 1}[k])] + [("a", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r["k"]: r for r in V.error_summary(df, "k", "v").collect()}
    ranks = {(r["k"], r["v"]): r["r"] for r in V.wide_ranks(df, ["k"], "v", "r").collect()}
    for key in ("a", None, "c"):
        vs = sorted(v for k, v in rows if k == key and v is not None)
        a, n, r = sorted(map(abs, vs)), len(vs), got[key]
        assert r["n"] == n and r["p90"] == a[min(n - 1, int(n * 0.9))] and abs(r["median"] - (vs[(n - 1) // 2] + vs[n // 2]) / 2) < 1e-12
        first = {}
        for i, v in enumerate(vs):
            first.setdefault(v, []).append(i + 1)
        assert all(ranks[key, v] == sum(at) / len(at) for v, at in first.items())


def test_features_of_unlike_payloads(spark):
    rows = [("d1", "crawl", '{"reachable": false, "sitemaps": {"url_count": 5}}'), ("d1", "tranco", '{"status": "absent", "list_size": 10}'), ("d2", "crux_top", '{"status": "present", "rank": 1000}'), ("d2", "dns", "{}"),
            ("d3", "crawl", '{"reachable": true, "homepage": {"page": {"schema_types": ["Store"]}}, "tech": {"technologies": [{"name": "a"}], "marketing": ["x", "y"]}}'), ("d4", "commoncrawl", '{"url_count": 7}'), ("d4", "dns", '{"records": {"NS": ["a"]}, "infra": {"parked_provider": "p"}}')]
    df = T.feature_vector(spark.createDataFrame(rows, "domain string, source string, payload string"))
    assert len(df.columns) == 93
    got = {r["domain"]: r.asDict() for r in df.collect()}
    one, two, three, four = (got[f"d{i}"] for i in (1, 2, 3, 4))
    assert one["crawl_reachable"] is False and one["sitemap_url_count"] is None and one["has_rss"] is None and one["tranco_rank"] is None and one["tranco_list_size"] == 10 and one["technologies"] == []
    assert two["crux_rank_bucket"] == 1000 and two["dns_resolves"] is False and two["dns_a_count"] == 0 and two["crawl_reachable"] is None and two["commoncrawl_limit_hit"] is None
    assert three["schema_organization"] and not three["schema_product"] and three["technology_count"] == 1 and three["marketing_tag_count"] == 2 and three["sitemap_found"] is False and three["sitemap_product_count"] == 0
    assert four["commoncrawl_url_count"] == 7 and four["commoncrawl_limit_hit"] is False and four["dns_ns_count"] == 1 and four["dns_parked"] is True


def test_benchmark_rows_and_report(spark, tmp_path):
    schema = "domain string, reference double, estimate double, lower double, upper double, signals map<string,double>, sources map<string,string>, z long, a long, extra map<string,string>"
    rows = spark.createDataFrame([("x", 100.0, 20_000.0, 50.0, 200.0, {"s": 1.0}, {"b": "present", "a": "absent"}, 1, 2, {"Notes": "n", "City": "c"})], schema)
    out = K.benchmark_rows(rows, ["z", "a"], "extra")
    r = out.first()
    assert r["sources"] == "a=absent;b=present;" and r["bucket_diff"] == 2 and abs(r["log10_error"] - 2.30103) < 1e-5 and r["in_range"] and out.columns[-4:] == ["a", "z", "ref_City", "ref_Notes"]
    K.write_benchmark_rows(out, f"{tmp_path}/rows")
    assert spark.read.option("header", True).csv(f"{tmp_path}/rows").count() == 1
    report = K.benchmark_report({"Rows": (rows.select("domain", "reference"), "domain")})
    assert report.startswith("## Rows\n\n| domain | reference |") and "| x | 100.000 |" in report


def test_results_are_bounded_on_write(spark):
    rows = spark.createDataFrame([("j", "u", "m" * 3000, "h" * 3000, "t", ["l"] * 10, '{"a": [1]}'), ("j", "u", "m", "h", "t", [], "{}"), ("j", "old", "m", "h", "t", [], "{}")], "job_id string, url string, markdown string, html string, text string, links array<string>, metadata string")
    got = K.new_results(rows, rows.where("url = 'old'"), ["markdown", "html"], 5, budget=2000).collect()
    assert len(got) == 1 and got[0]["text"] is None and got[0]["content_bytes"] <= 2000


def test_imports_with_a_null_value_win(spark):
    schema = "domain string, source string, measurement_date date, actual_monthly_visits double, notes string, period_start date, period_end date"
    import datetime as dt

    day = dt.date(2024, 1, 1)
    old = spark.createDataFrame([("a", "s", day, 5.0, "old", day, None)], schema)
    new = spark.createDataFrame([("a", "s", day, None, "new", None, day)], schema)
    r = K.upsert_ground_truth(old, new, old.select("domain")).first()
    assert r["actual_monthly_visits"] is None and r["notes"] == "new" and r["period_start"] == day and r["period_end"] == day


def plain_roles(rows, seen):
    """The rules of A28 to A30 for one site in plain Python; ``seen`` holds the facts of each readable colour."""
    kept = [r for r in rows if r["colour"] in seen]
    delta = lambda a, b: sum((seen[a][k] - seen[b][k]) ** 2 for k in ("lab_l", "lab_a", "lab_b")) ** 0.5

    def scale(source, total, items):
        whole = sum(w for _, w in items)
        return [(c, w / whole * total, source) for c, w in items] if whole > 0 else []

    def merged(entries):
        out = []
        for c, w, s in sorted(entries, key=lambda e: -e[1]):
            for o in out:
                if delta(o[0], c) < 12:
                    o[1] += w
                    o[2].add(s)
                    break
            else:
                out.append([c, w, {s}])
        return sorted(out, key=lambda o: -o[1])

    of = lambda s: [(r["colour"], r["weight"]) for r in kept if r["source"] == s]
    fixed = {"buttons": 5, "logo": 4, "cssvar": 3, "header": 2.5, "links": 2, "headings": 2, "borders": 1, "background": 2, "footer": 1.5, "theme": 2, "screenshot": 1.5}
    variables = [r for r in kept if r["source"] == "cssvar" and seen[r["colour"]]["hex"] not in ("#6EC1E4", "#0170B9")]
    brand = list(dict.fromkeys(r["colour"] for r in variables if any(x in r["name"] for x in ("primary", "accent", "brand"))))
    first = next((r["colour"] for r in variables if "primary" in r["name"]), None)
    pooled = [e for s, total in fixed.items() for e in scale(s, total, [(c, 1) for c in brand] if s == "cssvar" else of(s))]
    neutral, tint = (lambda c: seen[c]["neutral"]), (lambda c: seen[c]["tint"])
    ground = [o[0] for o in merged(scale("background", 1, of("background")) + scale("screenshot", 0.3, of("screenshot")) + scale("background", 0.1, of("body"))) if neutral(o[0]) or tint(o[0])]
    ground = (ground or [c for c, _ in of("body")] or [None])[0]
    text = merged(scale("text", 1, of("paragraphs" if any(r["source"] == "paragraphs" for r in rows) else "text")))

    def score(o):
        c, w, s = o
        n, light = len(s - {"screenshot"}), seen[c]["l"]
        carried = bool(s & {"buttons", "logo", "header", "cssvar"})
        if n == 0:
            return 0
        if not neutral(c) and not tint(c):
            m = 1 if n >= 2 or s & {"buttons", "logo"} else 0.5
        elif tint(c):
            m = 0.7 if carried else 0.3
        elif light < 0.4 and s & {"buttons", "cssvar", "logo"}:
            m = 0.45
        else:
            m = 0.25 if carried and 0.4 <= light <= 0.85 else 0
        m *= 0.5 if ground and delta(c, ground) < 6 and "buttons" not in s else 1
        return w * m * (1.5 if first and delta(c, first) < 12 else 1)

    def differ(a, b):
        turn = abs(seen[a]["h"] - seen[b]["h"])
        return delta(a, b) >= 20 and (neutral(a) != neutral(b) or min(turn, 360 - turn) >= 30 or abs(seen[a]["l"] - seen[b]["l"]) >= 0.3)

    ranked = sorted(((score(o), o) for o in merged(pooled) if score(o) > 0), key=lambda x: -x[0])
    p = ranked[0][1] if ranked else None
    others = [(s, o) for s, o in ranked if p and o is not p and differ(o[0], p[0])]
    q = next((o for s, o in others if not neutral(o[0]) and s >= ranked[0][0] * 0.15), others[0][1] if others else None)
    a = next((o for _, o in others if o is not q and not neutral(o[0]) and (q is None or differ(o[0], q[0]))), None)
    hexed = lambda o: seen[o[0]]["hex"] if o else None
    confidence = "low"
    if p:
        n, margin = len(p[2] - {"screenshot"}), ranked[0][0] / ranked[1][0] if len(ranked) > 1 else 3
        confidence = "high" if (n >= 3 or {"buttons", "logo"} <= p[2]) and margin >= 1.2 else "medium" if n >= 2 else "low"
    palette = [hexed(o) for o in merged(pooled) if o[2] - {"screenshot"} or o[1] > 0.3][:8]
    return hexed(p), hexed(q), hexed(a), seen[ground]["hex"] if ground else None, hexed(text[0]) if text else None, confidence, palette, sorted(p[2]) if p else ["none"]


def test_brand_roles_match_plain_form(spark):
    rng = random.Random(11)
    sources = [*B.SOURCE_WEIGHTS, "text", "paragraphs", "body"]
    base = [f"#{rng.randrange(1 << 24):06x}" for _ in range(40)] + ["#ffffff", "#fdf6e3", "#222222", "#111", "#6ec1e4", "#0170b9", "#888888"]
    rows = []
    for site in range(60):
        for s in rng.sample(sources, rng.randrange(1, len(sources) + 1)):
            single = s in ("footer", "theme", "body")
            for c in rng.sample(base, 1 if single else rng.randrange(1, 6)):
                rows.append((f"s{site}", s, rng.choice(["--primary", "--accent-2", "--brand", "--gap"]), c, rng.random() + 0.01, len(rows)))
    rows += [("none", "text", "", "red", 1.0, 0), ("none", None, None, None, None, None), ("unread", "paragraphs", "", "nope", 1.0, 0), ("unread", "text", "", "#333", 1.0, 1)]
    schema = "site string, source string, name string, colour string, weight double, position long"
    df = spark.createDataFrame(rows, schema)
    seen = {r["colour"]: r.asDict() for r in B.colour_columns(df.select("colour").distinct(), "colour").collect()}
    got = {r["site"]: (r["primary"], r["secondary"], r["accent"], r["background"], r["text"], r["confidence"], [p["hex"] for p in r["palette"]], sorted(r["basis"].split("+"))) for r in B.brand_colours(df).collect()}
    assert len(got) == 62 and got["none"] == (None, None, None, None, None, "low", [], ["none"]) and got["unread"][4] is None
    for site in {r[0] for r in rows} - {"none"}:
        own = [dict(zip(("site", "source", "name", "colour", "weight", "position"), r)) for r in rows if r[0] == site]
        assert got[site] == plain_roles(own, seen), site
    for k in range(5):  # every role is met
        assert any(v[k] for v in got.values())


def test_variables_of_page_builders_do_not_count(spark):
    rows = [("s", "buttons", "", "rgb(54, 48, 42)", 2.0, 0), ("s", "header", "", "rgb(236, 228, 218)", 1.0, 1), ("s", "background", "", "rgb(236, 228, 218)", 1.0, 2),
            ("s", "cssvar", "--custom-primary-color", "#36302a", 1.0, 3), ("s", "cssvar", "--e-global-color-primary", "#6EC1E4", 1.0, 4)]
    r = B.brand_colours(spark.createDataFrame(rows, "site string, source string, name string, colour string, weight double, position long")).first()
    assert r["primary"] == "#36302A" and "#6EC1E4" not in [p["hex"] for p in r["palette"]]


def test_job_view_states(spark):
    rows = [(i, s, e) for i, (s, e) in enumerate((s, e) for s in ("queued", "running", "completed", "failed", "cancelled", None) for e in (None, 5.0))]
    got = R.job_view(spark.createDataFrame(rows, "id int, s string, e double").selectExpr("*", "map('maxURLs', 1) as o", "timestamp'2024-01-01' as a", "cast(null as timestamp) as b"), "o", "a", "b", "s", "e").collect()
    for r in got:
        want = "ready" if r["e"] else "failed" if r["s"] in ("failed", "cancelled") else "pending"
        assert (r["view_status"], r["refreshing"], r["duration_ms"], list(r["o"])) == (want, bool(r["e"]) and r["s"] in ("queued", "running"), None, ["max_u_r_ls"])


def plain_registrable(host, rules):
    """The registrable domain by walking all rules: an exception wins, else the rule with the most labels."""
    labels, best = host.split("."), 0
    if "" in labels:
        return None
    for i in range(len(labels)):
        tail = ".".join(labels[i:])
        if "!" + tail in rules:
            return tail
        if tail in rules:
            best = max(best, len(labels) - i)
        if "*." + tail in rules and i > 0:
            best = max(best, len(labels) - i + 1)
    return ".".join(labels[-best - 1 :]) if 0 < best < len(labels) else None


def test_registrable_domains_of_a_long_list(spark, tmp_path):
    rng = random.Random(3)
    rules = {f"t{i}" for i in range(300)} | {f"s{i % 7}.t{i % 300}" for i in range(4000)} | {f"x.s{i % 5}.t{i}" for i in range(300)} | {f"*.w{i}" for i in range(50)} | {f"!k.w{i}" for i in range(50)} | {f"*.z.t{i}" for i in range(20)}
    parts = ["a", "www", "k", "x", "z", *[f"s{i}" for i in range(8)], *[f"t{i}" for i in range(0, 320, 5)], *[f"w{i}" for i in range(0, 55, 5)]]
    hosts = sorted({".".join(rng.choice(parts) for _ in range(rng.randint(1, 5))) for _ in range(6000)} | rules - {r for r in rules if r[0] in "*!"} | {"a..t5", ".t5", "x.s1..t5", "b.z.t5", "a.b.z.t5"})
    (tmp_path / "rules.txt").write_text("// a comment\n\n" + "".join(f"{r}  note\n" for r in sorted(rules)) + "b\u00fccher\n")
    table = U.read_suffixes(spark, str(tmp_path / "rules.txt"))
    assert {r["rule"] for r in table.collect()} == {"=", "*", "!"} and table.where("suffix = 'xn--bcher-kva'").count() == 1
    rows = U.registrable_domains(spark.createDataFrame([(h,) for h in [*hosts, None]], "h string"), "h", table).collect()
    got = {r["h"]: r["domain"] for r in rows}
    assert got.pop(None) is None
    assert {h: d for h, d in got.items() if "" not in h.split(".")} == {h: plain_registrable(h, rules) for h in hosts if "" not in h.split(".")}
    assert got["a..t5"] is None and got[".t5"] is None and sum(d is not None for d in got.values()) > 1000


def test_estimates_match_plain_form(spark):
    """Curves, weighted mean, agreement, coverage and caps of rows with gaps, against Python arithmetic."""
    rng, config = random.Random(5), T.V2
    some = lambda v: None if rng.random() < 0.3 else v
    people = [(f"d{i}", some(10 ** rng.uniform(0, 7)), some(4_600_000.0), some(10 ** rng.uniform(2, 7)), some(10 ** rng.uniform(0, 9))) for i in range(200)] + [("none", None, None, None, None)]
    features = spark.createDataFrame(people, "domain string, tranco_rank double, tranco_list_size double, crux_rank_bucket double, opr_ref_domains double")
    kinds = ["present", "absent", "unreachable", "blocked", "disabled", "missing"]
    said = [(p[0], s, rng.choice(kinds)) for p in people if p[0] != "none" for s in [*config["source_weights"], "unlisted"] if rng.random() < 0.8]
    rows = {r["domain"]: r for r in T.estimate(features, spark.createDataFrame(said, "domain string, source string, status string")).collect()}
    caps = {r["domain"]: r["cap"] for r in T.absence_caps(features, spark.createDataFrame(said, "domain string, source string, status string"), config).collect()}
    curves = {s: (w, k, c) for s, _, w, k, c in config["signals"]}

    def at(x, points):
        for (x0, y0), (x1, y1) in zip(points, points[1:]):  # noqa: B905
            if x < points[0][0]:
                return points[0][1]
            if x < x1:
                return y0 + (y1 - y0) * (x - x0) / (x1 - x0)
        return points[-1][1]

    for name, rank, size, crux, refs in people:
        have = {"tranco": rank and round(math.log10(rank), 4), "crux": crux and round(math.log10(crux), 4), "referring_domains": refs and round(math.log10(refs + 1), 4)}
        have = {s: round(at(x, curves[s][2]) + 1e-9, 3) for s, x in have.items() if x is not None}
        own = {s: k for d, s, k in said if d == name}
        live = [(config["source_weights"][s], {"present": 1, "absent": 0.8, "unreachable": 0.5, "blocked": 0.3}.get(k, 0)) for s, k in own.items() if s in config["source_weights"] and k != "disabled"]
        detail = rows[name]["details"]
        assert (detail["signals"] or {}) == pytest.approx(have, abs=0.0011)
        assert detail["coverage"] == (pytest.approx(sum(w * c for w, c in live) / sum(w for w, _ in live), abs=1e-4) if live else None)
        judged = [v for s, v in have.items() if curves[s][1] == "popularity"] or list(have.values())
        assert detail["stddev"] == (pytest.approx(statistics.pstdev(judged), abs=0.002) if len(judged) > 1 else None)
        cap = round(at(math.log10(size), curves["tranco"][2]) + 0.5, 2) if size and own.get("tranco") == "absent" and own.get("crux_top") != "present" else None
        assert caps.get(name) == (pytest.approx(cap, abs=0.011) if cap else None)
        if have and any(curves[s][1] == "popularity" for s in have):
            mean = sum(curves[s][0] * v for s, v in have.items()) / sum(curves[s][0] for s in have)
            assert detail["log10_estimate"] == pytest.approx(min(mean, cap) if cap else mean, abs=0.012)
