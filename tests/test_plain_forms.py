"""Registered queries that SQL can't express, against plain Python over the same tables."""

import json
import os

import pytest
import xxhash
from pyspark.sql import functions as F

from siteloom.operators import pages as P
from siteloom.operators import relational as R
from siteloom.plans import all_queries

SF = "/root/testdata/sf0.001"
QUERIES, _ = all_queries()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def order_of(seed: int, item: str) -> tuple[int, str]:
    """A row's place: the signed XXH64 of its item, seeded with the hash of the seed."""
    h = xxhash.xxh64_intdigest(item.encode(), xxhash.xxh64_intdigest(seed.to_bytes(4, "little"), 42))
    return (h - (1 << 64) if h >> 63 else h), item


def test_w9_hash_sample(spark):
    by_site: dict = {}
    for r in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_suppkey", "l_orderkey", "l_linenumber").collect():
        by_site.setdefault(r[0], []).append(f"{r[1]}-{r[2]}")
    want = sorted((site, item) for site, items in by_site.items() for item in sorted(items, key=lambda x: order_of(7, x))[:40])
    assert sorted((r["l_suppkey"], r["item"]) for r in QUERIES["w9_hash_sample"](spark, SF).collect()) == want


def test_w18_random_rows(spark):
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect()}
    want = sorted(urls.values(), key=lambda u: order_of(3, u))[:25]
    assert [r["url"] for r in QUERIES["w18_random_rows"](spark, SF).collect()] == want
    some = spark.createDataFrame([(i, f"u{i}") for i in range(1000)], "i int, url string")
    assert R.random_rows(some.repartition(5), 30, "url", 9).collect() == R.random_rows(some, 30, "url", 9).collect()


def fitted(content: dict, budget: int) -> tuple[dict, bool, int]:
    """P18 on one row, on its bytes."""
    size = lambda: len(json.dumps(content, ensure_ascii=False, separators=(",", ":")).encode())
    content = dict(content)
    truncated = size() > budget
    if truncated:
        content["links"] = content["links"][:1000]
        if size() > budget:
            content["logo"] = None
        for c in ("html", "text", "markdown"):
            over = size() - budget
            if over > 0 and content[c]:
                kept = content[c].encode()[: max(0, len(content[c].encode()) - over - 64)]
                content[c] = kept.decode("utf-8", "ignore")
        if size() > budget:
            content["links"] = []
    return content, truncated, size()


def test_p18_size_budget(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", F.upper("text").alias("upper")).collect()
    got = {r["doc_id"]: r for r in QUERIES["p18_size_budget"](spark, SF).collect()}
    assert len(got) == len(docs)
    cut = 0
    for d in docs:
        content, truncated, size = fitted({"html": d["text"], "text": d["text"], "markdown": d["upper"], "links": d["text"].split(" "), "logo": "data:"}, 6000)
        r = got[d["doc_id"]]
        cut += truncated
        assert (r["truncated"], r["content_bytes"]) == (truncated, size)
        assert (r["n_html"], r["n_text"], r["n_markdown"], r["n_links"]) == (len(content["html"]), len(content["text"]), len(content["markdown"]), len(content["links"]))
    assert 0 < cut < len(docs)


def test_p18_on_odd_texts(spark):
    """Wide characters cut in two, escapes that grow, many links, empty fields."""
    rows = [
        (0, "é" * 3000, "日" * 800, "🙂" * 400, ["/a"] * 3, "data:x"), (1, '"\\\n' * 900, "\t" * 500, "x", ["/b" * 40] * 1500, None), (2, "", "", "", [], None), (3, "a", "b", "c" * 9000, ["/c"] * 1200, "data:" + "y" * 8000),
        (4, "", "", "", ["/" + "z" * 3000] * 2, "logo"), (5, "plain", "plain", "plain", ["/p"], "data:"),
    ]
    df = spark.createDataFrame(rows, "id int, html string, text string, markdown string, links array<string>, logo string")
    for budget in (300, 2000, 4000):
        for r in P.fit_budget(df, budget).collect():
            content, truncated, size = fitted(dict(zip(("html", "text", "markdown", "links", "logo"), rows[r["id"]][1:], strict=True)), budget)
            assert (r["truncated"], r["content_bytes"]) == (truncated, size) and {c: r[c] for c in content} == content
            assert size <= budget
