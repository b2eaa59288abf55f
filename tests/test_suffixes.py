"""Registrable domains under the whole suffix list, type names, whole reports."""

import pytest

from siteloom.functions import urls as U
from siteloom.operators import estimate as T
from siteloom.sources import lists, sinks

HOSTS = {
    "shop.example.ca": "example.ca", "a.b.ru": "b.ru", "www.x.com.cn": "x.com.cn", "y.co.kr": "y.co.kr", "co.kr": None, "deep.er.blogspot.com": "er.blogspot.com",
    "a.b.c.ck": "b.c.ck", "www.ck": "www.ck", "x.www.ck": "www.ck", "c.ck": None, "city.kobe.jp": "city.kobe.jp", "a.b.kobe.jp": "a.b.kobe.jp",
    "shop.muenchen.example.de.": "example.de", "x.nosuchname": None, "nosuchname": None, "a.xn--p1ai": "a.xn--p1ai", None: None, "": None,
}


def test_whole_list_by_default(spark):
    rows = spark.createDataFrame([(h,) for h in HOSTS], "host string")
    got = {r.host: r.domain for r in U.registrable_domains(rows, "host", U.suffix_table(spark)).collect()}
    assert got == HOSTS and len(U.shipped_suffixes(spark)) > 5_000


def test_lists_keep_all_suffixes(spark, tmp_path):
    (tmp_path / "crux.csv").write_text("origin,rank\nhttps://shop.example.ca,1000\nhttps://www.example.ca,5000\nhttps://a.b.ru,1000\nhttp://www.x.com.cn,10000\nhttps://y.co.kr,1000\n")
    got = {r.domain: r["rank"] for r in lists.READERS["crux_top"](spark, str(tmp_path / "crux.csv")).collect()}
    assert got == {"example.ca": 1000, "b.ru": 1000, "x.com.cn": 10000, "y.co.kr": 1000}


@pytest.mark.parametrize(
    "name, flags",
    [("TechArticle", (False, True, False)), ("Store", (False, False, True)), ("Offer", (True, False, False)), ("Thing", (False, False, False)), (None, (False, False, False))],
)
def test_type_names(spark, name, flags):
    row = spark.createDataFrame([([name] if name else None,)], "types array<string>").select(*[v.alias(k) for k, v in T.type_flags(U.F.col("types")).items()]).first()
    assert tuple(row) == flags


def test_reports_are_whole_or_refused(spark):
    df = spark.range(450).toDF("k")
    assert sinks.markdown_table(df, "k").count("\n") == 451
    assert "| 449 |" in sinks.benchmark_report({"all": (df, "k")})
    with pytest.raises(ValueError):
        sinks.markdown_table(df, "k", most=449)
