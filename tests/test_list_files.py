"""The data source of list files: five providers, splits, compressed files of any size."""

import gzip
import zipfile

import pytest

from siteloom.sources import lists as L
from siteloom.sources.list_files import list_file


def lines_of(df):
    return [r["value"] for r in df.collect()]


def test_five_providers(spark, tmp_path):
    (tmp_path / "t.csv").write_text("1,Example.com\n2,no domain\r\n\n3,b.co.uk\nx,c.com\n0,d.com")
    (tmp_path / "m.csv").write_text("GlobalRank,TldRank,Domain,TLD,RefSubNets,RefIPs\n1,1,a.com,com,10,20\n2,1,\"b.org\",org,x,5\n")
    (tmp_path / "o.csv").write_text("﻿ Rank ,Domain,Extension,Open Page Rank,Referring Domains\n1,a.com,com,9.5,100\n2,b.com\n")
    (tmp_path / "c.csv").write_text("origin,rank\nhttps://www.a.com,5000\nhttp://b.a.com,1000,extra\n")
    with gzip.open(tmp_path / "g.txt.gz", "wt") as f:
        f.write("#h\n1\t0.5\t7\t0.1\tcom.example\t3\n2\t0.5\tx\t0.1\torg.bad\t3\n")
    with gzip.open(tmp_path / "g.txt.gz", "at") as f:  # a second gzip member
        f.write("3\t0.5\t9\t0.1\torg.last\n")
    names = {"tranco": "t.csv", "majestic": "m.csv", "openpagerank": "o.csv", "crux_top": "c.csv", "cc_webgraph": "g.txt.gz"}
    rows = L.read_lists(spark, {p: ("v", str(tmp_path / n)) for p, n in names.items()}).collect()
    got = {(r["provider"], r["domain"]): r for r in rows}
    assert sorted(got) == [("cc_webgraph", "example.com"), ("cc_webgraph", "last.org"), ("crux_top", "a.com"), ("majestic", "a.com"), ("majestic", "b.org"),
                           ("openpagerank", "a.com"), ("openpagerank", "b.com"), ("tranco", "b.co.uk"), ("tranco", "example.com")]
    assert got["crux_top", "a.com"]["rank"] == 1000 and got["cc_webgraph", "example.com"]["pr_rank"] == 7
    assert (got["majestic", "a.com"]["ref_ips"], got["majestic", "b.org"]["ref_subnets"]) == (20, None)
    assert (got["openpagerank", "a.com"]["score"], got["openpagerank", "a.com"]["ref_domains"], got["openpagerank", "b.com"]["score"]) == (9.5, 100, None)


@pytest.mark.parametrize("split", [1, 2, 3, 7, 16, 1000])
def test_splits_lose_and_repeat_nothing(spark, tmp_path, split):
    want = ["", "a", "", "bbé", "c" * 40, "d", "", "last"]
    (tmp_path / "x.txt").write_bytes("\n".join(want).encode())
    (tmp_path / "y.txt").write_bytes(b"one\r\ntwo\r\n")
    df = list_file(spark, "lines", str(tmp_path), splitBytes=str(split))
    assert lines_of(df) == [*want, "one", "two"]
    assert df.rdd.getNumPartitions() >= (10 if split <= 3 else 2)


def test_a_zip_member_beyond_two_gigabytes(spark, tmp_path):
    line, n = b"x" * ((1 << 20) - 1) + b"\n", 2_200
    with zipfile.ZipFile(tmp_path / "big.zip", "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
        z.writestr("folder/", "")
        with z.open("member.txt", "w", force_zip64=True) as f:
            for _ in range(n):
                f.write(line)
        z.writestr("second.txt", "not read")
    row = L.read_lines(spark, str(tmp_path / "big.zip")).selectExpr("count(*) as n", "sum(length(value)) as chars").first()
    assert tuple(row) == (n, n * ((1 << 20) - 1)) and row["chars"] > 2**31


def test_errors_and_empty_files(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "bad.csv").write_text("Domain,x\na.com,1\n")
    with zipfile.ZipFile(tmp_path / "none.zip", "w") as z:
        z.writestr("folder/", "")
    for provider in ("tranco", "majestic"):
        assert list_file(spark, provider, str(tmp_path / "empty.csv")).count() == 0
    for provider, name in (("openpagerank", "bad.csv"), ("tranco", "none.zip"), ("tranco", "absent.csv"), ("nobody", "empty.csv")):
        with pytest.raises(Exception, match="no column|no member|absent|unknown list provider"):
            list_file(spark, provider, str(tmp_path / name)).collect()
