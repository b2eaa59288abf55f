"""Pattern search by automaton against the expressions themselves."""

import random
import re

import pytest

from siteloom.functions import patterns as P
from siteloom.operators import signals as S


@pytest.mark.parametrize(
    "pattern, parts, runs",
    [
        ("abc|d[|e]f|g(h|i)j", ["abc", "d[|e]f", "g(h|i)j"], [["abc"], ["d", None, "f"], ["g", None, "j"]]),
        (r"a\.com/\d+/x", [r"a\.com/\d+/x"], [["a.com/", None, "/x"]]),
        (r"vue(\.min)?\.js", [r"vue(\.min)?\.js"], [["vue", None, ".js"]]),
        ("colou?r|x{2}y", ["colou?r", "x{2}y"], [["colo", None, "r"], [None, "y"]]),
        ("^start", ["^start"], [[None, "start"]]),
    ],
)
def test_alternatives_and_literals(pattern, parts, runs):
    assert P.alternatives(pattern) == parts and [P.literal_runs(x) for x in parts] == runs
    assert [P.plain_text(x) for x in parts] == [r[0] if len(r) == 1 else None for r in runs]


def test_signatures_equal_their_expressions(spark):
    """Pages made of pieces of all html patterns, some spoilt, against one search per pattern."""
    html = [(n, p) for n, _, part, _, p in S.SIGNATURES if part == "html"]
    filled = lambda x: re.sub(r"\\(.)", r"\1", re.sub(r"\\d\+|\\d\*|\\d", "7", re.sub(r"\[0-9a-f\]\{6,\}", "0a1b2c", re.sub(r"\([^)]*\)\?|[?]", "", x))))
    pieces = [filled(a) for _, p in html for a in P.alternatives(p)]
    rnd, pages = random.Random(2), [None, "", "İK Kelvin wordpreſs", "x" * 300_000 + "jquery"]
    for i, piece in enumerate(pieces):
        pages += [f"<p>{piece.upper()}é", piece[:-1], " ".join(rnd.sample(pieces, 3)) + piece[: rnd.randint(1, 9)]]
    df = spark.createDataFrame([(str(i), t, {"server": "nginx"} if i % 9 == 0 else None) for i, t in enumerate(pages)], "domain string, html string, headers map<string,string>")
    got = {(r.domain, r.tech) for r in S.detect_technologies(df).collect()}
    want = {(str(i), n) for i, t in enumerate(pages) for n, p in html if t and re.search(p, t[:300_000], re.I | re.A)}
    want |= {(str(i), n) for i in range(0, len(pages), 9) for n, _, part, key, p in S.SIGNATURES if part == "header" and key == "server" and re.search(p, "nginx", re.I)}
    assert got == want and len({n for _, n in got}) > 90
    assert S.detect_technologies(df.where("domain = 'none'")).collect() == []
