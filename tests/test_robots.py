"""Path rules as one automaton against a regular expression per rule."""

import random
import re
import time

from siteloom.functions.paths import PathRules
from siteloom.operators import signals as S


def by_expression(rules, path):
    best = (-1, True)
    for allow, pattern in rules:
        body = "".join(".*" if c == "*" else re.escape(c) for c in pattern.removesuffix("$"))
        if re.match(body + ("$" if pattern.endswith("$") else ""), path):
            best = max(best, (len(pattern), allow))
    return best[1]


def test_automaton_equals_expressions():
    rnd = random.Random(1)
    for _ in range(3_000):
        rules = [(rnd.random() < 0.5, "/" + "".join(rnd.choice("ab/*") for _ in range(rnd.randint(0, 6))) + rnd.choice(["", "", "$", "*", "**$"])) for _ in range(rnd.randint(0, 8))]
        path = "/" + "".join(rnd.choice("ab/$") for _ in range(rnd.randint(0, 8)))
        assert PathRules(rules).allows(path) == by_expression(rules, path), (rules, path)


def test_a_large_host_is_told_apart_in_groups(spark):
    rnd = random.Random(2)
    rules = [(i % 3 == 0, f"/{i % 700}/{'*' if i % 50 == 0 else ''}x{i}") for i in range(5_000)]
    paths = [f"/{rnd.randrange(700)}/{'q' * rnd.randrange(3)}x{rnd.randrange(5_000)}/{k}" for k in range(100_000)]
    urls = spark.createDataFrame([(f"https://big.com{p}",) for p in paths] + [("https://none.com/0/x0",), (None,), ("https://big.com/0/x0",), ("https://big.com/0/x0",)], "url string")
    table = spark.createDataFrame([("big.com", a, p) for a, p in rules], "host string, allow boolean, path string")
    began = time.perf_counter()
    got = S.robots_allowed(urls, table, host_urls=30_000).collect()
    assert time.perf_counter() - began < 60 and len(got) == 100_004
    answers = {r["url"]: r["allowed"] for r in got}
    assert answers[None] and answers["https://none.com/0/x0"] and answers["https://big.com/0/x0"]
    for p in rnd.sample(paths, 60):
        assert answers[f"https://big.com{p}"] == by_expression(rules, p)
    assert any(not a for a in answers.values())
