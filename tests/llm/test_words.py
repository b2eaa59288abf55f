"""Periodic runs, benchmark windows and spelling variants against plain forms."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from siteloom.llm import decontaminate, queries, runs, spelling
from siteloom.llm.common import Workspace

SF = "/root/testdata/sf0.001"
EMPTY = hashlib.sha256(b"").hexdigest()


def lyndon_by_definition(s):
    is_lyndon = lambda w: all(w < w[k:] for k in range(1, len(w)))
    return [max(j - i for j in range(i + 1, len(s) + 1) if is_lyndon(s[i:j])) for i in range(len(s))]


def runs_by_definition(s, exponent, shortest):
    """Maximal stretches of each period, smallest periods first."""
    n, found = len(s), set()
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and s[j] == s[j + q]:
                j += 1
            end = j + q
            if j > i and end - i >= max(shortest, exponent * q) and not any(a <= i and end <= a + m and q % p == 0 for a, m, p in found):
                found.add((i, end - i, q))
            i = max(j, i) + 1
    return sorted(found)


def word_lists(n, seed=3):
    rnd = random.Random(seed)
    for _ in range(n):
        s = [rnd.randint(1, rnd.randint(1, 5)) for _ in range(rnd.randint(1, 40))]
        if rnd.random() < 0.6:
            p, a = rnd.randint(1, 5), rnd.randrange(len(s))
            s = [s[i] if i < a else s[a + (i - a) % p] if a + (i - a) % p < len(s) else s[i] for i in range(len(s))]
        yield s


def test_groups_give_the_lyndon_arrays_of_both_orders():
    for s in word_lists(400):
        assert runs.lyndon_array(s) == lyndon_by_definition(s)
        assert runs.lyndon_array([-x for x in s]) == lyndon_by_definition([-x for x in s])


@pytest.mark.parametrize("exponent, shortest", [(2, 2), (3, 3), (4, 6)])
def test_roots_extend_to_the_runs(exponent, shortest):
    for s in word_lists(600, seed=exponent):
        assert runs.runs_of(np.array(s), exponent, shortest) == runs_by_definition(s, exponent, shortest)


def test_rare_words_cut_no_run():
    for s in word_lists(600, seed=9):
        a = np.array(s)
        got = [(x + i, m, q) for x, y in runs.stretches(a, np.zeros(len(s), int), 4, 6) for i, m, q in runs.runs_of(a[x:y], 4, 6)]
        assert got == runs_by_definition(s, 4, 6)


def test_long_repetitions_take_linear_time():
    import time

    took = []
    for n in (50_000, 200_000):
        began = time.perf_counter()
        for s in (np.zeros(n, int), np.r_[np.zeros(n // 2, int), np.ones(n // 2, int)], np.arange(n) % 7):
            runs.runs_of(s, 4, 6)
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0]


def run_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if doc_id is not None and w and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g, n = zlib.crc32(str(doc_id).encode()) // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = runs_by_definition(w, 4, 6)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else (None, None, None)
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    left = " ".join(x for i, x in enumerate(w) if i not in gone)
    milli = 1000 * best[1] // best[2] if found else None
    return (doc_id, len(found), *best, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest())


def test_registered_runs_equal_the_plain_form(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r) for r in queries.op11_word_runs(spark, SF).collect()}
    assert len(got) == len(rows) and any(r[1] for r in got.values())
    for doc_id, text in rows:
        if len(text or "") < 5_000:
            assert got[doc_id] == run_row(doc_id, text)


def test_runs_of_odd_documents(spark):
    texts = [(1, None), (1, ""), (2, " \n\t"), (None, "a b " * 9), (3, "la " * 900), (3, "é ü " * 6), (4, "one\x1cword x x x x x x")]
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in texts], "doc_id long, text string, n_runs int, period string")
    got = sorted((tuple(r) for r in runs.run_summary(docs).collect()), key=str)
    plain = lambda i, t: (None, *run_row(None, t)[1:]) if i is None else (i, *run_row(None, t)[1:])
    assert got == sorted((plain(i, t) for i, t in texts), key=str)
    assert (1, 0, None, None, None, None, EMPTY, EMPTY) in got
    assert runs.run_summary(docs.where("doc_id > 9")).collect() == []
    long = spark.createDataFrame([(5, "la " * 200_000)], "doc_id long, text string")
    assert tuple(runs.run_summary(long).first())[:6] == (5, 1, 0, 200_000, 1, 200_000_000)
    with pytest.raises(ValueError):
        runs.run_summary(docs, exponent=1)


@pytest.mark.parametrize("name", ["op12_benchmark_windows", "op13_spelling_variants"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, SF)
    rows = [tuple(r[c] for c in want.columns) for r in got.collect()]
    assert sorted(rows, key=str) == sorted(want.fetchall(), key=str)


def windows_by_definition(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    known = [(i, tuple(w[s : s + 10])) for i, t in items for w in [words(t)] if w for s in range(max(len(w) - 9, 1))]
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item, win in known:
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s : s + len(win)]) == win:
                    hit.update(range(s, s + len(win)))
                    found.add(item)
        found = sorted(str(i) for i in found if i is not None)
        yield doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("part_bytes", [decontaminate.PART_BYTES, 400])
def test_windows_of_odd_documents_and_items(spark, part_bytes):
    rnd = random.Random(5)
    vocab = ["a", "Bb", "c3", "dé", "ee", "f"]
    text = lambda n: rnd.choice([" ", ", ", "\n"]).join(rnd.choice(vocab) for _ in range(n))
    items = [(1, text(14)), (2, text(10)), (2, text(4)), (10, text(3)), (11, text(2)), (None, text(12)), (12, None), (13, "..."), (14, "zz"), (15, text(30))]
    docs = [(i % 40, text(rnd.randint(0, 60))) for i in range(60)] + [(90, None), (None, items[0][1] + " Q " + items[5][1]), (91, "ZZ"), (92, "zzz " * 50_000 + items[9][1].upper().replace("É", "é"))]
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, items string, n_words int")
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, window string")
    got = decontaminate.contamination(Workspace(spark), d, b, part_bytes).collect()
    assert sorted(map(tuple, got), key=str) == sorted(windows_by_definition(docs, items), key=str)
    assert not any(r.contaminated for r in decontaminate.contamination(Workspace(spark), d, b.where("item_id < 0")).collect())
    assert decontaminate.contamination(Workspace(spark), d.where("doc_id < 0"), b).collect() == []


def test_search_skips_words():
    class Counting(list):
        read = 0

        def __getitem__(self, i):
            Counting.read += 1
            return super().__getitem__(i)

    search = decontaminate.WindowSearch([(tuple(b"w%d" % i for i in range(10)), "1")])
    words = Counting(b"x%d" % i for i in range(9_000))
    assert search.find(words) == ([], set()) and Counting.read <= 2_100
    assert search.find([*words, *(b"w%d" % i for i in range(10))]) == ([(9_000, 9_010)], {"1"})


def variants_by_definition(words):
    near = lambda a, b: a != b and (len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1 or abs(len(a) - len(b)) == 1 and min(a, b, key=len) in {max(a, b, key=len)[:i] + max(a, b, key=len)[i + 1 :] for i in range(max(len(a), len(b)))})
    around = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, vs in around.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        yield w, form[w], root, words[w], len(around[w]), words.get(form[w])


def test_variants_of_random_words(spark):
    rnd = random.Random(8)
    texts = []
    for i in range(150):
        texts.append((rnd.choice([i, None, 7]), " ".join("".join(rnd.choice("abÀé×") for _ in range(rnd.randint(3, 7))) for _ in range(60))))
    texts.append((None, "chains " * 3 + "chainsa " * 8 + "chainsab " * 20))
    long = "q" * 8_000
    texts += [(200, None), (201, ""), (202, f"{long} {long} {long} {long[1:]} {long[1:]} {long[1:]} {long[1:]} {long[1:]} {long[1:]}")]
    counts = Counter()
    for doc_id, text in texts:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{doc_id}:{w}".encode())
            if doc_id is not None and h % 7 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    docs = spark.createDataFrame([(i, t, "x", 2) for i, t in texts], "doc_id long, text string, word string, n int")
    got = spelling.spelling_variants(Workspace(spark), docs, rate=7)
    rows = sorted((tuple(r) for r in got.select("word", "form", "root", "n", "n_near", "form_n").collect()))
    assert rows == sorted(variants_by_definition(words)) and any(r[1] and r[2] != r[1] for r in rows)
    assert spelling.spelling_variants(Workspace(spark), docs.where("doc_id < 0")).collect() == []


def test_nodes_of_different_ways_have_different_numbers(spark):
    words = spark.createDataFrame([(w,) for w in ("abcab", "abcba", "aaaaa", "aaaaab")], "word string")
    seed = spelling.numbering(words)
    edges = spelling.trie_edges(words, seed).collect()
    ways = {}
    for w in ("abcab", "abcba", "aaaaa", "aaaaab"):
        for back in (False, True):
            for i in range(1, len(w) + 1):
                v = w[::-1] if back else w
                ways.setdefault((back, v[:i]), set())
    assert len({(e.back, e.node) for e in edges}) == len(ways)
