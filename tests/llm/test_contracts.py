"""The registered queries on the smallest tables: their columns, and their rows against SQL or brute force."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest

import __spark_entry__
from siteloom.llm import common, lines, mixing, packing, queries, ranking, secrets, simhash

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = {
    "op1_warc_revisits": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op2_simhash_components": "doc_id bigint, fingerprint string, component_id bigint",
    "op3_mix_sources": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op4_secret_spans": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op5_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op6_top_neighbours": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op7_line_components": "doc_id bigint, n_lines bigint, n_dropped bigint, dropped string",
    "op8_quality_ranking": "doc_id bigint, held_out boolean, score double, predicted int",
    "op9_pack_sequences": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op10_repeated_strings": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
}


@pytest.fixture(scope="module")
def result(spark):
    """Rows of a registered query, whose columns are checked."""
    made = {}

    def of(name):
        if name not in made:
            df = __spark_entry__.queries()[name](spark, SF)
            want = [tuple(c.split()) for c in COLUMNS[name].split(", ")]
            assert df.dtypes[: len(want)] == want
            made[name] = df.collect()
        return made[name]

    return of


@pytest.fixture(scope="module")
def docs():
    rows = duckdb.sql(f"SELECT doc_id, text, source FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()
    return {i: (t or "", s) for i, t, s in rows}


@pytest.mark.parametrize("name", ["op1_warc_revisits", "op6_top_neighbours"])
def test_query_equals_its_sql(result, name):
    con = duckdb.connect()
    for t in ("pages", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = con.sql(queries.ORACLES[name])
    rows = [tuple(r[c] for c in got.columns) for r in result(name)]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(rows, key=key) == sorted(got.fetchall(), key=key)


def reach(n, near):
    """The smallest number reachable from each of range(n)."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in near:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_op2_components(result, docs):
    rows = sorted(result("op2_simhash_components"), key=lambda r: r["doc_id"])
    fps = [simhash.fingerprint(t) for t, _ in docs.values()]
    ids = list(docs)
    near = [(a, b) for a in range(len(ids)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4]
    want = [(i, f"{f:016x}", ids[r]) for i, f, r in zip(ids, fps, reach(len(ids), near))]
    assert [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows] == want


def test_op3_places_follow_the_splitting_tree(result, docs):
    rows = result("op3_mix_sources")
    words = {i: len(WORD.findall(t)) for i, (t, _) in docs.items()}
    by_source = {}
    for i, (_, s) in docs.items():
        by_source[s] = by_source.get(s, 0) + words[i]
    quota = mixing.quotas(by_source)
    number = {q.source: k for k, q in enumerate(quota)}
    have = np.array([q.quota for q in quota])
    shards = max(1, -(-int(have.sum()) // mixing.SHARD_BLOCKS))
    taken, slots, blocks = {}, {}, {}
    for r in rows:
        q = quota[number[docs[r["doc_id"]][1]]]
        assert r["size"] == words[r["doc_id"]] and r["source_size"] == q.words and abs(r["target"] - q.target) < 1e-6 * q.target + 1e-9
        assert r["taken"] == sum(p["length"] for p in r["places"]) <= 2 * r["size"]
        taken[q.source] = taken.get(q.source, 0) + r["taken"]
        for p in r["places"]:
            assert 0 <= p["start"] and p["start"] + p["length"] <= r["size"] and 0 <= p["shard"] < shards
            slots.setdefault(p["shard"], []).append(p["slot"])
            blocks[p["shard"], q.source] = blocks.get((p["shard"], q.source), 0) + p["length"]
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    for q in quota:
        assert abs(taken[q.source] - q.target) <= 0.02 * q.target + 2 * q.block
        for k in range(shards):
            own = int(mixing.split_tree(have, shards, k, 11)[1][number[q.source]])
            # blocks have q.block words, but for the last one of the source, which may be drawn twice
            assert own * q.block - 2 * q.block <= blocks.get((k, q.source), 0) <= own * q.block


def test_op4_base_spans(result, docs):
    for r in result("op4_secret_spans"):
        t, found = docs[r["doc_id"]][0], []
        for k, (p, least, g) in enumerate(((secrets.ASSIGN, 12, 2), (r"AKIA[A-Z0-9]+", 18, 0), (r"[0-9a-f]+", 16, 0))):
            found += [(m.start(), k, m.end()) for m in re.finditer(p, t) if len(m.group(g)) >= least]
        text = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest() and set(text.split(",")) - {""} <= set(r["spans"].split(","))
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(f[1] == k for f in found) for k in range(3)]


def test_op5_statistics(result, docs):
    rows = result("op5_quality_rules")
    for r in rows:
        t = docs[r["doc_id"]][0]
        w = WORD.findall(t)
        seen = {}
        for i in range(len(w) - 7):
            seen.setdefault(tuple(w[i : i + 8]), []).append(i)
        covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(8)}
        own = [x for x in t.split("\n") if WORD.search(x)]
        want = len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(own) - len(set(own)), len(covered)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (r["base_failed"] and r["kept"])
    assert sum(r["kept"] for r in rows) > len(rows) / 2


def test_op7_components(result, docs):
    rows = {r["doc_id"]: r for r in result("op7_line_components")}
    own = {i: lines.line_keys(t) for i, (t, _) in docs.items()}
    place = {}
    for i, found in own.items():
        for no, line in found:
            place.setdefault(line, (i, no))
    different = list(place)
    sets = [lines.shingles(x) for x in different]
    size = np.array([len(s) for s in sets])
    near = []
    for a in np.argsort(size).tolist():
        for b in np.flatnonzero((size >= size[a]) & (size * common.SIMILAR <= size[a])).tolist():
            if a != b and common.alike(sets[a], sets[b]):
                near.append((a, b))
    root = reach(len(different), near)
    first = {}
    for k, line in enumerate(different):
        first[root[k]] = min(first.get(root[k], place[line]), place[line])
    stays = {line: first[root[k]] for k, line in enumerate(different)}
    missed = due = 0
    for i, found in own.items():
        r = rows[i]
        gone = [(no, stays[line]) for no, line in found if stays[line] != (i, no)]
        kept_lines = [int(x) for x in r["kept_lines"].split(",") if x]
        got = list(zip([int(x) for x in r["dropped"].split(",") if x], zip(r["kept_docs"], kept_lines)))
        assert r["n_lines"] == len(found) and r["n_dropped"] == len(got)
        assert {no for no, _ in got} <= {no for no, _ in gone}  # no line is dropped that has no like
        missed, due = missed + len(gone) - len(set(got) & set(gone)), due + len(gone)
    assert due and missed <= 0.01 * due


def test_op8_holds_out_its_fold(spark):
    rows = __spark_entry__.queries()["op8_quality_ranking"](spark, "/root/testdata/sf0.01").collect()
    label = dict(duckdb.sql("SELECT doc_id, quality FROM '/root/testdata/sf0.01/labels.parquet'").fetchall())
    assert len(rows) == duckdb.sql("SELECT count(*) FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()[0][0]
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= ranking.CUT_SCORE) and 0 <= r["score"] <= 1
    known = [(r["score"], label[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in label]
    good, bad = [s for s, y in known if y == 1], [s for s, y in known if y == 0]
    assert bad and sum(g > b for g in good for b in bad) >= 0.95 * len(good) * len(bad)
    assert sum((s >= ranking.CUT_SCORE) == bool(y) for s, y in known) >= 0.9 * len(known)


def test_op9_pieces_hold_each_id_once(result, docs):
    paths = queries.tokenizer_paths()
    rows, at = {}, {}
    for r in result("op9_pack_sequences"):
        rows.setdefault(r["doc_id"], []).append(r)
        at.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(rows) == set(docs)
    for i, own in rows.items():
        ids, start = [*packing._encoders(*paths)[0].encode(docs[i][0], add_special_tokens=False).ids, 0], 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == start and r["doc_tokens"] == len(ids)
            part = np.array(ids[start : start + r["length"]], "<u4")
            assert len(part) == r["length"] and r["ids_crc32"] == zlib.crc32(part.tobytes())
            start += r["length"]
        assert start == len(ids)
    used = 0
    for parts in at.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 1024
        used += end
    assert sorted(at) == list(range(len(at))) and len(at) <= used / 1024 * 1.02 + 1


def test_op10_removes_what_brute_force_removes(result, docs):
    first = {}
    body = {i: t.encode() for i, (t, _) in docs.items()}
    for i in sorted(body):
        for s in range(len(body[i]) - 49):
            first.setdefault(body[i][s : s + 50], i)
    got = {r["doc_id"]: r for r in result("op10_repeated_strings")}
    for i, b in body.items():
        gone = np.zeros(len(b) + 1, int)
        hit = [s for s in range(len(b) - 49) if first[b[s : s + 50]] < i]
        np.add.at(gone, hit, 1)
        np.add.at(gone, [s + 50 for s in hit], -1)
        gone = np.cumsum(gone)[:-1] > 0
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(b), int(gone.sum()), int((gone & ~np.concatenate([[False], gone[:-1]])[: len(gone)]).sum()), hashlib.sha256(kept).hexdigest())
