"""Operators' pure parts against brute force."""

import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siteloom.llm import common, lines, mixing, packing, ranking, rules, simhash, suffixes, topk


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 200), max_size=20))
@settings(max_examples=60, deadline=None)
def test_pack_histogram_places_each_length_once_within_size(counts):
    patterns = packing.pack_histogram(counts, 64)
    placed = {}
    for n, lengths in patterns:
        assert n > 0 and sum(lengths) <= 64
        for x in lengths:
            placed[x] = placed.get(x, 0) + n
    assert placed == counts
    by_length = {}
    for length, lo, hi, _, _ in packing.slots(patterns):
        assert lo == by_length.get(length, 0)
        by_length[length] = hi
    assert by_length == counts


def test_cut_covers_all_ids():
    for n in (1, 511, 512, 513, 1023, 1024, 1025, 5000):
        parts = packing.cut(n)
        assert sum(parts) == n and all(0 < p <= 1024 for p in parts)


def test_fast_encoder_gives_the_tokenizers_ids():
    P = pytest.importorskip("public_tokenizers")
    args = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")
    texts = ["", "Hello  wörld\n\n x", "a" * 5000, " \t\n ", "don't we'll 12345 ***", "日本語 and 😀", "<|endoftext|> in text", "é" * 300]
    for t in texts:
        assert packing.token_ids(t, *args) == packing.token_ids(t, args[0])


def test_fingerprint_matches_its_definition():
    import xxhash

    def plain(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        if not words:
            return 0
        hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    for t in ("", " \n", "One", "a b c", "A b C d E f", "É À x y z z z z z z", "w " * 5000):
        assert simhash.fingerprint(t) == plain(t)


@pytest.mark.parametrize("slices,limit", [(3, 4), (5, 4), (1, 4), (2, 5)])
def test_forest_shards_and_stars_find_every_component(slices, limit):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    near = base.repeat(4) ^ np.array([sum(1 << int(b) for b in rng.integers(0, 64, 3)) for _ in range(240)], np.uint64)
    fps = np.unique(np.concatenate([base, near]))
    forest = simhash.fit_forest(fps.view(np.int64), 4, slices)
    groups = {}
    for tree, (mask, levels) in enumerate(forest):
        for f in fps.tolist():
            leaves = [0]
            for v, r in levels:
                d = ((f ^ v) & mask).bit_count()
                leaves = [x for leaf in leaves for x in ([2 * leaf + (d > r)] + ([2 * leaf + 1] if r - limit // slices < d <= r else []))]
            for leaf in leaves:
                groups.setdefault((tree, leaf), []).append(f)
    got = components_of(fps.tolist(), [(a % 2**64, b % 2**64) for g in groups.values() for a, b in zip(*(x.tolist() for x in simhash.star_links(np.array(g, np.uint64), limit)))])
    want = components_of(fps.tolist(), [(a, b) for i, a in enumerate(fps.tolist()) for b in fps[i + 1 :].tolist() if (a ^ b).bit_count() <= limit])
    assert got == want


def test_without_overlap_at_boundaries_pairs_are_lost():
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**64, 400, dtype=np.uint64)
    near = base ^ np.array([sum(1 << int(b) for b in rng.choice(64, 4, replace=False)) for _ in base], np.uint64)
    forest = simhash.fit_forest(np.concatenate([base, near]).view(np.int64), 8, simhash.SLICES)

    def leaves(fp, tolerance):
        out = set()
        for tree, (mask, levels) in enumerate(forest):
            own = [0]
            for v, r in levels:
                d = ((fp ^ v) & mask).bit_count()
                own = [x for leaf in own for x in ([2 * leaf + (d > r)] + ([2 * leaf + 1] if r - tolerance < d <= r else []))]
            out |= {(tree, x) for x in own}
        return out

    met = [sum(bool(leaves(a, t) & leaves(b, t)) for a, b in zip(base.tolist(), near.tolist())) for t in (0, 4 // simhash.SLICES)]
    assert met[1] == 400 > met[0]


def components_of(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_share_targets_reshare_and_stop_at_the_cap():
    t = mixing.share_targets([100, 10, 1000], [5, 2, 1], 900, 2.0)
    assert t == [200, 20, 680] and mixing.share_targets([], [], 0) == []
    assert mixing.share_targets([0, 10], [5, 1], 15, 2.0) == [0.0, 15.0]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000])
def test_permutation_is_one(n):
    assert sorted(mixing.permuted(np.arange(n), n, 3).tolist()) == list(range(n))


def test_take_words_keeps_runs_and_spacing():
    assert mixing.take_words("a  b\nc d", [(0, 1), (2, 2)]) == "a  c d"
    assert mixing.take_words(" a b ", [(0, 2)]) == " a b "


@pytest.mark.parametrize("spread", [3, 60, 100_000])
def test_index_is_exact_with_ties_and_negative_values(spread):
    rng = np.random.default_rng(1)
    x = rng.integers(-spread, spread, (2000, 16))
    x[5] = x[6] = x[7]
    index, own = topk.ImpactIndex(x), np.array([0, 5, -1, 1999])
    q = x[[0, 5, 7, 1999]]
    all_ = q @ x.T
    all_[[0, 1, 3], [0, 5, 1999]] = -(10**18)
    for threshold in (np.full(4, -np.inf), np.sort(all_, axis=1)[:, -5].astype(float), np.sort(all_, axis=1)[:, -9].astype(float)):
        who, at, score = index.search(q, 5, own, threshold)
        assert len(who) < 4 * len(x) / 8  # most rows are proved out of reach
        for i in range(4):
            mine = who == i
            best = np.lexsort((at[mine], -score[mine]))[:5]
            want = np.lexsort((np.arange(2000), -all_[i]))[:5]
            assert at[mine][best].tolist() == want.tolist() and score[mine][best].tolist() == all_[i][want].tolist()
    none = np.full(1, -np.inf)
    assert topk.ImpactIndex(x[:3]).search(x[:1], 5, np.array([0]), none)[1].size == 2
    assert topk.ImpactIndex(x[:1]).search(x[:1], 5, np.array([0]), none)[0].size == 0
    assert topk.ImpactIndex(np.zeros((9, 4), int)).search(np.zeros((1, 4), int), 5, np.array([-1]), none)[1].size == 9


def clustered(n=6000, dims=64):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, dims)) * (rng.random((30, dims)) < 0.3)
    return np.floor(256 * (centres[rng.integers(0, 30, n)] + 0.05 * rng.normal(size=(n, dims)))).astype(int)


def test_index_reads_few_postings_in_order_of_impact(monkeypatch):
    """On clustered vectors proof comes long before the last segment, and only if segments come by descending impact."""
    x = clustered()
    own = np.flatnonzero((x @ x[0]) > 0.5 * (x[0] @ x[0]))[:60]
    best = np.sort(x[own] @ x.T, axis=1)[:, -6].astype(float)
    read = {}
    for name in ("impact", "by dimension", "ascending"):
        if name == "by dimension":
            monkeypatch.setattr(topk.ImpactIndex, "order", lambda self, w: np.arange(len(self.begin)))
        if name == "ascending":
            monkeypatch.setattr(topk.ImpactIndex, "order", lambda self, w: np.argsort(w[self.dim] * self.top, kind="stable"))
        index = topk.ImpactIndex(x)
        who, at, score = index.search(x[own], 5, own, best)
        assert all((score[who == i] >= best[i]).sum() >= 5 for i in range(len(own)))
        read[name] = index.read / x.size
    assert read["impact"] < 0.5 and read["impact"] < 0.7 * min(read["by dimension"], read["ascending"])


def test_index_holds_no_zeros():
    rng = np.random.default_rng(3)
    x = np.where(rng.random((3000, 64)) < 0.05, rng.integers(1, 900, (3000, 64)), 0)
    index = topk.ImpactIndex(x)
    who, at, score = index.search(x[:50], 5, np.arange(50), np.full(50, -np.inf))
    assert index.read <= len(index.row) < 0.06 * x.size
    plain = x[:50] @ x.T
    plain[np.arange(50), np.arange(50)] = -1
    for i in range(50):
        assert sorted(score[who == i])[-5:] == sorted(plain[i])[-5:]


def test_band_recall_is_high_at_the_threshold():
    random.seed(3)
    pairs = []
    for n in (30, 100, 180, 400, 900):
        for _ in range(60):
            a = "".join(random.choice("abcdefghij klm") for _ in range(n))
            e = list(a)
            while True:
                f = e[:]
                f[random.randrange(n)] = "#"
                if not common.alike(lines.shingles(a), lines.shingles("".join(f))):
                    break
                e = f
            pairs += [a, "".join(e)]
    bands = lines.band_hashes(pairs)
    hits = [bool(set(bands[i]) & set(bands[i + 1])) for i in range(0, len(pairs), 2)]
    assert np.mean(hits) >= 0.97
    assert [x.tolist() for x in lines.band_hashes(pairs[:3])] == [x.tolist() for x in bands[:3]]  # no neighbour changes a signature


def test_star_links_span_chains():
    a = {1, 2, 3, 4, 5, 6, 7, 8, 9}
    chain = [a, (a - {1}) | {10}, (a - {1, 2}) | {10, 11}, {99}]
    links = common.star_links([1, 2, 3, 4], chain)
    assert components_of([1, 2, 3, 4], links) == {1: 1, 2: 1, 3: 1, 4: 4}


@given(st.lists(st.binary(max_size=40), unique=True, min_size=1, max_size=30))
@settings(max_examples=100, deadline=None)
def test_blind_trie_orders_like_sorted(strings):
    assert [strings[i] for i in suffixes.blind_trie_order(strings)] == sorted(strings)


@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 1), st.integers(0, 2), st.integers(0, 3)), min_size=1, max_size=60), st.sampled_from([0, 8, 16, 56]))
@settings(max_examples=80, deadline=None)
def test_deep_shallow_orders_like_sorted(shape, shallow):
    m = np.array([[97 + c] * 3 + [97] * 17 + [97 + a] * 20 + [97 + b] * 8 + [97 + c] * 8 for _, a, b, c in shape], np.uint8)
    group = np.array([g for g, *_ in shape])
    order = suffixes.deep_shallow_order(m, group, shallow)
    assert sorted(order.tolist()) == list(range(len(m)))
    assert [(group[i], m[i].tobytes()) for i in order] == sorted((g, x.tobytes()) for g, x in zip(group, m))


def test_multikey_quicksort_leaves_ties_of_its_depth_to_the_tries(monkeypatch):
    rng = np.random.default_rng(6)
    words = rng.integers(0, 5, (3000, 3)).astype(np.uint64)
    words[rng.random(3000) < 0.1, 0] = 2**64 - 1
    group = rng.integers(0, 4, 3000)
    order, start, size = suffixes.multikey_quicksort(words, group, 2)
    keys = [(group[i], *words[i, :2].tolist()) for i in order]
    assert keys == sorted(keys)
    runs = {keys[a]: n for a, n in zip(start.tolist(), size.tolist())}
    assert runs == {k: keys.count(k) for k in set(keys) if keys.count(k) > 1}
    assert all(len({keys[i] for i in range(a, a + n)}) == 1 for a, n in zip(start.tolist(), size.tolist()))
    # a shard's strings are ordered by these two steps and nothing else
    asked = []
    monkeypatch.setattr(suffixes, "blind_trie_order", lambda strings, skip=0: asked.append((len(strings), skip)) or sorted(range(len(strings)), key=strings.__getitem__))
    m = np.array([[1] * 16 + [k] * 8 for k in (3, 1, 2)] + [[2] * 24], np.uint8)
    assert suffixes.deep_shallow_order(m).tolist() == [1, 2, 0, 3] and asked == [(3, 16)]


def test_anchors_partition_the_starts_and_agree_between_texts():
    random.seed(2)
    text = bytes(random.choice(b"abcd ") for _ in range(3000))
    got = list(suffixes.anchors([b"", text, b"zz" + text[100:900], text[:49]]))
    starts = {1: [], 2: []}
    picks = {1: {}, 2: {}}
    for t, at, h, first, last in got:
        for i, p, f, z in zip(t.tolist(), at.tolist(), first.tolist(), last.tolist()):
            starts[i] += range(f, z + 1)
            picks[i] |= {s: p for s in range(f, z + 1)}
    assert starts[1] == list(range(len(text) - 49)) and starts[2] == list(range(802 - 49))
    assert all(picks[2][s] + 98 == picks[1][s + 98] for s in range(2, 802 - 49))


def test_pairwise_model_ranks_held_out_pairs():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, len(ranking.FEATURES)))
    y = (x[:, 0] + 0.2 * rng.normal(size=600) < 0.8).astype(int)
    model = ranking.fit(x[:400], y[:400])
    s = model.score(x[400:])
    good, bad = s[y[400:] == 1], s[y[400:] == 0]
    assert (good[:, None] > bad[None, :]).mean() > 0.95 and 0 <= s.min() and s.max() <= 1
    assert ranking.fit(x[:5], np.ones(5)) is None
    assert len(ranking.text_features("")) == len(ranking.FEATURES)


def test_decision_list_finds_a_planted_rule():
    rng = np.random.default_rng(5)
    cells = rng.integers(0, 8, (2000, 3))
    bad = (cells[:, 1] > 5) & (cells[:, 2] <= 3)
    w = np.ones((2000, 2))
    found = rules.learn_cells(cells, w * bad[:, None], w * ~bad[:, None])
    out = np.zeros(2000, bool)
    for rule in found:
        hit = np.ones(2000, bool)
        for j, above, v in rule:
            hit &= cells[:, j] > v if above else cells[:, j] <= v
        out |= hit
    assert (out == bad).mean() > 0.99
    assert rules.learn_cells(cells, w * 0, w) == []


def test_crc_is_of_little_endian_ids():
    assert zlib.crc32(np.array([1, 256], "<u4").tobytes()) == zlib.crc32(b"\x01\x00\x00\x00\x00\x01\x00\x00")


def test_shards_draw_what_the_splitting_tree_gives_them():
    have = np.array([700, 200, 90, 10])
    parts = [mixing.split_tree(have, 10, k, 11) for k in range(10)]
    assert sum(own for _, own in parts).tolist() == have.tolist() and all(own.sum() == 100 for _, own in parts)
    at = np.zeros(4, int)
    for first, own in parts:
        assert first.tolist() == at.tolist()
        at = at + own
    even = np.array([own / have for _, own in parts])
    assert even.std() > 0.01  # a draw, not an even cut
    many = np.array([mixing.split_tree(have, 2, 0, seed)[1][0] for seed in range(400)])
    # hypergeometric: 500 of 1000 blocks, 700 of them of the first source
    assert abs(many.mean() - 350) < 2 and abs(many.std() - 7.25) < 1.2


def test_pairs_are_bounded_in_all(monkeypatch):
    """19,000 of 20,000 rows of label 0 give as many pairs as the bound says, and the order is learned."""
    rng, made = np.random.default_rng(4), []
    y = (np.arange(20_000) % 20 == 0).astype(int)
    x = rng.normal(size=(20_000, len(ranking.FEATURES))) + y[:, None] * 2
    repeat = np.repeat
    monkeypatch.setattr(np, "repeat", lambda a, n, *r, **k: made.append(len(a) * n) or repeat(a, n, *r, **k))
    model = ranking.fit(x, y)
    monkeypatch.undo()
    assert made[0] == 19_000 * 21 <= ranking.MAX_PAIRS
    s = model.score(x)
    assert np.mean(s[y == 1][:, None] > s[y == 0][None, :2_000]) > 0.99
