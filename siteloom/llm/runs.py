"""Periodic runs of words, found as extensions of Lyndon roots (Baier grouping).

The first phase of Baier's suffix sorting groups suffixes by their longest Lyndon prefix, and
so gives the Lyndon array without a sorted suffix array.  Done once for an order of the words
and once for the reverse order, the two arrays hold a Lyndon root of every run, at each of its
repetitions; a root extended to both sides by common extensions is the run.

Runs never cross documents, so a document is read by one task and nothing is shuffled.  A word
of a run with exponent e or more stands floor(e) times or more in that run; words that are
rarer in their stretch of text therefore cut it, again and again, and the grouping takes the
stretches that are left.  That cut is exact, and a text of repetitions only stays whole.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text

#: Characters of text that a task works on together.
_CHUNK = 1 << 22
_OUT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
Run = tuple[int, int, int]


def lyndon_array(ranks: list[int]) -> list[int]:
    """Length of the longest Lyndon word that starts at each place, by Baier's grouping.

    Groups are places whose texts begin with the same word so far, and are worked off from the
    highest to the lowest.  Each place of the group in work is taken out of the list of open
    places and given to the nearest open place before it, whose Lyndon word it prolongs; places
    of one group that are prolonged by the same number of pieces move to a new group above it.
    Time and space are linear in the number of places after the ranks are sorted.
    """
    n = len(ranks)
    members: list[list[int]] = []
    size: list[int] = []
    below: list[int] = []
    number: dict[int, int] = {}
    for r in sorted(set(ranks)):
        number[r] = len(members)
        below.append(len(members) - 1)
        members.append([])
        size.append(1)
    group = [number[r] for r in ranks]
    for i, g in enumerate(group):
        members[g].append(i)
    above = [*range(1, len(members)), -1]
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    out = [1] * n
    g = len(members) - 1
    while g >= 0:
        here = [i for i in members[g] if group[i] == g]
        members[g] = []
        if here:
            long, taken, last = size[g], {}, -2
            for i in here:
                out[i] = long
                p, q = before[i], after[i]
                if p >= 0:
                    after[p] = q
                    taken[p] = taken.get(p, 0) + 1
                if q >= 0:
                    before[q] = p
            moved: dict[tuple[int, int], list[int]] = {}
            for p, k in taken.items():
                if group[p] != g:
                    moved.setdefault((group[p], k), []).append(p)
            for h, k in sorted(moved):
                # pieces more stand above pieces fewer, and all of them above the rest of their group
                under = h if last < 0 or last_of != h else last
                new = len(members)
                places = moved[h, k]
                members.append(places)
                size.append(size[h] + k * long)
                up = above[under]
                above.append(up)
                below.append(under)
                above[under] = new
                if up >= 0:
                    below[up] = new
                for p in places:
                    group[p] = new
                last, last_of = new, h
        g = below[g]
    return out


def stretches(ids: np.ndarray, owner: np.ndarray, least: int, shortest: int) -> Iterator[tuple[int, int]]:
    """(begin, end) of the stretches of one owner in which every word stands ``least`` times or more.

    Words that stand less often are cut out and what they part is counted anew, until nothing is cut.
    """
    places = np.arange(len(ids))
    while len(ids):
        key = owner.astype(np.int64) * (int(ids.max()) + 1) + ids
        _, back, counts = np.unique(key, return_inverse=True, return_counts=True)
        stay = counts[back] >= least
        part = np.ones(len(ids), bool)
        part[1:] = (owner[1:] != owner[:-1]) | ~stay[:-1]
        owner = np.cumsum(part)
        whole = stay.all()
        ids, owner, places = ids[stay], owner[stay], places[stay]
        _, back, counts = np.unique(owner, return_inverse=True, return_counts=True)
        wide = counts[back] >= shortest
        whole &= wide.all()
        ids, owner, places = ids[wide], owner[wide], places[wide]
        if whole:
            break
    if len(ids):
        edges = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1], True])
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            yield int(places[a]), int(places[b - 1]) + 1


def _common(ids: np.ndarray, a: int, b: int, step: int) -> int:
    """How far the words at ``a`` and ``b`` (a < b) agree, going on by ``step`` (1 or -1)."""
    most = len(ids) - b if step > 0 else a + 1
    done, width = 0, 16
    while done < most:
        w = min(width, most - done)
        if step > 0:
            differ = ids[a + done : a + done + w] != ids[b + done : b + done + w]
        else:
            differ = ids[a - done - w + 1 : a - done + 1][::-1] != ids[b - done - w + 1 : b - done + 1][::-1]
        at = int(differ.argmax())
        if differ[at]:
            return done + at
        done, width = done + w, width * 4
    return most


def runs_of(ids: np.ndarray, exponent: int, shortest: int) -> list[Run]:
    """(start, length, period) of the runs of at least ``exponent`` periods and ``shortest`` words, sorted.

    ``exponent`` is 2 or more.  From 3 on a run holds two whole roots of the same length side by
    side in the Lyndon array of one of the orders, which is looked for first.
    """
    n, found = len(ids), set()
    plain = ids.tolist()
    for ranks in (plain, [-x for x in plain]):
        roots = lyndon_array(ranks)
        reached: dict[int, int] = {}
        for i, q in enumerate(roots):
            if i + q >= n or (exponent > 2 and roots[i + q] != q) or reached.get(q, 0) >= i + 2 * q:
                continue
            end = i + q + _common(ids, i, i + q, 1)
            begin = i - (_common(ids, i - 1, i + q - 1, -1) if i else 0)
            if end - begin >= 2 * q:
                reached[q] = max(reached.get(q, 0), end)
                if end - begin >= max(shortest, exponent * q):
                    found.add((begin, end - begin, q))
    return sorted((s, m, q) for s, m, q in found)


def planted_order(doc_id: int | None, n: int) -> list[int] | None:
    """The words' places after a tail of some documents is made periodic, None where it is not."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [*range(a), *(a + (i - a) % p for i in range(a, n))]


def _report(doc_id: int | None, words: list[bytes], runs: list[Run]) -> tuple:
    keep = words
    if runs:
        gone = np.zeros(len(words), bool)
        for s, m, q in runs:
            gone[s + q : s + m] = True
        keep = [w for w, x in zip(words, gone.tolist(), strict=True) if not x]
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    best = (None, None, None, None)
    if runs:
        s, m, q = runs[0]
        for x in runs[1:]:  # runs are sorted by start and period, so ties stay with the earlier one
            if x[1] * q > m * x[2]:
                s, m, q = x
        best = (s, m, q, 1000 * m // q)
    return (doc_id, len(runs), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(keep)).hexdigest())


def _work(ids: list[int | None], texts: list[str], exponent: int, shortest: int, order: Callable | None) -> list[tuple]:
    words, numbers, known = [], [], {}
    for doc_id, text in zip(ids, texts, strict=True):
        w = text.encode().split()  # ASCII white space, the six characters that separate words
        at = order(doc_id, len(w)) if order else None
        if at is not None:
            w = [w[i] for i in at]
        words.append(w)
        numbers.append(np.fromiter((known.setdefault(x, len(known)) for x in w), np.int64, len(w)))
    sizes = np.array([len(w) for w in words], np.int64)
    flat, owner = np.concatenate(numbers), np.repeat(np.arange(len(words)), sizes)
    first = np.cumsum(sizes) - sizes
    runs: list[list[Run]] = [[] for _ in words]
    for a, b in stretches(flat, owner, exponent, shortest):
        d = int(owner[a])
        runs[d] += [(a - int(first[d]) + s, m, q) for s, m, q in runs_of(flat[a:b], exponent, shortest)]
    return [_report(i, w, r) for i, w, r in zip(ids, words, runs, strict=True)]


def run_summary(docs: DataFrame, exponent: int = 4, shortest: int = 6, order: Callable | None = None) -> DataFrame:
    """Per document its runs of at least ``exponent`` (a whole number from 2) periods and ``shortest`` words.

    ``start, length, period`` and ``exponent_milli`` are of the run with the greatest length over period (ties: smallest
    start, then period), ``runs_sha256`` of all runs, and ``collapsed_sha256`` of the words left when each run keeps
    its first period only.  ``order(doc_id, n)`` may give other places of the words.

    Null and empty texts have no word: no run, four nulls, and digests of nothing.  A null doc_id stays null;
    repeated rows give a row each; other columns are not read.  Texts are whole however long: memory is
    about 100 bytes a word of the longest text, or of 4 million characters of shorter ones.
    """
    if exponent < 2 or shortest < 1:
        raise ValueError("runs have two periods or more, and a word or more")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(ids: list, texts: list) -> pa.RecordBatch:
            rows = list(zip(*_work(ids, texts, exponent, shortest, order), strict=True))
            kinds = [pa.int64()] * 6 + [pa.string()] * 2
            return pa.record_batch([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], names=[x.split()[0] for x in _OUT.split(", ")])

        for batch in batches:
            ids, texts, held = [], [], 0
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids.append(doc_id.as_py())
                texts.append(text.as_py())
                held += len(texts[-1])
                if held >= _CHUNK:
                    yield made(ids, texts)
                    ids, texts, held = [], [], 0
            if ids:
                yield made(ids, texts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_text("text").alias("text")).mapInArrow(run, _OUT)
