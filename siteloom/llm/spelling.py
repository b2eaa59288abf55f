"""Spelling variants: exact neighbours of words by pairs of trie nodes.

The words make two tries, one of their beginnings and one of their reversed ends, whose nodes
are numbered.  A word that skips the letter at a place is the pair (node before it, node behind
it); a word that takes in a letter at a place is the pair of the nodes that meet there.  Words
with the same pair differ by one letter: two that skip differ by a replaced one, one that
skips and one that takes in by an inserted one.  So neighbours meet by joining integers.

A pair holds at most one word for each letter and one that takes a letter in, so with 90 letters
no group has more than 91 rows, however common its words are.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, as_text

#: A run of letters of the text.
LETTERS = r"[A-Za-zÀ-ÿ]+"
#: Different letters after folding: a-z, and U+00C0 to U+00FF, of which A-Z only are folded.
ALPHABET = 26 + 64
_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_PRIME = (1 << 61) - 1
_HELD = 1 << 17


def misspelt(doc_id: int | None, word: str, rate: int) -> str:
    """The word without one letter, in one of ``rate`` of the (document, word) pairs, by checksum."""
    h = zlib.crc32(f"{doc_id}:{word}".encode())
    if doc_id is None or h % rate:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def count_words(docs: DataFrame, least_length: int = 5, least_count: int = 3, rate: int | None = None) -> DataFrame:
    """(word, n): runs of letters in all texts, A-Z in lower case, with at least so many letters and occurrences.

    Counts are added up per task before they are shuffled, in at most 131,072 different words (or those of one text) at once.
    """
    pattern = re.compile(LETTERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def made() -> pa.RecordBatch:
            return pa.record_batch([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                doc_id = doc_id.as_py()
                for word, n in Counter(pattern.findall(text.as_py().translate(_FOLD))).items():
                    if rate:
                        word = misspelt(doc_id, word, rate)
                    if len(word) >= least_length:
                        held[word] += n
                if len(held) > _HELD:
                    yield made()
                    held.clear()
        yield made()

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_text("text").alias("text")).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _paths(word: str, factor: int) -> list[int]:
    """Numbers of the trie nodes on the way of a word from the root, which is 1."""
    node, out = 1, [1]
    for c in map(ord, word):
        node = (node * factor + c) % _PRIME
        out.append(node)
    return out


def _factors(seed: int) -> tuple[int, int]:
    return tuple(pow(3, 1_000_003 + 2 * seed + back, _PRIME) for back in (0, 1))


def trie_edges(words: DataFrame, seed: int) -> DataFrame:
    """(back, node, parent, letter) for each letter of ``words(word)``; ``back`` is true in the trie of reversed words."""
    factors = _factors(seed)

    def run(batches):
        for batch in batches:
            cols: list[list] = [[], [], [], []]
            for word in batch.column(0).to_pylist():
                for back in (False, True):
                    w = word[::-1] if back else word
                    nodes = _paths(w, factors[back])
                    for col, values in zip(cols, ([back] * len(w), nodes[1:], nodes[:-1], map(ord, w)), strict=True):
                        col.extend(values)
                if len(cols[0]) > _HELD:
                    yield pa.record_batch(cols_of(cols), names=["back", "node", "parent", "letter"])
                    cols = [[], [], [], []]
            yield pa.record_batch(cols_of(cols), names=["back", "node", "parent", "letter"])

    def cols_of(cols):
        return [pa.array(c, t) for c, t in zip(cols, (pa.bool_(), pa.int64(), pa.int64(), pa.int32()), strict=True)]

    return words.select("word").mapInArrow(run, "back boolean, node long, parent long, letter int")


def numbering(words: DataFrame, tries: int = 8) -> int:
    """A seed under which the nodes of both tries have different numbers.

    A node's number follows from its path, so no counter is shared.  That no two nodes have one number is
    checked: a number that is not the root's and always has the same parent and letter names one path only.
    """
    for seed in range(tries):
        nodes = trie_edges(words, seed).groupBy("back", "node").agg(
            F.min("parent").alias("p0"), F.max("parent").alias("p1"), F.min("letter").alias("l0"), F.max("letter").alias("l1")
        )
        if nodes.where("node = 1 OR p0 <> p1 OR l0 <> l1").isEmpty():
            return seed
    raise RuntimeError("no seed numbers the trie nodes")


def node_pairs(words: DataFrame, seed: int) -> DataFrame:
    """(before, behind, takes, first, id, n): the pairs of ``words(id, word, n)``.

    ``takes`` is true where a letter would be taken in, false where one is skipped; ``first`` is false where the skipped
    letter equals the one before, as skipping that one gives the same word.
    """
    ahead, behind = _factors(seed)

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for i, word, n in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                left, right = _paths(word, ahead), _paths(word[::-1], behind)[::-1]
                for at, c in enumerate(word):
                    rows.append((left[at], right[at + 1], False, at == 0 or word[at - 1] != c, i, n))
                    rows.append((left[at], right[at], True, True, i, n))
                rows.append((left[-1], right[-1], True, True, i, n))
                if len(rows) > _HELD:
                    yield batch_of(rows)
                    rows = []
            if rows:
                yield batch_of(rows)

    def batch_of(rows):
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64()]
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["before", "behind", "takes", "first", "id", "n"])

    return words.select("id", "word", "n").mapInArrow(run, "before long, behind long, takes boolean, first boolean, id long, n long")


def _near(one: Column, other: Column) -> Column:
    """Whether two rows of a pair are neighbours that meet here and nowhere else."""
    replaced = ~one["takes"] & ~other["takes"] & (one["id"] != other["id"])
    return replaced | ((one["takes"] != other["takes"]) & one["first"] & other["first"])


def neighbours(pairs: DataFrame) -> DataFrame:
    """(id, n_near, best): per word its neighbours and the struct (n, -id) of the one of largest n, ties to the smallest id.

    Each group of a pair has at most a row per letter and one more; its neighbours are counted there, no list of pairs is made.
    """
    row = F.struct("takes", "first", "id", "n")
    groups = pairs.groupBy("before", "behind").agg(F.collect_list(row).alias("m")).where(F.size("m") > 1)
    one = groups.select("m", F.explode("m").alias("o"))
    near = F.filter("m", lambda x: _near(F.col("o"), x))
    best = F.array_max(F.transform(near, lambda x: F.struct(x["n"].alias("n"), (-x["id"]).alias("id"))))
    at = one.select(F.col("o.id").alias("id"), F.size(near).cast("long").alias("k"), best.alias("b"))
    return at.groupBy("id").agg(F.sum("k").alias("n_near"), F.max("b").alias("best"))


def follow(ws: Workspace, links: DataFrame) -> DataFrame:
    """(id, root) of ``links(id, form)`` by pointer doubling: a form occurs twice as often or more, so ways are short and end."""
    jumps = ws.save(links.select("id", F.col("form").alias("root")), "jumps")
    while True:
        far = jumps.select(F.col("id").alias("_i"), F.col("root").alias("_r"))
        on = jumps.join(far, jumps["root"] == far["_i"], "left")
        before, jumps = jumps, ws.save(on.select("id", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")), "jumps")
        ws.drop(before)
        if jumps.where("moved").isEmpty():
            return jumps.select("id", "root")


def spelling_variants(ws: Workspace, docs: DataFrame, least_length: int = 5, least_count: int = 3, rate: int | None = None) -> DataFrame:
    """Per word its form (the neighbour of largest count, if that is twice its own or more), the root of its forms, and counts.

    Words are compared whole, by code points.  Null and empty texts have no word, tables without words give
    no row; repeated rows of documents count each; a null doc_id is counted but loses no letter to ``rate``; other
    columns are not read.  Very long words take rows and time in proportion to their length.  Ties go to the
    smaller word in code-point order, which is the order of the ids.
    """
    counted = ws.save(count_words(docs, least_length, least_count, rate), "counted")
    words = ws.save(counted.orderBy("word").withColumn("id", F.monotonically_increasing_id()), "words")
    seed = numbering(words)
    near = ws.save(neighbours(node_pairs(words, seed)), "near")
    own = words.join(near, "id", "left")
    form = F.when(F.col("best.n") >= 2 * F.col("n"), F.struct((-F.col("best.id")).alias("id"), F.col("best.n").alias("n")))
    forms = ws.save(own.select("id", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), form.alias("f")), "forms")
    roots = follow(ws, forms.where("f is not null").select("id", F.col("f.id").alias("form")))
    name = lambda c: words.select(F.col("id").alias(f"_{c}"), F.col("word").alias(c))
    out = forms.join(roots, "id", "left").join(name("form"), F.col("f.id") == F.col("_form"), "left").join(name("end"), F.col("root") == F.col("_end"), "left")
    return out.select("word", "form", F.coalesce("end", "word").alias("root"), "n", "n_near", F.col("f.n").alias("form_n"))
