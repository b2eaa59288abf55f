"""Many patterns over long texts in one pass: an automaton for their literal parts.

Of a list of regular expressions, alternatives of plain text are settled by the automaton alone;
the others have a literal that must occur wherever they match, and only rows that hold it are
given to the expression itself.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_META = set(".^$*+?{}[]()|\\")
#: A literal shorter than this does not rule out enough rows to be looked for.
LEAST = 3


def alternatives(pattern: str) -> list[str]:
    """The alternatives of a pattern, split at bars outside of groups and classes."""
    out, depth, in_class, i = [""], 0, False, 0
    while i < len(pattern):
        c = pattern[i : i + 2] if pattern[i] == "\\" else pattern[i]
        if c == "|" and not depth and not in_class:
            out.append("")
        else:
            out[-1] += c
            in_class = c != "]" and (in_class or c == "[")
            depth += 0 if in_class else (c in "({") - (c in ")}")
        i += len(c)
    return out


def plain_text(pattern: str) -> str | None:
    """The text that a pattern without operators stands for, else None."""
    runs = literal_runs(pattern)
    return runs[0] if len(runs) == 1 and runs[0] is not None else None


def literal_runs(pattern: str) -> list[str | None]:
    """The pattern as runs of plain characters that must occur, with None for whatever else stands between them."""
    out: list[str | None] = [""]
    i, depth, in_class = 0, 0, False
    while i < len(pattern):
        c = pattern[i : i + 2] if pattern[i] == "\\" else pattern[i]
        i += len(c)
        plain = c[1] if len(c) == 2 and not c[1].isalnum() else c if c not in _META and len(c) == 1 else None
        if depth or in_class:
            plain = None
        if pattern[i : i + 1] in ("?", "*", "{"):  # what comes before may be missing
            plain = None
        if plain is None:
            if out[-1] is not None:
                out.append(None)
            in_class = c != "]" and (in_class or c == "[")
            depth += 0 if in_class else (c in "({") - (c in ")}")
        elif out[-1] is None:
            out.append(plain)
        else:
            out[-1] += plain
    return [x for x in out if x != ""] or [""]


def _folded(text: str) -> str:
    return text.encode().lower().decode()  # A-Z only, as in expressions that ignore case


class LiteralIndex:
    """Numbers for the literals of patterns, and the conditions on a row in terms of those found in it."""

    def __init__(self) -> None:
        self.numbers: dict[str, int] = {}

    def number(self, text: str) -> int:
        return self.numbers.setdefault(_folded(text), len(self.numbers))

    def condition(self, pattern: str, found: Column, text: Column) -> Column:
        """Whether ``pattern`` matches ``text`` whatever the case; ``found`` are the literals that :meth:`found_in` gives."""
        sure, checked = [], []
        for one in alternatives(pattern):
            plain = plain_text(one)
            if plain and len(plain) >= LEAST:
                sure.append(self.number(plain))
                continue
            needed = max((x for x in literal_runs(one) if x), key=len, default="")
            checked.append(F.array_contains(found, self.number(needed)) & text.rlike(f"(?i){one}") if len(needed) >= LEAST else text.rlike(f"(?i){one}"))
        out = F.arrays_overlap(found, F.array(*map(F.lit, sure))) if sure else F.lit(False)
        for c in checked:
            out = out | c
        return out

    def found_in(self, text: Column) -> Column:
        """The numbers of the literals that occur in ``text``, read once; to be called when all conditions are made."""
        words = list(self.numbers.items())
        made: list = []

        @F.arrow_udf("array<int>")
        def search(texts: pa.Array) -> pa.Array:
            if not made:
                tree = ahocorasick.Automaton()
                for word, i in words:
                    tree.add_word(word, i)
                tree.make_automaton()
                made.append(tree)
            return pa.array([None if t is None else list({i for _, i in made[0].iter(_folded(t))}) for t in texts.to_pylist()], pa.list_(pa.int32()))

        return search(text)
