"""Word signs and first-match ladders stated as data and evaluated by one fold."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ontoweave.functions.text import any_of


@dataclass(frozen=True)
class Sign:
    """Present where one of ``words`` and all of ``also`` occur, ``pattern`` matches, and none of ``unless`` is present."""

    words: Sequence[str] = ()
    also: Sequence[str] = ()
    pattern: str = ""
    unless: Sequence[Sign] = ()

    def column(self, text: Column) -> Column:
        tests = [any_of(text, list(self.words))] if self.words else []
        tests += [text.contains(w) for w in self.also]
        tests += [text.rlike(self.pattern)] if self.pattern else []
        tests += [~s.column(text) for s in self.unless]
        return reduce(lambda a, b: a & b, tests, F.lit(True))


def any_sign(text: Column, signs: Sequence[Sign]) -> Column:
    return reduce(lambda a, b: a | b, [s.column(text) for s in signs], F.lit(False))


def first_match(rows: Sequence[tuple[str, str]], default: str) -> Column:
    """Value of the first row whose condition (an SQL predicate over the columns) holds."""
    return reduce(lambda rest, row: F.when(F.expr(row[1]), row[0]).otherwise(rest), reversed(rows), F.lit(default))
