"""The release vocabulary (S7) as one matcher: release words, media sources and release groups.

Words and patterns become one alternation, built when a query is planned.
Literal groups become a membership test, which is a hash lookup where it runs;
patterns of groups are merged. A vocabulary is handed to every function of
names that needs one; without one the built-in words and media sources count,
and no group is known.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .constants import MEDIA_SOURCES, RELEASE_WORDS

#: Entries that a vocabulary, written by hand, may have.
MOST = 50_000
#: Patterns that one expression joins.
PATTERNS = 200
_SIZE = r"[0-9]{3,4}x[0-9]{3,4}"


def literal(phrase: str) -> str:
    """An expression that matches ``phrase`` as it stands."""
    return "".join(c if c.isalnum() or c == "-" else f"\\{c}" for c in phrase)


def any_of(phrases) -> str:
    """An expression for any of the phrases, longer ones first."""
    return "|".join(sorted(map(literal, phrases), key=lambda p: (-len(p), p)))


@dataclass(frozen=True)
class Vocabulary:
    """Media sources (expressions, beside the release words), groups in lower case, and groups by expression."""

    sources: tuple[str, ...] = tuple(MEDIA_SOURCES.values())
    groups: frozenset[str] = frozenset()
    patterns: tuple[str, ...] = ()

    @property
    def words(self) -> str:
        """Release words, sizes and media sources, in this order, without borders."""
        return "|".join([any_of(RELEASE_WORDS), _SIZE, *(f"(?:{s})" for s in self.sources)])

    @property
    def word(self) -> str:
        """A release word as an expression."""
        return rf"(?i)\b(?:{self.words})\b"

    def is_group(self, word: Column) -> Column:
        """Whether a word is a release group; never null."""
        known = F.lit(False)
        if self.groups:
            known = known | F.lower(word).isin(*sorted(self.groups))
        for at in range(0, len(self.patterns), PATTERNS):
            known = known | word.rlike("^(?:" + "|".join(f"(?:{p})" for p in self.patterns[at : at + PATTERNS]) + ")$")
        return F.coalesce((word != "") & known, F.lit(False))


DEFAULT = Vocabulary()


def _sound(patterns: list[str]) -> tuple[str, ...]:
    """The patterns that compile, in their order. A look-behind of changing width counts as sound, as it is in Spark."""
    out = []
    for p in patterns:
        try:
            re.compile(re.sub(r"\(\?<[=!][^()]*\)", "", p))
            out.append(p)
        except re.error:
            continue
    return tuple(out)


def compiled(sources: DataFrame | None = None, groups: DataFrame | None = None) -> Vocabulary:
    """The matcher of ``sources`` (label, pattern) and ``groups`` (name, is_pattern), tables of at most MOST rows.

    Without ``sources`` the built-in ones count. Patterns that do not compile are left out.
    """

    def listed(df: DataFrame, column: str) -> list[str]:
        rows = df.select(column).where(F.col(column).isNotNull() & (F.trim(column) != "")).limit(MOST + 1).collect()
        if len(rows) > MOST:
            raise ValueError(f"a vocabulary has at most {MOST} entries")
        return list(dict.fromkeys(r[0] for r in rows))

    kinds = {}
    if sources is not None:
        kinds["sources"] = _sound(listed(sources, "pattern"))
    if groups is not None:
        kinds["groups"] = frozenset(n.lower() for n in listed(groups.where(~F.col("is_pattern")), "name"))
        kinds["patterns"] = _sound(sorted(listed(groups.where("is_pattern"), "name")))
    return Vocabulary(**kinds)
