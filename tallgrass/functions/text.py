r"""Tokens of searchable columns, as JVM-side column expressions.

``words`` splits on white space, and besides on the separators below and the space;
a text's tokens are those of either split, trimmed.  ``spaces`` splits on white space.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The separators of word search.
SEPARATORS = "~#@$^&*=,.!?:;-\"'`()[]<>{}/·–\\|↑•%°„_ "


def character_class(characters: str = SEPARATORS) -> str:
    return "[" + "".join(re.escape(c) if c.isascii() and c != " " else c for c in characters) + "]"


def tokens(column: Column, kind: str) -> Column:
    """Distinct tokens; null stays null."""
    low = F.lower(column)
    parts = F.split(low, r"\s+")
    if kind == "words":
        fine = F.transform(F.split(low, character_class()), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
        parts = F.array_distinct(F.concat(parts, fine))
    return F.filter(parts, lambda x: x != "")


def query_words(query: str) -> list[str]:
    return query.lower().split()


def _holding(column: Column, part: str) -> Column:
    """The text where it holds ``part``, else null.

    Every token is part of the text, and the scan is cheaper than the split.  Splitting
    this column, not the text, keeps Spark from sharing one split of every text
    between several searches.
    """
    return F.when(F.contains(F.lower(column), F.lit(part)), column)


def has_word(column: Column, kind: str, word: str) -> Column:
    return F.coalesce(F.array_contains(tokens(_holding(column, word), kind), word), F.lit(False))


def has_prefix(column: Column, kind: str, prefix: str) -> Column:
    return F.coalesce(F.exists(tokens(_holding(column, prefix), kind), lambda t: t.startswith(F.lit(prefix))), F.lit(False))
