"""Keyword extraction from query text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom.functions.text import let

# Words that never count as keywords.
STOP_WORDS = (
    "the a an and or but in on at to for of with by from up about into through during "
    "is are was were be been being have has had do does did will would could should may might "
    "must shall can how what when where which who that this these those it its get set use "
    "new return class function method var let const def import as if else while for try "
    "except raise pass break continue not"
).split()

KEYWORD_LIMIT = 20


def keywords(text: Column, limit: int = KEYWORD_LIMIT) -> Column:
    """First ``limit`` distinct identifiers, case-insensitive, in order of appearance.

    ``array_distinct`` keeps first occurrences and hashes, so the cost stays linear in the
    text; stop words are dropped from the distinct words, and only the few survivors are
    looked up again for their original spelling.
    """
    words = F.regexp_extract_all(text, F.lit(r"[a-zA-Z][a-zA-Z0-9_]*"), F.lit(0))
    both = F.struct(words.alias("words"), F.transform(words, F.lower).alias("lowered"))

    def first_spellings(found: Column) -> Column:
        counted = F.filter(
            F.array_distinct(found["lowered"]),
            lambda w: (F.length(w) > 2) & ~w.isin(list(dict.fromkeys(STOP_WORDS))),
        )
        return F.transform(
            F.slice(counted, 1, limit),
            lambda w: F.element_at(found["words"], F.array_position(found["lowered"], w).cast("int")),
        )

    return let(both, first_spellings)
