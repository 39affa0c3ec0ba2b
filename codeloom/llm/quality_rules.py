"""Quality rules: a threshold table compiled into one projection of built-in functions.

Every measure is an expression over the whole text; a rule is a row (measure, low, high) and
fails where the measure lies outside. There is no shuffle: the scan, the measures and the
verdict are one stage, and its memory is bounded by one text.

``stop_share`` counts one stop word more than there are, so that a short text isn't failed by chance.

Defined results: a null text is empty; an empty text has all counts 0, ratios 0 and fails the
word floor. Repeated rows are judged one by one. Extra columns are carried by ``judge``, and a
column whose name clashes with a measure gives way to the measure only in ``measured``'s struct.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.text import exploded, let
from codeloom.llm.base import query, table, words


class Rule(NamedTuple):
    measure: str
    low: float | None
    high: float | None


# Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "with", "be", "by", "are", "this",
    "der", "die", "und", "den", "von", "zu", "das", "mit", "des", "auf", "ist", "im", "dem", "nicht", "ein",
    "de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "dans", "qui", "par",
    "el", "los", "se", "del", "las", "por", "con", "una", "su", "para", "lo", "al", "como", "y",
)
SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: The word floor and the repetition limit; a text failing one of these is never kept.
BASE_RULES = (Rule("n_words", 20, None), Rule("repeat_share", None, 0.30))
RULES = (
    Rule("word_chars_mean", 1.5, 14.0),
    Rule("symbols_per_word", None, 0.10),
    Rule("dup_line_share", None, 0.50),
    Rule("stutter_share", None, 0.20),
    Rule("stop_share", 0.02, None),
)


def _repeat_words(hashes: Column) -> Column:
    """Words lying in a window of WINDOW words that the text holds twice or more."""

    def covered(windows: Column) -> Column:
        ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twins = let(
            ordered,
            lambda s: F.transform(
                s,
                lambda x, i: F.when(
                    (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]), x["i"]
                ),
            ),
        )
        places = F.sort_array(F.filter(twins, lambda i: i.isNotNull()))
        start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        step = lambda a, i: F.struct(
            (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")
        )
        return F.aggregate(places, start, step, lambda a: a["n"])

    windows = F.transform(
        F.sequence(F.lit(1), F.size(hashes) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(hashes, i, WINDOW))
    )
    count = let(
        windows,
        lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w)),
    )
    return F.when(F.size(hashes) < WINDOW, F.lit(0)).otherwise(count)


def measured(docs: DataFrame, keep: Sequence[Column | str]) -> DataFrame:
    """``keep`` and the struct ``m`` of all measures of column ``text``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(" \t\n\x0b\x0c\r")) != "")
    found = docs.select(F.struct(*keep).alias("k"), F.col("text"), words(F.col("text")).alias("w"), lines.alias("l"))
    found = found.select("*", F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    stutters = F.filter("h", lambda x, i: F.get("h", i - 1) == x)
    counts = found.select(
        "k",
        F.size("w").cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace(F.coalesce("text", F.lit("")), f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        F.size("l").cast("long").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("w", lambda x: F.lower(x).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.size(stutters).cast("long").alias("n_stutters"),
        _repeat_words(F.col("h")).cast("long").alias("n_repeat_words"),
    )
    share = lambda n, of: F.when(F.col(of) > 0, F.col(n) / F.col(of)).otherwise(F.lit(0.0))
    return counts.select(
        "k.*",
        F.struct(
            *(c for c in counts.columns if c != "k"),
            share("n_repeat_words", "n_words").alias("repeat_share"),
            share("word_chars", "n_words").alias("word_chars_mean"),
            share("n_symbols", "n_words").alias("symbols_per_word"),
            share("n_stutters", "n_words").alias("stutter_share"),
            share("n_dup_lines", "n_lines").alias("dup_line_share"),
            F.when(F.col("n_words") > 0, (F.col("n_stop_words") + 1) / F.col("n_words")).otherwise(F.lit(0.0)).alias("stop_share"),
        ).alias("m"),
    )


def failed_rules(rules: Sequence[Rule], measures: str = "m") -> Column:
    """Names of the measures outside their limits, as one expression compiled from the table."""

    def outside(rule: Rule) -> Column:
        value = F.col(f"{measures}.{rule.measure}")
        low = F.lit(False) if rule.low is None else value < F.lit(rule.low)
        high = F.lit(False) if rule.high is None else value > F.lit(rule.high)
        return low | high

    return F.array_compact(F.array(*(F.when(outside(r), F.lit(r.measure)) for r in rules)))


def judge(docs: DataFrame, rules: Sequence[Rule] = BASE_RULES + RULES, verdict: str = "failed") -> DataFrame:
    """All columns of ``docs`` and the array ``verdict`` of failed measures, empty for a good text.

    The verdict passes through an explode of one element: a filter on it would otherwise be pushed
    below the measures, and each rule in it would compute them anew.
    """
    held = measured(docs, [F.struct("*").alias("row")])
    return exploded(held, ["row"], F.array(failed_rules(rules)), "found").select("row.*", F.col("found").alias(verdict))


def keep_good(docs: DataFrame, rules: Sequence[Rule] = BASE_RULES + RULES) -> DataFrame:
    """The rows of ``docs`` that pass every rule, with their own columns."""
    return judge(docs, rules, "_failed").where(F.size("_failed") == 0).drop("_failed")


_STOP_SQL = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS k
        FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM win) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM dup) GROUP BY rid),
m AS (SELECT w.rid, doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines,
        len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
        len(list_filter(ws, lambda x: lower(x) IN ({_STOP_SQL}))) AS n_stop_words,
        len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS n_stutters
      FROM w LEFT JOIN rep ON rep.rid = w.rid),
j AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars::DOUBLE / n_words BETWEEN 1.5 AND 14.0
  AND n_symbols::DOUBLE / n_words <= 0.10 AND n_dup_lines::DOUBLE / n_lines <= 0.50
  AND n_stutters::DOUBLE / n_words <= 0.20
  AND (n_stop_words + 1)::DOUBLE / n_words >= 0.02 AS kept
FROM j
"""


@query(SQL)
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = measured(table(spark, sf_dir, "documents"), ["doc_id"])
    base = (F.col("m.n_words") < 20) | (100 * F.col("m.n_repeat_words") > 30 * F.col("m.n_words"))
    good = F.size(failed_rules(RULES)) == 0
    return docs.select(
        "doc_id",
        *(F.col(f"m.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        base.alias("base_failed"),
        (~base & good).alias("kept"),
    )
