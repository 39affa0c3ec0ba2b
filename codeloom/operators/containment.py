"""Which of many needles occur in which of many texts, in one reading of each text."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of needles that one automaton holds; more needles are dealt over several.
SHARD_CHARS = 1_000_000


def _search(needles: list[str], text_col: str, needle_col: str, keep: list[str], prefix_only: bool):
    """Arrow batches to the kept columns and a needle, a row for each distinct needle of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for needle in needles:
            automaton.add_word(needle, needle)
        automaton.make_automaton()
        longest = max(map(len, needles))

        def found(text: str) -> set[str]:
            if prefix_only:
                return {n for end, n in automaton.iter(text[:longest]) if end + 1 == len(n)}
            return {n for _, n in automaton.iter(text)}

        for batch in batches:
            rows, hits = [], []
            for row, text in enumerate(batch.column(text_col)):
                of_row = found(text.as_py() or "")
                rows.extend([row] * len(of_row))
                hits.extend(of_row)
            at = pa.array(rows, pa.int64())
            kept = [batch.column(c).take(at) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(hits, pa.string())], [*keep, needle_col])

    return run


def containing(
    rows: DataFrame, text_col: str, needles: DataFrame, needle_col: str, prefix_only: bool = False
) -> DataFrame:
    """``rows`` without ``text_col``, once for each needle that the text contains (or starts with).

    An automaton of all needles runs over each text once, whatever their number and lengths,
    and the text goes no further. The driver deals the distinct needles into automata of at most
    ``SHARD_CHARS`` characters, one after the other; each is one more reading of the texts. Empty
    needles are not matched; they would match everything.
    """
    keep = [c for c in rows.columns if c != text_col]
    fields = [f for f in rows.schema.fields if f.name != text_col]
    layout = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"`{needle_col}` string"])
    wanted = needles.select(F.col(needle_col).cast("string").alias("n")).where(F.length("n") > 0).distinct()
    shards, size = [[]], 0
    for row in wanted.toLocalIterator():
        if shards[-1] and size + len(row.n) > SHARD_CHARS:
            shards.append([])
            size = 0
        shards[-1].append(row.n)
        size += len(row.n)
    if not shards[-1]:
        return rows.select(*keep, F.lit(None).cast("string").alias(needle_col)).where(F.lit(False))
    out = None
    for shard in shards:
        part = rows.mapInArrow(_search(shard, text_col, needle_col, keep, prefix_only), layout)
        out = part if out is None else out.unionByName(part)
    return out


def contains_join(
    texts: DataFrame, needles: DataFrame, text_col: str, needle_col: str, prefix_only: bool = False
) -> DataFrame:
    """Distinct pairs ``text_col, needle_col`` where the text contains (or starts with) the needle."""
    pairs = texts.select(text_col).distinct().withColumn("_text", F.col(text_col))
    return containing(pairs, "_text", needles, needle_col, prefix_only)
