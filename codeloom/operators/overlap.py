"""Join of line ranges that overlap within one file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_range: tuple[str, str] = ("start_line", "end_line"),
    right_range: tuple[str, str] = ("line_start", "line_end"),
    bin_lines: int = 64,
) -> DataFrame:
    """Pairs with equal ``keys`` whose inclusive ranges overlap.

    Both sides are spread over bins of ``bin_lines`` lines and joined on ``(keys, bin)``, so
    a long file is compared bin by bin instead of every range with every other. A pair that
    shares several bins is emitted only in the first common one: no distinct is needed.
    """
    (ls, le), (rs, re_) = left_range, right_range

    def binned(rows: DataFrame, start: str, end: str, name: str) -> DataFrame:
        first = F.floor(F.col(start) / bin_lines).cast("int")
        last = F.floor(F.col(end) / bin_lines).cast("int")
        bins = F.sequence(first, F.greatest(first, last))
        return rows.select("*", first.alias(name), F.explode(bins).alias("_bin"))

    a = binned(left, ls, le, "_first_l")
    b = binned(right, rs, re_, "_first_r")
    pairs = a.join(b, [*keys, "_bin"], "inner").where(
        (F.col(re_) >= F.col(ls))
        & (F.col(rs) <= F.col(le))
        & (F.col("_bin") == F.greatest("_first_l", "_first_r"))
    )
    return pairs.drop("_bin", "_first_l", "_first_r")
