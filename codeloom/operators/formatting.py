"""Result blocks as text under a byte budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import text as tx

MAX_OUTPUT_BYTES = 80_000
MAX_LINE_CHARS = 1000
CUT_MARK = " [truncated — use Read tool for full content]"


def block_header(path: Column, first: Column, last: Column) -> Column:
    return F.concat(path, F.lit("#L"), first.cast("string"), F.lit("-"), last.cast("string"))


def numbered(lines: Column, first: Column, max_chars: int = MAX_LINE_CHARS) -> Column:
    """Lines as ``n: text`` joined by newlines, over-long ones cut."""
    return F.array_join(
        F.transform(
            lines,
            lambda line, i: F.concat(
                (first + i).cast("string"),
                F.lit(": "),
                F.when(
                    F.length(line) > max_chars,
                    F.concat(F.substring(line, 1, max_chars), F.lit(CUT_MARK)),
                ).otherwise(line),
            ),
        ),
        "\n",
    )


def render_blocks(
    ranked: DataFrame, max_bytes: int = MAX_OUTPUT_BYTES, max_chars: int = MAX_LINE_CHARS
) -> DataFrame:
    """``rank, header, block, bytes, total_bytes, shown`` for a top-k result.

    ``ranked`` has ``rank, path, start_line, end_line, content`` and at most top-k rows, which
    is what makes the one ordered window over all of them safe. Blocks are shown up to the
    first that overflows the budget; a block after that is not shown even if it would fit.
    """
    header = block_header(F.col("path"), F.col("start_line"), F.col("end_line"))
    body = numbered(tx.split_lines(F.col("content")), F.col("start_line"), max_chars)
    rows = ranked.select("rank", header.alias("header"), F.concat(header, F.lit("\n"), body).alias("block"))
    so_far = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    sized = rows.withColumn("bytes", F.octet_length("block")).withColumn(
        "total_bytes", F.sum("bytes").over(so_far) + 2 * (F.row_number().over(Window.orderBy("rank")) - 1)
    )
    return sized.withColumn("shown", F.max("total_bytes").over(so_far) <= max_bytes)


def format_results(rendered: DataFrame) -> DataFrame:
    """One row ``output``: the shown blocks, then a note with the headers of the others.

    The only step that gathers text into one value; its input is a top-k result.
    """
    def gather(value: str, wanted: Column) -> Column:
        rows = F.array_sort(F.collect_list(F.when(wanted, F.struct("rank", value))))
        return F.transform(rows, lambda row: row[value])

    gathered = rendered.agg(
        gather("block", F.col("shown")).alias("blocks"),
        gather("header", ~F.col("shown")).alias("hidden"),
    )
    count = F.size("blocks")
    note = F.concat(
        F.lit("\n\n[Showing "), count.cast("string"), F.lit("/"),
        (count + F.size("hidden")).cast("string"),
        F.lit(" results. Remaining (use Read tool):\n"), F.array_join("hidden", "\n"), F.lit("]"),
    )
    text = F.array_join("blocks", "\n\n")
    return gathered.select(
        F.when(F.size("hidden") > 0, F.concat(text, note)).otherwise(text).alias("output")
    )
