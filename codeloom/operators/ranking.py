"""Let a language model order the blocks of a result.

The result is a top-k list, so its prompt and the answer are small driver-side texts. Any
callable ``(system, user) -> answer`` can serve as the model.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import text as tx

Ask = Callable[[str, str], str]

# What the model is told. The tag is the one that parse_indices reads.
TAG = "ranked_indices"
RANK_SYSTEM = f"""You are a ranker of source code excerpts.

Each excerpt below has a number in square brackets. A line of facts tells its retrieval score and,
where the call graph has them, how many callers and callees it has and which flow it is part of.

How to judge:
- keep what helps to answer the question, leave out the rest;
- trust running code more than prose about it;
- take a high score, many callers or a flow as signs of weight, not as proof.

Answer with the numbers you keep, best first, as a JSON list inside <{TAG}></{TAG}>."""
RANK_CLOSING = f"Which excerpts answer the question? Reply with <{TAG}>[...]</{TAG}> only."
EXPAND_SYSTEM = """You rephrase questions about a code base for a semantic search.

Say in plain words what the code in question would do: its steps, its conditions, the data it changes.
Name no product or framework. Put every rephrasing on a line of its own, without bullets."""
EXPANSIONS = 3


@dataclass
class Ranking:
    """Chosen positions (0-based, best first) and how they came about."""

    order: list[int]
    system_prompt: str = ""
    user_prompt: str = ""
    answer: str | None = None
    seconds: float = 0.0
    fallback: bool = False
    notes: dict = field(default_factory=dict)


def prompt_entries(blocks: DataFrame) -> DataFrame:
    """``rank, entry``: one prompt paragraph per block; long texts lose their middle.

    ``blocks`` has ``rank`` (1-based), the block columns and optionally ``callers, callees,
    flow`` where the graph knows them.
    """
    number = (F.col("rank") - 1).cast("string")
    facts = [F.format_string("score %.2f", F.col("score"))]
    if "callers" in blocks.columns:
        for name in ("callers", "callees"):
            facts.append(F.concat(F.lit(f"{name} "), F.col(name).cast("string")))
        facts.append(F.when(F.col("callers").isNotNull() & (F.col("flow") != ""), F.concat(F.lit("flow "), "flow")))
    lines = F.concat_ws("-", F.col("start_line").cast("string"), F.col("end_line").cast("string"))
    head = F.concat_ws(" ", F.concat(F.lit("["), number, F.lit("]")), F.concat_ws(":", "file_path", lines), "chunk_type", "symbol")
    body = tx.elide_middle(F.col("content"), 100)
    entry: Column = F.concat_ws("\n", F.rtrim(head), F.concat_ws(", ", *facts), body, F.lit(""))
    return blocks.select("rank", entry.alias("entry"))


def parse_indices(answer: str, count: int) -> list[int]:
    """Valid, distinct positions in an answer; empty when it holds none."""
    body = answer.partition(f"<{TAG}>")[2].partition(f"</{TAG}>")[0] or answer
    first, last = body.find("["), body.rfind("]")
    if first < 0 or body[:first].strip().strip("`") not in ("", "json"):
        return []
    try:
        values = json.loads(body[first : last + 1])
    except ValueError:
        return []
    if not isinstance(values, list):
        return []
    return list(dict.fromkeys(int(v) for v in values if isinstance(v, int) and 0 <= v < count))


def rank_entries(query: str, entries: list[str], ask: Ask | None) -> Ranking:
    """Ask the model for an order; without a model or a usable answer the order stays."""
    unchanged = list(range(len(entries)))
    if not entries or ask is None:
        return Ranking(unchanged)
    prompt = "\n".join([f"Question: {query}", "", *entries, RANK_CLOSING])
    began = time.perf_counter()
    answer, order = None, []
    try:
        answer = ask(RANK_SYSTEM, prompt)
        order = parse_indices(answer, len(entries))
    except Exception as error:  # the search must answer even when the model does not
        return Ranking(
            unchanged, RANK_SYSTEM, prompt, answer, time.perf_counter() - began, True,
            {"error": repr(error)},
        )
    return Ranking(
        order or unchanged, RANK_SYSTEM, prompt, answer, time.perf_counter() - began, not order
    )


def reorder(blocks: DataFrame, order: list[int]) -> DataFrame:
    """Blocks at the chosen positions, ranked in the chosen order."""
    places = F.array(*[F.lit(i) for i in order]) if order else F.array().cast("array<int>")
    position = F.array_position(places, (F.col("rank") - 1).cast("int")).cast("int")
    return blocks.withColumn("_new", position).where(F.col("_new") > 0).withColumn(
        "rank", F.col("_new")
    ).drop("_new")


def expand_query(query: str, ask: Ask | None, most: int = EXPANSIONS) -> list[str]:
    """At most ``most`` search texts from the model, or the query itself."""
    if ask is None:
        return [query]
    try:
        answer = ask(EXPAND_SYSTEM, f"Give {most} rephrasings of: {query}")
    except Exception:
        return [query]
    return [line.strip() for line in answer.splitlines() if line.strip()][:most] or [query]
