"""Reply trees as conversations: root-to-leaf paths by iterative self-joins, ranked and formatted.

``paths`` finds every path without walking the tree level by level. Each round joins the table
of jumps with itself and so doubles their length: after k rounds a node knows its ancestor 2**k
above. Then the paths grow from the leaves the other way, longest jumps first; each ancestor is
reached exactly once, because a distance has one sum of powers of two. A tree of depth d needs
2 log d joins, rows stay one per node and path, and no array of a path exists before formatting.

The template writes ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn. Inside a text a backslash is
doubled and every control string gets a backslash behind its first character, so no control
string of any listed template survives, and dropping one backslash of each pair restores the
text. Roles are percent-encoded. Loss spans are code point ranges of assistant texts.

Defined results: a null text is empty, a null role is an empty role, a null tree id is a tree of
its own; a parent that does not exist makes its node a root; nodes that lead into a cycle have
no path; repeated turns are all kept, ties in ``turn`` are ordered by role and text; an empty
table gives no rows. Other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.llm.base import Scratch, query, table

START, END = "<|im_start|>", "<|im_end|>"
# Control strings of common chat templates, none of which may occur in a text.
CONTROLS = (
    START, END, "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>",
    "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
)
LOSS_ROLE = "assistant"
_MOST_ROUNDS = 40


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in CONTROLS:
        out = F.replace(out, F.lit(control), F.lit(f"{control[0]}\\{control[1:]}"))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def linear_trees(turns: DataFrame) -> DataFrame:
    """Conversations of numbered turns as trees in which each turn replies to the one before."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return turns.select(
        F.col("conv_id").alias("tree_id"), "role", "text", F.row_number().over(order).cast("long").alias("node_id")
    ).select("*", F.when(F.col("node_id") > 1, F.col("node_id") - 1).alias("parent_id"), F.lit(0.0).alias("score"))


def _same_tree(left: str, right: str) -> Column:
    return F.col(f"{left}.tree_id").eqNullSafe(F.col(f"{right}.tree_id"))


def paths(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(tree_id, leaf_id, node_id, above): every node of every root-to-leaf path."""
    ids = nodes.select("tree_id", "node_id")
    up = (
        nodes.alias("n")
        .join(ids.alias("p"), _same_tree("n", "p") & (F.col("n.parent_id") == F.col("p.node_id")))
        .select("n.tree_id", "n.node_id", F.col("p.node_id").alias("up"))
    )
    jumps = [scratch.settle("jump-0", up)]
    while len(jumps) < _MOST_ROUNDS:
        last = jumps[-1]
        twice = (
            last.alias("a")
            .join(last.alias("b"), _same_tree("a", "b") & (F.col("a.up") == F.col("b.node_id")))
            .select("a.tree_id", "a.node_id", "b.up")
        )
        jumps.append(scratch.settle(f"jump-{len(jumps)}", twice))
        if jumps[-1].isEmpty() or 2 ** (len(jumps) - 1) > 2 * ids.count():
            break
    endless = jumps.pop()
    parents = jumps[0].select("tree_id", F.col("up").alias("node_id"))
    leaves = ids.alias("n")
    for other in (parents, endless):
        leaves = leaves.join(
            other.alias("o"), _same_tree("n", "o") & (F.col("n.node_id") == F.col("o.node_id")), "left_anti"
        ).alias("n")
    found = leaves.select("tree_id", F.col("node_id").alias("leaf_id"), "node_id", F.lit(0).cast("long").alias("above"))
    for k in reversed(range(len(jumps))):
        higher = (
            found.alias("f")
            .join(jumps[k].alias("j"), _same_tree("f", "j") & (F.col("f.node_id") == F.col("j.node_id")))
            .select("f.tree_id", "f.leaf_id", F.col("j.up").alias("node_id"), (F.col("f.above") + 2**k).alias("above"))
        )
        found = scratch.settle(f"paths-{k}", found.unionByName(higher))
    return found


def conversations(nodes: DataFrame, branches: int | None = None) -> DataFrame:
    """(tree_id, leaf_id, branch, formatted, loss) of ``nodes`` (tree_id, node_id, parent_id, role, text, score).

    ``branch`` ranks the paths of a tree by the sum of their scores; ``branches`` keeps the best.
    ``loss`` lists the (start, end) spans of assistant texts in ``formatted``.
    """
    scratch = Scratch(nodes.sparkSession, "reply-trees")
    nodes = scratch.settle("nodes", nodes.select("tree_id", "node_id", "parent_id", "role", "text", "score"))
    body = escape(F.coalesce(F.col("n.text"), F.lit("")))
    role = F.coalesce(F.col("n.role"), F.lit(""))
    steps = (
        paths(nodes, scratch)
        .alias("p")
        .join(nodes.alias("n"), _same_tree("p", "n") & (F.col("p.node_id") == F.col("n.node_id")))
        .select(
            "p.tree_id", "p.leaf_id", "p.above", F.coalesce("n.score", F.lit(0.0)).alias("score"),
            F.concat(F.lit(START), F.url_encode(role), F.lit("\n")).alias("head"), body.alias("body"),
            (role == LOSS_ROLE).alias("learned"),
        )
    )
    path = Window.partitionBy("tree_id", "leaf_id").orderBy(F.desc("above")).rowsBetween(Window.unboundedPreceding, -1)
    width = F.char_length("head") + F.char_length("body") + F.lit(len(END) + 1)
    begin = F.coalesce(F.sum(width).over(path), F.lit(0)) + F.char_length("head")
    placed = steps.select("*", begin.alias("begin"))
    turn = F.struct(
        (-F.col("above")).alias("place"),
        F.concat("head", "body", F.lit(END + "\n")).alias("written"),
        F.when(F.col("learned"), F.struct(F.col("begin").alias("start"), (F.col("begin") + F.char_length("body")).alias("end"))).alias("span"),
    )
    joined = placed.groupBy("tree_id", "leaf_id").agg(
        F.sum("score").alias("score"), F.sort_array(F.collect_list(turn)).alias("turns")
    )
    by_score = Window.partitionBy("tree_id").orderBy(F.desc("score"), "leaf_id")
    ranked = joined.withColumn("branch", F.row_number().over(by_score))
    if branches is not None:
        ranked = ranked.where(F.col("branch") <= branches)
    return ranked.select(
        "tree_id", "leaf_id", "branch",
        F.array_join(F.transform("turns", lambda t: t["written"]), "").alias("formatted"),
        F.array_compact(F.transform("turns", lambda t: t["span"])).alias("loss"),
    )


def read_back(formatted: Column) -> Column:
    """The (role, text) turns of a formatted conversation."""
    cut = F.split(formatted, r"<\|im_end\|>\n", -1)
    pieces = F.slice(cut, 1, F.size(cut) - 1)
    bare = F.transform(pieces, lambda p: F.substring(p, len(START) + 1, 2**31 - 1))
    return F.transform(
        bare,
        lambda p: F.struct(
            F.url_decode(F.substring_index(p, "\n", 1)).alias("role"),
            unescape(F.substring(p, F.locate("\n", p) + 1, F.char_length(p))).alias("text"),
        ),
    )


def _sql_escape(text: str) -> str:
    out = f"replace({text}, chr(92), chr(92) || chr(92))"
    for control in CONTROLS:
        out = f"replace({out}, '{control}', '{control[0]}' || chr(92) || '{control[1:]}')"
    return out


SQL = f"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i,
  coalesce(role, '') AS role, coalesce(text, '') AS text FROM c),
g AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(string_agg(text, '' ORDER BY i) FILTER (role = '{LOSS_ROLE}'), '') AS loss,
  sum({len(START) + len(END) + 2} + length(url_encode(role)) + length({_sql_escape('text')}))::BIGINT AS formatted_chars
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""


@query(SQL)
def op9_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(LOSS_ROLE).alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    turns = table(spark, sf_dir, "conversations").select(*own.columns).unionByName(own)
    chats = conversations(linear_trees(turns)).where(F.col("branch") == 1)
    spoken = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    told = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return (
        chats.select("*", read_back(F.col("formatted")).alias("turns"), F.array_join(spoken, "").alias("spoken"))
        .select(
            F.col("tree_id").alias("conv_id"),
            F.size("turns").cast("long").alias("n_turns"),
            F.sha2(F.array_join(told, ""), 256).alias("turns_sha256"),
            F.char_length("spoken").cast("long").alias("loss_chars"),
            F.sha2("spoken", 256).alias("loss_sha256"),
            F.char_length("formatted").cast("long").alias("formatted_chars"),
        )
    )
