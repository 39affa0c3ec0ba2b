"""Service edges kept current: facts of what changed meet all names, all facts meet changed names.

An edge between services depends on the facts of its source and on two sets of names: the services,
and the folders and files that RPC calls name. When some repositories change, their own edges change,
and so may those of any repository whose facts name something that came or went. Only these are
linked anew, from stored facts; no text is read for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import text as tx
from codeloom.operators import services as ops


def differing(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of one side only."""
    return before.exceptAll(after).unionByName(after.exceptAll(before)).distinct()


def changed_names(before: DataFrame, after: DataFrame) -> DataFrame:
    """``name`` of folders and files that a repository gained or lost; inputs ``repo_id, file_path``."""
    return differing(ops.path_names(before), ops.path_names(after)).select("name").distinct()


def affected_repos(
    changed: DataFrame, facts: DataFrame, services: DataFrame, names: DataFrame
) -> DataFrame:
    """``repo_id`` of the changed repositories and of those whose facts name what changed.

    ``changed`` has ``repo_id``, ``facts`` are those of all repositories, ``services`` the
    services that came or went, ``names`` the changed names of ``changed_names``.
    """
    called = tx.exploded(facts, ["repo_id"], F.col("rpc_names"), "name").join(names, "name", "left_semi")
    reads = tx.exploded(facts, ops.FILE_KEY, F.col("variables"), "variable")
    variables = ops.env_targets(reads, services).where(F.col("target_id") != ops.UNRESOLVED)
    out = changed.select("repo_id").unionByName(called.select("repo_id")).unionByName(variables.select("repo_id"))
    for edges in (ops.url_edges, ops.manifest_edges, ops.import_edges):
        out = out.unionByName(edges(facts, services).select(F.col("source_id").alias("repo_id")))
    return out.distinct()
