"""Ignore files: rules re-anchored per folder, last match wins."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.functions import text as tx
from codeloom.sources.file_profile import SKIP_DIRS, in_skipped_dir

IGNORE_FILE = ".gitignore"
EXCLUDE_FILE = ".git/info/exclude"


def glob_regex(pattern: str) -> str:
    """Regular expression of one ignore pattern for a path relative to the repository root."""
    folder_only = pattern.endswith("/")
    body = pattern.strip("/") if folder_only else pattern.lstrip("/")
    anchored = "/" in pattern.rstrip("/")
    pieces = []
    segments = body.split("/")
    for at, segment in enumerate(segments):
        last = at == len(segments) - 1
        if segment == "**":
            pieces.append(".+" if last else "(?:.+/)?")
        else:
            pieces.append(_segment_regex(segment) + ("" if last else "/"))
    lead = "" if anchored else "(?:.+/)?"
    tail = "/.*" if folder_only else ("" if segments[-1] == "**" else "(?:/.*)?")
    return f"^{lead}{''.join(pieces)}{tail}$"


def _segment_regex(segment: str) -> str:
    out, at = [], 0
    while at < len(segment):
        ch = segment[at]
        at += 1
        if ch == "*":
            out.append("[^/]*")
        elif ch == "?":
            out.append("[^/]")
        elif ch == "\\" and at < len(segment):
            out.append(re.escape(segment[at]))
            at += 1
        elif ch == "[" and (close := segment.find("]", at + 1)) > 0:
            members = segment[at:close]
            negated = members[0] in "!^"
            members = members[1:] if negated else members
            out.append("[" + ("^" if negated else "") + members.replace("\\", "\\\\") + "]")
            at = close + 1
        else:
            out.append(re.escape(ch))
    return "".join(out)


def ignore_rules(ignore_files: DataFrame) -> DataFrame:
    """``repo_id, rules`` from the ignore files of each repository.

    Input ``repo_id, file_path, content``. A rule is ``struct<pattern, keep>`` in order of
    precedence: the exclude file, the root file, then nested ones by path. Patterns of a
    nested file hold below its folder. The list of one repository is as long as its ignore
    files, never as long as its file list.
    """
    path = F.col("file_path")
    folder = F.when(
        path.isin(EXCLUDE_FILE, IGNORE_FILE), ""
    ).otherwise(F.regexp_replace(path, r"/[^/]*$", ""))
    precedence = F.when(path == EXCLUDE_FILE, 0).when(path == IGNORE_FILE, 1).otherwise(2)
    nested = ~path.isin(EXCLUDE_FILE, IGNORE_FILE)
    usable = ~nested | ~(in_skipped_dir(folder, SKIP_DIRS) | folder.rlike(r"(^|/)\."))
    lines = ignore_files.where(
        usable & ((path == EXCLUDE_FILE) | (tx.base_name(path) == IGNORE_FILE))
    ).select(
        "repo_id", folder.alias("folder"), precedence.alias("precedence"),
        F.posexplode(tx.split_lines(F.col("content"))).alias("at", "raw"),
    )
    line = F.trim("raw")
    keep = line.startswith("!")
    bare = F.when(keep, F.substring(line, F.lit(2), F.length(line))).otherwise(line)
    rooted = F.when(bare.startswith("/"), F.substring(bare, F.lit(2), F.length(bare)))
    below = (
        F.when(rooted.isNotNull(), F.concat("folder", F.lit("/"), rooted))
        .when(F.regexp_replace(bare, "/+$", "").contains("/"), F.concat("folder", F.lit("/"), bare))
        .otherwise(F.concat("folder", F.lit("/**/"), bare))
    )
    pattern = F.when(F.col("folder") == "", bare).otherwise(below)
    rules = lines.where((line != "") & ~line.startswith("#")).select(
        "repo_id",
        F.struct("precedence", "folder", "at", pattern.alias("pattern"), keep.alias("keep")).alias("r"),
    )
    ordered = F.array_sort(F.collect_list("r"))
    return rules.groupBy("repo_id").agg(
        F.transform(ordered, lambda r: F.struct(r["pattern"].alias("pattern"), r["keep"].alias("keep"))).alias("rules")
    )


@F.pandas_udf(T.BooleanType())
def path_ignored(paths: pd.Series, rules: pd.Series) -> pd.Series:
    """Last rule that matches decides; a path without a matching rule is not ignored."""
    compiled: dict[str, re.Pattern] = {}

    def ignored(path, listed) -> bool:
        for rule in reversed(() if listed is None else list(listed)):
            pattern = rule["pattern"]
            if pattern not in compiled:
                compiled[pattern] = re.compile(glob_regex(pattern))
            if compiled[pattern].match(path):
                return not rule["keep"]
        return False

    return pd.Series([ignored(p, r) for p, r in zip(paths, rules)], dtype="bool")


def drop_ignored(listing: DataFrame, rules: DataFrame) -> DataFrame:
    """Listing without ignored paths; one row of rules per repository meets its files."""
    joined = listing.join(rules, "repo_id", "left")
    return joined.where(~path_ignored(F.col("file_path"), F.col("rules"))).drop("rules")
