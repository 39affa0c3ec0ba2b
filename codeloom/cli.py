"""Command line: ``index build``, ``query search`` and ``query debug``; and the agent tool."""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Callable, Sequence

from pyspark.sql import SparkSession

from codeloom.operators.encoding import EmbeddingModel, HashModel
from codeloom.operators.ranking import Ask
from codeloom.plans.index_build import build, seed_from_sibling
from codeloom.plans.retrieval import retrieve, retrieve_debug
from codeloom.session import build_session
from codeloom.settings import PREFIX, Repo, Settings, index_location, settings_from_env
from codeloom.sources.workspace import git_branch

ModelFactory = Callable[[Settings], EmbeddingModel]


def hash_model(settings: Settings) -> EmbeddingModel:
    """The model that needs no network; real ones are passed in by the caller."""
    return HashModel(settings.dimension, settings.embedding_model)


def open_workspace(workspace: str) -> tuple[Settings, str, str]:
    """Settings, index path and the folder of all branches of a workspace.

    The workspace is one repository named after its folder.
    """
    workspace = os.path.abspath(workspace)
    if not os.path.isdir(workspace):
        raise FileNotFoundError(f"workspace folder not found: {workspace}")
    settings = settings_from_env((Repo(os.path.basename(workspace), workspace),))
    base = os.environ.get(PREFIX + "HOME", os.path.expanduser("~/.codeloom"))
    path = index_location(base, workspace, settings, git_branch(workspace))
    return settings, path, path.rsplit("/", 1)[0]


def codebase_retrieval(
    spark: SparkSession,
    information_request: str,
    workspace_full_path: str,
    model_factory: ModelFactory = hash_model,
    ask: Ask | None = None,
    top_k: int | None = None,
) -> str:
    """The tool an agent calls: a question and a workspace in, formatted source blocks out."""
    try:
        settings, path, siblings = open_workspace(workspace_full_path)
    except FileNotFoundError as error:
        return f"Error: {error}"
    seed_from_sibling(spark, siblings, path, settings)
    return retrieve(
        spark, path, settings, model_factory(settings), information_request, top_k or settings.top_k, ask
    )


def main(argv: Sequence[str] | None = None, model_factory: ModelFactory = hash_model, ask: Ask | None = None) -> int:
    parser = argparse.ArgumentParser(prog="codeloom")
    groups = parser.add_subparsers(dest="group", required=True)
    index = groups.add_parser("index").add_subparsers(dest="command", required=True)
    make = index.add_parser("build")
    make.add_argument("--rebuild", action="store_true")
    make.add_argument("--repo")
    make.add_argument("--workspace-full-path", default=os.environ.get(PREFIX + "WORKSPACE", "."))
    make.add_argument("-v", "--verbose", action="store_true")
    queries = groups.add_parser("query").add_subparsers(dest="command", required=True)
    for name in ("search", "debug"):
        find = queries.add_parser(name)
        find.add_argument("text")
        find.add_argument("-n", "--top-k", type=int, default=50)
        find.add_argument("--no-llm", action="store_true")
        find.add_argument("--no-rerank", action="store_true")
        find.add_argument("--workspace-full-path", default=os.environ.get(PREFIX + "WORKSPACE", "."))
    options = parser.parse_args(argv)
    try:
        settings, path, siblings = open_workspace(options.workspace_full_path)
    except FileNotFoundError as error:
        print(f"Error: {error}", file=sys.stderr)
        return 1
    spark = build_session()
    model = model_factory(settings)
    if options.group == "index":
        seed_from_sibling(spark, siblings, path, settings)
        say = (lambda message: print(message)) if options.verbose else (lambda message: None)
        try:
            print(json.dumps(build(spark, path, settings, model, options.rebuild, options.repo, say)))
        except ValueError as error:
            print(f"Error: {error}", file=sys.stderr)
            return 1
        return 0
    judge = None if options.no_llm or options.no_rerank else ask
    if options.command == "search":
        print(retrieve(spark, path, settings, model, options.text, options.top_k, judge))
        return 0
    result = retrieve_debug(spark, path, settings, model, options.text, options.top_k, judge)
    print(
        json.dumps(
            {
                "error": result.error,
                "timing": result.diagnostics.timing,
                "warning": result.diagnostics.warning(),
                "blocks": [row.asDict(recursive=True) for row in result.diagnostics.blocks],
                "ranking": result.diagnostics.ranking and result.diagnostics.ranking.__dict__,
                "output": result.output,
            },
            indent=2,
        )
    )
    return 0


if __name__ == "__main__":
    sys.exit(main())
