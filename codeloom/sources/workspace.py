"""Facts about one workspace folder, read on the driver: branch and newest sibling index."""

from __future__ import annotations

import os

NO_GIT = "_no_git"


def git_branch(workspace: str) -> str:
    """Branch name, ``detached-<7 characters>`` or ``_no_git``; follows worktree pointers."""
    git = os.path.join(workspace, ".git")
    if os.path.isfile(git):
        pointer = _first_text(git)
        if not pointer.startswith("gitdir: "):
            return NO_GIT
        git = os.path.join(workspace, pointer.removeprefix("gitdir: "))
    head = _first_text(os.path.join(git, "HEAD"))
    if head.startswith("ref: "):
        return head.removeprefix("ref: ").removeprefix("refs/heads/")
    return f"detached-{head[:7]}" if len(head) >= 7 else NO_GIT


def _first_text(path: str) -> str:
    try:
        with open(path, encoding="utf-8") as handle:
            return handle.read().strip()
    except OSError:
        return ""
