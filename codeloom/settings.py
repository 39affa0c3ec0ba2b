"""Settings of a workspace, read from the environment with code defaults."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from collections.abc import Mapping

PREFIX = "CODELOOM_"

# Model families and their vector width.
MODEL_DIMENSIONS = {"voyage-": 1024, "gemini-": 768}
DEFAULT_DIMENSION = 1024


@dataclass(frozen=True)
class Repo:
    repo_id: str
    path: str
    language: str = "python"


@dataclass(frozen=True)
class Settings:
    """Defaults are the reference values of each knob."""

    top_k: int = 24
    chunk_size: int = 32
    chunk_overlap: int = 8
    expand_depth: int = 2
    expand_max_chunks: int = 30
    rerank: bool = True
    embedding_model: str = "voyage-code-3"
    max_file_bytes: int = 1024 * 1024
    skip_dirs: tuple[str, ...] = ()
    llm_model: str = "claude-sonnet-4-5"
    llm_provider: str = "anthropic"
    encode_batch: int = 100
    fresh_seconds: float = 30.0
    index_buckets: int = 16
    dimension_override: int | None = None
    repos: tuple[Repo, ...] = field(default_factory=tuple)

    @property
    def dimension(self) -> int:
        return model_dimension(self.embedding_model, self.dimension_override)


def model_dimension(model: str, override: int | None = None) -> int:
    if override:
        return override
    for family, width in MODEL_DIMENSIONS.items():
        if model.startswith(family):
            return width
    return DEFAULT_DIMENSION


def settings_from_env(repos: tuple[Repo, ...] = (), env: Mapping[str, str] | None = None) -> Settings:
    env = os.environ if env is None else env

    def read(name: str, default, convert=str):
        raw = env.get(PREFIX + name)
        return default if raw is None else convert(raw)

    base = Settings()
    return Settings(
        top_k=read("TOP_K", base.top_k, int),
        chunk_size=read("CHUNK_SIZE", base.chunk_size, int),
        chunk_overlap=read("CHUNK_OVERLAP", base.chunk_overlap, int),
        expand_depth=read("EXPAND_CALL_DEPTH", base.expand_depth, int),
        expand_max_chunks=read("EXPAND_MAX_CHUNKS", base.expand_max_chunks, int),
        rerank=read("RERANK", True, lambda v: v.lower() not in ("false", "0", "no")),
        embedding_model=read("EMBEDDING_MODEL", "") or base.embedding_model,
        max_file_bytes=read("MAX_FILE_BYTES", base.max_file_bytes, int),
        skip_dirs=read(
            "SKIP_DIRS", (), lambda v: tuple(d.strip() for d in v.split(",") if d.strip())
        ),
        llm_model=read("LLM_MODEL", base.llm_model),
        llm_provider=read("LLM_PROVIDER", base.llm_provider),
        encode_batch=read("EMBED_BATCH", base.encode_batch, int),
        index_buckets=read("INDEX_BUCKETS", base.index_buckets, int),
        dimension_override=read("EMBEDDING_DIM", None, lambda v: int(v) if v.strip() else None),
        repos=repos,
    )


def sanitize_path(path: str) -> str:
    """Folder name for a workspace path: separators and drive colons become dashes."""
    text = os.path.abspath(path).rstrip("/\\")
    for ch in "\\/:":
        text = text.replace(ch, "-")
    return text.lstrip("-")


def index_location(base: str, workspace: str, settings: Settings, branch: str) -> str:
    """``base/workspace/model=../dim=../branch=..`` keeps each vector space apart."""
    def safe(text: str) -> str:
        return text.replace("/", "_").replace("\\", "_")

    return "/".join(
        [
            base.rstrip("/"),
            sanitize_path(workspace),
            f"model={safe(settings.embedding_model)}",
            f"dim={settings.dimension}",
            f"branch={safe(branch)}",
        ]
    )
