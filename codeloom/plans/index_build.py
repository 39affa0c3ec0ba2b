"""Build an index of source trees and keep it current."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom import schema
from codeloom.operators import calls as call_ops
from codeloom.operators import changes as change_ops
from codeloom.operators import chunking, definitions, encoding, keyed, linking
from codeloom.operators.definitions import Parsing
from codeloom.operators import services as service_ops
from codeloom.settings import Settings
from codeloom.sources import file_profile, ignore_rules, source_tree
from codeloom.sources.tables import IndexLock, Scratch, Table, drop_path, exists, modified_at

Progress = Callable[[str], None]


class ModelChanged(ValueError):
    """The index was built with another embedding model; only a rebuild may change it."""


class Index:
    """The tables of one index under ``path``.

    Tables of file facts are split by file, so a repository of any size spreads over all
    buckets and a changed file touches one; tables of graph edges are split by repository.
    """

    def __init__(self, spark: SparkSession, path: str, settings: Settings):
        self.spark, self.path, self.settings = spark, path.rstrip("/"), settings

        def table(name: str, layout, split_by=("repo_id", "file_path")) -> Table:
            return Table(spark, f"{self.path}/{name}", layout, split_by, settings.index_buckets)

        repo = schema.FILES["repo_id"]
        self.files = table("files", schema.FILES)
        self.chunks = table("chunks", schema.EMBEDDED_CHUNKS)
        self.methods = table("methods", schema.METHODS, ("service_id", "file_path"))
        self.sites = table("call_sites", schema.CALL_SITES, ("service_id", "file_path"))
        self.edges = table("edges", type(schema.FILES)([repo, *schema.EDGES.fields]), ("repo_id",))
        self.resources = table(
            "resources", type(schema.FILES)([repo, *schema.RESOURCES.fields]), ("repo_id",)
        )
        self.services = table("services", schema.SERVICES, ("service_id",))
        self.facts = table("facts", schema.FACTS)
        self.flows = table("flows", schema.FLOWS, ("service_id",))
        self.tracked = table("tracked", schema.TRACKED_FILES)

    @property
    def tables(self) -> list[Table]:
        return [
            self.files, self.chunks, self.methods, self.sites, self.edges, self.resources,
            self.services, self.facts, self.flows, self.tracked,
        ]

    def create(self) -> None:
        """Empty typed tables where there are none yet."""
        for table in self.tables:
            if not exists(self.spark, table.path):
                table.overwrite(self.spark.createDataFrame([], table.schema))

    def meta(self) -> dict[str, str]:
        path = f"{self.path}/meta"
        if not exists(self.spark, path):
            return {}
        rows = self.spark.read.schema(schema.INDEX_META).parquet(path).collect()
        return {row.key: row.value for row in rows}

    def write_meta(self, **entries: object) -> None:
        rows = [(k, str(v)) for k, v in {**self.meta(), **entries}.items()]
        frame = self.spark.createDataFrame(rows, schema.INDEX_META)
        frame.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/meta")

    def clear(self) -> None:
        for table in self.tables:
            drop_path(self.spark, table.path)
        drop_path(self.spark, f"{self.path}/meta")

    def lock(self, timeout: float = 300) -> IndexLock:
        return IndexLock(self.spark, f"{self.path}.lock", timeout)

    def call_edges(self) -> DataFrame:
        return self.edges.read().drop("repo_id")


@dataclass
class Scan:
    """What the trees hold now: all listed files, and those to index with their language."""

    listing: DataFrame
    indexed: DataFrame


def scan_trees(spark: SparkSession, settings: Settings, scratch: Scratch) -> Scan:
    """List the trees once; ignore files are read from that listing and applied to it."""
    listing = scratch.settle(
        source_tree.list_files(spark, settings.repos, settings.skip_dirs), "listing"
    )
    rule_files = source_tree.read_contents(
        listing.where(
            F.col("file_path").endswith(ignore_rules.IGNORE_FILE)
            | (F.col("file_path") == ignore_rules.EXCLUDE_FILE)
        )
    )
    visible = ignore_rules.drop_ignored(listing, ignore_rules.ignore_rules(rule_files))
    indexed = file_profile.indexed_files(visible, settings.max_file_bytes, settings.skip_dirs)
    return Scan(visible, scratch.settle(indexed, "indexed"))


def service_rows(spark: SparkSession, settings: Settings, scan: Scan) -> DataFrame:
    """One service per repository; its language comes from the marker files in its root."""
    repos = spark.createDataFrame(
        [(r.repo_id, r.path) for r in settings.repos], "repo_id string, repo string"
    )
    languages = file_profile.repo_languages(scan.listing)
    return repos.join(languages, "repo_id", "left").select(
        F.col("repo_id").alias("service_id"),
        F.col("repo_id").alias("name"),
        "repo",
        F.coalesce("language", F.lit("python")).alias("language"),
        F.array().cast("array<string>").alias("tags"),
    )


def stale_files(
    spark: SparkSession, index: Index, settings: Settings, scratch: Scratch
) -> tuple[Scan, DataFrame]:
    """The trees as they are and what changed in them since they were tracked."""
    scan = scan_trees(spark, settings, scratch)
    repos = [r.repo_id for r in settings.repos]
    tracked = index.tracked.read().where(F.col("repo_id").isin(repos))
    return scan, scratch.settle(change_ops.file_changes(tracked, scan.indexed), "changes")


def build(
    spark: SparkSession,
    path: str,
    settings: Settings,
    model: encoding.EmbeddingModel,
    rebuild: bool = False,
    repo: str | None = None,
    progress: Progress = lambda message: None,
    parsing: Parsing = Parsing(),
) -> dict[str, object]:
    """Full or incremental build; returns a summary of what was done.

    ``parsing`` holds a parser library for further languages, the limit of a body's lines and a
    table of built-in names that are no call targets.

    A rebuild forgets what is stored (of one repository, if named) and indexes every file; an
    incremental build indexes the files that changed. Both follow one order: text, chunks,
    graph, tracked files, meta. A build that dies is repeated by the next one, because its
    files are not tracked yet.
    """
    if repo is not None:
        named = tuple(r for r in settings.repos if r.repo_id == repo)
        if not named:
            raise ValueError(f"repository {repo!r} is not part of the workspace")
        settings = Settings(**{**settings.__dict__, "repos": named})
    index = Index(spark, path, settings)
    stored = index.meta().get("embedding_model")
    if not rebuild and stored and stored != model.name:
        raise ModelChanged(f"index holds vectors of {stored!r}, not {model.name!r}: rebuild it")
    with index.lock(), Scratch(spark) as scratch:
        last = index.meta().get("last_build_at")
        if rebuild and last and time.time() - float(last) < settings.fresh_seconds:
            return {"status": "already_built", "chunks_added": 0, "repos_rebuilt": 0}
        if rebuild and repo is None:
            index.clear()
        else:
            index.create()
        if rebuild and repo is not None:
            _forget(index, settings, scratch)
        progress("comparing files")
        scan, changes = stale_files(spark, index, settings, scratch)
        counts = change_ops.change_counts(changes).head().asDict()
        if not rebuild and not any(counts.values()):
            return {"status": "clean", "chunks_added": 0, "repos_rebuilt": 0}
        calls = _apply(spark, index, settings, model, scan, changes, scratch, progress, parsing)
        index.write_meta(
            embedding_model=model.name,
            last_build_at=time.time(),
            chunk_size=settings.chunk_size,
            overlap=settings.chunk_overlap,
        )
    repos_rebuilt = len(settings.repos) if rebuild else counts["repos_changed"]
    summary = {
        "status": "full_build" if rebuild else "incremental",
        "chunks_added": int(calls["api_total_texts"]),
        "repos_rebuilt": repos_rebuilt,
        "encoding": calls,
    }
    if not rebuild:
        summary |= {k: v for k, v in counts.items() if k.startswith("files_")}
    return summary


def _forget(index: Index, settings: Settings, scratch: Scratch) -> None:
    """Drop all file facts of the repositories; the build that follows sees every file as added."""
    repos = [r.repo_id for r in settings.repos]
    tracked = index.tracked.read().where(F.col("repo_id").isin(repos))
    known = scratch.settle(tracked.select("repo_id", "file_path"), "known")
    owned = known.select(F.col("repo_id").alias("service_id"), "file_path")
    for table, keys in (
        (index.files, known), (index.chunks, known), (index.methods, owned), (index.sites, owned),
        (index.tracked, known),
    ):
        table.replace(keys, table.read().where(F.lit(False)))


def _apply(
    spark: SparkSession,
    index: Index,
    settings: Settings,
    model: encoding.EmbeddingModel,
    scan: Scan,
    changes: DataFrame,
    scratch: Scratch,
    progress: Progress,
    parsing: Parsing,
) -> dict[str, float]:
    """Index the changed files; returns the encoding statistics."""
    keys = changes.select("repo_id", "file_path")
    fresh = keys.join(
        changes.where(F.col("change_type") != "deleted"), ["repo_id", "file_path"], "left_semi"
    )
    now = scan.indexed.join(fresh, ["repo_id", "file_path"], "left_semi")

    progress("reading text")
    index.files.replace(keys, source_tree.read_contents(now))
    text = index.files.read().join(fresh, ["repo_id", "file_path"], "left_semi")

    progress("chunking and encoding")
    chunks = keyed.keep_last(
        chunking.extract_chunks(text, settings.chunk_size, settings.chunk_overlap),
        ["chunk_id"],
        "start_line",
    )
    titled = encoding.takes_prompts(model.name)
    encoded = encoding.encode_chunks(chunks, model, settings.encode_batch, titled)
    stored = scratch.settle(encoded, "encoded")
    index.chunks.replace(keys, stored.drop("encode_seconds", "encode_retries"))
    calls = encoding.encode_summary(stored).head().asDict()

    progress("linking methods")
    service_keys = keys.select(F.col("repo_id").alias("service_id"), "file_path")
    methods, sites = definitions.extract_methods(
        text, parsing.grammar, parsing.grammar_parsers, parsing.body_limit, parsing.builtins, scratch.settle
    )
    index.methods.replace(service_keys, methods)
    index.sites.replace(service_keys, sites)

    progress("linking services")
    _relink(spark, index, settings, scan, changes, scratch)

    done = now.select("repo_id", "file_path", "mtime").withColumn("indexed_at", F.lit(time.time()))
    index.create()
    index.tracked.replace(keys, done)
    return calls


def _relink(
    spark: SparkSession,
    index: Index,
    settings: Settings,
    scan: Scan,
    changes: DataFrame,
    scratch: Scratch,
) -> None:
    """Services, facts and edges, wherever the changes reach.

    Methods and sites are not parsed again, and only changed files are read for facts. The service
    graph also reads manifests and Terraform files, which are not part of the indexed text,
    straight from the listing. Edges of repositories that didn't change are linked anew
    if their stored facts name a service, folder or file that came or went.
    """
    repos = scratch.settle(change_ops.changed_repos(changes), "repos")
    owners = repos.select(F.col("repo_id").alias("service_id"))
    services = service_rows(spark, settings, scan)
    is_manifest = F.element_at(F.split("file_path", "/"), -1).isin(
        [*service_ops.MANIFESTS, "Pipfile", "pyproject.toml"]
    )
    extra = scan.listing.where(
        (is_manifest | F.col("file_path").rlike(r"\.(tf|tfvars)$"))
        & (F.col("size") <= settings.max_file_bytes)
    ).join(scan.indexed.select("repo_id", "file_path"), ["repo_id", "file_path"], "left_anti")
    columns = ["repo_id", "file_path", "content"]
    text = (
        index.files.read().select(*columns)
        .unionByName(source_tree.read_contents(extra).select(*columns))
        .join(repos, "repo_id", "left_semi")
    )
    languages = services.select(F.col("service_id").alias("repo_id"), F.col("language").alias("service_language"))
    types = service_ops.service_types(text.join(languages, "repo_id"))
    rows = services.join(owners, "service_id", "left_semi").join(types, "service_id", "left").select(
        "service_id", "name", "repo", "language", "tags",
        F.coalesce("service_type", F.lit("service")).alias("service_type"),
    )
    index.create()
    rows = scratch.settle(rows, "services")
    before = scratch.settle(index.services.read().select("service_id", "language"), "services-before")
    index.services.replace(owners, rows)
    everyone = index.services.read()
    readable = text.withColumn("size", F.lit(0))
    sources = file_profile.service_files(readable, service_ops.MANIFESTS).select(*columns)

    key = ["repo_id", "file_path"]
    stored = scratch.settle(index.facts.read().select(*key).join(repos, "repo_id", "left_semi"), "facts-before")
    listed = scratch.settle(sources.select(*key), "sources")
    retold = linking.differing(
        before.join(owners, "service_id", "left_semi"), rows.select("service_id", "language")
    ).select(F.col("service_id").alias("repo_id"))
    stale = (
        changes.select(*key)
        .unionByName(extra.select(*key).join(repos, "repo_id", "left_semi"))
        .unionByName(linking.differing(stored, listed))
        .unionByName(listed.join(retold, "repo_id", "left_semi"))
        .distinct()
    )
    stale = scratch.settle(stale, "stale-facts")
    told = service_ops.file_facts(sources.join(stale, key, "left_semi").join(languages, "repo_id"))
    index.facts.replace(stale, told)
    facts = index.facts.read()

    came = linking.differing(before.select("service_id"), everyone.select("service_id"))
    names = linking.changed_names(stored, facts.select(*key).join(repos, "repo_id", "left_semi"))
    reached = scratch.settle(linking.affected_repos(repos, facts, came, names), "reached")
    resources, links = service_ops.link(
        scratch.settle(facts.join(reached, "repo_id", "left_semi"), "facts"), everyone, facts.select(*key)
    )
    index.resources.replace(reached, resources)
    owners = reached.select(F.col("repo_id").alias("service_id"))
    methods = index.methods.read().join(owners, "service_id", "left_semi")
    sites = index.sites.read().join(owners, "service_id", "left_semi")
    resolved = call_ops.resolve_calls(sites, methods)
    call_rows = call_ops.call_edges(resolved).withColumn(
        "repo_id", F.substring_index("source_id", "::", 1)
    )
    link_rows = links.withColumn("repo_id", F.col("source_id"))
    index.edges.replace(reached, call_rows.unionByName(link_rows))


def shared_resources(index: Index) -> DataFrame:
    """Each datastore and queue once, whoever uses it."""
    return index.resources.read().drop("repo_id").distinct()


def seed_from_sibling(spark: SparkSession, base: str, target: str, settings: Settings) -> str | None:
    """Start a new branch's index as a copy of the newest one with the same model and width.

    ``base`` holds ``branch=<name>`` folders. The tables are copied by Spark and the meta entry
    last, so a copy that dies half-way is not taken for an index.
    """
    if exists(spark, f"{target}/meta") or not exists(spark, base):
        return None
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(base)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    siblings = [s.getPath().toString() for s in fs.listStatus(folder) if s.isDirectory()]
    ready = [s for s in siblings if s.rstrip("/") != target.rstrip("/") and exists(spark, f"{s}/meta")]
    if not ready:
        return None
    newest = max(ready, key=lambda s: modified_at(spark, f"{s}/meta"))
    source, copy = Index(spark, newest, settings), Index(spark, target, settings)
    for old, new in zip(source.tables, copy.tables):
        if exists(spark, old.path):
            new.overwrite(old.read())
    copy.write_meta(**source.meta())
    return newest
