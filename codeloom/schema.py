"""Column layout of the index tables.

One typed table per node kind keeps column pruning useful; a JSON union view of
all nodes is derived in :mod:`codeloom.operators.exports` when it is needed.
"""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "array<string>": T.ArrayType(T.StringType()),
    "map<string,string>": T.MapType(T.StringType(), T.StringType()),
}


def _struct(columns: str) -> T.StructType:
    """Struct of ``name type`` pairs; unlike DDL parsing it needs no running session."""
    pairs = [column.strip().split(" ") for column in columns.split(", ")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


FILES = _struct(
    "repo_id string, file_path string, abs_path string, language string, "
    "size bigint, mtime double, content string"
)

CHUNKS = _struct(
    "chunk_id string, repo_id string, file_path string, start_line int, end_line int, "
    "content string, language string, chunk_type string, symbol string"
)

EMBEDDED_CHUNKS = T.StructType(
    CHUNKS.fields + [T.StructField("embedding", T.ArrayType(T.FloatType(), False))]
)

SCORED_CHUNKS = _struct(
    "chunk_id string, score double, file_path string, start_line int, end_line int, "
    "content string, repo_id string, symbol string, chunk_type string, language string"
)

SERVICES = _struct(
    "service_id string, name string, repo string, language string, tags array<string>, "
    "service_type string"
)

RESOURCES = _struct("node_id string, node_type string, kind string, name string")

METHODS = _struct(
    "method_id string, legacy_id string, service_id string, file_path string, "
    "class_name string, name string, full_name string, signature string, "
    "docstring string, line_start int, line_end int"
)

FLOWS = _struct(
    "flow_id string, name string, service_id string, entry_method_id string, step_count int"
)

CALL_SITES = _struct(
    "service_id string, file_path string, caller_id string, callee_name string, line int"
)

EDGES = _struct(
    "source_id string, target_id string, kind string, metadata map<string,string>"
)

_RESOURCE_USE = T.ArrayType(_struct("kind string, name string, direction string"))
_NAMES = ("hosts", "variables", "rpc_names", "quoted", "imported", "mentioned")

FACTS = T.StructType(
    _struct("repo_id string, file_path string").fields
    + [T.StructField(name, _RESOURCE_USE) for name in ("stores", "queues")]
    + [T.StructField(name, T.ArrayType(T.StringType())) for name in _NAMES]
)

TRACKED_FILES = _struct("repo_id string, file_path string, mtime double, indexed_at double")

INDEX_META = _struct("key string, value string")
