"""Methods and call sites of source files.

Python goes through its own parser inside a vectorised function. The other languages are
matched line by line with built-in expressions: one pass over the lines finds definition
heads, a running brace (or ``end``) depth per file, in Arrow, finds where each body closes.
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.functions import text as tx
from codeloom.operators.overlap import overlap_join

# File suffixes the method graph reads and the parser each one uses.
SUFFIX_PARSER = {
    ".py": "python",
    ".js": "javascript",
    ".ts": "typescript",
    ".tsx": "tsx",
    ".jsx": "javascript",
    ".go": "go",
    ".java": "java",
    ".cs": "csharp",
    ".rs": "rust",
    ".rb": "ruby",
    ".php": "php",
    ".c": "cpp",
    ".cc": "cpp",
    ".cpp": "cpp",
    ".cxx": "cpp",
    ".h": "cpp",
    ".hh": "cpp",
    ".hpp": "cpp",
    ".hxx": "cpp",
}

# Definition heads per language, tried in this order on one line.
# (languages, pattern, group with the name, group with a class prefix or 0, kind, texts every match
# holds: a line without one of them skips the pattern)
_JS = ("javascript", "typescript", "tsx")
HEADS = (
    (_JS, r"^\s*export\s+default\s+(?:async\s+)?function\s*([\w$]*)\s*[<(]", 1, 0, "default", ("default", "function")),
    (_JS, r"^\s*export\s+(?:async\s+)?function\s+([\w$]+)\s*[<(]", 1, 0, "function", ("export", "function")),
    (_JS, r"^\s*(?:export\s+)?async\s+function\s+([\w$]+)\s*[<(]", 1, 0, "function", ("async", "function")),
    (_JS, r"^\s*(?:export\s+)?function\s+([\w$]+)\s*[<(]", 1, 0, "function", ("function",)),
    (
        _JS,
        r"^\s*export\s+(?:const|let|var)\s+([\w$]+)\s*=\s*(?:async\s+)?"
        r"(?:\([^)]*\)|[\w$]+)\s*(?::[^=]+)?=>",
        1,
        0,
        "function",
        ("export", "=>"),
    ),
    (
        _JS,
        r"^\s*(?:const|let|var)\s+([\w$]+)\s*=\s*(?:async\s+)?"
        r"(?:\([^)]*\)|[\w$]+)\s*(?::[^=>]+)?=>",
        1,
        0,
        "function",
        ("=>",),
    ),
    (
        _JS,
        r"^\s*(?:(?:public|private|protected|static|abstract|override|async|readonly)\s+)*"
        r"([\w$]+)\s*[<(][^)]*\)\s*(?::[^{]+)?\s*\{",
        1,
        0,
        "member",
        ("{", ")"),
    ),
    (("go",), r"^func\s+(?:\([^)]+\)\s+)?(\w+)\s*\(", 1, 0, "function", ("func",)),
    (
        ("java",),
        r"(?:public|private|protected|static|\s)[\w<>\[\]]+\s+(\w+)\s*\([^)]*\)\s*\{?",
        1,
        0,
        "function",
        ("(", ")"),
    ),
    (
        ("csharp",),
        r"(?:public|private|protected|internal|static|async|\s)[\w<>\[\]]+\s+(\w+)"
        r"\s*\([^)]*\)\s*\{?",
        1,
        0,
        "function",
        ("(", ")"),
    ),
    (("rust",), r"^\s*(?:pub\s+)?(?:async\s+)?fn\s+(\w+)\s*\(", 1, 0, "function", ("fn",)),
    (("ruby",), r"^\s*def\s+(?:self\.)?(\w+)", 1, 0, "function", ("def",)),
    (
        ("php",),
        r"^\s*(?:(?:public|private|protected|static|final)\s+)*function\s+(\w+)\s*\(",
        1,
        0,
        "function",
        ("function",),
    ),
    (
        ("cpp",),
        r"^\s*(?:(?:virtual|static|inline|explicit|constexpr|consteval|extern|friend)\s+)*"
        r"(?:[\w:*&<>\[\],\s]+\s+)(?:([\w:]+)::)?(~?\w+)\s*\([^;]*\)"
        r"\s*(?:const|volatile|noexcept|override|final|\[\[.*?\]\]|\s)*\s*\{?\s*$",
        2,
        1,
        "member",
        ("(", ")"),
    ),
)

# Words that look like a definition head but are not one.
NOT_A_NAME = {
    _JS: (
        "if else for while switch catch try return new typeof instanceof import export from "
        "class extends implements interface type enum declare public private protected static "
        "async await"
    ).split(),
    ("java", "csharp"): "if for while switch catch class".split(),
    ("cpp",): (
        "if else for while switch catch try return new delete sizeof typeof static_cast "
        "dynamic_cast reinterpret_cast const_cast throw using namespace typedef class struct "
        "enum union public private protected do case default"
    ).split(),
}

# Class declarations, by language.
CLASS_HEADS = {
    _JS: r"^\s*(?:export\s+)?(?:abstract\s+)?class\s+([\w$]+)",
    ("cpp",): r"^\s*(?:class|struct)\s+(\w+)",
}

# Languages whose test methods start with 'test', not only 'test_'.
BARE_TEST_PREFIX = ("csharp", "rust", "php", "cpp")

# A call's name in a line without strings and comments, as group 1.
_CALL = r"(?<![\w$@])([^\W\d][\w$]*)(?:<[\w\s,<>\[\].:?$]*>)?(?:\?\.)?\s*\("
CALL_SITES = {
    (*_JS, "java", "csharp", "php"): _CALL,
    ("go",): r"(?<!\w)([^\W\d]\w*)(?:\[[\w\s,*.\[\]]+\])?\(",
    # A path such as a::b stays whole; a macro's name goes without its mark.
    ("rust",): r"(?<![\w:])((?:\w+::)*[^\W\d]\w*)(?:::<[^()]*?>)?(?:!?\s*\(|!\s*[\[{])",
    # After a dot, before a bracket, or first on a line before an argument.
    ("ruby",): (
        r"(?:(?<=\.)|(?<![\w@$:.])(?=[^\W\d]\w*[?!]?\()"
        r"|^\s*(?=[^\W\d]\w*[?!]?\s+[\"':@\w\[])(?!\s*\w+[?!]?\s+(?:if|unless|and|or|while|until|do|rescue|in)\b))"
        r"([^\W\d]\w*[?!]?)"
    ),
}

# Words of each language that stand before a bracket or an argument and call nothing.
_BRANCHES = ("if", "for", "while", "switch", "catch", "return", "new", "throw", "else", "case")
NOT_A_CALL = {
    _JS: (*_BRANCHES, "function", "typeof", "await", "super", "import", "of", "in", "instanceof", "void", "yield", "delete"),
    ("go",): (*_BRANCHES, "func", "go", "defer", "select", "range", "var", "type", "struct", "interface", "map", "chan"),
    ("java",): (*_BRANCHES, "synchronized", "super", "this", "try", "assert", "do"),
    ("csharp",): (*_BRANCHES, "using", "lock", "foreach", "fixed", "base", "this", "when", "checked", "unchecked",
                  "typeof", "sizeof", "default", "await", "in", "is", "and", "or", "not"),
    ("rust",): ("if", "while", "match", "for", "in", "return", "let", "loop", "fn", "move", "mut", "ref", "as", "else", "impl", "where"),
    ("ruby",): ("if", "unless", "while", "until", "for", "in", "case", "when", "elsif", "else", "return", "def", "class", "module",
                "do", "and", "or", "not", "yield", "super", "rescue", "ensure", "begin", "end", "then", "alias", "undef", "self"),
    ("php",): (*_BRANCHES, "elseif", "foreach", "match", "function", "fn", "array", "list", "isset", "empty", "unset", "echo",
               "print", "exit", "die", "use", "and", "or", "xor", "declare"),
}

# A definition's own name, so that it isn't taken for a call.
DEFINED_NAME = r"\b(?:function|func|fn|def)\s+(?:\([^)]*\)\s*|self\.)?[\w$]+[?!]?"

RUBY_OPENER = r"\b(def|class|module|do|if|unless|while|until|for|case|begin)\b"
RUBY_CLOSER = r"^\s*end\b"
#: A body of this many lines or more is given up and counts as its head line; None, as in builds, sets no limit.
BODY_LIMIT = 500
HEAD_TO_BRACE = 4

_METHOD_FIELDS = ("name", "full_name", "class_name", "signature", "docstring")
_PYTHON_METHOD = T.StructType(
    [T.StructField(n, T.StringType()) for n in _METHOD_FIELDS]
    + [T.StructField(n, T.IntegerType()) for n in ("line_start", "line_end")]
)
_PYTHON_CALL = T.StructType(
    [
        T.StructField("caller", T.StringType()),
        T.StructField("callee_name", T.StringType()),
        T.StructField("line", T.IntegerType()),
    ]
)
_PYTHON_FACTS = T.StructType(
    [
        T.StructField("methods", T.ArrayType(_PYTHON_METHOD)),
        T.StructField("calls", T.ArrayType(_PYTHON_CALL)),
    ]
)


def _is_test_name(name: str) -> bool:
    lowered = name.lower()
    return lowered.startswith("test_") or "mock" in lowered


def _python_facts(source: str | None) -> dict:
    """Methods and call sites of one Python text.

    The scope carries the innermost class and the innermost method, by full name; test and
    mock methods are left out with everything inside them.
    """
    methods, calls = [], []
    try:
        pending = [(ast.parse(source), None, None)] if source is not None else []
    except (SyntaxError, ValueError, RecursionError):
        pending = []
    while pending:
        node, owner, method = pending.pop()
        if isinstance(node, ast.ClassDef):
            owner = node.name
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            if _is_test_name(node.name):
                continue
            method = f"{owner}.{node.name}" if owner else node.name
            methods.append(
                {
                    "name": node.name,
                    "full_name": method,
                    "class_name": owner,
                    "signature": f"def {node.name}({', '.join(a.arg for a in node.args.args)})",
                    "docstring": ast.get_docstring(node),
                    "line_start": node.lineno,
                    "line_end": node.end_lineno,
                }
            )
        elif isinstance(node, ast.Call) and method:
            target = getattr(node.func, "id", None) or getattr(node.func, "attr", None)
            if target and isinstance(node.func, (ast.Name, ast.Attribute)):
                calls.append({"caller": method, "callee_name": target, "line": node.lineno})
        children = list(ast.iter_child_nodes(node))
        pending.extend((child, owner, method) for child in reversed(children))
    return {"methods": methods, "calls": calls}


Grammar = Callable[[str, str], dict]
Settle = Callable[[DataFrame, str], DataFrame]


def _unsettled(rows: DataFrame, name: str) -> DataFrame:
    return rows


@dataclass(frozen=True)
class Parsing:
    """How a build reads methods: the arguments of ``extract_methods`` that a caller may set."""

    grammar: Grammar | None = None
    grammar_parsers: tuple[str, ...] = ()
    body_limit: int | None = None
    builtins: DataFrame | None = None


def parsed_facts(grammar: Grammar | None = None) -> Callable[[Column, Column], Column]:
    """Vectorised ``(parser, source) -> struct<methods, calls>``.

    Python texts are parsed here; with a ``grammar`` (a parser library of the caller's, called
    as ``grammar(parser, source)`` and returning the same lists) so are all texts handed in.
    """

    @F.pandas_udf(_PYTHON_FACTS)
    def facts(parser: pd.Series, source: pd.Series) -> pd.DataFrame:
        found = [
            grammar(kind, text) if grammar else _python_facts(text)
            for kind, text in zip(parser, source)
        ]
        return pd.DataFrame(found, columns=["methods", "calls"])

    # Marked so that the optimizer never copies a call into a second place of a plan.
    return facts.asNondeterministic()


def _per_language(table: dict, column: str = "parser") -> list[tuple[Column, object]]:
    return [(F.col(column).isin(list(langs)), value) for langs, value in table.items()]


def _rejected(name: Column, langs: tuple[str, ...]) -> Column:
    """Names that define nothing in these languages: keywords, tests and mocks."""
    words = next((w for known, w in NOT_A_NAME.items() if langs[0] in known), [])
    keyword = f"~*(?:{'|'.join(words)})" if langs == ("cpp",) else "|".join(words)
    test = "test" if langs[0] in BARE_TEST_PREFIX else "test_"
    named = f"^(?:{keyword})$|" if words else ""
    return name.rlike(f"{named}^(?i:{test})|(?i:mock)")


def _head(line: Column) -> Column:
    """First accepted definition head on a line: ``struct<name, prefix, kind>`` or NULL."""
    options = []
    searched = F.when(
        (F.col("parser") == "cpp") & F.ltrim(line).startswith("template"),
        F.regexp_replace(line, r"^\s*template\s*<[^>]*>\s*", ""),
    ).otherwise(line)

    def accepted_in(langs: tuple[str, ...]):
        return lambda found: F.when(
            (found["name"] != "") & ~_rejected(found["name"], langs), found
        )

    for langs, pattern, group, prefix_group, kind, needs in HEADS:
        pattern = "(?U)" + pattern
        raw = F.regexp_extract(searched, pattern, group)
        if kind == "default":
            unnamed = (raw == "") & searched.rlike(pattern)
            raw = F.when(unnamed, tx.stem(F.col("file_path"))).otherwise(raw)
        prefix = F.regexp_extract(searched, pattern, prefix_group) if prefix_group else F.lit("")
        applies = reduce(lambda a, b: a & b, map(searched.contains, needs), F.col("parser").isin(list(langs)))
        if langs in (("java",), ("csharp",)):
            applies = applies & ~line.contains("class ")
        found = F.struct(raw.alias("name"), prefix.alias("prefix"), F.lit(kind).alias("kind"))
        options.append(F.when(applies, tx.let(found, accepted_in(langs))))
    return F.coalesce(*options)


def _class_head(line: Column) -> Column:
    found = F.lit(None).cast("string")
    for is_lang, pattern in _per_language(CLASS_HEADS):
        name = F.regexp_extract(line, "(?U)" + pattern, 1)
        may_be = is_lang & (line.contains("class") | line.contains("struct"))
        found = F.when(may_be & (name != ""), name).otherwise(found)
    return found


def _before_comment(line: Column, mark: str = "//") -> Column:
    return F.substring_index(line, mark, 1)


def _braces(line: Column) -> Column:
    """The braces of a line outside strings and comments, e.g. '}{'."""
    quoted = line.contains('"') | line.contains("'")
    code = tx.replaced_if(quoted, _before_comment(line), r"([\"'])(?:.*?(?<!\\)\1|.*$)", "")
    kept = F.regexp_replace(code, r"[^{}]+", "")
    none = ~(line.contains("{") | line.contains("}"))
    return F.when(none | F.ltrim(line).startswith("*") | F.ltrim(line).startswith("/*"), "").otherwise(kept)


def _depth_after(braces: Column, count: Column) -> Column:
    head = F.substring(braces, F.lit(1), count)
    return 2 * F.length(F.replace(head, F.lit("}"), F.lit(""))) - F.length(head)


def _line_depths(line: Column) -> Column:
    """``struct<delta, closes>``: depth change over a line and the depths, counted from its
    start, right after each closer."""
    none = F.array().cast("array<int>")

    def braced(braces: Column) -> Column:
        length = F.length(braces)
        places = F.filter(F.sequence(F.lit(1), length), lambda i: F.substring(braces, i, F.lit(1)) == "}")
        closes = F.transform(places, lambda i: _depth_after(braces, i))
        return F.struct(
            _depth_after(braces, length).alias("delta"),
            F.when(~braces.contains("}"), none).when(braces == "{}", F.array(F.lit(0))).otherwise(closes).alias("closes"),
        )

    opened = F.regexp_count(_before_comment(line, "#"), F.lit(RUBY_OPENER))
    ended = tx.let(
        opened - line.rlike(RUBY_CLOSER).cast("int"),
        lambda delta: F.struct(
            delta.alias("delta"), F.when(delta < 0, F.array(delta)).otherwise(none).alias("closes")
        ),
    )
    return F.when(F.col("parser") == "ruby", ended).otherwise(tx.let(_braces(line), braced))


def _scanned_files(files: DataFrame) -> DataFrame:
    """``repo_id, file_path, lines``: per file the lines that matter to the method graph.

    These are heads, class heads and depth changes. ``lag`` is the offset of the line with the
    opening brace from its head (0 for Ruby), NULL where no body opens; ``lead`` is the depth
    change between the two.
    The lines are matched inside their array, so each expression runs once per line, and only
    the few that matter go on, without the text. Copies of a file are read as one.
    """
    is_ruby = F.col("parser") == "ruby"

    def opens_after(lines: Column, line_no: Column) -> Column:
        near = F.slice(lines, line_no, F.lit(HEAD_TO_BRACE))
        at = F.array_position(
            F.transform(near, lambda text: _before_comment(text).contains("{")), F.lit(True)
        ).cast("int")
        return F.when(is_ruby, F.lit(0)).otherwise(F.when(at > 0, at - 1))

    def depth_between(lines: Column, line_no: Column, lag: Column) -> Column:
        return F.aggregate(
            F.slice(lines, line_no, lag),
            F.lit(0),
            lambda total, text: total
            + tx.let(_braces(text), lambda braces: _depth_after(braces, F.length(braces))),
        )

    def opening(lines: Column, line_no: Column) -> Column:
        return tx.let(
            opens_after(lines, line_no),
            lambda lag: F.struct(
                lag.alias("lag"), F.when(lag > 0, depth_between(lines, line_no, lag)).alias("depth")
            ),
        )

    def scan(lines: Column, line: Column, position: Column) -> Column:
        facts = F.struct(
            (position + 1).alias("line_no"),
            _head(line).alias("head"),
            _class_head(line).alias("class_head"),
            _line_depths(line).alias("depths"),
        )
        return tx.let(
            facts,
            lambda f: F.struct(
                f["line_no"].alias("line_no"),
                f["head"].alias("head"),
                f["class_head"].alias("class_head"),
                f["depths"]["delta"].alias("delta"),
                f["depths"]["closes"].alias("closes"),
                F.when(f["head"].isNotNull(), opening(lines, f["line_no"])).alias("opening"),
            ),
        )

    def matters(s: Column) -> Column:
        return (
            s["head"].isNotNull()
            | s["class_head"].isNotNull()
            | (s["delta"] != 0)
            | (F.size(s["closes"]) > 0)
        )

    scanned = tx.let(
        tx.split_lines(F.col("content")),
        lambda lines: F.filter(
            F.transform(lines, lambda line, at: scan(lines, line, at)), matters
        ),
    )
    return _by_file(files, ["repo_id", "file_path"], scanned, "lines")


def _by_file(rows: DataFrame, keys: list[str], array: Column, name: str) -> DataFrame:
    """One row per file with the elements of all its rows' arrays."""
    each = rows.select(*keys, array.alias(name))
    return each.groupBy(*keys).agg(F.flatten(F.collect_list(name)).alias(name))


_BODIES = (
    "repo_id string, file_path string, name string, prefix string, kind string, scope string, "
    "head_line int, at int, opens boolean, nearest int"
)


def _lengths(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)


def _ints(values: pa.Array) -> np.ndarray:
    return pc.fill_null(values, 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _heads_and_closers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scanned files to one row per head, with its class context and the nearest closer below.

    A body that opens at depth d closes on the first line from there on where a closer returns
    to d. All closers of a batch are sorted by file, depth and line, and each head looks up its place.
    """
    for batch in batches:
        lines = batch.column("lines")
        flat = lines.flatten()
        if not len(flat):
            continue
        file = np.repeat(np.arange(batch.num_rows), _lengths(lines))
        order = np.lexsort((_ints(flat.field("line_no")), file))
        flat, file = flat.take(pa.array(order)), file[order]
        line_no, delta = _ints(flat.field("line_no")), _ints(flat.field("delta"))
        first = np.searchsorted(file, file)
        before = np.cumsum(delta) - delta
        depth = before - before[first]

        classes = flat.field("class_head")
        last = np.maximum.accumulate(np.where(classes.is_valid(), np.arange(len(file)), -1))
        heads = np.flatnonzero(flat.field("head").is_valid())
        scope = classes.take(pa.array(last[heads], mask=last[heads] < first[heads]))

        lag = flat.field("opening").field("lag").take(pa.array(heads))
        lead = flat.field("opening").field("depth").take(pa.array(heads))
        at, level = line_no[heads] + _ints(lag), depth[heads] + _ints(lead)
        closes = flat.field("closes")
        line_of = np.repeat(np.arange(len(file)), _lengths(closes))
        closed = depth[line_of] + _ints(closes.flatten())
        lowest = min(level.min(initial=0), closed.min(initial=0))
        depths = max(level.max(initial=0), closed.max(initial=0)) - lowest + 1
        end = max(line_no.max(), at.max(initial=0)) + 1
        closers = np.sort((file[line_of] * depths + closed - lowest) * end + line_no[line_of])
        wanted = (file[heads] * depths + level - lowest) * end + at
        place = np.searchsorted(closers, wanted)
        found = np.append(closers, -1)[place]
        none = found // end != wanted // end

        head = flat.field("head").take(pa.array(heads))
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(c).take(pa.array(file[heads])) for c in ("repo_id", "file_path")),
                *(head.field(c) for c in ("name", "prefix", "kind")),
                scope,
                *(pa.array(v, pa.int32()) for v in (line_no[heads], at)),
                lag.is_valid(),
                pa.array(found % end, pa.int32(), mask=none),
            ],
            [c.split()[0] for c in _BODIES.split(", ")],
        )


def _bodies(scanned: DataFrame, body_limit: int | None) -> DataFrame:
    """Heads with class context and ``line_end``, from the lines of whole files.

    A file's lines stay in its row: nothing is sorted or numbered across rows, so a task holds a
    batch of files, whatever number it reads. A file is bounded by the size limit of the scan.
    """
    heads = scanned.mapInArrow(_heads_and_closers, _BODIES)
    in_reach = F.col("opens") & F.col("nearest").isNotNull()
    if body_limit is not None:
        in_reach = in_reach & (F.col("nearest") < F.col("at") + body_limit)
    return heads.withColumn(
        "line_end", F.when(in_reach, F.col("nearest")).otherwise(F.col("head_line"))
    )


def _method_id(full_name: Column) -> Column:
    return F.concat_ws("::", "repo_id", "file_path", full_name)


def _legacy_id(full_name: Column) -> Column:
    """Id with the bare file name, which equal names in equally named files share."""
    return F.concat_ws("::", F.col("repo_id"), tx.base_name(F.col("file_path")), full_name)


def scripted_methods(files: DataFrame, body_limit: int | None = BODY_LIMIT) -> DataFrame:
    """Methods of files matched by line, not parsed; input ``repo_id, file_path, parser, content``."""
    heads = _bodies(_scanned_files(files.where(F.col("parser") != "python")), body_limit)
    member = F.col("kind") == "member"
    own_prefix = F.when(F.col("prefix") != "", F.col("prefix"))
    class_name = F.when(member, F.coalesce(own_prefix, F.col("scope")))
    full = F.concat_ws(".", class_name, F.col("name"))
    return heads.select(
        _method_id(full).alias("method_id"),
        _legacy_id(full).alias("legacy_id"),
        F.col("repo_id").alias("service_id"),
        "file_path",
        class_name.alias("class_name"),
        "name",
        full.alias("full_name"),
        F.col("name").alias("signature"),
        F.lit(None).cast("string").alias("docstring"),
        F.col("head_line").alias("line_start"),
        "line_end",
    )


def cpp_calls(files: DataFrame, methods: DataFrame) -> DataFrame:
    """Call sites inside C and C++ bodies: every ``word(`` before a line comment."""
    source = files.where(F.col("parser") == "cpp")
    lines = source.select(
        F.col("repo_id").alias("service_id"),
        "file_path",
        F.posexplode_outer(tx.split_lines(F.col("content"))).alias("_p", "text"),
    ).withColumn("line", F.col("_p") + 1)
    found = F.regexp_extract_all(_before_comment(F.col("text")), F.lit(r"(?U)\b(\w+)\s*\("), F.lit(1))
    sites = tx.exploded(
        lines, ["service_id", "file_path", "line"], F.array_distinct(found), "callee_name"
    ).where(~F.col("callee_name").isin(NOT_A_NAME[("cpp",)]))
    spans = methods.select("service_id", "file_path", "method_id", "line_start", "line_end")
    inside = overlap_join(
        sites.withColumn("line_last", F.col("line")),
        spans,
        ["service_id", "file_path"],
        ("line", "line_last"),
    )
    return inside.select(
        "service_id", "file_path", F.col("method_id").alias("caller_id"), "callee_name", "line"
    )


def _code_of_line(line: Column) -> Column:
    """A line with its strings emptied and without comments, by the parser's rules."""
    quoted = tx.replaced_if(line.contains('"'), line, r"\"(?:[^\"\\]|\\.)*+\"", '""')
    # A single quote also marks lifetimes in Rust, where only a character literal is a text.
    marked, literal = line.contains("'"), F.col("parser").isin("rust", "go", "java", "csharp")
    single = tx.replaced_if(marked & literal, quoted, r"'(?:\\[^']+|[^'\\])'", "''")
    plain = tx.replaced_if(marked & ~literal, single, r"'(?:[^'\\]|\\.)*+'", "''")
    ticked = tx.replaced_if(line.contains("`"), plain, r"`(?:[^`\\]|\\.)*+`", "``")
    hashed = tx.replaced_if(line.contains("#") & F.col("parser").isin("ruby", "php"), ticked, r"#.*", "")
    slashes = F.col("parser") != "ruby"
    joined = tx.replaced_if(line.contains("/*") & slashes, hashed, r"/\*.*?\*/", " ")
    whole = tx.replaced_if(line.contains("/") & slashes, joined, r"//.*|/\*.*", "")
    inside_comment = (F.col("parser") != "ruby") & F.ltrim(line).rlike(r"^\*(?:\s|/|$)")
    return F.when(inside_comment, "").otherwise(whole)


_SITES = "service_id string, file_path string, caller_id string, callee_name string, line int"


def _sites_in_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files with their sites and spans to one row per call site inside a span."""
    for batch in batches:
        sites, spans = batch.column("sites").flatten(), batch.column("spans").flatten()
        site_ends, span_ends = (np.cumsum(_lengths(batch.column(c))) for c in ("sites", "spans"))
        line, names = sites.field("line").to_pylist(), sites.field("names")
        start, end, method, head = (spans.field(i).to_pylist() for i in range(4))
        counts = _lengths(names)
        called, site_of = names.flatten(), np.repeat(np.arange(len(line)), counts)
        name_ends = np.cumsum(counts)
        owner, kept = np.full(len(line), -1, np.int64), np.ones(len(called), bool)
        s = m = 0
        for s_end, m_end in zip(site_ends, span_ends):
            inner = sorted(range(m, m_end), key=lambda j: (start[j], -end[j], method[j]))
            heads = {(start[j], head[j]) for j in inner}
            starts = {start[j] for j in inner}
            # A copy of a file repeats its lines; a name counts once per line.
            copied, seen = len(set(line[s:s_end])) < s_end - s, set()
            opened, at = [], 0
            for r in sorted(range(s, s_end), key=line.__getitem__):
                while at < len(inner) and start[inner[at]] <= line[r]:
                    opened.append(inner[at])
                    at += 1
                while opened and end[opened[-1]] < line[r]:
                    opened.pop()
                if opened:
                    owner[r] = opened[-1]
                if copied or line[r] in starts:
                    for i in range(name_ends[r] - counts[r], name_ends[r]):
                        site = (line[r], called[i].as_py())
                        kept[i] = site not in heads and site not in seen
                        if copied:
                            seen.add(site)
            s, m = s_end, m_end
        at = np.flatnonzero(kept & (owner[site_of] >= 0))
        file = np.repeat(np.arange(batch.num_rows), _lengths(batch.column("sites")))[site_of[at]]
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(c).take(pa.array(file)) for c in ("service_id", "file_path")),
                spans.field("method_id").take(pa.array(owner[site_of[at]])),
                called.take(pa.array(at)),
                sites.field("line").take(pa.array(site_of[at])),
            ],
            [c.split()[0] for c in _SITES.split(", ")],
        )


def script_calls(files: DataFrame, methods: DataFrame) -> DataFrame:
    """Call sites of the languages matched by line, C and C++ excepted.

    ``files`` carry ``parser``; ``methods`` are those of the same files. A site belongs to the
    innermost method whose lines hold it; a site outside every method, so also one in the body of
    a test or mock, is left out. A name repeated on one line counts once, a method's own
    head isn't a call. Calls inside template literals and in continued block comments without a
    leading star aren't told apart from text.

    The names are found inside the array of lines, never with the text. The sites of a file meet its
    methods as two arrays of one row, where one walk over the lines finds the innermost.
    """
    code = F.transform(tx.split_lines(F.col("content")), _code_of_line)
    pattern, words = F.lit(None).cast("string"), F.array().cast("array<string>")
    for is_lang, expression in _per_language(CALL_SITES):
        pattern = F.when(is_lang, "(?U)" + expression).otherwise(pattern)
    for is_lang, known in _per_language(NOT_A_CALL):
        words = F.when(is_lang, F.array(*map(F.lit, known))).otherwise(words)

    def names(line: Column) -> Column:
        defines = line.contains("fn") | line.contains("func") | line.contains("def")
        code = tx.replaced_if(defines, line, "(?U)" + DEFINED_NAME, ";")
        return F.array_except(F.regexp_extract_all(code, F.col("pattern"), F.lit(1)), F.col("words"))

    sites = F.filter(
        F.transform(code, lambda line, at: F.struct((at + 1).alias("line"), names(line).alias("names"))),
        lambda site: F.size(site["names"]) > 0,
    )
    ruled = (
        files.select("*", pattern.alias("pattern"), words.alias("words"))
        .where(F.col("pattern").isNotNull())
        .withColumn("service_id", F.col("repo_id"))
    )
    keys = ["service_id", "file_path"]
    span = F.struct("line_start", "line_end", "method_id", "name")
    spans = methods.groupBy(*keys).agg(F.collect_list(span).alias("spans"))
    return _by_file(ruled, keys, sites, "sites").join(spans, keys).mapInArrow(_sites_in_spans, _SITES)


def parsed_methods_and_calls(
    files: DataFrame, grammar: Grammar | None = None, settle: Settle = _unsettled, name: str = "parsed"
) -> tuple[DataFrame, DataFrame]:
    """Methods and call sites of files that a real parser reads, Python unless told otherwise."""
    facts = settle(
        files.select(
            "repo_id", "file_path",
            parsed_facts(grammar)(F.col("parser"), F.col("content")).alias("facts"),
        ),
        name,
    )
    methods = tx.exploded(facts, ["repo_id", "file_path"], F.col("facts.methods"), "m").select(
        _method_id(F.col("m.full_name")).alias("method_id"),
        _legacy_id(F.col("m.full_name")).alias("legacy_id"),
        F.col("repo_id").alias("service_id"),
        "file_path",
        F.col("m.class_name").alias("class_name"),
        F.col("m.name").alias("name"),
        F.col("m.full_name").alias("full_name"),
        F.col("m.signature").alias("signature"),
        F.col("m.docstring").alias("docstring"),
        F.col("m.line_start").alias("line_start"),
        F.col("m.line_end").alias("line_end"),
    )
    calls = tx.exploded(facts, ["repo_id", "file_path"], F.col("facts.calls"), "c").select(
        F.col("repo_id").alias("service_id"),
        "file_path",
        _method_id(F.col("c.caller")).alias("caller_id"),
        F.col("c.callee_name").alias("callee_name"),
        F.col("c.line").alias("line"),
    )
    return methods, calls


def parser_of(path: Column) -> Column:
    pairs = [F.lit(x) for pair in SUFFIX_PARSER.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), tx.suffix(path))


def with_parser(files: DataFrame) -> DataFrame:
    """Files the method graph reads, with the parser their suffix selects."""
    return files.withColumn("parser", parser_of(F.col("file_path"))).where(
        F.col("parser").isNotNull()
    )


def extract_methods(
    files: DataFrame,
    grammar: Grammar | None = None,
    grammar_parsers: Sequence[str] = (),
    body_limit: int | None = BODY_LIMIT,
    builtins: DataFrame | None = None,
    settle: Settle = _unsettled,
) -> tuple[DataFrame, DataFrame]:
    """Methods and call sites of all files (``repo_id, file_path, content``).

    Files of ``grammar_parsers`` go to ``grammar``, other Python files to Python's own parser,
    the rest is matched by line. A method defined twice under one id keeps its last definition.
    Calls of a name in ``builtins(parser, callee_name)`` are left out. ``settle(rows, name)``
    writes what methods and call sites share, so that no file is parsed twice.
    """
    from codeloom.operators.calls import drop_builtins
    from codeloom.operators.keyed import keep_last

    known = with_parser(files)
    by_grammar = F.col("parser").isin(list(grammar_parsers)) if grammar_parsers else F.lit(False)
    rest = known.where(~by_grammar)
    methods, calls = parsed_methods_and_calls(rest.where(F.col("parser") == "python"), settle=settle)
    other = settle(scripted_methods(rest, body_limit), "scripted")
    in_cpp = parser_of(F.col("file_path")) == "cpp"
    methods = methods.unionByName(other)
    calls = calls.unionByName(cpp_calls(rest, other.where(in_cpp)))
    calls = calls.unionByName(script_calls(rest, other.where(~in_cpp)))
    if grammar_parsers:
        more_methods, more_calls = parsed_methods_and_calls(
            known.where(by_grammar), grammar, settle, "parsed_by_grammar"
        )
        methods, calls = methods.unionByName(more_methods), calls.unionByName(more_calls)
    if builtins is not None:
        told = calls.withColumn("parser", parser_of(F.col("file_path")))
        calls = drop_builtins(told, builtins.select("parser", "callee_name")).select(*calls.columns)
    return keep_last(methods, ["method_id"], "line_start", "line_end"), calls
