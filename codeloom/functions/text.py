"""Line and text expressions, all evaluated on the JVM side."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The line terminators of Python's str.splitlines.
LINE_END = r"(?:\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029])"
RARE_LINE_END = r"[\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"

# Words counted to tell writes from reads after a connection call.
WRITE_WORDS = ("insert", "update", ".save", ".create", "publish", "send")
READ_WORDS = ("select", "find", ".get", "query", "receive", "consume")
DIRECTION_WINDOW = 2000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value`` evaluated once.

    An expression used inside a lambda is evaluated again for every element; bound this way it
    becomes the lambda's own argument.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def replaced_if(wanted: Column, text: Column, pattern: str, by: str) -> Column:
    """``text`` with a pattern replaced where ``wanted`` holds: a cheap test that spares the pattern."""
    return let(text, lambda t: F.when(wanted, F.regexp_replace(t, pattern, by)).otherwise(t))


def exploded(rows: DataFrame, keep: Sequence[str], array: Column, name: str) -> DataFrame:
    """One row per array element, none for an empty array.

    The outer form with a test of the element avoids the filter on the array that Spark adds
    to a plain explode, which would evaluate an expensive array expression a second time.
    """
    return rows.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def split_lines(text: Column) -> Column:
    """Lines of a text; a final terminator opens no further line, '' has no lines."""
    body = F.regexp_replace(text, LINE_END + r"\z", "")
    # Most texts know one terminator only, which needs no pattern.
    unended = F.when(text.endswith("\n"), F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    return (
        F.when(text == "", F.array().cast("array<string>"))
        .when(text.rlike(RARE_LINE_END), F.split(body, LINE_END, -1))
        .otherwise(F.split(unended, "\n", -1))
    )


def line_range(lines: Column, first: Column, last: Column) -> Column:
    """Lines ``first..last`` (1-based, inclusive), clamped to what exists."""
    begin = F.greatest(first, F.lit(1))
    length = F.greatest(F.least(last, F.size(lines)) - begin + 1, F.lit(0))
    return F.slice(lines, begin, length)


def join_lines(lines: Column) -> Column:
    return F.array_join(lines, "\n")


def text_range(text: Column, first: Column, last: Column) -> Column:
    """The text of lines ``first..last``."""
    return let(split_lines(text), lambda lines: join_lines(line_range(lines, first, last)))


def has_ink(text: Column) -> Column:
    """True where the text holds anything but white space."""
    return text.rlike(r"(?U)\S")


def occurrences(text: Column, needle: str) -> Column:
    """Number of non-overlapping occurrences of a fixed string."""
    removed = F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))
    return (removed / F.lit(len(needle))).cast("int")


def _tally(text: Column, words: tuple[str, ...]) -> Column:
    total = F.lit(0)
    for word in words:
        total = total + occurrences(text, word)
    return total


def io_direction(text: Column, position: Column, window: int = DIRECTION_WINDOW) -> Column:
    """'write' if write words outnumber read words in the ``window`` characters from ``position``."""
    near = F.lower(F.substring(text, position, F.lit(window)))
    return F.when(_tally(near, WRITE_WORDS) > _tally(near, READ_WORDS), "write").otherwise("read")


def blank_code(text: Column) -> Column:
    """Empty string literals, then drop ``//``, ``#`` and block comments.

    The loops are possessive: the two alternatives of a string body cannot overlap, so
    nothing is lost, and a long unterminated literal cannot exhaust the regex stack.
    No step adds a mark that the text has not, so a step whose mark is missing is skipped.
    """
    out = text
    for quote in ('"', "'", "`"):
        literal = rf"(?<!\\){quote}[^{quote}\\]*+(?:\\[^\n][^{quote}\\]*+)*+{quote}"
        out = replaced_if(text.contains(quote), out, literal, quote * 2)
    out = replaced_if(text.contains("//"), out, r"//[^\n]*", "")
    out = replaced_if(text.contains("#"), out, r"#[^\n]*", "")
    return replaced_if(text.contains("/*"), out, r"(?s)/\*.*?\*/", "")


def _first_group(text: Column, pattern: str, group: int) -> Column:
    found = F.regexp_extract(text, pattern, group)
    return F.when(found != "", found)


def base_name(path: Column) -> Column:
    # The pattern is for the few paths whose end isn't a name's.
    plain = ~F.right(path, F.lit(1)).isin("/", "\n", "\r", "\x85", "\u2028", "\u2029")
    return F.when(plain, F.substring_index(path, "/", -1)).otherwise(F.regexp_extract(path, r"([^/]*)/*$", 1))


def stem(path: Column) -> Column:
    """File name without its last suffix; a leading dot is not a suffix."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]+$", "")


def suffix(path: Column) -> Column:
    """Last suffix with its dot, '' when there is none."""
    return F.regexp_extract(base_name(path), r".(\.[^.]+)$", 1)


def database_name(text: Column, kind: Column) -> Column:
    """Database name in a connection string, NULL when the text names none."""
    quoted_word = r"(['\"]?)(\w+)\1"
    sqlite = base_name(_first_group(text, r"sqlite3\.connect\(['\"]([^'\"]+)['\"]\)", 1))
    chroma = base_name(_first_group(text, r"path=['\"]([^'\"]+)['\"]", 1))
    postgres = F.coalesce(
        _first_group(text, "dbname=" + quoted_word, 2),
        _first_group(text, "database=" + quoted_word, 2),
    )
    mongo = _first_group(text, r"/(\w+)\?", 1)
    found = (
        F.when(kind == "sqlite", sqlite)
        .when(kind == "chromadb", chroma)
        .when(kind == "postgres", postgres)
        .when(kind == "mongodb", mongo)
    )
    return F.when(found != "", found)


def queue_name(text: Column) -> Column:
    """Queue name in the text, NULL when none of the known forms occurs."""
    refs = [
        _first_group(text, key + r"\s*=\s*(['\"])([^'\"]+)\1", 2)
        for key in ("QueueUrl", "queue_url", "queue_name", "queue")
    ]
    refs.append(_first_group(text, r"https?://sqs\.[^/]+/\d+/([a-zA-Z0-9_-]+)", 1))
    last = F.element_at(F.split(F.coalesce(*refs), "/"), -1)
    return F.when(last != "", last)


def elide_middle(text: Column, limit: int = 100) -> Column:
    """First and last ``limit/2`` lines of a text that has more than ``limit``."""
    half = limit // 2

    def shorten(lines: Column) -> Column:
        count = F.size(lines)
        marker = F.concat(
            F.lit("... ("), (count - limit).cast("string"), F.lit(" lines truncated) ...")
        )
        ends = F.concat(F.slice(lines, 1, half), F.array(marker), F.slice(lines, -half, half))
        return F.when(count > limit, join_lines(ends)).otherwise(text)

    return let(split_lines(text), shorten)


def absolute_path(path: Column, root: Column) -> Column:
    """A path under its repository root; absolute paths and unknown roots stay as they are."""
    return F.when(
        path.startswith("/") | root.isNull() | (root == ""), path
    ).otherwise(F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"), path))


def document_title(path: Column, symbol: Column, first: Column, last: Column) -> Column:
    place = F.concat(F.lit("L"), first.cast("string"), F.lit("-"), last.cast("string"))
    return F.concat(path, F.lit(":"), F.when(symbol != "", symbol).otherwise(place))


def document_prompt(text: Column, title: Column) -> Column:
    return F.concat(
        F.lit("title: "), F.coalesce(title, F.lit("none")), F.lit(" | text: "), text
    )
