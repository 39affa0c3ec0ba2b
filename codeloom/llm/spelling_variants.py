"""Spelling variants: words one edit apart, found by Gram matrices of letter counts.

Each word is a vector of letter counts. An inserted or deleted letter moves it by 1, a replaced one
by a squared distance of 2, so near words lie in one length block or in adjacent ones, at most 2
apart. NumPy multiplies a block's count matrix with that of its visitors; with the squared norms
the product gives all squared distances at once. Pairs of at most 2 are kept, and their letters
compared in place: one edit must turn one word into the other.

A length block is split into cells so that its work isn't the square of the vocabulary. The letters
fall into ``GROUPS`` groups of like frequency, and a cell is one vector of counts per group, packed
into a long. One edit adds one to a group, or moves one between two groups, so a word meets every
near word if it is at home in its cell and visits the cells at one of those steps, each pair of
cells from one side only. Words of more than ``PACKED`` letters have their whole length as a cell.

A cell above ``TILE`` words is cut into tiles, and the visitors from a cell of many tiles into
slices, so no task holds more than a tile's matrix and none reads more than ``SLICE`` tiles of
each neighbour. Rows are streamed, sorted by cell, tile and slice; nothing is dropped.

Defined results: null and blank texts have no words; a null doc_id counts as the empty string in the
checksum; repeated rows count each time; ties of the count go to the smallest word by code point; an
empty table gives no rows. Other columns are left out. A word of L letters has at most 90 * (2 L + 1) near
words, which bounds how many words share a form.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.text import exploded
from codeloom.llm.base import Scratch, ascii_lower, query, table

MIN_LETTERS = 7
MIN_COUNT = 2
#: A form is at least this many times as frequent as its variant.
RATIO = 10
GROUPS = 6
TILE = 4096
SLICE = 16
#: Letters of a run beside which a tile counts as full: TILE * WIDE letters.
WIDE = 64
BITS = 10
PACKED = 2**BITS - 2
#: Elements of one product, and candidate pairs compared at a time.
PRODUCT = 4_000_000
PAIRS = 200_000
DAMAGE = 31

_LETTERS = [*range(97, 123), *range(0xC0, 0x100)]
#: Column of each letter; others share the last one, which only makes distances smaller.
_COLUMN = np.full(256, len(_LETTERS), np.int64)
_COLUMN[_LETTERS] = np.arange(len(_LETTERS))


def runs(docs: DataFrame) -> DataFrame:
    """(doc_id, run): runs of at least MIN_LETTERS letters, A-Z lowered."""
    found = F.regexp_extract_all(F.col("text"), F.lit(f"[A-Za-zÀ-ÿ]{{{MIN_LETTERS},}}"), F.lit(0))
    rows = exploded(docs, ["doc_id"], found, "run")
    plain = F.octet_length("run") == F.char_length("run")
    return rows.select("doc_id", F.when(plain, F.lower("run")).otherwise(ascii_lower(F.col("run"))).alias("run"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): the runs, a letter less where their checksum says so, that occur often enough."""
    sum_ = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")))
    rows = runs(docs).select("run", sum_.alias("h"))
    place = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.char_length("run")))
    words = rows.select(F.when(F.col("h") % DAMAGE == 0, cut).otherwise(F.col("run")).alias("word"))
    counted = words.where(F.char_length("word") >= MIN_LETTERS).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= MIN_COUNT)


def letter_groups(words: DataFrame, groups: int) -> list[str]:
    """The letters of all words in ``groups`` strings of like frequency; at most 90 rows are collected."""
    letters = exploded(words, [], F.split("word", ""), "letter").where(F.col("letter") != "").groupBy("letter").count()
    load, out = [0] * groups, [""] * groups
    for row in sorted(letters.collect(), key=lambda r: (-r["count"], r["letter"])):
        least = load.index(min(load))
        load[least] += row["count"]
        out[least] += row["letter"]
    return out


def _cell(word: Column, groups: list[str]) -> Column:
    size = F.char_length(word).cast("long")
    packed = F.lit(0).cast("long")
    for i, letters in enumerate(groups):
        if letters:
            packed = packed + F.shiftleft(size - F.char_length(F.translate(word, letters, "")).cast("long"), BITS * i)
    return F.when(size <= PACKED, packed).otherwise(-size)


def _neighbours(size: Column, cell: Column, groups: int) -> Column:
    """Cells that a word of a cell visits: one letter more, or one moved to a group of lower number."""
    longer = [F.when(size < PACKED, cell + (1 << BITS * i)) for i in range(groups)]
    moved = [
        F.when((size <= PACKED) & (F.shiftright(cell, BITS * j).bitwiseAND(2**BITS - 1) > 0), cell + ((1 << BITS * i) - (1 << BITS * j)))
        for i in range(groups)
        for j in range(i + 1, groups)
    ]
    beyond = F.when(size >= PACKED, -(size + 1))
    return F.array_compact(F.array(*longer, *moved, beyond))


def meetings(words: DataFrame, groups: list[str], tile: int = TILE, slice_: int = SLICE) -> DataFrame:
    """(cell, tile, slice, visits, word, n): who meets in which product; ``word`` in one byte a letter."""
    size = F.char_length("word").cast("long")
    rows = words.select("word", "n", size.alias("size"), _cell(F.col("word"), groups).alias("cell"))
    near = lambda: _neighbours(F.col("size"), F.col("cell"), len(groups))
    weight = F.greatest(F.count("*") / tile, F.sum("size") / (tile * WIDE))
    hot = rows.groupBy("cell", "size").agg(F.ceil(weight).cast("int").alias("tiles")).where(F.col("tiles") > 1)
    hot = Scratch(words.sparkSession, "spelling-cells").settle("hot", hot)
    seen = hot.select(F.explode(F.concat(F.array("cell"), near())).alias("seen"), F.ceil(F.col("tiles") / slice_).cast("int").alias("slices"))
    seen = seen.groupBy("seen").agg(F.max("slices").alias("slices")).where(F.col("slices") > 1)

    placed = rows.join(hot.select("cell", "tiles"), "cell", "left")
    tiles = F.coalesce("tiles", F.lit(1))
    placed = placed.withColumn("tile", F.pmod(F.xxhash64("word"), tiles).cast("int"))
    raw = F.encode("word", "ISO-8859-1").alias("word")
    home = placed.join(seen.withColumnRenamed("seen", "cell"), "cell", "left")
    home = exploded(home, ["cell", "tile", "word", "n"], F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1), "slice")
    home = home.select("cell", "tile", "slice", F.lit(0).alias("visits"), raw, "n")

    own = (F.floor(F.col("tile") / slice_).cast("int")).alias("slice")
    out = exploded(placed, ["tile", "word", "n"], near(), "to").select(F.col("to").alias("cell"), own, "word", "n")
    out = out.join(hot.select("cell", "tiles"), "cell", "left")
    out = exploded(out, ["cell", "slice", "word", "n"], F.sequence(F.lit(0), F.coalesce("tiles", F.lit(1)) - 1), "tile")
    later = F.when(F.col("tile") + 1 < F.col("tiles"), F.sequence(F.col("tile") + 1, F.col("tiles") - 1))
    among = exploded(placed.where("tiles > 1").select("*", own), ["cell", "slice", "word", "n"], later, "tile")
    visitors = out.unionByName(among).select("cell", "tile", "slice", F.lit(1).alias("visits"), raw, "n")
    return home.unionByName(visitors)


class _Words:
    """Words as a padded matrix of their bytes, with counts of letters and occurrences."""

    def __init__(self, raw: np.ndarray, bounds: np.ndarray, n: np.ndarray):
        self.n, self.size = n, np.diff(bounds)
        width = int(self.size.max(initial=0))
        self.letters = np.zeros((len(n), width), np.uint8)
        self.letters[np.arange(width) < self.size[:, None]] = raw[bounds[0] : bounds[-1]]

    def counts(self) -> np.ndarray:
        """Letter counts; float32 is exact while a product of two rows stays below 2**24."""
        rows, n, width = np.repeat(np.arange(len(self.n)), self.size), len(self.n), len(_LETTERS) + 1
        columns = _COLUMN[self.letters[np.arange(self.letters.shape[1]) < self.size[:, None]]]
        kind = np.float32 if self.letters.shape[1] < 4096 else np.float64
        return np.bincount(rows * width + columns, minlength=n * width).reshape(n, width).astype(kind)


def one_edit(a: np.ndarray, b: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """Whether rows of ``a`` turn into those of ``b`` by one edit; ``longer``: a has one letter more than b."""
    width = b.shape[1]
    apart = a[:, :width] != b
    replaced = (apart.sum(1) == 1) & ~longer
    if not longer.any():
        return replaced
    at = np.flatnonzero(longer)
    first = np.where(apart[at].any(1), apart[at].argmax(1), width)
    shifted = np.zeros((len(at), width), np.uint8)
    shifted[:, : a.shape[1] - 1] = a[at, 1 : width + 1]
    behind = shifted != b[at]
    last = np.where(behind.any(1), width - 1 - behind[:, ::-1].argmax(1), -1)
    replaced[at] = last < first
    return replaced


def _near(home: _Words, counts: np.ndarray, other: _Words | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of home, rows of other) one edit apart; without other, each pair of home once."""
    norms = (counts * counts).sum(1)
    guests = counts if other is None else other.counts()
    guest_norms = norms if other is None else (guests * guests).sum(1)
    them = home if other is None else other
    width = max(home.letters.shape[1], them.letters.shape[1])
    pad = lambda m: m if m.shape[1] == width else np.pad(m, ((0, 0), (0, width - m.shape[1])))
    mine, theirs = pad(home.letters), pad(them.letters)
    step = max(PRODUCT // max(len(counts), 1), 1)
    for low in range(0, len(guests), step):
        part = slice(low, low + step)
        gram = counts @ guests[part].T
        squared = norms[:, None] + guest_norms[None, part]
        squared -= 2 * gram
        i, j = np.nonzero(squared <= 2)
        j += low
        if other is None:
            once = i < j
            i, j = i[once], j[once]
        for first in range(0, len(i), max(PAIRS * 16 // width, 1)):
            a, b = i[first : first + max(PAIRS * 16 // width, 1)], j[first : first + max(PAIRS * 16 // width, 1)]
            found = one_edit(mine[a], theirs[b], home.size[a] == them.size[b] + 1) & (home.size[a] >= them.size[b])
            yield a[found], b[found]


def _best(words: _Words, of: np.ndarray, near: np.ndarray, near_words: _Words) -> tuple[list, ...]:
    """Per word with near ones: itself, their number, and the most frequent of them with its count."""
    text = near_words.letters[near].view(f"S{near_words.letters.shape[1]}").ravel()
    order = np.lexsort((text, -near_words.n[near], of))
    of, near = of[order], near[order]
    first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
    say = lambda w, i: w.letters[i].view(f"S{w.letters.shape[1]}").ravel().tolist()
    return say(words, of[first]), np.diff(np.append(first, len(of))), near_words.n[near[first]], say(near_words, near[first])


NEAR = "word binary, near long, best_n long, best binary"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Products of each cell's home words with themselves and with their visitors, as these arrive."""
    key, home, counts = None, None, None

    def told(words: _Words, of: np.ndarray, near: np.ndarray, near_words: _Words) -> Iterator[pa.RecordBatch]:
        if len(of):
            columns = _best(words, of, near, near_words)
            types = (pa.binary(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["word", "near", "best_n", "best"])

    def both(found: Iterator[tuple[np.ndarray, np.ndarray]], other: _Words) -> Iterator[pa.RecordBatch]:
        pairs = list(found)
        if not pairs:
            return
        a, b = (np.concatenate(x) for x in zip(*pairs))
        if other is home:
            yield from told(home, np.concatenate((a, b)), np.concatenate((b, a)), home)
        else:
            yield from told(home, a, b, other)
            yield from told(other, b, a, home)

    waiting: list[_Words] = []

    def settle() -> Iterator[pa.RecordBatch]:
        """The home words have all come: join their pieces and compare them with each other."""
        nonlocal home, counts, waiting
        if waiting:
            sizes = np.concatenate([w.size for w in waiting])
            raw = np.concatenate([w.letters[np.arange(w.letters.shape[1]) < w.size[:, None]] for w in waiting])
            home = _Words(raw, np.concatenate(([0], np.cumsum(sizes))), np.concatenate([w.n for w in waiting]))
            counts, waiting = home.counts(), []
            if key[2] == 0:  # the other slices hold the same home words
                yield from both(_near(home, counts, None), home)

    for batch in batches:
        rows = pa.table([batch.column("word").cast(pa.large_binary())], ["word"]).column(0).combine_chunks()
        _, offsets, data = rows.buffers()
        bounds = np.frombuffer(offsets, np.int64)[rows.offset : rows.offset + len(rows) + 1]
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("cell", "tile", "slice", "visits")])
        n = batch.column("n").to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(np.concatenate(([True], (keys[:, 1:] != keys[:, :-1]).any(0)))) if len(n) else []
        for low, high in zip(edges, [*edges[1:], len(n)]):
            own, visits = tuple(keys[:3, low]), keys[3, low]
            if own != key:
                yield from settle()
                key, home, counts = own, None, None
            if visits and not waiting and home is None:
                continue
            part = _Words(raw, bounds[low : high + 1], n[low:high])
            if visits:
                yield from settle()
                yield from both(_near(home, counts, part), part)
            else:
                waiting.append(part)
    yield from settle()


def near_words(words: DataFrame, groups: int = GROUPS, tile: int = TILE, slice_: int = SLICE) -> DataFrame:
    """(word, n_near, best_n, best) of every word of ``words`` (word, n) that is one edit from another."""
    rows = meetings(words, letter_groups(words, groups), tile, slice_)
    keys = ["cell", "tile", "slice"]
    found = rows.repartition(*keys).sortWithinPartitions(*keys, "visits").mapInArrow(_compare, NEAR)
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("w")))
    one = found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b"))
    text = lambda c: F.decode(c, "ISO-8859-1")
    return one.select(text(F.col("word")).alias("word"), "n_near", (-F.col("b.n")).alias("best_n"), text(F.col("b.w")).alias("best"))


def group(words: DataFrame, ratio: int = RATIO, **sizes: int) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every row of ``words`` (word, n).

    The words are distinct, not empty, and their letters below U+0100.

    Each form is ``ratio`` times as frequent as its word, so chains of forms have at most 18 links and
    five doublings of the reach find every root.
    """
    scratch = Scratch(words.sparkSession, "spelling")
    words = scratch.settle("words", words)
    near = words.join(near_words(words, **sizes), "word", "left")
    takes = F.col("best_n") >= ratio * F.col("n")
    near = scratch.settle(
        "near",
        near.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(takes, F.col("best")).alias("form"), F.when(takes, F.col("best_n")).alias("form_n"),
        ),
    )
    reach = near.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    for step in range(5):
        reach = scratch.settle(f"reach-{step}", reach)
        onward = reach.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if reach.join(onward, "root", "left_semi").isEmpty():
            break
        reach = reach.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
    reach = scratch.settle("roots", reach)
    scratch.drop("words", *(f"reach-{k}" for k in range(step + 1)))
    rows = near.join(reach, "word", "left")
    return rows.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


SQL = r"""
WITH RECURSIVE r AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
d AS (SELECT run, count(*) AS n, list_transform(string_split(id || ':' || run, ''), lambda c: unicode(c)) AS points
    FROM r WHERE length(run) >= 7 GROUP BY id, run),
h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(points,
    lambda c: CASE WHEN c < 128 THEN [c::BIGINT] ELSE [195::BIGINT, c::BIGINT - 64] END))),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) AS h FROM d),
c AS (SELECT CASE WHEN h % 31 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM h),
w AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM c WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
x AS MATERIALIZED (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS cut FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT a.word, b.word AS near, b.n FROM x a JOIN x b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
    UNION SELECT x.word, w.word, w.n FROM x JOIN w ON x.cut = w.word
    UNION SELECT w.word, x.word, x.n FROM x JOIN w ON x.cut = w.word),
s AS (SELECT word, count(*) AS n_near, max(n) AS best_n, first(near ORDER BY n DESC, near) AS best FROM p GROUP BY word),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * w.n THEN best END AS form,
    CASE WHEN best_n >= 10 * w.n THEN best_n END AS form_n FROM w LEFT JOIN s ON s.word = w.word),
t AS (SELECT word, word AS root, form AS up FROM f UNION ALL SELECT t.word, f.word, f.form FROM t JOIN f ON f.word = t.up)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN t ON t.word = f.word AND t.up IS NULL
"""


@query(SQL)
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group(word_counts(table(spark, sf_dir, "documents")))
