"""Benchmark decontamination by winnowing.

Words are runs of letters, digits and non-ASCII characters, A-Z lowered. Of every window of
``SPAN - GRAM + 1`` consecutive GRAM-word hashes a text publishes the smallest, with its place. Two texts
that share SPAN words in a row share such a window, so they publish a common fingerprint at the
same place of the shared span: no shared span of that length is missed. Items of fewer words
are found by their own length in the same way, with every gram of that length published.

Documents meet the benchmark on fingerprints. A meeting fixes a diagonal (place in the document
less place in the item); along it the document's words are compared with the item's, one by
one, and every full window of equal words counts. Only documents with a meeting are read again.

A published gram is one of the text's own, so texts first test all their grams against a bitmap of
the benchmark's fingerprints; only those with a gram in it, nearly none, take their minima. The
bitmap's size follows the number of fingerprints up to ``MOST_BITS``; a full one only lets more texts
through. Words are cut, counted and hashed in one scan, whatever lengths the items have.

Sizes: the benchmark's fingerprints, and the ids of documents that met it, are broadcast while
their bytes are below a limit and shuffled beyond it. No fingerprint, however common,
is dropped; a document's meetings are collapsed to one row per (item, diagonal).

Defined results: a null text has no words; a document without hits has n_hit and n_items 0,
``contaminated`` false and the digest of an empty list; repeated document rows are all
returned; equal item ids count once; a null item id is the empty string; an empty benchmark hits
nothing. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.text import exploded, let
from codeloom.llm.base import Scratch, ascii_lower, query, table

SPAN = 10
GRAM = 5
#: Tables up to these bytes are broadcast.
BROADCAST_BYTES = 32_000_000
MOST_BITS = 1 << 22
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def match_words(text: Column) -> Column:
    """Words compared with the benchmark; the letters of an ASCII text are lowered the quick way."""
    whole = F.coalesce(text, F.lit(""))
    lowered = F.when(F.octet_length(whole) == F.char_length(whole), F.lower(whole)).otherwise(ascii_lower(whole))
    return F.filter(F.split(lowered, _BREAK), lambda w: w != "")


def _grams(hashes: Column, gram: int) -> Column:
    last = F.size(hashes) - (gram - 1)
    return F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(hashes, i, gram)))


def _chosen(g: Column, around: int) -> Column:
    """(h, place) of the grams that are the minimum of a window of ``around`` grams.

    A gram is chosen when it equals the largest of the minima of all windows that hold it.
    """
    minima = F.transform(F.sequence(F.lit(1), F.size(g) - (around - 1)), lambda i: F.array_min(F.slice(g, i, around)))

    def among(m: Column) -> Column:
        first = lambda i: F.greatest(i - (around - 2), F.lit(1))
        top = lambda i: F.array_max(F.slice(m, first(i), i + 2 - first(i)))
        return F.filter(_placed(g, lambda x, i: x == top(i)), lambda x: x.isNotNull())

    return let(minima, among)


def _placed(g: Column, where: Callable[[Column, Column], Column]) -> Column:
    return F.transform(g, lambda x, i: F.when(where(x, i), F.struct(x.alias("h"), i.alias("place"))))


def fingerprints(hashes: Column, spans: list[int], known: Callable[[Column], Column] | None = None) -> Column:
    """(span, h, place) of each span's fingerprints; gram places count from 0.

    Spans below SPAN publish all grams of their own length. known: whether the benchmark may have a
    gram; without such a gram nothing is published, and the minima are not taken.
    """
    known = known or (lambda h: F.lit(True))

    def of(span: int) -> Column:
        gram = min(GRAM, span) if span == SPAN else span
        around = span - gram + 1

        def published(g: Column) -> Column:
            if around > 1:
                return F.when(F.exists(g, known), _chosen(g, around))
            return F.filter(_placed(g, lambda x, _: known(x)), lambda x: x.isNotNull())

        found = F.when(F.size(hashes) >= span, let(_grams(hashes, gram), published))
        told = F.transform(found, lambda x: F.struct(F.lit(span).alias("span"), x["h"].alias("h"), x["place"].alias("place")))
        return F.coalesce(told, F.array().cast("array<struct<span:int,h:bigint,place:int>>"))

    return F.concat(*map(of, spans))


def _small(rows: DataFrame, size: Column) -> DataFrame:
    """``rows``, to be broadcast if the sum of ``size``, their bytes, is below the limit; they are a settled table."""
    return F.broadcast(rows) if (rows.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES else rows


def _bitmap(marks: DataFrame) -> Callable[[Column], Column]:
    """Test whether a gram may be among ``marks`` (h): a bit per residue, in a constant of at most MOST_BITS."""
    bits = 1 << 12
    n = marks.count()
    while bits < min(64 * n, MOST_BITS):
        bits *= 2
    place = F.col("h").bitwiseAND(bits - 1)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63).cast("int"))
    words = [0] * (bits // 64)
    for row in marks.groupBy(F.shiftright(place, 6).alias("i")).agg(F.bit_or(one).alias("w")).collect():
        words[row["i"]] = row["w"]
    constant = F.from_json(F.lit(f"[{','.join(map(str, words))}]"), "array<bigint>")

    def known(h: Column) -> Column:
        word = F.get(constant, F.shiftright(h.bitwiseAND(bits - 1), 6).cast("int"))
        return F.call_function("shiftrightunsigned", word, h.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1

    return known


class Benchmark:
    """The items' words and fingerprints, as settled tables."""

    def __init__(self, benchmark: DataFrame, scratch: Scratch):
        items = scratch.settle(
            "items",
            benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), match_words(F.col("text")).alias("w"))
            .where(F.size("w") > 0)
            .distinct()
            .select(F.xxhash64("item_id", "w").alias("item"), "item_id", "w", F.least(F.size("w"), F.lit(SPAN)).alias("own_span")),
        )
        self.spans = sorted((r[0] for r in items.select("own_span").distinct().collect()), reverse=True) or [SPAN]
        hashed = items.select("item", "own_span", F.size("w").alias("width"), F.transform("w", lambda w: F.xxhash64(w)).alias("hashes"))
        marks = exploded(hashed, ["item", "own_span", "width"], fingerprints(F.col("hashes"), self.spans), "f").where("f.span = own_span")
        marks = scratch.settle("marks", marks.select("f.span", "f.h", "item", "width", F.col("f.place").alias("item_place")))
        self.known = _bitmap(marks)
        self.marks = _small(marks, F.lit(40))
        self.items = _small(items, F.octet_length(F.array_join("w", " ")) + 24 * F.size("w") + F.octet_length("item_id") + 40)


def published(docs: DataFrame, items: Benchmark, keep: tuple[Column | str, ...] = ()) -> DataFrame:
    """(doc_id, text_hash, ``keep``, n_words, prints) of every row of ``docs``, from one scan of the texts."""
    hashes = F.transform(match_words(F.col("text")), lambda w: F.xxhash64(w))
    told = let(
        hashes,
        lambda h: F.struct(F.size(h).cast("long").alias("n_words"), fingerprints(h, items.spans, items.known).alias("prints")),
    )
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), *keep, told.alias("_told"))
    return rows.select(*rows.columns[:-1], "_told.n_words", "_told.prints")


def overlaps(docs: DataFrame, items: Benchmark, prints: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, text_hash, n_hit, items) of every distinct document with a hit; items: sorted ids.

    prints: ``published(docs, items)``, settled.
    """
    met = exploded(prints.where(F.size("prints") > 0), ["doc_id", "text_hash"], F.col("prints"), "f").select("doc_id", "text_hash", "f.*")
    met = (
        met.join(items.marks, ["span", "h"])
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_set(F.struct("item", "width", (F.col("place") - F.col("item_place")).alias("shift"))).alias("met"))
        .select(F.col("doc_id").alias("met_id"), F.col("text_hash").alias("met_hash"), "met")
    )
    met = _small(scratch.settle("met", met), 40 + 32 * F.size("met"))

    same_row = F.col("doc_id").eqNullSafe(F.col("met_id")) & (F.col("text_hash") == F.col("met_hash"))
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").join(met, same_row)
    cut = F.transform(
        "met",
        lambda m: F.struct(
            m["item"].alias("item"),
            m["shift"].alias("shift"),
            F.slice("w", F.greatest(m["shift"], F.lit(0)) + 1, m["width"]).alias("span"),
        ),
    )
    worded = texts.select("doc_id", "text_hash", "met", match_words(F.col("text")).alias("w"))
    lines = exploded(worded, ["doc_id", "text_hash"], cut, "m").select("doc_id", "text_hash", "m.*")
    pairs = lines.join(items.items, "item")
    equal = F.transform(F.col("w"), lambda x, j: F.coalesce(F.get("span", j + F.least(F.col("shift"), F.lit(0))) == x, F.lit(False)))
    begins = let(
        equal,
        lambda e: F.filter(
            F.sequence(F.lit(0), F.size("w") - F.col("own_span")),
            lambda i: F.forall(F.slice(e, i + 1, F.col("own_span")), lambda x: x),
        ),
    )
    hit = pairs.select("doc_id", "text_hash", "item_id", "shift", "own_span", begins.alias("begins")).where(F.size("begins") > 0)
    places = F.flatten(F.transform("begins", lambda b: F.sequence(b + F.col("shift"), b + F.col("shift") + F.col("own_span") - 1)))
    hits = (
        hit.select("doc_id", "text_hash", "item_id", F.array_distinct(places).alias("places"))
        .groupBy("doc_id", "text_hash")
        .agg(
            F.size(F.array_distinct(F.flatten(F.collect_list("places")))).cast("long").alias("n_hit"),
            F.sort_array(F.collect_set("item_id")).alias("items"),
        )
    )
    hits = scratch.settle("hits", hits.select(F.col("doc_id").alias("_hit_id"), F.col("text_hash").alias("_hit_hash"), "n_hit", "items"))
    scratch.drop("met", "marks", "items")
    return _small(hits, 64 + F.octet_length(F.array_join("items", ",")))


def contamination(docs: DataFrame, benchmark: DataFrame, keep: tuple[Column | str, ...] = ()) -> DataFrame:
    """One row per document row: doc_id, ``keep``, n_words, n_hit, n_items, items_sha256, contaminated."""
    scratch = Scratch(docs.sparkSession, "winnowing")
    items = Benchmark(benchmark, scratch)
    prints = scratch.settle("prints", published(docs, items, keep))
    found = overlaps(docs, items, prints, scratch)
    rows = prints.drop("prints")
    joined = rows.join(found, F.col("doc_id").eqNullSafe(F.col("_hit_id")) & (F.col("text_hash") == F.col("_hit_hash")), "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        "doc_id",
        *(c for c in rows.columns if c not in ("doc_id", "text_hash", "n_words")),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a hit, with all their columns."""
    scratch = Scratch(docs.sparkSession, "winnowing")
    items = Benchmark(benchmark, scratch)
    prints = scratch.settle("prints", published(docs, items).where(F.size("prints") > 0))
    hits = overlaps(docs, items, prints, scratch)
    return docs.join(hits, F.col("doc_id").eqNullSafe(F.col("_hit_id")) & (F.xxhash64("text") == F.col("_hit_hash")), "left_anti")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT DISTINCT item_id::VARCHAR AS item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
s AS (SELECT item_id, ws, least(len(ws), 10) AS n FROM b WHERE len(ws) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS k
    FROM (SELECT item_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM s)),
dw AS (SELECT rid, i, n, array_to_string(ws[i:i + n - 1], ' ') AS k
    FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM s) WHERE len(ws) >= n)),
h AS (SELECT rid, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.k = bw.k),
p AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM h) GROUP BY rid),
q AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
    FROM (SELECT DISTINCT rid, item_id FROM h) GROUP BY rid)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN p ON p.rid = d.rid LEFT JOIN q ON q.rid = d.rid
"""


@query(SQL)
def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
