"""Interpolated modified Kneser-Ney bigram model, counted in Spark and mapped into memory.

Training makes three passes of counts (hash_counts), each a block count in the tasks, a shuffle of
compressed sorted blocks by key range, and one sum per range:

1. word hashes: the sorted array of a range gives each word its id, its count and, as a running
   sum, its place among all tokens;
2. (context id, word id) pairs; ranges are cut by the places of pass 1, so a context with a
   third of all tokens is spread over a third of the ranges;
3. from the pairs, by id: in how many contexts a word occurs, and how many words follow a context
   once, twice, three times or more.

The model is the sorted key and count arrays of 1 and 2 and the dense arrays of 3, as files in
the shared folder. Workers map them and look words and pairs up in sorted order, so memory
doesn't grow with the corpus. Scoring has no shuffle. A shared folder that is mounted on all
machines is needed.

The order is two. Trigrams would need a third pass and, by an estimate that was not measured, about
twice the disk.

P(w | v) = max(c(vw) - D(c), 0) / c(v) + g(v) P(w), with P(w) of the same form over the
number of contexts of w, and g(v) the mass the discounts of v free; P(w) ends in 1 / (V + 1).

Defined results: a null or blank text is one end token; a null id counts as an empty string in
the choice of training rows; repeated rows count and are scored each; without training rows every
token has probability 1; an empty table gives no rows. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import hash_counts as hc
from codeloom.llm.base import Scratch, query, table
from codeloom.llm.word_hashes import hashed

#: Keys a task counts before it hands them on.
BLOCK = 3_000_000
#: Rows of counts-of-counts that estimate the discounts: seen once to four times.
TIMES = 4


def _hash_range(hashes: np.ndarray, n: int) -> np.ndarray:
    return (((hashes >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def discounts(seen: list[int]) -> list[float]:
    """Discounts for counts 1, 2 and 3 or more from the numbers of keys seen 1 to 4 times."""
    n1, n2, n3, n4 = seen
    if not (n1 and n2 and n3 and n4):
        return [0.5, 0.75, 0.75]
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return [min(max(d, 0.0), k + 1.0) for k, d in enumerate(raw)]


def _discounted(counts: np.ndarray, d: list[float]) -> np.ndarray:
    return counts - np.array([0.0, *d])[np.minimum(counts, 3).astype(np.int64)]


@dataclass
class Model:
    """Where the arrays lie, and the totals of the corpus; small enough to go with each task."""

    folder: str
    ranges: int
    docs: int = 0
    words: int = 0
    tokens: int = 0
    pairs: int = 0
    starts: list[int] = field(default_factory=list)
    places: list[int] = field(default_factory=list)
    pair_discounts: list[float] = field(default_factory=list)
    word_discounts: list[float] = field(default_factory=list)
    word_classes: list[int] = field(default_factory=list)

    @property
    def vocabulary(self) -> int:
        return self.words + (self.docs > 0)

    @property
    def block_ids(self) -> int:
        return (self.words + 2) // self.ranges + 1


class _Lookup:
    """A worker's view of the arrays. Ids: words in hash order, then the end, then the start."""

    def __init__(self, model: Model, with_pairs: bool = True):
        self.model, self.end, self.start = model, model.words, model.words + 1
        self.words = [hc.load(model.folder, f"word-{r}") for r in range(model.ranges)]
        self.counts = [hc.load(model.folder, f"seen-{r}") for r in range(model.ranges)]
        self.sums = [hc.load(model.folder, f"sum-{r}") for r in range(model.ranges)]
        if with_pairs:
            self.pairs = hc.Ranges(model.folder, model.ranges)
            self.by_id = [hc.load(model.folder, f"by-id-{r}") for r in range(model.ranges)]

    def tokens(self, hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
        """Per token with the ends: id (-1 unknown), count, place; and the ends' positions."""
        distinct, back = np.unique(hashes, return_inverse=True)
        ids = np.full(len(distinct), -1, np.int64)
        counts, places = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        ranges = _hash_range(distinct, self.model.ranges)
        for r in np.unique(ranges):
            low, high = np.searchsorted(ranges, [r, r + 1])
            own = self.words[r]
            if len(own):
                at = np.minimum(np.searchsorted(own, distinct[low:high]), len(own) - 1)
                known = own[at] == distinct[low:high]
                ids[low:high] = np.where(known, at + self.model.starts[r], -1)
                counts[low:high] = np.where(known, self.counts[r][at], 0)
                places[low:high] = np.where(known, self.sums[r][at] + self.model.places[r], 0)
        lengths = np.diff(starts)
        ends = np.cumsum(lengths + 1) - 1
        word = np.ones(len(hashes) + len(lengths), bool)
        word[ends] = False
        out = []
        for values, of_end in ((ids, self.end), (counts, self.model.docs), (places, 0)):
            full = np.full(len(word), of_end, np.int64)
            full[word] = values[back]
            out.append(full)
        return *out, ends

    def pair_keys(self, ids: np.ndarray, counts: np.ndarray, places: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """Per token: context id, context count, pair key, and the key's range."""
        context, seen, place = np.roll(ids, 1), np.roll(counts, 1), np.roll(places, 1)
        firsts = np.concatenate(([0], ends[:-1] + 1))
        context[firsts], seen[firsts] = self.start, self.model.docs
        place[firsts] = self.model.tokens - self.model.docs
        keys = (context.astype(np.uint64) << np.uint64(32)) | ids.astype(np.uint64)
        inside = seen * (ids / (self.model.words + 2))
        ranges = ((place + inside) * (self.model.ranges / max(self.model.tokens, 1))).astype(np.int64)
        return context, seen, keys, np.clip(ranges, 0, self.model.ranges - 1)

    def of_ids(self, ids: np.ndarray) -> np.ndarray:
        """Rows: contexts of a word; words following once, twice, three times or more. Ids >= 0."""
        distinct, back = np.unique(ids, return_inverse=True)
        found = np.zeros((4, len(distinct)), np.int64)
        blocks = distinct // self.model.block_ids
        for b in np.unique(blocks):
            low, high = np.searchsorted(blocks, [b, b + 1])
            found[:, low:high] = self.by_id[b][:, distinct[low:high] - b * self.model.block_ids]
        return found[:, back]


def _counted(batches: Iterator[pa.RecordBatch], keys_of, ranges_of) -> Iterator[pa.RecordBatch]:
    """Cuts of the keys of all pieces, BLOCK keys at a time; ranges_of: of (keys, first index of each)."""
    held, size = [], 0

    def flush() -> pa.RecordBatch:
        keys, extra = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
        order = np.argsort(keys, kind="stable")
        keys, extra = keys[order], extra[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        counts = np.diff(np.append(first, len(keys)))
        return hc.batch_of_cuts(list(hc.cuts(keys[first], counts, ranges_of(keys[first], extra[first]))))

    for batch in batches:
        for first, last, words, starts in hashed(batch.column("text")):
            held.append(keys_of(words, starts))
            size += len(held[-1][0])
            if size >= BLOCK:
                yield flush()
                held, size = [], 0
    if size:
        yield flush()


def _every_range(spark: SparkSession, n: int) -> DataFrame:
    """An empty cut of each range, so that each range gets its files."""
    return spark.range(n).select(
        F.col("id").cast("int").alias("range"), F.lit(b"").alias("keys"), F.lit(b"").alias("counts"), F.lit(0).cast("long").alias("n")
    )


def _of_table(rows: pa.Table) -> tuple[int, np.ndarray, np.ndarray]:
    return rows.column("range")[0].as_py(), *hc.uncut(*(rows.column(c).to_pylist() for c in ("keys", "counts", "n")))


def train(docs: DataFrame) -> Model:
    """The model of all rows of ``docs`` (text)."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "kneser-ney")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    model = Model(scratch.local_folder("model"), n)
    folder = model.folder
    texts = docs.select("text")

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _counted(batches, lambda words, _: (words, np.zeros(len(words), np.uint8)), lambda keys, _: _hash_range(keys, n))

    def sum_words(rows: pa.Table) -> pa.Table:
        own, keys, counts = _of_table(rows)
        hc.save(folder, f"word-{own}", keys)
        hc.save(folder, f"seen-{own}", counts.astype(np.uint32 if counts.max(initial=0) < 2**32 else np.uint64))
        hc.save(folder, f"sum-{own}", (np.cumsum(counts) - counts).astype(np.int64))
        return pa.table({"range": pa.array([own], pa.int32()), "n": [len(keys)], "total": [int(counts.sum())]})

    cut = texts.mapInArrow(count_words, hc.CUT).unionByName(_every_range(spark, n))
    found = scratch.settle("words", cut.groupBy("range").applyInArrow(sum_words, hc.RANGE_FILE)).orderBy("range").collect()
    model.docs = texts.count()
    model.words = sum(r["n"] for r in found)
    model.tokens = sum(r["total"] for r in found) + model.docs
    if model.words + 2 >= 2**32:
        raise ValueError("more words than 32-bit ids hold")
    for r in found:
        model.starts.append((model.starts[-1] + before[0]) if model.starts else 0)
        model.places.append((model.places[-1] + before[1]) if model.places else 0)
        before = r["n"], r["total"]

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = _Lookup(model, with_pairs=False)

        def keys_of(words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            _, _, keys, ranges = look.pair_keys(*look.tokens(words, starts))
            return keys, ranges.astype(np.int32)

        yield from _counted(batches, keys_of, lambda _, ranges: ranges)

    by_times = ", ".join(f"n{k} long" for k in range(1, TIMES + 1))

    def times(counts: np.ndarray) -> dict:
        return {f"n{k}": [int((counts == k).sum())] for k in range(1, TIMES + 1)}

    def sum_pairs(rows: pa.Table) -> pa.Table:
        own, keys, counts = _of_table(rows)
        hc.save(folder, f"key-{own}", keys)
        hc.save(folder, f"count-{own}", counts.astype(np.uint32 if counts.max(initial=0) < 2**32 else np.uint64))
        return pa.table({"range": pa.array([own], pa.int32()), "n": [len(keys)], **times(counts)})

    cut = texts.mapInArrow(count_pairs, hc.CUT).unionByName(_every_range(spark, n))
    pairs = scratch.settle("pairs", cut.groupBy("range").applyInArrow(sum_pairs, f"range int, n long, {by_times}"))
    total = pairs.agg(F.sum("n"), *(F.sum(f"n{k}") for k in range(1, TIMES + 1))).first()
    model.pairs, model.pair_discounts = total[0], discounts(list(total[1:]))
    width = model.block_ids

    def count_by_id(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in batch.column("id").to_pylist():
                keys, counts = hc.load(folder, f"key-{own}")[:], hc.load(folder, f"count-{own}")[:]
                kinds = [keys & np.uint64(2**32 - 1)] + [
                    keys[of] >> np.uint64(32) for of in (counts == 1, counts == 2, counts >= 3)
                ]
                for kind, ids in enumerate(kinds):
                    ids, sums = hc.summed(ids)
                    yield hc.batch_of_cuts([(r * 4 + kind, k, c, m) for r, k, c, m in hc.cuts(ids, sums, (ids // np.uint64(width)).astype(np.int64))])

    def sum_by_id(rows: pa.Table) -> pa.Table:
        block = rows.column("block")[0].as_py()
        dense = np.zeros((4, width), np.uint32)
        for kind in range(4):
            part = rows.filter(pa.compute.equal(rows.column("kind"), kind))
            ids, sums = hc.uncut(*(part.column(c).to_pylist() for c in ("keys", "counts", "n")))
            dense[kind, (ids - np.uint64(block * width)).astype(np.int64)] = sums
        hc.save(folder, f"by-id-{block}", dense)
        contexts = dense[0]
        classes = {f"c{k}": [int((contexts == k if k < 3 else contexts >= 3).sum())] for k in (1, 2, 3)}
        return pa.table({"block": pa.array([block], pa.int32()), **times(contexts), **classes})

    own = spark.range(n).repartition(n, "id").mapInArrow(count_by_id, hc.CUT)
    every = _every_range(spark, n).withColumn("range", F.col("range") * 4)
    keyed = own.unionByName(every).select(
        F.floor(F.col("range") / 4).cast("int").alias("block"), (F.col("range") % 4).alias("kind"), "keys", "counts", "n"
    )
    blocks = keyed.groupBy("block").applyInArrow(sum_by_id, f"block int, {by_times}, c1 long, c2 long, c3 long")
    blocks = scratch.settle("by-id", blocks)
    total = blocks.agg(*(F.sum(c) for c in blocks.columns if c != "block")).first()
    model.word_discounts, model.word_classes = discounts(list(total[:TIMES])), list(total[TIMES:])
    return model


def _scores(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = _Lookup(model)
        none = 1.0 / (model.vocabulary + 1)
        free_words = float(np.dot(model.word_discounts, model.word_classes))
        d = np.array(model.pair_discounts)
        for batch in batches:
            for first, last, words, starts in hashed(batch.column("text")):
                ids, counts, places, ends = look.tokens(words, starts)
                context, seen, keys, ranges = look.pair_keys(ids, counts, places, ends)
                edges = np.concatenate(([0], ends[:-1] + 1))
                sums = lambda x: np.add.reduceat(x, edges)  # noqa: B023, E731
                base = np.log10((counts + 1) / (model.tokens + model.vocabulary + 1))
                if model.pairs:
                    contexts = look.of_ids(np.maximum(ids, 0))[0]
                    word = (_discounted(np.where(ids >= 0, contexts, 0), model.word_discounts) + free_words * none) / model.pairs
                    both = np.flatnonzero((ids >= 0) & (context >= 0))
                    distinct, back = np.unique(keys[both], return_inverse=True)
                    at = np.empty(len(distinct), np.int64)
                    at[back] = ranges[both]
                    pair = np.zeros(len(ids), np.int64)
                    pair[both] = look.pairs.count(distinct, at)[back]
                    free = d @ look.of_ids(np.maximum(context, 0))[1:]
                    known = seen > 0
                    p = np.where(known, (_discounted(pair, model.pair_discounts) + free * word) / np.maximum(seen, 1), word)
                    p[~known] = word[~known]
                else:
                    p = np.full(len(ids), none)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, last - first),
                        batch.column("held_out").slice(first, last - first),
                        pa.array(sums(np.ones(len(ids), np.int64)), pa.int64()),
                        pa.array(sums((counts > 0).astype(np.int64)), pa.int64()),
                        pa.array(sums(base), pa.float64()),
                        pa.array(sums(np.log10(p)), pa.float64()),
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
                )

    return run


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts == part


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, base_score, score and perplexity of every row of ``docs``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    scored = docs.select("doc_id", "held_out", "text").mapInArrow(_scores(model), schema)
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


@query()
def op1_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out(F.col("doc_id"), 7, 2))
    model = train(docs.where(~F.col("held_out")))
    return score(docs, model).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity"
    )
