"""N-gram Jaccard join by grouped prefixes, down to the components of its links.

A document is the set of its word shingles. The sets are ordered rare shingles first, by counts
over the whole corpus; a document's prefix is so long that two sets above the threshold share a
shingle of their prefixes.

1. Equal sets become one node, nodes with equal prefixes and size one group.
2. Groups meet on prefix shingles that occur twice or more. Size and position filters drop
   pairs that can't reach the threshold.
3. For each shingle the group in which it stands foremost leads: it has the fewest rare shingles
   of its own, as an original has beside its edited copies. Members meet the leader first and
   are verified on their whole sets; this links large families with as many checks as members.
4. Only pairs of different components are left. On each shingle the members outside its largest
   component meet all that are in another component, are expanded and verified. So no pair that
   could join two components is left out, and no pair inside one is made.

The counts only order shingles; which pairs link never depends on them. They are kept as sorted
arrays that the tasks map into memory (see hash_counts), for shingles above ``FREQUENT`` only.

Defined results: null and blank texts have no shingle, ``n_shingles`` 0 and no link; with one or
two words the sequence is the one shingle; a null id is larger than all others; repeated rows
are copies of one another; an empty table gives no rows. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import hash_counts as hc
from codeloom.llm.base import Scratch, query, table
from codeloom.llm.components import components
from codeloom.llm.word_hashes import hashed, mix

#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 90
#: Shingles seen less often than this count as equally rare.
FREQUENT = 8
#: Rows of node ids up to this number are broadcast to the documents.
BROADCAST_NODES = 200_000
#: Shingles a task counts before it hands them on.
BLOCK = 3_000_000
_M = np.uint64(0x9E3779B97F4A7C15)
_KEY_SHIFT = np.uint64(24)
_KEY_BITS = 40


def shingle_hashes(words: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(document index, hash) of every shingle of ``n`` words, repeats included, in word order."""
    lengths = np.diff(starts)
    run = words.copy()
    whole = words.copy()
    short = []
    for k in range(1, n):
        fits = np.flatnonzero(lengths == k)
        short.append((fits, mix(whole[starts[fits]] * _M + np.uint64(k))))
        if len(run) > 1:
            run = mix(run[:-1] * _M + words[k:])
            whole = np.concatenate((run, np.zeros(k, np.uint64)))
        else:
            run = run[:0]
    counts = np.maximum(lengths - (n - 1), 0)
    owner = np.repeat(np.arange(len(lengths)), counts)
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts[:-1], counts)
    owners = [owner] + [f for f, _ in short]
    return np.concatenate(owners), np.concatenate([run[at] if len(at) else run[:0]] + [h for _, h in short])


def _sets(owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (owner, hash) in order."""
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    first = np.ones(len(owner), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    return owner[first], hashes[first]


def _range_of(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys * np.uint64(n)) >> np.uint64(_KEY_BITS)).astype(np.int64)


def frequent_shingles(docs: DataFrame, scratch: Scratch, n: int) -> tuple[str, int]:
    """Folder and number of ranges of the counts of all shingles seen ``FREQUENT`` times or more."""
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    folder = scratch.local_folder("order")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            block = np.concatenate(held)
            held.clear()
            keys, counts = hc.summed(block)
            del block
            return hc.batch_of_cuts(list(hc.cuts(keys, counts, _range_of(keys, ranges))))

        for batch in batches:
            for _, _, words, starts in hashed(batch.column("text")):
                held.append(shingle_hashes(words, starts, n)[1] >> _KEY_SHIFT)
                size += len(held[-1])
                if size >= BLOCK:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    def merge(table: pa.Table) -> pa.Table:
        keys, counts = hc.uncut(*(table.column(c).to_pylist() for c in ("keys", "counts", "n")))
        often = counts >= FREQUENT
        own = table.column("range")[0].as_py()
        hc.save(folder, f"key-{own}", keys[often])
        hc.save(folder, f"count-{own}", counts[often].astype(np.uint32))
        return pa.table({"range": pa.array([own], pa.int32()), "n": [int(often.sum())], "total": [int(counts.sum())]})

    every = docs.sparkSession.range(ranges).select(
        F.col("id").cast("int").alias("range"), F.lit(b"").alias("keys"), F.lit(b"").alias("counts"), F.lit(0).cast("long").alias("n")
    )
    cut = docs.select("text").mapInArrow(count, hc.CUT).unionByName(every)
    cut.groupBy("range").applyInArrow(merge, hc.RANGE_FILE).write.format("noop").mode("overwrite").save()
    return folder, ranges


def _features(folder: str, ranges: int, n: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = hc.Ranges(folder, ranges)
        for batch in batches:
            for first, last, words, starts in hashed(batch.column("text")):
                owner, hashes = _sets(*shingle_hashes(words, starts, n))
                keys = hashes >> _KEY_SHIFT
                by_key = np.argsort(keys, kind="stable")
                counts = np.empty(len(keys), np.uint64)
                counts[by_key] = order.count(keys[by_key], _range_of(keys[by_key], ranges))
                ranked = hashes[np.lexsort((hashes, counts, owner))]
                edges = np.searchsorted(owner, np.arange(last - first + 1))
                sizes = np.diff(edges)
                lengths = np.where(sizes > 0, sizes + (-sizes * percent // 100) + 1, 0)
                prefixes = [ranked[e : e + k] for e, k in zip(edges, lengths)]
                sets = [xxhash.xxh3_128_digest(hashes[a:b].tobytes()) if b > a else None for a, b in zip(edges[:-1], edges[1:])]
                groups = [
                    xxhash.xxh3_64_intdigest(p.tobytes(), seed=int(s)) - 2**63 if s else None for p, s in zip(prefixes, sizes)
                ]
                offsets = pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32())
                values = np.concatenate(prefixes).view(np.int64) if prefixes else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, last - first),
                        batch.column("text_hash").slice(first, last - first),
                        pa.array(sizes, pa.int64()),
                        pa.array(sets, pa.binary()),
                        pa.array(groups, pa.int64()),
                        pa.ListArray.from_arrays(offsets, pa.array(values, pa.int64())),
                    ],
                    ["doc_id", "text_hash", "size", "node", "grp", "prefix"],
                )

    return run


def _whole_sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, words, starts in hashed(batch.column("text")):
                owner, hashes = _sets(*shingle_hashes(words, starts, n))
                offsets = pa.array(np.searchsorted(owner, np.arange(last - first + 1)), pa.int32())
                sets = pa.ListArray.from_arrays(offsets, pa.array(hashes.view(np.int64), pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(first, last - first), sets], ["node", "shingles"])

    return run


def _can_link(a: str, b: str, percent: int) -> Column:
    """Size and position filters for a shingle at place ``at`` of two prefixes.

    Right for the first common shingle of a pair; a later one may fail, the first does not.
    """
    size_a, size_b, at_a, at_b = F.col(f"{a}.size"), F.col(f"{b}.size"), F.col(f"{a}.at"), F.col(f"{b}.at")
    fits = 100 * F.least(size_a, size_b) >= percent * F.greatest(size_a, size_b)
    return fits & ((100 + percent) * F.least(size_a - at_a, size_b - at_b) >= percent * (size_a + size_b))


class Join:
    """One run over ``docs``: ``features`` per row, ``nodes`` per distinct set, and the links."""

    def __init__(self, docs: DataFrame, n: int = 3, percent: int = PERCENT):
        self.scratch, self.n, self.percent = Scratch(docs.sparkSession, "jaccard-join"), n, percent
        self.docs = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
        folder, ranges = frequent_shingles(docs, self.scratch, n)
        kind = self.docs.schema["doc_id"].dataType.simpleString()
        found = self.docs.mapInArrow(
            _features(folder, ranges, n, percent),
            f"doc_id {kind}, text_hash long, size long, node binary, grp long, prefix array<long>",
        )
        self.features = self.scratch.settle("features", found)
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
        nodes = self.features.where(F.col("size") > 0).groupBy("node").agg(
            first.alias("best"), F.first("size").alias("size"), F.first("grp").alias("grp")
        )
        self.nodes = self.scratch.settle("nodes", nodes.select("node", "best.doc_id", "best.text_hash", "size", "grp"))

    def meetings(self) -> DataFrame:
        """(shingle, grp, size, at, leader, leader_size, leader_at) for shingles of two nodes or more."""
        prefixes = self.features.where(F.col("size") > 0).groupBy("grp").agg(F.first("size").alias("size"), F.first("prefix").alias("prefix"))
        groups = prefixes.join(self.nodes.groupBy("grp").agg(F.count("*").alias("members")), "grp")
        tokens = groups.select("grp", "size", "members", F.posexplode("prefix").alias("at", "shingle"))
        tokens = tokens.select("shingle", "grp", F.col("size").cast("int").alias("size"), "members", "at")
        foremost = F.min(F.struct("at", (-F.col("members")).alias("few"), "grp", "size"))
        shared = tokens.groupBy("shingle").agg(F.sum("members").alias("in_all"), foremost.alias("lead")).where(F.col("in_all") > 1)
        lead = shared.select("shingle", F.struct(F.col("lead.grp").alias("grp"), F.col("lead.size").alias("size"), F.col("lead.at").alias("at")).alias("lead"))
        return self.scratch.settle("meetings", tokens.drop("members").join(lead, "shingle"))

    def verified(self, pairs: DataFrame, name: str) -> DataFrame:
        """Of the (a, b) node pairs, those that link."""
        pairs = self.scratch.settle(f"{name}-pairs", pairs.distinct())
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        wanted = self.scratch.settle(f"{name}-wanted", wanted.join(self.nodes, "node").select("node", F.col("doc_id").alias("d"), F.col("text_hash").alias("h")))
        few = F.broadcast(wanted) if wanted.count() <= BROADCAST_NODES else wanted
        same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h"))
        texts = self.docs.join(few, same).select("node", "text")
        # Both sides of the check read one shuffle of the sets, so these are made once and not written as a table.
        sets = texts.mapInArrow(_whole_sets(self.n), "node binary, shingles array<long>").dropDuplicates(["node"])
        left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
        right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
        common = F.size(F.array_intersect("x", "y"))
        linked = pairs.join(left, "a").join(right, "b").where(
            (100 + self.percent) * common >= self.percent * (F.size("x") + F.size("y"))
        )
        return self.scratch.settle(f"{name}-links", linked.select("a", "b").hint("rebalance"))

    def links(self) -> DataFrame:
        """Verified (a, b) node pairs that connect every component of the whole join."""
        met = self.meetings()
        members = self.nodes.select("node", "grp")
        leads = members.groupBy("grp").agg(F.min("node").alias("lead"))
        inside = members.join(leads, "grp").where(F.col("node") != F.col("lead")).select(F.col("lead").alias("a"), F.col("node").alias("b"))
        near = met.alias("m").where((F.col("m.grp") != F.col("m.lead.grp")) & _can_link("m", "m.lead", self.percent))
        near = near.select(F.col("m.grp").alias("grp"), F.col("m.lead.grp").alias("lead_grp")).distinct()
        across = (
            near.join(members, "grp")
            .join(leads.select(F.col("grp").alias("lead_grp"), "lead"), "lead_grp")
            .select(F.col("lead").alias("a"), F.col("node").alias("b"))
        )
        ordered = lambda p: p.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        first = self.verified(ordered(inside.unionByName(across)), "first")

        roots = components(first, self.scratch, "first")
        rooted = self.scratch.settle("rooted", members.join(roots, "node", "left").select("node", "grp", F.coalesce("root", "node").alias("root")))
        parts = rooted.select("grp", "root").distinct()
        placed = self.scratch.settle("placed", met.select("shingle", "grp", "size", "at").join(parts, "grp"))
        weight = placed.groupBy("shingle", "root").agg(F.count("*").alias("n"))
        largest = weight.groupBy("shingle").agg(F.max(F.struct("n", "root"))["root"].alias("largest"), F.count("*").alias("roots"))
        open_ = largest.where(F.col("roots") > 1).select("shingle", "largest")
        contested = self.scratch.settle("contested", placed.join(open_, "shingle"))
        outside = contested.where(F.col("root") != F.col("largest")).alias("o")
        rest = outside.join(
            contested.alias("c"),
            (F.col("o.shingle") == F.col("c.shingle")) & (F.col("o.root") != F.col("c.root")) & _can_link("o", "c", self.percent),
        )
        rest = rest.select(
            F.col("o.grp").alias("ga"), F.col("o.root").alias("ra"), F.col("c.grp").alias("gb"), F.col("c.root").alias("rb")
        ).distinct()
        left = rooted.select(F.col("node").alias("a"), F.col("grp").alias("ga"), F.col("root").alias("ra"))
        right = rooted.select(F.col("node").alias("b"), F.col("grp").alias("gb"), F.col("root").alias("rb"))
        pairs = rest.join(left, ["ga", "ra"]).join(right, ["gb", "rb"]).select("a", "b")
        return first.unionByName(self.verified(ordered(pairs), "rest"))

    def classes(self) -> DataFrame:
        """(doc_id, text_hash, n_shingles, component_id) for every document row."""
        roots = components(self.links(), self.scratch, "all")
        nodes = self.nodes.join(roots, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root"))
        least = nodes.groupBy("root").agg(F.min("doc_id").alias("component_id"))
        of_node = nodes.join(least, "root").select(F.col("node").alias("of"), "component_id")
        joined = self.features.join(of_node, F.col("node") == F.col("of"), "left")
        own = F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
        return joined.select("doc_id", "text_hash", F.col("size").alias("n_shingles"), own.alias("component_id"))

    def kept(self, docs: DataFrame) -> DataFrame:
        """The rows of ``docs`` (those joined) with one document of each component, the smallest id.

        Documents without words all stay. Of rows equal in id and text one stays.
        """
        scratch = self.scratch
        rows = scratch.settle("classes", self.classes())
        key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
        wordy = rows.where(F.col("n_shingles") > 0)
        best = wordy.groupBy(F.col("component_id").alias("of")).agg(F.min(key).alias("best"))
        gone = (
            wordy.join(best, F.col("component_id").eqNullSafe(F.col("of")))
            .where(~key.eqNullSafe(F.col("best")))
            .select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"))
            .distinct()
        )
        twice = rows.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where(F.col("n") > 1)
        twice = twice.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"))
        left = without(docs, scratch.settle("gone", gone))
        twice = scratch.settle("twice", twice)
        if twice.isEmpty():
            return left
        return without(left, twice).unionByName(without(left, twice, "left_semi").dropDuplicates(["doc_id", "text"]))


def without(docs: DataFrame, rows: DataFrame, how: str = "left_anti") -> DataFrame:
    """``docs`` less ``rows`` (d, h: id and text hash), a settled table; a short one is broadcast."""
    few = rows.select(F.col("d").alias("_other_id"), F.col("h").alias("_other_hash"))
    few = F.broadcast(few) if rows.count() <= BROADCAST_NODES else few
    return docs.join(few, F.col("doc_id").eqNullSafe(F.col("_other_id")) & (F.xxhash64("text") == F.col("_other_hash")), how)


@query()
def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Join(table(spark, sf_dir, "documents")).classes().drop("text_hash")
