"""Alignment of two tokenizers' tokens over the same text, with corpus-wide counts of linked ids.

Each text is tokenised whole by both. Where a space-marked token of one starts at the byte at which
a space-marked token of the other starts, the ends before them are shared: such anchors cut a text
into windows of token ids. A window's alignment depends on its two id tuples alone, so a worker
remembers it: its groups (cut where both have an end) and its links (token pairs whose bytes
overlap). A text is then the chain of its windows; a text without spaces is one window.

Three passes. The first tokenises and leaves, per text, its figures and its distinct id pairs with
their numbers of links. The second counts in Spark in how many texts each pair occurs, a hot pair
being one row per task after the partial sum, and finds the highest count of each A id, which has
no more pairs than B has ids. The counts are written as sorted arrays, ``PAIRS_A_FILE`` pairs a
file, into the shared folder; the third pass maps the files when first asked and looks up each
text's pairs, so memory doesn't grow with the number of pairs. A shared folder that is mounted on
all machines is needed.

Defined results: a null or empty text, or one that either tokenizer doesn't give back byte for byte
(for B: a text with U+2581), has no tokens, zeros and an empty digest; special tokens' strings are plain text;
repeated rows count as documents of their own; an empty table gives no rows. Other columns are left out.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.functions.text import exploded
from codeloom.llm import hash_counts as hc
from codeloom.llm.base import Scratch, query, table
from codeloom.llm.token_counts import byte_letters

BYTE_LEVEL = "/opt/tokenizers/byte_bpe_50k.json"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
#: Fixed value: the pattern by which byte-level vocabularies of this kind cut texts before merging.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_FAR_LETTERS = re.compile("[\u0250-\U0010ffff]")
#: Links of remembered windows with which a worker starts anew.
MEMO_LINKS = 3_000_000
_OF_B = 1 << 30
#: Texts and characters tokenised at a time; a longer text is a piece of its own.
PIECE_TEXTS, PIECE_CHARS = 64, 500_000
PAIRS_A_FILE = 4_000_000
#: Files of counts a worker keeps mapped.
OPEN_FILES = 256


@dataclass
class Vocabulary:
    """A tokenizer's ids as bytes, their lengths, and which of them begin with a space."""

    entries: list[bytes]
    lengths: np.ndarray = field(init=False)
    marked: np.ndarray = field(init=False)

    def __post_init__(self):
        self.lengths = np.array([len(e) for e in self.entries], np.int64)
        self.said = {mark: np.array([f"{i}{mark}" for i in range(len(self.entries))], object) for mark in ",|;\n"}
        self.marked = np.array([e.startswith(b" ") for e in self.entries])
        self.flat = np.frombuffer(b"".join(self.entries), np.uint8)
        self.at = np.cumsum(self.lengths) - self.lengths

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return self.flat[ragged(self.at[ids], self.lengths[ids])]


def ragged(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places first, first + 1, ... of each run, one run after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(first - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class Tokenizers:
    """Tokenizer A (byte-level BPE) and B (pieces with byte fallback), loaded once a task.

    A plain byte-level vocabulary numbers its entries in the order of their merges, so they are
    ranks, and the faster library that takes ranks gives the same ids. It is used for texts of
    letters below U+0250, of which both know the same classes; others go to A's own library.
    """

    def __init__(self, path_a: str, path_b: str):
        import tiktoken
        from sentencepiece import SentencePieceProcessor

        with open(path_a, encoding="utf-8") as file:
            spec = json.load(file)
        added = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        letters, by_id = byte_letters(), {i: t for t, i in (spec["model"]["vocab"] | added).items()}
        entries = [bytes(letters[c] for c in by_id.get(i, "") if c in letters) for i in range(max(by_id) + 1)]
        self.a, self.path, self._own, self._ranked = Vocabulary(entries), path_a, None, None
        cut = spec.get("pre_tokenizer") or {}
        if cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space") and not spec.get("normalizer"):
            ranks = {entries[i]: i for t, i in spec["model"]["vocab"].items() if t not in added}
            self._ranked = tiktoken.Encoding("ranked", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = SentencePieceProcessor(model_file=path_b)
        pieces = [self.pieces.id_to_piece(i) for i in range(self.pieces.vocab_size())]
        self.b = Vocabulary(
            [bytes([int(p[3:5], 16)]) if self.pieces.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        )

    @property
    def tokenizer(self):
        """A as its own library reads it."""
        if self._own is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self._own = Tokenizer.from_file(self.path)
            self._own.encode_special_tokens = True
        return self._own

    def encode_a(self, text: str) -> list[int]:
        if self._ranked is not None and not _FAR_LETTERS.search(text):
            return self._ranked.encode_ordinary(text)
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> Encoded:
        """Ids of A and B of the texts; of those that one of them doesn't spell, none."""
        a, b = [self.encode_a(" " + t) if t else [] for t in texts], self.pieces.encode(texts, num_threads=1)
        raw = [b" " + t.encode() if t else b"" for t in texts]
        size = np.array([len(r) for r in raw])
        n_a, n_b = (np.array([len(x) for x in ids]) for ids in (a, b))
        a, b = (np.fromiter(chain.from_iterable(ids), np.int64) for ids in (a, b))
        right = size > 0
        for ids, n, of in ((a, n_a, self.a), (b, n_b, self.b)):
            right &= np.bincount(np.repeat(np.arange(len(n)), n), of.lengths[ids], len(n)) == size
        for ids, n, of in ((a, n_a, self.a), (b, n_b, self.b)):
            spelled = of.bytes_of(ids[np.repeat(right, n)])
            wrong = np.flatnonzero(spelled != np.frombuffer(b"".join(r for r, ok in zip(raw, right) if ok), np.uint8))
            which = np.flatnonzero(right)
            right[which[np.searchsorted(np.cumsum(size[which]), wrong, "right")]] = False
        a, b = a[np.repeat(right, n_a)], b[np.repeat(right, n_b)]
        return Encoded(a, b, np.where(right, n_a, 0), np.where(right, n_b, 0), np.where(right, size, 0))


@dataclass
class Encoded:
    """Ids of several texts one after the other, and each text's numbers of ids and bytes."""

    a: np.ndarray
    b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    size: np.ndarray


def anchors(texts: Encoded, of: Tokenizers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes at which windows begin, and the places of A and B ids there, each with the end appended.

    Every spelled text begins with a space, so each begins a window.
    """
    starts_a = np.cumsum(of.a.lengths[texts.a]) - of.a.lengths[texts.a]
    starts_b = np.cumsum(of.b.lengths[texts.b]) - of.b.lengths[texts.b]
    shared = np.intersect1d(starts_a[of.a.marked[texts.a]], starts_b[of.b.marked[texts.b]], assume_unique=True)
    cut = lambda starts: np.append(np.searchsorted(starts, shared), len(starts))
    return shared, cut(starts_a), cut(starts_b)


def align(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, of: Tokenizers) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Several windows at once, one after the other in ``a`` and ``b``; n_a: the A ids of each.

    Per window its groups as text, their number, its links as A << 32 | B, and the number of those.
    """
    ends_a, ends_b = np.cumsum(of.a.lengths[a]), np.cumsum(of.b.lengths[b])
    window_ends = ends_a[np.cumsum(n_a) - 1]
    both = np.union1d(ends_a, ends_b)  # each piece between two ends lies in one A and one B token
    links = a[np.searchsorted(ends_a, both)] << 32 | b[np.searchsorted(ends_b, both)]
    shared = np.intersect1d(ends_a, ends_b, assume_unique=True)
    group_a, group_b = np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b)
    last_a, last_b = np.searchsorted(ends_a, shared), np.searchsorted(ends_b, shared)
    window_last = np.searchsorted(shared, window_ends)
    said = np.empty(len(a) + len(b), object)
    at_a = np.arange(len(a)) + np.append(0, last_b + 1)[group_a]
    at_b = np.arange(len(b)) + last_a[group_b] + 1
    said[at_a], said[at_b] = of.a.said[","][a], of.b.said[","][b]
    said[at_a[last_a]], said[at_b[last_b]] = of.a.said["|"][a[last_a]], of.b.said[";"][b[last_b]]
    ends = last_b[window_last]
    said[at_b[ends]] = of.b.said["\n"][b[ends]]
    count = lambda all_ends: np.diff(np.searchsorted(all_ends, window_ends, "right"), prepend=0)
    return "".join(said.tolist()).split("\n")[:-1], count(shared), links, count(both)


class Memo:
    """Alignments of the windows a worker has met, numbered, by their ids."""

    def __init__(self, of: Tokenizers):
        self.of = of
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.texts: list[str] = []
        self.groups, self.links, self.bounds = array("q"), array("q"), array("q", [0])

    def windows(self, texts: Encoded, begin_a: np.ndarray, begin_b: np.ndarray) -> list[int]:
        """The numbers of all windows in order. A key is the window's A ids and then its B ids, marked."""
        if len(self.links) > MEMO_LINKS:
            self._clear()
        n_a, n_b = np.diff(begin_a), np.diff(begin_b)
        ids = np.empty(len(texts.a) + len(texts.b), np.int32)
        ids[np.arange(len(texts.a)) + np.repeat(begin_b[:-1], n_a)] = texts.a
        ids[np.arange(len(texts.b)) + np.repeat(begin_a[1:], n_b)] = texts.b | _OF_B
        raw, bounds = ids.tobytes(), ((begin_a + begin_b) * 4).tolist()
        keys = [raw[x:y] for x, y in zip(bounds, bounds[1:])]
        new = {key: w for w, key in enumerate(keys) if key not in self.known}
        if new:
            at = np.fromiter(new.values(), np.int64)
            a, b = texts.a[ragged(begin_a[at], n_a[at])], texts.b[ragged(begin_b[at], n_b[at])]
            said, groups, links, n_links = align(a, b, n_a[at], self.of)
            self.known.update(zip(new, range(len(self.texts), len(self.texts) + len(new))))
            self.texts.extend(said)
            self.groups.frombytes(groups.astype(np.int64).tobytes())
            self.links.frombytes(links.tobytes())
            self.bounds.frombytes((self.bounds[-1] + np.cumsum(n_links)).astype(np.int64).tobytes())
        return list(map(self.known.__getitem__, keys))


FIGURES = ("n_a", "n_b", "n_groups", "n_links")


def aligned_piece(texts: list[str], memo: Memo) -> list[pa.Array]:
    """Columns FIGURES, groups_sha256, pairs and times of some texts."""
    of = memo.of.encode(texts)
    begins, begin_a, begin_b = anchors(of, memo.of)
    windows = memo.windows(of, begin_a, begin_b)
    number = np.array(windows, np.int64)
    ends = np.cumsum(of.size)
    last = np.searchsorted(begins, ends)
    first = np.append(0, last[:-1])
    bounds = np.frombuffer(memo.bounds, np.int64)
    n_links = bounds[number + 1] - bounds[number]
    links = np.frombuffer(memo.links, np.int64)[ragged(bounds[number], n_links)] if len(number) else np.zeros(0, np.int64)
    links_to = np.append(0, np.cumsum(n_links))
    groups_to = np.append(0, np.cumsum(np.frombuffer(memo.groups, np.int64)[number])) if len(number) else np.zeros(1, np.int64)
    del bounds  # the arrays grow again
    pairs, times, digests = [], [], []
    for low, high in zip(first.tolist(), last.tolist()):
        own, n = np.unique(links[links_to[low] : links_to[high]], return_counts=True)
        pairs.append(own)
        times.append(n)
        digests.append(hashlib.sha256(";".join([memo.texts[w] for w in windows[low:high]]).encode()).hexdigest() if high > low else "")
    offsets = pa.array(np.append(0, np.cumsum([len(p) for p in pairs])), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x), pa.int64())) for x in (pairs, times)]
    figures = (of.n_a, of.n_b, groups_to[last] - groups_to[first], links_to[last] - links_to[first])
    return [*(pa.array(f, pa.int64()) for f in figures), pa.array(digests, pa.string()), *lists]


def _pieces(texts: list[str]) -> Iterator[list[str]]:
    held, size = [], 0
    for text in texts:
        if held and (len(held) == PIECE_TEXTS or size + len(text) > PIECE_CHARS):
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def _aligned(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(Tokenizers(path_a, path_b))
        for batch in batches:
            done = 0
            for piece in _pieces([t or "" for t in batch.column("text").to_pylist()]):
                ids = batch.column("doc_id").slice(done, len(piece))
                yield pa.RecordBatch.from_arrays([ids, *aligned_piece(piece, memo)], ["doc_id", *FIGURES, "groups_sha256", "pairs", "times"])
                done += len(piece)

    return run


def alignments(docs: DataFrame, path_a: str = BYTE_LEVEL, path_b: str = PIECES) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) of every row of ``docs``.

    pairs: the text's distinct linked ids as A << 32 | B; times: the links of each.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {', '.join(f'{c} long' for c in FIGURES)}, groups_sha256 string, pairs array<long>, times array<long>"
    return docs.select("doc_id", "text").mapInArrow(_aligned(path_a, path_b), schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best): in how many texts each pair is linked, and whether none of its A id is in more."""
    counts = exploded(aligned, [], F.col("pairs"), "pair").groupBy("pair").agg(F.count("*").alias("n"))
    best = F.max("n").over(Window.partitionBy(F.shiftright("pair", 32)))
    return counts.select("pair", "n", (F.col("n") == best).alias("best"))


@dataclass
class PairFiles:
    """Sorted pairs with their counts, ``files`` of them by remainder, opened as they are asked for."""

    folder: str
    files: int

    def __post_init__(self):
        self.open: OrderedDict[int, tuple[np.ndarray, np.ndarray]] = OrderedDict()

    @classmethod
    def write(cls, counts: DataFrame, folder: str) -> PairFiles:
        """``counts`` is a settled table; a repeated task replaces its file by an equal one."""
        files = max(-(-counts.count() // PAIRS_A_FILE), 1)

        def save(rows: pa.Table) -> pa.Table:
            pairs, n, best, own = (rows.column(c).to_numpy() for c in ("pair", "n", "best", "file"))
            order = np.argsort(pairs)
            hc.save(folder, f"pair-{own[0]}", pairs[order])
            hc.save(folder, f"value-{own[0]}", (n * 2 + best)[order].astype(np.int64))
            return pa.table({"file": own[:1], "n": [len(pairs)]})

        one = counts.select("pair", "n", "best", F.pmod("pair", F.lit(files)).alias("file"))
        one.groupBy("file").applyInArrow(save, "file long, n long").agg(F.sum("n")).collect()
        return cls(folder, files)

    def _file(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in self.open:
            if len(self.open) >= OPEN_FILES:
                self.open.popitem(last=False)
            self.open[k] = hc.load(self.folder, f"pair-{k}"), hc.load(self.folder, f"value-{k}")
        self.open.move_to_end(k)
        return self.open[k]

    def values(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count and best mark of ``pairs``, all of which were counted."""
        distinct, back = np.unique(pairs, return_inverse=True)
        out, file = np.zeros(len(distinct), np.int64), distinct % self.files
        for k in np.unique(file).tolist():
            own = file == k
            keys, values = self._file(k)
            out[own] = values[np.searchsorted(keys, distinct[own])]
        out = out[back]
        return out >> 1, out & 1


def _with_counts(files: PairFiles):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, times = (batch.column(c) for c in ("pairs", "times"))
            bounds = np.concatenate(([0], np.cumsum(pa.compute.list_value_length(pairs).to_numpy(zero_copy_only=False)))).astype(np.int64)
            n, best = files.values(pairs.flatten().to_numpy(zero_copy_only=False))
            links = times.flatten().to_numpy(zero_copy_only=False)

            def sums(values: np.ndarray) -> pa.Array:
                running = np.concatenate(([0], np.cumsum(values)))
                return pa.array(running[bounds[1:]] - running[bounds[:-1]], pa.int64())  # noqa: B023

            kept = ["doc_id", *FIGURES, "groups_sha256"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), sums(links * best), sums(links * n)], [*kept, "n_best", "count_sum"]
            )

    return run


def align_corpus(docs: DataFrame, path_a: str = BYTE_LEVEL, path_b: str = PIECES) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "token-alignment")
    aligned = scratch.settle("aligned", alignments(docs, path_a, path_b))
    files = PairFiles.write(scratch.settle("counts", pair_counts(aligned)), scratch.local_folder("files"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {', '.join(f'{c} long' for c in FIGURES)}, groups_sha256 string, n_best long, count_sum long"
    scratch.drop("counts")
    return aligned.mapInArrow(_with_counts(files), schema).select("doc_id", *FIGURES, "n_best", "count_sum", "groups_sha256")


@query()
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_corpus(table(spark, sf_dir, "documents"))
