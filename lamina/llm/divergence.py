"""How far the sources of a language differ in their words, by hash-consed segment trees.

Terms are runs of letters (ASCII letters, lower-cased, and everything beyond ASCII). A language
keeps the terms of at least MIN_DOCS of its documents. A group, a source within a language, gives
each kept term the share p = 1 + floor(10^9 (count + 1) / (N + V)), with N the group's
occurrences of kept terms and V their number; f = floor((p - q)^2 / q) prices p against q.

Reading tasks count the terms of each block of text, so a word, however common, is a row for each
block and group. A language's kept terms are dealt over segments of about SEGMENT_TERMS by a hash,
and its sources over blocks of about BLOCK_SOURCES; a task takes one segment for one pair of blocks.
There each source is a segment tree over the segment's term ids whose equal subtrees are one node,
for all sources together. Trees of two sources are walked at the same time from the root, level by level
for many pairs at once; two nodes that a pair has met are priced once, both ways, and the price is
handed up to all places. Sums of segments are added in a shuffle.

Null text, lang and source count as ''. A group without kept terms has N = 0; a language without
kept terms gives each pair the value 0. Ties rank by the item's bytes. Repeated rows count each, null ids
and other columns play no part; an empty table gives an empty result. All arithmetic is exact; a group of more
than 2^47 words is an error.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.session import Workspace

MIN_DOCS, TOP_TERMS = 3, 200
#: Text whose terms a reading task counts at once, in bytes.
BLOCK_BYTES = 32 << 20
#: Terms of a segment and sources of a block, on average: with 16 bytes for each of both in a task.
SEGMENT_TERMS, BLOCK_SOURCES = 1 << 14, 48
#: Node pairs of a level that are walked at once.
FRONTIER = 1 << 21
#: 10^9 in two factors, so that shares are exact in 64 bits for totals up to 2^47.
SCALE, FACTORS = 1_000_000_000, (31_250, 32_000)
MOST = 1 << 47
LETTERS = bytes(b if 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
COUNTED = "lang string, source string, term string, n long, docs long"


def terms_of(text: str) -> list[bytes]:
    """Terms as UTF-8 bytes; bytes.lower knows ASCII alone."""
    return text.encode().lower().translate(LETTERS).split()


def _count_terms(block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, docs, size = defaultdict(Counter), defaultdict(Counter), 0

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, source), counts in n.items():
                terms = list(counts)
                seen = docs[lang, source]
                columns = [pa.array([lang] * len(terms)), pa.array([source] * len(terms)), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64()), pa.array([seen[t] for t in terms], pa.int64())]
                whole = pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
                yield from (whole.slice(at, 20_000) for at in range(0, len(terms), 20_000))

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for lang, source, text in zip(*(batch.slice(at, 256).column(i).to_pylist() for i in range(3))):
                    terms = terms_of(text)
                    n[lang, source].update(terms)
                    docs[lang, source].update(set(terms))
                    size += len(text)
                    if size >= block_bytes:
                        yield from rows()
                        n.clear(), docs.clear()
                        size = 0
        yield from rows()

    return run


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (count + 1) / total), exactly."""
    q, r = np.divmod((count + 1) * FACTORS[0], total)
    return 1 + q * FACTORS[1] + r * FACTORS[1] // total


def share(count: F.Column, total: F.Column) -> F.Column:
    """The same as a column."""
    times = (count + 1) * F.lit(FACTORS[0]).cast("long")
    q = F.call_function("div", times, total)
    return 1 + q * FACTORS[1] + F.call_function("div", (times - q * total) * FACTORS[1], total)


def price(p, q):
    return (p - q) * (p - q) // q


class SegmentTrees:
    """Segment trees of several sources over the same term ids; equal subtrees share a node."""

    def __init__(self, counts: np.ndarray):
        """counts: a row for each source and a column for each term id."""
        sources, width = counts.shape
        leaves = np.full((sources, 1 << max(0, width - 1).bit_length()), -1, np.int64)  # -1: no term
        leaves[:, :width] = counts
        self.leaf_counts, nodes = np.unique(leaves, return_inverse=True)
        nodes = nodes.reshape(leaves.shape)
        #: For each level above the leaves, from below: the left and right nodes of its nodes.
        self.children: list[tuple[np.ndarray, np.ndarray]] = []
        below = len(self.leaf_counts)
        while nodes.shape[1] > 1:
            made, at = np.unique(nodes[:, ::2] * below + nodes[:, 1::2], return_inverse=True)
            self.children.append((made // below, made % below))
            nodes, below = at.reshape(sources, -1), len(made)
        self.roots = nodes[:, 0]

    def divergence(self, a: np.ndarray, b: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each pair of sources the sums of prices of a against b and of b against a."""
        pair, left, right = np.arange(len(a)), self.roots[a], self.roots[b]
        back = []
        for lefts, rights in reversed(self.children):
            size = max(int(lefts.max()), int(rights.max())) + 1
            codes = np.concatenate([(pair * size + child[left]) * size + child[right] for child in (lefts, rights)])
            met, at = np.unique(codes, return_inverse=True)
            back.append(at)
            pair, left, right = met // (size * size), met // size % size, met % size
        ca, cb = self.leaf_counts[left], self.leaf_counts[right]
        p, q = shares(ca, totals[a[pair]]), shares(cb, totals[b[pair]])
        present = ca >= 0
        forth, other = np.where(present, price(p, q), 0), np.where(present, price(q, p), 0)
        for at in reversed(back):
            half = len(at) // 2
            forth, other = (x[at[:half]] + x[at[half:]] for x in (forth, other))
        return forth, other


PARTIAL = "lang string, source string, item string, value long"


def _segment(key: tuple, terms: pa.Table, groups: pa.Table) -> pa.Table:
    """Sums over one segment of terms for the pairs between two blocks of sources."""
    first, second = key[2].as_py(), key[3].as_py()
    groups = groups.combine_chunks()
    names, block = groups.column("source"), groups.column("block").to_numpy()
    totals = groups.column("total").to_numpy()
    # a block may have no sources
    a, b = np.nonzero(np.triu(np.ones((len(block),) * 2, bool), 1)) if first == second else (x.ravel() for x in np.meshgrid(np.flatnonzero(block == first), np.flatnonzero(block == second)))
    lists = terms.column("groups").combine_chunks()
    width = len(lists)
    forth, other = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    if width and len(a):
        flat = lists.flatten()
        of = pc.index_in(flat.field("source"), value_set=names.combine_chunks()).to_numpy()
        sizes = pc.list_value_length(lists).to_numpy()
        counts = np.zeros((len(block), width), np.int64)
        counts[of, np.repeat(np.arange(width), sizes)] = flat.field("n").to_numpy()
        lowest = np.argmax(counts > 0, axis=0)
        counts = counts[:, np.lexsort((counts.sum(0), lowest, (counts > 0).sum(0)))]  # any order of ids is right; like terms side by side share subtrees
        trees = SegmentTrees(counts)
        step = max(1, FRONTIER // width)
        for at in range(0, len(a), step):
            forth[at : at + step], other[at : at + step] = trees.divergence(a[at : at + step], b[at : at + step], totals)
    lang = pa.array([key[0].as_py()] * (2 * len(a)), pa.string())
    return pa.table([lang, names.take(pa.array(np.concatenate([a, b]))), names.take(pa.array(np.concatenate([b, a]))), pa.array(np.concatenate([forth, other]))], ["lang", "source", "item", "value"])


class Audit:
    """Kept terms and groups of a corpus, written once; ``pairs`` and ``terms`` price them."""

    def __init__(self, docs: DataFrame, min_docs: int = MIN_DOCS, block_bytes: int = BLOCK_BYTES, segment_terms: int = SEGMENT_TERMS, block_sources: int = BLOCK_SOURCES):
        work = Workspace(docs.sparkSession, "divergence")
        rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
        counted = rows.mapInArrow(_count_terms(block_bytes), COUNTED).repartition("lang", "term")
        by_group = counted.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        kept = by_group.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("groups"))
        #: (lang, term, n, groups): the kept terms with their counts by source.
        self.kept = work.keep(kept.where(F.col("docs") >= min_docs).drop("docs"), "kept")
        langs = self.kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("lang_n"))
        totals = self.kept.select("lang", F.explode("groups").alias("g")).groupBy("lang", "g.source").agg(F.sum("g.n").alias("n"))
        groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
        zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
        groups = groups.select("lang", "source", (zero("n") + zero("v")).alias("total"), (zero("lang_n") + zero("v")).alias("lang_total"), zero("v").alias("v"))
        whole = F.when(F.col("lang_total") < MOST, F.col("lang_total")).otherwise(F.raise_error(F.lit("a language has more than 2^47 words")))
        #: (lang, source, total, lang_total, v): N + V of each group and of its language.
        self.groups = work.keep(groups.withColumn("lang_total", whole), "groups")
        self.segment_terms, self.block_sources = segment_terms, block_sources

    def pairs(self) -> DataFrame:
        """(lang, source, item, value) for all ordered pairs of sources of a language."""
        sizes = self.groups.groupBy("lang").agg(F.max("v").alias("v"), F.count(F.lit(1)).alias("s"))
        segments = F.greatest(F.ceil(F.col("v") / self.segment_terms), F.lit(1)).cast("int").alias("segments")
        sizes = sizes.select("lang", segments, F.ceil(F.col("s") / self.block_sources).cast("int").alias("blocks"))
        block = lambda source: F.pmod(F.xxhash64(source), F.col("blocks")).cast("int")
        first = F.explode(F.expr("sequence(0, blocks - 1)")).alias("first")
        second = F.explode(F.expr("sequence(first, blocks - 1)")).alias("second")
        terms = self.kept.join(sizes, "lang").select("lang", "blocks", "groups", F.pmod(F.xxhash64("term"), F.col("segments")).cast("int").alias("segment"))
        terms = terms.select("*", first).select("*", second)
        terms = terms.select("lang", "segment", "first", "second", F.filter("groups", lambda g: block(g["source"]).isin(F.col("first"), F.col("second"))).alias("groups"))
        groups = self.groups.join(sizes, "lang").select("lang", "source", "total", "segments", "blocks", block(F.col("source")).alias("block"))
        groups = groups.select("*", F.explode(F.expr("sequence(0, segments - 1)")).alias("segment")).select("*", F.explode(F.expr("sequence(0, blocks - 1)")).alias("with"))
        groups = groups.select("lang", "segment", F.least("block", "with").alias("first"), F.greatest("block", "with").alias("second"), "source", "block", "total")
        keys = ["lang", "segment", "first", "second"]
        return terms.groupBy(*keys).cogroup(groups.groupBy(*keys)).applyInArrow(_segment, PARTIAL).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    def terms(self, top: int = TOP_TERMS) -> DataFrame:
        """(lang, source, item, value, rank): the terms that a source gives more than its language does, the dearest first."""
        rows = self.kept.select("lang", F.col("term").alias("item"), F.col("n").alias("lang_n"), F.explode("groups").alias("g")).select("lang", "item", "lang_n", "g.*")
        rows = rows.join(self.groups, ["lang", "source"]).select("lang", "source", "item", share(F.col("n"), F.col("total")).alias("p"), share(F.col("lang_n"), F.col("lang_total")).alias("q"))
        rows = rows.where("p > q").select("lang", "source", "item", F.expr("(p - q) * (p - q) div q").alias("value"))
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def audit(docs: DataFrame, **options) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value and rank."""
    found = Audit(docs, **options)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = found.pairs().withColumn("rank", F.row_number().over(order))
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return columns(pairs, "pair").unionByName(columns(found.terms(), "term"))
