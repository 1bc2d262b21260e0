"""N-gram Jaccard join by vertical partitioning.

A document is the set of its distinct word n-grams, in one global order: that of their 64-bit
hashes. The order is cut into VERTICAL fragments. Overlaps of candidate pairs are counted in
each fragment apart and summed by pair.

Candidates are sought at the start of the order. Of similar sets x and y, at least NUM/DEN of
the larger one is common; so the first (1 - NUM/DEN) |x| + e n-grams of x and as many of y hold
e common ones. A set shows that many. Of these only the rarest are sought by: of at least e
common n-grams, one lies beside the e - 1 most frequent of either set. No pair that shares none
of the rest can be linked, whatever its size.

Equal sets are collapsed first. Then only what connects is compared, in turns. In the first two
every set is compared with the hub that it shares most n-grams with. What is still apart forms
clusters: sets that share an n-gram, directly or through others. There every set is compared
with the nearest of another group, twice, and at last all groups that may still be linked. Near
is told by sketches: the parities of a set's numbers of n-grams in one to two times as many
fragments as it has n-grams, which differ in no more places than the sets in n-grams. A set
whose sketch allows no link leaves its cluster. Sketches meet in blocks of bounded size, and
blocks meet each other: a cluster costs the square of its size, but in comparisons of bits
alone. No list of a group's pairs is ever made, and no pair that could connect two groups is
left out.

The result is one row for each row of documents: doc_id, n_shingles, component_id, the
smallest doc_id reachable by links. Fewer words than n are one n-gram; texts without words,
and null texts, are empty sets and linked with nothing, and their component is their own id.
Rows with a null doc_id count as members of their group through equal texts alone. Rows that
share a doc_id but not the text are linked each by its own text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions.graph import connected_components
from lamina.llm.common import id_and_text, slices
from lamina.session import Workspace

SHINGLE, NUM, DEN = 3, 90, 100
VERTICAL = 8
#: Hundredths of a set that it shows beyond what one common n-gram takes.
EXTRA = 20
#: Sets, and n-grams of theirs, of a cluster that are compared with each other in one task.
BLOCK, BLOCK_GRAMS = 2000, 8 << 20
CACHE_WORDS = 300_000
#: Ids that may be broadcast to pick candidates' texts; beyond it the texts are joined by shuffle.
BROADCAST_IDS = 500_000
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * M2
        x = (x ^ (x >> np.uint64(27))) * M3
        return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct n-gram hashes of a text; remembers words' hashes."""

    def __init__(self, n: int):
        self.n, self.words = n, {}

    def hashes(self, text: str) -> np.ndarray:
        words = text.encode().lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        known = self.words
        if len(known) > CACHE_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        ids, n = np.fromiter(map(known.__getitem__, words), np.uint64, len(words)), min(self.n, len(words))
        out = np.full(len(ids) - n + 1, n, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(n):
                out = mixed(out * M1 + ids[i : i + len(out)])
        return np.unique(out)


class Prefix:
    """How many n-grams a set shows, and how many of them a similar set shows as well at least."""

    def __init__(self, num: int, den: int, extra: int = EXTRA):
        self.num, self.den, self.more = num, den, extra

    def common(self, size: int) -> int:
        """The least overlap with a similar set, and the least size of one."""
        return -(-size * self.num // self.den)

    def extra(self, size: int) -> int:
        return max(1, size * self.more // 100)

    def shown(self, size: int) -> int:
        return min(size, size - self.common(size) + self.extra(size))

    def need(self, size: int) -> int:
        return min(self.extra(self.common(size)), self.common(size))


def _signer(n: int, num: int, den: int, extra: int = EXTRA):
    """(row, n, sign, need, keys): a set's size, its digest, and what it shows."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, prefix = Shingler(n), Prefix(num, den, extra)
        for rows, texts in slices(batches):
            hashes = [shingler.hashes(t) for t in texts]
            sizes = [len(h) for h in hashes]
            keys = [h[: prefix.shown(len(h))].view(np.int64) for h in hashes]
            columns = [pa.array(rows, pa.int64()), pa.array(sizes, pa.int64()), pa.array([xxhash.xxh3_128_digest(h.tobytes()) for h in hashes], pa.binary()), pa.array([prefix.need(k) for k in sizes], pa.int32()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["row", "n", "sign", "need", "keys"])

    return sign


def sketch_bits(size: int) -> int:
    """log2 of a sketch's bits: more than the set's size, at most twice, and a whole word at least."""
    return max(6, int(size).bit_length())


def sketch(hashes: np.ndarray) -> bytes:
    """The parity of the number of hashes in each of 2^k equal fragments of the order."""
    k = sketch_bits(len(hashes))
    return np.packbits(np.bincount((hashes >> np.uint64(64 - k)).astype(np.int64), minlength=1 << k).astype(np.uint8) & 1, bitorder="little").tobytes()


def halved(sketches: np.ndarray) -> np.ndarray:
    """Sketches of half as many fragments."""
    bits = np.unpackbits(sketches.view(np.uint8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits[:, ::2] ^ bits[:, 1::2], axis=1, bitorder="little")).view(np.uint64)


def _fragmenter(n: int):
    """(rep, parts, bits): a set cut at VERTICAL places of the global order, and its sketch."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, cuts = Shingler(n), np.arange(VERTICAL + 1, dtype=np.uint64)
        for rows, texts in slices(batches):
            hashes = [shingler.hashes(t) for t in texts]
            ends = [np.searchsorted((h >> np.uint64(32)) * np.uint64(VERTICAL) >> np.uint64(32), cuts) for h in hashes]
            parts = [[h[a:b].view(np.int64) for a, b in zip(e, e[1:])] for h, e in zip(hashes, ends)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(parts, pa.list_(pa.list_(pa.int64()))), pa.array([sketch(h) for h in hashes], pa.binary())], ["rep", "parts", "bits"])

    return cut


def block_candidates(num: int, den: int, nearest: bool):
    """Pairs between groups in one block, or between two blocks, of a cluster, that their sketches allow to be similar.

    nearest: for each set the pair of the least distance alone; else all, once each.
    """

    def find(rows: pa.Table) -> pa.Table:
        rep, n, group, block = (rows.column(c).to_numpy() for c in ("rep", "n", "group", "block"))
        bits, size = rows.column("bits").to_pylist(), np.array([sketch_bits(x) for x in n])
        two = block.min() != block.max()  # pairs inside a block are compared elsewhere
        out: list[list] = [[], [], [], [], []]
        members = {k: np.flatnonzero(size == k) for k in np.unique(size)}
        words = {k: np.frombuffer(b"".join([bits[i] for i in at]), np.uint64).reshape(len(at), -1) for k, at in members.items()}
        half = {k: halved(m) for k, m in words.items() if k - 1 in members}
        for k, at in members.items():
            for i, own in zip(at, range(len(at))):
                found, distance = [], []
                for p in (k - 1, k, k + 1):
                    if p not in members:
                        continue
                    others = members[p]
                    near = (group[others] != group[i]) & (np.minimum(n[others], n[i]) * den >= np.maximum(n[others], n[i]) * num)
                    if two:
                        near &= block[others] != block[i]
                    if not nearest:
                        near &= rep[others] > rep[i]
                    pick = np.flatnonzero(near)
                    if not len(pick):
                        continue
                    theirs, mine = (half[p] if p > k else words[p])[pick], (half[k] if p < k else words[k])[own]
                    differ = np.bitwise_count(theirs ^ mine).sum(axis=1, dtype=np.int64)
                    ok = differ <= (n[others[pick]] + n[i]) * (den - num) // (den + num)
                    found.append(others[pick[ok]])
                    distance.append(differ[ok])
                found, distance = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found, distance))
                if nearest and len(found) > 1:
                    best = np.lexsort((rep[found], distance))[:1]
                    found, distance = found[best], distance[best]
                for column, value in zip(out, (np.full(len(found), rep[i]), np.full(len(found), n[i]), rep[found], n[found], distance)):
                    column.append(value)
        return pa.table({c: pa.array(np.concatenate(v), pa.int64()) for c, v in zip(("rep", "n", "hub", "nh", "distance"), out)})

    return find


PAIR = ["rep", "n", "hub", "nh"]


class JaccardJoin:
    """One run over a table of documents."""

    def __init__(self, docs: DataFrame, n: int = SHINGLE, num: int = NUM, den: int = DEN):
        self.docs, self.n, self.num, self.den = id_and_text(docs), n, num, den
        self.work = Workspace(docs.sparkSession, "jaccard")

    def similar_sizes(self, a: str, b: str) -> F.Column:
        return F.least(a, b) * self.den >= F.greatest(a, b) * self.num

    def few(self, ids: DataFrame, name: str) -> DataFrame:
        """A written list of ids, broadcast if it is short enough."""
        ids = self.work.keep(ids, name)
        return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids

    def rarest(self, shown: DataFrame) -> DataFrame:
        """(key, rep, n): the n-grams of (rep, n, need, key) that candidates must be sought by. N-grams that one set alone shows go."""
        shared = self.work.keep(shown.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "keys")
        self.work.release()
        found = shown.join(shared, "key")
        by_set = Window.partitionBy("rep").orderBy(F.desc("c"), "key")  # a set's own n-grams
        kept = self.work.keep(found.withColumn("rank", F.row_number().over(by_set)).where("rank >= need").select("key", "rep", "n"), "kept")
        self.work.drop("keys")
        self.work.release()
        return kept.join(kept.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key"), "key", "left_semi")

    def sets(self, buckets: DataFrame) -> DataFrame:
        """Fragments and sketches of the sets that share a key with another."""
        ids = self.few(buckets.select("rep").distinct(), "ids")
        texts = self.docs.join(ids, self.docs["row"] == F.col("rep"), "left_semi").select("row", "text")
        return self.work.keep(texts.mapInArrow(_fragmenter(self.n), "rep long, parts array<array<long>>, bits binary"), "sets")

    def linked(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """Those of the pairs (rep, n, hub, nh) that are similar, as (a, b): partial overlaps, then their sums.

        A set moves once for each pair that it is the rep of, a hub's fragments once alone.
        """
        own = sets.select("rep", F.posexplode("parts").alias("fragment", "grams"))
        hubs = sets.select(F.col("rep").alias("hub"), F.posexplode("parts").alias("fragment", "hub_grams"))
        partial = pairs.join(own, "rep").join(hubs, ["hub", "fragment"]).select(*PAIR, F.size(F.array_intersect("grams", "hub_grams")).alias("part"))
        both = partial.groupBy(*PAIR).agg(F.sum("part").alias("both"))
        return both.where(F.col("both") * self.den >= (F.col("n") + F.col("nh") - F.col("both")) * self.num).select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b"))

    def hubs(self, buckets: DataFrame, salt: str) -> DataFrame:
        """For every set, the hub it shares most keys with among those of other groups; linear in the buckets."""
        hub = buckets.groupBy("key").agg(F.min(F.struct(F.xxhash64("rep", F.lit(salt)), "rep", "n", "group")).alias("hub"))
        shared = (
            buckets.join(hub, "key")
            .where((F.col("hub.group") != F.col("group")) & self.similar_sizes("n", "hub.n"))
            .groupBy("rep", "n", F.col("hub.rep").alias("hub"), F.col("hub.n").alias("nh"))
            .count()
        )
        return shared.groupBy("rep", "n").agg(F.max(F.struct("count", "hub", "nh")).alias("best")).select("rep", "n", "best.hub", "best.nh")

    def clusters(self, buckets: DataFrame) -> DataFrame:
        """(rep, n, group, cluster) of the sets of buckets; edges lead to each key's least set, so they are linear in the buckets."""
        star = buckets.join(buckets.groupBy("key").agg(F.min("rep").alias("b")), "key").where("rep <> b").select(F.col("rep").alias("a"), "b").distinct()
        tied = connected_components(star, self.work, "clusters_").select(F.col("node").alias("rep"), F.col("component").alias("cluster"))
        return self.work.keep(buckets.select("rep", "n", "group").distinct().join(tied, "rep"), "clusters")

    def meetings(self, clusters: DataFrame, sets: DataFrame, nearest: bool) -> DataFrame:
        """Pairs of groups of a cluster, as far as their sketches allow a link. A cluster is cut into
        blocks of bounded size, and every two blocks meet in a task of their own."""
        blocks = clusters.groupBy("cluster").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_GRAMS)).cast("int").alias("blocks"))
        placed = clusters.join(blocks, "cluster").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).join(sets.select("rep", "bits"), "rep")
        met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "n", "group", "bits")
        return met.groupBy("cluster", "i", "j").applyInArrow(block_candidates(self.num, self.den, nearest), "rep long, n long, hub long, nh long, distance long")

    def regroup(self, rows: DataFrame, by: str, links: DataFrame, name: str) -> DataFrame:
        """Rows with their sets' groups so far; buckets and clusters within one group can't connect anything more."""
        groups = connected_components(links, self.work, f"groups_{name}_")
        columns = [c for c in rows.columns if c != "group"]
        now = rows.drop("group").join(groups.withColumnRenamed("node", "rep"), "rep", "left").select(*columns, F.coalesce("component", "rep").alias("group"))
        now = self.work.keep(now, f"grouped_{name}")
        still = now.groupBy(by).agg(F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo <> hi").select(by)
        now = self.work.keep(now.join(still, by, "left_semi"), f"open_{name}")
        self.work.drop(f"grouped_{name}")
        self.work.release()
        return now

    def links(self, buckets: DataFrame) -> DataFrame:
        """Links that connect all that is connected."""
        sets, links, done = self.sets(buckets), None, None  # the pairs that are done are never compared again
        rows, by = buckets, "key"
        for turn in ("hub0", "hub1", "near0", "near1", "all"):
            if turn == "near0":
                rows, by = self.clusters(rows), "cluster"
            if by == "key":
                pairs = self.hubs(rows, turn)
            elif turn == "all":
                pairs = self.meetings(rows, sets, False).select(*PAIR)
            else:
                near = self.work.keep(self.meetings(rows, sets, True), turn)
                rows = rows.join(self.few(near.select("rep").distinct(), f"active_{turn}"), "rep", "left_semi")
                pairs = near.groupBy("rep", "n").agg(F.min(F.struct("distance", "hub", "nh")).alias("best")).select("rep", "n", "best.hub", "best.nh")
            pairs = pairs.withColumns({"a": F.least("rep", "hub"), "b": F.greatest("rep", "hub")}).dropDuplicates(["a", "b"])
            if done is not None:
                pairs = pairs.join(done, ["a", "b"], "left_anti")
            pairs = self.work.keep(pairs, f"pairs_{turn}")
            done = pairs.select("a", "b") if done is None else done.unionByName(pairs.select("a", "b"))
            new = self.work.keep(self.linked(pairs.select(*PAIR), sets), f"links_{turn}")
            links = new if links is None else links.unionByName(new)
            self.work.release()
            if turn != "all":
                rows = self.regroup(rows, by, links, turn)
                if rows.isEmpty():
                    break
        return links

    def run(self) -> DataFrame:
        repeated = not self.docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()
        # an id that stands in several rows doesn't name one of them
        self.docs = self.work.keep(self.docs.withColumn("row", F.monotonically_increasing_id()), "rows") if repeated else self.docs.withColumn("row", F.col("doc_id"))
        names = self.docs.select("row", "doc_id")
        signed = self.work.keep(self.docs.select("row", "text").mapInArrow(_signer(self.n, self.num, self.den, EXTRA), "row long, n long, sign binary, need int, keys array<long>"), "signed")
        rows = self.work.keep(signed.select("row", "n", "sign").join(names, "row") if repeated else signed.select("row", "n", "sign", F.col("row").alias("doc_id")), "sizes")
        equal = self.work.keep(rows.where("n > 0 and doc_id is not null").groupBy("sign").agg(F.min("row").alias("rep"), F.max("row").alias("last"), F.min("doc_id").alias("least")), "equal")
        others = rows.where("n > 0").join(equal.where("last > rep"), "sign").where("doc_id is null or row > rep").select("row") if repeated else rows.where("n > 0").join(equal.where("last > rep"), "sign").where("row > rep").select("row")
        own = signed.where("n > 0 and row is not null").join(self.few(others, "copies"), "row", "left_anti")
        if repeated:
            own = own.join(self.few(names.where("doc_id is null").select("row"), "unnamed"), "row", "left_anti")
        buckets = self.work.keep(self.rarest(own.select(F.col("row").alias("rep"), "n", "need", F.explode("keys").alias("key"))).withColumn("group", F.col("rep")), "buckets")
        self.work.drop("kept", "signed")
        self.work.release()
        components = connected_components(self.links(buckets), self.work).withColumnRenamed("node", "rep")
        groups = equal.join(components, "rep", "left").select("sign", F.coalesce("component", "rep").alias("component"), "least")
        if repeated:
            groups = groups.join(groups.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("sign", "component_id")
        else:
            groups = groups.select("sign", F.col("component").alias("component_id"))
        return rows.join(groups, "sign", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def jaccard_components(docs: DataFrame, n: int = SHINGLE, num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    return JaccardJoin(docs, n, num, den).run()
