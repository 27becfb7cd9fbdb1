"""SimHash near-duplicates by a forest of vantage-point trees.

Fingerprints link at `radius` or fewer differing bits; linked ones form groups.

Why a forest
------------
Fingerprints of unrelated texts differ in 32 bits, give or take 4. One tree over
all 64 bits with a search radius of 4 must enter both sides of a median split for
three in four queries: a level saves 13 % of the pairs and copies 37 % of the
fingerprints, so pairs grow almost with the square of the corpus. So each tree
measures distance on some of the bits only. The bits are cut into m bands; of
two fingerprints within 4 bits, some c bands together hold at most one of the
differing bits, whatever bits these are (m = 3 and c = 1, or 5 and 2, 6 and 3, as
the corpus grows). There is one tree for each choice of c bands, and its search
radius is 1: a level saves 33 % of the pairs, and copies 17 % of the fingerprints.

A tree
------
A node has a vantage point, one of `POINTS` fingerprints taken from the data by
hash, and a distance near the median. What is within that distance of the point
is near, the rest far. A far fingerprint whose distance is within the radius of
the boundary visits the near side, too; on its way down a visitor goes to every
side that the triangle bound cannot rule out. So each fingerprint is at home in
one leaf, a shard, and visits those where something within its radius may be;
all others are pruned. A node's point is chosen by a hash of the node's path, so
that a tree of any depth needs no more than the points. Shards are dealt to tasks.

Within a shard the same tree goes on, with points out of the shard and the same
search radius, down to leaves where members at home meet each other and the
visitors with their exact distance over all 64 bits. Subtrees whose members are
already in one group are not searched. A shard gives back the edges of a spanning
forest, so no group is written out as pairs. A shard with over `split` members, as
a sample by hash says, is dealt in chunks to tasks for all pairs of chunks.

Equal fingerprints are one from the start: a text that a third of all rows hold
is one member. Groups are found in Spark (see _components); nothing is collected.

Defined results: a text without words has fingerprint zero, which links like
any other; a null text is such a text; null ids keep their fingerprint and are
passed over for component_id, which is null if a group has no other; repeated
rows are returned as often; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from quern.llm._components import components
from quern.llm._store import exactly_once, row_keys, shuffle_partitions, unused, written
from quern.llm._text import ASCII_LOWER, NON_SPACE, as_text, byte_view, find_words, mix, release, slices

RADIUS, BITS = 4, 64
SHARD_SIZE, SPLIT, SAMPLE, POINTS = 4096, 65_536, 1024, 4096
_SMALL = 64


#: For each byte, eight lanes of a byte with one of its bits each.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8").ravel()


def majority(values: np.ndarray, step: np.ndarray) -> np.ndarray:
    """For each group of values step[i]:step[i + 1], none empty: the bits that are set in over half of them.

    Bits are added up as lanes of a byte, at most 255 at a time.
    """
    out = np.empty(len(step) - 1, np.uint64)
    for a, b in slices(step, 1 << 17):
        begin, n = step[a:b] - step[a], np.diff(step[a : b + 1])
        blocks = -(-n // 255)
        first = np.cumsum(blocks) - blocks
        starts = np.repeat(begin, blocks) + 255 * (np.arange(blocks.sum()) - np.repeat(first, blocks))
        lanes = _LANES[values[step[a] : step[b]].astype("<u8").view(np.uint8).reshape(-1, 8)]
        sums = np.add.reduceat(lanes, starts, axis=0).view(np.uint8).reshape(len(starts), 64)
        ones = np.add.reduceat(sums, first, axis=0, dtype=np.int64)
        out[a:b] = np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def simhash(texts: pa.Array, width: int = 4, seed: int = 42) -> np.ndarray:
    """Fingerprints: a bit is set if it is in over half of the shingles' XXH64."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    data, offsets = byte_view(as_text(texts))
    out = np.zeros(len(texts), np.uint64)
    for lo, hi in slices(offsets):
        words = find_words(ASCII_LOWER[data[offsets[lo] : offsets[hi]]], offsets[lo : hi + 1] - offsets[lo], NON_SPACE)
        if not len(words.starts):
            continue
        lengths = words.ends - words.starts
        begin = np.concatenate([[0], np.cumsum(lengths + 1)])  # words joined by one space
        place = np.arange(begin[-1]) + np.repeat(words.starts - begin[:-1], lengths + 1)
        joined = np.append(words.data, np.uint8(0))[place]
        joined[begin[1:] - 1] = 0x20
        counts = words.counts
        shingles = np.where(counts > 0, np.maximum(counts - width + 1, 1), 0)
        at = np.repeat(words.first[:-1] - np.concatenate([[0], np.cumsum(shingles)[:-1]]), shingles) + np.arange(shingles.sum())
        last = np.minimum(at + width, np.repeat(words.first[1:], shingles)) - 1
        raw = joined.tobytes()
        values = np.array([digest(raw[s:e], seed) for s, e in zip(begin[at].tolist(), (begin[last] + lengths[last]).tolist(), strict=True)], dtype="<u8")
        full = np.flatnonzero(shingles)
        step = np.concatenate([[0], np.cumsum(shingles[full])])
        out[lo + full] = majority(values, step)
    release()
    return out


@F.arrow_udf(LongType())
def _fingerprint(texts: pa.Array) -> pa.Array:
    return pa.array(simhash(texts).view(np.int64))


def fingerprint(text: str | Column) -> Column:
    """The fingerprint of a text column, as a signed 64-bit integer."""
    return _fingerprint((F.col(text) if isinstance(text, str) else text).cast("string"))


def band_masks(n: int, radius: int = RADIUS, shard_size: int = SHARD_SIZE) -> tuple[np.ndarray, int]:
    """The bits of each tree for n fingerprints, and the trees' search radius.

    If the differing bits are spread over m bands as evenly as can be, the c bands
    with fewest hold c * (radius // m) of them and what remains beyond m - c bands;
    no other spread leaves more. Trees take the first m at which this is 1 (or 0)
    and a shard of all that differ in a bit at most has `shard_size` members.
    """
    for m in range(1, 2 * radius + 2):
        held = {c: c * (radius // m) + max(0, radius % m - (m - c)) for c in range(1, m + 1)}
        c = max((c for c, x in held.items() if x <= 1), default=0)
        bits = BITS * c // m
        if c and (n * (bits + 1) / 2**bits <= shard_size or m > 2 * radius):
            break
    cuts = [round(i * BITS / m) for i in range(m + 1)]
    bands = [sum(1 << j for j in range(x, y)) for x, y in zip(cuts, cuts[1:], strict=False)]
    return np.array([sum(x) for x in combinations(bands, c)], dtype=np.uint64), held[c]


@dataclass(frozen=True)
class Forest:
    """Trees over `masks`; a node's vantage point is one of `points`, its boundary the point's of `middles` in that tree."""

    masks: np.ndarray
    share: int
    points: np.ndarray
    middles: np.ndarray
    depth: int

    @classmethod
    def of(cls, points: np.ndarray, n: int, radius: int = RADIUS, shard_size: int = SHARD_SIZE) -> Forest:
        """For n fingerprints, of which `points` are some."""
        masks, share = band_masks(n, radius, shard_size)
        points = points if len(points) else np.zeros(1, np.uint64)
        middles = np.zeros((len(masks), len(points)), np.int64)
        seen = points[:256]
        for t, mask in enumerate(masks):
            d = np.sort(np.bitwise_count((points[:, None] ^ seen) & mask), axis=1)
            half = d[:, len(seen) // 2].astype(np.int64)
            within, below = ((d <= x[:, None]).mean(axis=1) for x in (half, half - 1))
            middles[t] = np.where(within - 0.5 <= 0.5 - below, half, half - 1)
        return cls(masks, share, points, middles, min(40, max(0, math.ceil(math.log2(max(n, 1) / shard_size)))))

    def route(self, x: np.ndarray, tree: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, leaf, at home or visiting) of each fingerprint in all leaves that it enters."""
        who, node, home = np.arange(len(x)), np.ones(len(x), np.int64), np.ones(len(x), bool)
        for _ in range(self.depth):
            at = (mix(node.astype(np.uint64) + np.uint64((tree + 1) << 48)) % np.uint64(len(self.points))).astype(np.int64)
            d = np.bitwise_count((x[who] ^ self.points[at]) & self.masks[tree]).astype(np.int64) - self.middles[tree, at]
            near = np.where(home, d <= 0, d <= self.share)
            far = np.where(home, d > 0, d > -self.share)
            over = home & (d > 0) & (d <= self.share)
            who = np.concatenate([who[near], who[far], who[over]])
            home = np.concatenate([home[near], home[far], np.zeros(over.sum(), bool)])
            node = np.concatenate([2 * node[near], 2 * node[far] + 1, 2 * node[over]])
        return who, node, home


class _Union:
    """Union-find over positions, in numpy."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, at: np.ndarray) -> np.ndarray:
        root = self.parent[at]
        while not np.array_equal(up := self.parent[root], root):
            root = up
        self.parent[at] = root
        return root

    def union(self, at: np.ndarray) -> None:
        roots = np.unique(self.find(at))
        self.parent[roots] = roots[0]


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits; the last axis holds the words of a fingerprint."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int16)


def link(x: np.ndarray, radius: int = RADIUS, leaf: int = 256, home: np.ndarray | None = None, mask: np.uint64 | None = None, share: int | None = None) -> np.ndarray:
    """For distinct fingerprints (n, words): the position of each one's group, by a vantage-point tree.

    Links are searched between those at `home` and all; distances to vantage points
    count the bits in `mask` only, where linked fingerprints differ in `share` at most.
    """
    x = x.reshape(len(x), -1)
    share = radius if share is None else share
    measured = x if mask is None else x & mask
    forest = _Union(len(x))
    stack = [(np.arange(len(x)), np.zeros(0, np.int64), 0)] if home is None else [(np.flatnonzero(home), np.flatnonzero(~home), 0)]
    while stack:
        own, query, tries = stack.pop()
        if not len(own):
            continue
        roots = forest.find(own)
        if (roots == roots[0]).all():  # what is linked already needs no search
            query = query[forest.find(query) != roots[0]]
            if not len(query):
                continue
        if len(own) <= leaf or tries > 4:
            others = np.concatenate([own, query])
            step = max(1, (1 << 19) // (len(others) * x.shape[1]))
            for k in range(0, len(own), step):
                rows = own[k : k + step]
                near = _distance(x[rows][:, None], x[others]) <= radius
                for i in np.flatnonzero(near.sum(axis=1) > 1):
                    forest.union(others[near[i]])
            continue
        v = measured[own[(len(own) * (tries + 1)) // 6]]
        d, dq = _distance(measured[own], v), _distance(measured[query], v)
        mid = int(np.partition(d, len(d) // 2)[len(d) // 2])
        if np.count_nonzero(d < mid) > np.count_nonzero(d > mid) or (d <= mid).all():
            mid -= 1
        near = d <= mid
        if not near.any() or near.all():
            stack.append((own, query, tries + 1))
            continue
        far = own[~near]
        stack.append((far, query[dq > mid - share], 0))
        stack.append((own[near], np.concatenate([query[dq <= mid + share], far[d[~near] <= mid + share]]), 0))
    return forest.find(np.arange(len(x)))


def shard_groups(shard: np.ndarray, x: np.ndarray, radius: int) -> np.ndarray:
    """For rows sorted by shard, without repeats in one: the position of the first of each one's group in its shard."""
    x = x.reshape(len(x), -1)
    cut = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]]))
    sizes = np.diff(cut)
    root = np.arange(len(x))
    small = np.repeat(sizes <= _SMALL, sizes)
    pairs = []
    for k in range(1, _SMALL):
        i = np.flatnonzero(small[:-k] & (shard[:-k] == shard[k:])) if k < len(x) else np.zeros(0, np.int64)
        if not len(i):
            break
        parts = [j[_distance(x[j], x[j + k]) <= radius] for j in np.array_split(i, 1 + len(i) // (1 << 18))]
        pairs += [(j, j + k) for j in parts]
    if pairs:
        i, j = (np.concatenate(p) for p in zip(*pairs, strict=True))
        while True:
            before = root.copy()
            np.minimum.at(root, j, root[i])
            np.minimum.at(root, i, root[j])
            root = root[root]
            if np.array_equal(before, root):
                break
    for s in np.flatnonzero(sizes > _SMALL):
        root[cut[s] : cut[s + 1]] = cut[s] + link(x[cut[s] : cut[s + 1]], radius)
    return root


def _linker(forest: Forest, radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b["tree"].to_numpy(), b["shard"].to_numpy(), b["fp"].to_numpy(), b["home"].to_numpy(zero_copy_only=False)) for b in batches if len(b)]
        if not got:
            return
        tree, shard, x, home = (np.concatenate(p) for p in zip(*got, strict=True))
        del got
        x, order = x.view(np.uint64), np.lexsort((shard, tree))
        tree, shard, x, home = tree[order], shard[order], x[order], home[order]
        cut = np.flatnonzero(np.concatenate([[True], (tree[1:] != tree[:-1]) | (shard[1:] != shard[:-1]), [True]]))
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            own = x[lo:hi]
            root = link(own, radius, home=home[lo:hi], mask=forest.masks[tree[lo]], share=forest.share)
            edge = root != np.arange(hi - lo)
            if edge.any():
                yield pa.RecordBatch.from_arrays([pa.array(own[edge].view(np.int64)), pa.array(own[root[edge]].view(np.int64))], ["a", "b"])

    return run


def _dealer(forest: Forest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 1 << 14):
                x = batch["fp"].to_numpy()[lo : lo + (1 << 14)]
                for t in range(len(forest.masks)):
                    who, leaf, home = forest.route(x.view(np.uint64), t)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(who), t, np.int32)), pa.array(leaf), pa.array(x[who]), pa.array(home)], ["tree", "shard", "fp", "home"])

    return run


_DEALT = "tree int, shard long, fp long, home boolean"


def deal(distinct: DataFrame, forest: Forest, n: int, split: int = SPLIT) -> DataFrame:
    """(tree, shard, fp, home) of the n fingerprints in each shard that they enter; shards of over `split` as pairs of chunks.

    Pair (i, j) has the members at home of chunk i, and as visitors all other
    members of chunk j; of those at home, j > i alone.
    """
    dealt = distinct.mapInArrow(_dealer(forest), _DEALT)
    if n <= split:
        return dealt
    rate = max(split // SAMPLE, 1)
    sample = distinct.where(F.pmod(F.xxhash64("fp"), F.lit(rate)) == 0).mapInArrow(_dealer(forest), _DEALT)
    hot = written(sample.groupBy("tree", "shard").agg((F.count(F.lit(1)) * rate).alias("members")).where(F.col("members") > split), "hot-shards")
    if not hot.limit(1).count():
        return dealt
    chunks, zero = F.ceil(F.col("members") * 2 / split), F.lit(0).cast("long")
    own, every = F.pmod(F.xxhash64("fp", F.lit(1)), chunks), F.sequence(zero, chunks - 1)

    def pair(i, j, home):
        return F.struct(i.alias("i"), j.alias("j"), home.alias("home"))

    visits = F.transform(F.filter(every, lambda i: ~F.col("home") | (i < own)), lambda i: pair(i, own, F.lit(False)))
    homes = F.when(F.col("home"), F.transform(every, lambda j: pair(own, j, F.lit(True)))).otherwise(F.array().cast("array<struct<i: bigint, j: bigint, home: boolean>>"))
    cool = F.array(pair(zero - 1, zero, F.col("home")))
    joined = dealt.join(F.broadcast(hot), ["tree", "shard"], "left")
    at = joined.select("tree", "shard", "fp", F.explode(F.when(F.col("members").isNull(), cool).otherwise(F.concat(homes, visits))).alias("at"))
    shard = F.when(F.col("at.i") < 0, F.col("shard")).otherwise(F.xxhash64("shard", "at.i", "at.j"))
    return at.select("tree", shard.alias("shard"), "fp", "at.home")


def link_groups(prints: DataFrame, radius: int = RADIUS, shard_size: int = SHARD_SIZE, split: int = SPLIT) -> DataFrame:
    """(node, root) of all fingerprints in `prints` (fp) that have a link to another."""
    distinct = written(prints.select("fp").where("fp IS NOT NULL").distinct(), "prints", prints.count())
    n = distinct.count()
    points = np.array([r["fp"] for r in distinct.orderBy(F.xxhash64("fp", F.lit(2)), "fp").limit(POINTS).collect()], np.int64).view(np.uint64)
    forest = Forest.of(points, n, radius, shard_size)
    entered = sum(len(forest.route(points, t)[0]) for t in range(len(forest.masks))) / max(len(points), 1)
    parts = max(shuffle_partitions(prints.sparkSession), math.ceil(n * entered / 1_000_000))
    spread = distinct.repartition(parts, "fp")  # a task's share enters many shards
    return components(deal(spread, forest, n, split).repartition(parts, "tree", "shard").mapInArrow(_linker(forest, radius), "a long, b long"), len(forest.masks) * n)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shard_size: int = SHARD_SIZE, split: int = SPLIT) -> DataFrame:
    """One row per text: id, fp (signed) and component_id, the smallest id within reach."""
    rows = written(docs.select(F.col(id_col).alias("id"), fingerprint(text_col).alias("fp")), "fingerprints", gather=True)
    groups = link_groups(rows, radius, shard_size, split)
    smallest = rows.groupBy("fp").agg(F.min("id").alias("least"))
    known = written(smallest.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "members", rows.count())
    best = written(known.groupBy("root").agg(F.min("least").alias("component_id")), "groups", rows.count())
    labels = written(known.join(best, "root").select("fp", "component_id"), "labels", rows.count())
    return rows.join(labels, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def firsts(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(key, key2) of the row with the smallest id, null last, of each group in the staged `rows` (id, key, key2, fp)."""
    groups = link_groups(rows, radius)
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "key", "key2")).alias("row")
    smallest = rows.groupBy("fp").agg(first)
    known = smallest.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return known.groupBy("root").agg(F.min("row").alias("row")).select("row.key", "row.key2")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """`docs` with one row of each group: that with the smallest id, null last.

    Rows that are equal throughout count once. Texts are shuffled once.
    """
    names = unused(docs, "key", "key2")
    keys = row_keys(id_col, F.col(text_col).cast("string"))
    rows = written(docs.select(F.col(id_col).alias("id"), keys[0].alias("key"), keys[1].alias("key2"), fingerprint(text_col).alias("fp")), "fingerprints", gather=True)
    times = rows.groupBy("key", "key2").agg((F.count(F.lit(1)) > 1).alias("repeated"))
    keep = written(firsts(rows, radius).join(times, ["key", "key2"]).withColumnsRenamed(dict(zip(("key", "key2"), names, strict=True))), "kept", rows.count())
    return exactly_once(docs.select("*", *[k.alias(n) for k, n in zip(keys, names, strict=True)]), keep, names).select(*docs.columns)


def op7_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
