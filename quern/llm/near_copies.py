"""Near copies by word-shingle similarity: SimHash candidates, exact verification.

The contract's fingerprints link at 4 of 64 bits, which near copies of the usual
similarity mostly exceed: at a Jaccard similarity of 0.8 on shingles an expected
15 % of a fingerprint's bits differ. This form of the operator takes shingles of
five words and a SimHash of `WORDS` times 64 bits, and takes fingerprints within
`reach` bits as candidates: the expectation at `similarity` and 3.5 deviations,
71 of 320, while unrelated texts differ in 160 with a deviation of 9.

Each tree partitions the fingerprints by rings of distance 0 on some of the bits,
10 to 16 as their number grows; there are as many trees as let a pair of exactly
`similarity` share a shard with probability `RECALL`. In a shard, a vantage-point
tree over all bits finds the candidates, and gives spanning edges. A shard with
over `split` members, as a sample by hash says that leaves about `SAMPLE` of
them, is dealt in chunks to tasks for all pairs of chunks. Groups are connected
components (see _components); they are candidates only.

In a group, rows in order of id, null last, are judged on whole texts: a row goes
if its set of shingles has a Jaccard similarity of at least `similarity` with a
row that stays, and stays otherwise. So what goes has a near copy that stays, and
no two rows of a group that stay are near copies, whatever chains the candidates
make. A group of over `PIECE` members, or `PIECE_SHINGLES` shingles, is dealt in
pieces by hash: the first piece, which holds the group's first row, is judged;
what it keeps judges all other pieces, in as many tasks; the rest goes on alike.
A round settles a whole piece and all its near copies, not one cluster.

Defined results: a text of fewer words than a shingle is one shingle, one
without words has none; null texts are empty; two texts without words are alike;
texts with the same shingles as often are one from the start, and of those the
smallest id stays; rows that are equal throughout count once; an empty table
gives an empty result. Shingles are told apart by 64 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm._components import components
from quern.llm._store import exactly_once, row_keys, shuffle_partitions, unused, written
from quern.llm._text import ASCII_LOWER, NON_SPACE, as_text, byte_view, find_words, hash_ranges, mix, release, rolling, slices
from quern.llm.simhash_dedup import fingerprint, firsts, majority, shard_groups

SIMILARITY, WIDTH = 0.8, 5
WORDS = 5
RECALL, SPLIT, SAMPLE = 0.99, 65_536, 1024
PIECE, PIECE_SHINGLES = 1024, 1 << 20
_BASE = 0x5851F42D4C957F2D


def _shingle_hashes(texts: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, hashes, first) slice by slice: first[i]:first[i + 1] are those of row + i."""
    data, offsets = byte_view(as_text(texts))
    for lo, hi in slices(offsets):
        words = find_words(ASCII_LOWER[data[offsets[lo] : offsets[hi]]], offsets[lo : hi + 1] - offsets[lo], NON_SPACE)
        h, counts = hash_ranges(words.data, words.starts, words.ends, 3), words.counts
        n = np.where(counts > 0, np.maximum(counts - width + 1, 1), 0)
        first = np.concatenate([[0], np.cumsum(n)])
        at = np.repeat(words.first[:-1] - first[:-1], n) + np.arange(first[-1])
        whole = rolling(np.concatenate([h, np.zeros(width, np.uint64)]), width, _BASE)
        values = mix(whole[at]) if len(at) else np.zeros(0, np.uint64)
        for i in np.flatnonzero((counts > 0) & (counts < width)):  # the whole sequence
            own = np.concatenate([h[words.first[i] : words.first[i + 1]], np.zeros(width - counts[i], np.uint64)])
            values[first[i]] = mix(rolling(own, width, _BASE) + np.uint64(counts[i]))[0]
        yield lo, values, first


def long_simhash(texts: pa.Array, width: int = WIDTH, words: int = WORDS) -> np.ndarray:
    """(n, words) fingerprints: a bit is set if it is in over half of the shingles' hashes."""
    out = np.zeros((len(texts), words), np.uint64)
    for lo, values, first in _shingle_hashes(texts, width):
        n = np.diff(first)
        full = np.flatnonzero(n)
        step = np.concatenate([[0], np.cumsum(n[full])])
        for w in range(words):
            h = mix(values + np.uint64((w + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            out[lo + full, w] = majority(h, step)
    release()
    return out


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text, sorted."""
    return (np.unique(values[a:b]) for _, values, first in _shingle_hashes(texts, width) for a, b in zip(first[:-1], first[1:], strict=True))


def _share(similarity: float) -> float:
    """The share of bits in which texts of this similarity are expected to differ."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def reach(similarity: float, bits: int) -> int:
    """Bits within which texts of this similarity lie: the expectation and 3.5 deviations."""
    share = _share(similarity)
    return math.ceil(bits * share + 3.5 * math.sqrt(bits * share * (1 - share)))


def tree_bits(n: int, similarity: float = SIMILARITY) -> np.ndarray:
    """The bits of each tree, for n fingerprints."""
    bits = min(max(n.bit_length() - 5, 10), 16)
    trees = math.ceil(math.log(1 - RECALL) / math.log(1 - (1 - _share(similarity)) ** bits))
    rng = np.random.default_rng(bits)
    order = np.concatenate([rng.permutation(64 * WORDS) for _ in range(math.ceil(trees * bits / (64 * WORDS)))])
    return order[: trees * bits].reshape(trees, bits)


@F.arrow_udf(T.BinaryType())
def _long_fingerprint(texts: pa.Array) -> pa.Array:
    """The fingerprint, and 64 bits of what shingles there are."""
    own = np.zeros(len(texts), np.uint64)
    for lo, values, first in _shingle_hashes(texts, WIDTH):
        full = np.flatnonzero(np.diff(first))
        if len(full):
            own[lo + full] = np.add.reduceat(mix(values + np.uint64(_BASE)), first[full])
    return pa.array([x.tobytes() for x in np.column_stack([long_simhash(texts), own])], pa.binary())


@F.arrow_udf(T.BinaryType())
def _shingles(texts: pa.Array) -> pa.Array:
    out = pa.array([x.tobytes() for x in shingle_sets(texts)], pa.binary())
    release()
    return out


def _dealer(chosen: np.ndarray):
    trees, bits = chosen.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 1024):
                part = batch.slice(lo, 1024)
                raw = part["print"].to_pylist()
                ones = np.unpackbits(np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1), axis=1, bitorder="little")
                bands = np.zeros((len(raw), trees, 16), np.uint8)
                bands[:, :, :bits] = ones[:, chosen.ravel()].reshape(len(raw), trees, bits)
                shards = (np.arange(trees) << 16) + np.packbits(bands, axis=2, bitorder="little").view("<u2")[:, :, 0]
                yield pa.RecordBatch.from_arrays([pa.array(shards.T.ravel(), pa.int64()), pa.concat_arrays([part["key"]] * trees), pa.array(raw * trees, pa.binary())], ["shard", "key", "print"])

    return run


def _linker(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b["shard"].to_numpy(), b["key"].to_numpy(), np.frombuffer(b"".join(b["print"].to_pylist()), np.uint64).reshape(len(b), -1)) for b in batches if len(b)]
        if got:
            shard, key, x = (np.concatenate(p) for p in zip(*got, strict=True))
            order = np.lexsort((key, shard))
            shard, key, x = shard[order], key[order], x[order]
            root = shard_groups(shard, x, radius)
            own = root != np.arange(len(x))
            yield pa.RecordBatch.from_arrays([pa.array(key[own]), pa.array(key[root[own]])], ["a", "b"])

    return run


def deal(prints: DataFrame, n: int, chosen: np.ndarray, split: int = SPLIT) -> DataFrame:
    """(shard, key, print) for each tree; shards of over `split` of the n members as pairs of chunks."""
    every = "shard long, key long, print binary"
    dealt = prints.mapInArrow(_dealer(chosen), every)
    if n <= split:
        return dealt
    rate = max(split // SAMPLE, 1)
    sample = prints.where(F.pmod(F.xxhash64("key"), F.lit(rate)) == 0).mapInArrow(_dealer(chosen), every)
    hot = written(sample.groupBy("shard").agg((F.count(F.lit(1)) * rate).alias("count")).where(F.col("count") > split), "hot-shards")
    if not hot.limit(1).count():
        return dealt
    chunks = F.ceil(F.col("count") * 2 / split)
    own = F.pmod(F.xxhash64("key", F.lit(1)), chunks)
    cool = F.col("count").isNull()
    pair = F.explode(F.when(cool, F.array(F.lit(-1).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), chunks - 1))).alias("other")
    joined = dealt.join(F.broadcast(hot), "shard", "left").select("shard", "key", "print", "count", own.alias("own"), pair)
    return joined.select(F.when(cool, F.col("shard")).otherwise(F.xxhash64("shard", F.least("own", "other"), F.greatest("own", "other"))).alias("shard"), "key", "print")


def candidate_groups(prints: DataFrame, similarity: float = SIMILARITY, split: int = SPLIT) -> DataFrame:
    """(node, root) of the keys in `prints` (key, print) that have another within reach in some shard."""
    n = prints.count()
    chosen = tree_bits(n, similarity)
    parts = max(shuffle_partitions(prints.sparkSession), -(-n * len(chosen) // 300_000))
    spread = prints.repartition(parts, "key")  # a task's share enters many shards
    return components(deal(spread, n, chosen, split).repartition(parts, "shard").mapInArrow(_linker(reach(similarity, 64 * WORDS)), "a long, b long"), len(chosen) * n)


def _groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, leads, hashes, first) of the rows with equal values in `by`, which come together; hashes[first[i]:first[i + 1]] is a set."""

    def whole(held):
        sets = [np.frombuffer(x, np.uint64) for _, _, x in held]
        return [k for k, _, _ in held], np.array([x for _, x, _ in held]), np.concatenate(sets), np.concatenate([[0], np.cumsum([len(x) for x in sets])])

    held, last = [], None
    for batch in batches:
        for *own, key, lead, shingles in zip(*(batch[c].to_pylist() for c in [*by, "key", "lead"]), batch["set"], strict=True):
            if held and own != last:
                yield whole(held)
                held = []
            held.append((key, lead, shingles.as_py()))
            last = own
    if held:
        yield whole(held)


def judge(hashes: np.ndarray, first: np.ndarray, similarity: float, leads: np.ndarray | None = None) -> np.ndarray:
    """For sets in order: whether each goes, as one that stays is alike. Given `leads`, only those count as staying."""
    n = len(first) - 1
    sizes, gone = np.diff(first), np.zeros(n, bool)
    known, ids = np.unique(hashes, return_inverse=True)
    mark = np.zeros(len(known) + 1, bool)
    totals = np.empty(len(ids) + 1, np.int64)
    totals[0] = 0
    for i in range(n):
        if gone[i] or (leads is not None and not leads[i]):
            continue
        mark[ids[first[i] : first[i + 1]]] = True
        start = first[i + 1]
        np.cumsum(mark[ids[start:]], out=totals[1 : len(ids) - start + 1])
        both = np.diff(totals[first[i + 1 :] - start])
        mark[ids[first[i] : first[i + 1]]] = False
        either = sizes[i] + sizes[i + 1 :] - both
        alike = both >= similarity * either
        gone[i + 1 :] |= alike if leads is None else alike & ~leads[i + 1 :]
    return gone


def _settle(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, _, hashes, first in _groups(batches, ["root"]):
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(judge(hashes, first, similarity))], ["key", "gone"])

    return run


def _compare(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, leads, hashes, first in _groups(batches, ["root", "piece"]):
            gone = judge(hashes, first, similarity, leads)[~leads]
            own = [k for k, lead in zip(keys, leads, strict=True) if not lead]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(gone)], ["key", "gone"])

    return run


def near_copies(members: DataFrame, similarity: float = SIMILARITY, piece: int = PIECE) -> DataFrame:
    """(key) of the rows of `members` (root, key, id, set) that go, for one that stays in their group."""
    spark = members.sparkSession
    order = F.struct(F.col("id").isNull().alias("last"), "id", "key")
    found, turn = [], 0
    while True:
        shingles = F.length("set") / 8
        sizes = written(members.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / piece), F.ceil(F.sum(shingles) / PIECE_SHINGLES)).cast("long").alias("pieces"), F.min(order)["key"].alias("first")), "sizes")
        heads, large = members, sizes.where("pieces > 1")
        split = bool(large.limit(1).count())
        if split:  # only groups in pieces are staged anew
            at = F.when(F.col("key") == F.col("first"), F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64("key", F.lit(turn)), "pieces"))
            dealt = written(members.join(large, "root").select("root", "key", "id", "set", "pieces", at.alias("piece"), F.lit(False).alias("lead")), "pieces")
            heads = members.join(sizes.where("pieces <= 1"), "root", "left_semi").unionByName(dealt.where("piece = 0").select(*members.columns))
        heads = heads.repartition(shuffle_partitions(spark), "root").sortWithinPartitions("root", F.col("id").isNull(), "id", "key")
        settled = written(heads.select("root", "key", F.lit(False).alias("lead"), "set").mapInArrow(_settle(similarity), "key long, gone boolean"), "settled", gather=True)
        found.append(settled.where("gone").select("key"))
        if not split or not dealt.where("piece > 0").limit(1).count():
            break
        rest = dealt.where("piece > 0")
        stay = dealt.where("piece = 0").join(settled.where("NOT gone").select("key"), "key")
        stay = stay.select("root", "key", "set", F.explode(F.sequence(F.lit(1).cast("long"), F.col("pieces") - 1)).alias("piece"), F.lit(True).alias("lead"))
        both = rest.select("root", "key", "set", "piece", "lead").unionByName(stay)
        both = both.repartition(shuffle_partitions(spark), "root", "piece").sortWithinPartitions("root", "piece", F.desc("lead"), "key")
        judged = written(both.mapInArrow(_compare(similarity), "key long, gone boolean"), "compared", gather=True)
        found.append(judged.where("gone").select("key"))
        members = written(rest.join(judged.where("NOT gone").select("key"), "key").select("root", "key", "id", "set"), "members")
        turn += 1
    out = found[0]
    for part in found[1:]:
        out = out.unionAll(part)
    return out


def _without(docs: DataFrame, rows: DataFrame, among: DataFrame, id_col: str, text_col: str, similarity: float, piece: int) -> DataFrame:
    """`docs` less near copies, of the rows whose keys are `among`; `rows` (id, key, key2, row, print) are staged, one for each of `docs`."""
    text = F.col(text_col).cast("string")
    names = unused(docs, "key", "key2")
    keys = [k.alias(n) for k, n in zip(row_keys(id_col, text), ("key", "key2"), strict=True)]
    n = rows.count()
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "key", "key2", "row")).alias("first")
    nodes = written(among.groupBy("print").agg(first).select(F.substring("print", 1, 8 * WORDS).alias("print"), "first.row", "first.key", "first.key2", "first.id"), "nodes", n)
    groups = candidate_groups(nodes.select(F.col("row").alias("key"), "print"), similarity)
    linked = written(nodes.join(groups.withColumnRenamed("node", "row"), "row").select("row", "key", "key2", "id", "root"), "linked", n)
    own = docs.select(*keys, text.alias("text")).join(linked.hint("merge"), ["key", "key2"]).dropDuplicates(["row"])
    members = written(own.select("root", F.col("row").alias("key"), "id", _shingles("text").alias("set")), "members")
    drop = near_copies(members, similarity, piece).select(F.col("key").alias("row"))
    times = rows.groupBy("key", "key2").agg((F.count(F.lit(1)) > 1).alias("repeated"))
    kept = nodes.select("row", "key", "key2").join(drop, "row", "left_anti").join(times, ["key", "key2"])
    keep = written(kept.select(*[F.col(k).alias(n) for k, n in zip(("key", "key2"), names, strict=True)], "repeated"), "kept", n)
    own_keys = [k.alias(n) for k, n in zip(row_keys(id_col, text), names, strict=True)]
    return exactly_once(docs.select("*", *own_keys), keep, names).select(*docs.columns)


def _rows(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """(id, key, key2, row, print) and `more` of each of `docs`, staged."""
    text = F.col(text_col).cast("string")
    keys = [k.alias(n) for k, n in zip(row_keys(id_col, text), ("key", "key2"), strict=True)]
    return written(docs.select(F.col(id_col).alias("id"), *keys, F.monotonically_increasing_id().alias("row"), _long_fingerprint(text).alias("print"), *more), "long-prints", gather=True)


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, piece: int = PIECE) -> DataFrame:
    """`docs` without rows that are as similar to a row of their group that stays."""
    rows = _rows(docs, id_col, text_col)
    return _without(docs, rows, rows, id_col, text_col, similarity, piece)


def firsts_without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, piece: int = PIECE) -> DataFrame:
    """The rows of `without_near_copies` over those of `simhash_dedup.one_of_each`, which are told by keys: their texts are not staged."""
    rows = _rows(docs, id_col, text_col, fingerprint(text_col).alias("fp"))
    among = rows.join(firsts(rows).hint("merge"), ["key", "key2"])
    return _without(docs, rows, among, id_col, text_col, similarity, piece)
