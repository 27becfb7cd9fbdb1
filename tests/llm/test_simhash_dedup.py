import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from quern.llm import simhash_dedup as S
from quern.llm._components import components

SF = "/root/testdata/sf0.001"


def brute_print(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def brute_groups(prints, radius=4):
    prints = sorted(set(prints))
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, p in enumerate(prints):
        for q in prints[:i]:
            if bin(p ^ q).count("1") <= radius:
                a, b = sorted((find(p), find(q)))
                root[b] = a
    return {p: find(p) for p in prints}


def brute(rows):
    prints = [brute_print(t) for _, t in rows]
    group = brute_groups(prints)
    least = {}
    for (key, _), p in zip(rows, prints):
        if key is not None:
            least[group[p]] = min(key, least.get(group[p], key))
    return [(key, p, least.get(group[p])) for (key, _), p in zip(rows, prints)]


def clusters(rng, n, spread):
    out = set()
    while len(out) < n:
        centre = rng.getrandbits(64)
        for _ in range(rng.randrange(1, spread)):
            out.add(centre ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(0, 7))) & (2**64 - 1))
    return np.array(sorted(out), dtype=np.uint64)


def test_fingerprints():
    texts = ["", None, "One", "a B c", "a b c d", "x\ty\x0bz  w ä\nß q\x00r s", "long " * 5000, "A-Z ÄÖ é " * 7, "\n \t"]
    assert S.simhash(pa.array(texts, pa.string())).tolist() == [brute_print(t) for t in texts]


@pytest.mark.parametrize("leaf", [4, 32, 256])
def test_tree_finds_all_links(leaf):
    rng = random.Random(leaf)
    for x in (clusters(rng, 700, 60), clusters(rng, 900, 700)):
        got = S.link(x, leaf=leaf)
        want = brute_groups(x.tolist())
        assert len(set(zip(got.tolist(), (want[v] for v in x.tolist())))) == len(set(got.tolist())) == len(set(want.values()))


@pytest.mark.parametrize("size", [10, 10**7, 10**9, 10**11, 10**14])
def test_every_close_pair_differs_in_a_bit_at_most_in_some_tree(size):
    rng = random.Random(size)
    masks, share = S.band_masks(size)
    assert share == 1
    for _ in range(300):
        bits = sum(1 << b for b in rng.sample(range(64), 4))
        assert any((bits & int(m)).bit_count() <= share for m in masks)


@pytest.mark.parametrize("size", [300, 10**5, 10**9])
def test_a_visitor_meets_every_close_one_at_home(size):
    rng = random.Random(size)
    base = [rng.getrandbits(64) for _ in range(300)]
    x = np.array(base + [b ^ sum(1 << i for i in rng.sample(range(64), rng.randrange(1, 5))) for b in base], dtype=np.uint64)
    forest = S.Forest.of(x[:200], size, shard_size=64)
    met = set()
    for t in range(len(forest.masks)):
        who, leaf, home = forest.route(x, t)
        assert sorted(who[home]) == list(range(len(x)))
        at = {}
        for w, n, h in zip(who.tolist(), leaf.tolist(), home.tolist()):
            at.setdefault(n, ([], []))[0 if h else 1].append(w)
        met |= {(min(a, b), max(a, b)) for own, more in at.values() for a in own for b in own + more}
    assert all((i, i + 300) in met for i in range(300))


def test_the_tree_prunes_and_finds_all_links(spark):
    """On the 9,000 fingerprints of a larger table: branches are pruned, visits across boundaries happen, links are those of all pairs."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    table = docs.select(S.fingerprint("text").alias("fp")).distinct()
    x = np.array(sorted(r.fp for r in table.collect()), np.int64).view(np.uint64)
    forest = S.Forest.of(x[:: len(x) // 500], len(x), shard_size=128)
    leaves, entered, visits = 2**forest.depth, 0, 0
    for t in range(len(forest.masks)):
        who, _, home = forest.route(x, t)
        entered, visits = entered + len(who), visits + int((~home).sum())
    assert visits > len(x)  # across boundaries
    assert entered < 0.2 * leaves * len(forest.masks) * len(x)  # all other branches are pruned
    root = np.arange(len(x))
    pairs = [(i, j) for i in range(len(x) - 1) for j in (i + 1 + np.flatnonzero(np.bitwise_count(x[i] ^ x[i + 1 :]) <= 4)).tolist()]
    while True:
        before = root.copy()
        for i, j in pairs:
            root[i] = root[j] = min(root[i], root[j])
        if (before == root).all():
            break
    want = {}
    for i, r in enumerate(root.tolist()):
        want.setdefault(r, set()).add(int(x[i]))
    got = {}
    for r in S.link_groups(table, shard_size=128).collect():
        got.setdefault(r.root, set()).add(r.node % 2**64)
    assert sorted(map(sorted, got.values())) == sorted(sorted(s) for s in want.values() if len(s) > 1)


@pytest.mark.parametrize("split,shard_size", [(64, 32), (10**6, 4096)])
def test_groups_equal_brute_force(spark, split, shard_size):
    rng = random.Random(3)
    x = np.concatenate([clusters(rng, 400, 40), clusters(rng, 300, 300)])
    df = spark.createDataFrame([(int(v),) for v in x.view(np.int64)] * 2, "fp long")
    got = {r.node % 2**64: r.root % 2**64 for r in S.link_groups(df, shard_size=shard_size, split=split).collect()}
    want = brute_groups(x.tolist())
    sizes = {}
    for p, r in want.items():
        sizes.setdefault(r, set()).add(p)
    seen = {}
    for p, r in got.items():
        seen.setdefault(r, set()).add(p)
    assert sorted(map(sorted, seen.values())) == sorted(sorted(s) for s in sizes.values() if len(s) > 1)


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5), (7, 6), (6, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(300)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in S.op7_simhash_dedup(spark, SF).collect()}
    assert got == set(brute(rows))


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "a b"), (None, "only here with no id"), (9, "w " * 9000)]
    df = spark.createDataFrame([(a, b, 0) for a, b in rows], "doc_id long, text string, fp int")
    got = [(r.doc_id, r.fp % 2**64, r.component_id) for r in S.near_duplicates(df).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows), key=repr)
    assert S.near_duplicates(df.limit(0)).collect() == []
