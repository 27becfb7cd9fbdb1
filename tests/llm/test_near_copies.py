import random
import re

import numpy as np
import pyarrow as pa

import corpus_pipeline
from quern.llm import near_copies as N
from quern.llm._store import written
from quern.llm.simhash_dedup import one_of_each
from quern.sources import staging


def sets(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return words


def corpus(rng):
    rows, base = [], [[f"w{rng.randrange(3000)}" for _ in range(rng.randrange(60, 400))] for _ in range(60)]
    for words in base:
        rows.append(" ".join(words))
        rows += [" ".join(edited(rng, words, k)) for k in (1, 2, len(words) // 60, len(words) // 8) for _ in range(2)]
    rows += [None, "", " ", "a b", "A b", "a b c", "a b c d e f", rows[0]]
    return list(enumerate(rows))


def test_fingerprints_follow_shingle_sets():
    rows = ["a b c d e f", "A  b\nc d e f", "a b c d e f g", "a b", "a b c", "", None, " "]
    x = N.long_simhash(pa.array(rows, pa.string()))
    assert (x[0] == x[1]).all() and (x[0] != x[2]).any() and (x[3] != x[4]).any() and not x[5:].any()


def test_long_fingerprints_follow_similarity():
    rng = random.Random(2)
    words = [f"w{rng.randrange(5000)}" for _ in range(600)]
    x = N.long_simhash(pa.array([" ".join(words), " ".join(edited(rng, words, 3)), " ".join(f"v{i}" for i in range(600)), ""], pa.string()))
    d = np.bitwise_count(x[0] ^ x[1:]).sum(axis=1)
    assert d[0] <= N.reach(0.8, 320) < 80 < d[1] and not x[3].any()


def test_one_of_each_group_stays(spark):
    rows = corpus(random.Random(3))
    rows += [(None, rows[9][1]), (4, rows[4][1])]
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, node int")
    kept = [(r.doc_id, r.text) for r in N.without_near_copies(df).collect()]
    left = [sets(t) for _, t in kept]
    dropped = list(rows)
    for r in kept:
        dropped.remove(r)
    assert all(max(similar(sets(t), x) for x in left) >= 0.8 for _, t in dropped)
    missed = sum(similar(a, b) >= 0.8 for i, a in enumerate(left) for b in left[:i])
    assert len(dropped) > 150 and missed <= 0.05 * len(dropped)
    assert (0, rows[0][1]) in kept and len([k for k in kept if k == (4, rows[4][1])]) <= 1
    assert N.without_near_copies(df.limit(0)).collect() == []


def test_shingles_are_those_of_the_definition():
    texts = [t for _, t in corpus(random.Random(1))]
    got = list(N.shingle_sets(pa.array(texts, pa.string())))
    want = [sets(t) for t in texts]
    assert [len(x) for x in got] == [len(x) for x in want]
    for i, j in [(random.randrange(len(texts)), random.randrange(len(texts))) for _ in range(300)]:
        assert len(np.intersect1d(got[i], got[j])) == len(want[i] & want[j])


def test_pairs_at_the_similarity_are_candidates():
    rng = random.Random(4)
    radius, chosen = N.reach(0.8, 320), N.tree_bits(100_000)
    texts, found, pairs = [], 0, 0
    for _ in range(400):
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        texts += [" ".join(words), " ".join(edited(rng, words, 4))]
    x = N.long_simhash(pa.array(texts, pa.string()))
    bits = np.unpackbits(x.view(np.uint8).reshape(len(x), -1), axis=1, bitorder="little")
    for i in range(0, len(texts), 2):
        if 0.8 <= similar(sets(texts[i]), sets(texts[i + 1])) < 0.84:
            differ = bits[i] != bits[i + 1]
            pairs += 1
            found += bool(differ.sum() <= radius and (~differ[chosen].any(axis=1)).any())
    assert pairs > 200 and found >= 0.98 * pairs


def chain(rng, n):
    """Texts of which each is like the next, and like few others."""
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        rows.append(" ".join(words))
        words = words[12:] + [f"y{rng.randrange(10**6)}" for _ in range(12)]
    return rows


def test_chains_keep_what_is_unlike_and_pieces_agree(spark):
    rng = random.Random(5)
    rows = chain(rng, 40)
    base = rows[7].split()
    rows += [" ".join(edited(rng, base, 2)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    for piece in (N.PIECE, 8):
        kept = {r.doc_id for r in N.without_near_copies(df, piece=piece).collect()}
        left = [sets(rows[k]) for k in kept]
        assert 0 in kept
        assert all(max(similar(sets(rows[k]), x) for x in left) >= 0.8 for k in set(range(100)) - kept)
        assert not sum(similar(a, b) >= 0.8 for i, a in enumerate(left) for b in left[:i])


def test_hot_shards_are_split(spark):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 256, 40, dtype=np.uint8)
    family = np.repeat(base[None], 3000, axis=0)
    family[np.arange(3000), rng.integers(0, 40, 3000)] ^= rng.integers(1, 256, 3000, dtype=np.uint8)
    family = np.unique(family, axis=0)
    prints = spark.createDataFrame([(i, bytes(x)) for i, x in enumerate(family)], "key long, print binary").cache()
    n, chosen = len(family), N.tree_bits(len(family))
    most = max(r["count"] for r in N.deal(prints, n, chosen, 500).groupBy("shard").count().collect())
    assert most <= 700 < max(r["count"] for r in N.deal(prints, n, chosen).groupBy("shard").count().collect())
    groups = N.candidate_groups(prints, split=500).collect()
    assert len(groups) == n and {r.root for r in groups} == {0}


def test_firsts_without_near_copies_are_both_steps(spark):
    rng = random.Random(7)
    rows = corpus(rng)
    rows = [(k, t, i % 3) for i, (k, t) in enumerate(rows + [(k + 1000, t) for k, t in rows[::4]] + [(None, rows[9][1]), (None, None), (4, rows[4][1]), (4, rows[4][1])])]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, node int")
    both = N.firsts_without_near_copies(df).collect()
    apart = N.without_near_copies(written(one_of_each(df), "firsts")).collect()
    assert sorted((r.doc_id, r.text or "") for r in both) == sorted((r.doc_id, r.text or "") for r in apart)
    assert len(both) < len(rows) / 3 and N.firsts_without_near_copies(df.limit(0)).collect() == []


def test_stage_stages_no_texts_and_few_files(spark):
    df = spark.createDataFrame([(k, t, "en", "s", 5) for k, t in corpus(random.Random(8))], "doc_id long, text string, lang string, source string, n_chars long")
    docs = written(df.repartition(12), "docs")
    before = set(staging.staged(spark))
    corpus_pipeline.near_duplicates(spark, docs, "").collect()
    own = [p for p in staging.staged(spark) if p not in before]
    assert own and not any("text" in spark.read.parquet(p).columns for p in own)
    narrow = [len(spark.read.parquet(p).inputFiles()) for p in own if "prints-" in p or "settled-" in p]
    assert len(narrow) >= 3 and max(narrow) <= 2


def test_only_groups_in_pieces_are_staged_anew(spark):
    hashes = [np.arange(100, dtype=np.uint64) + np.uint64(i) for i in range(20)]
    rows = [(1, i, i, x.tobytes()) for i, x in enumerate(hashes)] + [(2, 100, 100, hashes[0].tobytes()), (2, 101, 101, hashes[1].tobytes()), (3, 102, 102, hashes[0].tobytes()), (3, 103, 103, b"")]
    members = spark.createDataFrame(rows, "root long, key long, id long, set binary")
    before = set(staging.staged(spark))
    gone = {r.key for r in N.near_copies(members, piece=8).collect()}
    pieces = [p for p in staging.staged(spark) if p not in before and "/pieces-" in p]
    assert pieces and all({r.root for r in spark.read.parquet(p).collect()} == {1} for p in pieces)
    stay = [i for i in range(20) if i not in gone]
    assert 0 in stay and 101 in gone and not gone & {100, 102, 103}
    assert all(any(len(np.intersect1d(hashes[i], hashes[j])) >= 0.8 * len(np.union1d(hashes[i], hashes[j])) for j in stay) for i in gone if i < 20)
    assert all(len(np.intersect1d(hashes[i], hashes[j])) < 0.8 * len(np.union1d(hashes[i], hashes[j])) for i in stay for j in stay if i < j)
