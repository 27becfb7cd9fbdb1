import re

import numpy as np
import pytest

from quern.llm import mixing as M

SF = "/root/testdata/sf0.01"


def brute_targets(sizes, weights=M.WEIGHTS, most=3.0):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total = sum(sizes.values())
    capped = set()
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        free = sum(w[s] for s in order if s not in capped)
        out = {s: most * sizes[s] if s in capped else rest * w[s] / free for s in order}
        over = {s for s in order if s not in capped and out[s] > most * sizes[s]}
        if not over:
            return out
        capped |= over


def test_flight_keeps_totals_and_settles_all_but_two():
    rng = np.random.default_rng(1)
    for sizes in (rng.integers(0, 500, 400), np.full(300, 7), np.zeros(50, int), np.array([5]), np.zeros(0, int)):
        p = np.full(len(sizes), 0.37)
        out = M.flight(p, sizes, np.random.default_rng(2))
        assert ((out > 0) & (out < 1)).sum() <= 2
        assert out.sum() == pytest.approx(p.sum(), abs=1e-6) and (out * sizes).sum() == pytest.approx((p * sizes).sum(), abs=1e-3)
        assert set(M.land(out, sizes, rng)) <= {0.0, 1.0}


def test_inclusion_probabilities_hold():
    sizes = np.random.default_rng(3).integers(1, 90, 12)
    p = np.full(12, 0.3)
    hits = sum(M.land(M.flight(p, sizes, r), sizes, r) for r in map(np.random.default_rng, range(4000)))
    assert np.allclose(hits / 4000, 0.3, atol=0.04)


def test_targets_equal_brute_force(spark):
    for sizes in ({"a": 100, "b": 1, "c": 50, None: 30}, {"a": 1, "b": 1, "c": 1000}, {"é": 10, "z": 0, "Z": 5}, {None: 3}, {"a": 0}):
        df = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, n long")
        got = {r.source: r.target for r in M.targets(df).collect()}
        assert got == pytest.approx(brute_targets(sizes))


def check(rows, docs, slack):
    sizes, src = {}, {}
    for key, text, source in docs:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        sizes[source] = sizes.get(source, 0) + n
        src.setdefault(key, source)
    want = brute_targets(sizes)
    assert sorted((r.doc_id, r.size) for r in rows) == sorted((k, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for k, t, _ in docs)
    took = dict.fromkeys(sizes, 0)
    for r in rows:
        source = src[r.doc_id]
        assert r.source_size == sizes[source] and r.target == pytest.approx(want[source])
        assert r.taken % max(1, r.size) == 0 and r.taken <= 3 * r.size
        took[source] += r.taken
    for source in sizes:
        assert abs(took[source] - want[source]) <= slack(source)


def test_query_comes_near_its_targets_and_reruns_agree(spark):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = M.op10_mix(spark, SF).collect()
    longest = {}
    for _, t, s in docs:
        longest[s] = max(longest.get(s, 0), len(t.split()))
    check(rows, docs, lambda s: 2 * longest[s])
    assert sorted(rows) == sorted(M.op10_mix(spark, SF).collect())


def test_small_blocks_odd_rows(spark):
    docs = [(i, "w " * (i % 17), ["a", "b", None, "d"][i % 4]) for i in range(400)] + [(1000, None, "a"), (1001, "", "void"), (1002, " x\n", "d")]
    df = spark.createDataFrame([(*d, 5) for d in docs], "doc_id long, text string, source string, size int")
    from pyspark.sql import functions as F

    rows = M.mix(df, block=16, fan_in=2).withColumn("taken", F.col("size") * F.col("copies")).collect()
    check(rows, docs, lambda s: 40)
    same = spark.createDataFrame([(None, "a b", "s")] * 10 + [(1, "c", "s")], "doc_id long, text string, source string")
    assert len(M.mix(same).collect()) == 11
    assert M.mix(same.limit(0)).collect() == []


def test_equal_rows_spread_and_names_may_clash(spark):
    """30,000 equal rows go to many blocks, each is taken about as often as the others, and no column is touched."""
    from pyspark.sql import functions as F

    clash = [F.lit(x).alias(x) for x in ("key", "key2", "copies", "turn", "repeated", "size", "place", "times", "low", "unit")]
    same = spark.range(30_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("big").alias("source"), *clash)
    other = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("d " * 50).alias("text"), F.lit("a").alias("source"), *clash)
    docs = same.repartition(6).unionAll(other)
    units = docs.select(F.col("doc_id").alias("id"), "source", F.lit(3).cast("long").alias("size"), *[k.alias(n) for k, n in zip(M.row_keys("doc_id", F.col("text")), ("key", "key2"))])
    assert M._told_apart(units).where("id = 7 AND source = 'big'").select("place").distinct().count() == 30_000
    rows = M.mix(docs).groupBy("source").agg(F.count("*").alias("n"), F.sum(F.col("size") * F.col("copies")).alias("taken"), F.max("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 100 for r in rows) and sorted(r.n for r in rows) == [100, 30_000]
    mixed = M.mixed(docs)
    assert mixed.columns == docs.columns and mixed.where("key <> 'key' OR copies <> 'copies' OR repeated <> 'repeated'").count() == 0
    total = {r.source: r.taken for r in rows}
    assert mixed.where("source = 'big'").count() * 3 == total["big"] and mixed.where("source = 'a'").count() * 50 == total["a"]
