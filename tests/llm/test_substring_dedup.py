import random
import re
from collections import Counter

import pytest

from quern.llm.substring_dedup import op5_substring_dedup, remove_repeated_windows

SF = "/root/testdata/sf0.001"


def brute(rows, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (key, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((key, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def order(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("window", [1, 3, 7])
def test_equals_brute_force(spark, window):
    rng = random.Random(window)
    rows = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randrange(0, 30)))) for i in range(60)]
    rows += [(None, None), (7, ""), (8, " \t\n "), (9, "one"), (9, "one"), (None, "ä ö ß " * 20), (11, "z " * 9000), (12, " x y\x0bz")]
    df = spark.createDataFrame([(a, b, "clash", 1) for a, b in rows], "doc_id long, text string, n_words string, grp int")
    found = remove_repeated_windows(df, window, group_bytes=200).collect()
    assert all(sum(x.end - x.start for x in r.removed) == r.n_removed for r in found)
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in found]
    assert order(got) == order(brute(rows, window))


def test_empty_table(spark):
    assert remove_repeated_windows(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query_on_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = op5_substring_dedup(spark, SF).collect()
    import hashlib

    assert order([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got]) == order([(a, b, c, hashlib.sha256(d.encode()).hexdigest()) for a, b, c, d in brute(rows, 35)])


def test_equal_rows_spread(spark):
    from pyspark.sql import functions as F

    text = " ".join(f"w{i}" for i in range(40))
    same = spark.range(10_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit(text).alias("text")).repartition(6)
    df = same.unionAll(spark.createDataFrame([(2, "own words " * 3), (3, "x " + text)], "doc_id long, text string"))
    got = remove_repeated_windows(df, group_bytes=1 << 16).groupBy("doc_id", "n_words", "n_removed").count().collect()
    assert sorted(map(tuple, got)) == [(1, 40, 40, 10_000), (2, 6, 0, 1), (3, 41, 40, 1)]


def test_a_long_text(spark):
    text = " ".join(f"w{i}" for i in range(400_000))
    df = spark.createDataFrame([(1, text), (2, text[:5000]), (3, "x")], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in remove_repeated_windows(df).select("doc_id", "n_words", "n_removed").collect()}
    n = len(text[:5000].split())
    assert got[1][0] == 400_000 and got[1][1] == got[2][1] >= n - 1 and got[3] == (1, 0)
