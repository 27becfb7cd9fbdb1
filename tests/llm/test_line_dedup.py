import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from quern.llm import line_dedup as L

SF = "/root/testdata/sf0.01"


def brute(rows, min_lines=L.MIN_LINES, min_words=L.MIN_WORDS):
    """Rows in corpus order. Every run is looked up among all runs that begin earlier."""
    texts = [[] if t is None else t.split("\n") for _, t in rows]
    worded = [[i for i, x in enumerate(lines) if re.search(L.WORD, x)] for lines in texts]
    seen, out = set(), []
    for (key, _), lines, at in zip(rows, texts, worded):
        own, gone, longest = [lines[i] for i in at], set(), 0
        for i in range(len(own)):
            k, run = 0, ()
            while i + k < len(own) and (run := (*run, own[i + k])) in seen:
                k += 1
            for j in range(1, len(own) - i + 1):  # what begins here is known from the next place on
                seen.add(tuple(own[i : i + j]))
            longest = max(longest, k)
            words = sum(len(re.findall(L.WORD, x)) for x in own[i : i + k])
            if k and (k >= min_lines or words >= min_words or k == len(own)):
                gone.update(at[i : i + k])
        out.append((key, len(lines), len(gone), longest, "\n".join(x for i, x in enumerate(lines) if i not in gone)))
    return out


def result(df, *sizes):
    return sorted(((r.doc_id, r.n_lines, r.n_removed, r.longest_copy, r.kept_text) for r in L.remove_repeated_lines(df, "doc_id", "text", *sizes).collect()), key=repr)


@pytest.mark.parametrize("min_lines,min_words", [(3, 50), (1, 50), (5, 4), (100, 6)])
def test_equals_brute_force(spark, min_lines, min_words):
    rng = random.Random(min_lines)
    line = lambda: rng.choice(["a", "b", "c d", "", "  ", "é"])
    rows = [(i, "\n".join(line() for _ in range(rng.randrange(0, 25)))) for i in range(40)]
    rows += [(60, None), (61, "\r\n\n"), (62, "x\n" * 90), (63, "tail\na\nb"), (64, "word " * 60), (65, "own\n" + "word " * 60), (66, "one"), (67, "one")]
    rows += [(70, "p\nq\nr\ns\nt\nu\nv\nw\nx")] * 3 + [(None, "p\nq\nr\ns\nt\nu\nv\nw\nx")]
    df = spark.createDataFrame([(a, b, 0, 1, 2) for a, b in rows], "doc_id long, text string, place int, __key int, row int")
    assert result(df, min_lines, min_words) == sorted(brute(rows, min_lines, min_words), key=repr)


def test_spans_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a\nb\nc\nd"), (2, "x\na\nb\n\nc\nd\ny")], "doc_id long, text string")
    got = {r.doc_id: [(s.start, s.end) for s in r.removed] for r in L.remove_repeated_lines(df, min_lines=2).collect()}
    assert got == {1: [], 2: [(1, 5)]}
    assert L.remove_repeated_lines(df.limit(0)).collect() == []


def test_rounds_follow_the_longest_run(spark):
    """A copied run of 2**k lines takes k rounds of doubling, and its copies are whole at every length between."""
    for n in (16, 21):
        rows = [(1, "\n".join(f"{n} {i}" for i in range(n))), (2, "before\n" + "\n".join(f"{n} {i}" for i in range(n)) + "\nbehind")]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        levels = L.suffix_ranks(L.sequences(df, "doc_id", "text"))
        assert len(levels) == n.bit_length()
        runs = sorted(r.copied for r in L.copied_runs(levels).collect())
        assert runs == list(range(1, n + 1))


def test_ranks_are_a_suffix_array(spark):
    """On the last level and all below, ranks order the suffixes as their prefixes are ordered."""
    rng = random.Random(4)
    rows = [(i, "\n".join(rng.choice("ab") for _ in range(30))) for i in range(6)]
    lines = L.sequences(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    all_lines = {r.place: (r.a, r.b, r.stop) for r in lines.collect()}
    for j, level in enumerate(L.suffix_ranks(lines)):
        prefix = lambda p, j=j: [all_lines[q][:2] for q in range(p, p + 2**j)]
        ranks = sorted((r["rank"], prefix(r.place)) for r in level.collect())
        for (r, x), (s, y) in zip(ranks, ranks[1:]):
            assert (r == s) == (x == y) and x <= y


def test_many_equal_rows(spark):
    """100,000 equal rows of four lines: the first keeps all, and no task sees them together."""
    same = spark.range(100_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("one\ntwo\n\nthree\nfour").alias("text"))
    df = same.repartition(8).unionAll(spark.createDataFrame([(8, "zero\none\ntwo\nthree")], "doc_id long, text string"))
    got = L.remove_repeated_lines(df).groupBy("doc_id", "n_lines", "n_removed", "kept_text").count().collect()
    assert sorted(map(tuple, got)) == [(7, 5, 0, "one\ntwo\n\nthree\nfour", 1), (7, 5, 4, "", 99_999), (8, 4, 3, "zero", 1)]


def test_a_long_text(spark):
    text = "\n".join(f"line {i % 1000} of a long text" for i in range(4000))
    df = spark.createDataFrame([(1, text), (2, text + "\nlast")], "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.longest_copy, r.kept_text) for r in L.remove_repeated_lines(df).collect()}
    assert got[1][:2] == (3000, 3000) and got[2] == (4000, 4000, "last")


def test_query_and_sql(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    want = sorted((*x, hashlib.sha256(d.encode()).hexdigest()) for *x, d in map(tuple, brute(rows)))
    assert sorted(map(tuple, L.op6_line_dedup(spark, SF).collect())) == [tuple(x) for x in want]
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert sorted(c.sql(L.SQL).fetchall()) == [tuple(x) for x in want]
    assert sum(x[2] for x in want) > 50
