import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tests.llm.test_decontaminate import brute as brute_hits
from tests.llm.test_decontaminate import words as item_words
from tests.llm.test_mixing import brute_targets
from tests.llm.test_near_copies import sets as shingles
from tests.llm.test_near_copies import similar
from tests.llm.test_quality_rules import brute_verdicts
from tests.llm.test_simhash_dedup import brute as brute_near
from tests.llm.test_token_files import expected as expected_tokens

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for name, stage in P.STAGES:
        docs = P.written(stage(spark, docs, SF), name)
        out.append(docs.collect())
    return out


def test_quality(spark, stages):
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    kept = {k for k, *_, ok in brute_verdicts([(r.doc_id, r.text, r.lang) for r in stages[0]], labels, 0.03, 0.05) if ok}
    assert sorted(stages[1]) == sorted(r for r in stages[0] if r.doc_id in kept)


def test_near_duplicates(stages):
    first = {c for _, _, c in brute_near([(r.doc_id, r.text) for r in stages[1]])}
    kept = {r.doc_id: shingles(r.text) for r in stages[2]}
    assert set(stages[2]) <= {r for r in stages[1] if r.doc_id in first}
    for r in stages[1]:
        if r.doc_id in first and r.doc_id not in kept:
            assert max(similar(shingles(r.text), x) for x in kept.values()) >= 0.8
    left = list(kept.values())
    missed = sum(similar(a, b) >= 0.8 for i, a in enumerate(left) for b in left[:i])
    assert len(stages[2]) < len(stages[1]) and missed <= 2


def test_decontamination(spark, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hits = {k: (n, h, i) for k, n, h, i in brute_hits([(r.doc_id, r.text) for r in stages[2]], items)}
    after = {r.doc_id: r for r in stages[3]}
    for r in stages[2]:
        n, hit, found = hits[r.doc_id]
        if not hit:
            assert after[r.doc_id] == r
        elif len(found) > 1 or hit == n:
            assert r.doc_id not in after
        else:
            own = after[r.doc_id]
            assert len(item_words(own.text)) == n - hit and own.n_chars == len(own.text) and own[2:4] == r[2:4]
    assert len(after) == len(stages[3]) and any(h for _, h, _ in hits.values())


def test_mixture(stages):
    sizes, took = {}, {}
    for r in stages[3]:
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.split())
    for r in stages[4]:
        took[r.source] = took.get(r.source, 0) + len(r.text.split())
    longest = max(len(r.text.split()) for r in stages[3])
    for s, t in brute_targets(sizes).items():
        assert abs(took.get(s, 0) - t) <= 2 * longest
    assert set(stages[4]) <= set(stages[3])


def test_tokens_and_run(spark, stages):
    want = expected_tokens([(r.doc_id, r.text) for r in stages[4]])
    assert sorted(map(tuple, stages[5])) == sorted(want)
    assert sorted(map(tuple, P.run(spark, SF).collect())) == sorted(want)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(80))
    rows = [(1, long, None, "s", 5), (1, long, None, "s", 5), (None, long + " x", "en", None, None), (3, None, "en", "s", 0), (4, "", None, None, 0), (5, "few words", "en", "t", 9)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert len(P.quality(spark, docs, SF).collect()) == 3
    assert len(P.near_duplicates(spark, docs, SF).where(F.col("text").contains("w7")).collect()) == 1
    assert len(P.decontamination(spark, docs, SF).collect()) == 6
    mixed = P.mixture(spark, docs, SF).collect()
    assert all(tuple(r) in rows for r in mixed)
    for _, stage in P.STAGES:
        assert stage(spark, docs.limit(0), SF).collect() == []


def test_columns_with_internal_names_stay(spark):
    """A table that has every name that the operators use inside keeps its columns."""
    names = ["key", "key2", "row", "found", "copies", "repeated", "turn", "id", "m_", "print", "root", "set", "node", "digest", "at", "items", "fp", "used", "stratum", "__key"]
    long = " ".join(f"w{i}" for i in range(80))
    rows = [(i, f"{long} {i}" if i % 2 else f"{i} " * 60, "en", "s", 5) for i in range(12)] + [(1, f"{long} 1", "en", "s", 5)]
    docs = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(n).alias(n) for n in names])
    item = spark.createDataFrame([(1, long)], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    results = {
        "quality": P.quality_rules.judge(docs, labels).drop("m", "verdict"), "first": P.simhash_dedup.one_of_each(docs), "near": P.near_copies.without_near_copies(docs),
        "decontaminated": P.decontaminate.decontaminated(docs, item), "mixed": P.mixing.mixed(docs),
    }
    for name, df in results.items():
        assert df.columns == docs.columns, name
        assert all(r[n] == n for r in df.collect() for n in names), name
    assert results["near"].count() == 7 and results["quality"].count() == 13
