import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm import quality_rules as Q

SF = "/root/testdata/sf0.01"


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dups = sum(x in lines[:i] for i, x in enumerate(lines))
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": dups, "n_repeat_words": len(again), "n_lines": len(lines), "n_upper": len(re.findall("[A-Z]", text)), "n_bangs": text.count("!")}


def test_measures():
    rng = random.Random(4)
    texts = ["".join(rng.choice(["a", "bé", "#", " ", "\n", "\r\n", "A!", "\t", "日"]) for _ in range(rng.randrange(0, 80))) for _ in range(300)]
    texts += ["", None, "\n\n \n", "a b c a b c", "x " * 5000, "same\nsame\nsame \nsame"]
    assert Q.measure(pa.array(texts, pa.string())).to_pylist() == [brute(t) for t in texts]


@pytest.mark.parametrize(("k", "n", "p"), [(0, 10, 0.1), (3, 100, 0.1), (9, 100, 0.1), (0, 3000, 0.003), (5, 5000, 0.004), (20, 20, 0.5), (10, 100, 0.1)])
def test_binomial_tail(k, n, p):
    want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) if k < n * p else 1.0
    assert Q.binomial_tail(k, n, p) == pytest.approx(want, rel=1e-9)


def brute_verdicts(docs, labels, max_rejection, delta):
    worst = {}
    for key, q in labels:
        if key is not None and q is not None:
            worst[key] = min(q, worst.get(key, q))
    m = [brute(t) for _, t, _ in docs]
    failed = [x["n_words"] < 50 or 100 * x["n_repeat_words"] > 50 * x["n_words"] for x in m]
    pool, junk = {}, {}
    for (key, _, lang), x, bad in zip(docs, m, failed):
        if not bad and key in worst:
            (pool if worst[key] == 1 else junk).setdefault(lang, []).append(x)
    level, steps = delta / max(1, len(pool)), [(r, c) for r in Q.RULES for c in r.cutoffs]
    rejects = lambda x, upto: [r.name for r, c in steps[:upto] if x[r.numerator] > c * x[r.denominator]]
    used = {}
    for lang, good in pool.items():
        best = 0
        for upto in range(1, len(steps) + 1):
            k, caught = (sum(bool(rejects(x, upto)) for x in part) for part in (good, junk.get(lang, [])))
            if Q.binomial_tail(k, len(good), max_rejection) > level:
                break
            if caught - k > best:
                best, used[lang] = caught - k, upto
    out = []
    for (key, _, lang), x, bad in zip(docs, m, failed):
        by = list(dict.fromkeys(rejects(x, used.get(lang, 0))))
        out.append((key, bad, by, not bad and not by))
    return out


def test_verdicts_equal_brute_force(spark):
    rng = random.Random(8)
    plain = lambda: " ".join(f"{rng.choice('abcdefg')}{rng.randrange(400)}" for _ in range(60))
    docs = [(i, plain(), rng.choice(["en", None])) for i in range(500)]
    docs += [(600 + i, " ".join(f"w{j}###" for j in range(70 + i)), rng.choice(["en", None, "xx"])) for i in range(30)] + [(5, "few", "en"), (None, None, "en"), (7, plain(), "en"), (7, "", None)]
    labels = [(i, 1) for i in range(450)] + [(600 + i, 0) for i in range(10)] + [(3, 0), (None, 1), (8, None), (5, 1)]
    d = spark.createDataFrame([(a, b, c, 1, 2, "s", 3, 4) for a, b, c in docs], "doc_id long, text string, lang string, kept int, m int, stratum string, id int, used int")
    got = [(r.doc_id, r.verdict.base_failed, r.verdict.rejected_by, r.verdict.kept) for r in Q.judge(d, spark.createDataFrame(labels, "doc_id long, quality int"), max_rejection=0.3).collect()]
    want = brute_verdicts(docs, labels, 0.3, 0.05)
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert any(x[2] for x in got) and sum(x[3] for x in got) > 400


def test_no_labels_and_no_documents(spark):
    d = spark.createDataFrame([(1, "a " * 60, "en"), (2, " ".join(map(str, range(60))), "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert sorted((r.doc_id, r.verdict.kept) for r in Q.judge(d, labels).collect()) == [(1, False), (2, True)]
    assert Q.judge(d.limit(0), labels).collect() == []


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    spark_rows = Q.op4_quality_rules(spark, SF).collect()
    want = brute_verdicts(docs, labels, 0.03, 0.05)
    assert sorted((r.doc_id, r.base_failed, r.kept) for r in spark_rows) == sorted((a, b, d) for a, b, _, d in want)
    assert any(b and not a and not d for a, b, d in ((x[1], x[2], x[3]) for x in want))  # the method itself rejects some
    counts = {d[0]: brute(d[1]) for d in docs}
    assert all(r[x] == counts[r.doc_id][x] for r in spark_rows for x in Q.FIELDS[:5])


def test_every_stratum_of_the_larger_table_certifies_steps(spark):
    judged = Q.judge(*(spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels")), columns=["doc_id", "lang"])
    by = {r.lang: r.n for r in judged.where("NOT verdict.base_failed AND NOT verdict.kept").groupBy("lang").agg(F.count("*").alias("n")).collect()}
    assert set(by) == {"de", "en", "es", "fr"} and min(by.values()) > 50


def test_a_long_text():
    text = " ".join(f"word{i % 999}#" for i in range(600_000))
    got = Q.measure(pa.array([text, "short"]))[0].as_py()
    assert got["n_words"] == got["n_symbols"] == got["n_repeat_words"] == 600_000
