import hashlib
import random
import re

import pytest

from quern.llm.decontaminate import op1_decontaminate, with_hits

SF = "/root/testdata/sf0.001"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text):
    return re.findall(WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=8):
    index = {}
    for key, text in items:
        w = words(text)
        if key is not None and w:
            for i in range(max(1, len(w) - window + 1)):
                index.setdefault(tuple(w[i : i + window]), set()).add(str(key))
    out = []
    for key, text in docs:
        w, hit, found = words(text), set(), set()
        for n in range(1, window + 1):
            for i in range(len(w) - n + 1):
                got = index.get(tuple(w[i : i + n]))
                if got:
                    hit.update(range(i, i + n))
                    found |= got
        out.append((key, len(w), len(hit), sorted(found)))
    return out


def order(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize(("block_bytes", "window"), [(1 << 20, 8), (300, 8), (1 << 20, 5)])
def test_equals_brute_force(spark, block_bytes, window):
    rng = random.Random(window + block_bytes)
    text = lambda n: " ".join(rng.choice(["a", "b", "Cé"]) for _ in range(n))
    items = [(i, text(rng.randrange(0, 25))) for i in range(40)] + [(3, text(9)), (None, "a b a"), (50, None), (51, " .,!"), (52, "x-y-z"), (53, "one")]
    docs = [(i, text(rng.randrange(0, 60))) for i in range(60)]
    docs += [(1, None), (1, ""), (None, items[5][1]), (None, items[5][1]), (70, "X Y Z\x00one\x7f"), (71, "q " * 4000 + items[7][1]), (72, items[8][1] + " " + items[9][1])]
    d = spark.createDataFrame([(a, b, "x") for a, b in docs], "doc_id long, text string, n_words string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = with_hits(d, b, window=window, gram=min(4, window - 1), block_bytes=block_bytes).collect()
    assert order([(r.doc_id, r.found.n_words, r.found.n_hit, r.found["items"]) for r in got]) == order(brute(docs, items, window))
    assert all(sum(s.end - s.start for s in r.found.hits) == r.found.n_hit for r in got)
    assert all(r.n_words == "x" for r in got)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [r.found.n_hit for r in with_hits(docs, none).collect()] == [0]
    assert with_hits(docs.limit(0), none).collect() == []


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = [(a, b, c, len(d), hashlib.sha256(",".join(d).encode()).hexdigest(), len(d) >= 2) for a, b, c, d in brute(docs, items)]
    got = [tuple(r)[:6] for r in op1_decontaminate(spark, SF).collect()]
    assert order(got) == order(want)
    assert any(r[3] for r in got)
