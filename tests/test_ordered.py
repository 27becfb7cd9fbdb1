import random

import pytest

from quern.operators import columns
from quern.operators.ordered import TotalOrder


@pytest.mark.parametrize("ranges", [1, 3, 13])
def test_windows_over_one_order(spark, ranges):
    rng = random.Random(ranges)
    rows = [(i * 3, rng.choice([None, rng.randrange(100)])) for i in range(300)]
    df = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "o long, v long")
    t = TotalOrder(df, "o", ranges=ranges).lag("v", "p").running_sum("v", "s").running_sum("v", "b", inclusive=False).row_number("k")
    total, want = 0, []
    for k, (o, v) in enumerate(rows):
        want.append((o, v, rows[k - 1][1] if k else None, total + (v or 0), total, k))
        total += v or 0
    assert sorted(tuple(r) for r in t.rows().select("o", "v", "p", "s", "b", "k").collect()) == want
    assert TotalOrder(df.limit(0), "o").row_number("k").rows().collect() == []


def test_inverses(spark):
    rng = random.Random(5)
    n = [rng.randrange(-50, 50) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(n)), "o long, v long")
    steps = columns.differences(df, "o", "v").rows()
    assert [r.n for r in columns.undelta(n[0], steps.select("ordinal", "d")).orderBy("ordinal").collect()] == n
    assert [r.n for r in columns.undelta_of_delta(n[0], n[1] - n[0], steps.select("ordinal", "dd")).orderBy("ordinal").collect()] == n
    words = spark.createDataFrame([(i, rng.choice(["", "a", "b", "b", None])) for i in range(200)], "o long, v string")
    want = [(r.o, r.v or "") for r in words.orderBy("o").collect()]
    runs = columns.rle_encode(words, "o", "v")
    assert [tuple(r) for r in columns.reinsert_nulls(words, "o", "v", columns.rle_decode(runs)).orderBy("ordinal").collect()] == want
    codes = columns.dictionary(words, "v")
    assert [tuple(r) for r in codes.orderBy("code").collect()] == [(0, "a"), (1, "b")]
    decoded = {r.ordinal: r.value for r in columns.dictionary_decode(columns.dictionary_encode(words, "o", "v"), codes).collect()}
    assert decoded == {o: v for o, v in want if v}


def test_bit_layout(spark):
    flags = spark.createDataFrame([(i, i in (0, 3, 8, 17)) for i in range(18)], "i long, flag boolean")
    packed = columns.pack_bits(flags, "i", "flag")
    assert [r.value for r in packed.orderBy("byte").collect()] == [0x09, 0x01, 0x02]
    assert sorted(tuple(r) for r in columns.unpack_bits(packed, 18).collect()) == sorted(tuple(r) for r in flags.collect())


def test_staged_tables_can_be_discarded(spark):
    import os

    from quern.sources import staging

    before = staging.staged(spark)
    df = staging.written(spark.range(5), "some")
    (path,) = [p for p in staging.staged(spark) if p not in before]
    assert df.count() == 5 and staging.staged(spark) == [*before, path]
    staging.discard(spark, [path])
    assert staging.staged(spark) == before and not os.path.exists(path.removeprefix("file:").replace("///", "/"))
