"""How often contents move between tasks while a dataset is packed and read."""

import random

import pytest

from quern.operators import codecs
from quern.plans import store
from quern.sources import staging


def moved(df) -> int:
    """Exchanges of contents in the physical plan, before adaptive execution changes it; those to the few dictionaries aside, which it broadcasts."""

    def count(node) -> int:
        if node.nodeName() == "AdaptiveSparkPlan":
            node = node.initialPlan()
        output, below = node.output(), node.children()
        named = {output.apply(i).name() for i in range(output.size())}
        own = node.nodeName() == "Exchange" and bool(named & {"content", "head", "raw", "payload", "u"}) and "dictionary_id" not in node.outputPartitioning().toString()
        return own + sum(count(below.apply(i)) for i in range(below.size()))

    return count(df._jdf.queryExecution().executedPlan())


@pytest.fixture
def packed(spark, monkeypatch):
    """A packed dataset of texts with shared chunks, and the plans of its staged tables; nothing is broadcast."""
    plans, plain = {}, store.written
    monkeypatch.setattr(store, "written", lambda df, name, *a, **b: (plans.__setitem__(name, moved(df)), plain(df, name, *a, **b))[1])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    rows = [(f"f/{i}", bytearray(b"".join(b"%d" % (i * k % 7) * 4096 for k in range(1, 4)) + b"end" * (i % 3))) for i in range(40)]
    try:
        yield store.pack(spark.createDataFrame(rows, "path string, content binary"), store.Options(chunk_size=4096)), plans, {p: bytes(c) for p, c in rows}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_contents_move_once_to_be_packed(packed):
    """records take no content along, and owners' chunks are cut out where they are packed."""
    d, plans, contents = packed
    assert plans["files"] == 0
    assert plans["chunks"] == 1
    assert {r.path: r.encoded_size for r in d.files.collect()} == {p: len(c) for p, c in contents.items()}
    own = d.chunks.collect()
    assert {(r.chunk_id, r.raw_size) for r in own} == {(r.chunk_id, r.raw_size) for r in store.chunking.split_chunks(d.spark.createDataFrame([(p, bytearray(c)) for p, c in contents.items()], "path string, content binary"), 4096).collect()}
    assert len(own) == len({r.chunk_id for r in own})


def test_only_packed_payloads_move_to_references(packed):
    """unpacked bytes are not dealt out again by chunk."""
    d, _, contents = packed
    refs = d.file_chunks.select("path", "ordinal", "chunk_id")
    assert moved(store.restored_chunks(d, refs)) == 1
    assert {r.path: bytes(r.content) for r in store.extract(d).collect()} == contents
    one = d.chunks.first().chunk_id
    left = store.restored_chunks(d.replaced(chunks=d.chunks.where(f"chunk_id <> '{one}'")), refs).collect()
    assert len(left) == refs.count()
    assert {r.chunk_id for r in left if r.raw is None} == {one} and all(r.problem is None for r in left)


def test_heads_do_not_move_to_their_places(spark):
    """what is kept for training is a small table of known size."""
    text = random.Random(7)
    files = staging.written(spark.createDataFrame([(f"src/{i}.py", bytearray(text.randbytes(4000).hex().encode())) for i in range(30)], "path string, content binary"), "sources")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "6k")
    try:
        samples = codecs.dictionary_samples(files)
        assert moved(samples) == 0
        assert {r.path: bytes(r.sample) for r in samples.collect()} == {r.path: bytes(r.content) for r in files.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
