"""Python works on slices of a batch: no function holds a whole batch as Python objects or as one result."""

import hashlib

import pyarrow as pa
import pytest

from quern.functions import batches
from quern.functions.batches import SLICE_BYTES, sliced
from quern.operators import chunking, codecs
from quern.plans import store

WIDE = 300_000


def whole(rows: int) -> pa.Array:
    return pa.array([bytes([i]) * WIDE for i in range(rows)], pa.binary())


def test_slices_are_bounded_and_whole():
    sizes = [0, 10, SLICE_BYTES + 5, 700_000, 400_000, 1, SLICE_BYTES]
    column = pa.array([None if n == 1 else b"x" * n for n in sizes], pa.binary())
    out = list(sliced([(column, pa.array(range(7))), (column.slice(0, 0), pa.array([], pa.int64())), (column.slice(3, 2), pa.array([7, 8]))]))
    assert [r[1] for part in out for r in part] == [*range(7), 7, 8]
    assert [len(r[0] or b"") for part in out for r in part] == [0, 10, SLICE_BYTES + 5, 700_000, 400_000, 0, SLICE_BYTES, 700_000, 400_000]
    assert all(len(part) == 1 or sum(len(r[0] or b"") for r in part) <= SLICE_BYTES for part in out)


def test_codecs_hand_on_slices():
    """candidates, packing and unpacking."""
    n, raw = 12, whole(12)
    null, store_ = pa.nulls(n, pa.binary()), pa.array(["store"] * n)
    out = list(codecs.packed.func(iter([(raw, store_, pa.nulls(n, pa.int32()), null)])))
    assert pa.concat_arrays(out).to_pylist() == raw.to_pylist() and max(len(a) for a in out) * WIDE <= SLICE_BYTES
    out = list(codecs.unpacked.func(iter([(raw, store_, pa.array([WIDE] * n), null)])))
    assert [x["raw"] for a in out for x in a.to_pylist()] == raw.to_pylist() and max(len(a) for a in out) * WIDE <= SLICE_BYTES


@pytest.fixture
def given_back(monkeypatch):
    calls = []
    monkeypatch.setattr(batches, "_TRIM", calls.append)
    return calls


def test_workers_give_memory_back(given_back):
    for _ in codecs.packed.func(iter([(whole(2), pa.array(["store"] * 2), pa.nulls(2, pa.int32()), pa.nulls(2, pa.binary()))] * 3)):
        pass
    assert len(given_back) == 3


def seen_rows(monkeypatch) -> list[int]:
    """How many rows each Python list has that is made of a slice, in this process' workers."""
    sizes: list[int] = []
    plain = batches.sliced

    def counted(*a, **b):
        for rows in plain(*a, **b):
            sizes.append(sum(len(x) for r in rows for x in r if isinstance(x, bytes)))
            yield rows

    for module in (store, chunking, codecs):
        monkeypatch.setattr(module, "sliced", counted)
    return sizes


def test_tables_and_digests_work_on_slices(spark, monkeypatch):
    """The functions of the plans take their rows from slices."""
    sizes, made = seen_rows(monkeypatch), {}
    real = store.F.arrow_udf

    def kept(kind):
        def add(f):
            made[f.__name__] = f
            return real(kind)(f)

        return add

    monkeypatch.setattr(store.F, "arrow_udf", kept)
    table = b"n,v\n" + b"".join(b"%d,%d.5\n" % (i, i) for i in range(40_000))
    files = spark.createDataFrame([("a.csv", bytearray(table))], "path string, content binary")
    d = store.pack(files, store.Options(profile="telemetry", telemetry_mode="canonical"))
    got = store.extract(d).first()
    assert bytes(got.content) == table
    out = list(made["transform"](iter([pa.array([table] * 6, pa.binary())])))
    assert sum(map(len, out)) == 6 and len(out) > 1
    documents = pa.array([x["content"] for a in out for x in a.to_pylist()], pa.binary())
    assert [x for a in made["decoded"](iter([documents])) for x in a.to_pylist()] == [table] * 6
    assert max(sizes) <= SLICE_BYTES
    out = list(made["measured"](iter([(whole(12), pa.array([False] * 12))])))
    assert sum(map(len, out)) == 12 and len(out) > 1


def test_hashes_of_chunked_files_work_on_slices(spark):
    """the function that streams chunks through a hash."""

    class Refs:
        sparkSession = spark

        def select(self, *_):
            return self

        repartition = sortWithinPartitions = select

        def mapInArrow(self, f, schema):
            return f

    raw = whole(12)
    batch = pa.RecordBatch.from_pydict({"path": [f"f/{i // 2}" for i in range(12)], "raw": raw})
    out = list(chunking.file_digests(Refs())(iter([batch])))
    files = [r for b in out for r in b.to_pylist()]
    parts = raw.to_pylist()
    assert [r["hash"] for r in files] == [hashlib.sha256(parts[2 * i] + parts[2 * i + 1]).hexdigest() for i in range(6)]
    assert len(out) > 2
