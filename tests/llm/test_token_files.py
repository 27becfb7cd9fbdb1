import io
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quern.llm import token_files as K

SF = "/root/testdata/sf0.001"
PATH = K.tokenizer_path()


def library_ids(texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("bits", [1, 3, 8, 11, 16, 17, 32])
def test_pack_round_trip(bits):
    rng = np.random.default_rng(bits)
    for n in (1, 7, 8, 9, 1000):
        ids = rng.integers(0, 1 << bits, n, dtype=np.uint64).astype(np.uint32)
        raw = K.pack(ids, bits)
        assert len(raw) == (n * bits + 7) // 8 and K.unpack(raw, bits, n).tolist() == ids.tolist()


def test_min_bits():
    assert [K.min_bits(n) for n in (1, 2, 3, 256, 257, 50257, 65536, 65537)] == [1, 1, 2, 8, 9, 16, 16, 17]


def test_random_access():
    class Kept(io.BytesIO):
        def close(self):
            pass

    rng = np.random.default_rng(5)
    ids = rng.integers(0, 50257, 5000, dtype=np.uint32)
    counts = np.array([0, 10, 4000, 990])
    file = Kept()
    writer = K.ShardWriter(file, 16, block=64)
    cut = np.cumsum(counts)
    for i, part in enumerate(np.split(ids, cut[:-1])):
        writer.add(pa.array([i], pa.int64()), counts[i : i + 1], part)
    assert writer.close() == (4, 5000)
    shard = K.ShardReader(file)
    for a, b in [(0, 5000), (63, 65), (64, 128), (4999, 5000), (10, 10), (4990, 9999)]:
        assert shard.ids(a, b).tolist() == ids[a:b].tolist()
    assert shard.documents["start"].to_pylist() == [0, 0, 10, 4010]
    with pytest.raises(ValueError):
        K.ShardReader(io.BytesIO(b"x" * 100))


def test_encoder_equals_library(monkeypatch):
    rng = random.Random(2)
    bits = ["a", "the", "It's", "'s", " ", "  ", "\n", "\t", " ", "　", "᠎", "\x1c", "​", "ñé", "42", "<|endoftext|>", "!?", "...", "\U0001f600", "\r\n", "don't", "x" * 50, "日本", "é", "\x00"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " ", "  "]) for _ in range(rng.randrange(0, 30))) for _ in range(800)] + ["", " ", "  a", "a  ", " \n a"]
    encoder = K.Encoder(PATH)
    got = encoder(texts)
    assert [np.frombuffer(x, encoder.dtype).tolist() for x in got] == library_ids(texts)
    monkeypatch.setattr(K, "CACHE_WORDS", 3)
    assert encoder(texts[:50]) == got[:50] and encoder(texts[20:]) == got[20:]


class Counted:
    """A library or model whose calls are counted by what they are given."""

    def __init__(self, of, calls):
        self.of, self.calls = of, calls

    @property
    def model(self):
        return Counted(self.of.model, self.calls)

    def tokenize(self, piece):
        self.calls.append(1)
        return self.of.tokenize(piece)

    def encode(self, text, **options):
        self.calls.append(1)
        return self.of.encode(text, **options)

    def encode_batch_fast(self, texts, **options):
        self.calls += texts
        return self.of.encode_batch_fast(texts, **options)


def test_new_words_are_encoded_together():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abehinorstuäéñ") for _ in range(rng.randrange(9, 14))) + rng.choice(["", ",", ".", "&&&", ".\n\u00c9t"])
    texts = [" ".join(word() for _ in range(100)) for _ in range(60)]
    encoder, calls = K.Encoder(PATH), []
    encoder.library = Counted(encoder.library, calls)
    if hasattr(encoder, "merges"):
        encoder.merges = Counted(encoder.merges, calls)
    got = encoder(texts)
    assert len(calls) < 300  # of 6,000 words
    assert [np.frombuffer(x, encoder.dtype).tolist() for x in got] == library_ids(texts)


def test_words_seen_once_take_no_room():
    encoder = K.Encoder(PATH)
    for k in range(3):
        encoder([" ".join(f"often{i} once{k}x{i}" for i in range(500))])
    assert sum(w.startswith("often") for w in encoder.after) >= 499 and sum("once" in w for w in encoder.after) < 20


def test_places_where_words_are_cut():
    rng = random.Random(3)
    bits = ["a", "É", "ñ", "ß", "x", "7", "'", "'s", "n't", ".", "!?", "'.", "…", "日", "٣", "ⅷ", "\n", "\n\n", " ", "  ", "\t", "\r", "\x0b", "\x1c", "\x85", "\xa0", "\u180e", "\u200b", "\u2028", "\u3000", "\ufeff", "\x00", "e\u0301", "ª", "×"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 14))) for _ in range(20_000)]
    encoder = K.Encoder(PATH)
    want = library_ids(texts)
    for k in (20_000, 500):  # known words and new ones
        got = [x for i in range(0, len(texts), k) for x in encoder(texts[i : i + k])]
        assert [np.frombuffer(x, encoder.dtype).tolist() for x in got] == want


def expected(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    ids = library_ids([t or "" for _, t in order])
    start, out = 0, []
    for (key, _), x in zip(order, ids):
        x = [*x, 0]
        out.append((key, start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        start += len(x)
    return out


def test_query_equals_library(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(map(tuple, K.op9_token_files(spark, SF).collect())) == expected(rows)


def test_odd_rows_and_small_blocks(spark, tmp_path):
    rows = [(None, "first"), (5, None), (4, ""), (9, "word " * 30000), (7, "mid <|endoftext|> dle")]
    df = spark.createDataFrame([(a, b, 1, 2) for a, b in rows], "doc_id long, text string, start int, path int")
    manifest = K.write_token_files(df, PATH, folder=f"file://{tmp_path}/out", shard_bytes=1000, block=100)
    got = [tuple(r) for r in K.read_token_files(manifest, span=500).collect()]
    assert sorted(got, key=lambda r: r[1]) == expected(rows)
    assert manifest.agg({"n_docs": "sum"}).first()[0] == 5 and os.listdir(tmp_path / "out")


def test_repeated_ids_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c"), (2, "d")], "doc_id long, text string")
    got = sorted((tuple(r) for r in K.read_token_files(K.write_token_files(df, PATH)).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [1, 1, 1, 2] and [r[1] for r in got] == list(np.cumsum([0, *[r[2] for r in got[:-1]]]))
    assert sorted(r[2:] for r in got) == sorted(r[2:] for r in expected([(1, "a b"), (1, "a b"), (1, "c"), (2, "d")]))
    assert K.read_token_files(K.write_token_files(df.limit(0), PATH)).collect() == []


def test_equal_rows_spread(spark):
    from pyspark.sql import functions as F

    df = spark.range(10_000).select(F.lit(3).cast("long").alias("doc_id"), F.lit("the same words").alias("text")).repartition(4)
    manifest = K.write_token_files(df, PATH, shard_bytes=20_000)
    sizes = [r.n_docs for r in manifest.collect()]
    assert sum(sizes) == 10_000 and len(sizes) > 4 and max(sizes) < 5_000
    starts = [r.start for r in K.read_token_files(manifest).orderBy("start").select("start").collect()]
    assert starts == list(range(0, 10_000 * (starts[1] - starts[0]), starts[1] - starts[0]))
