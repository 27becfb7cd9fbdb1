"""Codecs, the choice among them from a bounded sample, and dictionaries.

Compression has no built-in form in Spark, so it runs in Arrow functions; one
call measures all candidates of a row. Penalties, the choice, its tie-break and
the fallback to storing are column expressions over the measured sizes.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import paths
from quern.functions.batches import sliced
from quern.operators.ordered import TotalOrder
from quern.sources.staging import written

SAMPLE_BYTES = 256 << 10
GOALS = ("balanced", "smallest", "prefer-store", "prefer-zstd-low", "avoid-zlib")
DICTIONARY_BYTES, FILE_SAMPLE_BYTES, CATEGORY_SAMPLE_BYTES = 8192, 64 << 10, 1 << 20

#: What files of compressed formats begin with.
COMPRESSED_MAGIC = (
    b"\x89PNG\r\n\x1a\n",
    b"\xff\xd8\xff",
    b"GIF87a",
    b"GIF89a",
    b"RIFF",
    b"ID3",
    b"\x00\x00\x00\x18ftyp",
    b"%PDF-",
    b"PK\x03\x04",
    b"\x1f\x8b",
    b"7z\xbc\xaf'\x1c",
    b"Rar!\x1a\x07",
)

#: Bytes added to a candidate's packed size, by goal and codec.
PENALTIES = {
    "prefer-store": {"store": 0, "zstd": 1024, "zlib": 2048},
    "prefer-zstd-low": {"store": 256, "zstd": 0, "zlib": 2048},
    "avoid-zlib": {"store": 0, "zstd": 512, "zlib": 2048},
}
ZSTD_LEVELS = {"smallest": 9, "balanced": 3}


@dataclass(frozen=True)
class Codec:
    """How a codec packs and unpacks bytes; `dictionary` is for codecs that know one."""

    name: str
    default_level: int | None
    pack: Callable[[bytes, int | None, bytes | None], bytes]
    unpack: Callable[[bytes, int, bytes | None], bytes]


@lru_cache(maxsize=64)
def _zstd_dict(raw: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(raw)


@lru_cache(maxsize=64)
def _zstd_compressor(level: int, dictionary: bytes | None):
    """Contexts are dear to make, so a worker keeps one for each level and dictionary."""
    import zstandard

    return zstandard.ZstdCompressor(level=level, dict_data=_zstd_dict(dictionary) if dictionary else None)


@lru_cache(maxsize=64)
def _zstd_decompressor(dictionary: bytes | None):
    import zstandard

    return zstandard.ZstdDecompressor(dict_data=_zstd_dict(dictionary) if dictionary else None)


def _zstd_pack(data: bytes, level: int | None, dictionary: bytes | None) -> bytes:
    return _zstd_compressor(3 if level is None else level, dictionary or None).compress(data)


def _zstd_unpack(data: bytes, size: int, dictionary: bytes | None) -> bytes:
    return _zstd_decompressor(dictionary or None).decompress(data, max_output_size=size)


def _zlib_unpack(data: bytes, size: int, dictionary: bytes | None) -> bytes:
    d = zlib.decompressobj()
    out = d.decompress(data, size + 1)
    if d.unconsumed_tail or d.unused_data or not d.eof:
        raise ValueError("zlib data do not end where they should")
    return out


CODECS: dict[str, Codec] = {}


def register_codec(codec: Codec) -> None:
    """Adds or replaces a codec by its name."""
    CODECS[codec.name] = codec


register_codec(Codec("store", None, lambda data, level, dictionary: data, lambda data, size, dictionary: data))
register_codec(Codec("zlib", 6, lambda data, level, dictionary: zlib.compress(data, 6 if level is None else level), _zlib_unpack))
register_codec(Codec("zstd", 3, _zstd_pack, _zstd_unpack))


def pack_bytes(codec: str, data: bytes, level: int | None = None, dictionary: bytes | None = None) -> bytes:
    return CODECS[codec].pack(data, level, dictionary)


def unpack_bytes(codec: str, data: bytes, size: int, dictionary: bytes | None = None) -> bytes:
    out = CODECS[codec].unpack(data, size, dictionary)
    if len(out) != size:
        raise ValueError(f"{codec} data unpack to {len(out)} bytes instead of {size}")
    return out


@F.arrow_udf(T.BinaryType())
def packed(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Of (raw, codec, level, dictionary)."""
    for rows in sliced(batches):
        yield pa.array([pack_bytes(c, r, n, d) for r, c, n, d in rows], pa.binary())


@F.arrow_udf(T.StructType([T.StructField("raw", T.BinaryType()), T.StructField("problem", T.StringType())]))
def unpacked(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Of (payload, codec, size, dictionary): the bytes, or what is wrong with them. Equal rows that follow each other are unpacked once."""
    for rows in sliced(batches):
        out: list[dict] = []
        for i, (p, c, n, d) in enumerate(rows):
            if i and rows[i - 1] == rows[i]:
                out.append(out[-1])
                continue
            try:
                out.append({"raw": unpack_bytes(c, p, n, d), "problem": None})
            except Exception as e:  # any damage is a finding, not a failure
                out.append({"raw": None, "problem": f"{type(e).__name__}: {e}"[:200]})
        yield pa.array(out, pa.struct([("raw", pa.binary()), ("problem", pa.string())]))


# --- choice ------------------------------------------------------------------


def is_compressed(content: Column) -> Column:
    out = F.lit(False)
    for magic in COMPRESSED_MAGIC:
        out = out | F.startswith(content, F.lit(magic))
    return out


def check_goal(goal: str) -> str:
    if goal not in GOALS:
        raise ValueError(f"goal must be one of {', '.join(GOALS)}")
    return goal


def candidate_list(goal: str, requested: str | None, level: int | None, compressed: bool) -> list[tuple[str, int | None]]:
    if requested:
        return [(requested, level)]
    if compressed:
        return [("store", None), ("zstd", 1)]
    return [("store", None), ("zlib", 6), ("zstd", ZSTD_LEVELS.get(goal, 1))]


_MEASURED = T.ArrayType(T.StructType([T.StructField("codec", T.StringType()), T.StructField("level", T.IntegerType()), T.StructField("packed_bytes", T.LongType())]))


def candidates(files: DataFrame, goal: str = "balanced", requested: str | None = None, level: int | None = None) -> DataFrame:
    """(path, codec, level, sample_bytes, packed_bytes, score): every candidate packed, and unpacked again, on the head of the content."""
    check_goal(goal)
    if requested is not None and requested not in CODECS:
        raise ValueError(f"unknown codec {requested!r}")

    @F.arrow_udf(_MEASURED)
    def measured(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for rows in sliced(batches):
            out = []
            for raw, flag in rows:
                row = []
                for codec, n in candidate_list(goal, requested, level, flag):
                    data = pack_bytes(codec, raw, n)
                    unpack_bytes(codec, data, len(raw))
                    row.append({"codec": codec, "level": n, "packed_bytes": len(data)})
                out.append(row)
            yield pa.array(out, pa.list_(pa.struct([("codec", pa.string()), ("level", pa.int32()), ("packed_bytes", pa.int64())])))

    sample = F.substring(F.coalesce("content", F.lit(b"")), 1, SAMPLE_BYTES)
    rows = files.select("path", F.octet_length(sample).cast("long").alias("sample_bytes"), F.explode(measured(sample, is_compressed(sample))).alias("c"))
    return scored(rows.select("path", "c.codec", "c.level", "sample_bytes", "c.packed_bytes"), goal)


def scored(measured: DataFrame, goal: str) -> DataFrame:
    table = PENALTIES.get(check_goal(goal), {})
    penalty = F.lit(0).cast("long")
    for codec, extra in table.items():
        penalty = F.when(F.col("codec") == codec, F.lit(extra).cast("long")).otherwise(penalty)
    return measured.withColumn("score", F.col("packed_bytes") + penalty)


def choose(scored_candidates: DataFrame, forced: bool = False) -> DataFrame:
    """(path, codec, level, sample_bytes, packed_bytes, score) of the best: smallest (score, codec).

    Where the best saves less than max(16, a hundredth) bytes the content is
    stored; a forced codec stays.
    """
    one = F.struct("codec", "level", "sample_bytes", "packed_bytes", "score")
    best = scored_candidates.groupBy("path").agg(F.min_by(one, F.struct("score", "codec")).alias("best"), F.max(F.when(F.col("codec") == "store", one)).alias("store"))
    if forced:
        return best.select("path", "best.*")
    n = F.col("best.sample_bytes")
    small = F.col("best.packed_bytes") >= n - F.greatest(F.lit(16).cast("long"), F.floor(n / 100))
    return best.select("path", F.when(small, F.col("store")).otherwise(F.col("best")).alias("c")).select("path", "c.*")


# --- dictionaries ------------------------------------------------------------


def dictionary_samples(files: DataFrame) -> DataFrame:
    """(path, category, sample): heads of text files in path order, up to a total per category.

    A category's running total is taken over lengths alone, in ranges of the total
    order of all files; heads are read again for what is kept.
    """
    head = F.substring("content", 1, FILE_SAMPLE_BYTES)
    own = files.select("path", paths.category(F.col("path")).alias("category"), head.alias("head")).where((F.col("category") != "other") & (F.octet_length("head") > 0) & ~F.contains("head", F.lit(b"\0")))
    return bounded_samples(own)


def bounded_samples(own: DataFrame, limit: int = CATEGORY_SAMPLE_BYTES) -> DataFrame:
    """`own` (path, category, head), the heads clipped to a running total of `limit` bytes per category."""
    lengths = own.select("category", "path", F.octet_length("head").cast("long").alias("n"))
    placed = TotalOrder(lengths, "category", "path").running_sum("n", "sum", inclusive=False).rows()
    starts = placed.groupBy("category").agg(F.min("sum").alias("start"))
    kept = placed.join(starts, "category").select("category", "path", (F.col("sum") - F.col("start")).alias("before")).where(F.col("before") < limit)
    heads = own.join(written(kept, "kept"), ["category", "path"])  # a table of known size, and a small one: no head moves to it
    return heads.select("path", "category", F.substring(F.col("head"), F.lit(1), (F.lit(limit) - F.col("before")).cast("int")).alias("sample"))


def train_dictionaries(samples: DataFrame) -> DataFrame:
    """(category, dictionary_id, size, data) of categories with 8 samples and 2,048 bytes; training that fails gives none."""
    enough = samples.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("sample")).alias("bytes")).where("n >= 8 AND bytes >= 2048").select("category")

    def train(table: pa.Table) -> pa.Table:
        import zstandard

        schema = pa.schema([("category", pa.string()), ("data", pa.binary())])
        parts = [x for _, x in sorted(zip(table["path"].to_pylist(), table["sample"].to_pylist(), strict=True))]
        size = min(DICTIONARY_BYTES, max(256, sum(map(len, parts)) // 8))
        try:
            data = zstandard.train_dictionary(size, parts).as_bytes()
        except zstandard.ZstdError:
            return schema.empty_table()
        return pa.table({"category": [table["category"][0].as_py()], "data": pa.array([data], pa.binary())}, schema=schema)

    trained = samples.join(enough, "category").groupBy("category").applyInArrow(train, "category string, data binary")
    return trained.select("category", F.sha2("data", 256).alias("dictionary_id"), F.octet_length("data").cast("long").alias("size"), "data")
