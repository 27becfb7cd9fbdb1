"""How well codecs, and whole datasets, pack some input: sizes, ratios, throughput.

Payloads are packed file by file where they lie. A task measures its own CPU time
and memory, so figures are those of the executors' work, whatever their number; a
tar is made of all files for comparison, by one task, so it is for inputs that fit
one.
"""

from __future__ import annotations

import io
import resource
import statistics
import tarfile
import time

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.batches import sliced
from quern.operators import chunking, codecs
from quern.plans import store

SWEEP = (("store", None), ("zlib", 6), ("zstd", 1), ("zstd", 3), ("zstd", 9))


_SWEPT = "name string, original long, packed long, encode double, decode double, peak long"


def _trial(raw: bytes, codec: str, level: int | None, repeats: int) -> tuple[int, float, float]:
    """(packed size, median CPU seconds to pack, and to unpack)."""
    packing, unpacking = [], []
    for _ in range(repeats):
        times = [time.thread_time()]
        data = codecs.pack_bytes(codec, raw, level)
        times.append(time.thread_time())
        codecs.unpack_bytes(codec, data, len(raw))
        times.append(time.thread_time())
        packing.append(times[1] - times[0])
        unpacking.append(times[2] - times[1])
    return len(data), statistics.median(packing), statistics.median(unpacking)


def _named(codec: str, level: int | None) -> str:
    return codec if level is None else f"{codec}-{level}"


def sweep(files: DataFrame, settings: tuple[tuple[str, int | None], ...] = SWEEP, repeats: int = 1) -> DataFrame:
    """(name, original_size, packed_size, ratio, encode_s, decode_s, peak_bytes) of every codec over all contents, in one pass.

    Seconds are CPU time of all tasks together; the peak is that of the largest Python worker.
    """

    def run(batches):
        sums = {_named(*s): [0, 0, 0.0, 0.0] for s in settings}
        for rows in sliced(b["content"] for b in batches):
            for (raw,) in rows:
                raw = raw or b""
                for codec, level in settings:
                    size, encode, decode = _trial(raw, codec, level, repeats)
                    own = sums[_named(codec, level)]
                    own[:] = own[0] + len(raw), own[1] + size, own[2] + encode, own[3] + decode
        peak = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * 1024
        original, packed, encode, decode = zip(*sums.values(), strict=True)
        yield pa.RecordBatch.from_pydict({"name": list(sums), "original": pa.array(original, pa.int64()), "packed": pa.array(packed, pa.int64()), "encode": pa.array(encode, pa.float64()), "decode": pa.array(decode, pa.float64()), "peak": pa.array([peak] * len(sums), pa.int64())})

    rows = files.select("content").mapInArrow(run, _SWEPT)
    sums = rows.groupBy("name").agg(F.sum("original").alias("original_size"), F.sum("packed").alias("packed_size"), F.sum("encode").alias("encode_s"), F.sum("decode").alias("decode_s"), F.max("peak").alias("peak_bytes"))
    ratio = F.when(F.col("original_size") > 0, F.col("packed_size") / F.col("original_size")).otherwise(F.lit(0.0))
    return sums.select("name", "original_size", "packed_size", ratio.alias("ratio"), "encode_s", "decode_s", "peak_bytes")


def tar_bytes(entries: list[tuple[str, bytes]]) -> bytes:
    """A tar that depends on names and bytes alone."""
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.PAX_FORMAT) as tar:
        for name, data in sorted(entries):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    return out.getvalue()


def tar_of(files: DataFrame) -> DataFrame:
    """(content) of one tar of all files, made by one task."""

    def run(batches):
        entries = [(p, c or b"") for b in batches for p, c in zip(b["path"].to_pylist(), b["content"].to_pylist(), strict=True)]
        yield pa.RecordBatch.from_pydict({"content": pa.array([tar_bytes(entries)], pa.binary())})

    return files.select("path", "content").coalesce(1).mapInArrow(run, "content binary")


def benchmark(files: DataFrame, profile: str = "general", repeats: int = 3) -> list[dict[str, object]]:
    """Rows of scope (raw-payload, tar-container, full-dataset), name, sizes, overhead, ratio, seconds, MiB/s and peak.

    The first two scopes report CPU seconds of the tasks, the last one wall-clock seconds of whole jobs.
    """
    repeats = max(1, repeats)
    raw = sweep(files, repeats=repeats).orderBy("name").collect()
    total = max((r["original_size"] or 0 for r in raw), default=0)
    tar = sweep(tar_of(files), SWEEP[1:], repeats).orderBy("name").collect()
    options = store.Options(profile=profile)
    begin = time.monotonic()
    dataset = store.pack(files, options)
    dataset.file_chunks.count()
    packed_at = time.monotonic()
    store.extract(dataset).agg(F.sum(F.octet_length("content"))).first()
    jobs = {"name": profile, "encode_s": packed_at - begin, "decode_s": time.monotonic() - packed_at, "peak_bytes": None}
    size = chunking.inspect(dataset.files, dataset.file_chunks, dataset.chunks.select("packed_size")).first()
    out = []
    for scope, r, packed, overhead in [*(("raw-payload", r, r["packed_size"], 0) for r in raw), *(("tar-container", r, r["packed_size"], r["original_size"] - total) for r in tar), ("full-dataset", jobs, size["payload_size"] + size["container_overhead"], size["container_overhead"])]:
        speed = {f"{k}_mib_s": total / 2**20 / r[f"{k}_s"] if r[f"{k}_s"] else 0.0 for k in ("encode", "decode")}
        out.append({"scope": scope, "name": r["name"], "original_size": total, "packed_size": packed, "overhead": overhead, "ratio": packed / total if total else 0.0, "encode_s": r["encode_s"], "decode_s": r["decode_s"], **speed, "peak_bytes": r["peak_bytes"]})
    return out


def markdown(rows: list[dict[str, object]]) -> str:
    head = "| scope | name | original | packed | overhead | ratio | encode s | decode s | peak MiB |\n|---|---|---:|---:|---:|---:|---:|---:|---:|"
    peak = lambda r: "" if r["peak_bytes"] is None else f"{r['peak_bytes'] / 2**20:.0f}"
    return "\n".join([head, *(f"| {r['scope']} | {r['name']} | {r['original_size']:,} | {r['packed_size']:,} | {r['overhead']:,} | {r['ratio']:.3f} | {r['encode_s']:.4f} | {r['decode_s']:.4f} | {peak(r)} |" for r in rows)])
