"""Content-addressed datasets: pack, open, list, inspect, verify, unpack.

A dataset is a folder of Parquet tables:

    files        path, source_size, size, encoded_size, hash, encoded_hash, source_category, mode,
                 transform {id, mode, applied, detected}, preferred_codec, level, reason
    file_chunks  path, ordinal, chunk_id, actual_codec, actual_level, dictionary_id, reason, reused
    chunks       chunk_id, codec, level, dictionary_id, raw_size, packed_size, payload
    candidates   path, codec, level, sample_bytes, packed_bytes, score
    dictionaries dictionary_id, size, data            source_dictionaries  category, dictionary_id
    directories  path                                 excluded             path
    manifest     one row of settings and versions     seal  name, rows, digest of each table

Reports read the small tables; the payload column is read only where bytes are
wanted, and only of the chunks that the chosen paths refer to. Tables are written
to a folder beside the target, which one rename then puts in place.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import paths, table_text
from quern.functions.batches import sliced
from quern.operators import chunking, codecs
from quern.sources.staging import written

PROFILES = ("general", "source", "telemetry")
SEAL = "seal"
TABLES = ("files", "file_chunks", "chunks", "candidates", "dictionaries", "source_dictionaries", "directories", "excluded", "manifest")
FORMAT, SCHEMA, ENGINE = (1, 1), (2, 0), "0.1.0"
REUSED, STORED = "the chunk was stored before", "the chunk is new, and packed as its file prefers"


@dataclass(frozen=True)
class Options:
    profile: str = "general"
    goal: str = "balanced"
    chunk_size: int = chunking.DEFAULT_CHUNK
    codec: str | None = None
    level: int | None = None
    store_permissions: bool = False
    telemetry_mode: str = "exact"
    time_field: str | None = None

    def __post_init__(self) -> None:
        if self.profile not in PROFILES:
            raise ValueError(f"profile must be one of {', '.join(PROFILES)}")
        if self.telemetry_mode not in ("exact", "canonical"):
            raise ValueError("telemetry mode must be exact or canonical")
        if self.codec is not None and self.codec not in codecs.CODECS:
            raise ValueError(f"unknown codec {self.codec!r}")
        codecs.check_goal(self.goal)
        chunking.check_chunk_size(self.chunk_size)


class Dataset:
    """The tables of a dataset, as attributes."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], path: str | None = None):
        self.spark, self.tables, self.path = spark, tables, path

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["tables"][name]
        except KeyError as e:
            raise AttributeError(name) from e

    def replaced(self, **tables: DataFrame) -> Dataset:
        return Dataset(self.spark, self.tables | tables)

    def save(self, path: str, overwrite: bool = False) -> None:
        """Writes all tables beside the target, then moves them there at once."""
        fs, target = _hadoop(self.spark, path)
        if fs.exists(target) and not overwrite:
            raise FileExistsError(path)
        staging = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
        _, temporary = _hadoop(self.spark, staging)
        try:
            for name in TABLES:
                self.tables[name].write.parquet(f"{staging}/{name}")
            seal_of(open_dataset(self.spark, staging)).write.parquet(f"{staging}/{SEAL}")
            if fs.exists(target):
                fs.delete(target, True)
            if not fs.rename(temporary, target):
                raise OSError(f"cannot move {staging} to {path}")
        finally:
            if fs.exists(temporary):
                fs.delete(temporary, True)


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def open_dataset(spark: SparkSession, path: str) -> Dataset:
    return Dataset(spark, {name: spark.read.parquet(f"{path}/{name}") for name in TABLES}, path)


_TRANSFORM = T.StructType([T.StructField("id", T.StringType()), T.StructField("mode", T.StringType()), T.StructField("applied", T.ArrayType(T.StringType())), T.StructField("detected", T.ArrayType(T.StringType()))])
_TRANSFORMED = T.StructType([T.StructField("content", T.BinaryType()), T.StructField("size", T.LongType()), T.StructField("hash", T.StringType()), T.StructField("transform", _TRANSFORM)])
_ARROW_TRANSFORMED = pa.struct([("content", pa.binary()), ("size", pa.int64()), ("hash", pa.string()), ("transform", pa.struct([("id", pa.string()), ("mode", pa.string()), ("applied", pa.list_(pa.string())), ("detected", pa.list_(pa.string()))]))])
TABLE_TRANSFORM = "columnar-csv"


def _transformed(files: DataFrame, options: Options) -> DataFrame:
    """Adds what is stored (content), what comes back (size, hash) and the transform."""
    source = files.withColumn("source_size", F.octet_length("content").cast("long"))
    plain = F.struct(F.lit("none").alias("id"), F.lit("exact").alias("mode"), F.lit(None).cast("array<string>").alias("applied"), F.lit(None).cast("array<string>").alias("detected"))
    as_is = [F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("hash"), plain.alias("transform")]
    if options.profile != "telemetry":
        return source.select("*", *as_is)
    mode, time_field = options.telemetry_mode, options.time_field

    @F.arrow_udf(_TRANSFORMED)
    def transform(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import hashlib

        for rows in sliced(batches):
            out = []
            for (data,) in rows:
                document, detected, applied = table_text.encode_table(data, time_field)
                back = data
                if mode == "canonical":
                    back = table_text.decode_table(document)
                else:
                    document, applied = data, ["kept byte for byte"]
                out.append({"content": document, "size": len(back), "hash": hashlib.sha256(back).hexdigest(), "transform": {"id": TABLE_TRANSFORM, "mode": mode, "applied": applied, "detected": detected}})
            yield pa.array(out, _ARROW_TRANSFORMED)

    is_table = F.lower(paths.suffix(F.col("path"))) == ".csv"
    tables = source.where(is_table).withColumn("t", transform.asNondeterministic()("content")).drop("content").select("*", "t.*").drop("t")
    return source.where(~is_table).select("*", *as_is).unionByName(tables)


def pack(files: DataFrame, options: Options = Options(), directories: DataFrame | None = None, excluded: DataFrame | None = None) -> Dataset:
    """A dataset of files (path, content and, where kept, mode). Nothing is written to its place yet; see Dataset.save."""
    spark = files.sparkSession
    if "mode" not in files.columns:
        files = files.withColumn("mode", F.lit(None).cast("int"))
    as_stored = _transformed(files.withColumn("content", F.coalesce("content", F.lit(b""))).select("path", "content", "mode"), options)
    # sizes and hashes are taken where the content is: only one join below moves content, and only that of chunks' owners
    stored = written(as_stored.withColumns({"encoded_size": F.octet_length("content").cast("long"), "encoded_hash": F.sha2("content", 256)}), "stored", compression="zstd")
    measured = written(codecs.candidates(stored, options.goal, options.codec, options.level), "candidates")
    chosen = codecs.choose(measured, forced=options.codec is not None).select("path", F.col("codec").alias("preferred_codec"), "level", "sample_bytes")
    trained = written(codecs.train_dictionaries(codecs.dictionary_samples(stored)), "dictionaries") if options.profile == "source" else spark.createDataFrame([], "category string, dictionary_id string, size long, data binary")
    reason = F.concat(F.lit(f"least {options.goal} score of the first "), F.col("sample_bytes").cast("string"), F.lit(" bytes"))
    category = paths.category(F.col("path")) if options.profile == "source" else F.lit(None).cast("string")
    mode = F.col("mode").bitwiseAND(F.lit(0o777)) if options.store_permissions else F.lit(None).cast("int")
    records = written(
        stored.join(chosen, "path").select(
            "path", "source_size", "size", "encoded_size", "hash", "encoded_hash",
            category.alias("source_category"), mode.alias("mode"), "transform", "preferred_codec", "level", reason.alias("reason"),
        ), "files",
    )

    refs = written(chunking.split_chunks(stored, options.chunk_size), "refs")
    policy = records.select("path", "preferred_codec", "level", paths.category(F.col("path")).alias("category"))
    first = chunking.owned_bytes(chunking.owners(refs), stored, policy, options.chunk_size)
    if options.profile == "source":
        first = first.join(trained.select("category", "dictionary_id", "data"), "category", "left")
    else:
        first = first.withColumns({"dictionary_id": F.lit(None).cast("string"), "data": F.lit(None).cast("binary")})
    with_dictionary = F.col("preferred_codec") == "zstd"
    payload = codecs.packed.asNondeterministic()(F.col("raw"), F.col("preferred_codec"), F.col("level"), F.when(with_dictionary, F.col("data")))
    chunks = written(
        first.select("chunk_id", F.col("preferred_codec").alias("codec"), "level", F.when(with_dictionary, F.col("dictionary_id")).alias("dictionary_id"), "raw_size", payload.alias("payload"))
        .select("chunk_id", "codec", "level", "dictionary_id", "raw_size", F.octet_length("payload").cast("long").alias("packed_size"), "payload"), "chunks", compression="zstd",
    )
    actual = chunks.select("chunk_id", F.col("codec").alias("actual_codec"), F.col("level").alias("actual_level"), "dictionary_id")
    file_chunks = written(
        chunking.mark_reuse(refs).join(actual, "chunk_id").select("path", "ordinal", "chunk_id", "actual_codec", "actual_level", "dictionary_id", F.when(F.col("reused"), REUSED).otherwise(STORED).alias("reason"), "reused"), "file-chunks"
    )
    used = chunks.select("dictionary_id").where("dictionary_id IS NOT NULL").distinct()
    catalog = trained.join(used, "dictionary_id", "left_semi")
    none = spark.createDataFrame([], "path string")
    return Dataset(spark, {
        "files": records, "file_chunks": file_chunks, "chunks": chunks, "candidates": measured,
        "dictionaries": catalog.select("dictionary_id", "size", "data").distinct(), "source_dictionaries": catalog.select("category", "dictionary_id"),
        "directories": (directories if directories is not None else none).distinct(), "excluded": (excluded if excluded is not None else none).distinct(),
        "manifest": manifest_row(spark, options),
    })


def manifest_row(spark: SparkSession, options: Options) -> DataFrame:
    import zstandard

    schema = "format_major int, format_minor int, schema_major int, schema_minor int, profile string, goal string, chunk_size long, store_permissions boolean, engine_version string, codec_versions map<string,string>"
    versions = {"store": "1", "zlib": zlib.ZLIB_VERSION, "zstd": zstandard.__version__}
    return spark.createDataFrame([(*FORMAT, *SCHEMA, options.profile, options.goal, options.chunk_size, options.store_permissions, ENGINE, versions)], schema)


# --- reading -----------------------------------------------------------------


def restored_chunks(dataset: Dataset, refs: DataFrame) -> DataFrame:
    """`refs` (path, ordinal, chunk_id) with raw and problem; both are null where there is no such chunk.

    Payloads move to their references as they are packed, and are unpacked there:
    Spark forgets after Python how rows are dealt, and would deal out unpacked bytes
    once more. References to one chunk come one after the other, and share its bytes.
    """
    own = dataset.chunks.select("chunk_id", "codec", "dictionary_id", "raw_size", "payload", F.lit(True).alias("known"))
    met = refs.join(own, "chunk_id", "left").join(dataset.dictionaries.select("dictionary_id", "data"), "dictionary_id", "left")
    opened = met.select(*refs.columns, "known", codecs.unpacked.asNondeterministic()("payload", "codec", "raw_size", "data").alias("u"))
    wrong = F.coalesce(F.col("u.problem"), F.when(F.sha2("u.raw", 256) != F.col("chunk_id"), F.lit("the bytes do not have the chunk's hash")))
    return opened.select("chunk_id", "path", "ordinal", F.col("u.raw").alias("raw"), F.when(F.col("known"), wrong).alias("problem"))


def extract(dataset: Dataset, selected: Sequence[str] = ()) -> DataFrame:
    """(path, content, mode) of the chosen files, all without a choice; checked against their hashes."""
    files = dataset.files.where(paths.selected(F.col("path"), list(selected)))
    refs = dataset.file_chunks.where(paths.selected(F.col("path"), list(selected))).select("path", "ordinal", "chunk_id")
    parts = restored_chunks(dataset, refs)
    bad = F.raise_error(F.concat(F.lit("damaged chunk "), F.col("chunk_id"), F.lit(": "), F.coalesce("problem", F.lit("missing"))))
    whole = chunking.ordered_bytes(parts.select("path", "ordinal", F.when(F.col("problem").isNull() & F.col("raw").isNotNull(), F.col("raw")).otherwise(bad.cast("binary")).alias("raw")))
    joined = files.join(whole, "path", "left").withColumn("content", F.coalesce("content", F.lit(b"")))

    @F.arrow_udf(T.BinaryType())
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in sliced(batches):
            yield pa.array([table_text.decode_table(c) for (c,) in rows], pa.binary())

    canonical = (F.col("transform.id") == TABLE_TRANSFORM) & (F.col("transform.mode") == "canonical")
    plain = joined.where(~canonical).select("path", "content", "mode", "hash")
    tables = joined.where(canonical).select("path", decoded.asNondeterministic()("content").alias("content"), "mode", "hash")
    wrong = F.raise_error(F.concat(F.lit("file hash mismatch: "), F.col("path"))).cast("binary")
    return plain.unionByName(tables).select("path", F.when(F.sha2("content", 256) == F.col("hash"), F.col("content")).otherwise(wrong).alias("content"), "mode")


def write_tree(extracted: DataFrame, output: str, directories: DataFrame | None = None, overwrite: bool = False, restore_permissions: bool = False, needed: int = 0) -> DataFrame:
    """Writes files below a folder that the executors share; each appears whole or not at all. (path, size) of what was written.

    Nothing is written if the folder's disk has less than `needed` bytes left.
    """
    import os
    import shutil

    os.makedirs(output, exist_ok=True)
    if (free := shutil.disk_usage(output).free) < needed:
        raise OSError(f"{output} has {free} bytes left, and {needed} are needed")
    if directories is not None:
        for row in directories.toLocalIterator():
            os.makedirs(paths.inside(output, row["path"]), exist_ok=True)

    def put(batches):
        for batch in batches:
            done: dict[str, list] = {"path": [], "size": []}
            for path, content, mode in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), batch["mode"].to_pylist(), strict=True):
                target = paths.inside(output, path)
                if os.path.lexists(target) and (not overwrite or os.path.isdir(target) or os.path.islink(target)):
                    with open(target, "rb") as f:  # a task that runs again finds its own file
                        if f.read() != content:
                            raise FileExistsError(target)
                os.makedirs(os.path.dirname(target), exist_ok=True)
                temporary = f"{target}.{uuid.uuid4().hex}.part"
                with open(temporary, "xb") as f:
                    f.write(content)
                    f.flush()
                    os.fsync(f.fileno())
                if restore_permissions and mode is not None:
                    os.chmod(temporary, mode & 0o777)
                os.replace(temporary, target)
                done["path"].append(path)
                done["size"].append(len(content))
            yield pa.RecordBatch.from_pydict({"path": pa.array(done["path"], pa.string()), "size": pa.array(done["size"], pa.int64())})

    return extracted.select("path", "content", "mode").mapInArrow(put, "path string, size long")


# --- reports -----------------------------------------------------------------


def list_files(dataset: Dataset) -> DataFrame:
    """One row per file: sizes, packed contribution, codecs, transform, dedup."""
    refs = dataset.file_chunks.select("path", "chunk_id")
    rows = chunking.list_rows(dataset.files.select("path", "size", "hash", "preferred_codec"), refs, dataset.chunks.select("chunk_id", "packed_size", "codec"))
    return rows.join(dataset.files.select("path", F.col("transform.id").alias("transformation")), "path")


def inspect_dataset(dataset: Dataset) -> DataFrame:
    """One row of totals and settings, and whether the tables are those that were sealed."""
    totals = chunking.inspect(dataset.files, dataset.file_chunks, dataset.chunks.select("packed_size"))
    return totals.join(dataset.manifest.select("profile", "goal", "chunk_size", "format_major", "format_minor"), F.lit(True)).withColumn("seal", F.lit(seal_status(dataset)))


def seal_of(dataset: Dataset) -> DataFrame:
    """(name, rows, digest) of all tables. Payloads are left out: a chunk's id tells its bytes, and `damage` checks that."""
    parts = [table_digest(t.drop("payload")).select(F.lit(name).alias("name"), "rows", "digest") for name, t in dataset.tables.items() if name in TABLES]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def seal_status(dataset: Dataset) -> str:
    """intact, broken, or none where there is no seal: of tables in memory, or from before there were seals."""
    if dataset.path is None:
        return "none"
    fs, at = _hadoop(dataset.spark, f"{dataset.path}/{SEAL}")
    if not fs.exists(at):
        return "none"
    return "intact" if {tuple(r) for r in dataset.spark.read.parquet(f"{dataset.path}/{SEAL}").collect()} == {tuple(r) for r in seal_of(dataset).collect()} else "broken"


def table_digest(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row (rows, digest) that depends on the multiset of rows, not on their order or layout."""
    names = sorted(columns or df.columns)
    row = F.sha2(F.to_json(F.struct(*[F.hex(c).alias(c) if df.schema[c].dataType == T.BinaryType() else F.col(c) for c in names]), {"ignoreNullFields": "false"}), 256)
    parts = [F.conv(F.substring(row, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(4)]
    total = F.concat_ws("-", *[F.coalesce(F.sum(p), F.lit(0)).cast("string") for p in parts])
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sha2(total, 256).alias("digest"))


def dataset_digest(dataset: Dataset) -> str:
    """Equal for datasets with equal tables: what packing the same input twice must give."""
    import hashlib

    h = hashlib.sha256()
    for name in TABLES:
        rows, digest = table_digest(dataset.tables[name]).first()
        h.update(f"{name} {rows} {digest}\n".encode())
    return h.hexdigest()


def explain(dataset: Dataset) -> DataFrame:
    """(path, text): what was decided for each file, and why."""
    c = dataset.candidates.join(dataset.files.select("path", "preferred_codec"), "path").where("codec <> preferred_codec")
    level = F.coalesce(F.col("level").cast("string"), F.lit("default"))
    line = F.concat(F.lit("  "), "codec", F.lit(" level "), level, F.lit(": "), F.col("packed_bytes").cast("string"), F.lit(" packed bytes from "), F.col("sample_bytes").cast("string"), F.lit(" sampled bytes"))
    rejected = c.groupBy("path").agg(F.array_sort(F.collect_list(line)).alias("rejected"))
    actual = dataset.file_chunks.groupBy("path").agg(F.array_sort(F.collect_set("actual_codec")).alias("codecs"), F.count_if("reused").alias("reused"))

    def block(title: str, lines) -> F.Column:
        return F.when(F.size(lines) > 0, F.concat(F.lit(f"{title}:\n"), F.array_join(lines, "\n")))

    indent = lambda a: F.transform(a, lambda x: F.concat(F.lit("  "), x))
    chosen = F.concat(F.lit("  "), F.col("preferred_codec"), F.coalesce(F.concat(F.lit(" level "), F.col("level").cast("string")), F.lit("")))
    parts = F.array(
        F.col("path"), block("Detected", indent(F.col("transform.detected"))), block("Applied", indent(F.col("transform.applied"))),
        F.concat(F.lit("Preferred codec:\n"), chosen), F.concat(F.lit("Reason:\n  "), F.col("reason"), F.lit(".")), block("Rejected candidates", F.col("rejected")),
        F.concat(F.lit("Stored as:\n  "), F.coalesce(F.array_join("codecs", ", "), F.lit("nothing (empty file)"))),
        F.when(F.col("reused") > 0, F.concat(F.lit("  "), F.col("reused").cast("string"), F.lit(" chunk reference(s) reuse a chunk stored before"))),
    )
    return dataset.files.join(rejected, "path", "left").join(actual, "path", "left").select("path", F.array_join(F.filter(parts, lambda x: x.isNotNull()), "\n\n").alias("text"))
