"""From format 1.0 to 1.1: metadata is rewritten, payloads stay as they are.

A 1.0 dataset differs in that its chunks carry their dictionary, its decisions
say final_codec, it records no decisions per reference and no schema version,
its source dictionaries are (category, bytes, hash), and its goals have other
names. `goals` and `normalize` are plain table transforms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import chunking, constraints
from quern.plans import store
from quern.plans.store import Dataset

#: What 1.0 called the goals.
GOALS = {
    "balanced": "balanced",
    "smallest": "smallest",
    "fastest": "prefer-store",
    "fastest-decode": "prefer-zstd-low",
    "low-memory": "avoid-zlib",
}
LEGACY = (1, 0)
KEPT = "packed before the migration, and left as it was"


class MigrationError(ValueError):
    """A dataset that is not a sound 1.0 dataset."""


def migrated_goal(goal: Column) -> Column:
    """The goal's name in 1.1; null if 1.0 had no such goal."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in GOALS.items() for x in pair]), goal)


def compatibility(spark: SparkSession, path: str) -> dict[str, object]:
    """What a folder holds, and whether it can be read or migrated: from its manifest, and its seal where it has one."""
    try:
        row = spark.read.parquet(f"{path}/manifest").select("format_major", "format_minor").first()
    except Exception as e:  # not a dataset at all
        return {"format": None, "status": "unreadable", "readable": False, "migratable": False, "detail": str(e).splitlines()[0][:200]}
    version = (row["format_major"], row["format_minor"]) if row else None
    status = {store.FORMAT: "current", LEGACY: "legacy"}.get(version, "unsupported")
    if status == "current":
        try:
            sealed = store.seal_status(store.open_dataset(spark, path))
        except Exception as e:  # a table is missing or is none
            return {"format": f"{version[0]}.{version[1]}", "status": "damaged", "readable": False, "migratable": False, "detail": str(e).splitlines()[0][:200]}
        if sealed == "broken":
            return {"format": f"{version[0]}.{version[1]}", "status": "damaged", "readable": False, "migratable": False, "detail": "the tables are not those that were sealed"}
    return {"format": version and f"{version[0]}.{version[1]}", "status": status, "readable": status == "current", "migratable": status == "legacy", "detail": ""}


def open_legacy(spark: SparkSession, path: str) -> Dataset:
    names = ("files", "file_chunks", "chunks", "candidates", "source_dictionaries", "directories", "excluded", "manifest")
    return Dataset(spark, {n: spark.read.parquet(f"{path}/{n}") for n in names})


def problems(old: Dataset) -> DataFrame:
    """Why a dataset cannot be migrated: (rule, subject, problem)."""
    where = constraints._where
    m = old.manifest.withColumn("what", F.lit("manifest"))
    used = old.chunks.where("dictionary IS NOT NULL").select("codec", "dictionary", F.sha2("dictionary", 256).alias("dictionary_id"), "chunk_id")
    sizes = used.select("dictionary_id", F.octet_length("dictionary").alias("size")).distinct()
    named = old.source_dictionaries.select("category", F.col("bytes").alias("named"), F.col("hash").alias("dictionary_id")).join(sizes, "dictionary_id")
    is_source = old.manifest.where("profile = 'source'").select("profile")
    return constraints._union([
        where(m, (F.col("format_major") != LEGACY[0]) | (F.col("format_minor") != LEGACY[1]), "version", "what", "not format 1.0"),
        where(m, migrated_goal(F.col("goal")).isNull(), "goal", "what", "an unknown goal"),
        where(used, (F.col("codec") != "zstd") | ~F.octet_length("dictionary").between(1, constraints.MAX_DICTIONARY), "dictionary", "chunk_id", "a dictionary that cannot be"),
        where(named, F.col("named") != F.col("size"), "dictionary", "category", "the size is wrong"),
        where(sizes.join(old.source_dictionaries.select(F.col("hash").alias("dictionary_id")), "dictionary_id", "left_anti").join(is_source, F.lit(True)), F.lit(True), "dictionary", "dictionary_id", "no category names it"),
        where(old.file_chunks.join(old.chunks.select("chunk_id"), "chunk_id", "left_anti"), F.lit(True), "reference", "path", "refers to an unknown chunk"),
        where(old.files, F.coalesce("mode", F.lit(0)) < 0, "mode", "path", "a negative mode"),
    ])


def normalize(old: Dataset) -> Dataset:
    """The tables in format 1.1."""
    dictionary_id = F.when(F.col("dictionary").isNotNull(), F.sha2("dictionary", 256))
    chunks = old.chunks.withColumn("dictionary_id", dictionary_id).select("chunk_id", "codec", "level", "dictionary_id", "raw_size", "packed_size", "payload")
    catalog = old.chunks.where("dictionary IS NOT NULL").groupBy(F.sha2("dictionary", 256).alias("dictionary_id")).agg(F.first("dictionary").alias("data"))
    actual = chunks.select("chunk_id", F.col("codec").alias("actual_codec"), F.col("level").alias("actual_level"), "dictionary_id")
    refs = chunking.mark_reuse(old.file_chunks.select("path", "ordinal", "chunk_id")).join(actual, "chunk_id")
    manifest = old.manifest.select(
        F.lit(store.FORMAT[0]).alias("format_major"), F.lit(store.FORMAT[1]).alias("format_minor"), F.lit(store.SCHEMA[0]).alias("schema_major"), F.lit(store.SCHEMA[1]).alias("schema_minor"),
        "profile", migrated_goal(F.col("goal")).alias("goal"), "chunk_size", "store_permissions", F.lit(store.ENGINE).alias("engine_version"), "codec_versions",
    )
    named = old.source_dictionaries.select("category", F.col("hash").alias("dictionary_id")).join(catalog.select("dictionary_id"), "dictionary_id", "left_semi")
    return Dataset(old.spark, {
        "files": old.files.withColumnRenamed("final_codec", "preferred_codec").withColumn("mode", F.col("mode").bitwiseAND(F.lit(0o777))),
        "file_chunks": refs.select("path", "ordinal", "chunk_id", "actual_codec", "actual_level", "dictionary_id", F.when(F.col("reused"), store.REUSED).otherwise(KEPT).alias("reason"), "reused"),
        "chunks": chunks, "candidates": old.candidates,
        "dictionaries": catalog.select("dictionary_id", F.octet_length("data").cast("long").alias("size"), "data"),
        "source_dictionaries": named.select("category", "dictionary_id"), "directories": old.directories, "excluded": old.excluded, "manifest": manifest,
    })


def migrate(spark: SparkSession, source: str, target: str, overwrite: bool = False) -> Dataset:
    """Migrates a saved dataset; the result is verified before it takes its place."""
    old = open_legacy(spark, source)
    found = problems(old).limit(5).collect()
    if found:
        raise MigrationError("; ".join(f"{r['subject']}: {r['problem']}" for r in found))
    new = normalize(old)
    found = constraints.verify(new).limit(5).collect()
    if found:
        raise MigrationError("; ".join(f"{r['subject']}: {r['problem']}" for r in found))
    new.save(target, overwrite)
    return store.open_dataset(spark, target)


def legacy_of(dataset: Dataset) -> Dataset:
    """The same content as a 1.0 dataset: what tests migrate."""
    back = {v: k for k, v in GOALS.items()}
    goal = F.element_at(F.create_map(*[F.lit(x) for pair in back.items() for x in pair]), F.col("goal"))
    d = dataset
    data = d.dictionaries.select("dictionary_id", F.col("data").alias("dictionary"))
    return Dataset(d.spark, d.tables | {
        "files": d.files.withColumnRenamed("preferred_codec", "final_codec"),
        "file_chunks": d.file_chunks.select("path", "ordinal", "chunk_id"),
        "chunks": d.chunks.join(data, "dictionary_id", "left").drop("dictionary_id"),
        "source_dictionaries": d.source_dictionaries.join(d.dictionaries, "dictionary_id").select("category", F.col("size").alias("bytes"), F.col("dictionary_id").alias("hash")),
        "manifest": d.manifest.drop("schema_major", "schema_minor").withColumns({"format_major": F.lit(LEGACY[0]), "format_minor": F.lit(LEGACY[1]), "goal": goal}),
    })


__all__ = ["GOALS", "MigrationError", "compatibility", "legacy_of", "migrate", "migrated_goal", "normalize", "open_legacy", "problems"]
