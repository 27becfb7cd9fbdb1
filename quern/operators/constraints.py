"""Integrity of a dataset as tables of violations (rule, subject, problem).

A dataset is valid if all are empty. Rules on the metadata tables run without
reading a payload; `verify(full=True)` also unpacks every chunk once and hashes
every file in order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import paths
from quern.operators import chunking, codecs

HASH = "^[0-9a-f]{64}$"
MAX_DICTIONARY, MAX_CANDIDATES, MAX_TRANSFORM, MAX_LIST = 65_536, 32, 64 << 20, 4096


def _where(df: DataFrame, broken: Column, rule: str, subject: str, problem: str) -> DataFrame:
    return df.where(F.coalesce(broken, F.lit(True))).select(F.lit(rule).alias("rule"), F.col(subject).cast("string").alias("subject"), F.lit(problem).alias("problem"))


def _checked(df: DataFrame, subject: str, *checks: tuple[str, Column, str]) -> DataFrame:
    """All checks (rule, broken, problem) in one pass over a table; what cannot be told is broken."""
    found = [F.when(F.coalesce(broken, F.lit(True)), F.struct(F.lit(rule).alias("rule"), F.lit(problem).alias("problem"))) for rule, broken, problem in checks]
    return df.select(F.col(subject).cast("string").alias("subject"), F.explode(F.array_compact(F.array(*found))).alias("x")).select("x.rule", "subject", "x.problem")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def repeated(df: DataFrame, key: str, rule: str, problem: str) -> DataFrame:
    return _where(df.groupBy(key).count(), F.col("count") > 1, rule, key, problem)


def limits(d, max_files: int | None = None, max_chunks: int | None = None, max_extract_size: int | None = None) -> DataFrame:
    """Totals, where a bound is given."""
    one = F.lit(1).cast("long")
    counted = [("files and folders", d.files.select("path").unionByName(d.directories.select("path")), max_files), ("excluded paths", d.excluded, max_files), ("chunks", d.chunks.select("chunk_id"), max_chunks), ("dictionaries", d.dictionaries.select("dictionary_id"), max_chunks), ("references", d.file_chunks.select("path"), max_chunks)]
    parts = [t.agg(F.coalesce(F.sum(one), F.lit(0).cast("long")).alias("n")).select(F.lit("V2").alias("rule"), F.lit(name).alias("subject"), F.lit(most).cast("long").alias("most"), "n") for name, t, most in counted if most is not None]
    if max_extract_size is not None:
        parts.append(d.files.agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("n")).select(F.lit("V21").alias("rule"), F.lit("extracted bytes").alias("subject"), F.lit(max_extract_size).cast("long").alias("most"), "n"))
    if not parts:
        return d.manifest.limit(0).select(F.lit("").alias("rule"), F.lit("").alias("subject"), F.lit("").alias("problem"))
    return _union(parts).where("n > most").select("rule", "subject", F.concat(F.lit("more than "), F.col("most").cast("string")).alias("problem"))


def settings(d) -> DataFrame:
    """V1, V3, V4: one manifest row, with versions and settings that are known."""
    from quern.plans import store

    m = d.manifest.withColumn("what", F.lit("manifest"))
    rows = _where(d.manifest.agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit("manifest")), F.col("n") != 1, "V1", "what", "not one row")
    version = (F.col("format_major") != store.FORMAT[0]) | (F.col("format_minor") != store.FORMAT[1]) | (F.col("schema_major") != store.SCHEMA[0]) | (F.col("schema_minor") != store.SCHEMA[1])
    own = _checked(
        m, "what",
        ("V3", version, "an unsupported version"),
        ("V3", ~F.col("chunk_size").between(chunking.MIN_CHUNK, chunking.MAX_CHUNK), "the chunk size is out of range"),
        ("V4", ~F.col("profile").isin(*store.PROFILES) | ~F.col("goal").isin(*codecs.GOALS), "an unknown profile or goal"),
        ("V4", F.col("engine_version").isNull() | F.col("codec_versions").isNull() | F.col("store_permissions").isNull(), "settings are missing"),
    )
    return rows.unionByName(own)


def dictionaries(d) -> DataFrame:
    """The catalog, and who refers to it."""
    t = d.dictionaries
    size = F.octet_length("data")
    listed = t.select("dictionary_id").distinct().withColumn("listed", F.lit(True))
    used = d.chunks.select("dictionary_id", "codec").where("dictionary_id IS NOT NULL")
    ids = used.select("dictionary_id").distinct().withColumn("used", F.lit(True))
    sources = d.source_dictionaries
    profile = d.manifest.select("profile")
    unlisted = ids.join(sources, "dictionary_id", "left_anti").join(profile.where("profile = 'source'"), F.lit(True))
    return _union([
        _checked(
            t.join(ids, "dictionary_id", "left"), "dictionary_id",
            ("V5", ~F.col("dictionary_id").rlike(HASH) | (F.sha2("data", 256) != F.col("dictionary_id")), "the id is not the data's hash"),
            ("V5", ~size.between(1, MAX_DICTIONARY) | (size != F.col("size")), "the size is out of range or wrong"),
            ("V10", F.col("used").isNull(), "no chunk uses it"),
        ),
        repeated(t, "dictionary_id", "V5", "a repeated dictionary"),
        _checked(
            used.join(listed, "dictionary_id", "left"), "dictionary_id",
            ("V8", F.col("codec") != "zstd", "a dictionary on a codec that knows none"), ("V8", F.col("listed").isNull(), "no such dictionary"),
        ),
        _where(unlisted, F.lit(True), "V10", "dictionary_id", "no category names it"),
        _checked(
            sources.join(listed, "dictionary_id", "left").join(profile, F.lit(True)), "category",
            ("V6", F.col("listed").isNull(), "no such dictionary"), ("V10", F.col("profile") != "source", "source dictionaries under another profile"),
        ),
    ])


def chunks(d) -> DataFrame:
    """Ids, codecs and sizes. Parquet replaces offsets; spans are checked where a table has them."""
    t = d.chunks.drop("payload").join(d.manifest.select("chunk_size"), F.lit(True))
    parts = [
        _checked(
            t, "chunk_id",
            ("V7", ~F.col("chunk_id").rlike(HASH), "not a hash"),
            ("V7", ~F.col("codec").isin(*codecs.CODECS), "an unknown codec"),
            ("V7", ~F.col("raw_size").between(1, F.col("chunk_size")) | (F.col("packed_size") <= 0), "a size is out of range"),
            ("V7", F.col("level").isNotNull() & (F.col("codec") == "store"), "a stored chunk has a level"),
        ),
        repeated(t, "chunk_id", "V7", "a repeated chunk"),
    ]
    if "offset" in t.columns:
        parts.append(chunking.span_violations(t).select(F.lit("V11").alias("rule"), F.col("chunk_id").alias("subject"), "problem"))
    return _union(parts)


def files(d) -> DataFrame:
    """Paths, sizes, hashes, transforms, modes."""
    t = d.files.join(d.manifest.select("store_permissions", "profile"), F.lit(True))
    normal = paths.normalized(F.col("path"))
    exact = F.col("transform.mode") == "exact"
    same = (F.col("size") == F.col("encoded_size")) & (F.col("size") == F.col("source_size")) & (F.col("hash") == F.col("encoded_hash"))
    lists = F.greatest(F.coalesce(F.size("transform.applied"), F.lit(0)), F.coalesce(F.size("transform.detected"), F.lit(0)))
    known = ((F.col("transform.id") == "none") & exact) | ((F.col("transform.id") != "none") & F.col("transform.mode").isin("exact", "canonical") & (F.col("profile") == "telemetry"))
    own = _checked(
        t, "path",
        ("V12", normal.isNull() | (normal != F.col("path")), "not a normal path"),
        ("V13", (F.least("source_size", "size", "encoded_size") < 0) | ~F.col("hash").rlike(HASH) | ~F.col("encoded_hash").rlike(HASH), "a negative size or malformed hash"),
        ("V16", ~known | (lists > MAX_LIST), "an unknown transform"),
        ("V16", (F.col("transform.mode") == "canonical") & (F.greatest("size", "encoded_size", "source_size") > MAX_TRANSFORM), "too large for a transform"),
        ("V17", exact & ~same, "an exact file whose sizes or hashes differ"),
        ("V20", F.col("mode").isNotNull() & (~F.col("store_permissions") | ~F.col("mode").between(0, 0o777)), "a mode that should not be"),
    )
    return own.unionByName(repeated(t, "path", "V12", "a repeated path"))


def decisions(d) -> DataFrame:
    """Candidates, and how each reference was stored."""
    c = d.candidates
    per_file = d.files.select("path", "preferred_codec", "reason").join(c.groupBy("path").count(), "path", "left")
    refs = d.file_chunks
    actual = d.chunks.select("chunk_id", "codec", F.col("level").alias("own_level"), F.col("dictionary_id").alias("own_dictionary"), F.lit(True).alias("known"))
    first = refs.groupBy("chunk_id").agg(F.min(F.struct("path", "ordinal")).alias("first"))
    told = refs.join(first, "chunk_id").join(actual, "chunk_id", "left")
    differs = (F.col("actual_codec") != F.col("codec")) | ~F.col("actual_level").eqNullSafe(F.col("own_level")) | ~F.col("dictionary_id").eqNullSafe(F.col("own_dictionary"))
    is_first = (F.col("path") == F.col("first.path")) & (F.col("ordinal") == F.col("first.ordinal"))
    return _union([
        _checked(
            per_file, "path",
            ("V18", ~F.coalesce("count", F.lit(0)).between(1, MAX_CANDIDATES), "no candidates, or too many"),
            ("V18", F.col("preferred_codec").isNull() | ~F.col("preferred_codec").isin(*codecs.CODECS) | F.col("reason").isNull(), "a decision is malformed"),
        ),
        _where(c, ~F.col("codec").isin(*codecs.CODECS) | ~F.col("sample_bytes").between(0, codecs.SAMPLE_BYTES) | (F.col("packed_bytes") < 0) | (F.col("score") < 0), "V18", "path", "a candidate is malformed"),
        _checked(
            told, "path",
            ("V19", F.col("known").isNotNull() & F.coalesce(differs, F.lit(True)), "a reference differs from its chunk"),
            ("V19", F.col("reused") == is_first, "a reuse flag is wrong"),
            ("V19", F.col("reason").isNull(), "a reason is missing"),
        ),
    ])


def references(d) -> DataFrame:
    """References and chunks cover each other, and sizes add up."""
    refs, ids = d.file_chunks, d.chunks.select("chunk_id", "raw_size")
    owned = refs.select("path", "ordinal", "chunk_id").join(d.files.select("path", F.lit(True).alias("owned")).distinct(), "path", "left")
    met = owned.join(ids.select("chunk_id", F.lit(True).alias("known")).distinct(), "chunk_id", "left")
    sums = refs.join(ids, "chunk_id").groupBy("path").agg(F.sum("raw_size").alias("sum"), F.count(F.lit(1)).alias("n"), F.max("ordinal").alias("last"), F.count_distinct("ordinal").alias("places"))
    sized = d.files.select("path", "encoded_size").join(sums, "path", "left")
    return _union([
        _checked(met, "path", ("V14", F.col("known").isNull(), "refers to an unknown chunk"), ("V14", F.col("owned").isNull(), "references of no file")),
        _checked(
            sized, "path",
            ("V15", F.coalesce("sum", F.lit(0)) != F.col("encoded_size"), "chunk sizes do not add up to the file's"),
            ("V14", F.col("n").isNotNull() & ((F.col("last") + 1 != F.col("n")) | (F.col("places") != F.col("n"))), "ordinals have gaps or repeat"),
        ),
        _where(ids.join(refs, "chunk_id", "left_anti"), F.lit(True), "V22", "chunk_id", "no file refers to it"),
    ])


def namespace(d) -> DataFrame:
    """Folders are normal, no two names differ in case alone, no file lies above another entry."""
    names = d.files.select("path", F.lit("file").alias("kind")).unionByName(d.directories.select("path", F.lit("folder").alias("kind")))
    keyed = names.withColumn("key", paths.collision_key(F.col("path")))
    normal = paths.normalized(F.col("path"))
    above = names.select(F.col("path").alias("below"), F.explode(paths.ancestors(F.col("path"))).alias("path"))
    blocked = above.join(d.files.select("path"), "path", "left_semi").select("path").distinct()
    return _union([
        _where(d.directories, normal.isNull() | (normal != F.col("path")), "V23", "path", "not a normal path"),
        repeated(keyed, "key", "V23", "names collide"),
        _where(blocked, F.lit(True), "V24", "path", "a file lies above another entry"),
    ])


def violations(d, **most: int | None) -> DataFrame:
    """All rules on metadata; bounds on totals where they are given."""
    return _union([limits(d, **most), settings(d), dictionaries(d), chunks(d), files(d), decisions(d), references(d), namespace(d)])


def damage(d) -> DataFrame:
    """What only the bytes show: chunks that do not unpack or hash to their id, files whose chunks do not hash to theirs."""
    from quern.plans import store
    from quern.sources.staging import written

    refs = d.file_chunks.select("path", "ordinal", "chunk_id")
    parts = written(store.restored_chunks(d, refs), "restored", compression="zstd")
    broken = parts.where(F.col("problem").isNotNull() | F.col("raw").isNull()).select("chunk_id", F.coalesce("problem", F.lit("missing")).alias("problem")).distinct()
    whole = chunking.file_digests(parts.where("raw IS NOT NULL").select("path", "ordinal", "raw"))
    nothing = F.sha2(F.lit(b""), 256)
    hashed = d.files.select("path", "encoded_hash", "hash", "transform").join(whole.select("path", F.col("hash").alias("found")), "path", "left")
    bad = _where(hashed, F.coalesce("found", nothing) != F.col("encoded_hash"), "hash", "path", "the stored bytes do not have the file's hash")
    size = d.chunks.where(F.octet_length("payload") != F.col("packed_size")).select(F.lit("size").alias("rule"), F.col("chunk_id").alias("subject"), F.lit("the payload has another size").alias("problem"))
    return _union([broken.select(F.lit("chunk").alias("rule"), F.col("chunk_id").alias("subject"), "problem"), bad, size])


def verify(d, full: bool = True) -> DataFrame:
    """All violations; an empty result is a valid dataset."""
    return violations(d).unionByName(damage(d)) if full else violations(d)
