"""All queries of the engine by name, and the same in SQL for DuckDB.

Inputs are the driver's tables: the texts of documents and conversations and the
html of pages as files, columns of events, orders and lineitem as table columns,
the urls of pages as paths. Every query runs over its whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import numbers, paths, payload
from quern.operators import chunking, codecs, columns, constraints
from quern.operators.ordered import TotalOrder
from quern.plans import measure, migration, store
from quern.sources import delimited, staging
from quern.sources import files as sources
from quern.sources.staging import written

CHUNK = 4096

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark, sf_dir) -> DataFrame:
    return sources.text_files(table(spark, sf_dir, "documents"), "documents", "doc_id", "text")


def pages(spark, sf_dir) -> DataFrame:
    return sources.text_files(table(spark, sf_dir, "pages"), "pages", "page_id", "html")


def refs(spark, sf_dir) -> DataFrame:
    return chunking.split_chunks(documents(spark, sf_dir), CHUNK)


# --- chunks ------------------------------------------------------------------

_FILES = "files AS (SELECT 'documents/' || doc_id AS path, encode(text) AS content, octet_length(encode(text)) AS size FROM documents)"
_REFS = f"""{_FILES},
hexed AS (SELECT path, size, hex(content) AS h FROM files),
refs AS (SELECT path, n AS ordinal, sha256(unhex(substr(h, 1 + n * {2 * CHUNK}, {2 * CHUNK}))) AS chunk_id, least({CHUNK}, size - n * {CHUNK})::BIGINT AS raw_size
  FROM (SELECT *, unnest(range((size + {CHUNK} - 1) // {CHUNK})) AS n FROM hexed))"""
_OWNERS = f"""{_REFS}, chunks AS (SELECT chunk_id, raw_size, path AS first_path, ordinal AS first_ordinal FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY path, ordinal) AS k FROM refs) WHERE k = 1)"""
_USE = f"{_REFS}, used AS (SELECT chunk_id, count(*) AS uses FROM refs GROUP BY chunk_id)"


@query("chunk_refs", f"WITH {_REFS} SELECT path, ordinal, chunk_id, raw_size FROM refs")
def chunk_refs(spark, sf_dir):
    return refs(spark, sf_dir)


@query("chunk_owners", f"WITH {_OWNERS} SELECT chunk_id, raw_size, first_path, first_ordinal FROM chunks")
def chunk_owners(spark, sf_dir):
    return chunking.owners(refs(spark, sf_dir))


@query("chunk_reuse", f"WITH {_REFS} SELECT path, ordinal, chunk_id, raw_size, row_number() OVER (PARTITION BY chunk_id ORDER BY path, ordinal) > 1 AS reused FROM refs")
def chunk_reuse(spark, sf_dir):
    return chunking.mark_reuse(refs(spark, sf_dir)).select("path", "ordinal", "chunk_id", "raw_size", "reused")


@query("chunk_use", f"WITH {_USE} SELECT chunk_id, uses FROM used")
def chunk_use(spark, sf_dir):
    return chunking.chunk_use(refs(spark, sf_dir))


@query("dedup_report", f"WITH {_REFS}, u AS (SELECT chunk_id, count(*) AS uses, max(raw_size) AS raw_size FROM refs GROUP BY chunk_id) SELECT sum(uses)::BIGINT AS chunk_count, count(*) AS unique_chunk_count, sum(uses - 1)::BIGINT AS reused_count, sum(uses * raw_size)::BIGINT AS raw_bytes, sum(raw_size)::BIGINT AS unique_bytes FROM u")
def dedup_report(spark, sf_dir):
    return chunking.dedup_report(refs(spark, sf_dir))


@query("used_chunks_by_source", f"WITH {_USE}, named AS (SELECT 'documents/' || doc_id AS path, source FROM documents) SELECT source, count(*) AS chunk_count, count(DISTINCT chunk_id) AS unique_chunk_count, count_if(uses > 1)::BIGINT AS shared_count FROM refs JOIN used USING (chunk_id) JOIN named USING (path) GROUP BY source")
def used_chunks_by_source(spark, sf_dir):
    named = table(spark, sf_dir, "documents").select(F.concat(F.lit("documents/"), F.col("doc_id").cast("string")).alias("path"), "source")
    r = written(refs(spark, sf_dir), "refs")
    per = r.join(chunking.chunk_use(r), "chunk_id").join(named, "path").groupBy("source", "chunk_id").agg(F.count(F.lit(1)).alias("n"), F.max("uses").alias("uses"))
    return per.groupBy("source").agg(F.sum("n").alias("chunk_count"), F.count(F.lit(1)).alias("unique_chunk_count"), F.coalesce(F.sum(F.when(F.col("uses") > 1, F.col("n"))), F.lit(0)).cast("long").alias("shared_count"))


def _stored(spark, sf_dir):
    """Files, references and chunks as if every chunk were stored as it is."""
    f = documents(spark, sf_dir).select("path", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("hash"), F.lit("store").alias("preferred_codec"))
    r = written(refs(spark, sf_dir), "refs")
    return f, r, chunking.owners(r).select("chunk_id", "first_path", "first_ordinal", "raw_size", F.col("raw_size").alias("packed_size"), F.lit("store").alias("codec"))


@query(
    "list_rows",
    f"""WITH {_USE}, per AS (SELECT path, round(sum(raw_size / uses), 6) AS packed_contribution, bool_or(uses > 1) AS deduplicated, count(*) AS chunk_count FROM refs JOIN used USING (chunk_id) GROUP BY path)
SELECT path, size::BIGINT AS size, coalesce(packed_contribution, 0.0) AS packed_contribution, 'store' AS preferred_codec, CASE WHEN chunk_count > 0 THEN 'store' ELSE '' END AS actual_codecs, coalesce(deduplicated, false) AS deduplicated, coalesce(chunk_count, 0) AS chunk_count, left(sha256(content), 12) AS hash FROM files LEFT JOIN per USING (path)""",
)
def list_rows(spark, sf_dir):
    return chunking.list_rows(*_stored(spark, sf_dir))


@query(
    "inspect_report",
    f"""WITH {_OWNERS}, t AS (SELECT (SELECT count(*) FROM files) AS file_count, (SELECT sum(size) FROM files)::BIGINT AS original_size, (SELECT count(*) FROM refs) AS chunk_count, (SELECT count(*) FROM chunks) AS unique_chunk_count, (SELECT sum(raw_size) FROM chunks)::BIGINT AS payload_size)
SELECT *, 16 + 56 * unique_chunk_count AS container_overhead, round(payload_size / original_size, 9) AS compression_ratio FROM t""",
)
def inspect_report(spark, sf_dir):
    return chunking.inspect(*_stored(spark, sf_dir))


_OFFSETS = f"{_OWNERS}, placed AS (SELECT *, (16 + coalesce(sum(56 + raw_size) OVER (ORDER BY first_path, first_ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS \"offset\" FROM chunks)"


@query("chunk_offsets", f'WITH {_OFFSETS} SELECT chunk_id, raw_size AS packed_size, "offset" FROM placed')
def chunk_offsets(spark, sf_dir):
    return chunking.chunk_offsets(_stored(spark, sf_dir)[2]).select("chunk_id", "packed_size", "offset")


@query("span_violations", f"""WITH {_OFFSETS}, moved AS (SELECT chunk_id, raw_size, "offset" + CASE WHEN first_ordinal = 1 THEN 1 ELSE 0 END AS "offset" FROM placed), seen AS (SELECT *, lag("offset" + 56 + raw_size) OVER (ORDER BY "offset", chunk_id) AS before FROM moved) SELECT chunk_id, 'span does not follow the one before' AS problem FROM seen WHERE "offset" <> coalesce(before, 16)""")
def span_violations(spark, sf_dir):
    """Every second chunk of a file is moved by a byte, to have something to find."""
    placed = chunking.chunk_offsets(_stored(spark, sf_dir)[2])
    return chunking.span_violations(placed.withColumn("offset", F.col("offset") + F.when(F.col("first_ordinal") == 1, 1).otherwise(0)))


@query("file_hash", f"WITH {_FILES} SELECT path, size::BIGINT AS size, sha256(content) AS hash FROM files WHERE size > 0")
def file_hash(spark, sf_dir):
    """Hashes of files from their chunks, streamed in order."""
    return chunking.file_digests(chunking.split_chunks(documents(spark, sf_dir), CHUNK, keep_bytes=True))


@query("reconstruct", f"WITH {_FILES} SELECT path, size::BIGINT AS size, sha256(content) AS hash FROM files WHERE size > 0")
def reconstruct(spark, sf_dir):
    """Contents put together from distinct chunks."""
    r = written(chunking.split_chunks(documents(spark, sf_dir), CHUNK, keep_bytes=True), "refs")
    distinct = r.groupBy("chunk_id").agg(F.first("raw").alias("raw"))
    back = chunking.ordered_bytes(r.select("path", "ordinal", "chunk_id").join(distinct, "chunk_id"))
    return back.select("path", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("hash"))


@query("whole_file_dups", f"WITH {_FILES} SELECT sha256(content) AS hash, count(*) AS copies, min(path) AS first_path, max(size)::BIGINT AS size FROM files GROUP BY 1 HAVING count(*) > 1")
def whole_file_dups(spark, sf_dir):
    f = documents(spark, sf_dir).select(F.sha2("content", 256).alias("hash"), "path", F.octet_length("content").cast("long").alias("size"))
    return f.groupBy("hash").agg(F.count(F.lit(1)).alias("copies"), F.min("path").alias("first_path"), F.max("size").alias("size")).where("copies > 1")


@query("reference_check", f"WITH {_REFS}, firsts AS (SELECT DISTINCT chunk_id FROM refs WHERE ordinal = 0) SELECT path, count(*) AS missing FROM refs WHERE chunk_id NOT IN (SELECT chunk_id FROM firsts) GROUP BY path")
def reference_check(spark, sf_dir):
    """References to chunks outside of an index of all first chunks: an anti-join."""
    r = written(refs(spark, sf_dir), "refs")
    return r.join(r.where("ordinal = 0").select("chunk_id").distinct(), "chunk_id", "left_anti").groupBy("path").agg(F.count(F.lit(1)).alias("missing"))


# --- columns -----------------------------------------------------------------



def events(spark, sf_dir) -> DataFrame:
    """events as texts, with a boolean, a 0/1 and a sparse column; ordered by event_id."""
    e = table(spark, sf_dir, "events")
    value = F.col("value")
    return e.select(
        "event_id", F.unix_micros(F.col("ts").cast("timestamp")).cast("string").alias("ts"), F.col("user_id").cast("string").alias("user_id"), "event_type",
        F.when(value > 50, "true").otherwise("false").alias("flag"), (F.col("user_id") % 2).cast("string").alias("odd"), F.when(F.col("event_id") % 3 > 0, F.col("event_type")).otherwise("").alias("sparse"),
    )


_E = "e AS (SELECT event_id, epoch_us(ts)::VARCHAR AS ts, user_id::VARCHAR AS user_id, event_type, CASE WHEN value > 50 THEN 'true' ELSE 'false' END AS flag, (user_id % 2)::VARCHAR AS odd, CASE WHEN event_id % 3 > 0 THEN event_type ELSE '' END AS sparse FROM events)"


def _infer_sql(cte: str, source: str, ordinal: str, names: list[str], time_field: str | None = None) -> str:
    """The whole of inference for some columns of one table of texts."""
    parts = []
    for i, name in enumerate(names):
        v = f'"{name}"'
        parts.append(f"""SELECT {i} AS position, '{name}' AS name, count(*) AS "rows", count({v}) AS present, count(DISTINCT {v}) AS "distinct",
 coalesce(bool_and(lower({v}) IN ('true', 'false', '0', '1')), false) AS b, coalesce(bool_and(regexp_matches({v}, '{numbers.INTEGER}')), false) AS i, coalesce(bool_and(regexp_matches({v}, '{numbers.FLOAT}')), false) AS f,
 coalesce(bool_and(n >= p OR p IS NULL), true) AS up FROM (SELECT *, lag(n) OVER (ORDER BY o) AS p FROM (SELECT {ordinal} AS o, nullif({v}, '') AS {v}, CASE WHEN regexp_matches({v}, '{numbers.INTEGER}') THEN try_cast({v} AS DECIMAL(38,0)) END AS n FROM {source} WHERE {v} <> ''))""")
    time_type = f"WHEN name = '{time_field}' THEN CASE WHEN i THEN 'timestamp' ELSE 'timestamp-text' END" if time_field else ""
    return f"""WITH {cte}, p AS ({" UNION ALL ".join(parts)}), total AS (SELECT count(*) AS all_rows FROM {source}), t AS (SELECT *, CASE {time_type} WHEN b THEN 'boolean' WHEN i THEN 'integer' WHEN f THEN 'float' ELSE 'string' END AS type FROM p)
SELECT position, name, type, CASE type WHEN 'timestamp' THEN 'delta' WHEN 'timestamp-text' THEN 'dictionary' WHEN 'boolean' THEN 'bit-pack' WHEN 'float' THEN 'ieee-754' WHEN 'integer' THEN CASE WHEN up THEN 'delta' ELSE 'plain' END
 ELSE CASE WHEN present > 0 AND "distinct" <= greatest(16, present // 4) THEN 'dictionary' WHEN present > 2 AND "distinct" < present * 3 // 4 THEN 'rle' ELSE 'plain' END END AS encoding, all_rows AS "rows", present, "distinct" FROM t, total"""


_EVENT_COLUMNS = ["ts", "user_id", "event_type", "flag", "odd", "sparse"]


@query("infer_types_events", _infer_sql(_E, "e", "event_id", _EVENT_COLUMNS, "ts"))
def infer_types_events(spark, sf_dir):
    return columns.infer(events(spark, sf_dir), "event_id", _EVENT_COLUMNS, "ts")


_ORDER_COLUMNS = ["key", "customer", "status", "priority", "day"]


@query("infer_types_orders", _infer_sql("o AS (SELECT o_orderkey, o_orderkey::VARCHAR AS key, o_custkey::VARCHAR AS customer, o_orderstatus AS status, o_orderpriority AS priority, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders)", "o", "o_orderkey", _ORDER_COLUMNS))
def infer_types_orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("key"), F.col("o_custkey").cast("string").alias("customer"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return columns.infer(o, "o_orderkey", _ORDER_COLUMNS)


_LINE_COLUMNS = ["part", "supplier", "line", "flag", "status"]


@query("infer_types_lineitem", _infer_sql("l AS (SELECT row_number() OVER (ORDER BY ALL) AS o, l_partkey::VARCHAR AS part, l_suppkey::VARCHAR AS supplier, l_linenumber::VARCHAR AS line, l_returnflag AS flag, l_linestatus AS status FROM lineitem)", "l", "o", _LINE_COLUMNS).replace("ORDER BY ALL", "ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"))
def infer_types_lineitem(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    numbered = TotalOrder(l, *order).row_number("o").rows()
    texts = numbered.select("o", *[F.col(c).cast("string").alias(n) for c, n in zip(("l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus"), _LINE_COLUMNS, strict=True)])
    return columns.infer(texts, "o", _LINE_COLUMNS)


_PACK = "SELECT (i // 8)::BIGINT AS byte, sum(CASE WHEN f THEN 1 << (i % 8)::INT ELSE 0 END)::INT AS value FROM x GROUP BY 1"


@query("null_bitmap", f"WITH {_E}, x AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS i, sparse = '' AS f FROM e) {_PACK}")
def null_bitmap(spark, sf_dir):
    return columns.null_bitmap(events(spark, sf_dir), "event_id", "sparse")


@query("bit_pack", f"WITH {_E}, x AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS i, flag = 'true' AS f FROM e) {_PACK}")
def bit_pack(spark, sf_dir):
    return columns.bit_pack(events(spark, sf_dir), "event_id", "flag")


@query("bit_pack_orders", f"WITH x AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i, o_orderstatus = 'O' AS f FROM orders) {_PACK}")
def bit_pack_orders(spark, sf_dir):
    return columns.pack_bits(TotalOrder(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey").row_number("i").rows(), "i", F.col("o_orderstatus") == "O")


@query("bit_unpack", f"WITH {_E} SELECT row_number() OVER (ORDER BY event_id) - 1 AS i, flag = 'true' AS flag FROM e")
def bit_unpack(spark, sf_dir):
    e = events(spark, sf_dir)
    return columns.unpack_bits(columns.bit_pack(e, "event_id", "flag"), e.count())


_STEPS = "n AS (SELECT event_id AS ordinal, epoch_us(ts) AS n FROM events), d AS (SELECT *, n - lag(n) OVER (ORDER BY ordinal) AS d FROM n), dd AS (SELECT *, d - lag(d) OVER (ORDER BY ordinal) AS dd FROM d)"


def _ts(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir).select("event_id", "ts")


@query("delta", f"WITH {_STEPS} SELECT ordinal, n, d FROM dd")
def delta(spark, sf_dir):
    return columns.differences(_ts(spark, sf_dir), "event_id", "ts").rows().select("ordinal", "n", "d")


@query("delta_of_delta", f"WITH {_STEPS} SELECT ordinal, n, d, dd FROM dd")
def delta_of_delta(spark, sf_dir):
    return columns.differences(_ts(spark, sf_dir), "event_id", "ts").rows().select("ordinal", "n", "d", "dd")


@query("undelta", "SELECT event_id AS ordinal, epoch_us(ts) AS n FROM events")
def undelta(spark, sf_dir):
    steps = columns.differences(_ts(spark, sf_dir), "event_id", "ts").rows()
    first = steps.where("d IS NULL").agg(F.max("n")).first()[0]
    return columns.undelta(first, steps.select("ordinal", "d"))


@query("undelta_of_delta", "SELECT event_id AS ordinal, epoch_us(ts) AS n FROM events")
def undelta_of_delta(spark, sf_dir):
    steps = columns.differences(_ts(spark, sf_dir), "event_id", "ts").rows()
    first, first_delta = steps.agg(F.max(F.when(F.col("d").isNull(), F.col("n"))), F.max(F.when(F.col("d").isNotNull() & F.col("dd").isNull(), F.col("d")))).first()
    return columns.undelta_of_delta(first, first_delta, steps.select("ordinal", "dd"))


@query(
    "encoding_choice",
    """WITH v AS (SELECT 'event_id' AS name, event_id AS o, event_id AS n FROM events UNION ALL SELECT 'ts', event_id, epoch_us(ts) FROM events UNION ALL SELECT 'o_orderkey', o_orderkey, o_orderkey FROM orders),
d AS (SELECT *, n - lag(n) OVER (PARTITION BY name ORDER BY o) AS d FROM v), dd AS (SELECT *, d - lag(d) OVER (PARTITION BY name ORDER BY o) AS dd FROM d)
SELECT name, CASE WHEN count(dd) >= 1 AND count(DISTINCT dd) <= greatest(4, count(dd) // 8) THEN 'delta-of-delta' ELSE 'delta' END AS encoding FROM dd GROUP BY name""",
)
def encoding_choice(spark, sf_dir):
    e, o = events(spark, sf_dir), table(spark, sf_dir, "orders")
    cases = {"event_id": (e.select("event_id", F.col("event_id").alias("n")), "event_id"), "ts": (e.select("event_id", F.col("ts").alias("n")), "event_id"), "o_orderkey": (o.select("o_orderkey", F.col("o_orderkey").alias("n")), "o_orderkey")}
    return spark.createDataFrame([(name, columns.delta_encoding(columns.differences(df, by, "n").df)) for name, (df, by) in cases.items()], "name string, encoding string")


@query("monotonic", "WITH v AS (SELECT 'ts' AS name, event_id AS o, epoch_us(ts) AS n FROM events UNION ALL SELECT 'user_id', event_id, user_id FROM events UNION ALL SELECT 'o_custkey', o_orderkey, o_custkey FROM orders), p AS (SELECT *, lag(n) OVER (PARTITION BY name ORDER BY o) AS p FROM v) SELECT name, bool_and(p IS NULL OR n >= p) AS rising FROM p GROUP BY name")
def monotonic(spark, sf_dir):
    e, o = events(spark, sf_dir), table(spark, sf_dir, "orders")
    cases = {"ts": (e, "event_id"), "user_id": (e, "event_id"), "o_custkey": (o, "o_orderkey")}
    return spark.createDataFrame([(name, columns.monotonic(df, by, name)) for name, (df, by) in cases.items()], "name string, rising boolean")


_DICT = "dict AS (SELECT row_number() OVER (ORDER BY value) - 1 AS code, value FROM (SELECT DISTINCT o_orderpriority AS value FROM orders WHERE o_orderpriority <> ''))"


@query("dictionary", f"WITH {_DICT} SELECT code, value FROM dict")
def dictionary(spark, sf_dir):
    return columns.dictionary(table(spark, sf_dir, "orders"), "o_orderpriority")


@query("dictionary_encode", f"WITH {_DICT} SELECT o_orderkey AS ordinal, code FROM orders JOIN dict ON value = o_orderpriority")
def dictionary_encode(spark, sf_dir):
    return columns.dictionary_encode(table(spark, sf_dir, "orders"), "o_orderkey", "o_orderpriority")


@query("dictionary_decode", "SELECT o_orderkey AS ordinal, o_orderpriority AS value FROM orders WHERE o_orderpriority <> ''")
def dictionary_decode(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    codes = written(columns.dictionary(o, "o_orderpriority"), "dictionary")
    return columns.dictionary_decode(columns.dictionary_encode(o, "o_orderkey", "o_orderpriority", codes), codes)


_RUNS = f"{_E}, s AS (SELECT event_id, sparse, lag(sparse) OVER (ORDER BY event_id) AS before FROM e WHERE sparse <> ''), r AS (SELECT *, sum(CASE WHEN before IS NULL OR before <> sparse THEN 1 ELSE 0 END) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) - 1 AS run FROM s)"


@query("rle_encode", f"WITH {_RUNS} SELECT run::BIGINT AS run, min(event_id) AS start, min(sparse) AS value, count(*) AS length FROM r GROUP BY run")
def rle_encode(spark, sf_dir):
    return columns.rle_encode(events(spark, sf_dir), "event_id", "sparse")


@query("rle_decode", f"WITH {_E} SELECT row_number() OVER (ORDER BY event_id) - 1 AS i, sparse AS value FROM e WHERE sparse <> ''")
def rle_decode(spark, sf_dir):
    return columns.rle_decode(columns.rle_encode(events(spark, sf_dir), "event_id", "sparse"))


@query("rle_by_user", "WITH s AS (SELECT user_id, ts, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events), r AS (SELECT *, sum(CASE WHEN b IS NULL OR b <> event_type THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - 1 AS run FROM s) SELECT user_id, run::BIGINT AS run, min(event_type) AS value, count(*) AS length FROM r GROUP BY user_id, run")
def rle_by_user(spark, sf_dir):
    return columns.rle_encode_by(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type")


@query("column_round_trip", f"WITH {_E} SELECT event_id AS ordinal, sparse AS value FROM e")
def column_round_trip(spark, sf_dir):
    """A sparse column through runs and back, with its nulls."""
    e = events(spark, sf_dir).select("event_id", "sparse")
    return columns.reinsert_nulls(e, "event_id", "sparse", columns.rle_decode(columns.rle_encode(e, "event_id", "sparse")))


@query("ieee754")
def ieee754(spark, sf_dir):
    """Bytes, value read back and text of all event values."""
    raw = table(spark, sf_dir, "events").select("event_id", payload.ieee754_bytes("value").alias("raw"))
    return raw.select("event_id", F.lower(F.hex("raw")).alias("bytes"), payload.float_text(payload.ieee754_values("raw")).alias("text"))


@query("ieee754_round_trip", "SELECT event_id, value FROM events")
def ieee754_round_trip(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", payload.ieee754_values(payload.ieee754_bytes("value")).alias("value"))


# --- paths -------------------------------------------------------------------

_PATHS = "p AS (SELECT page_id, regexp_replace(substr(url, instr(url, '://') + 3), '[?#].*$', '') AS path FROM pages)"


def url_paths(spark, sf_dir) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.substr(url, F.instr(url, "://") + F.lit(3)), "[?#].*$", "").alias("path"))


@query("path_normalize", f"WITH {_PATHS}, x AS (SELECT page_id, path, list_filter(string_split(replace(path, '\\', '/'), '/'), lambda s: s NOT IN ('', '.')) AS parts FROM p) SELECT page_id, array_to_string(parts, '/') AS path FROM x WHERE NOT regexp_matches(path, '^(/|[A-Za-z]:)') AND NOT list_contains(parts, '..') AND len(parts) > 0")
def path_normalize(spark, sf_dir):
    return url_paths(spark, sf_dir).select("page_id", paths.normalized(F.col("path")).alias("path")).where("path IS NOT NULL")


_SUFFIX = "lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1))"
_CATEGORY = "CASE " + " ".join(f"WHEN {_SUFFIX} IN ({', '.join(repr(e) for e in ends)}) THEN '{name}'" for name, ends in paths.CATEGORIES.items()) + " ELSE 'other' END"


@query("path_category", f"WITH {_PATHS} SELECT page_id, {_CATEGORY} AS category FROM p")
def path_category(spark, sf_dir):
    return url_paths(spark, sf_dir).select("page_id", paths.category(F.col("path")).alias("category"))


@query("path_excluded", f"WITH {_PATHS} SELECT page_id, path FROM p WHERE list_has_any(string_split(path, '/'), ['*.html', 'fr', 'm.*']) OR regexp_matches(path, '\\.html$') OR regexp_matches(path, '^m\\.')")
def path_excluded(spark, sf_dir):
    return url_paths(spark, sf_dir).where(paths.matches(F.col("path"), ["*.html", "fr", "m.*"]))


def _named(df: DataFrame) -> DataFrame:
    """Two documents of a pair get names that differ in case, or in the writing of a sharp s, alone."""
    street = F.when(F.col("doc_id") % 2 == 0, "Straße").otherwise("STRASSE")
    return df.select(F.concat(street, F.lit("/"), F.upper("lang"), F.lit("/É"), F.floor(F.col("doc_id") / 2).cast("string")).alias("path"))


@query("path_collision", "WITH p AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'Straße' ELSE 'STRASSE' END || '/' || upper(lang) || '/É' || (doc_id // 2) AS path FROM documents), k AS (SELECT replace(lower(path), 'ß', 'ss') AS key FROM p) SELECT key, count(*) AS entries FROM k GROUP BY key HAVING count(*) > 1")
def path_collision(spark, sf_dir):
    keys = _named(table(spark, sf_dir, "documents")).select(paths.collision_key(F.col("path")).alias("key"))
    return keys.groupBy("key").agg(F.count(F.lit(1)).alias("entries")).where("entries > 1")


@query("path_ancestors", f"WITH {_PATHS}, s AS (SELECT page_id, string_split(path, '/') AS parts FROM p), a AS (SELECT parts, unnest(range(1, len(parts))) AS n FROM s) SELECT array_to_string(parts[1:n], '/') AS ancestor, count(*) AS entries FROM a GROUP BY 1")
def path_ancestors(spark, sf_dir):
    above = url_paths(spark, sf_dir).select(F.explode(paths.ancestors(F.col("path"))).alias("ancestor"))
    return above.groupBy("ancestor").agg(F.count(F.lit(1)).alias("entries"))


@query(
    "path_conflicts",
    """WITH f AS (SELECT DISTINCT CASE WHEN doc_id % 11 = 3 THEN lang || '/' || (doc_id // 10) ELSE lang || '/' || (doc_id // 10) || '/' || doc_id END AS path FROM documents),
s AS (SELECT string_split(path, '/') AS parts FROM f), a AS (SELECT parts, unnest(range(1, len(parts))) AS n FROM s) SELECT DISTINCT array_to_string(parts[1:n], '/') AS path FROM a WHERE array_to_string(parts[1:n], '/') IN (SELECT path FROM f)""",
)
def path_conflicts(spark, sf_dir):
    """Paths that are also ancestors of others: an equi-join with exploded ancestors instead of a prefix join."""
    folder = F.concat("lang", F.lit("/"), F.floor(F.col("doc_id") / 10).cast("string"))
    path = F.when(F.col("doc_id") % 11 == 3, folder).otherwise(F.concat(folder, F.lit("/"), F.col("doc_id").cast("string")))
    f = table(spark, sf_dir, "documents").select(path.alias("path")).distinct()
    return f.select(F.explode(paths.ancestors(F.col("path"))).alias("path")).distinct().join(f, "path", "left_semi")


_ROOTS = ("de", "en/3", "fr/1/", "es/2/12")


@query("select_paths", "WITH p AS (SELECT doc_id, lang || '/' || (doc_id % 10) || '/' || doc_id AS path FROM documents) SELECT doc_id, path FROM p WHERE " + " OR ".join(f"path = '{r.rstrip('/')}' OR starts_with(path, '{r.rstrip('/')}/')" for r in _ROOTS))
def select_paths(spark, sf_dir):
    path = F.concat_ws("/", "lang", (F.col("doc_id") % 10).cast("string"), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("path")).where(paths.selected(F.col("path"), list(_ROOTS)))


# --- codecs and datasets -----------------------------------------------------


@query("magic_sniff", "SELECT 'pages/' || page_id AS path, starts_with(hex(encode(html)), '89504E470D0A1A0A') OR starts_with(hex(encode(html)), '25504446') OR starts_with(hex(encode(html)), '47494638') OR starts_with(hex(encode(html)), '52494646') OR starts_with(hex(encode(html)), '494433') AS compressed FROM pages")
def magic_sniff(spark, sf_dir):
    return pages(spark, sf_dir).select("path", codecs.is_compressed(F.col("content")).alias("compressed"))


def source_files(spark, sf_dir) -> DataFrame:
    """Documents as source files of four categories; every ninth has a zero byte in front."""
    d = table(spark, sf_dir, "documents")
    ending = F.element_at(F.array(*map(F.lit, (".py", ".c", ".MD", ".json"))), (F.col("doc_id") % 4 + 1).cast("int"))
    zero = F.when(F.col("doc_id") % 9 == 0, F.lit(b"\0")).otherwise(F.lit(b""))
    return d.select(F.concat(F.lit("src/"), F.col("doc_id").cast("string"), ending).alias("path"), F.concat(zero, F.col("text").cast("binary")).alias("content"))


_SOURCE = """files AS (SELECT 'src/' || doc_id || (['.py', '.c', '.MD', '.json'])[doc_id % 4 + 1] AS path, (['python', 'c-cpp', 'documentation', 'json-yaml'])[doc_id % 4 + 1] AS category, doc_id % 9 = 0 AS zero, CASE WHEN doc_id % 9 = 0 THEN '\\x00'::BLOB ELSE ''::BLOB END || encode(text) AS content FROM documents)"""
_SAMPLES = f"{_SOURCE}, head AS (SELECT path, category, unhex(left(hex(content), {2 * codecs.FILE_SAMPLE_BYTES})) AS head FROM files WHERE NOT zero), s AS (SELECT *, octet_length(head) AS n, coalesce(sum(octet_length(head)) OVER (PARTITION BY category ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM head WHERE octet_length(head) > 0)"


@query("dictionary_samples", f"WITH {_SAMPLES} SELECT path, category, least(n, {codecs.CATEGORY_SAMPLE_BYTES} - before)::BIGINT AS sample_bytes FROM s WHERE before < {codecs.CATEGORY_SAMPLE_BYTES}")
def dictionary_samples(spark, sf_dir):
    return codecs.dictionary_samples(source_files(spark, sf_dir)).select("path", "category", F.octet_length("sample").cast("long").alias("sample_bytes"))


@query("dictionary_train", f"WITH {_SAMPLES}, k AS (SELECT category, count(*) AS n, sum(least(n, {codecs.CATEGORY_SAMPLE_BYTES} - before)) AS bytes FROM s WHERE before < {codecs.CATEGORY_SAMPLE_BYTES} GROUP BY category) SELECT category, true AS trained FROM k WHERE n >= 8 AND bytes >= 2048")
def dictionary_train(spark, sf_dir):
    """Which categories get a dictionary; its bytes are the trainer's."""
    trained = codecs.train_dictionaries(codecs.dictionary_samples(source_files(spark, sf_dir)))
    return trained.select("category", F.col("size").between(1, codecs.DICTIONARY_BYTES).alias("trained"))


@query("codec_candidates")
def codec_candidates(spark, sf_dir):
    return codecs.candidates(documents(spark, sf_dir))


@query("codec_choice")
def codec_choice(spark, sf_dir):
    return codecs.choose(codecs.candidates(documents(spark, sf_dir), "avoid-zlib"))


_SIZES = "c AS (SELECT 'orders/' || o_orderkey AS path, unnest(['store', 'zlib', 'zstd']) AS codec, 20000 + o_orderkey % 5000 AS sample_bytes, unnest([20000 + o_orderkey % 5000, 9000 + o_custkey * 7 % 14000, 9000 + o_custkey * 11 % 14000]) AS packed_bytes FROM orders)"


@query(
    "codec_choice_from_sizes",
    f"""WITH {_SIZES}, s AS (SELECT *, packed_bytes + CASE codec WHEN 'zstd' THEN 512 WHEN 'zlib' THEN 2048 ELSE 0 END AS score FROM c), b AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score, codec) AS k FROM s)
SELECT path, CASE WHEN packed_bytes >= sample_bytes - greatest(16, sample_bytes // 100) THEN 'store' ELSE codec END AS codec FROM b WHERE k = 1""",
)
def codec_choice_from_sizes(spark, sf_dir):
    """Choice and fallback over made-up sizes, which SQL can follow."""
    o = table(spark, sf_dir, "orders")
    n = F.lit(20000) + F.col("o_orderkey") % 5000
    sizes = F.explode(F.array(*[F.struct(F.lit(c).alias("codec"), p.cast("long").alias("packed_bytes")) for c, p in (("store", n), ("zlib", F.lit(9000) + F.col("o_custkey") * 7 % 14000), ("zstd", F.lit(9000) + F.col("o_custkey") * 11 % 14000))]))
    rows = o.select(F.concat(F.lit("orders/"), F.col("o_orderkey").cast("string")).alias("path"), n.cast("long").alias("sample_bytes"), sizes.alias("c"))
    measured = rows.select("path", "c.codec", F.lit(None).cast("int").alias("level"), "sample_bytes", "c.packed_bytes")
    return codecs.choose(codecs.scored(measured, "avoid-zlib")).select("path", "codec")


@query("codec_sweep")
def codec_sweep(spark, sf_dir):
    return measure.sweep(documents(spark, sf_dir))


def _packed(spark, sf_dir, **options) -> store.Dataset:
    return store.pack(documents(spark, sf_dir), store.Options(chunk_size=CHUNK, **options))


@query("pack_stored", f"WITH {_OWNERS} SELECT chunk_id, 'store' AS codec, raw_size, raw_size AS packed_size FROM chunks")
def pack_stored(spark, sf_dir):
    """Packing with a forced codec that SQL can follow."""
    return _packed(spark, sf_dir, codec="store").chunks.select("chunk_id", "codec", "raw_size", "packed_size")


@query("file_records", f"WITH {_FILES} SELECT path, size::BIGINT AS source_size, size::BIGINT AS size, size::BIGINT AS encoded_size, sha256(content) AS hash, sha256(content) AS encoded_hash FROM files")
def file_records(spark, sf_dir):
    return _packed(spark, sf_dir, codec="store").files.select("path", "source_size", "size", "encoded_size", "hash", "encoded_hash")


@query("pack_extract", f"WITH {_FILES} SELECT path, size::BIGINT AS size, sha256(content) AS hash FROM files")
def pack_extract(spark, sf_dir):
    """All files through packing and extraction."""
    return store.extract(_packed(spark, sf_dir)).select("path", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("hash"))


@query("extract_selected", f"WITH {_FILES} SELECT path, sha256(content) AS hash FROM files WHERE path IN ('documents/7', 'documents/21')")
def extract_selected(spark, sf_dir):
    return store.extract(_packed(spark, sf_dir, codec="zstd"), ["documents/7", "documents/21"]).select("path", F.sha2("content", 256).alias("hash"))


@query("dataset_list", f"WITH {_FILES}, d AS (SELECT path, size::BIGINT AS size, left(sha256(content), 12) AS hash FROM files) SELECT path, size, hash, 'none' AS transformation FROM d")
def dataset_list(spark, sf_dir):
    return store.list_files(_packed(spark, sf_dir)).select("path", "size", "hash", "transformation")


@query(
    "dataset_inspect",
    f"""WITH {_OWNERS}, t AS (SELECT (SELECT count(*) FROM files) AS file_count, (SELECT sum(size) FROM files)::BIGINT AS original_size, (SELECT count(*) FROM refs) AS chunk_count, (SELECT count(*) FROM chunks) AS unique_chunk_count, (SELECT sum(raw_size) FROM chunks)::BIGINT AS payload_size)
SELECT *, 16 + 56 * unique_chunk_count AS container_overhead, round(payload_size / original_size, 9) AS compression_ratio, 'general' AS profile, 'balanced' AS goal, {CHUNK}::BIGINT AS chunk_size, 1 AS format_major, 1 AS format_minor, 'none' AS seal FROM t""",
)
def dataset_inspect(spark, sf_dir):
    return store.inspect_dataset(_packed(spark, sf_dir, codec="store"))


@query(
    "dataset_explain",
    f"""WITH {_REFS}, m AS (SELECT path, row_number() OVER (PARTITION BY chunk_id ORDER BY path, ordinal) > 1 AS reused FROM refs), n AS (SELECT path, count_if(reused)::BIGINT AS reused, count(*) AS chunks FROM m GROUP BY path)
SELECT path, path || E'\\n\\nPreferred codec:\\n  store\\n\\nReason:\\n  least balanced score of the first ' || least(size, {codecs.SAMPLE_BYTES}) || E' bytes.\\n\\nStored as:\\n  ' || CASE WHEN chunks > 0 THEN 'store' ELSE 'nothing (empty file)' END
 || CASE WHEN reused > 0 THEN E'\\n\\n  ' || reused || ' chunk reference(s) reuse a chunk stored before' ELSE '' END AS text FROM files LEFT JOIN n USING (path)""",
)
def dataset_explain(spark, sf_dir):
    return store.explain(_packed(spark, sf_dir, codec="store"))


@query("violations", "SELECT '' AS rule, '' AS subject, '' AS problem WHERE false")
def violations(spark, sf_dir):
    """A sound dataset has none."""
    return constraints.violations(_packed(spark, sf_dir))


@query("verify_full", "SELECT '' AS rule, '' AS subject, '' AS problem WHERE false")
def verify_full(spark, sf_dir):
    return constraints.verify(_packed(spark, sf_dir))


@query("violations_found", f"WITH {_REFS} SELECT 'V14' AS rule, path AS subject, 'refers to an unknown chunk' AS problem FROM refs WHERE left(chunk_id, 1) = '0'")
def violations_found(spark, sf_dir):
    """The unknown references of a dataset that lost a sixteenth of its chunks."""
    d = _packed(spark, sf_dir, codec="store")
    lost = d.replaced(chunks=d.chunks.where("left(chunk_id, 1) <> '0'"))
    return constraints.references(lost).where("problem = 'refers to an unknown chunk'")


# One dataset for each table of rules, spoilt here and there: every rule has something to find.


def _spoilt(where: str, then: F.Column, column: str):
    return F.when(F.expr(where), then).otherwise(F.col(column))


def _number() -> str:
    return "CAST(substring_index(path, '/', -1) AS long)"


_TEXTS = "texts AS (SELECT doc_id, sha256(text) AS id, octet_length(encode(text)) AS size FROM documents)"
_ROWS = "SELECT '{}' AS rule, {} AS subject, '{}' AS problem FROM {}"


def _found(*rows: tuple[str, str, str, str]) -> str:
    return " UNION ALL ".join(_ROWS.format(*r) for r in rows)


@query(
    "violations_dictionaries",
    f"""WITH {_OWNERS}, {_TEXTS}, catalog AS (SELECT id, size + CASE WHEN doc_id % 100 = 0 THEN 1 ELSE 0 END AS told, size FROM texts WHERE doc_id % 50 = 0), sources AS (SELECT 'c' || doc_id AS category, id FROM texts WHERE doc_id % 25 = 0), used AS (SELECT chunk_id AS id FROM chunks WHERE left(chunk_id, 2) = '0a')
"""
    + _found(
        ("V5", "id", "the size is out of range or wrong", "catalog WHERE told <> size OR size NOT BETWEEN 1 AND 65536"), ("V5", "id", "a repeated dictionary", "(SELECT id FROM catalog GROUP BY id HAVING count(*) > 1)"),
        ("V10", "id", "no chunk uses it", "catalog WHERE id NOT IN (SELECT id FROM used)"), ("V8", "id", "a dictionary on a codec that knows none", "used"), ("V8", "id", "no such dictionary", "used WHERE id NOT IN (SELECT id FROM catalog)"),
        ("V6", "category", "no such dictionary", "sources WHERE id NOT IN (SELECT id FROM catalog)"), ("V10", "category", "source dictionaries under another profile", "sources"),
    ),
)
def violations_dictionaries(spark, sf_dir):
    """Texts as dictionaries, some of a wrong size, some missing, none used; chunks that name one which is none."""
    d = _packed(spark, sf_dir, codec="store")
    texts = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("dictionary_id"), F.octet_length("text").cast("long").alias("size"), F.col("text").cast("binary").alias("data"))
    catalog = texts.where("doc_id % 50 = 0").withColumn("size", F.expr("size + IF(doc_id % 100 = 0, 1L, 0L)")).drop("doc_id")
    sources = texts.where("doc_id % 25 = 0").select(F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("category"), "dictionary_id")
    chunks = d.chunks.withColumn("dictionary_id", F.when(F.left("chunk_id", F.lit(2)) == "0a", F.col("chunk_id")))
    return constraints.dictionaries(d.replaced(dictionaries=catalog, source_dictionaries=sources, chunks=chunks))


@query(
    "violations_chunks",
    f"WITH {_OWNERS}, c AS (SELECT *, left(chunk_id, 1) AS k FROM chunks) "
    + _found(
        ("V7", "chunk_id", "a size is out of range", "c WHERE k = '1'"), ("V7", "chunk_id", "an unknown codec", "c WHERE k = '2'"), ("V7", "upper(chunk_id)", "not a hash", "c WHERE k = '3' AND regexp_matches(chunk_id, '[a-f]')"),
        ("V7", "chunk_id", "a stored chunk has a level", "c WHERE k = '4'"), ("V7", "chunk_id", "a repeated chunk", "c WHERE k = '5'"),
    ),
)
def violations_chunks(spark, sf_dir):
    """V7: chunks of no size, of no codec, under no hash, with a level that cannot be, and twice."""
    d, k = _packed(spark, sf_dir, codec="store"), "left(chunk_id, 1) = '{}'"
    own = d.chunks.select(
        _spoilt(k.format(3), F.upper("chunk_id"), "chunk_id").alias("chunk_id"), _spoilt(k.format(2), F.lit("odd"), "codec").alias("codec"), _spoilt(k.format(4), F.lit(3), "level").alias("level"),
        "dictionary_id", _spoilt(k.format(1), F.lit(0).cast("long"), "raw_size").alias("raw_size"), "packed_size", "payload",
    )
    return constraints.chunks(d.replaced(chunks=own.unionByName(own.where(k.format(5)))))


_AT = "f AS (SELECT 'documents/' || doc_id AS path, doc_id % 97 AS k FROM documents)"


@query(
    "violations_files",
    f"WITH {_AT} "
    + _found(
        ("V12", "'../' || path", "not a normal path", "f WHERE k = 1"), ("V12", "path", "a repeated path", "f WHERE k = 2"), ("V13", "path", "a negative size or malformed hash", "f WHERE k = 3"), ("V16", "path", "an unknown transform", "f WHERE k = 4"),
        ("V17", "path", "an exact file whose sizes or hashes differ", "f WHERE k = 5"), ("V20", "path", "a mode that should not be", "f WHERE k = 6"),
        ("V16", "path", "too large for a transform", "f WHERE k = 7"), ("V16", "path", "an unknown transform", "f WHERE k = 7"),
    ),
)
def violations_files(spark, sf_dir):
    """File records with one thing wrong each."""
    d, k = _packed(spark, sf_dir, codec="store"), _number() + " % 97 = {}"
    f = d.files
    own = f.withColumns({
        "hash": _spoilt(k.format(3), F.lit("xyz"), "hash"), "encoded_hash": _spoilt(k.format(3), F.lit("xyz"), "encoded_hash"), "size": _spoilt(k.format(5), F.col("size") + 1, "size"), "mode": _spoilt(k.format(6), F.lit(0o644), "mode"),
        "encoded_size": _spoilt(k.format(7), F.lit(1 << 40), "encoded_size"),
        "transform": F.when(F.expr(k.format(4)), F.col("transform").withField("id", F.lit("odd"))).when(F.expr(k.format(7)), F.col("transform").withField("mode", F.lit("canonical"))).otherwise(F.col("transform")),
    })
    own = own.withColumn("path", _spoilt(k.format(1), F.concat(F.lit("../"), F.col("path")), "path"))
    return constraints.files(d.replaced(files=own.unionByName(own.where(k.format(2)))))


@query(
    "violations_decisions",
    f"WITH {_REFS}, {_AT}, r AS (SELECT f.path, k FROM refs JOIN f USING (path)) "
    + _found(
        ("V18", "path", "no candidates, or too many", "f WHERE k = 1"), ("V18", "path", "a candidate is malformed", "f WHERE k = 2"), ("V18", "path", "a decision is malformed", "f WHERE k = 3"),
        ("V19", "path", "a reference differs from its chunk", "r WHERE k = 4"), ("V19", "path", "a reuse flag is wrong", "r WHERE k = 5"), ("V19", "path", "a reason is missing", "r WHERE k = 6"),
    ),
)
def violations_decisions(spark, sf_dir):
    """Candidates and references that tell something else than what was done."""
    d, k = _packed(spark, sf_dir, codec="store"), _number() + " % 97 = {}"
    c = d.candidates.where("NOT " + k.format(1)).withColumn("codec", _spoilt(k.format(2), F.lit("odd"), "codec"))
    f = d.files.withColumn("preferred_codec", _spoilt(k.format(3), F.lit(None), "preferred_codec"))
    r = d.file_chunks.withColumns({"actual_codec": _spoilt(k.format(4), F.lit("zlib"), "actual_codec"), "reused": _spoilt(k.format(5), ~F.col("reused"), "reused"), "reason": _spoilt(k.format(6), F.lit(None), "reason")})
    return constraints.decisions(d.replaced(candidates=c, files=f, file_chunks=r))


@query(
    "violations_references",
    f"""WITH {_REFS}, {_AT}, left_over AS (SELECT * FROM refs WHERE left(chunk_id, 2) <> '0a'), sums AS (SELECT path, sum(raw_size) AS sum, count(*) AS n, max(ordinal) + 1 AS stop FROM left_over GROUP BY path),
sized AS (SELECT files.path, size + CASE WHEN k = 8 THEN 1 ELSE 0 END AS told, sums.* EXCLUDE (path) FROM files JOIN f USING (path) LEFT JOIN sums ON sums.path = files.path WHERE k <> 7), r AS (SELECT refs.*, k FROM refs JOIN f USING (path)) """
    + _found(
        ("V14", "path", "refers to an unknown chunk", "refs WHERE left(chunk_id, 2) = '0a'"), ("V14", "path", "references of no file", "r WHERE k = 7"), ("V15", "path", "chunk sizes do not add up to the file''s", "sized WHERE coalesce(sum, 0) <> told"),
        ("V14", "path", "ordinals have gaps or repeat", "sized WHERE n <> stop"), ("V22", "sha256('no text')", "no file refers to it", "(SELECT 1)"),
    ),
)
def violations_references(spark, sf_dir):
    """Lost chunks, lost files, a wrong size, a chunk too many."""
    d, k = _packed(spark, sf_dir, codec="store"), _number() + " % 97 = {}"
    more = spark.range(1).select(F.sha2(F.lit("no text"), 256).alias("chunk_id"), F.lit(7).cast("long").alias("raw_size"))
    kept = d.chunks.where("left(chunk_id, 2) <> '0a'").unionByName(more, allowMissingColumns=True)
    f = d.files.where("NOT " + k.format(7)).withColumn("encoded_size", _spoilt(k.format(8), F.col("encoded_size") + 1, "encoded_size"))
    return constraints.references(d.replaced(chunks=kept, files=f))


@query("violations_namespace", _found(("V23", "'../up'", "not a normal path", "(SELECT 1)"), ("V23", "'documents/7'", "names collide", "(SELECT 1)"), ("V24", "'documents/21'", "a file lies above another entry", "(SELECT 1)")))
def violations_namespace(spark, sf_dir):
    """Folders that climb, that differ from a file in case alone, and that lie below a file."""
    folders = spark.createDataFrame([("../up",), ("DOCUMENTS/7",), ("documents/21/below",)], "path string")
    return constraints.namespace(_packed(spark, sf_dir, codec="store").replaced(directories=folders))


@query(
    "violations_settings",
    f"WITH {_FILES}, t AS (SELECT count(*) AS n, sum(size) AS bytes FROM files) "
    + _found(
        ("V1", "'manifest'", "not one row", "(SELECT 1)"), ("V3", "'manifest'", "an unsupported version", "(SELECT 1)"), ("V3", "'manifest'", "the chunk size is out of range", "(SELECT 1)"), ("V4", "'manifest'", "an unknown profile or goal", "(SELECT 1)"),
        ("V4", "'manifest'", "settings are missing", "(SELECT 1)"), ("V2", "'files and folders'", "more than 3", "t WHERE n > 3"), ("V21", "'extracted bytes'", "more than 10", "t WHERE bytes > 10"),
    ),
)
def violations_settings(spark, sf_dir):
    """No manifest, one with everything wrong, and totals beyond their bounds."""
    d = _packed(spark, sf_dir, codec="store")
    wrong = d.manifest.withColumns({"format_minor": F.lit(7), "chunk_size": F.lit(1).cast("long"), "goal": F.lit("fastest"), "engine_version": F.lit(None).cast("string")})
    empty = constraints.settings(d.replaced(manifest=d.manifest.limit(0)))
    return empty.unionByName(constraints.settings(d.replaced(manifest=wrong))).unionByName(constraints.limits(d, max_files=3, max_extract_size=10))


# --- tables as files ---------------------------------------------------------

TABLE_ROWS = 500
_FIELDS = ("n", "ok", "price", "kind", "code", "note", "none")


def event_tables(spark, sf_dir) -> DataFrame:
    """Every 500 events as a CSV file: zeros in front, mixed case, one more decimal, quotes, an empty column, CRLF."""
    e, at = table(spark, sf_dir, "events"), F.col("event_id")
    cents = F.floor(F.abs(F.col("value")) * 100).cast("long")
    cells = F.concat_ws(
        ",", F.concat(F.lit("00"), at.cast("string")), F.element_at(F.array(*map(F.lit, ("True", "FALSE", ""))), (at % 3 + 1).cast("int")),
        F.concat(F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"), F.lit("0")), "event_type",
        F.concat(F.lit("c"), F.floor(at / 2).cast("string")), F.concat(F.lit('"x,""'), at.cast("string"), F.lit('"')), F.lit(""),
    )
    lines = e.select(F.floor(at / TABLE_ROWS).cast("string").alias("file"), F.struct(at.alias("at"), cells.alias("cells")).alias("line"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("line")), lambda x: x["cells"]), "\r\n")
    content = F.concat(F.lit(",".join(_FIELDS) + "\r\n"), body, F.lit("\r\n"))
    return lines.groupBy("file").agg(content.cast("binary").alias("content")).select(F.concat(F.lit("events/"), F.col("file"), F.lit(".csv")).alias("path"), "content")


_CELLS = f"""c AS (SELECT event_id, event_id // {TABLE_ROWS} AS file, floor(abs(value) * 100)::BIGINT AS cents, event_type FROM events),
cells AS (SELECT file, event_id, cents // 100 || '.' || lpad((cents % 100)::VARCHAR, 2, '0') || '0' AS price, event_type, 'c' || (event_id // 2) AS code, event_id % 3 AS third FROM c),
raw AS (SELECT 'events/' || file || '.csv' AS path, '{",".join(_FIELDS)}' || E'\r\n' || string_agg('00' || event_id || ',' || (['True', 'FALSE', ''])[third + 1] || ',' || price || ',' || event_type || ',' || code || ',"x,""' || event_id || '",', E'\r\n' ORDER BY event_id) || E'\r\n' AS text FROM cells GROUP BY file),
canonical AS (SELECT 'events/' || file || '.csv' AS path, '{",".join(_FIELDS)}' || E'\n' || string_agg(event_id || ',' || (['true', 'false', ''])[third + 1] || ',' || price::DOUBLE || ',' || event_type || ',' || code || ',"x,""' || event_id || '",', E'\n' ORDER BY event_id) || E'\n' AS text FROM cells GROUP BY file)"""


def _tables(spark, sf_dir, **options) -> store.Dataset:
    return store.pack(event_tables(spark, sf_dir), store.Options(profile="telemetry", chunk_size=CHUNK, **options))


@query("telemetry_canonical", f"WITH {_CELLS} SELECT path, octet_length(encode(text))::BIGINT AS size, sha256(text) AS hash FROM canonical")
def telemetry_canonical(spark, sf_dir):
    """CSV files through columns, packing and back: what comes out is canonical."""
    return store.extract(_tables(spark, sf_dir, telemetry_mode="canonical")).select("path", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("hash"))


@query("telemetry_exact", f"WITH {_CELLS} SELECT path, octet_length(encode(text))::BIGINT AS size, sha256(text) AS hash FROM raw")
def telemetry_exact(spark, sf_dir):
    return store.extract(_tables(spark, sf_dir)).select("path", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("hash"))


@query(
    "telemetry_columns",
    f"""WITH {_CELLS}, k AS (SELECT 'events/' || file || '.csv' AS path, count(*) AS n, count(DISTINCT event_type) AS kinds, count(DISTINCT code) AS codes FROM cells GROUP BY file),
t AS (SELECT path, unnest([0, 1, 2, 3, 4, 5, 6]) AS position, unnest(['n: timestamp', 'ok: boolean', 'price: float', 'kind: string', 'code: string', 'note: string', 'none: string']) AS detected,
 unnest(['n as ' || CASE WHEN n > 2 THEN 'delta-of-delta' ELSE 'delta' END, 'ok as bit-pack', 'price as ieee-754', 'kind as ' || CASE WHEN kinds <= greatest(16, n // 4) THEN 'dictionary' WHEN n > 2 AND kinds < n * 3 // 4 THEN 'rle' ELSE 'plain' END,
 'code as ' || CASE WHEN codes <= greatest(16, n // 4) THEN 'dictionary' WHEN n > 2 AND codes < n * 3 // 4 THEN 'rle' ELSE 'plain' END, 'note as ' || CASE WHEN n <= 16 THEN 'dictionary' ELSE 'plain' END, 'none as plain']) AS applied FROM k)
SELECT path, position, detected, applied FROM t""",
)
def telemetry_columns(spark, sf_dir):
    """What was seen in each column, and how it was encoded."""
    told = F.posexplode(F.arrays_zip(F.col("transform.detected").alias("d"), F.slice(F.col("transform.applied"), 3, 100).alias("a"))).alias("position", "x")
    packed = _tables(spark, sf_dir, telemetry_mode="canonical", time_field="n").files
    return packed.select("path", told).select("path", "position", F.col("x.d").alias("detected"), F.col("x.a").alias("applied"))


@query("csv_rows", f"WITH {_CELLS} SELECT 'events/' || file || '.csv' AS path, row_number() OVER (PARTITION BY file ORDER BY event_id) - 1 AS ordinal, '00' || event_id AS n, 'x,\"' || event_id AS note FROM cells")
def csv_rows(spark, sf_dir):
    """Files cut into records, with their numbers; two columns by name."""
    return delimited.csv_table(event_tables(spark, sf_dir), ["n", "note"]).select("path", F.col("ordinal").cast("long").alias("ordinal"), "n", "note")


# --- sources with trained dictionaries ---------------------------------------


def _sources(spark, sf_dir) -> store.Dataset:
    return store.pack(source_files(spark, sf_dir), store.Options(profile="source", codec="zstd", chunk_size=CHUNK))


@query("source_extract", f"WITH {_SOURCE} SELECT path, octet_length(content)::BIGINT AS size, sha256(content) AS hash FROM files")
def source_extract(spark, sf_dir):
    """Sources packed with a dictionary for each category, and back."""
    return store.extract(_sources(spark, sf_dir)).select("path", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("hash"))


@query("source_dictionaries", f"WITH {_SOURCE} SELECT category, sum(ceil(octet_length(content) / {CHUNK}))::BIGINT AS references_, sum(ceil(octet_length(content) / {CHUNK}))::BIGINT AS with_dictionary, true AS listed FROM files GROUP BY category")
def source_dictionaries(spark, sf_dir):
    """All references of a category are packed with a dictionary that the catalog has."""
    d = _sources(spark, sf_dir)
    catalog = d.dictionaries.select("dictionary_id", F.lit(True).alias("known"))
    refs = d.file_chunks.join(d.files.select("path", "source_category"), "path").join(catalog, "dictionary_id", "left")
    counted = refs.groupBy(F.col("source_category").alias("category")).agg(F.count(F.lit(1)).alias("references_"), F.count_if("known").alias("with_dictionary"))
    return counted.join(d.source_dictionaries.select("category", F.lit(True).alias("listed")), "category", "left")


@query("source_violations", "SELECT 'V10' AS rule, c AS subject, 'source dictionaries under another profile' AS problem FROM (SELECT unnest(['python', 'c-cpp', 'documentation', 'json-yaml']) AS c)")
def source_violations(spark, sf_dir):
    """A sound dataset with dictionaries, but for its profile."""
    d = _sources(spark, sf_dir)
    return constraints.violations(d.replaced(manifest=d.manifest.withColumn("profile", F.lit("general"))))


@query("migrate_sources", "SELECT c AS category, true AS same FROM (SELECT unnest(['python', 'c-cpp', 'documentation', 'json-yaml']) AS c)")
def migrate_sources(spark, sf_dir):
    """Dictionaries out of a 1.0 dataset, where chunks carried them, are those of before."""
    d = _sources(spark, sf_dir)
    new = migration.normalize(migration.legacy_of(d))
    same = new.source_dictionaries.join(new.dictionaries, "dictionary_id").join(d.dictionaries.select("dictionary_id", F.col("data").alias("was")), "dictionary_id")
    return same.select("category", (F.col("data") == F.col("was")).alias("same"))


@query("tree_round_trip", "SELECT 'pages/' || page_id AS path, octet_length(encode(html))::BIGINT AS size, sha256(html) AS hash FROM pages")
def tree_round_trip(spark, sf_dir):
    """Pages written as a tree of files, walked, listed and read again."""
    folder = staging.fresh_path(spark, "tree").removeprefix("file://")
    written_rows = store.write_tree(pages(spark, sf_dir).withColumn("mode", F.lit(None).cast("int")), folder).count()
    listing, _, _ = sources.catalog_tables(spark, sources.walk([f"{folder}/pages"]))
    if listing.count() != written_rows:
        raise ValueError("the walk does not find what was written")
    return sources.read_contents(listing).select("path", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("hash"))


@query("wide_delta", "WITH n AS (SELECT event_id AS ordinal, (100000000000000000000::HUGEINT * event_id + user_id) AS n FROM events), d AS (SELECT *, n - lag(n) OVER (ORDER BY ordinal) AS d FROM n) SELECT ordinal, n::VARCHAR AS n, d::VARCHAR AS d, (d - lag(d) OVER (ORDER BY ordinal))::VARCHAR AS dd FROM d")
def wide_delta(spark, sf_dir):
    """Differences of integers of over twenty digits."""
    wide = (F.lit("1" + 20 * "0").cast("decimal(38,0)") * F.col("event_id").cast("decimal(12,0)") + F.col("user_id")).cast("decimal(38,0)").cast("string")
    steps = columns.differences(table(spark, sf_dir, "events").select("event_id", wide.alias("n")), "event_id", "n").rows()
    return steps.select("ordinal", *[F.col(c).cast("string").alias(c) for c in ("n", "d", "dd")])


@query("infer_types_wide", "SELECT position, name, type, encoding, rows_ AS \"rows\", rows_ AS present, rows_ AS \"distinct\" FROM (SELECT count(*) AS rows_ FROM events), (SELECT unnest([0, 1, 2, 3]) AS position, unnest(['rising', 'falling', 'long', 'real']) AS name, unnest(['integer', 'integer', 'integer', 'float']) AS type, unnest(['delta', 'plain', 'plain', 'ieee-754']) AS encoding)")
def infer_types_wide(spark, sf_dir):
    """Integers of over 20 digits that rise and fall, of over 37 digits, and floats with exponents."""
    at = F.lpad(F.col("event_id").cast("string"), 12, "0")
    texts = table(spark, sf_dir, "events").select(
        "event_id", F.concat(F.lit("1"), F.repeat(F.lit("0"), 9), at).alias("rising"), F.concat(F.lit("-1"), F.repeat(F.lit("0"), 9), at).alias("falling"), F.concat(F.repeat(F.lit("9"), 40), at).alias("long"), F.concat(F.lit("0.5"), at, F.lit("e-3")).alias("real"),
    )
    return columns.infer(texts, "event_id", ["rising", "falling", "long", "real"])


@query("goal_migration", "SELECT goal, CASE goal WHEN 'fastest' THEN 'prefer-store' WHEN 'fastest-decode' THEN 'prefer-zstd-low' WHEN 'low-memory' THEN 'avoid-zlib' WHEN 'balanced' THEN 'balanced' WHEN 'smallest' THEN 'smallest' END AS migrated FROM (SELECT unnest(['balanced', 'smallest', 'fastest', 'fastest-decode', 'low-memory', 'other']) AS goal)")
def goal_migration(spark, sf_dir):
    rows = spark.createDataFrame([(g,) for g in (*migration.GOALS, "other")], "goal string")
    return rows.select("goal", migration.migrated_goal(F.col("goal")).alias("migrated"))


@query("migrate_dataset", f"WITH {_REFS} SELECT path, ordinal, chunk_id, row_number() OVER (PARTITION BY chunk_id ORDER BY path, ordinal) > 1 AS reused FROM refs")
def migrate_dataset(spark, sf_dir):
    """The references of an old dataset with the decisions that migration adds."""
    return migration.normalize(migration.legacy_of(_packed(spark, sf_dir, codec="store"))).file_chunks.select("path", "ordinal", "chunk_id", "reused")


@query("dataset_digest", "SELECT count(*) AS \"rows\", true AS same FROM documents")
def dataset_digest(spark, sf_dir):
    """The digest of one input, packed twice in different layouts."""
    f = documents(spark, sf_dir)
    one, two = (store.table_digest(store.pack(x, store.Options(chunk_size=CHUNK, codec="store")).files) for x in (f, f.repartition(5)))
    return one.join(two.withColumnRenamed("rows", "other").withColumnRenamed("digest", "again"), F.lit(True)).select("rows", (F.col("digest") == F.col("again")).alias("same"))
