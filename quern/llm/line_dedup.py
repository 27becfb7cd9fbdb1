"""Line dedup: maximal repeated runs of lines lose all copies but the first.

The lines with a word, in order, are a document's sequence of line ids; a line
id is a 128-bit hash. Rows are put in the order of (id with null last, hash
of id and text), and their lines in that order, so a place is one number, and the
place k lines on is k more.

Suffix array by prefix doubling
-------------------------------
The rank of a place among prefixes of length k, paired with the rank of the
place k lines on, ranks it among prefixes of length 2k. Ranks come from a range
sort of the distinct pairs that two places or more share; a place whose prefix
is its own has its order, and leaves. Rounds end when no prefix is shared, so
they are as many as the logarithm of the longest repeated run.

Longest common prefixes
-----------------------
For each place, `copied` is the length of the longest run that starts there and
at an earlier place, too: the depth of the deepest longest-common-prefix interval
in which the place is not the first. Ranks give its power of two 2**j at once.
Between 2**j and 2**(j + 1) it is found by halving: two overlapping ranks of
length 2**j identify a prefix of any length in between, so each step splits the
intervals at hand by one look-up and one minimum. The first place of an interval
stands for all of it in shorter ones; no interval is written out as pairs, and no
task sees one whole.

What goes
---------
The copied run of a place counts if it has `min_lines` lines, or `min_words`
words, or is its whole document. Runs that count merge into maximal intervals,
and their lines are deleted, judged on the input. (Shorter runs are what any two
texts may share: a heading, a greeting.)

Places are spread by number, line ids and ranks are pre-aggregated before a
shuffle, and places meet their rank in joins whose tables are written first, so
that a line that a third of all documents hold can be split over tasks. A line
repeated in one text enters as often as it stands there. Equal rows enter the
sort like others, but meet their answer by their hash: the first keeps what it
keeps, and each other loses all worded lines, being a copy as a whole. They are
aggregated by task, so no task gathers them.

Defined results: a null text has no lines; lines without a word are no part of
runs, and stay; of equal rows the first keeps what the others lose; ids may be
null; an empty table gives an empty result; other columns are not used. A text
is cut into lines as a whole: a task needs about six times the bytes of its
longest text.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm._store import shuffle_partitions, written

MIN_LINES, MIN_WORDS = 3, 50
WORD = r"[^\x20\x09-\x0D]+"


def _keys(id_col: str, text) -> list:
    return [F.xxhash64(F.col(id_col), text).alias("key"), F.hash(text, F.col(id_col)).alias("key2")]


def sequences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(place, row, stop, a, b, w, key, key2): a line each, in corpus order.

    The places of a row's lines are `row` up to, not including, `stop`; (a, b) is
    the line's id, and w the number of its words. Rows without worded lines have none.
    """
    text = F.col(text_col).cast("string")
    parts = F.coalesce(F.split(text, "\n", -1), F.array().cast("array<string>"))
    counted = F.transform(parts, lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"), F.regexp_count(x, F.lit(WORD)).alias("w")))
    table = docs.select(F.col(id_col).alias("id"), *_keys(id_col, text), F.filter(counted, lambda x: x["w"] > 0).alias("lines"))
    table = written(table, "texts")  # else a range sort's sample cuts all texts once more
    order = [F.col("id").asc_nulls_last(), F.col("key"), F.col("key2")]
    ordered = table.repartitionByRange(shuffle_partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    one = ordered.select("key", "key2", F.size("lines").alias("n"), F.posexplode("lines").alias("pos", "line"))
    placed = one.withColumn("place", F.monotonically_increasing_id()).withColumn("row", F.col("place") - F.col("pos"))
    return written(placed.select("place", "row", (F.col("row") + F.col("n")).alias("stop"), "line.a", "line.b", "line.w", "key", "key2"), "lines")


def ranked(places: DataFrame, keys: list[str], size: int) -> DataFrame:
    """The places whose key others share, with the key's rank instead, and the first of those places.

    Ranks follow the order of the keys: range partitions and the order within them
    make the increasing ids follow it. `size` is about how many places there are.
    """
    shared = places.groupBy(*keys).agg(F.count(F.lit(1)).alias("places"), F.min("place").alias("first")).where("places > 1")
    parts = min(shuffle_partitions(places.sparkSession), 1 + size // 500_000)
    ranks = shared.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select(*keys, "first", F.monotonically_increasing_id().alias("rank"))
    return written(places.join(ranks, keys).drop(*keys), "places", size)


def suffix_ranks(lines: DataFrame) -> list[DataFrame]:
    """(place, rank, first) for prefixes of 1, 2, 4, ... lines, as long as any is shared; of one line with row, stop and w, too."""
    levels = [ranked(lines.select("place", "row", "stop", "w", "a", "b"), ["a", "b"], lines.count())]
    while size := levels[-1].count():
        step = 1 << (len(levels) - 1)
        ahead = levels[-1].select((F.col("place") - step).alias("place"), F.col("rank").alias("next"))
        own = levels[-1].where(F.col("place") + step < F.col("stop")).select("place", "stop", F.col("rank").alias("head"))
        levels.append(ranked(own.join(ahead, "place"), ["head", "next"], size))
    return levels[:-1]


def _united(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def copied_runs(levels: list[DataFrame]) -> DataFrame:
    """(place, copied) of the places that begin a run which an earlier place begins, too; copied: its most lines."""
    later = F.col("place") > F.col("first")
    # at level j are the places for which no run of 2**(j + 1) is known, and the firsts that stand for those
    sizes = [x.count() for x in levels]
    opened = [x.join(up.where(later).select("place"), "place", "left_anti") for x, up in zip(levels, levels[1:], strict=False)] + levels[-1:]
    at = None
    for j in range(len(levels) - 1, 0, -1):
        own = opened[j].select(F.lit(j).alias("level"), F.lit(1 << j).cast("long").alias("low"), "first", "place")
        ranks = _united([x.select(F.lit(k).alias("level"), F.col("place").alias("at"), F.col("rank").alias("next")) for k, x in enumerate(levels) if k >= j])
        at = _halved(own if at is None else at.unionAll(own), ranks, j - 1, 2 * sizes[j])
    done = opened[0].where(later).select("place", F.lit(1).cast("long").alias("copied"))
    return done if at is None else done.unionAll(at.where(later).select("place", F.col("low").alias("copied")))


def _halved(at: DataFrame, ranks: DataFrame, i: int, size: int) -> DataFrame:
    """Splits the intervals of depth `low`, all on levels over i, at depth low + 2**i.

    A prefix of that depth is the interval and the rank, on its level, of the
    window that ends there. Places that share it go on at the new depth; the first
    of them, and what shares it with none, also at the old one.
    """
    step, columns = 1 << i, ["level", "low", "first", "place"]
    ends = at.withColumn("at", F.expr("place + low - shiftleft(1L, level)") + step)
    seen = written(ends.join(ranks, ["level", "at"], "left").select(*columns, "next"), "seen", size)
    known, keys = seen.where("next IS NOT NULL"), ["level", "low", "first", "next"]
    both = known.join(known.groupBy(*keys).agg(F.min("place").alias("least"), F.count(F.lit(1)).alias("places")), keys)
    kept = F.when(F.col("places") > 1, F.struct((F.col("low") + step).alias("low"), F.col("least").alias("first")))
    stay = F.when(F.col("place") == F.col("least"), F.struct("low", "first"))
    going = both.select("level", "place", F.explode(F.array_compact(F.array(kept, stay))).alias("to"))
    return going.select("level", "to.low", "to.first", "place").unionAll(seen.where("next IS NULL").select(*columns))


def removals(lines: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """(row, longest, removed) of the rows in `lines` (see sequences) with copied runs: their most lines, and merged intervals of what goes."""
    levels = suffix_ranks(lines)
    if not levels:
        return lines.selectExpr("row", "0L AS longest", "CAST(array() AS array<struct<start: bigint, end: bigint>>) AS removed").limit(0)
    shared = levels[0].select("place", "row", "stop", "w")
    runs = written(copied_runs(levels).join(shared, "place"), "runs")
    whole = (F.col("copied") >= min_lines) | (F.col("copied") == F.col("stop") - F.col("row"))
    short = runs.where(~whole).select("place", F.explode(F.sequence(F.col("place"), F.col("place") + F.col("copied") - 1)).alias("at"))
    heavy = short.join(shared.select(F.col("place").alias("at"), "w"), "at").groupBy("place").agg(F.sum("w").alias("words")).where(F.col("words") >= min_words).select("place", F.lit(True).alias("heavy"))
    found = runs.join(heavy, "place", "left")
    span = F.when(whole | F.col("heavy"), F.struct((F.col("place") - F.col("row")).alias("start"), (F.col("place") - F.col("row") + F.col("copied")).alias("end")))
    by_row = written(found.groupBy("row").agg(F.max("copied").alias("longest"), F.array_sort(F.collect_list(span)).alias("own")), "spans")
    # the ends of copied runs never fall from one place to the next, so neighbours decide
    begins = F.filter("own", lambda x, i: (i == 0) | (x["start"] > F.get("own", i - 1)["end"]))
    stops = F.filter("own", lambda x, i: (i == F.size("own") - 1) | (F.get("own", i + 1)["start"] > x["end"]))
    merged = F.zip_with(begins, stops, lambda x, y: F.struct(x["start"].alias("start"), y["end"].alias("end")))
    return by_row.select("row", "longest", merged.alias("removed"))


def remove_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per text: id, n_lines, n_removed, longest_copy (lines), removed (intervals of worded lines) and kept_text."""
    lines = sequences(docs, id_col, text_col)
    keys = ["key", "key2"]
    firsts = lines.where("place = row").groupBy(*keys).agg(F.min("row").alias("row"), F.min(F.col("stop") - F.col("row")).alias("worded"), F.count(F.lit(1)).alias("times"))
    known = firsts.join(removals(lines, min_lines, min_words), "row", "left").where("times > 1 OR longest > 0")
    answers = written(known.select(F.col("key").alias("__key"), F.col("key2").alias("__key2"), "worded", "times", "longest", "removed"), "answers")
    text = F.col(text_col).cast("string")
    base = docs.select(F.col(id_col).alias("id"), text.alias("text"), *_keys(id_col, text), F.spark_partition_id().alias("task"))
    # merged at every size: a broadcast would depend on how much of the corpus repeats
    joined = base.join(answers.hint("merge"), (F.col("key") == F.col("__key")) & (F.col("key2") == F.col("__key2")), "left")
    columns = ["id", "text", "longest", "removed"]
    rows = joined.where("times IS NULL OR times = 1").select(*columns)
    if answers.where("times > 1").limit(1).count():
        rows = rows.unionAll(_of_equals(joined.where("times > 1")).select(*columns))
    none = F.array().cast("array<struct<start: bigint, end: bigint>>")
    lines = F.coalesce(F.split("text", "\n", -1), F.array().cast("array<string>"))
    shown = rows.select("id", "text", F.coalesce("longest", F.lit(0)).cast("long").alias("longest"), F.coalesce("removed", none).alias("removed"), F.size(lines).cast("long").alias("n_lines"))
    return shown.select(
        F.col("id").alias(id_col),
        "n_lines",
        F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_removed"),
        F.col("longest").alias("longest_copy"),
        "removed",
        # a Python function under a condition runs on every row: it gets empty texts where nothing is to do
        F.when(F.size("removed") == 0, F.coalesce("text", F.lit(""))).otherwise(_without(F.when(F.size("removed") > 0, F.col("text")).otherwise(F.lit("")), "removed")).alias("kept_text"),
    )


def _of_equals(rows: DataFrame) -> DataFrame:
    """Of equal rows, one with its answer, and all others without worded lines: counted by task, then written out again."""
    keys = ["key", "key2"]
    once = rows.groupBy(*keys, "task").agg(*[F.first(x).alias(x) for x in ("id", "text", "worded", "longest", "removed")], F.count(F.lit(1)).alias("copies"))
    once = written(once, "equals")
    first = once.groupBy(*keys).agg(F.min("task").alias("first"))
    turns = once.join(first, keys).withColumn("turn", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    kept = (F.col("task") == F.col("first")) & (F.col("turn") == 1)
    whole = F.when(F.col("worded") > 0, F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("worded").alias("end"))))
    return turns.withColumns({"longest": F.when(kept, F.col("longest")).otherwise(F.col("worded")), "removed": F.when(kept, F.col("removed")).otherwise(whole)})


@F.arrow_udf(T.StringType())
def _without(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """The texts without the lines of the spans, which count worded lines."""
    out = []
    for text, own in zip(texts, spans, strict=True):
        lines, own = text.as_py().split("\n"), own.as_py()
        if own:
            at = [i for i, x in enumerate(lines) if x.strip(" \t\n\x0b\x0c\r")]
            gone = {i for s in own for i in at[s["start"] : s["end"]]}
            lines = [x for i, x in enumerate(lines) if i not in gone]
        out.append("\n".join(lines))
    return pa.array(out, pa.string())


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeated_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_removed", "longest_copy", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


#: Prefixes grow by a line a round here; `place` numbers all worded lines in corpus order.
SQL = f"""
WITH RECURSIVE split AS (SELECT doc_id, coalesce(string_split(text, chr(10)), []) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS no FROM split),
worded AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS LAST, no) AS place, row_number() OVER d AS pos, count(*) OVER (PARTITION BY doc_id) AS worded, dense_rank() OVER (ORDER BY line) AS lid
  FROM (SELECT *, len(regexp_extract_all(line, '{WORD}')) AS words FROM lines) WHERE words > 0 WINDOW d AS (PARTITION BY doc_id ORDER BY no)),
runs AS (SELECT 1 AS k, place, min(place) OVER (PARTITION BY lid) AS first FROM worded QUALIFY count(*) OVER (PARTITION BY lid) > 1
  UNION ALL
  SELECT k + 1, r.place, min(r.place) OVER (PARTITION BY first, b.lid) FROM runs r JOIN worded a ON a.place = r.place JOIN worded b ON b.place = r.place + k AND b.pos = a.pos + k AND b.doc_id IS NOT DISTINCT FROM a.doc_id QUALIFY count(*) OVER (PARTITION BY first, b.lid) > 1),
copied AS (SELECT place, max(k) AS k FROM runs WHERE first <> place GROUP BY place),
weighed AS (SELECT w.doc_id, w.place, w.pos, w.worded, k, (SELECT sum(words) FROM worded v WHERE v.place >= w.place AND v.place < w.place + k) AS words FROM copied JOIN worded w USING (place)),
gone AS (SELECT DISTINCT unnest(range(place, place + k)) AS place FROM weighed WHERE k >= {MIN_LINES} OR words >= {MIN_WORDS} OR k = worded),
marked AS (SELECT l.doc_id, l.no, l.line, g.place IS NOT NULL AS gone FROM lines l LEFT JOIN worded w ON w.doc_id = l.doc_id AND w.no = l.no LEFT JOIN gone g ON g.place = w.place),
kept AS (SELECT doc_id, count(*) AS n_lines, count_if(gone)::BIGINT AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (WHERE NOT gone), '') AS kept FROM marked GROUP BY doc_id),
longest AS (SELECT doc_id, max(k)::BIGINT AS k FROM weighed GROUP BY doc_id)
SELECT s.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(g.k, 0) AS longest_copy, sha256(coalesce(kept, '')) AS kept_sha256
FROM split s LEFT JOIN kept k ON s.doc_id = k.doc_id LEFT JOIN longest g ON s.doc_id = g.doc_id
"""
