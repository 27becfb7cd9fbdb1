"""Substring dedup: windows of words that occur more than once are removed.

Rabin-Karp hashes of every window of `window` consecutive words are counted in
Spark; all windows found twice or more merge into maximal removal intervals.

How it is laid out
------------------
* Texts are dealt into groups of a few MB by a hash of (id, text, number of the
  input partition), so that equal rows spread, too. A group is a unit of work, not
  a unit of meaning: which texts share one has no influence.
* Each group sends its distinct window hashes, packed eight bytes each, to
  buckets chosen by a second, independent hash. A window is thus told apart by
  64 bits and the bucket's number. A hash that a group holds many times is sent
  once, with a mark; so a passage in a third of all texts arrives at most once
  per group, whatever its frequency.
* A bucket answers each group with one bit per hash it sent.
* Groups and bits meet again, and positions follow from hashing once more.

Shuffled are the texts once, eight bytes a window, and one bit a window back.
Nothing is collected on the driver but one sum.

Defined results: a null text is an empty one; a text with fewer words than the
window keeps all; repeated rows are copies of each other like any others, also
where id and text are both equal; ids may be null; columns other than id and
text are not used and not returned; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm._store import shuffle_partitions
from quern.llm._text import NON_SPACE, Words, as_text, byte_view, covered, find_words, hash_ranges, mix, release, rolling, runs, same_text

GROUP_BYTES = 3 << 20
BUCKET_BYTES = 12 << 20
_BASE, _BASE2 = 0x5851F42D4C957F2D, 0xD1342543DE82EF95


def _window_hashes(words: Words, window: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the windows, their hashes and their buckets."""
    at = same_text(words.first, window)
    if not len(at):
        return at, np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = hash_ranges(words.data, words.starts, words.ends, 1)
    key = mix(rolling(h, window, _BASE)[at])
    other = mix(rolling(mix(h ^ np.uint64(_BASE2)), window, _BASE2)[at])
    return at, key, ((other >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _distinct(key: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct (bucket, key) in order: keys, buckets, counts, and each window's place."""
    order = np.lexsort((key, bucket))
    k, b = key[order], bucket[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (b[1:] != b[:-1])
    first = np.flatnonzero(new)
    place = np.empty(len(k), np.int64)
    place[order] = np.cumsum(new) - 1
    return k[first], b[first], np.diff(np.append(first, len(k))), place


def _sender(window: int, buckets: int):
    def send(table: pa.Table) -> pa.Table:
        data, offsets = byte_view(as_text(table["text"]))
        _, key, bucket = _window_hashes(find_words(data, offsets, NON_SPACE), window, buckets)
        rows: dict[str, list] = {"bucket": [], "grp": [], "once": [], "often": []}
        if len(key):
            k, b, counts, _ = _distinct(key, bucket)
            cut = np.flatnonzero(np.diff(b)) + 1
            grp = table["grp"][0].as_py()
            for kk, bb, cc in zip(np.split(k, cut), np.split(b, cut), np.split(counts, cut), strict=True):
                rows["bucket"].append(int(bb[0]))
                rows["grp"].append(grp)
                rows["once"].append(kk[cc == 1].tobytes())
                rows["often"].append(kk[cc > 1].tobytes())
        release()
        return pa.table({"bucket": pa.array(rows["bucket"], pa.int64()), "grp": pa.array(rows["grp"], pa.int64()), "once": pa.array(rows["once"], pa.binary()), "often": pa.array(rows["often"], pa.binary())})

    return send


def _answer(table: pa.Table) -> pa.Table:
    """For every group that sent hashes to a bucket: which of its single ones are repeated."""
    once = [np.frombuffer(x, np.uint64) for x in table["once"].to_pylist()]
    sizes = np.array([len(x) for x in once])
    own = np.concatenate(once)
    often = [np.frombuffer(x, np.uint64) for x in table["often"].to_pylist()]
    k, inverse, counts = np.unique(own, return_inverse=True, return_counts=True)
    bad = counts > 1
    if sum(map(len, often)):
        bad |= np.isin(k, np.concatenate(often))
    flags = bad[inverse] if len(own) else np.zeros(0, bool)
    grp, out, bits = table["grp"].to_pylist(), [], []
    for g, part in zip(grp, np.split(flags, np.cumsum(sizes)[:-1]), strict=True):
        if part.any():
            out.append(g)
            bits.append(np.packbits(part).tobytes())
    bucket = table["bucket"][0].as_py() if len(table) else 0
    return pa.table({"grp": pa.array(out, pa.int64()), "bucket": pa.array([bucket] * len(out), pa.int64()), "bits": pa.array(bits, pa.binary())})


def _remover(window: int, buckets: int):
    def remove(texts: pa.Table, answers: pa.Table) -> pa.Table:
        column = as_text(texts["text"])
        data, offsets = byte_view(column)
        words = find_words(data, offsets, NON_SPACE)
        at, key, bucket = _window_hashes(words, window, buckets)
        gone = np.zeros(len(words.starts), bool)
        if len(at):
            k, b, counts, place = _distinct(key, bucket)
            bad = counts > 1
            single = np.flatnonzero(~bad)
            begin = np.searchsorted(b[single], np.arange(buckets + 1))
            for n, packed in zip(answers["bucket"].to_pylist(), answers["bits"].to_pylist(), strict=True):
                mine = single[begin[n] : begin[n + 1]]
                bad[mine] = np.unpackbits(np.frombuffer(packed, np.uint8), count=len(mine)).astype(bool)
            gone = covered(len(words.starts), at[bad[place]], window)
        raw, first = data.tobytes(), words.first
        kept, spans, removed = [], [], []
        for i in range(len(column)):
            lo, hi = int(first[i]), int(first[i + 1])
            mask = gone[lo:hi]
            s, e = runs(mask)
            removed.append(int(mask.sum()))
            spans.append([{"start": int(x), "end": int(y)} for x, y in zip(s, e, strict=True)])
            starts, ends = words.starts[lo:hi], words.ends[lo:hi]
            if removed[-1]:
                starts, ends = starts[~mask], ends[~mask]
            kept.append(b" ".join([raw[x:y] for x, y in zip(starts.tolist(), ends.tolist(), strict=True)]).decode())
        return pa.table({
            "id": texts["id"],
            "n_words": pa.array(words.counts, pa.int64()),
            "n_removed": pa.array(removed, pa.int64()),
            "removed": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            "kept_text": pa.array(kept, pa.string()),
        })

    return remove


def remove_repeated_windows(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", group_bytes: int = GROUP_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per text: id, n_words, n_removed, removed (word intervals) and kept_text.

    A group's hashes go to all buckets, so that groups and buckets both grow with
    the square root of the input above 4 GB, up to 16 times their sizes here.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    total = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    grow = min(16.0, max(1.0, math.sqrt(total / (4 << 30))))
    groups = max(1, math.ceil(total / (group_bytes * grow)), shuffle_partitions(spark))
    buckets = max(1, math.ceil(1.3 * total / (bucket_bytes * grow)), shuffle_partitions(spark))
    dealt = base.withColumn("grp", F.pmod(F.xxhash64("id", "text", F.spark_partition_id()), F.lit(groups)))
    sent = dealt.groupBy("grp").applyInArrow(_sender(window, buckets), "bucket long, grp long, once binary, often binary")
    answers = sent.groupBy("bucket").applyInArrow(_answer, "grp long, bucket long, bits binary")
    out = dealt.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(
        _remover(window, buckets), f"id {base.schema['id'].dataType.simpleString()}, n_words long, n_removed long, removed array<struct<start: long, end: long>>, kept_text string"
    )
    return out.withColumnRenamed("id", id_col)


WINDOW = 35


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = remove_repeated_windows(docs, WINDOW)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


SQL = rf"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (SELECT doc_id, i, array_to_string(w[i + 1:i + {WINDOW}], ' ') AS run FROM (SELECT doc_id, w, unnest(range(len(w) - {WINDOW - 1})) AS i FROM docs WHERE len(w) >= {WINDOW})),
often AS (SELECT run FROM places GROUP BY run HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS i FROM places JOIN often USING (run)),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM docs),
kept AS (SELECT w.doc_id, count(g.i) AS n_removed, string_agg(word, ' ' ORDER BY w.i) FILTER (WHERE g.i IS NULL) AS kept FROM words w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.i = w.i GROUP BY w.doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM docs d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
