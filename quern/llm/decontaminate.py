"""Benchmark decontamination by winnowing.

A window is `window` consecutive words of a benchmark item; an item of fewer
words, but not none, is one window. A document word inside an occurrence of a
window is hit.

Winnowing keeps, of every `window - gram + 1` consecutive word `gram`-grams, the
one with the smallest hash (the last of equal ones). Two texts that share a
window share all of its grams, hence the one that is kept of them, so the join
of kept fingerprints meets every shared window. Each meeting is then extended
word by word to both sides, and counts only where a whole window agrees. For an
item of n < window words the same holds with n-grams of which all are kept.

The fingerprints of the items are broadcast, in blocks of at most `block_bytes`
of item text. One block is the usual case, and costs one scan without a
shuffle; with more, the documents are scanned once for each block, and the hits
of a text are put together by its digest.

Defined results: null texts have no words; items without an id or words are no
items; rows with the same item id are one item; repeated documents are judged
alike, each in its own row; words compare by 64-bit hashes; an empty benchmark
hits nothing; columns other than those named are not used and not returned.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm._store import unused, written
from quern.llm._text import ALPHANUMERIC, ASCII_LOWER, as_text, byte_view, covered, find_words, hash_ranges, mix, release, rolling, runs, same_text, slices

WINDOW, GRAM = 8, 4
BLOCK_BYTES = 16 << 20
_BASE = 0x2545F4914F6CDD1D
_PAIRS = 1 << 18

SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
HITS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("hits", T.ArrayType(SPAN)), T.StructField("items", T.ArrayType(T.StringType()))])
_ARROW_HITS = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("hits", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])


def _grams(h: np.ndarray, width: int) -> np.ndarray:
    return mix(rolling(h, width, _BASE))


def winnow(grams: np.ndarray, first: np.ndarray, gram: int, window: int) -> np.ndarray:
    """Positions of the kept grams; grams[i] begins at word i, texts begin at `first`."""
    at = same_text(first, window)
    best = at.copy()
    for j in range(1, window - gram + 1):
        later = at + j
        best = np.where(grams[later] <= grams[best], later, best)
    keep = np.zeros(len(grams), bool)
    keep[best] = True
    return np.flatnonzero(keep)


class ItemIndex:
    """Fingerprints of the items' windows, sorted, with the places that they come from."""

    def __init__(self, ids: list[str], texts: list[str], window: int = WINDOW, gram: int = GRAM):
        self.ids, self.window, self.gram = sorted(set(ids)), window, gram
        number = {x: i for i, x in enumerate(self.ids)}
        data, offsets = byte_view(as_text(pa.array(texts, pa.large_string())))
        words = find_words(ASCII_LOWER[data], offsets, ALPHANUMERIC)
        self.words = hash_ranges(words.data, words.starts, words.ends)
        self.first, counts = words.first, words.counts
        self.row = words.doc()
        self.item = np.array([number[x] for x in ids], dtype=np.int64)
        self.by_width: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        places = {n: self.first[:-1][counts == n] for n in range(1, window)}
        long = counts >= window
        if long.any():
            kept = winnow(_grams(self.words, gram), self.first, gram, window)
            places[window] = kept[long[self.row[kept]]]
        for n, at in places.items():
            if len(at):
                fp = _grams(self.words, gram if n == window else n)[at]
                order = np.argsort(fp, kind="stable")
                sieve = np.zeros(1 << 16, bool)
                sieve[(fp & np.uint64(0xFFFF)).astype(np.int64)] = True
                self.by_width[n] = fp[order], at[order], sieve

    def _meetings(self, h: np.ndarray, n: int, at: np.ndarray, grams: np.ndarray):
        """Pairs of places in documents and items with the same fingerprint, some at a time."""
        fps, places, sieve = self.by_width[n]
        g = grams[at]
        maybe = sieve[(g & np.uint64(0xFFFF)).astype(np.int64)]
        at, g = at[maybe], g[maybe]
        lo, hi = np.searchsorted(fps, g, "left"), np.searchsorted(fps, g, "right")
        found = np.flatnonzero(hi > lo)
        at, lo, many = at[found], lo[found], (hi - lo)[found]
        for a, b in slices(np.concatenate([[0], np.cumsum(many)]), _PAIRS):
            m = many[a:b]
            step = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            yield np.repeat(at[a:b], m), places[np.repeat(lo[a:b], m) + step]

    def search(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The mask of hit words, and the pairs (text, item) with hits."""
        hit = np.zeros(len(h), bool)
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        docs, items = [], []
        for n in self.by_width:
            width = self.gram if n == self.window else n
            grams = _grams(h, width)
            at = winnow(grams, first, width, n) if n == self.window else same_text(first, n)
            reach = n - width
            for p, q in self._meetings(h, n, at, grams):
                equal = np.empty((len(p), n + reach), bool)
                begin, end, start, stop = first[doc[p]], first[doc[p] + 1], self.first[self.row[q]], self.first[self.row[q] + 1]
                for k in range(-reach, n):
                    x, y = p + k, q + k
                    inside = (x >= begin) & (x < end) & (y >= start) & (y < stop)
                    equal[:, k + reach] = inside & (h[np.where(inside, x, 0)] == self.words[np.where(inside, y, 0)])
                for k in range(reach + 1):
                    whole = equal[:, k : k + n].all(axis=1)
                    if whole.any():
                        hit |= covered(len(h), p[whole] - reach + k, n)
                        docs.append(doc[p[whole]])
                        items.append(self.item[self.row[q[whole]]])
        if not docs:
            return hit, np.zeros(0, np.int64), np.zeros(0, np.int64)
        pairs = np.unique(np.concatenate(docs) * len(self.ids) + np.concatenate(items))
        return hit, pairs // len(self.ids), pairs % len(self.ids)


def find_hits(texts: pa.Array, index: ItemIndex) -> pa.Array:
    data, offsets = byte_view(as_text(texts))
    parts = []
    for lo, hi in slices(offsets):
        words = find_words(ASCII_LOWER[data[offsets[lo] : offsets[hi]]], offsets[lo : hi + 1] - offsets[lo], ALPHANUMERIC)
        h = hash_ranges(words.data, words.starts, words.ends)
        mask, docs, items = index.search(h, words.first)
        first, n = words.first, hi - lo
        padded = np.concatenate([[0], np.cumsum(mask)])
        n_hit = padded[first[1:]] - padded[first[:-1]]
        spans: list[list] = [[] for _ in range(n)]
        for d in np.flatnonzero(n_hit):
            s, e = runs(mask[first[d] : first[d + 1]])
            spans[d] = [{"start": a, "end": b} for a, b in zip(s.tolist(), e.tolist(), strict=True)]
        named: list[list] = [[] for _ in range(n)]
        for d, i in zip(docs.tolist(), items.tolist(), strict=True):
            named[d].append(index.ids[i])
        parts.append(pa.StructArray.from_arrays([pa.array(words.counts, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(spans, _ARROW_HITS[2].type), pa.array(named, _ARROW_HITS[3].type)], fields=list(_ARROW_HITS)))
    return pa.concat_arrays(parts) if parts else pa.array([], _ARROW_HITS)


def _block_udf(spark, rows: list, window: int, gram: int):
    shared = spark.sparkContext.broadcast(ItemIndex([r["item"] for r in rows], [r["body"] for r in rows], window, gram))

    @F.arrow_udf(HITS)
    def hits(texts: pa.Array) -> pa.Array:
        out = find_hits(texts, shared.value)
        release()
        return out

    return hits.asNondeterministic()  # else a filter on the hits is pushed below, and they are searched twice


def with_hits(docs: DataFrame, benchmark: DataFrame, name: str = "found", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, gram: int = GRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`docs` with a struct column: n_words, n_hit, hits (word intervals) and items (ids as strings, sorted)."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("body")).where("item IS NOT NULL AND body IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("body") + F.octet_length("item"))).first()[0] or 0
    text = F.col(text_col).cast("string")
    if total <= block_bytes:
        return docs.withColumn(name, _block_udf(spark, items.collect(), window, gram)(text))
    blocks = 2 * math.ceil(total / block_bytes)
    items = written(items.withColumn("block", F.pmod(F.xxhash64("item", "body"), F.lit(blocks))), "items")
    digest = F.sha2(F.coalesce(text, F.lit("")), 256)
    found = []
    for k in range(blocks):
        udf = _block_udf(spark, items.where(F.col("block") == k).collect(), window, gram)
        rows = docs.select(digest.alias("digest"), udf(text).alias("f")).where("f.n_hit > 0")
        found.append(written(rows.groupBy("digest").agg(F.first("f").alias("f")), "hits"))
    merged = found[0]
    for other in found[1:]:
        merged = merged.unionAll(other)
    positions = F.array_sort(F.array_distinct(F.flatten(F.transform(F.flatten(F.collect_list("f.hits")), lambda s: F.sequence(s["start"], s["end"] - 1)))))
    merged = written(merged.groupBy("digest").agg(positions.alias("at"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("f.items")))).alias("items")), "hits")
    of, place, met = unused(docs, "digest", "at", "items")
    joined = docs.withColumn(of, digest).join(merged.withColumnsRenamed({"digest": of, "at": place, "items": met}), of, "left")
    empty = F.array().cast("array<bigint>")
    at = F.coalesce(place, empty)
    starts = F.filter(at, lambda x: ~F.array_contains(at, x - 1))
    ends = F.filter(at, lambda x: ~F.array_contains(at, x + 1))
    spans = F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), (e + 1).alias("end")))
    struct = F.struct(_count_words(text).alias("n_words"), F.size(at).cast("long").alias("n_hit"), spans.alias("hits"), F.coalesce(met, F.array().cast("array<string>")).alias("items"))
    return joined.withColumn(name, struct).select(*[F.col(c) for c in docs.columns], name)


@F.arrow_udf(T.LongType())
def _count_words(texts: pa.Array) -> pa.Array:
    data, offsets = byte_view(as_text(texts))
    return pa.array(find_words(ASCII_LOWER[data], offsets, ALPHANUMERIC).counts, pa.int64())


def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """The texts without the words of their spans and what lies between those."""
    texts = as_text(texts)
    data, offsets = byte_view(texts)
    parts = []
    for lo, hi in slices(offsets):
        part = data[offsets[lo] : offsets[hi]]
        words = find_words(ASCII_LOWER[part], offsets[lo : hi + 1] - offsets[lo], ALPHANUMERIC)
        raw = part.tobytes()
        for i, own in enumerate(spans[lo:hi].to_pylist()):
            out, at = [], int(offsets[lo + i] - offsets[lo])
            for s in own or []:
                first = int(words.first[i])
                out.append(raw[at : words.starts[first + s["start"]]])
                at = int(words.ends[first + s["end"] - 1])
            out.append(raw[at : int(offsets[lo + i + 1] - offsets[lo])])
            parts.append(b"".join(out).decode())
    return pa.array(parts, pa.string())


@F.arrow_udf(T.StringType())
def _cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
    return cut(texts, spans)


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", chars_col: str = "n_chars", max_items: int = 1) -> DataFrame:
    """`docs` without texts that hold over `max_items` items, and without the hit words of the others.

    A text of which nothing but hit words is left goes too. Texts without hits stay
    as they are.
    """
    (name,) = unused(docs, "found")
    found = with_hits(docs, benchmark, name, text_col)
    n_items, n_hit = F.size(f"{name}.items"), F.col(f"{name}.n_hit")
    kept = found.where((n_items <= max_items) & ((n_hit == 0) | (n_hit < F.col(f"{name}.n_words"))))
    # only few texts have hits, but a Python function under a condition runs on every row: give it empty texts for the rest
    shortened = _cut(F.when(n_hit > 0, F.col(text_col).cast("string")).otherwise(F.lit("")), f"{name}.hits")
    text = F.when(n_hit > 0, shortened).otherwise(F.col(text_col))
    columns = [text.alias(c) if c == text_col else F.when(n_hit > 0, F.char_length(shortened).cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c == chars_col else F.col(c) for c in docs.columns]
    return kept.select(*columns)


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = with_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_items = F.size("found.items").cast("long")
    return found.select("doc_id", "found.n_words", "found.n_hit", n_items.alias("n_items"), F.sha2(F.array_join("found.items", ",").cast("binary"), 256).alias("items_sha256"), (n_items >= 2).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = f"""
WITH docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
items AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS (SELECT DISTINCT item_id, least({WINDOW}, len(w)) AS n, array_to_string(w[i + 1:i + {WINDOW}], ' ') AS run FROM (SELECT *, unnest(range(greatest(1, len(w) - {WINDOW - 1}))) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, n, i, array_to_string(w[i + 1:i + n], ' ') AS run FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS i FROM docs, sizes WHERE len(w) >= n)),
met AS (SELECT doc_id, n, i, item_id FROM places JOIN windows USING (n, run)),
hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM met) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM met) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM docs d LEFT JOIN hit h ON h.doc_id = d.doc_id LEFT JOIN found f ON f.doc_id = d.doc_id
"""
