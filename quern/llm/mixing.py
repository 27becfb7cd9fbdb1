"""Mixing sources to target weights by cube-method balanced sampling.

A text's size is its number of words. The sources, in the order of their names'
code points with null last, weigh 5, 2, 1, 5, 2, 1, ... and share the sizes of
all texts; a source's target stops at `most` times its own size, and the excess
goes to the others by weight until none is above.

A source whose target is r times its size takes each of its texts floor(r) times,
and once more with probability r - floor(r). These last are drawn by the cube
method. In the flight phase, the vector of inclusion probabilities moves along
directions in the null space of the constraints (the number of texts and the
number of words of the source), a step that keeps both totals and every
expectation and settles at least one text. It runs in blocks of a few thousand
texts of one source; a block ends with at most two unsettled texts. What is
unsettled meets in blocks of blocks, until a source has one block. There the
landing settles the last two: along the direction that keeps words alone, then
by chance. So a source's words miss the target by about one text.

Every block has its own generator, seeded by source, level and block, and takes
its texts in a fixed order: reruns agree. No task sees more than a block, and
the driver sees counts only.

Defined results: a null text has size 0; null sources are one source; a source
without words has target 0 and takes each of its texts never; identical rows are
texts of their own; null ids are allowed; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm._store import exactly_once, row_keys, unused, written

WEIGHTS = (5.0, 2.0, 1.0)
BLOCK, PIECE = 4096, 100_000
FAN_IN = 1024
_EPS = 1e-9


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """`sources` (source, source_size, n) with rank and target.

    A source is capped once the level (words per unit of weight) that the others
    share would carry it above its cap; the level only rises, so a round caps
    more or ends. A round is one aggregation of the table of sources.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())  # a row per source
    ranked = sources.withColumn("rank", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    table = written(ranked.withColumn("weight", weight).withColumn("cap", most * F.col("source_size")), "sources")
    total = float(table.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        free = F.col("weight") * F.lit(level) < F.col("cap")
        taken, left = table.agg(F.sum(F.when(~free, F.col("cap"))), F.sum(F.when(free, F.col("weight")))).first()
        if not left:
            break
        higher = (total - (taken or 0.0)) / left
        if higher <= level * (1 + 1e-15):
            break
        level = higher
    return table.withColumn("target", F.least(F.col("weight") * F.lit(level), F.col("cap")))


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Settles all but at most two texts, keeping the sums of p and of p * size."""
    p = p.copy()
    draws = iter(rng.random(len(p) + 3).tolist())
    held: list[int] = []
    for i in np.flatnonzero((p > _EPS) & (p < 1 - _EPS)).tolist():
        held.append(i)
        if len(held) < 3:
            continue
        a, b, c = (float(size[k]) for k in held)
        u = (c - b, a - c, b - a)
        if not any(u):
            u = (1.0, -1.0, 0.0)
        _move(p, held, u, next(draws))
        held = [k for k in held if _EPS < p[k] < 1 - _EPS]
    return _rounded(p)


def land(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Settles the last two texts: words first, then by chance."""
    p = p.copy()
    held = np.flatnonzero((p > _EPS) & (p < 1 - _EPS)).tolist()
    if len(held) == 2:
        a, b = (float(size[k]) for k in held)
        _move(p, held, (b, -a) if a or b else (1.0, -1.0), rng.random())
    for k in held:
        if _EPS < p[k] < 1 - _EPS:
            p[k] = float(rng.random() < p[k])
    return _rounded(p)


def _move(p: np.ndarray, at: list[int], u: tuple[float, ...], draw: float) -> None:
    up = min((1 - p[k]) / x if x > 0 else p[k] / -x for k, x in zip(at, u, strict=True) if x)
    down = min(p[k] / x if x > 0 else (1 - p[k]) / -x for k, x in zip(at, u, strict=True) if x)
    step = up if draw * (up + down) < down else -down
    for k, x in zip(at, u, strict=True):
        p[k] += step * x


def _rounded(p: np.ndarray) -> np.ndarray:
    return np.where(p <= _EPS, 0.0, np.where(p >= 1 - _EPS, 1.0, p))


def _settler(level: int, seed: int):
    def settle(table: pa.Table) -> pa.Table:
        order = np.array(table.select(["key", "size"]).append_column("i", pa.array(np.arange(len(table)))).sort_by([("key", "ascending"), ("size", "ascending"), ("i", "ascending")])["i"])
        p, size = table["p"].to_numpy()[order], table["size"].to_numpy()[order]
        rank, block = table["rank"][0].as_py(), table["block"][0].as_py()
        rng = np.random.default_rng([seed, rank, level, block])
        p = flight(p, size, rng)
        if table["blocks"][0].as_py() == 1:
            p = land(p, size, rng)
        out = np.empty_like(p)
        out[order] = p
        return table.set_column(table.schema.get_field_index("p"), "p", pa.array(out))

    return settle


_ROW = "key long, rank int, size long, base long, p double, block long, blocks long, unit {unit}"


def balanced_counts(units: DataFrame, stats: DataFrame, block: int = BLOCK, fan_in: int = FAN_IN, seed: int = 20) -> DataFrame:
    """`units` (unit, source, size, key) as rows (unit, rank, size, copies).

    `stats` is the table of targets. `unit` is any value; it comes back as it is.
    """
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    known = stats.select(F.col("source").alias("__source"), "rank", ratio.alias("ratio"), F.ceil(F.col("n") / block).alias("blocks"))
    base = F.floor(F.col("ratio") + _EPS)
    rows = units.join(known, units["source"].eqNullSafe(known["__source"])).select(
        "key", "rank", "size", base.alias("base"), F.greatest(F.col("ratio") - base, F.lit(0.0)).alias("p"), F.pmod("key", "blocks").alias("block"), "blocks", "unit"
    )
    schema = _ROW.format(unit=units.schema["unit"].dataType.simpleString())
    level, done = 0, []
    while True:
        settled = written(rows.groupBy("rank", "block").applyInArrow(_settler(level, seed), schema), "mix")
        done.append(settled.where("p = 0 OR p = 1"))
        rows = settled.where("p > 0 AND p < 1")
        if not rows.limit(1).count():
            break
        level += 1
        rows = rows.withColumn("block", F.floor(F.col("block") / fan_in)).withColumn("blocks", F.ceil(F.col("blocks") / fan_in))
    out = done[0]
    for part in done[1:]:
        out = out.unionAll(part)
    return out.select("unit", "rank", "size", (F.col("base") + F.col("p").cast("long")).alias("copies"))


def _told_apart(units: DataFrame) -> DataFrame:
    """`units` with `place`, a hash that differs between equal rows, too: they are counted, numbered in pieces and spread."""
    most = units.groupBy("key", "key2").count().agg(F.max("count")).first()[0] or 0
    if most <= 1:
        return units.withColumn("place", F.col("key"))
    counted = units.groupBy(*units.columns).agg(F.count(F.lit(1)).alias("times"))
    pieces = counted.withColumn("low", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1, F.lit(PIECE).cast("long")))).repartition("key", "low")
    turns = pieces.withColumn("turn", F.explode(F.sequence("low", F.least(F.col("low") + PIECE, F.col("times")) - 1)))
    return turns.withColumn("place", F.when(F.col("turn") == 0, F.col("key")).otherwise(F.xxhash64("key", "turn")))


def word_count(text: str):
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, most: float = 3.0, block: int = BLOCK, fan_in: int = FAN_IN, seed: int = 20) -> DataFrame:
    """One row per text: id, digest and digest2 (of id and text), size, source_size, target and copies."""
    text = F.col(text_col).cast("string")
    key, key2 = row_keys(id_col, text)
    units = written(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"), key.alias("key"), key2.alias("key2")), "units")
    stats = written(targets(units.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), weights, most), "targets")
    counts = balanced_counts(_told_apart(units).select(F.struct("id", "key", "key2").alias("unit"), "source", "size", F.col("place").alias("key")), stats, block, fan_in, seed)
    shown = stats.select("rank", "source", "source_size", "target")
    return counts.join(shown, "rank").select(F.col("unit.id").alias(id_col), F.col("unit.key").alias("digest"), F.col("unit.key2").alias("digest2"), "size", "source", "source_size", "target", "copies")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """`docs` as mixed: each row as often as it is taken."""
    counts = mix(docs, id_col, text_col, source_col)
    key, key2, copies, turn = unused(docs, "key", "key2", "copies", "turn")
    summed = counts.groupBy(F.col("digest").alias(key), F.col("digest2").alias(key2)).agg(F.sum("copies").alias(copies), (F.count(F.lit(1)) > 1).alias("repeated"))
    keep = written(summed.where(F.col(copies) > 0), "copies")
    rows = docs.withColumns(dict(zip((key, key2), row_keys(id_col, F.col(text_col).cast("string")), strict=True)))
    taken = exactly_once(rows, keep, [key, key2])
    return taken.withColumn(turn, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*docs.columns)


def op10_mix(spark, sf_dir: str) -> DataFrame:
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
