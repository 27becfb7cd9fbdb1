"""Intermediate tables of the operators, and joins that keep rows once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.sources.staging import fresh_path, shared_folder, shuffle_partitions, written

__all__ = ["exactly_once", "fresh_path", "row_keys", "shared_folder", "shuffle_partitions", "unused", "written"]


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as the table's own columns make needed."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def row_keys(id_col: str, text: Column) -> list[Column]:
    """Two independent hashes that together tell rows apart by id and text."""
    return [F.xxhash64(F.col(id_col), text), F.xxhash64(F.lit(1), F.col(id_col), text)]


def exactly_once(rows: DataFrame, keep: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys are in `keep`, one for each key; `repeated` says where there are more."""
    keep = keep.hint("merge")  # what is kept grows with the corpus
    once = rows.join(keep.where(~F.col("repeated")).drop("repeated"), keys)
    if not keep.where("repeated").limit(1).count():
        return once
    return once.unionByName(rows.join(keep.where("repeated").drop("repeated"), keys).dropDuplicates(keys))
