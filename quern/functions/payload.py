"""Bytes of columns: floats as IEEE 754, and texts of floats, by Arrow functions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.arrow_udf(T.BinaryType())
def ieee754_bytes(values: pa.Array) -> pa.Array:
    """Big-endian binary64 of each double; null stays null."""
    mask = values.is_valid().to_pylist()
    raw = values.fill_null(0.0).to_numpy(zero_copy_only=False).astype(">f8").tobytes()
    return pa.array([raw[8 * i : 8 * i + 8] if ok else None for i, ok in enumerate(mask)], pa.binary())


@F.arrow_udf(T.DoubleType())
def ieee754_values(raw: pa.Array) -> pa.Array:
    """The inverse; bytes of another length than 8 are an error."""
    rows = raw.to_pylist()
    if any(x is not None and len(x) != 8 for x in rows):
        raise ValueError("a float is not eight bytes long")
    return pa.array([None if x is None else float(np.frombuffer(x, ">f8")[0]) for x in rows], pa.float64())


@F.arrow_udf(T.StringType())
def float_text(values: pa.Array) -> pa.Array:
    """The shortest text that reads back as the same double."""
    return pa.array([None if x is None else repr(x) for x in values.to_pylist()], pa.string())


@F.arrow_udf(T.StringType())
def case_folded(texts: pa.Array) -> pa.Array:
    """Full Unicode case folding, for names that differ in case alone."""
    return pa.array([None if x is None else x.casefold() for x in texts.to_pylist()], pa.string())
