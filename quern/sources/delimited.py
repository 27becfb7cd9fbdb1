"""CSV with exact semantics: every value a text, every row with its ordinal.

Spark's own reader skips blank lines, renames repeated headers and pads short
rows; here a blank line or a row of another width is an error, and '' is null.
A file is one unit of work, as quotes can span lines; many files spread.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.batches import sliced
from quern.functions.table_text import parse_csv


def csv_cells(files: DataFrame) -> DataFrame:
    """(path, ordinal, position, name, value) of all cells of CSV files (path, content)."""

    def cells(batches):
        for held in sliced((b["path"], b["content"]) for b in batches):
            for path, content in held:
                header, rows = parse_csv(content or b"")
                for lo in range(0, len(rows), 4096):
                    part = rows[lo : lo + 4096]
                    k = len(header)
                    yield pa.RecordBatch.from_pydict({
                        "path": [path] * (k * len(part)),
                        "ordinal": pa.array([lo + i for i in range(len(part)) for _ in range(k)], pa.int64()),
                        "position": pa.array([j for _ in part for j in range(k)], pa.int32()),
                        "name": pa.array(header * len(part), pa.string()),
                        "value": pa.array([v for r in part for v in r], pa.string()),
                    })

    return files.select("path", "content").mapInArrow(cells, "path string, ordinal long, position int, name string, value string")


def csv_table(files: DataFrame, columns: list[str]) -> DataFrame:
    """(path, ordinal, one column of texts per name); '' becomes null."""
    wide = csv_cells(files).groupBy("path", "ordinal").pivot("name", columns).agg(F.first("value"))
    return wide.select("path", "ordinal", *[F.when(F.col(f"`{c}`") != "", F.col(f"`{c}`")).alias(c) for c in columns])
