"""Intermediate tables in the folder that driver and executors share.

A written table cuts a long lineage, fixes values that depend on a row's place,
and lets adaptive execution see sizes and split skewed joins.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROWS_A_FILE = 100_000

_LOCAL: dict[str, str] = {}
_STAGED: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only on a single machine that has it unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="quern-")
    return _LOCAL[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, rows: int | None = None, compression: str | None = None, gather: bool = False) -> DataFrame:
    """The table, written and read back. `rows`, a bound of how many there are, keeps small tables in few files.

    Each file costs a task, several round trips to the file system and, on a local
    one, two processes for permissions; give no bound where a row is costly to make,
    but `gather`: as many tasks as before make the rows, and one more shuffle brings
    them into as many files as their bytes need. It is for narrow rows only.
    `compression` is Parquet's, where another than the session's is worth its time.
    """
    if gather:
        df = df.hint("rebalance")
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_A_FILE)))
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    _STAGED.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged(spark: SparkSession) -> list[str]:
    """The tables that this application has written so far, oldest first."""
    return list(_STAGED.get(spark.sparkContext.applicationId, []))


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Deletes staged tables. Results that still read them, and are not written yet, are lost."""
    own = _STAGED.get(spark.sparkContext.applicationId, [])
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        if path in own:
            own.remove(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
