"""References of arriving texts, each chunk's bytes once.

Splitting and hashing need no state. First occurrence does: a chunk is new if no
earlier batch, and no earlier place of its own batch, had it. The ids that were
seen are a Parquet table beside the output, joined to each batch, so state is
neither in the driver nor in executors' memory and survives both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.operators import chunking


def ingest(stream: DataFrame, folder: str, checkpoint: str, chunk_size: int = chunking.DEFAULT_CHUNK) -> StreamingQuery:
    """Starts a query over files (path, content) that arrive: `folder`/refs gets (path, ordinal, chunk_id, raw_size, reused), `folder`/chunks each id and its bytes once.

    A batch that is run again writes the same folders again, so nothing is doubled.
    """

    def one_batch(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        refs = chunking.split_chunks(batch, chunk_size, keep_bytes=True)
        known = spark.read.schema("chunk_id string, batch long").option("recursiveFileLookup", "false").parquet(f"{folder}/chunks") if _exists(spark, f"{folder}/chunks") else spark.createDataFrame([], "chunk_id string, batch long")
        earlier = known.where(F.col("batch") < number).select("chunk_id")
        marked = chunking.mark_reuse(refs).join(earlier.withColumn("before", F.lit(True)), "chunk_id", "left").withColumn("reused", F.col("reused") | F.coalesce("before", F.lit(False)))
        marked = marked.persist()
        try:
            marked.select("path", "ordinal", "chunk_id", "raw_size", "reused").write.mode("overwrite").parquet(f"{folder}/refs/batch={number}")
            marked.where(~F.col("reused")).select("chunk_id", "raw_size", "raw").write.mode("overwrite").parquet(f"{folder}/chunks/batch={number}")
        finally:
            marked.unpersist()

    return stream.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
