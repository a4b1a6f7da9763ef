"""Rows that a stream appends, one folder per stream and batch, folded when read.

A batch is known by the stream that gave it (the query id lives in its checkpoint) and
its number. A replay replaces its own folder and nothing else; another stream, or the
same job on a new checkpoint, has folders of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def stream_id(batch: DataFrame) -> str:
    """Identity of the stream that a micro-batch belongs to."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")


class BatchLog:
    def __init__(self, spark: SparkSession, root: str, schema: T.StructType):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema

    def write(self, batch: DataFrame, batch_id: int) -> None:
        place = f"{self.root}/stream={stream_id(batch)}/batch={batch_id}"
        batch.select(*self.schema.names).write.mode("overwrite").parquet(place)

    def _streams(self):
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return fs, [s.getPath() for s in fs.listStatus(root)] if fs.exists(root) else []

    def read(self) -> DataFrame:
        """All rows, with the ``stream`` and ``batch`` they came in."""
        named = T.StructType(
            [*self.schema.fields, T.StructField("stream", T.StringType()), T.StructField("batch", T.LongType())]
        )
        if not self._streams()[1]:
            return self.spark.createDataFrame([], named)
        return self.spark.read.schema(named).parquet(self.root)
