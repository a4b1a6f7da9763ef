"""The ledger as a Parquet table partitioned by top folder, rewritten folder by folder.

A rescan of one scope reads and writes the partitions that the scope can have rows in
and no others: the scan is pruned by a filter on the partition column, and Spark's
dynamic partition overwrite replaces only partitions that the job writes to. A partition
that loses all its rows has to be written too, so each partition that was read also
gets one row without a path, which readers pass over.

What is to be written is written beside the table first. The overwrite then reads no
partition that it replaces, and one that was cut short, which may have removed a
partition and not yet renamed the new one, is done again by the next use of the table.
There is one writer at a time, and a reader may meet some partitions new and some old;
``snapshots.SnapshotTable`` is for readers that must not.

A folder is the first ``depth`` segments of the folder that a path lies in, and ``/``
for paths without one. Large folders are written in several files, small ones in one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slimlake.functions.columns import col
from slimlake.operators import ledger as books
from slimlake.operators.scope import EVERYTHING, Scope
from slimlake.schemas import LEDGER, evolve

FOLDER = "folder"
TOP = "/"
#: Folders that a keyed update may name in the scan's filter; more are matched by a join.
NAMED = 1000


def folder_of(path="path", depth: int = 1) -> Column:
    parts = F.split(col(path), "/")
    inside = F.slice(parts, 1, F.least(F.size(parts) - 1, F.lit(depth)))
    return F.when(F.size(inside) > 0, F.array_join(inside, "/")).otherwise(TOP)


def folders_in(scope: Scope, depth: int = 1) -> Column:
    """Whether a folder may hold rows of the scope."""
    if not scope.prefixes:
        return F.lit(True)
    folder, tests = F.col(FOLDER), []
    for prefix in scope.prefixes:
        parts = prefix.split("/")
        # The prefix may itself be a file's path.
        tests.append(folder == ("/".join(parts[:-1][:depth]) or TOP))
        tests.append(folder == "/".join(parts[:depth]))
        if len(parts) < depth:
            tests.append(folder.startswith(prefix + "/"))
    return reduce(lambda a, b: a | b, tests)


class FolderLedger:
    def __init__(self, spark: SparkSession, root: str, depth: int = 1, schema: T.StructType = LEDGER):
        self.spark, self.root, self.depth = spark, root.rstrip("/"), depth
        self.schema = T.StructType([*schema.fields, T.StructField(FOLDER, T.StringType())])

    def _at(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, name: str = "") -> bool:
        path, fs = self._at(name)
        return fs.exists(path)

    def _stored(self) -> DataFrame:
        """All rows with their folder, those without a path among them."""
        self._finish()
        if not self._exists():
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.root)

    def read(self, scope: Scope = EVERYTHING) -> DataFrame:
        """The rows in scope, from the partitions that can have any."""
        rows = self._stored().where(folders_in(scope, self.depth) & F.col("path").isNotNull())
        return rows.where(scope.contains("path")).drop(FOLDER)

    def files(self) -> DataFrame:
        """The data files of each folder."""
        return self._stored().select(FOLDER, F.col("_metadata.file_path").alias("file")).distinct()

    def _finish(self) -> None:
        """Overwrite the partitions that stand ready beside the table."""
        if not self._exists("_next/_SUCCESS"):
            return
        ready = self.spark.read.schema(self.schema).parquet(f"{self.root}/_next")
        writer = ready.hint("rebalance", FOLDER).write.partitionBy(FOLDER).mode("overwrite")
        writer.option("partitionOverwriteMode", "dynamic").parquet(self.root)
        path, fs = self._at("_next")
        fs.delete(path, True)

    def _replace(self, rows: DataFrame, emptied: DataFrame | None = None) -> None:
        """Replace the folders of ``rows`` and those named in ``emptied``."""
        rows = rows.withColumn(FOLDER, folder_of("path", self.depth)).select(*self.schema.names)
        if emptied is not None:
            rows = rows.unionByName(emptied.select(FOLDER), allowMissingColumns=True)
        # Splits a folder with many rows and gathers those with few.
        spread = rows.hint("rebalance", FOLDER)
        spread.write.partitionBy(FOLDER).mode("overwrite").parquet(f"{self.root}/_next")
        self._finish()

    def write(self, ledger: DataFrame) -> None:
        """The whole ledger anew."""
        self._replace(evolve(ledger), self._stored().select(FOLDER).distinct())

    def reconcile(self, listing: DataFrame, scope: Scope = EVERYTHING, **options) -> None:
        """``operators.ledger.reconcile`` within the partitions of ``scope``."""
        stored = self._stored().where(folders_in(scope, self.depth))
        rows = stored.where(F.col("path").isNotNull()).drop(FOLDER)
        self._replace(books.reconcile(rows, listing, scope, **options), stored.select(FOLDER).distinct())

    def update(self, updates: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Apply ``change(ledger, updates)`` within the partitions that ``updates`` name.

        ``change`` keeps the path of every row, as the keyed updates of
        ``operators.ledger`` do.
        """
        asked = updates.select(folder_of("path", self.depth).alias(FOLDER)).distinct()
        stored = self._stored()
        names = [r[0] for r in asked.limit(NAMED + 1).collect()]
        if len(names) <= NAMED:
            stored = stored.where(F.col(FOLDER).isin(names))
        else:
            stored = stored.join(asked, FOLDER, "left_semi")
        rows = stored.where(F.col("path").isNotNull()).drop(FOLDER)
        self._replace(change(rows, updates))
