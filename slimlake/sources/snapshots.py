"""A table kept as immutable Parquet versions with a commit list.

A version is published by creating its commit file, named after its number, once its
data is complete: a job that dies part-way leaves the last version current. Creating
a file that exists fails, so of two writers with the same number one wins, and the
other raises ``WriteConflict`` (``update`` reads again and retries). The store must
refuse to create an existing file, as HDFS and local disks do. Data folders are never
shared. Every ``FOLD`` commits are folded into one file, so reading the list takes a
handful of files.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_COMMIT = T.StructType(
    [
        T.StructField("version", T.LongType()),
        T.StructField("data", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("tag", T.StringType()),
    ]
)


FOLD = 20


class NothingCommitted(LookupError):
    """The table has no version yet."""


class WriteConflict(RuntimeError):
    """Another writer has committed this version."""


@dataclass(frozen=True)
class Commit:
    version: int
    data: str
    action: str
    tag: str | None


class SnapshotTable:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    # -- commits -----------------------------------------------------------

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self, folder: str) -> list[int]:
        """The versions that a folder of the commit list has names for."""
        path, fs = self._path(folder)
        if not fs.exists(path):
            return []
        names = [str(status.getPath().getName()) for status in fs.listStatus(path)]
        return sorted(int(n.split(".")[0][2:]) for n in names if n.startswith("v="))

    def _folded(self) -> int:
        for number in reversed(self._numbers("folded")):
            done, fs = self._path(f"folded/v={number:08d}/_SUCCESS")
            if fs.exists(done):
                return number
        return 0

    def commits(self) -> DataFrame:
        folded = self._folded()
        paths = [f"{self.root}/commits/v={n:08d}.json" for n in self._numbers("commits") if n > folded]
        if folded:
            paths.append(f"{self.root}/folded/v={folded:08d}")
        if not paths:
            return self.spark.createDataFrame([], _COMMIT)
        # A writer that died while creating its file leaves an empty one.
        return self.spark.read.schema(_COMMIT).json(paths).where("version IS NOT NULL")

    def current(self) -> Commit | None:
        """The newest commit; one row reaches the driver."""
        newest = self.commits().orderBy(F.desc("version")).limit(1).collect()
        return Commit(**newest[0].asDict()) if newest else None

    def has_tag(self, tag: str) -> bool:
        return not self.commits().where(F.col("tag") == tag).isEmpty()

    def _next(self) -> int:
        return max(self._numbers("commits"), default=0) + 1

    @staticmethod
    def _place(version: int) -> str:
        return f"data/v={version:08d}-{uuid.uuid4().hex}"

    def _publish(self, version: int, data: str, action: str, tag: str | None) -> int:
        row = json.dumps({"version": version, "data": data, "action": action, "tag": tag})
        path, fs = self._path(f"commits/v={version:08d}.json")
        try:
            out = fs.create(path, False)
        except Py4JJavaError as error:
            if not fs.exists(path):
                raise
            raise WriteConflict(f"version {version} of {self.root} is taken") from error
        out.write(bytearray((row + "\n").encode()))
        out.close()
        if version % FOLD == 0:
            self.commits().coalesce(1).write.mode("overwrite").json(f"{self.root}/folded/v={version:08d}")
        return version

    # -- data --------------------------------------------------------------

    def read(self, version: int | None = None) -> DataFrame:
        if version is None:
            commit = self.current()
        else:
            found = self.commits().where(F.col("version") == version).limit(1).collect()
            commit = Commit(**found[0].asDict()) if found else None
        if commit is None:
            raise NothingCommitted(self.root)
        return self.spark.read.parquet(f"{self.root}/{commit.data}")

    def write(self, df: DataFrame, action: str = "write", tag: str | None = None, **options) -> int:
        """Write a new version and make it current.

        A ``tag`` that is already committed is not written again, so a replayed
        streaming batch has no second effect. A commit by another writer since then
        is a ``WriteConflict``.
        """
        if tag is not None and self.has_tag(tag):
            return self.current().version
        version = self._next()
        data = self._place(version)
        df.write.options(**options).parquet(f"{self.root}/{data}")
        return self._publish(version, data, action, tag)

    def update(
        self, change: Callable[[DataFrame | None], DataFrame], action: str = "update",
        tag: str | None = None, attempts: int = 10, **options,
    ) -> int:
        """Write ``change`` of the current version (None at first), again if it has moved on."""
        for left in reversed(range(attempts)):
            try:
                number = self._next()
                commit = self.current()
                old = None if commit is None else self.spark.read.parquet(f"{self.root}/{commit.data}")
                if tag is not None and self.has_tag(tag):
                    return commit.version
                data = self._place(number)
                change(old).write.options(**options).parquet(f"{self.root}/{data}")
                return self._publish(number, data, action, tag)
            except WriteConflict:
                if not left:
                    raise
        raise AssertionError("at least one attempt is needed")

    def staging_place(self) -> str:
        """Where the next version's data belongs, relative to the table."""
        return self._place(self._next())

    def publish(self, data: str, action: str, tag: str | None = None) -> int:
        """Make data written to its staging place current."""
        return self._publish(self._next(), data, action, tag)

    def restore(self, version: int) -> int:
        """Make an earlier version current again, as a new commit."""
        found = self.commits().where(F.col("version") == version).limit(1).collect()
        if not found:
            raise NothingCommitted(f"{self.root} version {version}")
        return self._publish(self._next(), found[0].data, f"restore of {version}", None)

    def drop_data(self, versions: list[int]) -> None:
        """Remove the data of old versions for good; the current one is refused."""
        keep = self.current().data
        rows = self.commits().where(F.col("version").isin(versions)).collect()
        if any(row.data == keep for row in rows):
            raise ValueError("the current version cannot be dropped")
        jvm = self.spark._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for row in rows:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{row.data}")
            path.getFileSystem(conf).delete(path, True)


_FOLDER = "kept_by_"


def keep_copy(df: DataFrame, archive: str, partition_by: list[str] | None = None) -> None:
    """Keep a copy under ``archive`` before anything is replaced.

    Folders are named after the values, but the columns themselves stay in the files:
    a folder name has no type, and an empty text or a null none at all.
    """
    names = {
        f"{_FOLDER}{c}": F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
        for c in partition_by or []
    }
    writer = df.withColumns(names).write.mode("errorifexists")
    if names:
        writer = writer.partitionBy(*names)
    writer.parquet(archive)


def read_copy(spark: SparkSession, archive: str) -> DataFrame:
    """A kept copy as it was."""
    stored = spark.read.parquet(archive)
    return stored.drop(*[c for c in stored.columns if c.startswith(_FOLDER)])


def save_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> None:
    """Save a catalog table bucketed on ``key``, so joins on it skip that shuffle."""
    df.write.bucketBy(buckets, key).sortBy(key).mode("overwrite").saveAsTable(name)
