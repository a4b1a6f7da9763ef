"""Inventory sources: listing JSON, direct listings, batch lookups, quota."""

from __future__ import annotations

import hashlib
from datetime import UTC

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from slimlake.functions import paths, sizes
from slimlake.functions.columns import col
from slimlake.schemas import RAW_LISTING, RAW_QUOTA

HASH_NAME = "blake3"
#: Bytes of a content read at a time.
HASHED_AT_ONCE = 1 << 20


def _hash_named(hashes: Column, name: str) -> Column:
    """A digest from the hash map, whatever the case of its key."""
    matching = F.map_filter(hashes, lambda k, v: F.lower(k) == name)
    return F.try_element_at(F.map_values(matching), F.lit(1))


def from_raw(raw: DataFrame, scope: str = "") -> DataFrame:
    """Raw listing objects -> inventory rows under ``scope``, files only."""
    return raw.where(~F.coalesce(F.col("IsDir"), F.lit(False))).select(
        paths.join(F.lit(scope), "Path").alias("path"),
        sizes.clamp_size("Size").alias("size"),
        F.col("ModTime").alias("mod_time"),
        _hash_named(F.col("Hashes"), HASH_NAME).alias("blake3"),
    )


def read_listing_json(
    spark: SparkSession, path: str | list[str], scope: str = "", json_lines: bool = False
) -> DataFrame:
    """Read listing JSON; a truncated or malformed file is an error.

    One JSON array per file is how listing tools print, and such a file cannot be
    split. Large listings should be written as one object per line.
    """
    raw = (
        spark.read.schema(RAW_LISTING)
        .option("multiLine", not json_lines)
        .option("mode", "FAILFAST")
        .json(path)
    )
    return from_raw(raw, scope)


_ENTRY = r"(?s)\A\s*\[?\s*(\{.*\})?\s*(,|\])?\s*\z"


def read_listing_lines(spark: SparkSession, path: str | list[str], scope: str = "") -> DataFrame:
    """Read listings printed as one JSON array, an entry to a line, by their lines.

    Brackets and commas are taken off as expressions, so one file is read by as many
    tasks as it has splits. A line that is no entry, or a broken one, is an error. So is
    a file whose array does not close: the lines are read a second time for that, for
    each file's last bracket or comma alone.
    """
    lines = spark.read.text(path)
    whole = F.col("value").rlike(_ENTRY)
    entry = F.nullif(F.regexp_extract("value", _ENTRY, 1), F.lit(""))
    refused = F.raise_error(F.concat(F.lit("not an entry of a listing: "), F.left("value", F.lit(80))))
    text = F.when(whole, entry).otherwise(refused.cast("string"))
    ends = _array_ends(lines, entry)
    raw = lines.select(text.alias("entry"), ends.alias("_ends")).where("entry IS NOT NULL AND _ends")
    parsed = F.from_json("entry", RAW_LISTING, {"mode": "FAILFAST"}).alias("raw")
    return from_raw(raw.select(parsed).select("raw.*"), scope)


def _array_ends(lines: DataFrame, entry: Column) -> Column:
    """True, or an error if some file is not one array from its first line to its last."""
    opens, closes = (F.col("value").rlike(p) for p in (r"\A\s*\[", r"\]\s*\z"))
    goes_on = F.col("value").rlike(r",\s*\z")
    file = lines.select(
        F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"),
        F.col("_metadata.file_block_start").alias("block"), opens.alias("opens"), closes.alias("closes"),
        (entry.isNotNull() & ~goes_on & ~closes).alias("last"), F.trim("value").alias("value"),
    ).where("value <> ''")
    place = F.struct("block", "at")
    judged = file.groupBy("file").agg(
        F.count_if("opens").alias("opened"), F.count_if("closes").alias("closed"), F.count_if("last").alias("lasts"),
        F.min_by("opens", place).alias("first"), F.max_by("closes", place).alias("end"),
    )
    sound = F.expr("opened = 1 AND closed = 1 AND first AND end AND lasts <= 1")
    broken = F.raise_error(F.concat(F.lit("not one whole array: "), F.col("file"))).cast("boolean")
    checked = judged.agg(F.bool_and(F.when(sound, True).otherwise(broken)).alias("sound"))
    return F.coalesce(checked.scalar(), F.lit(True))


def list_files(spark: SparkSession, root: str, scope: str = "", with_hash: bool = False) -> DataFrame:
    """A recursive listing of ``root``; contents are read only when hashed.

    Spark's file source passes over empty files, so they are not listed, and a hashed
    object is one row, so it must be below 2 GiB.

    ``path`` is relative to ``root``, which must be absolute. Any store Spark can
    open will do.
    """
    target = f"{root.rstrip('/')}/{scope.strip('/')}".rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(target)
    # Listed paths carry a scheme, and the root may spell it with more slashes.
    base = "/" + root.split(":", 1)[-1].strip("/")
    plain = F.regexp_replace(F.col("path"), r"\A[a-zA-Z0-9+.-]+:/*(?=/)", "")
    below = F.substr(plain, F.lit(len(base) + 1))
    rows = files.select(
        paths.normalize(below).alias("path"),
        F.col("length").alias("size"),
        F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("mod_time"),
        "content",
    )
    return with_content_hash(rows, "content", enabled=with_hash).drop("content")


class _Folder(InputPartition):
    def __init__(self, path: str, below: bool):
        self.path, self.below = path, below


class _TreeReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"].rstrip("/") or "/"
        self.scope = options.get("scope", "").strip("/")
        self.depth = int(options.get("depth", "1"))
        self.hashed = options.get("hash", "false").lower() == "true"
        self.hidden = options.get("hidden", "false").lower() == "true"

    def _open(self):
        """The file system and the root's path in it, whatever the URI's scheme."""
        from pyarrow import fs

        if "://" in self.root or self.root.startswith("file:"):
            return fs.FileSystem.from_uri("file://" + self.root[5:] if self.root.startswith("file:/") else self.root)
        return fs.LocalFileSystem(), self.root

    def _entries(self, store, folder: str, below: bool):
        from pyarrow import fs

        for entry in store.get_file_info(fs.FileSelector(folder, recursive=below)):
            inside = entry.path[len(folder) :].strip("/").split("/")
            if self.hidden or not any(name[:1] in "._" for name in inside):
                yield entry

    def partitions(self):
        """One for what lies in each folder down to ``depth``, one for each tree below."""
        from pyarrow import fs

        store, root = self._open()
        start = f"{root.rstrip('/')}/{self.scope}".rstrip("/") or "/"
        if store.get_file_info(start).type == fs.FileType.NotFound:
            raise FileNotFoundError(f"nothing to list at {start}")
        level, found = [start], []
        for _ in range(self.depth):
            found += [_Folder(folder, below=False) for folder in level]
            level = [
                entry.path for folder in level for entry in self._entries(store, folder, below=False)
                if entry.type == fs.FileType.Directory
            ]
        return found + [_Folder(folder, below=True) for folder in level]

    def _digest(self, store, path: str) -> str:
        made = hashlib.sha256()
        with store.open_input_stream(path) as content:
            while piece := content.read(HASHED_AT_ONCE):
                made.update(piece)
        return made.hexdigest()

    def read(self, partition):
        from pyarrow import fs

        store, root = self._open()
        cut = len(root.rstrip("/")) + 1
        for entry in self._entries(store, partition.path, partition.below):
            if entry.type == fs.FileType.File:
                yield (
                    entry.path[cut:], int(entry.size), entry.mtime.astimezone(UTC).replace(tzinfo=None),
                    self._digest(store, entry.path) if self.hashed else None,
                )


class TreeSource(DataSource):
    """Every file below a folder, empty ones too, listed by the tasks.

    Options: ``path`` (the root), ``scope`` (a folder below it; paths stay relative to
    the root), ``depth`` (how far down the driver plans; each folder there and each tree
    below is a partition), ``hash`` (a SHA-256 of each content, read in pieces, so an
    object of any size will do) and ``hidden`` (names that begin with ``.`` or ``_``).
    """

    @classmethod
    def name(cls):
        return "tree"

    def schema(self):
        return "path string, size bigint, modified timestamp_ntz, blake3 string"

    def reader(self, schema):
        return _TreeReader(self.options)


def list_tree(
    spark: SparkSession, root: str, scope: str = "", with_hash: bool = False, depth: int = 1, hidden: bool = False
) -> DataFrame:
    """A recursive listing of ``root`` as inventory rows, by ``TreeSource``.

    Each folder down to ``depth`` and each tree below is listed by a task of its own;
    a store with few large top folders wants a larger depth. Stores that Arrow opens
    from a URI can be listed; ``list_files`` lists any that Spark opens.
    """
    spark.dataSource.register(TreeSource)
    reader = spark.read.format("tree").option("scope", scope).option("depth", depth)
    rows = reader.option("hash", with_hash).option("hidden", hidden).load(root)
    return rows.select(
        paths.normalize("path").alias("path"), "size",
        F.date_format("modified", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("mod_time"), "blake3",
    )


def with_content_hash(df: DataFrame, content: str, enabled: bool, name: str = "blake3") -> DataFrame:
    """Add a content digest only when asked; else the content is never read."""
    digest = F.sha2(F.col(content), 256) if enabled else F.lit(None).cast("string")
    return df.withColumn(name, digest)


def stat(wanted: DataFrame, listing: DataFrame) -> DataFrame:
    """Metadata of the wanted paths; null where the listing has no such path."""
    found = listing.select("path", "size", "mod_time", F.lit(True).alias("_found"))
    return (
        wanted.select("path")
        .join(found, "path", "left")
        .withColumn("present", F.coalesce("_found", F.lit(False)))
        .drop("_found")
    )


def hashsum(wanted: DataFrame, listing: DataFrame) -> DataFrame:
    """Digest of the wanted paths; null where none is recorded."""
    return wanted.select("path").join(listing.select("path", "blake3"), "path", "left")


def parse_quota(json_text) -> Column:
    """Quota figures, each of which may be absent."""
    return F.from_json(col(json_text), RAW_QUOTA, {"mode": "FAILFAST"})
