"""Which paths a job may touch: folder prefixes and exclude globs."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slimlake.functions import globs, paths
from slimlake.functions.columns import col


@dataclass(frozen=True)
class Scope:
    """Prefixes are OR-ed, none means everything; any exclude match wins."""

    prefixes: tuple[str, ...] = ()
    excludes: tuple[str, ...] = ()

    def __post_init__(self):
        clean = tuple(p.strip("/") for p in self.prefixes)
        object.__setattr__(self, "prefixes", tuple(p for p in clean if p))
        object.__setattr__(self, "excludes", tuple(self.excludes))
        for pattern in self.excludes:
            globs.to_regex(pattern)

    def contains(self, path="path") -> Column:
        """A prefix covers itself and what lies below it, by whole segments.

        Written as equality and ``startswith`` on the bare column so that both
        reach the scan; inventory paths are stored normalised.
        """
        if not self.prefixes:
            return F.lit(True)
        path = col(path)
        return reduce(
            lambda a, b: a | b,
            [(path == p) | path.startswith(p + "/") for p in self.prefixes],
        )

    def excluded(self, path="path") -> Column:
        if not self.excludes:
            return F.lit(False)
        path = col(path)
        return reduce(lambda a, b: a | b, [path.rlike(globs.to_regex(g)) for g in self.excludes])

    def allows(self, path="path") -> Column:
        return self.contains(path) & ~self.excluded(path)


EVERYTHING = Scope()


def scope_totals(df: DataFrame, prefixes: list[str]) -> DataFrame:
    """Files and bytes per listed folder; nested folders each count their rows."""
    labelled = F.array_compact(
        F.array(*[F.when(Scope((p,)).contains("path"), F.lit(p.strip("/"))) for p in prefixes])
    )
    hits = df.select("size", F.explode(labelled).alias("scope"))
    return hits.groupBy("scope").agg(
        F.count("*").alias("files"), F.sum("size").alias("bytes")
    )


def ancestors(path="path") -> Column:
    """The path itself and every folder above it."""
    parts = F.split(col(path), "/")
    lengths = F.sequence(F.lit(1), F.size(parts))
    return F.transform(lengths, lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def _above(path) -> Column:
    """The ancestors, and the empty one that is above all."""
    return F.array_distinct(F.concat(F.array(F.lit("")), ancestors(path)))


def matching_scopes(df: DataFrame, scopes: DataFrame, path: str = "path") -> DataFrame:
    """The rows of ``df`` beside each scope of ``scopes`` that covers them.

    A scope covers a path if it is one of the path's ancestors, so any number of scopes
    is one equality join, which Spark broadcasts while they are few. ``scopes`` has a
    column ``scope``; repeated ones and slashes around them count for nothing, and an
    empty one covers everything.
    """
    wanted = scopes.select(F.trim(F.col("scope"), F.lit("/")).alias("scope")).where("scope IS NOT NULL").distinct()
    return df.withColumn("scope", F.explode(_above(path))).join(wanted, "scope")


def totals_by_scope(df: DataFrame, scopes: DataFrame) -> DataFrame:
    """Files and bytes per scope of a table of scopes; nested ones each count their rows.

    Rows are first summed by the folder they lie in, which partial aggregation shrinks,
    and only these sums are repeated for the folders above. A scope that is itself a
    file's path counts that file. Scopes without rows are left out.
    """
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    sums = [F.count("*").alias("files"), F.sum("size").alias("bytes")]
    inside = matching_scopes(df.groupBy(folder.alias("path")).agg(*sums), scopes)
    own = df.groupBy("path").agg(*sums).withColumnRenamed("path", "scope")
    wanted = scopes.select(F.trim(F.col("scope"), F.lit("/")).alias("scope")).distinct()
    files = own.join(wanted, "scope", "left_semi")
    both = inside.select("scope", "files", "bytes").unionByName(files.select("scope", "files", "bytes"))
    return both.groupBy("scope").agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes"))


def within_scopes(df: DataFrame, scopes: DataFrame) -> DataFrame:
    """The rows of ``df`` that at least one scope covers, each once."""
    wanted = scopes.select(F.trim(F.col("scope"), F.lit("/")).alias("scope")).where("scope IS NOT NULL").distinct()
    paths_in = df.select("path").distinct().withColumn("scope", F.explode(_above("path"))).join(wanted, "scope", "left_semi")
    return df.join(paths_in.select("path").distinct(), "path", "left_semi")


def union_of_scopes(listings: list[DataFrame]) -> DataFrame:
    """One row per path over overlapping listings; the later listing wins."""
    numbered = [df.withColumn("_at", F.lit(i)) for i, df in enumerate(listings)]
    rows = reduce(lambda a, b: a.unionByName(b), numbered)
    data = [c for c in listings[0].columns if c != "path"]
    latest = rows.groupBy("path").agg(F.max_by(F.struct(*data), F.col("_at")).alias("_row"))
    return latest.select("path", *[F.col(f"_row.{c}").alias(c) for c in data])


def distinct_paths(df: DataFrame) -> DataFrame:
    return df.select(paths.normalize("path").alias("path")).distinct()
