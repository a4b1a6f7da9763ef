"""URL filters: allow and block rules for hosts and path prefixes, as a range join.

A rule ``(host, path)`` fits its host and every subdomain, if the url's path starts
with the rule's path; of the rules that fit, the longest decides.

Reversing a host's labels turns "this host or below" into "starts with", so with the
key ``com.example./path`` every rule is one interval of keys. A url is looked up once
for each level of its host on which rules exist (``com.``, ``com.example.``, ...).
Intervals of prefixes are nested or apart, so a sorted sweep over the rules' starts
and ends needs only a stack: the running sum of +1 and -1 is the stack's height, and
the entry at a height is the last rule that started there. The sweep leaves segments,
each with its innermost rule; a second sweep carries them over the sorted url keys.
Both sweeps run on range partitions and pass what is open from one to the next, so
neither a popular host nor a host with many rules gathers in one task.

Defined cases: a null url, or one without ``://``, has the host ``''`` and the path
``''``. A host that is empty in a rule fits every url. Equal rules count once, and
``block`` wins over ``allow`` among them. Where no rule fits, ``rule`` is null and the
verdict is ``default``. Every row of the input gives one row, repeated rows too; input
columns called like an output (host, path, rule, verdict) are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slimlake.llm.common import kept
from slimlake.operators.ordered import carry_last, running

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULE_TYPE = "struct<host:string,path:string,verdict:string>"
OUTPUTS = ("host", "path", "rule", "verdict")


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """Between ``://`` and the next ``/``, ``?`` or ``#``, with A-Z lower-cased."""
    host = F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ``?`` or ``#``."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _key(host_labels: Column, depth: Column, path: Column) -> Column:
    """Sort key of a path on the first ``depth`` reversed labels; hosts hold no ``/``."""
    labels = F.transform(F.slice(host_labels, 1, depth), lambda x: F.concat(x, F.lit(".")))
    return F.concat(F.array_join(labels, ""), F.lit("/"), path).cast("binary")


def _labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def segments(rules: DataFrame) -> DataFrame:
    """Where along the sorted keys the innermost rule changes, and to which rule."""
    depth = F.when(F.col("host") == "", 0).otherwise(F.size(_labels(F.col("host"))))
    keyed = rules.select(
        _key(_labels(F.col("host")), depth, F.col("path")).alias("at"),
        F.struct("host", "path", "verdict").alias("rule"),
    )
    # No UTF-8 text has a byte 0xFF, so it follows whatever starts with the key.
    ends = keyed.select(
        F.concat("at", F.unhex(F.lit("FF"))).alias("at"),
        F.lit(0).alias("kind"),
        F.lit(-1).cast("long").alias("step"),
        F.lit(None).cast(RULE_TYPE).alias("rule"),
    )
    starts = keyed.select("at", F.lit(1).alias("kind"), F.lit(1).cast("long").alias("step"), "rule")
    height = running(starts.unionByName(ends), ["at", "kind"], {"height": "step"})
    top = carry_last(height, ["at", "kind"], {"top": "rule"}, ["height"])
    return top.select(
        "at", "kind", F.struct(*[F.col(f"top.{c}").alias(c) for c in ("host", "path", "verdict")]).alias("found")
    )


def match_keys(keys: DataFrame, rules: DataFrame) -> DataFrame:
    """For distinct ``(host, path)``: the rule that decides, where there is one."""
    # As many numbers as rule hosts have levels.
    label_count = F.when(F.col("host") == "", 0).otherwise(F.size(F.split("host", r"\.")))
    depths = sorted(r[0] for r in rules.select(label_count.alias("d")).distinct().collect())
    if not depths:
        return keys.select("host", "path", F.lit(None).cast(RULE_TYPE).alias("best"))
    levels = F.filter(
        F.array(*[F.lit(d) for d in depths]), lambda d: d <= F.size(F.split("host", r"\."))
    )
    lookups = keys.withColumn("depth", F.explode(levels)).select(
        _key(_labels(F.col("host")), F.col("depth"), F.col("path")).alias("at"),
        F.lit(2).alias("kind"),
        "host",
        "path",
        F.lit(None).cast(RULE_TYPE).alias("found"),
    )
    borders = segments(rules).select("at", "kind", F.lit("").alias("host"), F.lit("").alias("path"), "found")
    swept = carry_last(borders.unionByName(lookups), ["at", "kind", "host", "path"], {"rule": "found"})
    # A later border may say "no rule here": its fields are null.
    fits = swept.where("kind = 2 AND rule.verdict IS NOT NULL")
    rank = F.struct(F.length("rule.host") + F.length("rule.path"), F.length("rule.host"))
    return fits.groupBy("host", "path").agg(F.max_by("rule", rank).alias("best"))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Add host, path, deciding rule and verdict to each row of ``pages``."""
    rules = (
        rules.select(
            F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER).alias("host"),
            F.coalesce("path", F.lit("")).alias("path"),
            "verdict",
        )
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))
    )
    others = [c for c in pages.columns if c not in OUTPUTS]
    parsed = pages.select(
        *[F.col(f"`{c}`") for c in others],
        host_of(F.col(f"`{url}`")).alias("host"),
        path_of(F.col(f"`{url}`")).alias("path"),
    )
    # Equal addresses are judged once, however many rows carry them. Written, so that
    # the join below sees two plain tables and may split a very frequent address.
    best = kept(match_keys(parsed.select("host", "path").distinct(), rules), "url-rules")
    best = best.select(
        F.col("host").alias("__host"), F.col("path").alias("__path"), F.col("best").alias("__best")
    )
    joined = parsed.join(best, (F.col("host") == F.col("__host")) & (F.col("path") == F.col("__path")), "left")
    return joined.select(
        *[F.col(f"`{c}`") for c in others],
        "host",
        "path",
        F.concat("__best.host", "__best.path").alias("rule"),
        F.coalesce("__best.verdict", F.lit(default)).alias("verdict"),
    )
