"""C: scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from slimlake.catalog.projections import with_output_path
from slimlake.catalog.registry import query
from slimlake.catalog.tables import Tables
from slimlake.functions import paths, sizes, text
from slimlake.operators import progress
from slimlake.operators.scope import Scope


@query("C1_normalize_path", "SELECT page_id, trim(path, '/') AS path FROM f_pages")
def normalize_path(t: Tables):
    return t.f_pages.select("page_id", paths.normalize("path").alias("path"))


@query(
    "C2_join_path",
    """SELECT page_id, CASE WHEN page_id % 4 = 0 THEN trim(path, '/') WHEN trim(path, '/') = '' THEN 'base/x'
 ELSE 'base/x/' || trim(path, '/') END AS path FROM f_pages""",
)
def join_path(t: Tables):
    prefix = F.when(F.col("page_id") % 4 == 0, "/").otherwise("/base/x/")
    return t.f_pages.select("page_id", paths.join(prefix, "path").alias("path"))




@query(
    "C4_extension_of",
    r"""SELECT path, regexp_extract(path, '[^/]\.([^./]*)$', 1) AS ext FROM f_docs UNION ALL
SELECT concat(doc_id, '/', CASE doc_id % 6 WHEN 0 THEN '.hidden' WHEN 1 THEN 'plain' WHEN 2 THEN '.d/x.tar.gz' WHEN 3 THEN '.h.PNG' WHEN 4 THEN 'end.' ELSE 'n.jpg' END),
 CASE doc_id % 6 WHEN 2 THEN 'gz' WHEN 3 THEN 'PNG' WHEN 5 THEN 'jpg' ELSE '' END FROM documents""",
)
def extension_of(t: Tables):
    kind = F.col("doc_id") % 6
    name = (
        F.when(kind == 0, ".hidden").when(kind == 1, "plain").when(kind == 2, ".d/x.tar.gz")
        .when(kind == 3, ".h.PNG").when(kind == 4, "end.").otherwise("n.jpg")
    )
    odd = t.documents.select(F.concat(F.col("doc_id").cast("string"), F.lit("/"), name).alias("path"))
    rows = t.f_docs.select("path").union(odd)
    return rows.select("path", paths.extension("path").alias("ext"))


@query(
    "C5_swap_extension",
    """SELECT path, output_path FROM o_out UNION ALL
SELECT concat(doc_id, '/', CASE doc_id % 4 WHEN 0 THEN '.hidden' WHEN 1 THEN 'plain' WHEN 2 THEN 'x.tar.gz' ELSE 'end.' END),
 concat(doc_id, '/', CASE doc_id % 4 WHEN 0 THEN '.hidden' WHEN 1 THEN 'plain' WHEN 2 THEN 'x.tar' ELSE 'end' END, '.jxl') FROM documents""",
)
def swap_extension(t: Tables):
    kind = F.col("doc_id") % 4
    name = F.when(kind == 0, ".hidden").when(kind == 1, "plain").when(kind == 2, "x.tar.gz").otherwise("end.")
    odd = t.documents.select(F.concat(F.col("doc_id").cast("string"), F.lit("/"), name).alias("path"))
    swapped = odd.select("path", paths.swap_extension("path", F.lit("jxl")).alias("output_path"))
    return with_output_path(t).select("path", "output_path").union(swapped)


@query(
    "C6_safe_relative",
    """SELECT page_id, CASE WHEN page_id % 5 = 1 THEN NULL ELSE nullif(trim(regexp_replace(path, '/+', '/', 'g'), '/'), '') END AS safe FROM f_pages""",
)
def safe_relative(t: Tables):
    raw = (
        F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("//./"), "path"))
        .when(F.col("page_id") % 5 == 1, F.concat(F.lit("a/../"), "path"))
        .otherwise(F.col("path"))
    )
    return t.f_pages.select("page_id", paths.safe_relative(raw, strict=False).alias("safe"))


@query("C7_short_name", "SELECT page_id, string_split(path, '/')[-1] AS name FROM f_pages")
def short_name(t: Tables):
    return t.f_pages.select("page_id", paths.short_name("path").alias("name"))


@query(
    "C9_parse_number",
    r"""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events""",
)
def parse_number(t: Tables):
    shown = F.get_json_object("props", "$.k")
    raw = F.when(F.col("event_id") % 5 == 0, F.concat(shown, F.lit("x"))).otherwise(shown)
    return t.events.select("event_id", text.parse_number(raw, "bigint").alias("k"))


@query(
    "C11_round_setting",
    """SELECT event_id, CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN NULL
 ELSE CAST(least(round_even((event_id % 300) / 4.0::DOUBLE, 0), 63) AS INTEGER) END AS crf FROM events""",
)
def round_setting(t: Tables):
    kind = F.col("event_id") % 6
    number = (F.col("event_id") % 300) / 4.0
    raw = (
        F.when(kind == 0, "none").when(kind == 1, "NaN").when(kind == 2, "Infinity")
        .when(kind == 3, F.concat(F.lit("-1"), number.cast("string"))).otherwise(number.cast("string"))
    )
    return t.events.select("event_id", text.round_setting(text.parse_number(raw)).alias("crf"))


# Every event prints one line; every fourth ends a block of its job.
_LINE = (
    "CASE event_id % 7 WHEN 0 THEN concat('out_time_us=',cast(event_id*1000 AS string)) WHEN 1 THEN 'out_time_us=N/A' "
    "WHEN 2 THEN concat(' speed = ',cast(event_id % 9 AS string),'.5x ') WHEN 3 THEN 'speed=N/A' "
    "WHEN 4 THEN concat('frame=',cast(event_id AS string)) WHEN 5 THEN 'noise without a value' ELSE 'progress=continue' END"
)


def progress_lines(t: Tables):
    return t.events.select(
        F.concat(F.lit("job-"), F.col("user_id").cast("string")).alias("job"),
        F.col("event_id").alias("seq"),
        F.expr(_LINE).alias("line"),
    )


BLOCKS_SQL = """SELECT job, seq, out_time_us, speed FROM (SELECT concat('job-', CAST(user_id AS VARCHAR)) AS job, event_id AS seq, event_id % 7 AS k,
 coalesce(last_value(CASE WHEN event_id % 7 = 0 THEN event_id*1000 END IGNORE NULLS) OVER w, 0) AS out_time_us,
 coalesce(last_value(CASE WHEN event_id % 7 = 2 THEN (event_id % 9)::DOUBLE + 0.5 END IGNORE NULLS) OVER w, 0.0::DOUBLE) AS speed
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)) WHERE k = 6"""


@query("C13_absorb_progress", BLOCKS_SQL)
def absorb_progress(t: Tables):
    return progress.progress_blocks(progress_lines(t))


@query(
    "C14_fraction_and_eta",
    """SELECT event_id, round(CASE WHEN total > 0 THEN least(greatest(done / 1e6 / total, 0), 1) END, 9) AS fraction,
 round(CASE WHEN total > 0 AND speed > 0 THEN greatest((total - done / 1e6) / speed, 0) END, 6) AS eta
FROM (SELECT event_id, duration_secs - 20.5 AS total, (event_id * 37000 % 400000000)::DOUBLE AS done, (event_id % 5)::DOUBLE / 2 AS speed FROM o_parsed)""",
)
def fraction_and_eta(t: Tables):
    from slimlake.catalog.shared import parsed

    rows = parsed(t).select(
        "event_id",
        (F.col("probe.duration_secs") - 20.5).alias("total"),
        (F.col("event_id") * 37_000 % 400_000_000).alias("done_us"),
        (F.col("event_id") % 5 / 2.0).alias("speed"),
    )
    return rows.select(
        "event_id",
        F.round(sizes.progress_fraction("done_us", "total"), 9).alias("fraction"),
        F.round(sizes.eta_secs("done_us", "speed", "total"), 6).alias("eta"),
    )


@query(
    "C15_bytes_to_mib",
    """SELECT path, CAST(ceil(size * 100 / 1048576) AS BIGINT) AS mib, CASE WHEN size > 4096 THEN 4294967295 ELSE 1 END AS saturated FROM f_docs""",
)
def bytes_to_mib(t: Tables):
    huge = F.when(F.col("size") > 4096, F.lit(2**60)).otherwise(F.lit(2**20))
    return t.f_docs.select(
        "path",
        sizes.bytes_to_mib(F.col("size") * 100).alias("mib"),
        sizes.bytes_to_mib(huge).alias("saturated"),
    )


@query(
    "C16_saturating_subtract",
    "SELECT path, greatest(size - output_size, 0) AS saved, greatest(output_size - size, 0) AS grown FROM f_lines",
)
def saturating_subtract(t: Tables):
    return t.f_lines.select(
        "path",
        sizes.saturating_sub("size", "output_size").alias("saved"),
        sizes.saturating_sub("output_size", "size").alias("grown"),
    )


@query(
    "C17_saving_fraction",
    """SELECT path, round(CASE WHEN o = 0 THEN 0 ELSE greatest(o - size, 0)::DOUBLE / o END, 9) AS clamped,
 round(CASE WHEN o = 0 THEN 0 ELSE 1 - size::DOUBLE / o END, 9) AS signed
FROM (SELECT path, size, CASE WHEN size % 5 = 0 THEN 0 ELSE output_size + size % 1000000 END AS o FROM f_lines)""",
)
def saving_fraction(t: Tables):
    before = F.when(F.col("size") % 5 == 0, 0).otherwise(F.col("output_size") + F.col("size") % 1_000_000)
    rows = t.f_lines.withColumn("before", before)
    return rows.select(
        "path",
        F.round(sizes.saving_fraction("before", "size"), 9).alias("clamped"),
        F.round(sizes.signed_saving_fraction("before", "size"), 9).alias("signed"),
    )


@query(
    "C21_secret_redaction",
    """SELECT event_id, concat('tool run --user u', CAST(user_id AS VARCHAR), CASE event_id % 4
 WHEN 0 THEN ' --rc-pass <redacted> --fast' WHEN 1 THEN ' --API-Key <redacted>' WHEN 2 THEN ' --token <redacted> -v' ELSE ' pass through' END) AS line FROM events""",
)
def secret_redaction(t: Tables):
    secret = F.md5(F.col("event_id").cast("string"))
    tail = (
        F.when(F.col("event_id") % 4 == 0, F.concat(F.lit(" --rc-pass "), secret, F.lit(" --fast")))
        .when(F.col("event_id") % 4 == 1, F.concat(F.lit(" --API-Key '"), secret, F.lit(" x'")))
        .when(F.col("event_id") % 4 == 2, F.concat(F.lit(" --token "), secret, F.lit(" -v")))
        .otherwise(F.lit(" pass through"))
    )
    line = F.concat(F.lit("tool run --user u"), F.col("user_id").cast("string"), tail)
    return t.events.select("event_id", text.redact(line).alias("line"))


@query("C22_raw_digests", "SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5 FROM documents")
def raw_digests(t: Tables):
    return t.documents.select("doc_id", F.sha2("text", 256).alias("sha256"), F.md5("text").alias("md5"))


@query(
    "C23_like_escaping",
    r"""SELECT page_id, starts_with(p, '50%_a\b/') AS by_prefix, starts_with(p, '50%_a\b/') AS by_like
FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN '50%_a\b/' || path WHEN 1 THEN '500xa\b/' || path ELSE path END AS p FROM f_pages)""",
)
def like_escaping(t: Tables):
    prefix = "50%_a\\b"
    kind = F.col("page_id") % 3
    path = (
        F.when(kind == 0, F.concat(F.lit(prefix + "/"), "path"))
        .when(kind == 1, F.concat(F.lit("500xa\\b/"), "path"))
        .otherwise(F.col("path"))
    )
    rows = t.f_pages.select("page_id", path.alias("p"))
    return rows.select(
        "page_id",
        Scope((prefix,)).contains("p").alias("by_prefix"),
        F.col("p").like(paths.like_literal(prefix) + "/%").alias("by_like"),
    )


@query("C24_state_validation", "SELECT path, state FROM f_lines")
def state_validation(t: Tables):
    return t.f_lines.select("path", text.valid_state("state").alias("state"))
