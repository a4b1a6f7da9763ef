"""F: filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from slimlake.catalog.registry import query
from slimlake.catalog.shared import as_of, plan_limits
from slimlake.catalog.tables import Tables
from slimlake.functions import paths, sizes
from slimlake.operators import decide, ledger, scores
from slimlake.operators.scope import Scope


@query(
    "F1_scope_prefixes",
    """SELECT page_id, p = 'en' OR starts_with(p, 'en/') AS in_en, p = 'en/8' OR starts_with(p, 'en/8/') AS in_en8,
 (p = 'de' OR starts_with(p, 'de/') OR p = 'fr' OR starts_with(p, 'fr/')) AS in_two, true AS anywhere
FROM (SELECT page_id, trim(path, '/') AS p FROM f_pages)""",
)
def scope_prefixes(t: Tables):
    path = paths.normalize("path")
    return t.f_pages.select(
        "page_id",
        Scope(("/en/",)).contains(path).alias("in_en"),
        Scope(("en/8",)).contains(path).alias("in_en8"),
        Scope(("/de", "fr/")).contains(path).alias("in_two"),
        Scope().contains(path).alias("anywhere"),
    )


EXCLUDES = ("**/*.jpg", "src1/**", "*/de/doc-?.*", "**/doc-[0-4]5.*", "{src2,src3}/fr/**")
_EXCLUDED_SQL = (
    r"regexp_full_match(path, '(.*/)?[^\n]*\.jpg|src1/.*|.*/de/doc-.\..*|(.*/)?doc-[0-4]5\..*|(src2|src3)/fr/.*')"
)


@query("F2_glob_excludes", f"SELECT path FROM f_docs WHERE {_EXCLUDED_SQL}")
def glob_excludes(t: Tables):
    return t.f_docs.where(Scope(excludes=EXCLUDES).excluded("path")).select("path")


@query(
    "F3_allows",
    f"SELECT path FROM f_docs WHERE (path LIKE 'src2/%' OR path LIKE 'src4/%') AND NOT {_EXCLUDED_SQL}",
)
def allows(t: Tables):
    return t.f_docs.where(Scope(("src2", "src4"), EXCLUDES).allows("path")).select("path")


@query("F4_by_state", "SELECT path, size FROM f_lines WHERE state = 'skipped'")
def by_state(t: Tables):
    return t.f_lines.where(F.col("state") == "skipped").select("path", "size")


@query(
    "F5_size_gates",
    "SELECT path, CASE WHEN size < 4096 THEN 'too_small' ELSE 'too_large_for_budget' END AS skip_reason "
    "FROM f_docs WHERE size < 4096 OR size > 262144",
)
def size_gates(t: Tables):
    decided = decide.with_decision(t.f_docs, plan_limits())
    return decided.where(F.col("skip_reason").isin("too_small", "too_large_for_budget")).select("path", "skip_reason")


@query(
    "F6_kind_membership",
    """SELECT path, kind IN ('jpeg','png','gif','bmp','tiff','efficient_image','webp') AS image,
 kind IN ('mp4','mov','mkv','mpeg_ts','legacy_video') AS video FROM o_docs""",
)
def kind_membership(t: Tables):
    rows = t.f_docs.withColumn("kind", decide.kind_of("path"))
    return rows.select("path", decide.is_image("kind").alias("image"), decide.is_video("kind").alias("video"))


@query("F7_completed", "SELECT path, output_path FROM f_lines WHERE state = 'done' AND output_path IS NOT NULL")
def completed(t: Tables):
    return t.f_lines.where(ledger.is_completed()).select("path", "output_path")


@query(
    "F8_either_path_lookup",
    """WITH w AS (SELECT path AS wanted FROM f_lines WHERE size % 7 = 0 UNION
 SELECT output_path FROM f_lines WHERE output_path IS NOT NULL AND size % 11 = 0),
d AS (SELECT path, output_path FROM f_lines WHERE state = 'done' AND output_path IS NOT NULL)
SELECT wanted, path FROM d JOIN w ON path = wanted UNION SELECT wanted, path FROM d JOIN w ON output_path = wanted""",
)
def either_path_lookup(t: Tables):
    lines = t.stored("f_lines")
    by_path = lines.where(F.col("size") % 7 == 0).select("path")
    by_output = lines.where(F.col("output_path").isNotNull() & (F.col("size") % 11 == 0))
    wanted = by_path.union(by_output.select("output_path"))
    return ledger.completed_for(lines, wanted).select("wanted", "path")


@query(
    "F9_reclaimable",
    "SELECT path, size FROM f_lines WHERE state = 'done' AND trashed_at IS NOT NULL AND reclaimed = 0",
)
def reclaimable(t: Tables):
    return t.f_lines.where(ledger.is_reclaimable()).select("path", "size")


@query(
    "F10_newer_than_days",
    """SELECT path, trashed_at FROM f_lines WHERE state = 'done' AND reclaimed = 0
 AND trashed_at > TIMESTAMP '1998-10-01' - INTERVAL 30 DAY""",
)
def newer_than_days(t: Tables):
    young = ledger.is_reclaimable() & ledger.newer_than(30, as_of())
    return t.f_lines.where(young).select("path", "trashed_at")


@query(
    "F11_reason_in_list",
    "SELECT path, skip_reason FROM f_ledger WHERE state = 'skipped' AND skip_reason IN ('no_gain','unsupported')",
)
def reason_in_list(t: Tables):
    rows = t.f_ledger
    hit = rows.where(ledger.skipped_for(["no_gain", "unsupported"]))
    nothing = rows.where(ledger.skipped_for([]))
    return hit.union(nothing).select("path", "skip_reason")


@query(
    "F12_settings_reasons",
    """SELECT path, skip_reason FROM f_ledger WHERE state = 'skipped'
 AND skip_reason IN ('video_tier_disabled','too_large_for_budget','video_too_short')""",
)
def settings_reasons(t: Tables):
    return ledger.awaiting_settings(t.f_ledger, allow_video=True, allow_av1=False).select("path", "skip_reason")


@query(
    "F13_gain_gate",
    """SELECT path, CASE WHEN size = 0 THEN false
 ELSE greatest(size - output_size, 0)::DOUBLE / size::DOUBLE >= 0.03::DOUBLE END AS worthwhile FROM f_lines""",
)
def gain_gate(t: Tables):
    return t.f_lines.select("path", sizes.is_worthwhile("size", "output_size").alias("worthwhile"))


@query(
    "F14_quality_gate",
    """WITH r AS (SELECT item, score, row_number() OVER (PARTITION BY item ORDER BY score) AS rn,
 count(*) OVER (PARTITION BY item) AS n, avg(score) OVER (PARTITION BY item) AS m FROM f_scores)
SELECT item FROM r WHERE rn = greatest(ceil(0.01::DOUBLE * n), 1) AND m >= 97 AND score >= 95""",
)
def quality_gate(t: Tables):
    return scores.score_summary(t.f_scores, ["item"]).where(scores.passes()).select("item")


@query("F15_restorable", "SELECT path, recipe FROM f_lines WHERE state = 'done' AND fidelity = 'byte-exact'")
def restorable(t: Tables):
    return t.f_lines.where(ledger.is_completed() & ledger.is_restorable()).select("path", "recipe")
