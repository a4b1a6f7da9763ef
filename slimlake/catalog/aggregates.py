"""A: one-level aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from slimlake.catalog.joins import SCOPE, verified
from slimlake.catalog.registry import query
from slimlake.catalog.shared import as_of, plan_limits
from slimlake.catalog.tables import Tables, literal_view
from slimlake.functions import paths
from slimlake.operators import checks, decide, digests, duplicates, ledger, reports, scores
from slimlake.operators.scope import scope_totals, totals_by_scope
from slimlake.plans import commands


@query(
    "A1_counts_by_state",
    """SELECT count(*) FILTER (state = 'pending') AS pending, count(*) FILTER (state = 'claimed') AS claimed,
 count(*) FILTER (state = 'done') AS done, count(*) FILTER (state = 'skipped') AS skipped,
 count(*) FILTER (state = 'failed') AS failed, CAST(sum(size) AS BIGINT) AS total_bytes FROM f_lines""",
)
def counts_by_state(t: Tables):
    return reports.counts_by_state(t.f_lines)


@query(
    "A2_plan_projection",
    """SELECT CASE WHEN d.recipe IS NOT NULL THEN 'convert' ELSE 'skip' END AS outcome, coalesce(d.recipe, skip_reason) AS name,
 count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, CAST(sum(floor(size * ratio)) AS BIGINT) AS output_bytes
FROM o_plan d LEFT JOIN o_recipe r ON r.recipe = d.recipe GROUP BY ALL""",
)
def plan_projection(t: Tables):
    inventory = t.f_docs.withColumn("state", F.lit("pending"))
    return commands.plan(inventory, plan_limits())


@query(
    "A3_plan_totals",
    """SELECT files, input_bytes, output_bytes, input_bytes - output_bytes AS saving_bytes,
 round((input_bytes - output_bytes)::DOUBLE / input_bytes, 9) AS saving_fraction
FROM (SELECT count(*) AS files, CAST(sum(size) AS BIGINT) AS input_bytes, CAST(sum(floor(size * ratio)) AS BIGINT) AS output_bytes
 FROM o_plan JOIN o_recipe USING (recipe))""",
)
def plan_totals(t: Tables):
    totals = reports.projection_totals(decide.with_decision(t.f_docs, plan_limits()))
    return totals.withColumn("saving_fraction", F.round("saving_fraction", 9))


@query(
    "A4_deferred",
    "SELECT count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM o_plan WHERE skip_reason = 'needs_probe'",
)
def deferred(t: Tables):
    return reports.deferred(decide.with_decision(t.f_docs, plan_limits()))


@query(
    "A5_savings",
    """SELECT count(*) AS files, CAST(sum(size) AS BIGINT) AS original_bytes, CAST(sum(output_size) AS BIGINT) AS output_bytes,
 CAST(greatest(sum(size) - sum(output_size), 0) AS BIGINT) AS logical_bytes FROM f_lines WHERE state = 'done' AND output_size IS NOT NULL""",
)
def savings(t: Tables):
    return reports.savings(t.f_lines)


_HELD = "state = 'done' AND trashed_at IS NOT NULL AND reclaimed = 0"


@query("A6_pending_reclaim", f"SELECT count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM f_lines WHERE {_HELD}")
def pending_reclaim(t: Tables):
    return reports.pending_reclaim(t.f_lines)


@query(
    "A7_retention_readiness",
    f"""SELECT folder, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, count(*) FILTER (young) AS too_recent,
 count(*) FILTER (young) = 0 AS ready
FROM (SELECT *, split_part(path, '/', 1) AS folder, trashed_at > TIMESTAMP '1998-10-01' - INTERVAL 30 DAY AS young FROM f_lines WHERE {_HELD})
GROUP BY folder
UNION ALL SELECT 'all', count(*), CAST(sum(size) AS BIGINT), count(*) FILTER (young), count(*) FILTER (young) = 0
FROM (SELECT *, trashed_at > TIMESTAMP '1998-10-01' - INTERVAL 30 DAY AS young FROM f_lines WHERE {_HELD})""",
)
def retention_readiness(t: Tables):
    lines = t.f_lines.withColumn("folder", F.substring_index("path", "/", 1))
    each = reports.retention(lines, 30, as_of(), by=["folder"])
    whole = reports.retention(lines, 30, as_of()).withColumn("folder", F.lit("all"))
    return each.unionByName(whole)


literal_view(
    "o_groups",
    """SELECT blake3, size, count(*) AS copies, min(path) AS first_path, CAST(size * (count(*) - 1) AS BIGINT) AS recoverable
FROM f_docs WHERE size <> 0 AND blake3 IS NOT NULL GROUP BY blake3, size HAVING count(*) > 1""",
)


@query(
    "A8_duplicate_groups",
    "SELECT g.*, d.path FROM o_groups g JOIN f_docs d ON d.blake3 = g.blake3 AND d.size = g.size",
)
def duplicate_groups(t: Tables):
    return duplicates.members(t.f_docs)


@query(
    "A9_duplicate_totals",
    """SELECT count(*) AS groups, CAST(sum(copies - 1) AS BIGINT) AS redundant_files, CAST(sum(recoverable) AS BIGINT) AS recoverable,
 (SELECT count(*) FROM f_docs WHERE size <> 0 AND blake3 IS NULL) AS unhashed FROM o_groups""",
)
def duplicate_totals(t: Tables):
    return duplicates.totals(t.f_docs)


@query(
    "A10_run_summary",
    """SELECT count(*) FILTER (state = 'done') AS converted, count(*) FILTER (state = 'skipped') AS skipped,
 count(*) FILTER (state = 'failed') AS failed, count(*) FILTER (state = 'pending') AS cancelled,
 CAST(sum(size) FILTER (state = 'done') AS BIGINT) AS input_bytes, CAST(sum(output_size) FILTER (state = 'done') AS BIGINT) AS output_bytes,
 CAST(sum(size - output_size) FILTER (state = 'done') AS BIGINT) AS saved_bytes FROM f_lines WHERE state <> 'claimed'""",
)
def run_summary(t: Tables):
    outcome = F.when(F.col("state") == "done", "converted").when(F.col("state") == "pending", "cancelled")
    rows = t.f_lines.where(F.col("state") != "claimed").select(
        outcome.otherwise(F.col("state")).alias("outcome"),
        F.col("size").alias("input_bytes"),
        F.col("output_size").alias("output_bytes"),
    )
    return reports.run_summary(rows)


literal_view(
    "o_scores",
    """SELECT item, any_value(m) AS mean, round(any_value(lo), 9) AS min,
 round(max(score) FILTER (rn = greatest(ceil(0.01::DOUBLE * n), 1)), 9) AS low_percentile, any_value(n) AS frames
FROM (SELECT item, score, row_number() OVER w AS rn, count(*) OVER p AS n, (sum(CAST(round(score * 1000000) AS BIGINT)) OVER p)::BIGINT / (count(*) OVER p * 1000000) AS m, min(score) OVER p AS lo
 FROM f_scores WINDOW w AS (PARTITION BY item ORDER BY score), p AS (PARTITION BY item)) GROUP BY item""",
)


def rounded(df):
    return df.withColumns(
        {"min": F.round("min", 9), "low_percentile": F.round("low_percentile", 9)}
    )


@query("A11_score_aggregation", "SELECT * FROM o_scores")
def score_aggregation(t: Tables):
    return rounded(scores.score_summary(t.f_scores, ["item"]))


@query(
    "A12_settings_comparison",
    """WITH r AS (SELECT item, preset, count(*) AS frames, sum(CAST(round(score * 1000000) AS BIGINT))::BIGINT / (count(*) * 1000000) AS mean, min(score) AS lo,
  CAST(sum(floor(value*100)) AS BIGINT) AS i FROM f_scores GROUP BY item, preset),
p AS (SELECT item, preset, max(score) FILTER (rn = greatest(ceil(0.01::DOUBLE * n), 1)) AS low
 FROM (SELECT item, preset, score, row_number() OVER (PARTITION BY item, preset ORDER BY score) AS rn,
   count(*) OVER (PARTITION BY item, preset) AS n FROM f_scores) GROUP BY item, preset)
SELECT preset, item % 2 = 0 AS temporal_filtering, CAST(24 + item % 3 AS INTEGER) AS crf, count(*) AS samples,
 CAST(sum(i) AS BIGINT) AS input_bytes, CAST(sum(i * (7 + preset) // 12) AS BIGINT) AS output_bytes, round(avg(mean), 9) AS mean,
 round(min(low), 9) AS low_percentile, CAST(sum(frames) AS BIGINT) AS elapsed_secs, bool_and(item % 7 <> 0) AS metadata_kept,
 round(1.0 - sum(i * (7 + preset) // 12)::DOUBLE / sum(i)::DOUBLE, 9) AS saving_fraction, NOT bool_and(item % 7 <> 0) AS warn
FROM r JOIN p USING (item, preset) GROUP BY ALL""",
)
def settings_comparison(t: Tables):
    rows = t.f_scores
    summary = scores.score_summary(rows, ["item", "preset"])
    sizes = rows.groupBy("item", "preset").agg(
        F.sum(F.floor(F.col("value") * 100)).cast("long").alias("input_bytes")
    )
    item = F.col("item")
    runs = summary.join(sizes, ["item", "preset"]).select(
        "preset",
        (item % 2 == 0).alias("temporal_filtering"),
        (24 + item % 3).cast("int").alias("crf"),
        "input_bytes",
        F.floor(F.col("input_bytes") * (7 + F.col("preset")) / 12).cast("long").alias("output_bytes"),
        "mean",
        "low_percentile",
        F.col("frames").alias("elapsed_secs"),
        (item % 7 != 0).alias("metadata_kept"),
    )
    out = reports.settings_comparison(runs)
    return out.withColumns(
        {
            "mean": F.round("mean", 9),
            "low_percentile": F.round("low_percentile", 9),
            "saving_fraction": F.round("saving_fraction", 9),
        }
    )


@query(
    "A13_failure_histogram",
    "SELECT substr(skip_reason, 1, 80) AS error, count(*) AS files FROM f_lines WHERE state = 'failed' GROUP BY 1",
)
def failure_histogram(t: Tables):
    return reports.failure_histogram(t.f_lines)


@query(
    "A14_sync_counts",
    """SELECT (SELECT count(*) FROM f_listing) AS seen, (SELECT count(*) FROM f_ledger
 WHERE (path LIKE 'src1/%' OR path LIKE 'src2/%') AND state <> 'done' AND path NOT IN (SELECT path FROM f_listing)) AS removed""",
)
def sync_counts(t: Tables):
    return ledger.sync_counts(t.f_ledger, t.f_listing, SCOPE)


@query(
    "A15_verify_summary",
    """SELECT count(*) FILTER (problem IS NULL AND fidelity = 'byte-exact') AS proven,
 count(*) FILTER (problem IS NULL AND fidelity <> 'byte-exact') AS present, count(problem) AS failed FROM o_verify""",
)
def verify_summary(t: Tables):
    return checks.verify_summary(verified(t))


@query(
    "A16_scope_totals",
    """WITH p AS (SELECT trim(path, '/') AS path, size FROM f_pages)
SELECT s AS scope, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes
FROM (VALUES ('en'), ('fr'), ('de'), ('en/825'), ('fr/825')) v(s) JOIN p ON path = s OR starts_with(path, s || '/') GROUP BY s""",
)
def totals_of_scopes(t: Tables):
    rows = t.f_pages.select(paths.normalize("path").alias("path"), "size")
    return scope_totals(rows, ["/en/", "fr", "de", "en/825", "fr/825"])


@query(
    "A16_many_scopes",
    """WITH p AS (SELECT trim(path, '/') AS path, size FROM f_pages), s AS (
 SELECT split_part(path, '/', 1) AS scope FROM p UNION SELECT concat(split_part(path, '/', 1), '/', split_part(path, '/', 2)) FROM p
 UNION SELECT path FROM p WHERE size % 2 = 0)
SELECT scope, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM s JOIN p ON path = scope OR starts_with(path, scope || '/') GROUP BY scope""",
)
def totals_of_many_scopes(t: Tables):
    """Every folder of the first two levels and many single paths, in one join."""
    rows = t.f_pages.select(paths.normalize("path").alias("path"), "size")
    parts = F.split("path", "/")
    scopes = rows.select(parts[0].alias("scope"))
    scopes = scopes.union(rows.select(F.concat(parts[0], F.lit("/"), F.get(parts, 1), F.lit("/"))))
    return totals_by_scope(rows, scopes.union(rows.where("size % 2 = 0").select("path")))


@query(
    "A17_accounting",
    f"""SELECT CAST((SELECT greatest(sum(size) - sum(output_size), 0) FROM f_lines WHERE state = 'done') AS BIGINT) AS logical_bytes,
 count(*) AS pending_files, CAST(sum(size) AS BIGINT) AS pending_bytes,
 (SELECT max(event_id) * 1000 FROM events) AS remote_free FROM f_lines WHERE {_HELD}""",
)
def accounting(t: Tables):
    quota = t.events.agg((F.max("event_id") * 1000).alias("free"))
    return reports.accounting(t.f_lines, quota)


@query(
    "A18_reclaim_reconciliation",
    f"""WITH r AS (SELECT split_part(path, '/', 2) AS flag, CAST(sum(size) AS BIGINT) AS reclaimed FROM f_lines WHERE {_HELD} GROUP BY 1)
SELECT flag, reclaimed, CASE flag WHEN 'A' THEN reclaimed WHEN 'N' THEN reclaimed // 3 ELSE 0 END AS gained,
 reclaimed > 0 AND CASE flag WHEN 'A' THEN reclaimed WHEN 'N' THEN reclaimed // 3 ELSE 0 END * 2 < reclaimed AS short FROM r""",
)
def reclaim_reconciliation(t: Tables):
    held = t.f_lines.where(ledger.is_reclaimable())
    released = held.groupBy(F.split_part("path", F.lit("/"), F.lit(2)).alias("flag")).agg(
        F.sum("size").alias("reclaimed")
    )
    before = F.lit(10**12)
    after = (
        F.when(F.col("flag") == "A", before + F.col("reclaimed"))
        .when(F.col("flag") == "N", before + F.floor(F.col("reclaimed") / 3))
        .otherwise(before - 5)
    )
    gained, short = reports.reclaim_check("reclaimed", "before", "after")
    return released.withColumns({"before": before, "after": after.cast("long")}).select(
        "flag", "reclaimed", gained.alias("gained"), short.alias("short")
    )


@query(
    "A19_ordered_digest",
    """WITH items AS (
  SELECT conv_id, turn AS pos, sha256(text) AS h FROM conversations
  UNION ALL SELECT -1, event_id, sha256(event_id::VARCHAR) FROM events
), placed AS (
  SELECT conv_id, h, row_number() OVER (PARTITION BY conv_id ORDER BY pos) - 1 AS i FROM items
), one AS (
  SELECT conv_id, i // 4096 AS i, count(*) AS n, sha256(string_agg(h, chr(10) ORDER BY i)) AS h FROM placed GROUP BY conv_id, placed.i // 4096
), two AS (
  SELECT conv_id, i // 4096 AS i, sum(n) AS n, sha256(string_agg(h, chr(10) ORDER BY i)) AS h FROM one GROUP BY conv_id, one.i // 4096
)
SELECT conv_id, CAST(sum(n) AS BIGINT) AS frames, sha256(string_agg(h, chr(10) ORDER BY i)) AS digest FROM two GROUP BY conv_id""",
)
def ordered_digest(t: Tables):
    """Every conversation, and all events as one long sequence."""
    turns = t.conversations.select("conv_id", F.col("turn").cast("long"), F.sha2("text", 256).alias("h"))
    events = t.events.select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("event_id").alias("turn"),
        F.sha2(F.col("event_id").cast("string"), 256).alias("h"),
    )
    return digests.ordered_digest(turns.unionByName(events), ["conv_id"], ["turn"], "h")


@query(
    "A20_frame_count_check",
    """WITH a AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id),
b AS (SELECT conv_id, count(*) AS n FROM conversations WHERE NOT (conv_id % 4 = 1 AND turn = 0) AND conv_id % 9 <> 0 GROUP BY conv_id)
SELECT conv_id, a.n AS frames_before, b.n AS frames_after, coalesce(a.n = b.n, false) AS counts_match FROM a LEFT JOIN b USING (conv_id)""",
)
def frame_count_check(t: Tables):
    conv = F.col("conv_id")
    after = t.conversations.where(~((conv % 4 == 1) & (F.col("turn") == 0)) & (conv % 9 != 0))
    return digests.compare_frame_counts(t.conversations, after, ["conv_id"])


@query(
    "A21_file_byte_fold",
    "SELECT kind, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM o_docs GROUP BY kind",
)
def file_byte_fold(t: Tables):
    rows = t.f_docs.withColumn("kind", decide.kind_of("path"))
    return rows.groupBy("kind").agg(*reports.file_totals())
