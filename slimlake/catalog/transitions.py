"""U: ledger to ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from slimlake.catalog.registry import query
from slimlake.catalog.shared import as_of, pending_docs
from slimlake.catalog.tables import Tables, literal_view
from slimlake.operators import decide, ledger, reports
from slimlake.operators.decide import UNBOUNDED
from slimlake.operators.scope import Scope
from slimlake.plans import commands
from slimlake.schemas import evolve
from slimlake.session import scratch
from slimlake.sources.snapshots import SnapshotTable




@query(
    "U1_recover_claimed",
    "SELECT path, CASE WHEN state = 'claimed' THEN 'pending' ELSE state END AS state, skip_reason FROM f_lines",
)
def recover_claimed(t: Tables):
    return ledger.recover_claimed(t.f_lines).select("path", "state", "skip_reason")


@query(
    "U2_retry_failed",
    """SELECT path, CASE WHEN state = 'failed' THEN 'pending' ELSE state END AS state,
 CASE WHEN state = 'failed' THEN NULL ELSE skip_reason END AS skip_reason FROM f_lines""",
)
def retry_failed(t: Tables):
    return ledger.retry_failed(t.f_lines).select("path", "state", "skip_reason")


_OPENS = "state = 'skipped' AND skip_reason IN ('video_tier_disabled','too_large_for_budget','video_too_short','out_of_scope')"


@query(
    "U3_reopen_skipped",
    f"""SELECT path, CASE WHEN {_OPENS} THEN 'pending' ELSE state END AS state,
 CASE WHEN {_OPENS} THEN NULL ELSE skip_reason END AS skip_reason FROM f_ledger""",
)
def reopen_skipped(t: Tables):
    reasons = [*decide.reopened_by(allow_video=True, allow_av1=False), "out_of_scope"]
    return ledger.reopen_skipped(t.f_ledger, reasons).select("path", "state", "skip_reason")


@query(
    "U4_record_skip",
    """SELECT path, CASE WHEN state = 'pending' AND size < 4096 THEN 'skipped' ELSE state END AS state,
 CASE WHEN state = 'pending' AND size < 4096 THEN 'too_small' ELSE skip_reason END AS skip_reason FROM f_ledger""",
)
def record_skip(t: Tables):
    rows = t.f_ledger
    small = rows.where((F.col("state") == "pending") & (F.col("size") < 4096))
    skips = small.select("path", F.lit("too_small").alias("skip_reason"))
    return ledger.record_skip(rows, skips).select("path", "state", "skip_reason")


@query(
    "U5_record_conversion",
    """SELECT path, CASE WHEN c THEN 'done' ELSE state END AS state, CASE WHEN c THEN NULL ELSE skip_reason END AS skip_reason,
 CASE WHEN c THEN path || '.new' ELSE output_path END AS output_path, CASE WHEN c THEN size // 2 ELSE output_size END AS output_size,
 CASE WHEN c THEN 'flac' ELSE recipe END AS recipe, CASE WHEN c THEN 'byte-exact' ELSE fidelity END AS fidelity,
 CASE WHEN c THEN sha256(path) END AS blake3, CASE WHEN c THEN TIMESTAMP '1998-10-01' ELSE trashed_at END AS trashed_at,
 CAST(CASE WHEN c THEN 0 ELSE reclaimed END AS INTEGER) AS reclaimed
FROM (SELECT *, state IN ('claimed','failed') AND size % 2 = 0 AS c FROM f_lines)""",
)
def record_conversion(t: Tables):
    rows = t.stored("f_lines").withColumn("blake3", F.lit(None).cast("string"))
    results = rows.where(F.col("state").isin("claimed", "failed") & (F.col("size") % 2 == 0)).select(
        "path",
        F.concat("path", F.lit(".new")).alias("output_path"),
        F.floor(F.col("size") / 2).cast("long").alias("output_size"),
        F.lit("flac").alias("recipe"),
        F.lit("byte-exact").alias("fidelity"),
        F.sha2("path", 256).alias("blake3"),
    )
    out = ledger.record_conversion(rows, results, as_of())
    return out.select(
        "path", "state", "skip_reason", "output_path", "output_size", "recipe", "fidelity",
        "blake3", "trashed_at", "reclaimed",
    )


@query(
    "U6_mark_reclaimed",
    """SELECT path, CAST(CASE WHEN state = 'done' AND trashed_at IS NOT NULL THEN 1 ELSE reclaimed END AS INTEGER) AS reclaimed, 0::BIGINT AS still_held FROM f_lines""",
)
def mark_reclaimed(t: Tables):
    after = ledger.mark_reclaimed(t.f_lines)
    again = reports.pending_reclaim(after).select(F.col("bytes").alias("still_held"))
    return after.select("path", "reclaimed", again.scalar().alias("still_held"))


@query(
    "U7_record_outcomes",
    """SELECT path, CASE WHEN k = 1 THEN 'failed' WHEN k = 2 THEN 'pending' ELSE state END AS state,
 CASE WHEN k = 1 THEN 'worker lost after ' || seq WHEN k = 2 THEN NULL ELSE skip_reason END AS skip_reason
FROM (SELECT path, seq, seq % 3 AS k, state, 'old' AS skip_reason FROM (SELECT path, arg_max(state, seq) AS state, max(seq) AS seq FROM f_jobs GROUP BY path))""",
)
def record_outcomes(t: Tables):
    rows = ledger.latest_state(t.f_jobs).withColumn("skip_reason", F.lit("old"))
    kind = F.col("seq") % 3
    outcomes = rows.where(kind != 0).select(
        "path",
        F.concat(F.lit("worker lost after "), F.col("seq").cast("string")).alias("error"),
        (kind == 2).alias("interrupted"),
    )
    return ledger.record_outcomes(rows, outcomes).select("path", "state", "skip_reason")


_BUDGET, _BATCH = 12, 700
literal_view(
    "o_run",
    f"""WITH b AS (SELECT s.path, s.size, s.projected_saving, s.recipe, s.skip_reason, s.recipe IS NOT NULL OR s.skip_reason = 'needs_probe' AS goes,
  CAST(ceil(ceil(s.size*coalesce(r.peak, 1.65::DOUBLE))/1048576) AS BIGINT) AS need
 FROM (SELECT * FROM o_saving ORDER BY projected_saving DESC, size DESC, path LIMIT {_BATCH}) s LEFT JOIN o_recipe r ON r.recipe = s.recipe),
a AS (SELECT *, sum(CASE WHEN goes AND need <= {_BUDGET} THEN greatest(need, 1) ELSE 0 END)
  OVER (ORDER BY projected_saving DESC, size DESC, path ROWS UNBOUNDED PRECEDING) AS reserved FROM b)
SELECT path, size, coalesce(recipe, 'av1') AS recipe, CASE WHEN NOT goes OR need > {_BUDGET} THEN 'skipped' WHEN size % 5 IN (1, 2) THEN 'cancelled' WHEN size % 5 = 0 THEN 'failed'
  WHEN size % 5 = 3 OR size // 2 > size * 0.97::DOUBLE OR size = 0 THEN 'skipped' ELSE 'converted' END AS outcome,
 CASE WHEN NOT goes THEN skip_reason WHEN need > {_BUDGET} THEN 'too_large_for_budget' WHEN size % 5 = 0 THEN 'broken' WHEN size % 5 = 3 THEN 'no_gain' END AS reason
FROM a WHERE NOT goes OR need > {_BUDGET} OR reserved <= {_BUDGET}""",
)


def _whole_run(t: Tables):
    """A ledger of pending rows after one run, and the run's summary."""
    table = SnapshotTable(t.spark, scratch(t.spark, "ledger"))
    table.write(evolve(pending_docs(t)), "scan")
    kind, size = F.col("size") % 5, F.col("size")
    attempts = t.f_docs.where(kind != 2).select(
        "path", F.lit("av1").alias("recipe"), F.concat("path", F.lit(".new")).alias("output_path"),
        F.when(kind == 3, size - 1).otherwise(F.floor(size / 2).cast("long")).alias("output_size"),
        F.lit("byte-exact").alias("fidelity"), F.sha2("path", 256).alias("blake3"),
        F.when(kind == 0, "broken").alias("error"), (kind == 1).alias("interrupted"),
    )
    told = commands.run(table, attempts, UNBOUNDED, _BUDGET, _BATCH, as_of())
    return table, told


@query(
    "U5_whole_run",
    """SELECT d.path, CASE outcome WHEN 'converted' THEN 'done' WHEN 'skipped' THEN 'skipped' WHEN 'failed' THEN 'failed' ELSE 'pending' END AS state,
 r.reason AS skip_reason, CASE WHEN outcome = 'converted' THEN r.recipe END AS recipe, CASE WHEN outcome = 'converted' THEN d.size // 2 END AS output_size,
 CASE WHEN outcome = 'converted' THEN sha256(d.path) ELSE d.blake3 END AS blake3, outcome IS NOT DISTINCT FROM 'converted' AS trashed
FROM f_docs d LEFT JOIN o_run r ON r.path = d.path""",
)
def whole_run(t: Tables):
    after = _whole_run(t)[0].read()
    return after.select(
        "path", "state", "skip_reason", "recipe", "output_size", "blake3", F.col("trashed_at").isNotNull().alias("trashed")
    )


@query(
    "A10_whole_run",
    """SELECT count(*) FILTER (outcome = 'converted') AS converted, count(*) FILTER (outcome = 'skipped') AS skipped,
 count(*) FILTER (outcome = 'failed') AS failed, count(*) FILTER (outcome = 'cancelled') AS cancelled,
 CAST(coalesce(sum(size) FILTER (outcome = 'converted'), 0) AS BIGINT) AS input_bytes,
 CAST(coalesce(sum(size // 2) FILTER (outcome = 'converted'), 0) AS BIGINT) AS output_bytes,
 CAST(coalesce(sum(size - size // 2) FILTER (outcome = 'converted'), 0) AS BIGINT) AS saved_bytes FROM o_run""",
)
def whole_run_summary(t: Tables):
    return _whole_run(t)[1]


_OUT = "state = 'pending' AND regexp_full_match(path, '(.*/)?[^\\n]*\\.wav|src1/.*')"


@query(
    "U8_exclude_out_of_scope",
    f"""SELECT path, CASE WHEN {_OUT} THEN 'skipped' ELSE state END AS state,
 CASE WHEN {_OUT} THEN 'out_of_scope' ELSE skip_reason END AS skip_reason FROM f_ledger""",
)
def exclude_out_of_scope(t: Tables):
    scope = Scope(excludes=("**/*.wav", "src1/**"))
    return ledger.exclude_out_of_scope(t.f_ledger, scope).select("path", "state", "skip_reason")


@query(
    "U9_dry_run",
    """SELECT path, CASE WHEN state <> 'claimed' THEN state WHEN gain THEN 'pending' ELSE 'skipped' END AS state,
 CASE WHEN state <> 'claimed' THEN skip_reason WHEN gain THEN NULL ELSE 'no_gain' END AS skip_reason
FROM (SELECT *, size > 0 AND greatest(size - out, 0)::DOUBLE / size >= 0.03::DOUBLE AS gain FROM
 (SELECT *, CASE WHEN doc_id % 4 = 0 THEN size - 1 ELSE size * 3 // 4 END AS out FROM f_ledger))""",
)
def dry_run(t: Tables):
    rows = t.f_ledger
    out = F.when(F.col("doc_id") % 4 == 0, F.col("size") - 1).otherwise(F.floor(F.col("size") * 3 / 4).cast("long"))
    attempts = rows.where(F.col("state") == "claimed").select("path", "size", out.alias("output_size"))
    return commands.dry_run(rows, attempts).select("path", "state", "skip_reason")
