"""J: matching the ledger with listings, updates and results."""

from __future__ import annotations

from pyspark.sql import functions as F

from slimlake.catalog.projections import with_output_path
from slimlake.catalog.registry import query
from slimlake.catalog.shared import parsed
from slimlake.catalog.tables import Tables, literal_view
from slimlake.operators import checks, digests, ledger
from slimlake.operators.scope import Scope
from slimlake.session import cut, scratch
from slimlake.sources.folders import FolderLedger
from slimlake.sources.media import with_probe

SCOPE = Scope(("src1", "src2"))
_IN_SCOPE = "(path LIKE 'src1/%' OR path LIKE 'src2/%')"

literal_view(
    "o_new",
    """SELECT n.*, CAST(CASE WHEN n.size < 4096 THEN 0 WHEN k.kind = 'jpeg' THEN n.size - floor(n.size*0.80::DOUBLE)
 WHEN k.kind IN ('png','gif','bmp','tiff') THEN n.size - floor(n.size*0.65::DOUBLE)
 WHEN k.kind IN ('wav','aiff') THEN n.size - floor(n.size*0.55::DOUBLE) WHEN k.kind = 'flac' THEN n.size - floor(n.size*0.94::DOUBLE)
 WHEN k.kind = 'webp' THEN n.size - floor(n.size*0.93::DOUBLE)
 WHEN k.kind IN ('m4a','mp4','mov','mkv','mpeg_ts','legacy_video') THEN n.size - floor(n.size*0.70::DOUBLE) ELSE 0 END AS BIGINT) AS saving
FROM f_listing n LEFT JOIN o_ext k ON k.ext = lower(regexp_extract(n.path, '[^/]\\.([^./]*)$', 1))""",
)
literal_view(
    "o_sync",
    f"""SELECT n.path, CASE WHEN f.path IS NOT NULL AND same_place AND NOT changed THEN f.size ELSE n.size END AS size,
 CASE WHEN f.path IS NOT NULL AND same_place AND NOT changed THEN f.mod_time ELSE n.mod_time END AS mod_time,
 CASE WHEN f.path IS NOT NULL AND same_place AND NOT changed THEN f.blake3 ELSE n.blake3 END AS blake3,
 CASE WHEN f.path IS NULL OR changed THEN 'pending' ELSE f.state END AS state,
 CASE WHEN f.path IS NULL OR changed THEN NULL ELSE f.skip_reason END AS skip_reason,
 CASE WHEN f.path IS NOT NULL AND same_place AND NOT changed THEN 0 ELSE n.saving END AS projected_saving
FROM (SELECT n.*, f.path AS fp, coalesce(f.state = 'done' AND f.output_path = f.path, false) AS same_place,
   coalesce(CASE WHEN f.state = 'done' AND f.output_path = f.path THEN f.output_size ELSE f.size END <> n.size, false) AS changed
  FROM o_new n LEFT JOIN f_ledger f ON f.path = n.path) n LEFT JOIN f_ledger f ON f.path = n.fp
UNION ALL SELECT path, size, mod_time, blake3, state, skip_reason, 0 FROM f_ledger l
WHERE NOT EXISTS (SELECT 1 FROM f_listing n WHERE n.path = l.path) AND NOT ({_IN_SCOPE} AND state <> 'done')""",
)
SYNC_COLUMNS = ["path", "size", "mod_time", "blake3", "state", "skip_reason", "projected_saving"]


@query("J1_sync_reconcile", "SELECT * FROM o_sync")
def sync_reconcile(t: Tables):
    """A tenth of the listing's paths come twice, once as they were before."""
    listing = t.f_listing
    older = listing.where(F.pmod(F.xxhash64("path"), F.lit(10)) == 0).withColumns(
        {"mod_time": F.lit(None).cast(listing.schema["mod_time"].dataType), "size": F.col("size") + 1}
    )
    return ledger.reconcile(t.f_ledger, listing.unionByName(older), SCOPE).select(*SYNC_COLUMNS)


def _by_folder(t: Tables) -> FolderLedger:
    table = FolderLedger(t.spark, scratch(t.spark, "folders"))
    table.write(t.f_ledger.drop("doc_id"))
    return table


@query("J1_folder_reconcile", "SELECT * FROM o_sync")
def folder_reconcile(t: Tables):
    """The ledger by folder: the scope's two partitions are read and written."""
    table = _by_folder(t)
    table.reconcile(t.f_listing, SCOPE)
    return table.read().select(*SYNC_COLUMNS)


@query(
    "J1_folders_rewritten",
    """SELECT split_part(path, '/', 1) AS folder, split_part(path, '/', 1) IN ('src1', 'src2') AS rewritten
FROM (SELECT path FROM f_ledger UNION ALL SELECT path FROM f_listing) GROUP BY 1""",
)
def folders_rewritten(t: Tables):
    """Per folder, whether a rescan of the scope has left any of its files."""
    table = _by_folder(t)
    before = cut(table.files())
    table.reconcile(t.f_listing, SCOPE)
    both = table.files().join(before.withColumn("was", F.lit(True)), ["folder", "file"], "left")
    return both.groupBy("folder").agg(F.max("was").isNull().alias("rewritten"))


@query(
    "J2_stale_sweep",
    f"SELECT path, state FROM f_ledger WHERE {_IN_SCOPE} AND state <> 'done' AND path NOT IN (SELECT path FROM f_listing)",
)
def stale_sweep(t: Tables):
    return ledger.stale_rows(t.f_ledger, t.f_listing, SCOPE).select("path", "state")


_HASHED_LINES = "SELECT *, sha256(path) AS blake3 FROM f_lines WHERE state = 'done'"
literal_view(
    "o_verify",
    """SELECT path, output_path, fidelity, CASE WHEN size % 13 = 0 THEN 'missing' WHEN size % 11 = 0 THEN 'size_differs'
 WHEN fidelity <> 'byte-exact' THEN NULL WHEN size % 17 = 0 THEN 'not_rebuilt' WHEN size % 7 = 0 THEN 'hash_differs'
 WHEN size % 5 = 0 THEN 'rebuilt_size_differs' END AS problem FROM f_lines WHERE state = 'done'""",
)


def verified(t: Tables):
    lines = t.stored("f_lines").withColumn("blake3", F.sha2("path", 256))
    size = F.col("size")
    listing = lines.where((F.col("state") == "done") & (size % 13 != 0)).select(
        F.col("output_path").alias("path"),
        F.when(size % 11 == 0, F.col("output_size") + 1).otherwise(F.col("output_size")).alias("size"),
    )
    rebuilt = lines.where(ledger.is_restorable() & (size % 17 != 0)).select(
        "path",
        F.when(size % 7 == 0, "damaged").otherwise(F.col("blake3")).alias("rebuilt_hash"),
        F.when(size % 5 == 0, size - 1).otherwise(size).alias("rebuilt_size"),
    )
    return checks.verify_completed(lines, listing, rebuilt)


@query(
    "J3_verify",
    """SELECT path, output_path, fidelity, problem, CASE WHEN problem IS NOT NULL THEN 'failed'
 WHEN fidelity = 'byte-exact' THEN 'rebuilt' ELSE 'present' END AS status FROM o_verify""",
)
def verify(t: Tables):
    return verified(t)


@query(
    "J4_destination_exists",
    """WITH taken AS (SELECT path FROM f_docs UNION SELECT output_path FROM o_out WHERE size % 5 = 0)
SELECT path, output_path, path <> output_path AND output_path IN (SELECT path FROM taken) AS conflict FROM o_out""",
)
def destination_exists(t: Tables):
    planned = cut(with_output_path(t).select("path", "size", "output_path"))
    extra = planned.where(F.col("size") % 5 == 0).select(F.col("output_path").alias("path"))
    listing = t.f_docs.select("path").union(extra)
    return checks.destination_conflicts(planned, listing).select("path", "output_path", "conflict")


@query(
    "J5_confirm_write",
    """SELECT path, CASE WHEN size % 9 = 1 THEN 'missing' WHEN size % 9 = 2 THEN 'size_mismatch'
 WHEN size % 9 = 4 THEN 'ok_size_only' WHEN size % 9 = 3 THEN 'hash_mismatch' ELSE 'ok' END AS outcome FROM f_docs""",
)
def confirm_write(t: Tables):
    kind = F.col("size") % 9
    meant = t.f_docs.select("path", "size", F.sha2("path", 256).alias("hash"))
    found = meant.where(kind != 1).select(
        "path",
        F.when(kind == 2, F.col("size") + 1).otherwise(F.col("size")).alias("size"),
        F.when(kind == 4, None).when(kind == 3, F.lit("00")).when(kind == 5, F.upper("hash"))
        .otherwise(F.col("hash")).alias("hash"),
    )
    return checks.confirm_written(meant, found)


@query(
    "J6_keyed_update",
    """SELECT path, CASE WHEN size % 9 = 0 THEN 'skipped' ELSE state END AS state,
 CASE WHEN size % 9 = 0 THEN 'no_gain' ELSE skip_reason END AS skip_reason,
 CAST(CASE WHEN size % 6 = 0 THEN size % 64 END AS INTEGER) AS crf_hint FROM f_lines""",
)
def keyed_update(t: Tables):
    lines = t.stored("f_lines").withColumn("crf_hint", F.lit(None).cast("int")).withColumn(
        "crf_hint_preset", F.lit(None).cast("int")
    )
    states = lines.where(F.col("size") % 9 == 0).select(
        "path", F.lit("skipped").alias("state"), F.lit("no_gain").alias("skip_reason")
    )
    states = states.unionByName(states.where(F.length("path") % 2 == 0))  # some updates come twice
    known = lines.where(F.col("size") % 6 == 0)
    gone = lines.where(F.col("size") % 5 == 0).withColumn("path", F.concat("path", F.lit(".gone")))
    hints = known.unionByName(gone).select(
        "path", (F.col("size") % 64).cast("int").alias("crf_hint"), F.lit(3).alias("crf_hint_preset")
    )
    done = ledger.record_hints(ledger.set_state(lines, states), hints)
    return done.select("path", "state", "skip_reason", "crf_hint")


@query(
    "J6_folder_update",
    """SELECT path, CASE WHEN size % 9 = 0 AND path LIKE 'src1/%' THEN 'failed' ELSE state END AS state,
 CASE WHEN size % 9 = 0 AND path LIKE 'src1/%' THEN 'late' ELSE skip_reason END AS skip_reason FROM f_ledger""",
)
def folder_update(t: Tables):
    """Keyed updates that name one folder of a ledger by folder."""
    table = _by_folder(t)
    named = t.f_ledger.where((F.col("size") % 9 == 0) & F.col("path").startswith("src1/"))
    updates = named.select("path", F.lit("failed").alias("state"), F.lit("late").alias("skip_reason"))
    table.update(updates, ledger.set_state)
    return table.read().select("path", "state", "skip_reason")


@query(
    "J7_resume_match",
    """SELECT d.path, n.path IS NOT NULL AS reusable FROM f_docs d LEFT JOIN
 (SELECT path, CASE WHEN size % 5 = 0 THEN size + 1 ELSE size END AS size, CASE WHEN size % 3 = 0 THEN NULL ELSE mod_time END AS mod_time
  FROM f_docs WHERE size % 7 <> 0) n ON n.path = d.path AND n.size = d.size
  AND n.mod_time IS NOT DISTINCT FROM (CASE WHEN d.size % 2 = 0 AND d.size % 3 = 0 THEN NULL ELSE d.mod_time END)""",
)
def resume_match(t: Tables):
    size, time = F.col("size"), F.col("mod_time")
    salvaged = t.f_docs.select(
        "path", "size", F.when((size % 2 == 0) & (size % 3 == 0), None).otherwise(time).alias("mod_time")
    )
    claimed = t.f_docs.where(size % 7 != 0).select(
        "path",
        F.when(size % 5 == 0, size + 1).otherwise(size).alias("size"),
        F.when(size % 3 == 0, None).otherwise(time).alias("mod_time"),
    )
    return checks.match_salvaged(claimed, salvaged).select("path", "reusable")


@query(
    "J8_two_source_parity",
    """SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'only_left' WHEN a.path IS NULL THEN 'only_right'
 WHEN a.size <> b.size THEN 'size_differs' WHEN a.blake3 IS DISTINCT FROM b.blake3 THEN 'blake3_differs' END AS difference
FROM f_docs a FULL JOIN f_listing b ON a.path = b.path
WHERE a.path IS NULL OR b.path IS NULL OR a.size <> b.size OR a.blake3 IS DISTINCT FROM b.blake3""",
)
def two_source_parity(t: Tables):
    # The second listing is taken later; the clock column is left out of the comparison.
    same_clock = F.lit("2024-01-01T00:00:00Z")
    return checks.parity(
        t.f_docs.withColumn("mod_time", same_clock), t.f_listing.withColumn("mod_time", same_clock)
    )


@query(
    "J9_tuned_setting_cache",
    """SELECT f.path, f.preset, l.crf_hint FROM (SELECT path, CASE size % 3 WHEN 0 THEN 3 WHEN 1 THEN 4 ELSE 6 END AS preset FROM f_docs) f
LEFT JOIN f_ledger l ON l.path = f.path AND l.crf_hint_preset = f.preset""",
)
def tuned_setting_cache(t: Tables):
    preset = F.when(F.col("size") % 3 == 0, 3).when(F.col("size") % 3 == 1, 4).otherwise(6)
    return ledger.tuned_settings(t.f_docs.select("path", preset.alias("preset")), t.f_ledger)


@query(
    "J10_shape_survived",
    """SELECT event_id, coalesce(n_video > 0 AND NOT (event_id % 5 = 0 AND width = 1920) AND NOT (event_id % 5 <> 0 AND event_id % 7 = 1 AND list_contains(audio, 'aac')), false) AS metadata_kept FROM o_parsed""",
)
def shape_survived(t: Tables):
    changed = F.when(F.col("event_id") % 5 == 0, F.replace("probe", F.lit("1920"), F.lit("1280"))).when(
        F.col("event_id") % 7 == 1, F.replace("probe", F.lit('"aac"'), F.lit('"opus"'))
    ).otherwise(F.col("probe"))
    after = with_probe(t.f_probe.withColumn("probe", changed))
    return checks.shape_survived(parsed(t), after, "event_id")


@query(
    "J11_remux_comparison",
    """SELECT conv_id, CASE WHEN conv_id % 5 = 1 THEN 'frames_dropped' WHEN conv_id % 5 = 2 AND n > 1 THEN 'video_changed'
 WHEN conv_id % 5 = 3 THEN 'audio_changed' ELSE 'content-exact' END AS outcome
FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)""",
)
def remux_comparison(t: Tables):
    turns = t.conversations.withColumn("h", F.sha2("text", 256))

    def streams(rows, audio):
        video = digests.ordered_digest(rows, ["conv_id"], ["turn"], "h", "video")
        return video.withColumn("audio", audio)

    conv = F.col("conv_id") % 5
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("last"))
    damaged = (
        turns.join(last, "conv_id")
        .where(~((conv == 1) & (F.col("turn") == F.col("last"))))
        .withColumn("turn", F.when(conv == 2, -F.col("turn")).otherwise(F.col("turn")))
    )
    track = F.md5(F.col("conv_id").cast("string"))
    before = streams(turns, F.when(conv != 4, track))
    after = streams(damaged, F.when(conv == 3, F.lit("silence")).when(conv != 4, track))
    return checks.compare_remux(before, after, ["conv_id"])
