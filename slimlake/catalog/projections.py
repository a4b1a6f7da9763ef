"""P: classification and the rule table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from slimlake.catalog.registry import query
from slimlake.catalog.shared import (
    IS_RECIPE, M4A, SPLIT, decided_all, duck_verdict, duck_video, full_limits, parsed, plan_limits,
    probe_decided,
)
from slimlake.catalog.tables import Tables, literal_view
from slimlake.functions import media, paths, sniff
from slimlake.operators import checks, decide, reports


@query("P1_kind_from_extension", "SELECT path, kind FROM o_docs")
def kind_from_extension(t: Tables):
    return t.f_docs.select("path", decide.kind_of("path").alias("kind"))


_FORMAT_SQL = """CASE WHEN h LIKE '89504E470D0A1A0A%' THEN 'png' WHEN h LIKE 'FFD8FF%' THEN 'jpeg'
 WHEN h LIKE '47494638%' THEN 'gif' WHEN h LIKE '52494646________57454250%' THEN 'webp'
 WHEN h LIKE '49492A00%' OR h LIKE '4D4D002A%' THEN 'tiff'
 WHEN h LIKE '424D%' AND substr(h, 29, 8) IN ('0C000000','28000000','34000000','38000000','40000000','6C000000','7C000000') THEN 'bmp'
 WHEN substr(h, 9, 8) = '66747970' AND substr(h, 17, 8) IN ('68656963','68656978','68657663','68657678','6865696D','68656973','6D696631','6D736631','61766966','61766973') THEN 'heif'
 WHEN h LIKE 'FF0A%' OR h LIKE '0000000C4A584C200D0A870A%' THEN 'jxl' END"""
_WEBP_SQL = "h LIKE '52494646________574542505650384C%'"
_TS_SQL = "(n >= 752 AND substr(h,1,2) = '47' AND substr(h,377,2) = '47' AND substr(h,753,2) = '47' AND substr(h,1129,2) = '47')"
_CONFIRMED_SQL = f"""CASE WHEN kind = 'mpeg_ts' AND NOT {_TS_SQL} THEN 'other'
 WHEN kind IN ('jpeg','png','gif','bmp','tiff','efficient_image','webp') THEN
   coalesce(CASE WHEN format IN ('heif','jxl') THEN 'efficient_image' ELSE format END, kind) ELSE kind END"""
literal_view(
    "o_heads",
    f"""SELECT *, {_CONFIRMED_SQL} AS confirmed FROM (SELECT b.*, coalesce(k.kind,'other') AS kind, {_FORMAT_SQL} AS format
FROM f_bytes b LEFT JOIN o_ext k ON k.ext = lower(regexp_extract(path, '[^/]\\.([^./]*)$', 1)))""",
)


@query("P2_content_sniffing", "SELECT doc_id, format FROM o_heads")
def content_sniffing(t: Tables):
    return t.f_heads.select("doc_id", sniff.sniff_image("head").alias("format"))


@query("P3_lossless_webp", f"SELECT doc_id, {_WEBP_SQL} AS lossless FROM o_heads")
def lossless_webp(t: Tables):
    return t.f_heads.select("doc_id", sniff.is_lossless_webp("head").alias("lossless"))


@query("P4_transport_stream", f"SELECT doc_id, {_TS_SQL} AS is_ts FROM o_heads")
def transport_stream(t: Tables):
    return t.f_heads.select("doc_id", sniff.is_mpeg_ts("head").alias("is_ts"))


@query("P5_bytes_override_name", "SELECT doc_id, path, confirmed AS kind FROM o_heads")
def bytes_override_name(t: Tables):
    kind = decide.confirmed_kind("named", "head")
    return t.f_heads.withColumn("named", decide.kind_of("path")).select("doc_id", "path", kind.alias("kind"))


@query("P6_decide", "SELECT path, recipe, skip_reason FROM o_plan")
def decide_by_name(t: Tables):
    return decide.with_decision(t.f_docs, plan_limits()).select("path", "recipe", "skip_reason")


@query("P7_decide_video", "SELECT path, recipe, skip_reason FROM o_clips")
def decide_video(t: Tables):
    return probe_decided(t).select("path", "recipe", "skip_reason")


literal_view(
    "o_two",
    """SELECT h.doc_id, h.path, h.size, h.kind AS named, h.confirmed AS kind, h.h, h.n,
 CASE WHEN h.kind IN ('mp4','mov','mkv','mpeg_ts','legacy_video') OR lower(h.path) LIKE '%.m4a' THEN p.n_video END AS n_video,
 p.codec, p.hdr, p.duration_secs, p.lean, p.audio, h.doc_id % 5 <> 4 AS has_head
FROM o_heads h LEFT JOIN (SELECT * FROM o_parsed WHERE event_id % 12 <> 1) p ON p.event_id = h.doc_id""",
)
_NEEDS = "'needs_probe'"


@query(
    "P8_two_tier_deferral",
    f"""WITH cheap AS (SELECT *, {duck_verdict('262144', _NEEDS).replace('kind', 'named')} AS first FROM o_two),
again AS (SELECT doc_id, path, first, {duck_verdict('262144', duck_video(),
   webp=f"(CASE WHEN NOT has_head THEN 'needs_probe' WHEN {_WEBP_SQL} THEN 'jxl-from-webp' ELSE 'lossy_no_gain' END)", m4a=M4A)} AS second
 FROM (SELECT * EXCLUDE (kind), CASE WHEN has_head THEN kind ELSE named END AS kind FROM cheap)),
v AS (SELECT path, CASE WHEN first = 'needs_probe' OR first IN (SELECT recipe FROM o_recipe) THEN second ELSE first END AS verdict FROM again)
SELECT path, {SPLIT} FROM v""",
)
def two_tier_deferral(t: Tables):
    from slimlake.operators.decide import Limits

    heads = t.stored("f_heads")
    docs = t.f_ledger.select("doc_id", "path")
    clips = parsed(t).where(F.col("event_id") % 12 != 1).select("event_id", "probe")
    probes = docs.join(clips, F.col("doc_id") == F.col("event_id")).select("path", "probe")
    limits = Limits(max_file_bytes=262_144, min_video_secs=full_limits().min_video_secs)
    files = heads.select("path", "size")
    known = heads.where(F.col("doc_id") % 5 != 4)
    return decide.decide_in_two_steps(files, limits, known, probes).select("path", "recipe", "skip_reason")


@query(
    "P9_lossless_codecs",
    """SELECT event_id, codec, coalesce(codec IN ('rawvideo','huffyuv','ffvhuff','ffv1','magicyuv','utvideo','qtrle','v210','v410','r210','bmp','png'), false) AS lossless FROM o_parsed""",
)
def lossless_codecs(t: Tables):
    codec = media.first_video("probe")["codec"]
    return parsed(t).select("event_id", codec.alias("codec"), media.is_lossless_codec(codec).alias("lossless"))


@query("P10_already_lean", "SELECT event_id, lean FROM o_parsed")
def already_lean(t: Tables):
    lean = media.is_already_lean(media.pixels(media.first_video("probe")), media.video_bit_rate("probe"))
    return parsed(t).select("event_id", lean.alias("lean"))


@query("P11_hdr", "SELECT event_id, hdr FROM o_parsed")
def hdr(t: Tables):
    return parsed(t).select("event_id", media.is_hdr(media.first_video("probe")).alias("hdr"))


@query(
    "P12_pixels_and_rate",
    "SELECT event_id, width::BIGINT * height AS pixels, coalesce(v_rate, bit_rate) AS bit_rate FROM o_parsed",
)
def pixels_and_rate(t: Tables):
    return parsed(t).select(
        "event_id",
        media.pixels(media.first_video("probe")).alias("pixels"),
        media.video_bit_rate("probe").alias("bit_rate"),
    )


@query("P13_expected_ratio", "SELECT path, recipe, ratio FROM o_all JOIN o_recipe USING (recipe)")
def expected_ratio(t: Tables):
    rows = decided_all(t).where(F.col("recipe").isNotNull())
    return rows.select("path", "recipe", decide.expected_ratio("recipe").alias("ratio"))


@query("P14_projected_saving", "SELECT path, projected_saving FROM o_saving")
def projected_saving(t: Tables):
    return decide.with_projected_saving(t.f_docs).select("path", "projected_saving")


_EXT_SQL = r"lower(regexp_extract(path, '[^/]\.([^./]*)$', 1))"


@query(
    "P15_output_extension",
    f"""SELECT path, recipe, CASE WHEN recipe LIKE 'jxl%' THEN 'jxl' WHEN recipe LIKE 'flac%' THEN 'flac'
 WHEN recipe = 'ts-remux' THEN 'mp4' WHEN recipe = 'ffv1' THEN 'mkv' WHEN {_EXT_SQL} IN ('mov','qt') THEN 'mov'
 WHEN {_EXT_SQL} IN ('mkv','webm') THEN 'mkv' ELSE 'mp4' END AS output_ext FROM o_all WHERE recipe IS NOT NULL""",
)
def output_extension(t: Tables):
    rows = decided_all(t).where(F.col("recipe").isNotNull())
    ext = decide.output_extension("recipe", paths.extension("path"))
    return rows.select("path", "recipe", ext.alias("output_ext"))


@query(
    "P16_reversibility",
    "SELECT path, recipe = 'jxl-from-jpeg' AS byte_reversible, recipe <> 'av1' AS lossless FROM o_all WHERE recipe IS NOT NULL",
)
def reversibility(t: Tables):
    return decided_all(t).where(F.col("recipe").isNotNull()).select(
        "path",
        decide.is_byte_reversible("recipe").alias("byte_reversible"),
        decide.is_lossless("recipe").alias("lossless"),
    )


@query(
    "P17_reservation",
    """SELECT path, CAST(ceil(ceil(size*64*peak)/1048576) AS BIGINT) AS drop_source,
 CAST(ceil(ceil(size*64*(peak + CASE WHEN holds THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END))/1048576) AS BIGINT) AS keep_source
FROM o_all JOIN o_recipe USING (recipe)""",
)
def reservation(t: Tables):
    rows = decided_all(t).where(F.col("recipe").isNotNull())
    size = F.col("size") * 64
    return rows.select(
        "path",
        decide.reservation_mib("recipe", size).alias("drop_source"),
        decide.reservation_mib("recipe", size, keep_source=True).alias("keep_source"),
    )


@query(
    "P18_score_model",
    """SELECT event_id, CASE WHEN width::BIGINT * height > 4147200 THEN 'vmaf_4k_v0.6.1' ELSE 'vmaf_v0.6.1' END AS model
FROM o_parsed WHERE n_video > 0""",
)
def score_model(t: Tables):
    video = media.first_video("probe")
    rows = parsed(t).where(F.size("probe.video") > 0)
    return rows.select("event_id", media.score_model(video["width"], video["height"]).alias("model"))


@query(
    "P20_refusal_text",
    """SELECT path, CASE WHEN fidelity = 'byte-exact' THEN NULL
 WHEN recipe = 'av1' THEN path || ': a lossy re-encode cannot be undone'
 WHEN recipe IN ('jxl-from-raster','ffv1','ts-remux') THEN path || ': content kept in ' || output_path || ', original bytes not'
 ELSE path || ': ' || recipe || ' held only ' || fidelity || ' fidelity' END AS refusal
FROM f_lines WHERE state = 'done'""",
)
def refusal_text(t: Tables):
    done = t.f_lines.where(F.col("state") == "done")
    return done.select("path", reports.refusal("path", "output_path", "recipe", "fidelity").alias("refusal"))


@query(
    "P21_quota_advice",
    """WITH p AS (SELECT CAST(sum(size) AS BIGINT) AS b FROM f_lines WHERE state = 'done' AND reclaimed = 0 AND trashed_at IS NOT NULL)
SELECT 'keep' AS policy, b || ' bytes of originals are held and still count; check results, then clean up' AS advice FROM p
UNION ALL SELECT 'purge_after_days', b || ' bytes of originals are held until the retention period ends' FROM p
UNION ALL SELECT 'purge_now', b || ' bytes of originals are held and were not purged; clean up' FROM p
UNION ALL SELECT 'keep, nothing held', NULL FROM p""",
)
def quota_advice(t: Tables):
    held = reports.pending_reclaim(t.f_lines)
    nothing = reports.pending_reclaim(t.f_lines.where(F.col("state") == "failed"))
    rows = [
        held.select(F.lit(p).alias("policy"), reports.quota_advice(p, "bytes").alias("advice"))
        for p in ("keep", "purge_after_days", "purge_now")
    ]
    rows.append(nothing.select(F.lit("keep, nothing held").alias("policy"), reports.quota_advice("keep", "bytes").alias("advice")))
    return reduce(lambda a, b: a.union(b), rows)


literal_view(
    "o_out",
    f"""SELECT path, size, recipe, regexp_replace(path, '\\.[^./]*$', '') || '.' || CASE WHEN recipe LIKE 'jxl%' THEN 'jxl' WHEN recipe LIKE 'flac%' THEN 'flac'
 WHEN recipe = 'ts-remux' THEN 'mp4' WHEN recipe = 'ffv1' THEN 'mkv' WHEN {_EXT_SQL} IN ('mov','qt') THEN 'mov'
 WHEN {_EXT_SQL} IN ('mkv','webm') THEN 'mkv' ELSE 'mp4' END AS output_path FROM o_all WHERE recipe IS NOT NULL""",
)


def with_output_path(t: Tables):
    rows = decided_all(t).where(F.col("recipe").isNotNull())
    ext = decide.output_extension("recipe", paths.extension("path"))
    return rows.withColumn("output_path", paths.swap_extension("path", ext))


@query(
    "P23_in_place",
    "SELECT path, output_path, CASE WHEN path = output_path THEN path || '.job7.part' ELSE output_path END AS target FROM o_out",
)
def in_place(t: Tables):
    target = checks.in_place_target("path", "output_path", F.lit("job7"))
    return with_output_path(t).select("path", "output_path", target.alias("target"))
