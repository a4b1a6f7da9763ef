"""Steps and oracle views that several registered queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slimlake.catalog.tables import Tables, literal_view
from slimlake.operators.decide import Limits, with_decision
from slimlake.sources.media import with_probe

PLAN_MAX = 262_144
MIN_SECS = 10.0
AS_OF = "1998-10-01 00:00:00"


def as_of():
    return F.to_timestamp(F.lit(AS_OF)).cast("timestamp_ntz")


def plan_limits() -> Limits:
    return Limits(max_file_bytes=PLAN_MAX, allow_av1=False)


def full_limits() -> Limits:
    return Limits(min_video_secs=MIN_SECS)


def parsed(t: Tables) -> DataFrame:
    return with_probe(t.f_probe)


def probe_decided(t: Tables) -> DataFrame:
    return with_decision(parsed(t), full_limits(), probe="probe")


def decided_all(t: Tables) -> DataFrame:
    """Documents judged by name and clips judged by probe: every recipe but one."""
    names = with_decision(t.f_docs.select("path", "size"), full_limits())
    columns = ["path", "size", "kind", "recipe", "skip_reason"]
    return names.select(*columns).unionByName(probe_decided(t).select(*columns))


def pending_docs(t: Tables) -> DataFrame:
    """The whole inventory as pending rows with their sort key."""
    from slimlake.operators.decide import with_projected_saving

    return with_projected_saving(t.f_docs.withColumn("state", F.lit("pending")))


# -- oracle side -------------------------------------------------------------

literal_view(
    "o_ext",
    """SELECT * FROM (VALUES
('jpg','jpeg'),('jpeg','jpeg'),('jpe','jpeg'),('jfif','jpeg'),('png','png'),('gif','gif'),
('bmp','bmp'),('dib','bmp'),('tif','tiff'),('tiff','tiff'),('heic','efficient_image'),
('heif','efficient_image'),('avif','efficient_image'),('jxl','efficient_image'),('webp','webp'),
('wav','wav'),('wave','wav'),('aif','aiff'),('aiff','aiff'),('aifc','aiff'),('flac','flac'),
('m4a','m4a'),('mp3','lossy_audio'),('aac','lossy_audio'),('opus','lossy_audio'),
('ogg','lossy_audio'),('oga','lossy_audio'),('wma','lossy_audio'),('mp4','mp4'),('m4v','mp4'),
('mov','mov'),('qt','mov'),('mkv','mkv'),('webm','mkv'),('ts','mpeg_ts'),('m2ts','mpeg_ts'),
('mts','mpeg_ts'),('m2t','mpeg_ts'),('avi','legacy_video'),('wmv','legacy_video'),
('flv','legacy_video'),('3gp','legacy_video'),('mpg','legacy_video'),('mpeg','legacy_video'),
('vob','legacy_video')) v(ext, kind)""",
)
literal_view(
    "o_recipe",
    """SELECT recipe, ratio::DOUBLE AS ratio, peak::DOUBLE AS peak, holds FROM (VALUES
('jxl-from-jpeg',0.80,1.8,false),('jxl-from-raster',0.65,1.8,false),('jxl-from-webp',0.93,1.8,false),
('flac',0.55,1.5,false),('flac-recompress',0.94,1.5,false),('ts-remux',0.96,1.95,false),
('ffv1',0.50,2.5,true),('av1',0.70,1.65,true)) v(recipe, ratio, peak, holds)""",
)


def duck_verdict(max_bytes: str, video: str, webp: str = "'needs_probe'", m4a: str = "'needs_probe'") -> str:
    return f"""CASE WHEN size < 4096 THEN 'too_small' WHEN size > {max_bytes} THEN 'too_large_for_budget'
 WHEN kind = 'jpeg' THEN 'jxl-from-jpeg' WHEN kind IN ('png','gif','bmp','tiff') THEN 'jxl-from-raster'
 WHEN kind = 'efficient_image' THEN 'already_optimal' WHEN kind = 'webp' THEN {webp}
 WHEN kind IN ('wav','aiff') THEN 'flac' WHEN kind = 'flac' THEN 'flac-recompress'
 WHEN kind = 'm4a' THEN {m4a} WHEN kind = 'lossy_audio' THEN 'lossy_no_gain'
 WHEN kind IN ('mp4','mov','mkv','mpeg_ts','legacy_video') THEN {video} ELSE 'unsupported' END"""


def duck_video(min_secs: float = MIN_SECS) -> str:
    """Video verdict over the columns of ``o_parsed``."""
    return f"""(CASE WHEN n_video IS NULL THEN 'needs_probe' WHEN n_video = 0 THEN 'unsupported'
 WHEN n_video > 1 THEN 'video_complex_structure'
 WHEN codec IN ('rawvideo','huffyuv','ffvhuff','ffv1','magicyuv','utvideo','qtrle','v210','v410','r210','bmp','png') THEN 'ffv1'
 WHEN kind = 'mpeg_ts' AND (hdr OR codec = 'av1' OR coalesce(duration_secs < {min_secs}, false) OR lean) THEN 'ts-remux'
 WHEN hdr THEN 'video_hdr' WHEN codec = 'av1' THEN 'video_already_av1'
 WHEN coalesce(duration_secs < {min_secs}, false) THEN 'video_too_short' WHEN lean THEN 'video_low_bitrate' ELSE 'av1' END)"""


M4A = "(CASE WHEN n_video IS NULL THEN 'needs_probe' WHEN list_contains(audio, 'alac') THEN 'flac-recompress' ELSE 'lossy_no_gain' END)"
IS_RECIPE = "verdict IN (SELECT recipe FROM o_recipe)"
SPLIT = f"CASE WHEN {IS_RECIPE} THEN verdict END AS recipe, CASE WHEN NOT ({IS_RECIPE}) THEN verdict END AS skip_reason"


def kinds(of: str) -> str:
    return (
        f"SELECT d.*, coalesce(k.kind, 'other') AS kind FROM {of} d LEFT JOIN o_ext k "
        r"ON k.ext = lower(regexp_extract(d.path, '[^/]\.([^./]*)$', 1))"
    )


literal_view("o_docs", kinds("f_docs"))
literal_view("o_plan", f"SELECT *, {SPLIT} FROM (SELECT *, {duck_verdict(str(PLAN_MAX), chr(39) + 'needs_probe' + chr(39))} AS verdict FROM o_docs)")
literal_view("o_open", f"SELECT *, {SPLIT} FROM (SELECT *, {duck_verdict('9223372036854775807', chr(39) + 'needs_probe' + chr(39))} AS verdict FROM o_docs)")
literal_view(
    "o_saving",
    """SELECT d.*, CAST(CASE WHEN verdict = 'needs_probe' THEN size - floor(size * CASE WHEN kind = 'webp' THEN 0.93::DOUBLE ELSE 0.70::DOUBLE END)
 WHEN r.ratio IS NOT NULL THEN size - floor(size * r.ratio) ELSE 0 END AS BIGINT) AS projected_saving
FROM o_open d LEFT JOIN o_recipe r ON r.recipe = d.recipe""",
)
literal_view(
    "o_streams",
    """SELECT *, CAST(json_extract(probe, '$.streams[*]') AS JSON[]) AS streams FROM f_probe""",
)
literal_view(
    "o_split",
    """SELECT event_id, path, size,
 TRY_CAST(json_extract_string(probe, '$.format.duration') AS DOUBLE) AS duration_secs,
 TRY_CAST(json_extract_string(probe, '$.format.bit_rate') AS BIGINT) AS bit_rate,
 json_extract_string(probe, '$.format.format_name') AS format_name,
 list_filter(streams, lambda s: json_extract_string(s, '$.codec_type') = 'video') AS v,
 list_transform(list_filter(streams, lambda s: json_extract_string(s, '$.codec_type') = 'audio'),
   lambda s: json_extract_string(s, '$.codec_name')) AS audio,
 CAST(len(list_filter(streams, lambda s: json_extract_string(s, '$.codec_type') = 'subtitle')) AS INTEGER) AS subtitle_count
FROM o_streams""",
)
literal_view(
    "o_facts",
    """SELECT event_id, path, size, duration_secs, bit_rate, format_name, audio, subtitle_count,
 CAST(len(v) AS INTEGER) AS n_video, json_extract_string(v[1], '$.codec_name') AS codec,
 CAST(json_extract_string(v[1], '$.width') AS INTEGER) AS width,
 CAST(json_extract_string(v[1], '$.height') AS INTEGER) AS height,
 json_extract_string(v[1], '$.color_transfer') AS color_transfer,
 TRY_CAST(json_extract_string(v[1], '$.bit_rate') AS BIGINT) AS v_rate,
 coalesce(contains(lower(CAST(json_extract(v[1], '$.side_data_list') AS VARCHAR)), 'dovi'), false) AS dovi
FROM o_split""",
)
literal_view(
    "o_parsed",
    f"""SELECT *, (dovi OR coalesce(color_transfer IN ('smpte2084','arib-std-b67'), false)) AS hdr,
 coalesce(coalesce(v_rate, bit_rate)::DOUBLE / (width::BIGINT * height) < 1.0, false) AS lean
FROM ({kinds('o_facts')})""",
)
literal_view("o_clips", f"SELECT *, {SPLIT} FROM (SELECT *, {duck_verdict('9223372036854775807', duck_video(), m4a=M4A)} AS verdict FROM o_parsed)")
literal_view(
    "o_all",
    "SELECT path, size, kind, recipe, skip_reason FROM o_open UNION ALL SELECT path, size, kind, recipe, skip_reason FROM o_clips",
)
