"""S: scans, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from slimlake.catalog.registry import query
from slimlake.catalog.shared import parsed
from slimlake.catalog.tables import Tables
from slimlake.functions import text
from slimlake.schemas import LEDGER, evolve
from slimlake.session import scratch
from slimlake.sources import listing, media, snapshots


@query(
    "S1_listing_json",
    """SELECT concat('drive/', path) AS path, CAST(CASE WHEN doc_id % 11 = 0 THEN 0 ELSE size END AS BIGINT) AS size,
 mod_time, blake3 FROM f_ledger WHERE doc_id % 13 <> 0""",
)
def listing_json(t: Tables):
    place = scratch(t.spark, "listing")
    _raw_listing(t).write.json(place)
    return listing.read_listing_json(t.spark, place, scope="/drive/", json_lines=True)


def _raw_listing(t: Tables):
    key = F.when(F.col("doc_id") % 2 == 0, "BLAKE3").otherwise("blake3")
    return t.f_ledger.select(
        F.concat(F.lit("/"), "path").alias("Path"),
        F.when(F.col("doc_id") % 11 == 0, -1).otherwise(F.col("size")).alias("Size"),
        F.col("mod_time").alias("ModTime"),
        (F.col("doc_id") % 13 == 0).alias("IsDir"),
        F.when(F.col("blake3").isNotNull(), F.create_map(F.lit("md5"), F.md5("path"), key, "blake3")).alias("Hashes"),
    )


@query(
    "S1_listing_lines",
    """SELECT concat('drive/', path) AS path, CAST(CASE WHEN doc_id % 11 = 0 THEN 0 ELSE size END AS BIGINT) AS size,
 mod_time, blake3 FROM f_ledger WHERE doc_id % 13 <> 0""",
)
def listing_lines(t: Tables):
    """Printed arrays, one per task that wrote, read by their lines."""
    place = scratch(t.spark, "listing")
    _raw_listing(t).select(F.to_json(F.struct("*")).alias("value")).mapInArrow(_print_array, "value string").write.text(place)
    return listing.read_listing_lines(t.spark, place, scope="/drive/")


def _print_array(batches):
    """The rows as one JSON array, an entry to a line."""
    import pyarrow as pa

    before = None
    yield pa.RecordBatch.from_pydict({"value": ["["]})
    for batch in batches:
        for entry in batch.column(0).to_pylist():
            if before is not None:
                yield pa.RecordBatch.from_pydict({"value": [before + ","]})
            before = entry
    yield pa.RecordBatch.from_pydict({"value": ([] if before is None else [before]) + ["]"]})


@query(
    "S2_tree_listing",
    """SELECT concat(source, '/', lang) AS folder, count(*) AS texts, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes,
 2::BIGINT AS files, 1::BIGINT AS empty FROM documents GROUP BY ALL""",
)
def tree_listing(t: Tables):
    """Texts written to one file in each folder, and an empty file beside it, listed again."""
    place, by = scratch(t.spark, "tree"), ["source", "lang"]
    named = t.documents.select(*by, "text")
    named.repartition(*by).write.partitionBy(*by).text(place)
    texts = named.groupBy(F.concat_ws("/", *by).alias("folder")).agg(F.count("*").alias("texts"))
    store = t.spark._jvm.org.apache.hadoop.fs.Path
    for source, lang in named.select(*by).distinct().collect():
        empty = store(f"{place}/source={source}/lang={lang}/empty")
        empty.getFileSystem(t.spark.sparkContext._jsc.hadoopConfiguration()).createNewFile(empty)
    folder = F.regexp_replace("path", "^source=([^/]*)/lang=([^/]*)/.*$", "$1/$2").alias("folder")
    found = listing.list_tree(t.spark, place, depth=2).groupBy(folder).agg(
        F.sum("size").alias("bytes"), F.count("*").alias("files"), F.count_if(F.col("size") == 0).alias("empty")
    )
    return texts.join(found, "folder")


@query("S2_direct_listing")
def direct_listing(t: Tables):
    return listing.list_files(t.spark, t.folder).select("path", "size")


@query("S3_opt_in_hash", "SELECT doc_id, sha256(text) AS blake3 FROM documents")
def opt_in_hash(t: Tables):
    rows = t.documents.select("doc_id", F.col("text").cast("binary").alias("content"))
    return listing.with_content_hash(rows, "content", enabled=True).drop("content")


@query(
    "S4_stat",
    """SELECT w.path, d.size, d.mod_time, d.path IS NOT NULL AS present
FROM (SELECT CASE WHEN size % 4 = 0 AND size % 3 = 0 THEN concat(path, '.gone') ELSE path END AS path FROM f_docs) w
LEFT JOIN f_docs d ON d.path = w.path""",
)
def stat(t: Tables):
    gone = (F.col("size") % 4 == 0) & (F.col("size") % 3 == 0)
    wanted = t.f_docs.select(F.when(gone, F.concat("path", F.lit(".gone"))).otherwise(F.col("path")).alias("path"))
    return listing.stat(wanted, t.f_docs)


@query(
    "S5_hashsum",
    "SELECT w.path, d.blake3 FROM f_listing w LEFT JOIN f_docs d ON d.path = w.path",
)
def hashsum(t: Tables):
    return listing.hashsum(t.f_listing, t.f_docs)


_QUOTA = (
    "concat('{\"total\":',cast(event_id*1000 AS string),"
    "CASE WHEN event_id % 3 = 0 THEN concat(',\"used\":',cast(event_id*7 AS string)) ELSE '' END,"
    "CASE WHEN event_id % 4 = 0 THEN ',\"free\":null' ELSE concat(',\"free\":',cast(event_id*993 AS string)) END,"
    "',\"other\":\"x\"}')"
)


@query(
    "S6_quota",
    """SELECT event_id, event_id*1000 AS total, CASE WHEN event_id % 3 = 0 THEN event_id*7 END AS used,
 CASE WHEN event_id % 4 <> 0 THEN event_id*993 END AS free, CAST(NULL AS BIGINT) AS trashed FROM events""",
)
def quota(t: Tables):
    rows = t.events.select("event_id", F.expr(_QUOTA).alias("about"))
    return rows.withColumn("q", listing.parse_quota("about")).select("event_id", "q.*")


@query(
    "S7_probe_json",
    """SELECT event_id, array_to_string(list_filter(string_split(format_name, ','), lambda s: s <> ''), '+') AS format_names,
 duration_secs, bit_rate, n_video, codec, width, height, color_transfer, v_rate,
 CASE WHEN n_video > 0 THEN dovi END AS dovi, array_to_string(audio, '+') AS audio, subtitle_count FROM o_parsed""",
)
def probe_json(t: Tables):
    video = F.try_element_at("probe.video", F.lit(1))
    return parsed(t).select(
        "event_id",
        F.array_join("probe.format_names", "+").alias("format_names"),
        "probe.duration_secs",
        "probe.bit_rate",
        F.size("probe.video").alias("n_video"),
        *[video[c].alias(c) for c in ("codec", "width", "height", "color_transfer")],
        video["bit_rate"].alias("v_rate"),
        video["has_dolby_vision"].alias("dovi"),
        F.array_join("probe.audio_codecs", "+").alias("audio"),
        "probe.subtitle_count",
    )


_LOG = (
    "concat('{\"frames\":[{\"frameNum\":0,\"metrics\":{\"vmaf\":',cast(event_id % 100 AS string),'.25}},',"
    "'{\"frameNum\":1,\"metrics\":{\"vmaf\":',CASE WHEN event_id % 3 = 0 THEN 'null' ELSE '97.5' END,'}},',"
    "'{\"frameNum\":2,\"metrics\":{\"psnr\":40}},{\"frameNum\":3,\"metrics\":{\"vmaf\":100}}],\"pooled_metrics\":{}}')"
)


@query(
    "S8_score_log",
    """SELECT event_id, 0::BIGINT AS frame, (event_id % 100)::DOUBLE + 0.25 AS score FROM events
UNION ALL SELECT event_id, 1, 97.5::DOUBLE FROM events WHERE event_id % 3 <> 0
UNION ALL SELECT event_id, 3, 100::DOUBLE FROM events""",
)
def score_log(t: Tables):
    logs = t.events.select("event_id", F.expr(_LOG).alias("log"))
    return media.scores_from_log(logs, "log", ["event_id"])


@query(
    "S9_frame_hash_text",
    """SELECT conv_id, turn, array_to_string(list_transform(
 list_filter(string_split(concat('#header', chr(10), text), chr(10)), lambda l: l[1] <> '#' AND trim(l) <> ''),
 lambda l: trim(string_split(l, ',')[-1])), chr(10)) AS hashes FROM conversations""",
)
def frame_hash_text(t: Tables):
    dump = F.concat(F.lit("#header\n"), "text")
    return t.conversations.select("conv_id", "turn", text.hash_lines(dump).alias("hashes"))


@query("S10_ledger_table", "SELECT path, size, state, skip_reason, 0 AS reclaimed FROM f_ledger")
def ledger_table(t: Tables):
    table = snapshots.SnapshotTable(t.spark, scratch(t.spark, "ledger"))
    table.write(evolve(t.f_docs), "scan")
    table.write(evolve(t.f_ledger.drop("doc_id")), "run")
    return table.read().select("path", "size", "state", "skip_reason", "reclaimed")


@query(
    "S11_schema_evolution",
    """SELECT path, size, mod_time, blake3, 'pending' AS state, CAST(NULL AS VARCHAR) AS skip_reason,
 CAST(NULL AS VARCHAR) AS output_path, CAST(NULL AS BIGINT) AS output_size, CAST(NULL AS VARCHAR) AS recipe,
 CAST(NULL AS VARCHAR) AS fidelity, 0 AS reclaimed, CAST(NULL AS INTEGER) AS crf_hint,
 CAST(NULL AS INTEGER) AS crf_hint_preset, 0::BIGINT AS projected_saving FROM f_docs""",
)
def schema_evolution(t: Tables):
    return evolve(t.f_docs, LEDGER).drop("seen_at", "trashed_at")


@query(
    "S12_kept_copy",
    """SELECT *, CASE WHEN l_linenumber = 1 THEN '' WHEN l_linenumber > 2 THEN '00' || l_linenumber END AS lot FROM lineitem""",
)
def kept_copy(t: Tables):
    """By a text column of digits, empty texts and nulls, and by a flag."""
    place, number = scratch(t.spark, "kept"), F.col("l_linenumber")
    lot = F.when(number == 1, "").when(number > 2, F.concat(F.lit("00"), number.cast("string")))
    snapshots.keep_copy(t.lineitem.withColumn("lot", lot), place, ["lot", "l_returnflag"])
    return snapshots.read_copy(t.spark, place)
