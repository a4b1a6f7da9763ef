"""V: proven rewriting of tables and payload columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from slimlake.catalog.registry import query
from slimlake.catalog.shared import as_of
from slimlake.catalog.tables import Tables
from slimlake.operators import digests, recompress
from slimlake.operators.decide import with_projected_saving
from slimlake.operators.recompress import Setting
from slimlake.session import scratch
from slimlake.sources.listing import list_files
from slimlake.sources.snapshots import SnapshotTable

DENSE = Setting("zstd", ("l_orderkey", "l_linenumber"))


def _table(t: Tables, df, label: str = "table") -> SnapshotTable:
    table = SnapshotTable(t.spark, scratch(t.spark, label))
    table.write(df, "import", compression="snappy")
    return table


@query("V1_fingerprint", "SELECT count(*) AS rows, true AS order_free, true AS sees_change, true AS sees_repeat FROM lineitem")
def fingerprint(t: Tables):
    """The fingerprint of the table, of a reshuffle of it and of two damaged copies."""
    rows = t.lineitem
    words = ["rows", "word0", "word1", "word2"]

    def named(df, name):
        return digests.fingerprint(df).select(F.struct(*words).alias(name))

    changed = rows.withColumn("l_tax", F.when(F.col("l_orderkey") == 1, F.col("l_tax") + 1).otherwise(F.col("l_tax")))
    others = {
        # Tasks of the reshuffle stay of one size, however large the table is.
        "b": rows.hint("rebalance", "l_partkey"),
        "c": changed,
        "d": rows.union(rows.where(F.col("l_orderkey") == 1)),
    }
    one = named(rows, "a").withColumns({n: named(df, n).scalar() for n, df in others.items()})
    return one.select(
        "a.rows",
        (F.col("a") == F.col("b")).alias("order_free"),
        (F.col("a") != F.col("c")).alias("sees_change"),
        (F.col("a") != F.col("d")).alias("sees_repeat"),
    )


@query("V2_recompress", "SELECT * FROM lineitem")
def rewritten(t: Tables):
    place = scratch(t.spark, "dense")
    recompress.rewrite(t.lineitem, place, DENSE)
    return t.spark.read.parquet(place)


@query(
    "V3_verify",
    """SELECT * FROM (VALUES ('byte-exact', 'rewritten'), ('content-exact', 'rewritten, fingerprint only'),
 ('none', 'values changed'), ('none', 'rows lost'), ('none', 'rows repeated')) v(fidelity, copy)""",
)
def verified(t: Tables):
    place = scratch(t.spark, "dense")
    source = t.lineitem
    recompress.rewrite(source, place, DENSE)
    dense = t.spark.read.parquet(place)
    known = {True: digests.take_proof(source), False: digests.take_fingerprint(source)}
    hit = F.col("l_orderkey") % 997 == 0
    cents = F.when(hit, F.col("l_tax") + 0.01).otherwise(F.col("l_tax"))
    copies = {
        "rewritten": (dense, True),
        "rewritten, fingerprint only": (dense, False),
        "values changed": (dense.withColumn("l_tax", cents), True),
        "rows lost": (dense.where(~hit), True),
        "rows repeated": (dense.union(dense.where(hit)), True),
    }
    held = [
        (recompress.verify(source, copy, known[strict], strict) or "none", name)
        for name, (copy, strict) in copies.items()
    ]
    return t.spark.createDataFrame(held, "fidelity string, copy string")


@query(
    "V4_gain_gate",
    """SELECT s AS setting, o AS outcome, 'byte-exact' AS fidelity, s = 'zstd' AS smaller, (SELECT count(*) FROM documents) AS rows
FROM (VALUES ('zstd', 'would_convert'), ('uncompressed', 'no_gain')) v(s, o)""",
)
def gain_gate(t: Tables):
    """Files before and after a dense and a wasteful rewrite, and what the gate says."""
    table = _table(t, t.documents)
    kept = recompress.recompress(table, Setting("zstd"), execute=False)
    worse = recompress.recompress(table, Setting("uncompressed"), execute=False)
    rows = [(o.setting, o.outcome, o.fidelity, o.output_bytes < o.input_bytes) for o in (kept, worse)]
    told = t.spark.createDataFrame(rows, "setting string, outcome string, fidelity string, smaller boolean")
    return told.withColumn("rows", table.read().agg(F.count("*")).scalar())


@query(
    "V5_confirm",
    """SELECT CASE WHEN doc_id % 11 = 1 THEN 'missing' WHEN doc_id % 11 = 2 AND strlen(text) > 0 THEN 'size_mismatch'
 WHEN doc_id % 11 = 3 THEN 'ok_size_only' WHEN doc_id % 11 = 4 AND contains(text, 'e') THEN 'hash_mismatch' ELSE 'ok' END AS outcome,
 count(*) AS objects FROM documents GROUP BY 1""",
)
def confirm(t: Tables):
    """Size and digest recorded when staging, against what the store holds afterwards.

    Some objects are lost, cut short or damaged on the way, and some come back from a
    store that knows no digest.
    """
    from slimlake.operators.checks import confirm_written

    lot, record, store = F.col("doc_id") % 11, scratch(t.spark, "record"), scratch(t.spark, "store")
    staged = t.documents.select("doc_id", "text")
    meant = staged.select(
        "doc_id", F.octet_length("text").alias("size"), F.sha2("text", 256).alias("hash")
    )
    meant.write.parquet(record)
    held = F.when(lot == 2, F.expr("left(text, length(text) - 1)")).when(lot == 4, F.translate("text", "e", "3"))
    staged.where(lot != 1).withColumn("text", held.otherwise(F.col("text"))).write.parquet(store)
    digest = F.when(lot != 3, F.upper(F.sha2("text", 256)))
    found = t.spark.read.parquet(store).select(
        F.col("doc_id").alias("path"), F.octet_length("text").alias("size"), digest.alias("hash")
    )
    written = t.spark.read.parquet(record).withColumnRenamed("doc_id", "path")
    return confirm_written(written, found).groupBy("outcome").agg(F.count("*").alias("objects"))


@query("V6_swap", "SELECT * FROM lineitem")
def swapped(t: Tables):
    """The table as read after it was rewritten, proven and swapped."""
    table = _table(t, t.lineitem)
    done = recompress.recompress(table, DENSE)
    if done.outcome != "converted":
        raise RuntimeError(f"expected a conversion, got {done}")
    return table.read()


@query(
    "V6_partitioned_swap",
    """SELECT l.*, concat('l_linestatus=', l_linestatus, '/l_returnflag=', l_returnflag) AS place FROM lineitem l""",
)
def swapped_in_place(t: Tables):
    """A table in folders, rewritten, proven and swapped, with the folder of each row."""
    table = SnapshotTable(t.spark, scratch(t.spark, "table"))
    place = f"{table.root}/{table.staging_place()}"
    t.lineitem.write.option("compression", "snappy").partitionBy("l_linestatus", "l_returnflag").parquet(place)
    table.publish(place.removeprefix(f"{table.root}/"), "import")
    done = recompress.recompress(table, DENSE)
    if done.outcome != "converted":
        raise RuntimeError(f"expected a conversion, got {done}")
    folder = recompress.folders_of("_metadata.file_path", 2)
    return table.read().withColumn("place", folder).select(*t.lineitem.columns, "place")


@query(
    "V1_localised_difference",
    """SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_orderkey % 997 = 0 THEN 1 ELSE -1 END AS BIGINT) AS surplus, count(*) AS rows
FROM lineitem WHERE l_orderkey % 997 = 0 OR l_orderkey % 991 = 1 GROUP BY ALL""",
)
def localised_difference(t: Tables):
    """Where a damaged copy differs, found from the sums of hash buckets."""
    rows = t.lineitem
    lost, repeated = F.col("l_orderkey") % 997 == 0, (F.col("l_orderkey") % 991 == 1) & (F.col("l_orderkey") % 997 != 0)
    copy = rows.where(~lost).union(rows.where(repeated))
    found = digests.localised_difference(rows, copy, buckets=4096)
    counted = found.groupBy("l_orderkey", "l_linenumber", F.signum("surplus").cast("long").alias("surplus"))
    return counted.agg(F.sum(F.abs("surplus")).alias("rows"))


@query("V7_restore", "SELECT * FROM lineitem")
def restored(t: Tables):
    """The kept version, made current again after its fingerprint was checked."""
    table = _table(t, t.lineitem)
    first = table.current().version
    known = digests.take_fingerprint(table.read())
    table.write(t.lineitem.where(F.col("l_quantity") > 10), "a bad rewrite")
    recompress.restore(table, first, known)
    return table.read()


@query(
    "V8_settings_bench",
    """SELECT * FROM (VALUES ('snappy', 'no_gain', 'content-exact'), ('zstd', 'kept', 'content-exact'),
 ('gzip', 'kept', 'content-exact'), ('zstd by source,lang,doc_id', 'kept', 'content-exact')) v(setting, outcome, fidelity)""",
)
def settings_bench(t: Tables):
    settings = [
        Setting("snappy"), Setting("zstd"), Setting("gzip"),
        Setting("zstd", ("source", "lang", "doc_id")),
    ]
    measured = recompress.compare_settings(t.documents, scratch(t.spark, "bench"), settings)
    return measured.select("setting", "outcome", "fidelity")


@query(
    "V8_bench_inputs",
    """SELECT input, setting, rows, 'byte-exact' AS fidelity, outcome FROM (SELECT concat(source, '/', lang) AS input, count(*) AS rows FROM documents
 GROUP BY 1 ORDER BY sum(strlen(text)) DESC, 1 LIMIT 5), (VALUES ('uncompressed', 'no_gain'), ('zstd', 'kept'), ('gzip', 'kept')) v(setting, outcome)""",
)
def bench_inputs(t: Tables):
    """The five largest inputs with three settings each, measured and proven."""
    named = t.documents.select(F.concat_ws("/", "source", "lang").alias("input"), "text")
    settings = [Setting("uncompressed"), Setting("zstd"), Setting("gzip")]
    measured = recompress.bench_inputs(named, "input", scratch(t.spark, "bench"), settings, 5, F.octet_length("text"))
    return measured.select("input", "setting", "rows", "fidelity", "outcome")


def _trials(t: Tables, by, codecs):
    return recompress.payload_trial(t.documents, "text", by, codecs)


@query(
    "V9_payload_trial",
    """SELECT lang, codec, count(*) AS payloads, count(*) AS verified, CAST(sum(strlen(text)) AS BIGINT) AS input_bytes
FROM documents, (VALUES ('zlib'), ('bz2')) v(codec) GROUP BY ALL""",
)
def payload_trial(t: Tables):
    summary = recompress.trial_summary(_trials(t, ["lang"], ["zlib", "bz2"]), ["lang"])
    return summary.drop("output_bytes", "ratio")


@query("V10_measured_ratios")
def measured_ratios(t: Tables):
    summary = recompress.trial_summary(_trials(t, ["lang"], ["zlib"]), ["lang"])
    ratios = recompress.best_ratios(summary, ["lang"])
    files = t.f_docs.withColumn("lang", F.split_part("path", F.lit("/"), F.lit(2)))
    saving = recompress.with_measured_saving(with_projected_saving(files), ratios, ["lang"])
    return saving.select("path", "size", "projected_saving", "measured_saving")


_HELD = "state = 'done' AND trashed_at IS NOT NULL AND reclaimed = 0"


@query(
    "V11_retention_purge",
    f"""SELECT 'aged' AS folder, path, size FROM f_lines WHERE {_HELD} AND trashed_at < TIMESTAMP '1997-01-01'
 AND NOT EXISTS (SELECT 1 FROM f_lines WHERE {_HELD} AND trashed_at < TIMESTAMP '1997-01-01' AND trashed_at > TIMESTAMP '1998-10-01' - INTERVAL 30 DAY)
UNION ALL SELECT 'mixed', path, size FROM f_lines WHERE {_HELD}
 AND NOT EXISTS (SELECT 1 FROM f_lines WHERE {_HELD} AND trashed_at > TIMESTAMP '1998-10-01' - INTERVAL 30 DAY)""",
)
def retention_purge(t: Tables):
    old = t.f_lines.where(F.col("trashed_at") < F.lit("1997-01-01").cast("timestamp_ntz"))
    plans = [
        recompress.purge_plan(rows, 30, as_of()).select(F.lit(name).alias("folder"), "path", "size")
        for name, rows in (("aged", old), ("mixed", t.f_lines))
    ]
    return plans[0].union(plans[1])
