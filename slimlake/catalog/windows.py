"""W, T and X: ordered picks, limits and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from slimlake.catalog.filters import _EXCLUDED_SQL, EXCLUDES
from slimlake.catalog.registry import query
from slimlake.catalog.shared import pending_docs
from slimlake.catalog.tables import Tables, literal_view
from slimlake.functions import paths, text
from slimlake.operators import claims, decide, digests, duplicates, ledger, scores
from slimlake.operators.ordered import running
from slimlake.operators.scope import Scope, distinct_paths, union_of_scopes

FOUR = Scope(("src1", "src2", "src3", "src4"))
_FOUR_SQL = "regexp_matches(path, '^src[1-4]/')"
_BY_SAVING = "projected_saving DESC, size DESC, path"


@query(
    "W1_claim_batch",
    f"""WITH c AS (SELECT path FROM o_saving WHERE {_FOUR_SQL} ORDER BY {_BY_SAVING} LIMIT 60)
SELECT path, projected_saving, CASE WHEN path IN (SELECT path FROM c) THEN 'claimed' ELSE 'pending' END AS state FROM o_saving""",
)
def claim_batch(t: Tables):
    rows = pending_docs(t)
    claimed = claims.claim_batch(rows, 60, "savings", FOUR)
    return claims.apply_claims(rows, claimed).select("path", "projected_saving", "state")


_CAP = 48
literal_view(
    "o_priced",
    """SELECT s.path, s.size * 64 AS size, s.projected_saving, CAST(ceil(ceil(s.size*64*coalesce(r.peak, 1.65::DOUBLE))/1048576) AS BIGINT) AS need
FROM o_saving s LEFT JOIN o_recipe r ON r.recipe = s.recipe WHERE s.recipe IS NOT NULL OR s.skip_reason = 'needs_probe'""",
)


@query(
    "W2_budget_admission",
    f"""WITH w AS (SELECT path, need AS reservation_mib, CAST(sum(CASE WHEN need <= {_CAP} THEN greatest(need, 1) ELSE 0 END)
  OVER (ORDER BY projected_saving DESC, size DESC, path ROWS UNBOUNDED PRECEDING) AS BIGINT) AS reserved_mib FROM o_priced)
SELECT path, reservation_mib, CASE WHEN reservation_mib > {_CAP} THEN 'too_large_for_budget' WHEN reserved_mib <= {_CAP} THEN 'admitted' ELSE 'waiting' END AS admission, reserved_mib FROM w""",
)
def budget_admission(t: Tables):
    judged = decide.with_decision(pending_docs(t).drop("mod_time", "blake3"), decide.UNBOUNDED)
    goes_on = F.col("recipe").isNotNull() | (F.col("skip_reason") == "needs_probe")
    files = judged.where(goes_on).withColumn("size", F.col("size") * 64)
    admitted = claims.admit_within_budget(files, _CAP)
    return admitted.select("path", "reservation_mib", "admission", "reserved_mib")


_FREE, _RESERVE, _FLOOR = 11 * 10**9, 5 * 10**9, 2_000
_CAPACITY = -(-_FREE // 2**20) - -(-_RESERVE // 2**20)
literal_view(
    "o_headroom",
    f"""SELECT path, CAST({_CAPACITY} - sum(up) OVER w + ceil(sum(back) OVER w / 1048576) AS BIGINT) AS headroom_mib,
 CAST({_CAPACITY} - (sum(up) OVER w - up) + ceil((sum(back) OVER w - back) / 1048576) AS BIGINT) AS headroom_before_mib
FROM (SELECT path, trashed_at, greatest(CAST(ceil(output_size / 1048576) AS BIGINT), 1) AS up,
  CASE WHEN reclaimed = 1 THEN size ELSE 0 END AS back FROM f_lines WHERE state = 'done')
WINDOW w AS (ORDER BY trashed_at, path ROWS UNBOUNDED PRECEDING)""",
)


def line_headroom(t: Tables):
    # What is ordered is written once, so only the columns that count are handed in.
    done = t.f_lines.where(F.col("state") == "done").select("path", "trashed_at", "output_size", "size", "reclaimed")
    return claims.headroom(done, _FREE, _RESERVE, ["trashed_at", "path"])


@query("W3_remote_headroom", f"SELECT path, headroom_mib, headroom_mib < {_FLOOR} AS below_floor FROM o_headroom")
def remote_headroom(t: Tables):
    below = F.col("headroom_mib") < _FLOOR
    return line_headroom(t).select("path", "headroom_mib", below.alias("below_floor"))


@query(
    "W4_low_water_points",
    f"SELECT path, headroom_mib, headroom_before_mib FROM o_headroom WHERE headroom_mib < {_FLOOR} AND headroom_before_mib >= {_FLOOR}",
)
def low_water_points(t: Tables):
    points = claims.low_water_points(line_headroom(t), _FLOOR)
    return points.select("path", "headroom_mib", "headroom_before_mib")


@query(
    "W4_reclaim_and_go_on",
    f"""WITH RECURSIVE r AS (SELECT path, up, size, row_number() OVER w AS no, CAST(sum(up) OVER w AS BIGINT) AS spent, CAST(sum(size) OVER w AS BIGINT) AS replaced
  FROM (SELECT path, trashed_at, greatest(CAST(ceil(output_size / 1048576) AS BIGINT), 1) AS up, size FROM f_lines WHERE state = 'done')
  WINDOW w AS (ORDER BY trashed_at, path ROWS UNBOUNDED PRECEDING)),
p AS (SELECT 0::BIGINT AS no, 0::BIGINT AS back UNION ALL
  SELECT min(r.no), arg_min(r.replaced - r.size, r.no) FROM p JOIN r ON r.no > p.no AND r.spent - r.up > {_CAPACITY - _FLOOR} + CAST(ceil(p.back / 1048576) AS BIGINT) GROUP BY p.no),
h AS (SELECT r.*, p.no = r.no AS purged, p.back, CAST({_CAPACITY} - spent + ceil(p.back / 1048576) AS BIGINT) AS headroom FROM r ASOF JOIN p ON r.no >= p.no),
s AS (SELECT *, coalesce(no >= (SELECT min(no) FROM h WHERE headroom < 0), false) AS waits FROM h)
SELECT path, CASE WHEN waits THEN 'waiting' ELSE 'uploaded' END AS admission, CASE WHEN NOT waits THEN purged END AS purged,
 CASE WHEN NOT waits THEN headroom END AS headroom_mib, CASE WHEN NOT waits THEN back END AS returned_bytes, CASE WHEN NOT waits THEN replaced - back END AS held_bytes FROM s""",
)
def reclaim_and_go_on(t: Tables):
    done = t.f_lines.where(F.col("state") == "done").select("path", "trashed_at", "output_size", "size")
    walked = claims.reclaim_when_low(done, _FREE, _RESERVE, _FLOOR, ["trashed_at", "path"])
    return walked.drop("trashed_at", "output_size", "size")


@query(
    "W5_worker_assignment",
    f"SELECT path, row_number() OVER (ORDER BY {_BY_SAVING}) AS row_no, CAST((row_number() OVER (ORDER BY {_BY_SAVING}) - 1) % 7 AS INTEGER) AS worker FROM o_saving",
)
def worker_assignment(t: Tables):
    return claims.assign_workers(pending_docs(t).select("path", "size", "projected_saving"), 7).select("path", "row_no", "worker")


@query(
    "W6_nearest_rank",
    """SELECT item, round(max(score) FILTER (rn = greatest(ceil(0.05::DOUBLE * n), 1)), 9) AS p5, any_value(n) AS frames
FROM (SELECT item, score, row_number() OVER (PARTITION BY item ORDER BY score) AS rn, count(*) OVER (PARTITION BY item) AS n FROM f_scores) GROUP BY item""",
)
def nearest_rank(t: Tables):
    found = scores.score_summary(t.f_scores, ["item"], percent=5.0)
    return found.select("item", F.round("low_percentile", 9).alias("p5"), "frames")


_NUMBER = (
    "concat(cast(cast(floor(event_id % 280 / 4) AS bigint) AS string),'.',"
    "split_part('0,25,5,75',',',cast(event_id % 4 + 1 AS int)))"
)
_REPORT = (
    f"concat('probe 1 of 3: crf 61.0 is no verdict', chr(10), 'crf 12.5 first', chr(10), 'crf ', {_NUMBER}, ' settled',"
    " CASE event_id % 3 WHEN 0 THEN concat(chr(10), 'crf unknown') WHEN 1 THEN concat(chr(10), 'crf -9 refused') ELSE '' END)"
)


@query(
    "W7_last_match_wins",
    "SELECT event_id, CAST(least(round_even((event_id % 280) / 4.0::DOUBLE, 0), 63) AS INTEGER) AS crf FROM events",
)
def last_match_wins(t: Tables):
    return t.events.select("event_id", F.expr(_REPORT).alias("report")).select(
        "event_id", text.last_setting("report").alias("crf")
    )


@query(
    "W8_first_passing_rung",
    """WITH a AS (SELECT item, CASE preset WHEN 3 THEN 1 WHEN 4 THEN 2 ELSE 3 END AS attempt, score FROM f_scores),
s AS (SELECT item, attempt, sum(CAST(round(score * 1000000) AS BIGINT))::BIGINT / (count(*) * 1000000) AS mean, max(score) FILTER (rn = greatest(ceil(0.01::DOUBLE * n), 1)) AS low FROM
 (SELECT *, row_number() OVER (PARTITION BY item, attempt ORDER BY score) AS rn, count(*) OVER (PARTITION BY item, attempt) AS n FROM a) GROUP BY item, attempt),
r AS (SELECT *, mean >= 97 AND low >= 95 AS ok FROM s WHERE attempt = 1 OR item % 6 > 2 * (attempt - 1)),
k AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY ok DESC, CASE WHEN ok THEN attempt ELSE -attempt END) AS pick FROM r)
SELECT item, ok AS passed, attempt, CAST(greatest(item % 6 - 2 * (attempt - 1), 0) AS INTEGER) AS crf, mean, round(low, 9) AS low_percentile FROM k WHERE pick = 1""",
)
def first_passing_rung(t: Tables):
    attempt = F.when(F.col("preset") == 3, 1).when(F.col("preset") == 4, 2).otherwise(3)
    measured = scores.score_summary(t.f_scores.withColumn("attempt", attempt), ["item", "attempt"])
    # The ladder starts at 0 to 5 and ends at its floor.
    first = measured.withColumn("first", (F.col("item") % 6).cast("int"))
    crf = F.get(scores.setting_ladder("first"), F.col("attempt") - 1)
    tried = first.withColumn("crf", crf).where("crf IS NOT NULL").drop("first")
    return scores.first_passing(tried, ["item"]).withColumn("low_percentile", F.round("low_percentile", 9))


@query("W9_latest_state", "SELECT path, arg_max(state, seq) AS state, max(seq) AS seq FROM f_jobs GROUP BY path")
def latest_state(t: Tables):
    return ledger.latest_state(t.f_jobs)


# -- T -----------------------------------------------------------------------


def _numbered(df, order: str):
    """The position along the order, so that the order itself is compared."""
    ones = df.withColumn("_one", F.lit(1).cast("long"))
    return running(ones, claims.ORDERS[order], {"place": "_one"}).drop("_one")


@query("T1_order_savings", f"SELECT path, row_number() OVER (ORDER BY {_BY_SAVING}) AS place FROM o_saving")
def order_savings(t: Tables):
    return _numbered(pending_docs(t), "savings").select("path", "place")


@query("T2_order_size", "SELECT path, row_number() OVER (ORDER BY size DESC, path) AS place FROM f_docs")
def order_size(t: Tables):
    return _numbered(t.f_docs, "size").select("path", "place")


@query("T3_order_path", "SELECT path, row_number() OVER (ORDER BY path) AS place FROM f_docs")
def order_path(t: Tables):
    return _numbered(t.f_docs, "path").select("path", "place")


@query(
    "T4_largest_completed",
    "SELECT path, size FROM f_lines WHERE state = 'done' ORDER BY size DESC, path LIMIT 100",
)
def largest_completed(t: Tables):
    return claims.largest_completed(t.f_lines, 100).select("path", "size")


@query(
    "T5_bench_sample",
    f"""SELECT path, size FROM o_docs WHERE kind IN ('mp4','mov','mkv','mpeg_ts','legacy_video') AND {_FOUR_SQL}
ORDER BY size DESC, path LIMIT 12""",
)
def bench_sample(t: Tables):
    return claims.bench_sample(pending_docs(t), 12, FOUR).select("path", "size")


@query(
    "T6_verify_sample",
    """SELECT path, size FROM f_lines WHERE state = 'done' AND (path LIKE 's1/%' OR path LIKE 's2/A/%')
ORDER BY size DESC, path LIMIT 25""",
)
def verify_sample(t: Tables):
    return claims.verify_sample(t.f_lines, 25, Scope(("s1", "s2/A"))).select("path", "size")


@query(
    "T7_run_limit",
    f"SELECT path FROM o_saving WHERE NOT {_EXCLUDED_SQL} ORDER BY {_BY_SAVING} LIMIT 80",
)
def run_limit(t: Tables):
    return claims.start_run(pending_docs(t), 80, "savings", Scope(excludes=EXCLUDES)).select("path")


@query(
    "T8_dedup_order",
    "SELECT *, row_number() OVER (ORDER BY recoverable DESC, first_path) AS place FROM o_groups",
)
def dedup_order(t: Tables):
    groups = duplicates.groups(t.f_docs).withColumn("_one", F.lit(1).cast("long"))
    return running(groups, ["-recoverable", "first_path"], {"place": "_one"}).drop("_one")


# -- X -----------------------------------------------------------------------


@query("X1_union_of_scopes", """SELECT trim(path, '/') AS path, max(size) AS size FROM f_pages
WHERE regexp_matches(path, '^(en|fr)(/|$)') GROUP BY 1""")
def union_of_listed_scopes(t: Tables):
    pages = t.f_pages.select(paths.normalize("path").alias("path"), "size")
    unique = pages.groupBy("path").agg(F.max("size").alias("size"))
    listings = [unique.where(Scope((p,)).contains("path")) for p in ("en", "fr", "en/8", "en/825")]
    return union_of_scopes(listings)


@query("X2_union_of_states", "SELECT path, state FROM f_lines WHERE state <> 'claimed'")
def union_of_states(t: Tables):
    return duplicates.compared(t.f_lines).select("path", "state")


@query("X3_seen_set", "SELECT DISTINCT trim(path, '/') AS path FROM f_pages")
def seen_set(t: Tables):
    return distinct_paths(t.f_pages)


@query("X4_except", "SELECT path FROM f_ledger EXCEPT SELECT path FROM f_listing")
def except_seen(t: Tables):
    return t.f_ledger.select("path").join(t.f_listing.select("path"), "path", "left_anti")


@query(
    "X5_symmetric_difference",
    """WITH b AS (SELECT * REPLACE (CASE WHEN l_orderkey % 100 = 2 THEN l_tax + 1 ELSE l_tax END AS l_tax) FROM lineitem WHERE l_orderkey % 100 <> 0
 UNION ALL SELECT * FROM lineitem WHERE l_orderkey % 100 = 1),
c AS (SELECT *, 1 AS n FROM lineitem UNION ALL SELECT *, -1 FROM b),
g AS (SELECT * EXCLUDE (n), sum(n) AS s FROM c GROUP BY ALL)
SELECT * EXCLUDE (s), CASE WHEN s > 0 THEN 'left' ELSE 'right' END AS side, CAST(abs(s) AS BIGINT) AS copies FROM g WHERE s <> 0""",
)
def symmetric_difference(t: Tables):
    key = F.col("l_orderkey") % 100
    changed = t.lineitem.where(key != 0).withColumn(
        "l_tax", F.when(key == 2, F.col("l_tax") + 1).otherwise(F.col("l_tax"))
    )
    return digests.symmetric_difference(t.lineitem, changed.union(t.lineitem.where(key == 1)))
