"""The registered queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slimlake.llm import (
    decontaminate, line_rules, mixing, near_duplicates, prefix_trie, quality_net, sharding, substring_dedup,
    token_counts, token_files, toxicity, url_filters, whitening,
)
from slimlake.llm.common import kept
from slimlake.session import prepare, scratch

URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{table}.parquet")


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = line_rules.clean_lines(_read(spark, folder, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "n_lines", "n_bad_lines", "bad_chars",
    )


OP1_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS no, doc_id, text,
         coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words,
         coalesce(string_split(text, chr(10)), []) AS lines
  FROM documents
), placed AS (
  SELECT no, unnest(words) AS a, generate_subscripts(words, 1) AS pos FROM docs
), windows AS (
  SELECT no, pos, a, lead(a, 1) OVER w AS b, lead(a, 2) OVER w AS c FROM placed WINDOW w AS (PARTITION BY no ORDER BY pos)
), seen AS (
  SELECT no, pos, c IS NOT NULL AND count(*) OVER (PARTITION BY no, a, b, c) > 1 AS twice FROM windows
), covered AS (
  SELECT no, bool_or(twice) OVER (PARTITION BY no ORDER BY pos ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS hit FROM seen
), repeats AS (
  SELECT no, count(*) FILTER (hit) AS n_repeat_words FROM covered GROUP BY no
), each_line AS (
  SELECT no, unnest(lines) AS line FROM docs
), counted AS (
  SELECT no, line, len(line) AS n, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words,
         len(regexp_extract_all(line, '[|»›•·→]')) AS seps, len(regexp_extract_all(line, '[#*$%&|<>]')) AS symbols,
         len(regexp_extract_all(line, '\p{Lu}')) AS capitals, len(regexp_extract_all(line, '\p{Ll}')) AS small
  FROM each_line
), judged AS (
  SELECT *, (seps >= 3 AND seps * 6 >= words) OR symbols * 20 > n OR (words >= 2 AND capitals > small)
         OR regexp_matches(lower(line), 'BOILERPLATE')
         OR NOT regexp_matches(line, '[.!?…:;,)\]\"''”’»]\s*$') AS bad
  FROM counted WHERE words > 0
), sums AS (
  SELECT no, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines,
         count(*) FILTER (bad) AS n_bad_lines, sum(n)::BIGINT AS line_chars, coalesce(sum(n) FILTER (bad), 0)::BIGINT AS bad_chars
  FROM judged GROUP BY no
), joined AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, len(array_to_string(words, ''))::BIGINT AS word_chars,
         coalesce(len(regexp_extract_all(text, '[#*$%&|<>]')), 0)::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_bad_lines, 0)::BIGINT AS n_bad_lines,
         coalesce(bad_chars, 0)::BIGINT AS bad_chars, coalesce(line_chars, 0)::BIGINT AS line_chars
  FROM docs LEFT JOIN repeats USING (no) LEFT JOIN sums USING (no)
), based AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM joined
)
SELECT * EXCLUDE (line_chars), NOT base_failed AND bad_chars <= 0.3::DOUBLE * line_chars AS kept FROM based
""".replace("BOILERPLATE", "|".join(line_rules.BOILERPLATE))


def remainder(divisor: int) -> Column:
    """crc32 of doc_id's text, modulo ``divisor``; null without an id."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(divisor))


def _marked(scored: DataFrame, held: Column, least: float, *more: Column) -> DataFrame:
    return scored.select(
        "doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= least).cast("int").alias("predicted"), *more,
    )


def op2_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    documents, labels = _read(spark, folder, "documents"), _read(spark, folder, "labels")
    net = quality_net.fit(documents, labels, remainder(5) != 0)
    return _marked(quality_net.score_texts(documents, net, ["doc_id"]), remainder(5) == 0, 0.3)


def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(_read(spark, folder, "documents"), _read(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


OP3_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS no, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words
  FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark
), sized AS (
  SELECT *, least(len(words), 10) AS n FROM items WHERE len(words) > 0
), windows AS (
  SELECT DISTINCT item_id, n, array_to_string(words[i : i + n - 1], ' ') AS w
  FROM (SELECT *, unnest(range(1, len(words) - n + 2)) AS i FROM sized)
), placed AS (
  SELECT no, n, i, array_to_string(words[i : i + n - 1], ' ') AS w
  FROM (SELECT no, words, n, unnest(range(1, len(words) - n + 2)) AS i
        FROM docs, (SELECT DISTINCT n FROM sized) WHERE len(words) >= n)
), hits AS (
  SELECT no, item_id, i, n FROM placed JOIN windows USING (n, w)
), covered AS (
  SELECT no, count(DISTINCT pos) AS n_hit FROM (SELECT no, unnest(range(i, i + n)) AS pos FROM hits) GROUP BY no
), named AS (
  SELECT no, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT no, item_id::VARCHAR AS id FROM hits) GROUP BY no
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN covered USING (no) LEFT JOIN named USING (no)
"""


def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    plan = mixing.mix(_read(spark, folder, "documents"))
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))
    return plan.select("*", each).select("doc_id", "size", "source_size", "target", "taken", "copies")


OP4_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, md5(text) AS digest,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         coalesce(len(regexp_extract_all(text, '[#*$%&|<>]')), 0) AS symbols
  FROM documents
), grouped AS (
  SELECT doc_id, source, digest, size, symbols, count(*) AS n
  FROM docs GROUP BY doc_id, source, digest, size, symbols
), items AS (
  SELECT *, size * n AS mass,
         -ln((('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(digest, '')), 1, 13))::BIGINT + 0.5::DOUBLE)
             / 4503599627370496::DOUBLE) / ((size + 1)::DOUBLE / (size + 1 + symbols)) AS key
  FROM grouped
), sources AS (
  SELECT source, sum(mass)::BIGINT AS s, ([3, 1, 2])[1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)] AS w,
         row_number() OVER (ORDER BY source NULLS LAST) AS no
  FROM items GROUP BY source
), rated AS (
  SELECT *, 2.0::DOUBLE * s / w AS ratio,
         (1.5::DOUBLE * sum(s) OVER ()::BIGINT - 2.0::DOUBLE * (sum(s) OVER upto - s)::BIGINT)
           / (sum(w) OVER () - (sum(w) OVER upto - w))::BIGINT AS rate
  FROM sources WINDOW upto AS (ORDER BY 2.0::DOUBLE * s / w, no ROWS UNBOUNDED PRECEDING)
), goals AS (
  SELECT source, s, CASE WHEN ratio > rate THEN w * (SELECT max(rate) FROM rated WHERE ratio > rate)
                         ELSE 2.0::DOUBLE * s END AS target
  FROM rated
), summed AS (
  SELECT i.*, s, target, CASE WHEN s = 0 THEN 0 ELSE floor(target / s)::BIGINT END AS epochs,
         (sum(mass) OVER (PARTITION BY i.source ORDER BY key, doc_id, digest ROWS UNBOUNDED PRECEDING))::BIGINT AS upto
  FROM items i JOIN goals g ON i.source IS NOT DISTINCT FROM g.source
), picked AS (
  SELECT *, CASE WHEN size = 0 THEN 0 ELSE
         least(greatest(floor((2 * (target - epochs * s - (upto - mass)) + size) / (2 * size)), 0), n) END AS more
  FROM summed
), rows_taken AS (
  SELECT *, epochs + CASE WHEN no.range < more THEN 1 ELSE 0 END AS copies FROM picked, range(picked.n) AS no
)
SELECT doc_id, size, s AS source_size, target, (size * copies)::BIGINT AS taken, copies::BIGINT AS copies
FROM rows_taken
"""


def op5_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = substring_dedup.remove_repeats(_read(spark, folder, "documents"), form="sha256")
    return rows.withColumnRenamed("kept", "kept_sha256")


OP5_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS no, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words
  FROM documents
), windows AS (
  SELECT no, doc_id, i, md5(array_to_string(words[i : i + 49], ' ')) AS w
  FROM (SELECT *, unnest(range(1, len(words) - 48)) AS i FROM docs WHERE len(words) >= 50)
), firsts AS (
  SELECT w, min(doc_id) AS first_id FROM windows GROUP BY w HAVING min(doc_id) < max(doc_id)
), gone AS (
  SELECT DISTINCT no, unnest(range(i, i + 50)) AS pos FROM windows JOIN firsts USING (w) WHERE doc_id > first_id
), counted AS (
  SELECT no, count(*) AS n, list(pos) AS positions FROM gone GROUP BY no
), placed AS (
  SELECT no, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM docs
), stay AS (
  SELECT no, string_agg(word, ' ' ORDER BY pos) AS body FROM placed ANTI JOIN gone USING (no, pos) GROUP BY no
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM docs LEFT JOIN counted USING (no) LEFT JOIN stay USING (no)
"""


def op6_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.near_duplicates(_read(spark, folder, "documents"))


def op7_sharding(spark: SparkSession, folder: str) -> DataFrame:
    rows = sharding.shard_rows(_read(spark, folder, "documents"), 16)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    rules = prepare(spark).createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = _read(spark, folder, "pages").select("page_id", "url")
    return url_filters.judge_urls(pages, rules).drop("url")


OP8_SQL = r"""
WITH tails AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS tail FROM pages
), parsed AS (
  SELECT page_id, row_number() OVER () AS no,
         coalesce(translate(regexp_extract(tail, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(tail, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM tails
), rules(h, p, v) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
         ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), fits AS (
  SELECT no, arg_max(h || p, len(h || p)) AS rule, arg_max(v, len(h || p)) AS v
  FROM parsed JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY no
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM parsed LEFT JOIN fits USING (no)
"""


def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.context_table(token_counts.length_histogram(_read(spark, folder, "documents")))


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Adds the language's calibrated threshold, and whether the score reaches it."""
    documents, labels = _read(spark, folder, "documents"), _read(spark, folder, "labels")
    net, common, by = toxicity.fit(documents, labels, remainder(3) != 1)
    scored = toxicity.score_texts(documents, net, ["doc_id", "lang"])
    threshold = toxicity.threshold_of(F.col("lang"), common, by)
    return _marked(
        scored, remainder(3) == 1, 0.7,
        threshold.alias("threshold"), (F.col("score") >= threshold).alias("rejected"),
    )


def op11_token_files(spark: SparkSession, folder: str) -> DataFrame:
    documents, place = _read(spark, folder, "documents"), scratch(spark, "token-ids")
    token_files.write_ids(documents, place)
    return token_files.read_ids(spark, place, form="crc32").withColumnRenamed("crc32", "ids_crc32")


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    rows = whitening.whole_vectors(_read(spark, folder, "embeddings"))
    whitened = whitening.whiten(rows, whitening.fit(rows), ["vec_id"])
    return whitened.withColumn("deviation", F.col("deviation").cast("long"))


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    turns = kept(prefix_trie.rank_turns(_read(spark, folder, "conversations")), "trie-turns")
    return prefix_trie.trie(*prefix_trie.rebuild(turns))


OP13_SQL = r"""
WITH crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM range(256) r(i))
), turns AS (
  SELECT conv_id AS c, md5(concat(len(coalesce(role, '')), ':', role, text)) AS digest, strlen(coalesce(text, '')) AS bytes,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(concat(len(coalesce(role, '')), ':', role, text))) AS r
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT c, n, c - c % 5 AS base,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                         lambda a, b: xor(a >> 8, t[1 + xor(a, b) % 256])), 4294967295) % 9 AS h
  FROM (SELECT c, count(*) AS n FROM turns GROUP BY c), crc_table
), plan AS (
  SELECT a.c, a.base, a.h, coalesce(least(a.h, b.n), 0) AS shared FROM convs a LEFT JOIN convs b ON b.c = a.base
), rebuilt AS (
  SELECT p.c, r AS pos, digest, bytes FROM plan p JOIN turns t ON t.c = p.base WHERE r <= shared
  UNION ALL SELECT p.c, r - h + shared, digest, bytes FROM plan p JOIN turns t ON t.c = p.c WHERE r > h
), prefixes AS (
  SELECT c, pos, bytes, string_agg(digest, '') OVER (PARTITION BY c ORDER BY pos) AS prefix FROM rebuilt
  UNION ALL SELECT c, 0, 0, '' FROM plan
), ended AS (
  SELECT prefix, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM (SELECT c, max_by(prefix, pos) AS prefix FROM prefixes GROUP BY c) GROUP BY prefix
), nodes AS (
  SELECT prefix, pos AS depth, min(c) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes FROM prefixes GROUP BY prefix, pos
), below AS (
  SELECT left(prefix, 32 * (depth - 1)::INT) AS prefix, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1
), marked AS (
  SELECT nodes.*, coalesce(n, 0) AS n_children FROM nodes LEFT JOIN below USING (prefix)
), subtrees AS (
  SELECT a.prefix, count(*) FILTER (d.n_children = 0) AS n_leaves, sum((d.n_convs - 1) * d.bytes)::BIGINT AS saved_tokens
  FROM marked a JOIN marked d ON starts_with(d.prefix, a.prefix) GROUP BY a.prefix
)
SELECT m.conv_id, m.depth, up.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves, saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM marked m JOIN subtrees USING (prefix) LEFT JOIN ended USING (prefix)
LEFT JOIN nodes up ON m.depth > 0 AND up.prefix = left(m.prefix, 32 * (m.depth - 1)::INT)
"""


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_decontamination": op3_decontamination,
    "op4_mixing": op4_mixing,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_sharding": op7_sharding,
    "op8_url_filters": op8_url_filters,
    "op9_token_counts": op9_token_counts,
    "op10_toxicity": op10_toxicity,
    "op11_token_files": op11_token_files,
    "op12_whitening": op12_whitening,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLES = {
    "op1_quality_rules": OP1_SQL, "op3_decontamination": OP3_SQL, "op4_mixing": OP4_SQL, "op5_substring_dedup": OP5_SQL,
    "op8_url_filters": OP8_SQL, "op13_prefix_trie": OP13_SQL,
}
