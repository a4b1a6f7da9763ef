"""The driver tables, and inventory-like views derived from all of their rows.

Each view is written once as SQL expressions that both engines understand;
``_DIALECT`` holds the few names that differ.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slimlake.session import cut

_DIALECT = {
    "octet_length(text)": "strlen(text)",
    "octet_length(html)": "strlen(html)",
    "sha2(text,256)": "sha256(text)",
    "cast(text AS binary)": "encode(text)",
}


@dataclass(frozen=True)
class View:
    source: str
    columns: dict[str, str]
    where: str | None = None
    group_by: list[str] = field(default_factory=list)

    def frame(self, source: DataFrame) -> DataFrame:
        rows = source.where(self.where) if self.where else source
        columns = [F.expr(text).alias(name) for name, text in self.columns.items()]
        if not self.group_by:
            return rows.select(*columns)
        return rows.groupBy(*self.group_by).agg(*columns).select(*self.columns)

    def sql(self) -> str:
        text = ", ".join(f"{e} AS {name}" for name, e in self.columns.items())
        text = f"SELECT {text} FROM {self.source}"
        if self.where:
            text += f" WHERE {self.where}"
        if self.group_by:
            text += f" GROUP BY {', '.join(self.group_by)}"
        for spark_name, duck_name in _DIALECT.items():
            text = text.replace(spark_name, duck_name)
        return text


_EXTENSIONS = (
    "jpg,png,gif,bmp,tiff,heic,webp,wav,aiff,flac,m4a,mp3,mp4,mov,mkv,ts,avi,jxl,JPEG,txt,"
    "opus,webm,m2ts,bin"
)
_DOC_PATH = (
    "concat(source,'/',lang,'/doc-',cast(doc_id AS string),'.',"
    f"split_part('{_EXTENSIONS}',',',cast(doc_id % 24 + 1 AS int)))"
)
_DOC = {
    "path": _DOC_PATH,
    "size": "cast(octet_length(text)*16 AS bigint)",
    "mod_time": "concat('2024-01-',right(concat('0',cast(doc_id % 28 + 1 AS string)),2),'T00:00:00Z')",
    "blake3": "CASE WHEN doc_id % 10 = 7 THEN NULL ELSE sha2(text,256) END",
}
_REASONS = (
    "video_tier_disabled,av1_tier_disabled,too_large_for_budget,video_too_short,"
    "no_gain,out_of_scope,needs_probe,unsupported"
)
_PROBE = """concat('{"format":{"format_name":"',
 CASE WHEN event_id % 10 = 4 THEN '' ELSE 'mov,,mp4' END, '"',
 CASE WHEN event_id % 19 = 5 THEN '' ELSE concat(',"duration":"',cast(event_id % 300 AS string),'.5"') END,
 CASE WHEN event_id % 23 = 7 THEN ',"bit_rate":"N/A"'
      ELSE concat(',"bit_rate":"',cast(cast(floor(value*100000) AS bigint) AS string),'"') END,
 '},"streams":[',
 CASE WHEN event_id % 29 = 3 THEN '{"codec_type":"data"}' ELSE concat(
   '{"codec_type":"video","codec_name":"',
   split_part('h264,hevc,av1,rawvideo,prores',',',cast(event_id % 5 + 1 AS int)),
   CASE WHEN event_id % 4 = 0 THEN '","width":3840,"height":2160' ELSE '","width":1920,"height":1080' END,
   CASE event_id % 11 WHEN 0 THEN ',"color_transfer":"smpte2084"' WHEN 1 THEN ',"color_transfer":"arib-std-b67"'
                      WHEN 2 THEN ',"color_transfer":"bt709"' ELSE '' END,
   CASE WHEN event_id % 6 = 1 THEN concat(',"bit_rate":"',cast(event_id % 7 * 500000 AS string),'"') ELSE '' END,
   CASE event_id % 13 WHEN 0 THEN ',"side_data_list":[{"side_data_type":"DOVI configuration record"}]'
                      WHEN 1 THEN ',"side_data_list":[{"side_data_type":"Display Matrix"}]' ELSE '' END,
   '}') END,
 CASE WHEN event_id % 17 = 0 THEN ',{"codec_type":"video","codec_name":"mjpeg","width":320,"height":240}' ELSE '' END,
 CASE event_id % 3 WHEN 0 THEN ',{"codec_type":"audio","codec_name":"aac"}'
                   WHEN 1 THEN ',{"codec_type":"audio","codec_name":"alac"}' ELSE '' END,
 CASE WHEN event_id % 7 = 0 THEN ',{"codec_type":"subtitle","codec_name":"mov_text"}' ELSE '' END,
 ']}')"""

# Leading bytes as hex, put before each document's own bytes.
_MAGIC = {
    0: "'89504E470D0A1A0A'",
    1: "'FFD8FFE0'",
    2: "'474946383961'",
    3: "'5249464600000000574542505650384C'",
    4: "'52494646000000005745425056503820'",
    5: "'52494646000000005745425056503858'",
    6: "'49492A00'",
    7: "'4D4D002A'",
    8: "'424D00000000000000000000000028000000'",
    9: "'424D00000000000000000000000029000000'",
    10: "'000000186674797068656963'",
    11: "'000000186674797061766966'",
    12: "'00000018667479706D703432'",
    13: "'FF0A'",
    14: "'0000000C4A584C200D0A870A'",
    15: "repeat(concat('47',repeat('00',187)),8)",
    16: "concat('47',repeat('00',187),'46',repeat('00',700))",
    17: "'474946'",
    18: "''",
}
_MAGIC_SQL = (
    "CASE doc_id % 20 " + " ".join(f"WHEN {k} THEN {v}" for k, v in _MAGIC.items()) + " ELSE '424D' END"
)
_DONE = "(l_orderkey+l_linenumber) % 10 < 6"
_LINE_PATH = (
    "concat('s',cast(max(l_suppkey) AS string),'/',max(l_returnflag),'/',"
    "cast(l_orderkey AS string),'-',cast(l_linenumber AS string),'.jpg')"
)
_LINE_OUT = _LINE_PATH.replace("'.jpg'", "'.jxl'")

VIEWS: dict[str, View] = {
    "f_docs": View("documents", _DOC),
    "f_ledger": View(
        "documents",
        {
            "doc_id": "doc_id",
            **_DOC,
            "state": "CASE doc_id % 10 WHEN 0 THEN 'done' WHEN 1 THEN 'failed' WHEN 2 THEN 'claimed' "
            "WHEN 3 THEN 'pending' ELSE 'skipped' END",
            "skip_reason": "CASE WHEN doc_id % 10 = 1 THEN concat('error ',cast(doc_id % 7 AS string)) "
            f"WHEN doc_id % 10 > 3 THEN split_part('{_REASONS}',',',cast(doc_id % 8 + 1 AS int)) END",
            "output_path": f"CASE WHEN doc_id % 20 = 0 THEN {_DOC_PATH} "
            f"WHEN doc_id % 10 = 0 THEN concat({_DOC_PATH},'.out') END",
            "output_size": "CASE WHEN doc_id % 10 = 0 THEN cast(octet_length(text)*12 AS bigint) END",
            "crf_hint": "CASE WHEN doc_id % 3 = 0 THEN cast(doc_id % 64 AS int) END",
            "crf_hint_preset": "CASE doc_id % 9 WHEN 0 THEN 3 WHEN 3 THEN 4 WHEN 6 THEN 6 END",
        },
    ),
    # The second snapshot: a part is gone, a part resized, a part is new.
    "f_listing": View(
        "documents",
        {
            "path": f"CASE WHEN doc_id % 40 = 9 THEN concat('src1/new/',cast(doc_id AS string),'.png') ELSE {_DOC_PATH} END",
            "size": "cast(CASE WHEN doc_id % 60 = 0 THEN octet_length(text)*12 WHEN octet_length(text) % 5 = 0 THEN octet_length(text)*16 + 1 ELSE octet_length(text)*16 END AS bigint)",
            "mod_time": "'2024-02-01T00:00:00Z'",
            "blake3": "sha2(text,256)",
        },
        where="(source IN ('src1','src2') AND octet_length(text) % 3 <> 0) OR doc_id % 40 = 9",
    ),
    "f_lines": View(
        "lineitem",
        {
            "path": _LINE_PATH,
            "size": "cast(floor(max(l_extendedprice)*100) AS bigint)",
            "output_size": "cast(floor(max(l_extendedprice*(1-l_discount))*100) AS bigint)",
            "state": "CASE (l_orderkey+l_linenumber) % 10 WHEN 6 THEN 'pending' WHEN 7 THEN 'skipped' "
            "WHEN 8 THEN 'failed' WHEN 9 THEN 'claimed' ELSE 'done' END",
            "trashed_at": "max(l_shipdate)",
            "reclaimed": "cast(CASE WHEN l_orderkey % 3 = 0 THEN 1 ELSE 0 END AS int)",
            "fidelity": "CASE WHEN l_linenumber % 2 = 0 THEN 'byte-exact' ELSE 'content-exact' END",
            "recipe": "CASE WHEN l_linenumber % 2 = 0 THEN 'jxl-from-jpeg' ELSE "
            "split_part('jxl-from-raster,ffv1,ts-remux,av1,flac',',',cast(l_orderkey % 5 + 1 AS int)) END",
            "output_path": f"CASE WHEN {_DONE} THEN {_LINE_OUT} END",
            "skip_reason": "CASE (l_orderkey+l_linenumber) % 10 WHEN 7 THEN 'no_gain' WHEN 8 THEN "
            "concat('encoder stopped with code ',cast(l_orderkey % 7 AS string),"
            "' after the quality gate refused every attempt; sample ',cast(max(l_suppkey) % 3 AS string),', order ',cast(l_orderkey AS string)) END",
        },
        group_by=["l_orderkey", "l_linenumber"],
    ),
    "f_pages": View(
        "pages",
        {
            "page_id": "page_id",
            "path": r"regexp_extract(url,'^https?://[^/]+/([^?#]*)',1)",
            "size": "cast(octet_length(html) AS bigint)",
        },
    ),
    "f_probe": View(
        "events",
        {
            "event_id": "event_id",
            "path": "concat('clips/e-',cast(event_id AS string),'.',split_part('mp4,mov,mkv,ts,avi,m4a',',',cast(event_id % 6 + 1 AS int)))",
            "size": "cast(floor(value*100000) AS bigint)",
            "probe": _PROBE,
        },
    ),
    "f_scores": View(
        "events",
        {
            "item": "user_id",
            "frame": "event_id",
            "score": "100 - value/50",
            "preset": "cast(CASE event_id % 3 WHEN 0 THEN 3 WHEN 1 THEN 4 ELSE 6 END AS int)",
            "value": "value",
        },
    ),
    "f_jobs": View(
        "events",
        {
            "path": "concat('job-',cast(user_id AS string))",
            "seq": "event_id",
            "ts": "ts",
            "state": "CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'claimed' "
            "WHEN 'click' THEN 'skipped' WHEN 'error' THEN 'failed' ELSE 'done' END",
            "bytes": "cast(floor(value*100) AS bigint)",
        },
    ),
    "f_heads": View(
        "documents",
        {
            "doc_id": "doc_id",
            "path": _DOC_PATH,
            "size": "cast(octet_length(text)*16 AS bigint)",
            "magic": _MAGIC_SQL,
            "text": "text",
        },
    ),
}

_LITERAL_VIEWS: dict[str, str] = {}


def literal_view(name: str, sql: str) -> None:
    """Register an oracle-side view (a lookup table or a shared step)."""
    _LITERAL_VIEWS[name] = sql


def with_views(sql: str) -> str:
    """Put the views a query mentions, and those they mention, in front of it."""
    wanted: list[str] = []

    def visit(text: str) -> None:
        for name, body in {**{n: v.sql() for n, v in VIEWS.items()}, **_LITERAL_VIEWS}.items():
            if name not in wanted and re.search(rf"\b{name}\b", text):
                visit(body)
                if name not in wanted:
                    wanted.append(name)

    visit(sql)
    if not wanted:
        return sql.strip()
    bodies = {**{n: v.sql() for n, v in VIEWS.items()}, **_LITERAL_VIEWS}
    ctes = ",\n".join(f"{name} AS ({bodies[name]})" for name in wanted)
    rest = sql.strip()
    if rest.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{rest[15:]}"
    if rest.upper().startswith("WITH "):
        return f"WITH {ctes},\n{rest[5:]}"
    return f"WITH {ctes}\n{rest}"


class Tables:
    """Tables and views of one scale-factor folder as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("__"):
            raise AttributeError(name)
        if name in VIEWS:
            view = VIEWS[name]
            return self._finish(name, view.frame(getattr(self, view.source)))
        return self.spark.read.parquet(self.path(name))

    def stored(self, name: str) -> DataFrame:
        """A view written once, for queries that read it several times."""
        return cut(getattr(self, name))

    def _finish(self, name: str, df: DataFrame) -> DataFrame:
        if name == "f_heads":
            head = F.concat(F.unhex("magic"), F.col("text").cast("binary"))
            return df.select("doc_id", "path", "size", F.substring(head, 1, 1504).alias("head"))
        if name == "f_jobs":
            # Streams need an instant, not a wall-clock time; the session zone is UTC.
            return df.withColumn("ts", F.col("ts").cast("timestamp"))
        return df


literal_view(
    "f_bytes",
    "SELECT doc_id, path, size, substr(concat(magic, hex(encode(text))), 1, 3008) AS h, "
    "least(strlen(magic)//2 + strlen(text), 1504) AS n FROM f_heads",
)
