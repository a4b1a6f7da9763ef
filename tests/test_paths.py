from __future__ import annotations

import re

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from slimlake.functions import globs, paths, text
from slimlake.operators.scope import Scope, scope_totals, union_of_scopes
from slimlake.operators import scope as scope_module
from tests.conftest import rows


def evaluate(spark, values, expression, type_name="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {type_name}")
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


def test_normalize_and_join(spark):
    assert evaluate(spark, ["/a/b/", "a", "///", ""], paths.normalize("v")) == ["a/b", "a", "", ""]
    joined = paths.join(F.lit("/base/"), "v")
    assert evaluate(spark, ["/x", "", "/"], joined) == ["base/x", "base", "base"]
    assert evaluate(spark, ["/x/", ""], paths.join(F.lit(""), "v")) == ["x", ""]


def test_extension(spark):
    names = ["a.jpg", "d.x/plain", ".hidden", "a/.hidden", "a/.h.PNG", "x.tar.gz", "end.", "a.b/", "n"]
    assert evaluate(spark, names, paths.extension("v")) == ["jpg", "", "", "", "PNG", "gz", "", "b", ""]


def test_swap_extension(spark):
    names = ["d/a.jpg", "d.x/plain", ".hidden", "d/.hidden", "x.tar.gz", "end.", "a.b/"]
    assert evaluate(spark, names, paths.swap_extension("v", F.lit("jxl"))) == [
        "d/a.jxl", "d.x/plain.jxl", ".hidden.jxl", "d/.hidden.jxl", "x.tar.jxl", "end.jxl", "a.jxl",
    ]


def test_safe_relative(spark):
    names = ["/etc/x", "./a//b", "a/./b", "..", "a/../b", "", "/", "a..b/c"]
    assert evaluate(spark, names, paths.safe_relative("v", strict=False)) == [
        "etc/x", "a/b", "a/b", None, None, None, None, "a..b/c",
    ]
    with pytest.raises(PySparkException):
        evaluate(spark, ["a/../b"], paths.safe_relative("v"))


def test_scope_stops_at_a_segment(spark):
    scope = Scope(("/atlas/", "tapes"))
    names = ["atlas/north", "atlas", "atlas.old/north", "atlases", "tapes/1/2", "Atlas/north", "x/atlas"]
    assert evaluate(spark, names, scope.contains("v")) == [True, True, False, False, True, False, False]
    assert evaluate(spark, names, Scope(("/",)).contains("v")) == [True] * 7


def test_prefix_with_like_wildcards(spark):
    names = ["50%_a/x", "50xya/x", "500_a/x"]
    assert evaluate(spark, names, Scope(("50%_a",)).contains("v")) == [True, False, False]
    assert paths.like_literal("a\\b%c_") == "a\\\\b\\%c\\_"


@pytest.mark.parametrize(
    "pattern, path, hit",
    [
        ("**/tmp-[0-9]/**", "lab/tmp-4/run.log", True),
        ("**/tmp-[0-9]/**", "lab/old/tmp-4/x/y/run.log", True),
        ("**/tmp-[0-9]/**", "tmp-4/run", True),
        ("**/tmp-[0-9]/**", "lab/tmp-x/run.log", False),
        ("**/*.Log", "lab/run.Log", True),
        ("**/*.Log", "run.Log", True),
        ("**/*.Log", "run.log", False),
        ("*.csv", "one/two/three.csv", True),
        ("a?c", "a/c", True),
        ("a/**/b", "a/b", True),
        ("a/**/b", "a/x/y/b", True),
        ("a/**/b", "axb", False),
        ("[a-c]x", "bx", True),
        ("[!a-c]x", "bx", False),
        ("[]x]y", "]y", True),
        ("{src1,src2}/*.png", "src2/a.png", True),
        ("{a,b{c,d}}", "bd", True),
        ("a\\*b", "a*b", True),
        ("a\\*b", "axb", False),
        ("a.b", "axb", False),
        ("x,y", "x,y", True),
    ],
)
def test_globs(pattern, path, hit):
    # Python spells the end-of-text anchor \Z.
    assert bool(re.match(globs.to_regex(pattern).replace(r"\z", r"\Z"), path)) is hit


def test_globs_in_spark(spark):
    scope = Scope(("/lab",), ("**/tmp-?/**", "**/[p-r&&s]z"))
    names = ["lab/m", "lab/tmp-1/m", "lab/pz", "lab/&z", "lab/sz", "desk/m"]
    assert evaluate(spark, names, scope.allows("v")) == [True, False, False, False, False, False]


@pytest.mark.parametrize("pattern", ["logs/[0-9", "{x,{y,z}", "end}}", "tail\\", "[9-0]"])
def test_malformed_globs_are_reported(pattern):
    with pytest.raises(globs.BadGlob):
        Scope(excludes=(pattern,))


def test_scope_totals_count_nested_folders_twice(spark):
    df = spark.createDataFrame([("a/b/x", 1), ("a/y", 2), ("c/z", 4)], "path string, size long")
    assert rows(scope_totals(df, ["a", "a/b", "/c/", "none"]).select("scope", "files", "bytes")) == [
        ("a", 2, 3), ("a/b", 1, 1), ("c", 1, 4),
    ]


def test_union_of_scopes_keeps_the_later_listing(spark):
    first = spark.createDataFrame([("a", 1), ("b", 2)], "path string, size long")
    second = spark.createDataFrame([("b", 3)], "path string, size long")
    assert rows(union_of_scopes([first, second])) == [("a", 1), ("b", 3)]


def test_redaction(spark):
    lines = [
        "tool --rc-pass abc --fast", "tool --rc-user u pass w", "tool --API-KEY 'two words' -v",
        "--token --key x", "tool --token",
    ]
    assert evaluate(spark, lines, text.redact("v")) == [
        "tool --rc-pass <redacted> --fast", "tool --rc-user u pass w",
        "tool --API-KEY <redacted> -v", "--token <redacted> x", "tool --token",
    ]


def test_settings_of_reports(spark):
    reports = [
        "note: crf 9.5 is only a guess\ncrf 17.25 settled after two rounds",
        "crf 18.5 even", "crf 18.75 up", "crf 19.5 up", "crf 400 top", "crf -7 no", "crf NaN no",
        "crf 11 first\ncrf 50 second\ncrf 13 third", "silence", "   crf 21 indented",
    ]
    assert evaluate(spark, reports, text.last_setting("v")) == [17, 18, 19, 20, 63, None, None, 13, None, 21]


def test_frame_hash_dump_ignores_the_header(spark):
    body = "0, 0, 0, 1, 9, aaa\r\n0, 1, 1, 1, 9,  bbb \n\n"
    dumps = ["#sar 0: 1/1\n" + body, "#sar 0: 0/1\n#x\n" + body]
    assert evaluate(spark, dumps, text.hash_lines("v")) == ["aaa\nbbb", "aaa\nbbb"]
    empty = ["", "#only a header\n\n"]
    assert evaluate(spark, empty, text.hash_lines("v", strict=False)) == [None, None]
    with pytest.raises(PySparkException, match="without frames"):
        evaluate(spark, empty, text.hash_lines("v"))


def test_unknown_state_is_an_error(spark):
    assert evaluate(spark, ["done"], text.valid_state("v")) == ["done"]
    for bad in ("finished", None):
        with pytest.raises(PySparkException):
            evaluate(spark, [bad], text.valid_state("v"))


def test_many_scopes_equal_one_predicate_each(spark):
    paths = ["en/a/x", "en/a", "en", "en/ab/y", "fr/x", "top", "de/1/2/3/4", "de/1/2/3", "en/a/x"]
    df = spark.createDataFrame([(p, i + 1) for i, p in enumerate(paths)], "path string, size long")
    scopes = ["/en/", "en/a", "en", "fr", "de/1/2/3", "none", "top", None, "en/a/x"]
    table = spark.createDataFrame([(s,) for s in scopes], "scope string")
    named = sorted({s.strip("/") for s in scopes if s})
    got = {r.scope: (r.files, r.bytes) for r in scope_module.totals_by_scope(df, table).collect()}
    assert got == {r.scope: (r.files, r.bytes) for r in scope_module.scope_totals(df, named).collect()}
    inside = rows(scope_module.within_scopes(df, table))
    assert inside == rows(df.where(scope_module.Scope(tuple(named)).contains("path")))
    pairs = rows(scope_module.matching_scopes(df, table).select("path", "scope").distinct())
    assert ("de/1/2/3/4", "de/1/2/3") in pairs and ("en/ab/y", "en/a") not in pairs
    everything = spark.createDataFrame([("/",)], "scope string")
    assert scope_module.totals_by_scope(df, everything).first().files == len(paths)


def test_ten_thousand_scopes_are_one_join(spark):
    df = spark.range(2000).selectExpr("concat('d', id % 200, '/e', id, '/f') AS path", "id AS size")
    table = spark.range(10_000).selectExpr("concat('d', id % 500, '/e', id) AS scope")
    found = scope_module.totals_by_scope(df, table)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 2
    assert found.count() == sum(k % 200 == k % 500 for k in range(2000))
