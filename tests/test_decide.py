"""The rule table, case by case."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from slimlake import constants as K
from slimlake.functions import sniff
from slimlake.operators import decide
from slimlake.operators.decide import Limits
from slimlake.schemas import PROBE
from tests.conftest import rows

BIG = 10_000_000
OPEN = Limits()


def video(codec="h264", w=1920, h=1080, rate=12_000_000, transfer=None, dovi=False):
    return (codec, w, h, transfer, rate, dovi)


def probe(*streams, secs=120.0, rate=None, audio=()):
    return (["mov"], secs, rate, list(streams), list(audio), 0)


def judge(spark, cases, limits=OPEN):
    """``cases``: (path, size, head, probe) -> verdict per case, in order."""
    df = spark.createDataFrame(
        [(i, *c) for i, c in enumerate(cases)],
        f"i int, path string, size long, head binary, probe {PROBE.simpleString()}",
    )
    decided = decide.with_decision(df, limits, head="head", probe="probe").orderBy("i")
    out = []
    for row in decided.collect():
        assert (row.recipe is None) != (row.skip_reason is None)
        out.append(row.recipe or row.skip_reason)
    return out


def by_name(spark, path, size=BIG, limits=OPEN):
    df = spark.createDataFrame([(path, size)], "path string, size long")
    row = decide.with_decision(df, limits).first()
    return row.recipe or row.skip_reason


def test_every_extension_reaches_its_kind(spark):
    want = {e: k for k, es in K.KIND_EXTENSIONS.items() for e in es}
    assert len(want) == 45
    df = spark.createDataFrame([(f"d/x.{e.upper()}", k) for e, k in want.items()], "path string, k string")
    assert df.where(decide.kind_of("path") != F.col("k")).count() == 0


def test_names_alone(spark):
    cases = {
        "a.jpg": "jxl-from-jpeg", "a.png": "jxl-from-raster", "a.heic": "already_optimal",
        "a.webp": "needs_probe", "a.wav": "flac", "a.flac": "flac-recompress", "a.m4a": "needs_probe",
        "a.mp3": "lossy_no_gain", "a.mp4": "needs_probe", "a.txt": "unsupported", "a": "unsupported",
    }
    df = spark.createDataFrame([(p, BIG, v) for p, v in cases.items()], "path string, size long, want string")
    decided = decide.with_decision(df, OPEN)
    assert decided.where(F.coalesce("recipe", "skip_reason") != F.col("want")).count() == 0


def test_size_gates_come_first(spark):
    assert by_name(spark, "a.heic", 4095) == "too_small"
    assert by_name(spark, "a.jpg", 4096) == "jxl-from-jpeg"
    assert by_name(spark, "a.jpg", 101_000, Limits(max_file_bytes=100_000)) == "too_large_for_budget"
    assert by_name(spark, "a.txt", 10, Limits(max_file_bytes=5)) == "too_small"


WEBP = b"RIFF\0\0\0\0WEBP"
TS = (b"\x47" + b"\0" * 187) * 8


def test_bytes_win_over_names(spark):
    cases = [
        ("a.png", BIG, WEBP + b"VP8L", None), ("a.png", BIG, WEBP + b"VP8 ", None),
        ("a.webp", BIG, WEBP + b"VP8X", None), ("a.webp", BIG, b"\x89PNG\r\n\x1a\n", None),
        ("a.jpg", BIG, b"unknown bytes", None), ("a.heic", BIG, b"\xff\xd8\xff\xe0", None),
        ("a.txt", BIG, b"\xff\xd8\xff\xe0", None), ("a.webp", BIG, b"RIFF", None),
        ("a.ts", BIG, b"import x from 'y'" * 100, probe(video())), ("a.ts", BIG, TS, probe(video())),
    ]
    assert judge(spark, cases) == [
        "jxl-from-webp", "lossy_no_gain", "lossy_no_gain", "jxl-from-raster", "jxl-from-jpeg",
        "jxl-from-jpeg", "unsupported", "lossy_no_gain", "unsupported", "av1",
    ]


def test_m4a_needs_its_codec(spark):
    cases = [("a.m4a", BIG, None, probe(audio=["alac"])), ("a.m4a", BIG, None, probe(audio=["aac"])), ("a.m4a", BIG, None, None)]
    assert judge(spark, cases) == ["flac-recompress", "lossy_no_gain", "needs_probe"]


VIDEO_CASES = [
    (probe(), "unsupported", "unsupported"),
    (probe(video(), video()), "video_complex_structure", "video_complex_structure"),
    (probe(video("ffv1", transfer="smpte2084")), "ffv1", "ffv1"),
    (probe(video("prores")), "av1", "av1"),
    (probe(video(transfer="smpte2084")), "video_hdr", "ts-remux"),
    (probe(video(transfer="arib-std-b67")), "video_hdr", "ts-remux"),
    (probe(video(transfer="bt709")), "av1", "av1"),
    (probe(video(dovi=True)), "video_hdr", "ts-remux"),
    (probe(video("av1")), "video_already_av1", "ts-remux"),
    (probe(video(), secs=9.9), "video_too_short", "ts-remux"),
    (probe(video(), secs=10.0), "av1", "av1"),
    (probe(video(), secs=None), "av1", "av1"),
    (probe(video(rate=1_900_000)), "video_low_bitrate", "ts-remux"),
    (probe(video(rate=None), rate=1_900_000), "video_low_bitrate", "ts-remux"),
    (probe(video(rate=None)), "av1", "av1"),
    (probe(video(w=0, h=0, rate=1)), "av1", "av1"),
    (None, "needs_probe", "needs_probe"),
]


def test_video_rules(spark):
    limits = Limits(min_video_secs=10.0)
    plain = judge(spark, [("a.mp4", BIG, None, p) for p, _, _ in VIDEO_CASES], limits)
    assert plain == [want for _, want, _ in VIDEO_CASES]
    stream = judge(spark, [("a.ts", BIG, TS, p) for p, _, _ in VIDEO_CASES], limits)
    assert stream == [want for _, _, want in VIDEO_CASES]


def test_tiers(spark):
    off, lossless = Limits(allow_video=False), Limits(allow_av1=False)
    cases = [("a.mp4", BIG, None, probe(video())), ("a.ts", BIG, TS, probe(video())), ("a.mkv", BIG, None, probe(video("ffv1")))]
    assert judge(spark, cases, off) == ["video_tier_disabled"] * 3
    assert judge(spark, cases, lossless) == ["av1_tier_disabled", "ts-remux", "ffv1"]
    assert by_name(spark, "a.mov", limits=off) == "video_tier_disabled"


def test_every_recipe_and_reason_is_reachable(spark):
    seen = {by_name(spark, f"a.{e}") for e in ("jpg", "png", "wav", "flac", "heic", "mp3", "txt", "webp")}
    seen |= {by_name(spark, "a.jpg", 1), by_name(spark, "a.jpg", 9_000, Limits(max_file_bytes=8_000))}
    seen |= set(judge(spark, [("a.ts", BIG, TS, p) for p, _, _ in VIDEO_CASES], Limits(min_video_secs=10.0)))
    seen |= set(judge(spark, [("a.mp4", BIG, None, p) for p, _, _ in VIDEO_CASES], Limits(min_video_secs=10.0)))
    seen |= set(judge(spark, [("a.webp", BIG, WEBP + b"VP8L", None)]))
    seen |= set(judge(spark, [("a.mp4", BIG, None, probe(video()))], Limits(allow_av1=False)))
    seen |= set(judge(spark, [("a.mp4", BIG, None, None)], Limits(allow_video=False)))
    # A lack of gain is measured, not decided.
    assert set(K.RECIPES) | set(K.SKIP_REASONS) == seen | {"no_gain"}


def test_two_steps_agree_with_one(spark):
    cases = [
        ("a.png", BIG, WEBP + b"VP8L"), ("b.jpg", BIG, None), ("c.mp4", BIG, None), ("d.heic", BIG, b"\xff\xd8\xff"),
        ("e.txt", BIG, b"\xff\xd8\xff"), ("f.webp", BIG, WEBP + b"VP8L"),
    ]
    files = spark.createDataFrame([(p, s) for p, s, _ in cases], "path string, size long")
    heads = spark.createDataFrame([(p, h) for p, _, h in cases if h], "path string, head binary")
    probes = spark.createDataFrame([("c.mp4", probe(video()))], f"path string, probe {PROBE.simpleString()}")
    out = decide.decide_in_two_steps(files, OPEN, heads, probes)
    got = {r.path: r.recipe or r.skip_reason for r in out.collect()}
    # A skip by name is final, so the bytes of d are never looked at.
    assert got == {
        "a.png": "jxl-from-webp", "b.jpg": "jxl-from-jpeg", "c.mp4": "av1", "d.heic": "already_optimal",
        "e.txt": "unsupported", "f.webp": "jxl-from-webp",
    }


def test_projected_saving(spark):
    sizes = {"a.jpg": 2000, "b.webp": 700, "c.mp4": 3000, "d.mp3": 0, "e.m4a": 3000}
    df = spark.createDataFrame([(p, 10_000) for p in sizes], "path string, size long")
    got = {r.path: r.projected_saving for r in decide.with_projected_saving(df).collect()}
    assert got == sizes


@pytest.mark.parametrize(
    "recipe, keep, mib",
    [("jxl-from-jpeg", False, 1844), ("flac", False, 1536), ("ffv1", False, 2560), ("av1", False, 1690),
     ("jxl-from-jpeg", True, 2868), ("av1", True, 1690), ("ffv1", True, 2560), ("ts-remux", False, 1997)],
)
def test_reservation(spark, recipe, keep, mib):
    df = spark.createDataFrame([(recipe, 1 << 30)], "recipe string, size long")
    assert df.select(decide.reservation_mib("recipe", "size", keep)).first()[0] == mib


def test_reopened_by_settings():
    base = ["too_large_for_budget", "video_too_short"]
    assert decide.reopened_by(False, False) == base
    assert decide.reopened_by(True, False) == ["video_tier_disabled", *base]
    assert decide.reopened_by(False, True) == ["av1_tier_disabled", *base]


def test_output_extension_keeps_the_container(spark):
    cases = [("av1", "MOV", "mov"), ("av1", "webm", "mkv"), ("av1", "avi", "mp4"), ("ts-remux", "ts", "mp4"),
             ("ffv1", "mp4", "mkv"), ("flac-recompress", "m4a", "flac"), ("jxl-from-webp", "png", "jxl")]
    df = spark.createDataFrame(cases, "r string, e string, want string")
    assert df.where(decide.output_extension("r", "e") != F.col("want")).count() == 0


def test_sniffing_edges(spark):
    bmp = b"BM" + b"\0" * 12
    cases = [
        (bmp + b"\x28\0\0\0", "bmp"), (bmp + b"\x29\0\0\0", None), (b"BMW is a car, and more text", None),
        (b"GIF", None), (b"GIF89a", "gif"), (b"RIFF1234WEB", None), (b"\0\0\0\x18ftypavis", "heif"),
        (b"\0\0\0\x18ftypmp42", None), (b"\xff\x0a", "jxl"), (b"\0\0\0\x0cJXL \r\n\x87\n", "jxl"),
        (b"II*\0", "tiff"), (b"MM\0*", "tiff"), (b"MM*\0", None), (b"", None), (None, None),
    ]
    df = spark.createDataFrame(cases, "head binary, want string")
    bad = df.where(~sniff.sniff_image("head").eqNullSafe(F.col("want")))
    assert rows(bad) == []
    ts = spark.createDataFrame([(TS[:752], True), (TS[:751], False), (b"G" * 10, False), (None, False)], "h binary, want boolean")
    assert ts.where(sniff.is_mpeg_ts("h") != F.col("want")).count() == 0
