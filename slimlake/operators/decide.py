"""The rule table: every file gets a recipe or a named reason."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slimlake import constants as K
from slimlake.functions import media, paths, sizes, sniff
from slimlake.functions.columns import col, lookup, once

_EXTENSION_KIND = {ext: kind for kind, exts in K.KIND_EXTENSIONS.items() for ext in exts}
_RATIO = {recipe: facts[0] for recipe, facts in K.RECIPES.items()}
_PEAK = {recipe: facts[1] for recipe, facts in K.RECIPES.items()}
_HOLDS = [recipe for recipe, facts in K.RECIPES.items() if facts[2]]


@dataclass(frozen=True)
class Limits:
    max_file_bytes: int = 2**63 - 1
    allow_video: bool = True
    allow_av1: bool = True
    min_video_secs: float = 0.0


UNBOUNDED = Limits()


def plan_limits(limits: Limits) -> Limits:
    """A projection keeps the video tier on and the lossy tier off."""
    return replace(limits, allow_video=True, allow_av1=False)


# -- kinds -------------------------------------------------------------------


def kind_of(path) -> Column:
    """What the extension suggests."""
    return F.coalesce(lookup(F.lower(paths.extension(path)), _EXTENSION_KIND), F.lit(K.OTHER_KIND))


def is_image(kind) -> Column:
    return col(kind).isin(*K.IMAGE_KINDS)


def is_video(kind) -> Column:
    return col(kind).isin(*K.VIDEO_KINDS)


def confirmed_kind(kind, head) -> Column:
    """The kind after looking at the bytes, which win over the name."""
    kind, head = col(kind), col(head)
    false_ts = (kind == "mpeg_ts") & head.isNotNull() & ~sniff.is_mpeg_ts(head)
    named = F.when(is_image(kind), lookup(sniff.sniff_image(head), K.FORMAT_KINDS))
    return F.when(false_ts, F.lit(K.OTHER_KIND)).otherwise(F.coalesce(named, kind))


# -- verdicts ----------------------------------------------------------------


def _video_verdict(kind: Column, probe: Column | None, limits: Limits) -> Column:
    if not limits.allow_video:
        return F.lit("video_tier_disabled")
    if probe is None:
        return F.lit("needs_probe")
    video = media.first_video(probe)
    refused = (
        F.when(media.is_hdr(video), "video_hdr")
        .when(video["codec"] == "av1", "video_already_av1")
        .when(probe["duration_secs"] < F.lit(float(limits.min_video_secs)), "video_too_short")
        .when(
            media.is_already_lean(media.pixels(video), media.video_bit_rate(probe)),
            "video_low_bitrate",
        )
    )
    if not limits.allow_av1:
        refused = refused.otherwise("av1_tier_disabled")
    # A transport stream that is refused still gets its container overhead back.
    lossy = F.when(refused.isNull(), "av1").when(kind == "mpeg_ts", "ts-remux").otherwise(refused)
    return (
        F.when(probe.isNull(), "needs_probe")
        .when(F.size(probe["video"]) == 0, "unsupported")
        .when(F.size(probe["video"]) > 1, "video_complex_structure")
        .when(media.is_lossless_codec(video["codec"]), "ffv1")
        .otherwise(lossy)
    )


def verdict(kind, size, limits: Limits, head=None, probe=None) -> Column:
    """Recipe or reason name; ``head`` and ``probe`` are null where not known.

    ``kind`` is already confirmed against the bytes where those are at hand.
    """
    kind, size = col(kind), col(size)
    probe = None if probe is None else col(probe)
    webp = m4a = F.lit("needs_probe")
    if head is not None:
        webp = (
            F.when(col(head).isNull(), "needs_probe")
            .when(sniff.is_lossless_webp(head), "jxl-from-webp")
            .otherwise("lossy_no_gain")
        )
    if probe is not None:
        m4a = (
            F.when(probe.isNull(), "needs_probe")
            .when(F.array_contains(probe["audio_codecs"], "alac"), "flac-recompress")
            .otherwise("lossy_no_gain")
        )
    return (
        F.when(size < K.MIN_USEFUL_BYTES, "too_small")
        .when(size > F.lit(limits.max_file_bytes), "too_large_for_budget")
        .when(kind == "jpeg", "jxl-from-jpeg")
        .when(kind.isin("png", "gif", "bmp", "tiff"), "jxl-from-raster")
        .when(kind == "efficient_image", "already_optimal")
        .when(kind == "webp", webp)
        .when(kind.isin("wav", "aiff"), "flac")
        .when(kind == "flac", "flac-recompress")
        .when(kind == "m4a", m4a)
        .when(kind == "lossy_audio", "lossy_no_gain")
        .when(is_video(kind), _video_verdict(kind, probe, limits))
        .otherwise("unsupported")
    )


def split_verdict(name="verdict") -> tuple[Column, Column]:
    """``(recipe, skip_reason)``, exactly one of which is set."""
    is_recipe = col(name).isin(*K.RECIPES)
    return (
        F.when(is_recipe, col(name)).alias("recipe"),
        F.when(~is_recipe, col(name)).alias("skip_reason"),
    )


def with_decision(
    df: DataFrame, limits: Limits, head: str | None = None, probe: str | None = None
) -> DataFrame:
    """Add ``kind``, ``recipe`` and ``skip_reason``."""
    named = df.withColumn("kind", kind_of("path"))
    if head is not None:
        named = named.withColumn("kind", confirmed_kind("kind", head))
    judged = once(named, "verdict", verdict("kind", "size", limits, head, probe))
    recipe, reason = split_verdict()
    return judged.withColumns({"recipe": recipe, "skip_reason": reason}).drop("verdict")


def decide_in_two_steps(files: DataFrame, limits: Limits, heads: DataFrame, probes: DataFrame) -> DataFrame:
    """Decide on the name first, then on the bytes for what remains.

    ``heads`` is ``(path, head)`` and ``probes`` is ``(path, probe)``. Only rows
    the name does not settle are joined with them, so the wide columns move for
    those rows alone. A missing probe is an absent one.
    """
    data = files.columns
    cheap = with_decision(files, limits)
    open_rows = F.col("skip_reason").isNull() | (F.col("skip_reason") == "needs_probe")
    settled = cheap.where(~open_rows)
    kind, is_m4a = kind_of("path"), F.lower("path").endswith(".m4a")
    name_is_media = is_video(kind) | is_m4a
    # The heads and probes of other names say nothing; they stay where they are.
    heads = heads.where(is_image(kind) | (kind == "mpeg_ts") | is_m4a)
    probes = probes.where(name_is_media)
    facts = (
        cheap.where(open_rows)
        .select(*data)
        .join(heads.select("path", "head"), "path", "left")
        .join(probes.select("path", "probe"), "path", "left")
    )
    again = with_decision(facts, limits, head="head", probe="probe").drop("head", "probe")
    return settled.unionByName(again)


# -- facts per recipe --------------------------------------------------------


def expected_ratio(recipe) -> Column:
    return lookup(recipe, _RATIO)


def is_byte_reversible(recipe) -> Column:
    return col(recipe) == "jxl-from-jpeg"


def is_lossless(recipe) -> Column:
    return col(recipe) != "av1"


def output_extension(recipe, source_extension) -> Column:
    """Extension of the result; the lossy video recipe keeps its container."""
    recipe, ext = col(recipe), F.lower(col(source_extension))
    return (
        F.when(recipe.startswith("jxl-"), "jxl")
        .when(recipe.startswith("flac"), "flac")
        .when(recipe == "ts-remux", "mp4")
        .when(recipe == "ffv1", "mkv")
        .when((recipe == "av1") & ext.isin("mov", "qt"), "mov")
        .when((recipe == "av1") & ext.isin("mkv", "webm"), "mkv")
        .when(recipe == "av1", "mp4")
    )


def projected_saving(kind, size) -> Column:
    """Bytes a file might yield, for ordering only; independent of settings."""
    size = col(size)
    name = verdict(kind, size, UNBOUNDED)
    guess = F.when(col(kind) == "webp", _RATIO["jxl-from-webp"]).otherwise(_RATIO["av1"])
    ratio = F.when(name == "needs_probe", guess).otherwise(expected_ratio(name))
    return F.coalesce(sizes.saturating_sub(size, sizes.shrunk(size, ratio)), F.lit(0)).cast("long")


def with_projected_saving(df: DataFrame) -> DataFrame:
    kinds = df.withColumn("_kind", kind_of("path"))
    return kinds.withColumn("projected_saving", projected_saving("_kind", "size")).drop("_kind")


def reservation_mib(recipe, size, keep_source: bool = False) -> Column:
    """Peak staging space of one conversion, in whole MiB."""
    peak = lookup(recipe, _PEAK)
    if keep_source:
        peak = peak + F.when(col(recipe).isin(*_HOLDS), 0.0).otherwise(1.0)
    return sizes.bytes_to_mib(F.ceil(col(size).cast("double") * peak).cast("long"))


# -- reasons -----------------------------------------------------------------


def reasons_table(spark: SparkSession) -> DataFrame:
    """Every reason, whether settings decide it, and which flag it waits for."""
    flags = {"video_tier_disabled": "allow_video", "av1_tier_disabled": "allow_av1"}
    rows = [
        (name, name in K.SETTINGS_REASONS, flags.get(name))
        for name in (*K.SKIP_REASONS, K.OUT_OF_SCOPE)
    ]
    return spark.createDataFrame(rows, "skip_reason string, depends_on_settings boolean, flag string")


def reopened_by(allow_video: bool, allow_av1: bool) -> list[str]:
    """Reasons a run with these settings looks at again."""
    closed = set()
    if not allow_video:
        closed.add("video_tier_disabled")
    if not allow_av1:
        closed.add("av1_tier_disabled")
    return [reason for reason in K.SETTINGS_REASONS if reason not in closed]
