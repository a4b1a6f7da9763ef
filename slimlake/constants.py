"""Fixed values that results depend on: names, tables and thresholds."""

from __future__ import annotations

# --- fixed values -----------------------------------------------------------

STATES = ("pending", "claimed", "done", "skipped", "failed")

KIND_EXTENSIONS = {
    "jpeg": ("jpg", "jpeg", "jpe", "jfif"),
    "png": ("png",),
    "gif": ("gif",),
    "bmp": ("bmp", "dib"),
    "tiff": ("tif", "tiff"),
    "efficient_image": ("heic", "heif", "avif", "jxl"),
    "webp": ("webp",),
    "wav": ("wav", "wave"),
    "aiff": ("aif", "aiff", "aifc"),
    "flac": ("flac",),
    "m4a": ("m4a",),
    "lossy_audio": ("mp3", "aac", "opus", "ogg", "oga", "wma"),
    "mp4": ("mp4", "m4v"),
    "mov": ("mov", "qt"),
    "mkv": ("mkv", "webm"),
    "mpeg_ts": ("ts", "m2ts", "mts", "m2t"),
    "legacy_video": ("avi", "wmv", "flv", "3gp", "mpg", "mpeg", "vob"),
}
OTHER_KIND = "other"
IMAGE_KINDS = ("jpeg", "png", "gif", "bmp", "tiff", "efficient_image", "webp")
VIDEO_KINDS = ("mp4", "mov", "mkv", "mpeg_ts", "legacy_video")

# Image format named by the leading bytes -> kind.
FORMAT_KINDS = {
    "png": "png",
    "gif": "gif",
    "jpeg": "jpeg",
    "webp": "webp",
    "bmp": "bmp",
    "tiff": "tiff",
    "heif": "efficient_image",
    "jxl": "efficient_image",
}
HEIF_BRANDS = ("heic", "heix", "hevc", "hevx", "heim", "heis", "mif1", "msf1", "avif", "avis")
BMP_HEADER_SIZES = (12, 40, 52, 56, 64, 108, 124)
TS_PACKET = 188
TS_SYNC = 0x47
TS_PACKETS_CHECKED = 4
HEAD_BYTES = 188 * 8

# recipe -> (expected ratio, peak reservation, holds its source)
RECIPES = {
    "jxl-from-jpeg": (0.80, 1.8, False),
    "jxl-from-raster": (0.65, 1.8, False),
    "jxl-from-webp": (0.93, 1.8, False),
    "flac": (0.55, 1.5, False),
    "flac-recompress": (0.94, 1.5, False),
    "ts-remux": (0.96, 1.95, False),
    "ffv1": (0.50, 2.5, True),
    "av1": (0.70, 1.65, True),
}
SKIP_REASONS = (
    "already_optimal",
    "no_gain",
    "lossy_no_gain",
    "too_large_for_budget",
    "too_small",
    "video_hdr",
    "video_already_av1",
    "video_low_bitrate",
    "video_too_short",
    "video_complex_structure",
    "video_tier_disabled",
    "av1_tier_disabled",
    "needs_probe",
    "unsupported",
)
OUT_OF_SCOPE = "out_of_scope"
SETTINGS_REASONS = (
    "video_tier_disabled",
    "av1_tier_disabled",
    "too_large_for_budget",
    "video_too_short",
)
LOSSLESS_VIDEO_CODECS = (
    "rawvideo", "huffyuv", "ffvhuff", "ffv1", "magicyuv", "utvideo",
    "qtrle", "v210", "v410", "r210", "bmp", "png",
)
HDR_TRANSFERS = ("smpte2084", "arib-std-b67")

BYTE_EXACT = "byte-exact"
CONTENT_EXACT = "content-exact"

MIN_USEFUL_BYTES = 4096
MIN_GAIN = 0.03
MIN_BITS_PER_PIXEL_SEC = 1.0
MIN_MEAN_SCORE = 97.0
MIN_LOW_SCORE = 95.0
LOW_PERCENTILE = 1.0
UHD_PIXELS = 1920 * 1080 * 2
HD_MODEL = "vmaf_v0.6.1"
UHD_MODEL = "vmaf_4k_v0.6.1"
MAX_CRF = 63
CRF_STEP = 2
MAX_ATTEMPTS = 3
MIB = 1024 * 1024
MAX_MIB = 2**32 - 1
ERROR_PREFIX_CHARS = 80
PROGRESS_SECONDS = 15
SECRET_WORDS = ("pass", "secret", "token", "key")
REDACTED = "<redacted>"
BENCH_PRESETS = (3, 4, 6)
RETENTION_DAYS = 30

# --- end of fixed values ----------------------------------------------------
