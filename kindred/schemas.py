"""Row types of the engine. Nothing is inferred at run time."""

from pyspark.sql import types as T

SCHEMA_VERSION = 1
ALGORITHM_VERSION = "dct-phash-v1-32px-8x8-rotations4"
EXTENSIONS = ("png", "jpg", "jpeg", "bmp", "gif", "webp", "tiff")
CACHE_TTL_DAYS = 365
CACHE_ROWS = 250_000

_s, _l, _d, _b, _i = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.IntegerType()


def _struct(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


FILES = _struct(("path", _s), ("basename", _s), ("ord", _l), ("size", _l), ("mtime_ms", _d))
HASHED = _struct(("path", _s), ("basename", _s), ("ord", _l), ("hashes", T.ArrayType(_s)))
MATCHES = _struct(("hash", _s), ("file_path", _s), ("dist", _i))
GROUPS = _struct(("id", _s), ("kind", _s), ("representative", _s), ("files", T.ArrayType(_s)), ("evidence", _s), ("score", _d), ("size", _l), ("min_ord", _l))
CACHE = _struct(
    ("schema_version", _i), ("algorithm_version", _s), ("file_path", _s), ("basename", _s), ("hashes", T.ArrayType(_s)), ("size", _l), ("mtime_ms", _d), ("cached_at", T.TimestampType())
)
CACHE_STATS = _struct(("hits", _l), ("misses", _l), ("stale", _l), ("writes", _l), ("errors", _l))
CACHE_INFO = _struct(
    ("folder", _s), ("cache_path", _s), ("current_image_count", _l), ("valid_entry_count", _l), ("stale_entry_count", _l), ("missing_entry_count", _l), ("total_entries", _l), ("size_bytes", _l), ("ttl_days", _i), ("updated_at", _s)
)
PROGRESS = _struct(("type", _s), ("phase", _s), ("current_file", _l), ("total_files", _l), ("percent_complete", _l), ("estimated_time_remaining_ms", _l))
UPDATE = _struct(("type", _s), ("progress", PROGRESS), ("hashed_count", _l), ("discovered_count", _l), ("group_count", _l), ("message", _s))
LOG_ENTRY = _struct(("timestamp", _s), ("level", _s), ("scope", _s), ("event", _s), ("details", _s))
