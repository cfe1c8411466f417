"""String functions of reports, as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_name(path: Column) -> Column:
    """Last part that isn't empty, of either separator; the whole value where there is none."""
    parts = F.filter(F.split(F.replace(path, F.lit("/"), F.lit("\\")), r"\\"), lambda p: p != "")
    return F.coalesce(F.try_element_at(parts, F.lit(-1)), path)


def directory(path: Column) -> Column:
    """What stands before the last separator, with backslashes; empty without one."""
    flat = F.replace(path, F.lit("/"), F.lit("\\"))
    last = F.length(flat) - F.instr(F.reverse(flat), "\\")
    return F.when(F.instr(flat, "\\") == 0, F.lit("")).otherwise(F.substring(flat, F.lit(1), last))


def shorten_middle(value: Column, most: int) -> Column:
    left = most - 1
    prefix = math.ceil(left * 0.58)
    return F.when(F.length(value) <= most, value).otherwise(F.concat(F.substring(value, 1, prefix), F.lit("…"), F.right(value, F.lit(left - prefix))))


def escape_html(value: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        value = F.replace(value, F.lit(raw), F.lit(safe))
    return value


def fixed(x: Column, digits: int) -> Column:
    """``digits`` decimals, of the value rounded half up."""
    return F.format_string(f"%.{digits}f", F.round(x, digits))


def js_round(x: Column) -> Column:
    return F.floor(x + 0.5)


def format_duration(ms: Column) -> Column:
    """Milliseconds, seconds with a decimal, or minutes and rounded seconds."""
    minutes, seconds = F.floor(ms / 60_000), js_round((ms % 60_000) / 1000)
    return (
        F.when(ms < 1000, F.concat(F.format_string("%d", ms), F.lit(" ms")))
        .when(ms < 60_000, F.concat(fixed(ms / 1000, 1), F.lit(" s")))
        .otherwise(F.concat(F.format_string("%d", minutes), F.lit("m "), F.format_string("%d", seconds), F.lit("s")))
    )


def grouped_number(x: Column) -> Column:
    return F.format_number(x, 0)


def file_url(path: Column) -> Column:
    """file:// and the path with forward slashes, spaces and other reserved bytes escaped, slashes kept."""
    flat = F.replace(path, F.lit("\\"), F.lit("/"))
    encoded = F.url_encode(flat)
    for code, plain in (("+", "%20"), ("%2F", "/"), ("%3A", ":"), ("%3F", "?"), ("%23", "#"), ("%26", "&"), ("%3D", "="), ("%40", "@"), ("%2C", ","), ("%3B", ";"), ("%2B", "+"), ("%24", "$"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(code), F.lit(plain))
    return F.concat(F.lit("file://"), encoded)


PHASES = ("discovering", "hashing", "comparing")
LABELS = {"hashing": "preparing images", "comparing": "comparing matches", "complete": "wrapping up"}


def phase_label(phase: Column) -> Column:
    out = F.lit("discovering files")
    for name, label in LABELS.items():
        out = F.when(phase == name, F.lit(label)).otherwise(out)
    return out


def phase_state(current: Column, step: str) -> Column:
    """Of a step while ``current`` is under way: completed, active or pending."""
    place = PHASES.index(step)
    at = F.when(current == "complete", F.lit(len(PHASES)))
    for k, name in enumerate(PHASES):
        at = at.when(current == name, F.lit(k))
    at = at.otherwise(F.lit(-1))
    return F.when(at > place, F.lit("completed")).when(at == place, F.lit("active")).otherwise(F.lit("pending"))


def progress_text(current: Column, total: Column, phase: Column, elapsed_ms: Column, eta_ms: Column) -> Column:
    """Counts, images a second while hashing (after half a second), and the time left, rounded up."""
    counts = F.concat(current.cast("string"), F.lit("/"), total.cast("string"), F.lit(" "), F.when(phase == "comparing", F.lit("comparisons")).otherwise(F.lit("images")))
    speed = F.when((phase == "hashing") & (current > 0) & (elapsed_ms > 500), F.concat(fixed(current / (elapsed_ms / 1000), 1), F.lit(" img/s")))
    seconds = F.ceil(eta_ms / 1000)
    left = F.when(seconds < 60, F.concat(F.lit("~"), seconds.cast("string"), F.lit("s remaining"))).otherwise(F.concat(F.lit("~"), F.ceil(seconds / 60).cast("string"), F.lit("m remaining")))
    return F.concat_ws(" • ", counts, speed, F.when(eta_ms > 0, left))


def cache_text(images: Column, valid: Column, missing: Column, stale: Column, ttl_days: Column) -> Column:
    """One sentence about a folder's cache."""
    ttl = F.concat(F.lit(". TTL "), ttl_days.cast("string"), F.lit(" days."))
    some = lambda n, what: F.when(n > 0, F.concat(F.lit(", "), n.cast("string"), F.lit(f" {what}"))).otherwise(F.lit(""))
    ready = F.concat(F.lit("Cache: "), valid.cast("string"), F.lit("/"), images.cast("string"), F.lit(" image hashes ready"), some(missing, "missing"), some(stale, "stale"), ttl)
    return F.when(images == 0, F.concat(F.lit("Cache: no images in selected folder"), ttl)).otherwise(ready)


def folder_cache_id(folder: Column) -> Column:
    return F.concat(F.lit("folder-"), F.left(F.sha2(F.lower(folder), 256), F.lit(32)))
