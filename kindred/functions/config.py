"""Thresholds and rounding on the driver."""

from __future__ import annotations

import math
import re

DEFAULT_THRESHOLD, MOST_THRESHOLD = 5, 16
#: Session setting that replaces the default threshold. An explicit argument wins over it.
THRESHOLD_CONF = "kindred.threshold"


def js_round(x: float) -> int:
    """Halves go up, towards plus infinity."""
    return math.floor(x + 0.5)


def clamp_threshold(value: object, default: int = DEFAULT_THRESHOLD) -> int:
    """A threshold as callers give it: numbers rounded into 0 to 16, anything else the default."""
    if isinstance(value, bool) or not isinstance(value, (int, float)) or (isinstance(value, float) and not math.isfinite(value)):
        return default
    return max(0, min(MOST_THRESHOLD, js_round(value)))


def parse_threshold(text: str | None, default: int = DEFAULT_THRESHOLD) -> int:
    """A threshold as a setting gives it: the leading integer, clamped; the default where there is none."""
    found = re.match(r"\s*([+-]?\d+)", text or "")
    return max(0, min(MOST_THRESHOLD, int(found[1]))) if found else default


def resolve_threshold(argument: object, setting: str | None) -> int:
    return clamp_threshold(argument) if argument is not None else parse_threshold(setting)


def required_text(value: object, name: str) -> str:
    """A trimmed string that isn't empty."""
    if not isinstance(value, str) or not value.strip():
        raise ValueError(f"{name} must be a string that isn't empty")
    return value.strip()
