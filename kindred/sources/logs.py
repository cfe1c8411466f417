"""Log entries as rows and JSON lines."""

from __future__ import annotations

import json
import traceback
from datetime import UTC, date, datetime
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred import schemas

LEVELS = ("info", "warn", "error")
SCOPES = ("main", "renderer", "scan")


def iso(moment: datetime) -> str:
    return moment.astimezone(UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")


def sanitise(value: Any) -> Any:
    """What JSON can hold: errors become name, message and stack, times ISO text, whole numbers beyond 53 bits text."""
    if isinstance(value, BaseException):
        return {"message": str(value), "name": type(value).__name__, "stack": "".join(traceback.format_exception(value))}
    if isinstance(value, datetime):
        return iso(value)
    if isinstance(value, date):
        return value.isoformat()
    if isinstance(value, dict):
        return {str(k): sanitise(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [sanitise(v) for v in value]
    if isinstance(value, int) and not isinstance(value, bool) and abs(value) >= 1 << 53:
        return str(value)
    return value


def log_entry(scope: str, event: str, details: dict | None = None, level: str = "info", at: datetime | None = None) -> dict:
    if level not in LEVELS:
        raise ValueError(f"level must be one of {LEVELS}")
    entry = {"timestamp": iso(at or datetime.now(UTC)), "level": level, "scope": scope, "event": event}
    return entry if details is None else entry | {"details": sanitise(details)}


def log_rows(spark: SparkSession, entries: list[dict]) -> DataFrame:
    rows = [(e["timestamp"], e["level"], e["scope"], e["event"], json.dumps(e["details"]) if "details" in e else None) for e in entries]
    return spark.createDataFrame(rows, schemas.LOG_ENTRY)


def entry_column(timestamp: Column, level: Column, scope: Column, event: Column, details: Column) -> Column:
    """One JSON object; null fields are left out."""
    checked = F.when(level.isin(*LEVELS), level).otherwise(F.raise_error(F.concat(F.lit("unknown level: "), level)))
    at = F.concat(F.date_format(F.to_utc_timestamp(timestamp, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))
    return F.to_json(F.struct(at.alias("timestamp"), checked.alias("level"), scope.alias("scope"), event.alias("event"), details.alias("details")))


def append_logs(entries: DataFrame, path: str) -> None:
    """Appends JSON lines below ``path``, a folder for each scope."""
    entries.write.mode("append").partitionBy("scope").json(path)
