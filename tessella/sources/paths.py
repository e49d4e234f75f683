"""Versions of artifacts, told apart by a time in the file name: ``<stem>_<YYYYMMDD_HHMMSS><suffix>``."""

from __future__ import annotations

import re
from datetime import datetime
from zoneinfo import ZoneInfo

from pyspark.sql import SparkSession

from .files import SharedFile

#: The zone and the form of the times.
ZONE, STAMP = "Europe/Rome", "%Y%m%d_%H%M%S"


def _parts(name: str) -> tuple[str, str]:
    """Stem and suffix: a dot that begins a name begins no suffix."""
    at = name.rfind(".")
    return (name[:at], name[at:]) if at > 0 else (name, "")


def new_version(spark: SparkSession, path, moment: datetime | None = None) -> str:
    """Where a version of an artifact made at a moment (now) goes."""
    file = SharedFile(spark, path)
    stem, suffix = _parts(file.name)
    return str(file.beside(f"{stem}_{moment or datetime.now(ZoneInfo(ZONE)):{STAMP}}{suffix}"))


def versions(spark: SparkSession, path) -> list[tuple[str, str]]:
    """(time, path) of an artifact's versions, oldest first; names of the same beginning without a time come before."""
    file = SharedFile(spark, path)
    stem, suffix = _parts(file.name)
    pattern = re.compile(rf"{re.escape(stem)}_(?:.*_)?(\d{{8}}_\d{{6}}){re.escape(suffix)}|{re.escape(stem)}_.*{re.escape(suffix)}", re.S)
    found = ((m[1] or "", name) for name in file.siblings() if (m := pattern.fullmatch(name)))
    return [(time, str(file.beside(name))) for time, name in sorted(found)]


def current_version(spark: SparkSession, path) -> str:
    """The artifact itself where there is one, else its newest version; FileNotFoundError if there is neither."""
    if (file := SharedFile(spark, path)).exists():
        return str(file)
    if known := versions(spark, path):
        return known[-1][1]
    raise FileNotFoundError(f"no version of {path}")
