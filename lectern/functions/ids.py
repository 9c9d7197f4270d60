"""Identities made from content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(report_id: str, text: str) -> Column:
    """The first 16 hex digits of the SHA-1 of report and text."""
    return F.substring(F.sha1(F.concat(F.col(report_id), F.lit("\x1f"), F.col(text)).cast("binary")), 1, 16)
