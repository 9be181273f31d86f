"""Pre-flight checks of tables (O37): each gives the rows that break a rule, so an empty result is a pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def repeated(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that stand on more than one row."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def broken_spans(df: DataFrame, start: str = "start_char", end: str = "end_char") -> DataFrame:
    """Spans with one end only, before the text, or not in order."""
    s, e = F.col(start), F.col(end)
    return df.where((s.isNull() != e.isNull()) | (s < 0) | (e <= s))


def without_source(queries: DataFrame) -> DataFrame:
    """Observed and imported queries that name no source."""
    given = F.coalesce(F.length("source_id"), F.lit(0)) + F.coalesce(F.length("source_reference"), F.lit(0))
    return queries.where(F.col("origin").isin("observed", "imported") & (given == 0))


def unknown(df: DataFrame, known: DataFrame, *keys: str) -> DataFrame:
    """Rows whose key no row of `known` has."""
    return df.join(known.select(*keys).distinct(), list(keys), "left_anti")


def wrong_digests(df: DataFrame, body: str, digest: str) -> DataFrame:
    """Rows whose declared digest is not that of their text."""
    return df.where(F.col(digest).isNotNull() & (F.sha2(F.col(body), 256) != F.lower(digest)))


def executable_entries(entries: DataFrame, most: int = 500) -> DataFrame:
    """Manifest entries that may be used: approved or deprecated, of one owner, not expired. Raises beyond `most` entries, for
    several owners, and where two entries name one resource of a version."""
    if entries.limit(most + 1).count() > most:
        raise ValueError(f"a manifest has at most {most} entries")
    if entries.select("owner_id").distinct().limit(2).count() > 1:
        raise ValueError("a manifest has one owner")
    named = [c for c in ("asset_version_id", "resource_id", "resource_digest") if c in entries.columns]
    if named:
        require_none(repeated(entries, *named), "the entries of a manifest are unique")
    return entries.where(F.col("lifecycle").isin("approved", "deprecated") & (F.col("expires_at").isNull() | (F.col("expires_at") > F.current_timestamp())))


def require_none(df: DataFrame, what: str) -> None:
    """Raise when a check found anything."""
    if not df.isEmpty():
        raise ValueError(what)
