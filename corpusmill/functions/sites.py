"""The site of a page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scheme, user part and a leading www. are skipped; the host ends at a port, path, query or fragment.
SITE_PATTERN = r"^\s*(?:[a-z][a-z0-9+.\-]*://)?(?:[^/@\s]*@)?(?:www\.)?([^/:?#\s]+)"


def site(origin: Column | str) -> Column:
    """Host in lower case without scheme, leading www., port and trailing slash; '' where there is none, null for null."""
    return F.regexp_extract(F.lower(F.col(origin) if isinstance(origin, str) else origin), SITE_PATTERN, 1)
