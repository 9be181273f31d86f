"""Deterministic identifiers and digests."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.text import _c, sanitize

#: Namespace of point ids.
POINTS = uuid.uuid5(uuid.NAMESPACE_URL, "corpusmill:points")
SEPARATOR = "\x1f"


def uuid5(name: Column | str, namespace: uuid.UUID = POINTS) -> Column:
    """O31. Name-based UUID, version 5, as a string."""
    h = F.sha1(F.concat(F.lit(namespace.bytes), F.encode(_c(name), "utf-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def point_id(run: Column | str, page: Column | str, chunk: Column | str) -> Column:
    return uuid5(F.concat_ws(":", _c(run), _c(page), _c(chunk)))


def stable_id(*parts: Column | str) -> Column:
    """F45. First 24 hex digits of the SHA-256 of the parts, joined by a unit separator; plain strings are literals."""
    cols = [F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.substring(F.sha2(F.array_join(F.array(*cols), SEPARATOR), 256), 1, 24)


def text_digest(text: Column | str) -> Column:
    """F46. SHA-256 of the text as it is embedded."""
    return F.sha2(sanitize(text), 256)


def source_digest(html: Column | str) -> Column:
    """F47. SHA-256 of a page's markup, null when there is none."""
    return F.when(F.length(_c(html)) > 0, F.sha2(_c(html), 256))


def cache_key(text: Column | str, model: str) -> Column:
    """F48. Key of a text's vector: SHA-256 of model, NUL, text."""
    return F.sha2(F.concat(F.lit(model), F.lit("\0"), _c(text)), 256)


def canonical_json(value: object) -> bytes:
    """F49. Sorted keys, no spaces, UTF-8."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()


def sign(value: object, key: bytes) -> str:
    return hmac.new(key, canonical_json(value), hashlib.sha256).hexdigest()


def verify(value: object, key_base64: str, signature: str) -> bool:
    """Whether a signature over the canonical form of `value` holds; runs on the driver, never in a plan."""
    return hmac.compare_digest(sign(value, base64.b64decode(key_base64)), signature)
