"""The stand-in tokenizer: each run of word characters is one token, and so is each other character that is no white space."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = re.compile(r"\w+|[^\w\s]")

#: The same for the JVM, where \w and \s are ASCII only.
JVM_TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x1c-\x1f\x85\p{Z}]"

#: A maximal run of letters and digits, for the JVM.
JVM_WORD = r"[\p{L}\p{N}]+"


def token_count(text: Column) -> Column:
    """Tokens of a text, counted in the JVM; null for null."""
    return F.regexp_count(text, F.lit(JVM_TOKEN))


def token_spans(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in TOKEN.finditer(text)]
