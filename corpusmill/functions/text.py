"""Text rules as Column functions; nothing here needs Python workers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.strip and \s see it; Java's \s is ASCII only.
BLANK = r"\s\x0b\x1c-\x1f\x85\p{Z}"
#: An escaped markup character, with or without its backslash. Fixed values.
ESCAPED = r"(?i)\\?u(?:003c|003e|0022|0026|0027)"
ESCAPES = {"003c": "<", "003e": ">", "0022": '"', "0026": "&", "0027": "'"}
#: Tags that are taken out of texts in which markup was escaped. Fixed values.
INLINE_TAGS = r"(?i)</?(?:div|span|p|a|ul|ol|li|table|tr|td|th|h[1-6]|br|img|section|article|nav|header|footer)\b[^>]*>"
#: Control characters other than tab and line ends, DEL, zero-width characters, byte order mark, soft hyphen.
UNWANTED = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x{200b}-\x{200d}\x{feff}\x{ad}]"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), rf"^[{BLANK}]+|[{BLANK}]+$", "")


def collapse(x: Column | str) -> Column:
    """Runs of white space become one space."""
    return F.regexp_replace(_c(x), rf"[{BLANK}]+", " ")


def clean_prose(x: Column | str) -> Column:
    """F1. Texts with escaped markup: decode it, drop listed tags, collapse white space; all texts: strip."""
    x = _c(x)
    out = x
    for code, char in ESCAPES.items():
        out = F.regexp_replace(out, rf"(?i)\\?u{code}", char)
    out = collapse(F.regexp_replace(out, INLINE_TAGS, " "))
    return strip(F.when(x.rlike(ESCAPED), out).otherwise(x))


def render_block(b: Column) -> Column:
    """F2. Text of a block: cells joined by a bar (nulls skipped, empty ones kept), code stripped, others cleaned; '' for none."""
    row = F.array_join(F.transform(F.filter(F.coalesce(b["cells"], F.array()), lambda c: c.isNotNull()), clean_prose), " | ")
    text = F.coalesce(b["text"], F.lit(""))
    return F.when(b["kind"] == "row", row).when(b["kind"] == "code", strip(text)).otherwise(clean_prose(text))


def plain_text(blocks: Column | str) -> Column:
    """F3. All blocks rendered, blank ones dropped, joined by a blank line; '' for null."""
    parts = F.filter(F.transform(F.coalesce(_c(blocks), F.array()), render_block), lambda t: F.length(strip(t)) > 0)
    return F.array_join(parts, "\n\n")


def page_title(title: Column | str, blocks: Column | str) -> Column:
    """F4. The page's title, else its first heading that is not blank."""
    heads = F.filter(F.transform(F.filter(F.coalesce(_c(blocks), F.array()), lambda b: b["kind"] == "heading"), lambda b: strip(F.coalesce(b["text"], F.lit("")))), lambda t: F.length(t) > 0)
    own = strip(_c(title))
    return F.when(F.length(own) > 0, own).otherwise(F.get(heads, F.lit(0)))


def normalize(x: Column | str) -> Column:
    """F7. Stripped, white space collapsed, lower case; '' for null."""
    return F.lower(collapse(strip(F.coalesce(_c(x), F.lit("")))))


def sanitize(x: Column | str) -> Column:
    """F8. Text without characters that embedding models choke on; '' for null."""
    return F.regexp_replace(F.make_valid_utf8(F.coalesce(_c(x), F.lit(""))), UNWANTED, "")


def asset_text(x: Column | str) -> Column:
    """F9. Lines with runs of blanks and tabs collapsed and stripped, joined again; null when nothing is left."""
    lines = F.transform(F.split(F.regexp_replace(_c(x), "\r\n?", "\n"), "\n"), lambda t: strip(F.regexp_replace(t, r"[ \t]+", " ")))
    out = strip(F.array_join(lines, "\n"))
    return F.when(F.length(out) > 0, out)


def query_form(x: Column | str) -> Column:
    """F20. A query for comparison: lower case, white space collapsed and stripped."""
    return collapse(strip(F.lower(_c(x))))


def signal_form(x: Column | str) -> Column:
    """F20. A signal for comparison: its runs of a-z and 0-9, one space between them."""
    return F.array_join(F.regexp_extract_all(F.lower(_c(x)), F.lit("([a-z0-9]+)"), F.lit(1)), " ")


#: A trail of one to six spaced slashes between short segments.
TRAIL = r"^[^/\n]{1,40}(?:\s/\s[^/\n]{1,40}){1,6}$"
STUB_WORD = r"[A-Za-z0-9][A-Za-z0-9'’&.\-]*"
STUB_WORDS = 8


def is_stub(text: Column | str, section_title: Column | str) -> Column:
    """O9. No content: nothing, the section's own title, a trail, or fewer than 8 words."""
    t, own = normalize(text), normalize(section_title)
    return (F.length(t) == 0) | ((F.length(own) > 0) & (t == own)) | t.rlike(TRAIL) | (F.regexp_count(t, F.lit(STUB_WORD)) < STUB_WORDS)


#: A sentence ends at .!? before white space or the end, or at a colon before a line feed.
SENTENCE_END = r"(?<=[.!?])(?:\s+|$)|(?<=:)\n"


def sentences(x: Column | str) -> Column:
    """F11. Sentences of a text, stripped of blanks, line ends and list marks, three characters at least."""
    return F.filter(F.transform(F.split(_c(x), SENTENCE_END), lambda t: F.regexp_replace(t, r"^[ \n\-*]+|[ \n\-*]+$", "")), lambda t: F.length(t) >= 3)


#: What marks a specific fact: a number, a year, a named source, two capitalised words. Fixed value.
SPECIFIC = (
    r"(?:\b\d[\d,.]*(?:%|ms|s|kg|gb|mb|years?|days?|hours?|\b)"
    r"|\b(?:19|20)\d{2}\b|\baccording to\b|\bresearch\b|\bstudy\b"
    r"|\b[A-Z][A-Za-z0-9&.-]+(?:\s+[A-Z][A-Za-z0-9&.-]+)+\b)"
)


def is_specific(x: Column | str) -> Column:
    """F13."""
    return _c(x).rlike(SPECIFIC)
