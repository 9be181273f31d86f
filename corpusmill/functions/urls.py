"""URL and host rules as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.text import _c, strip

#: First path segments that are kept or dropped as regions, and languages whose pages are dropped. Fixed values.
KEPT_REGIONS = ["us"]
DROPPED_REGIONS = "gb uk au nz sg ae ca ie eu in za jp kr br mx de fr es it nl".split()
OTHER_LANGUAGES = (
    "aa ab ae af ak am an ar as av ay az ba be bg bh bi bm bn bo br bs ca ce ch co cr cs cu cv cy da de dv dz ee el eo es et eu "
    "fa ff fi fj fo fr fy ga gd gl gn gu gv ha he hi ho hr ht hu hy hz ia id ie ig ii ik io is it iu ja jv ka kg ki kj kk kl km kn ko kr ks ku kv kw ky "
    "la lb lg li ln lo lt lu lv mg mh mi mk ml mn mr ms mt my na nb nd ne ng nl nn no nr nv ny oc oj om or os pa pi pl ps pt qu rm rn ro ru rw "
    "sa sc sd se sg si sk sl sm sn so sq sr ss st su sv sw ta te tg th ti tk tl tn to tr ts tt tw ty ug uk ur uz ve vi vo wa wo xh yi yo za zh zu"
).split()

HOST = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?(\[[^\]]*\]|[^/:?#]*)"
PATH = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"
#: The last path segment, or its stem, of a sitemap. Fixed values.
SITEMAP = r"(?i)^(?:(?:html|xml|page|post|product|category|image|video|news)[-_])?sitemap(?:[-_.][\w\-]+)*$"


def path(url: Column | str) -> Column:
    return F.regexp_extract(F.coalesce(_c(url), F.lit("")), PATH, 1)


def segments(url: Column | str) -> Column:
    return F.filter(F.split(path(url), "/"), lambda s: F.length(s) > 0)


def host_of(origin: Column | str, url: Column | str) -> Column:
    """F22. Host of the first of the two that has one, in lower case; '' when neither has."""

    def one(x: Column) -> Column:
        raw = strip(F.coalesce(x, F.lit("")))
        return F.lower(F.regexp_extract(F.when(raw.contains("://"), raw).otherwise(F.concat(F.lit("https://"), raw)), HOST, 1))

    first = one(_c(origin))
    return F.when(F.length(first) > 0, first).otherwise(one(_c(url)))


def bare_host(host: Column | str) -> Column:
    """F23. Trimmed, lower case, without a leading www.; '' for null."""
    return F.regexp_replace(F.lower(strip(F.coalesce(_c(host), F.lit("")))), r"^www\.", "")


def host_candidates(url: Column | str) -> Column:
    """F24. Hosts a typed address may be stored under: as typed, without and with www.; none without a dot."""
    host = host_of(url, F.lit(None).cast("string"))
    bare = bare_host(host)
    return F.when(host.contains("."), F.array_distinct(F.array(host, bare, F.concat(F.lit("www."), bare)))).otherwise(F.array().cast("array<string>"))


def is_locale_path(url: Column | str) -> Column:
    """O2. The first path segment names a dropped region or another language."""
    seg = F.lower(F.get(segments(url), F.lit(0)))
    primary = F.split_part(seg, F.lit("-"), F.lit(1))
    return F.when(seg.isNull() | seg.isin(KEPT_REGIONS), False).when(seg.isin(DROPPED_REGIONS), True).otherwise(primary.isin(OTHER_LANGUAGES) & (primary != "en"))


def is_sitemap(url: Column | str) -> Column:
    """O3. The last path segment, whole or without its extension, is a sitemap's name."""
    last = F.element_at(F.concat(F.array(F.lit("")), segments(url)), -1)
    stem = F.regexp_replace(last, r"\.[^.]*$", "")
    return last.rlike(SITEMAP) | stem.rlike(SITEMAP)


def page_key(page_id: Column | str, final_url: Column | str, url: Column | str) -> Column:
    """F25. What tells pages apart in a result: the id, else the address in lower case, else ''."""
    address = F.lower(F.coalesce(F.nullif(strip(_c(final_url)), F.lit("")), F.nullif(strip(_c(url)), F.lit(""))))
    return F.when(F.length(_c(page_id)) > 0, F.concat(F.lit("id:"), _c(page_id))).when(address.isNotNull(), F.concat(F.lit("url:"), address)).otherwise("")


def tags(url: Column | str, title: Column | str) -> Column:
    """F26. At most 12 tags: cleaned path parts (first 8), then title words longer than 2 (of the first 6)."""
    parts = F.slice(F.filter(F.split(F.lower(path(url)), "/"), lambda p: (F.length(p) > 0) & ~p.isin("index.html", "index.htm")), 1, 8)
    parts = F.filter(F.transform(parts, lambda p: F.regexp_replace(F.regexp_replace(p, r"[^a-z0-9\-]+", "-"), r"^-+|-+$", "")), lambda p: F.length(p) > 0)
    words = F.filter(F.slice(F.regexp_extract_all(F.lower(F.coalesce(_c(title), F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1)), 1, 6), lambda w: F.length(w) > 2)
    return F.slice(F.array_distinct(F.concat(parts, words)), 1, 12)
