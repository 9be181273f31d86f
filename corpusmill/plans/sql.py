"""Pieces of DuckDB SQL that say the same as the column functions."""

from __future__ import annotations

from corpusmill.functions import classify, text, urls

BLANK = r"\s\x0b\x1c-\x1f\x{85}\pZ"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{BLANK}]+|[{BLANK}]+$', '', 'g')"


def collapse(x: str) -> str:
    return f"regexp_replace({x}, '[{BLANK}]+', ' ', 'g')"


def clean(x: str) -> str:
    out = x
    for code, char in text.ESCAPES.items():
        out = f"regexp_replace({out}, '(?i)\\\\?u{code}', {q(char)}, 'g')"
    out = collapse(f"regexp_replace({out}, {q(text.INLINE_TAGS)}, ' ', 'g')")
    return strip(f"(case when regexp_matches({x}, {q(text.ESCAPED)}) then {out} else {x} end)")


def block(b: str) -> str:
    return f"(case when {b}.kind = 'row' then array_to_string(list_transform(list_filter(coalesce({b}.cells, []), lambda c: c is not null), lambda c: {clean('c')}), ' | ') when {b}.kind = 'code' then {strip(f'coalesce({b}.text, chr(0)[1:0])')} else {clean(f'coalesce({b}.text, chr(0)[1:0])')} end)".replace("chr(0)[1:0]", "''")


def plain(blocks: str) -> str:
    return f"array_to_string(list_filter(list_transform(coalesce({blocks}, []), lambda b: {block('b')}), lambda t: length({strip('t')}) > 0), chr(10) || chr(10))"


def normalize(x: str) -> str:
    return f"lower({collapse(strip(f'coalesce({x}, chr(39)||chr(39))'))})".replace("chr(39)||chr(39)", "''")


def path(url: str) -> str:
    return f"regexp_extract(coalesce({url}, ''), {q(urls.PATH)}, 1)"


def segments(url: str) -> str:
    return f"list_filter(string_split({path(url)}, '/'), lambda s: s <> '')"


def locale(url: str) -> str:
    seg = f"lower({segments(url)}[1])"
    inside = lambda xs: ", ".join(map(q, xs))
    return f"(case when {seg} is null or {seg} in ({inside(urls.KEPT_REGIONS)}) then false when {seg} in ({inside(urls.DROPPED_REGIONS)}) then true else split_part({seg}, '-', 1) in ({inside(urls.OTHER_LANGUAGES)}) and split_part({seg}, '-', 1) <> 'en' end)"


def sitemap(url: str) -> str:
    last = f"coalesce(list_last({segments(url)}), '')"
    return f"(regexp_matches({last}, {q(urls.SITEMAP)}) or regexp_matches(regexp_replace({last}, '\\.[^.]*$', ''), {q(urls.SITEMAP)}))"


def int_of(x: str) -> str:
    return f"try_cast(trunc(try_cast({strip(x)} as double)) as int)"


def bool_of(x: str) -> str:
    t = f"lower({strip(x)})"
    return f"(case when {t} in ('t','true','1','y','yes') then true when {t} in ('f','false','0','n','no') then false when try_cast({t} as double) is not null then try_cast({t} as double) <> 0 end)"


def reason(url: str = "url", final: str = "final_url") -> str:
    page = f"coalesce(nullif({final}, ''), {url})"
    return (
        f"(case when {locale(page)} or {locale(url)} then 'locale' when {int_of('status_code')} >= 400 then 'http_error' when {sitemap(page)} or {sitemap(url)} then 'sitemap' "
        f"when not {bool_of('robots_allowed')} then 'failure' when length({strip('failure_reason')}) > 0 then 'failure' when coalesce(len(blocks), 0) = 0 then 'no_content' end)"
    )


def host(origin: str, url: str) -> str:
    one = lambda x: f"lower(regexp_extract(case when contains({strip(f'coalesce({x}, {q(str())})')}, '://') then {strip(f'coalesce({x}, {q(str())})')} else 'https://' || {strip(f'coalesce({x}, {q(str())})')} end, {q(urls.HOST)}, 1))"
    return f"(case when length({one(origin)}) > 0 then {one(origin)} else {one(url)} end)"


def any_of(blob: str, needles: list[str]) -> str:
    return "(" + " or ".join(f"contains({blob}, {q(n)})" for n in needles) + ")"


def category(url: str, body: str) -> str:
    blob = f"(lower(case when length({path(url)}) > 0 then {path(url)} else '/' end) || ' ' || lower(substr(coalesce({body}, ''), 1, 500)))"
    return "(case " + " ".join(f"when {any_of(blob, ns)} then {q(name)}" for name, ns in classify.CATEGORIES) + " else 'page' end)"


def terms(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z0-9]+')"


def words(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[\\pL\\pN]+')"


#: One row a page: the delivery that arrived last (deliveries of a page differ in nothing else).
PAGES = "(select * from crawl_pages qualify row_number() over (partition by page_id order by arrived_at desc) = 1)"
