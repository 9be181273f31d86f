"""SQL of whole pipelines: language, token windows, units and the index run, built from the pieces of `sql`."""

from __future__ import annotations

from corpusmill.functions import ids, text
from corpusmill.functions.language import FUNCTION_WORDS, LEAST_CHARS, LOOK_AT
from corpusmill.operators.index import POLICY_REASONS
from corpusmill.operators.sections import CHILD, PARENT
from corpusmill.plans import sql
from corpusmill.plans.sql import PAGES, q, strip

TOKEN = r"[\pL\pN_]+|[^\pL\pN_\s\x1c-\x1f\x85\pZ]"


def language(x: str) -> str:
    """Language of a text by function words, as a scalar subquery."""
    counts = ", ".join(f"len(list_filter(w, lambda x: x in ({', '.join(map(q, sorted(v)))})))" for v in FUNCTION_WORDS.values())
    return (
        f"(select case when length({strip(x)}) >= {LEAST_CHARS} and len(w) > 0 and list_max(c) * 25 >= len(w) then ([{', '.join(map(q, FUNCTION_WORDS))}])[list_position(c, list_max(c))] end "
        f"from (select w, [{counts}] as c from (select regexp_extract_all(lower(substr({strip(x)}, 1, {LOOK_AT})), '[\\pL\\p{{Nl}}\\p{{No}}]+') as w)))"
    )


def pieces(x: str) -> str:
    """A stripped text's tokens, each with the white space behind it."""
    return f"string_split(regexp_replace({x}, {q('(' + TOKEN + ')')}, chr(1) || '\\1', 'g'), chr(1))[2:]"


def windows(p: str, size: int, overlap: int) -> str:
    """Windows over `pieces` as structs of their start and text."""
    step = size - overlap
    many = f"(case when len({p}) = 0 then 0 else greatest(cast(ceil((len({p}) - {size}) / {step}) as int), 0) + 1 end)"
    return f"list_transform(range(0, {many}), lambda k: struct_pack(a := length(array_to_string({p}[1:k * {step}], '')), t := {strip(f'array_to_string({p}[k * {step} + 1:k * {step} + {size}], {q(str())})')}))"


def units(sections: str, keys: str = "page_id") -> str:
    """CTEs s, w, p, v, u: sections (keys, section_index, title, text) to parents and children."""
    return f"""s as ({sections}),
    w as (select *, {pieces(strip('text'))} as ps from s),
    w2 as (select *, {windows('ps', *PARENT)} as ws from w),
    p as (select {keys}, section_index, title as section_title, unnest(ws).t as parent_text, unnest(range(len(ws))) as k from w2),
    p2 as (select *, row_number() over (partition by {keys} order by section_index, k) - 1 as parent_index, {pieces('parent_text')} as ps from p),
    v as (select *, {windows('ps', *CHILD)} as ws from p2),
    v2 as (select {keys}, section_index, section_title, parent_text, parent_index, unnest(ws).t as child_text, unnest(range(len(ws))) as k from v),
    u as (select {keys}, section_index, section_title, parent_text, child_text, parent_index, row_number() over (partition by {keys} order by parent_index, k) - 1 as child_index from v2)"""


def page_sections(pages: str) -> str:
    """(page_id, section_index, title, level, text) of the sections of `pages`."""
    return f"""with b as (select page_id, unnest(blocks) as b, unnest(range(len(blocks))) as pos from {pages} where len(blocks) > 0),
    g as (select page_id, pos, b, sum(case when b.kind = 'heading' then 1 else 0 end) over (partition by page_id order by pos rows unbounded preceding) as g from b),
    r as (select page_id, g, pos, case when b.kind = 'heading' then nullif({strip('b.text')}, '') end as title, case when b.kind = 'heading' then b.level end as level, {sql.block('b')} as t from g),
    s as (select page_id, g, first(title order by pos) as title, first(level order by pos) as level, string_agg(t, chr(10) || chr(10) order by pos) filter (where length({strip('t')}) > 0) as text from r group by page_id, g)
    select page_id, cast(row_number() over (partition by page_id order by g) - 1 as int) as section_index, title, level, text from s where text is not null"""


def uuid5(h: str) -> str:
    return f"substr({h},1,8) || '-' || substr({h},9,4) || '-5' || substr({h},14,3) || '-' || case when substr({h},17,1) in ('0','4','8','c') then '8' when substr({h},17,1) in ('1','5','9','d') then '9' when substr({h},17,1) in ('2','6','a','e') then 'a' else 'b' end || substr({h},18,3) || '-' || substr({h},21,12)"


def _stub(t: str, own: str) -> str:
    return f"(length({sql.normalize(t)}) = 0 or (length({sql.normalize(own)}) > 0 and {sql.normalize(t)} = {sql.normalize(own)}) or regexp_matches({sql.normalize(t)}, {q(text.TRAIL)}) or len(regexp_extract_all({sql.normalize(t)}, {q(text.STUB_WORD)})) < {text.STUB_WORDS})"


def _sane(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), {q(text.UNWANTED)}, '', 'g')"


def _run() -> str:
    """CTEs up to n (all nodes) and o (with the page that owns the text)."""
    heading = f"list_filter(list_transform(list_filter(coalesce(blocks, []), lambda b: b.kind = 'heading'), lambda b: {strip('coalesce(b.text, ' + q('') + ')')}), lambda t: length(t) > 0)[1]"
    title = f"(case when length({strip('title')}) > 0 then {strip('title')} else {heading} end)"
    size = strip("plain")
    quality = f"least(greatest(35 + case when length(page_title) > 0 then 15 else 0 end + case when len(blocks) > 0 then 15 else 0 end + case when length({size}) >= 500 then 15 else 0 end + case when length({size}) >= 2000 then 10 else 0 end + case when length({size}) >= 5000 then 10 else 0 end - case when length({size}) < 200 then 20 else 0 end, 0), 100) / 100"
    return f"""with a as materialized (select *, {sql.reason()} as reason, {sql.plain('blocks')} as plain, {title} as page_title from {PAGES}),
    c as materialized (select *, case when reason = 'no_content' then 'extract_empty' when reason is not null then reason when length({strip('plain')}) = 0 then 'extract_empty' when coalesce({language('plain')}, '') <> 'en' then 'non_english' end as skipped from a),
    ok as (select *, {sql.category('url', 'plain')} as category, {quality} as quality from c where skipped is null),
    {units(page_sections('ok'))},
    k as (select u.*, {_stub('child_text', 'section_title')} as stub from u),
    f as (select *, row_number() over (partition by page_id, parent_index order by child_index) = 1 and {strip('parent_text')} <> {strip('child_text')} as leads from k where not stub),
    m as (select page_id, 'child' as chunk_role, 'child:' || child_index as chunk_key, {_sane('child_text')} as t from f union all select page_id, 'parent', 'parent:' || parent_index, {_sane('parent_text')} from f where leads),
    n as (select m.*, sha256(t) as text_digest, run_id, crawled_at, category, quality from m join ok using (page_id)),
    o as (select *, first_value(page_id) over (partition by run_id, text_digest order by crawled_at, page_id) as owner from n)"""


INDEX_RUN = f"""{_run()}, h as (select *, sha1(unhex('{ids.POINTS.hex}') || encode(concat_ws(':', run_id, page_id, chunk_key))) as h from o where page_id = owner)
select {uuid5('h')} as point_id, run_id, page_id, chunk_role, chunk_key, category, quality, text_digest from h"""

INDEX_COUNTS = f"""{_run()},
g as (select run_id, count(*) as pages_seen, count(*) filter (where skipped is null) as pages_english, count(*) filter (where skipped = 'non_english') as skipped_lang,
  count(*) filter (where skipped is not null and skipped not in ({', '.join(map(q, POLICY_REASONS))})) as skipped_empty, count(*) filter (where skipped is not null) as skipped_unusable from c group by run_id),
r as (select run_id, count(*) filter (where page_id = owner) as up, count(*) filter (where page_id <> owner) as again from o group by run_id),
z as (select run_id, count(*) filter (where stub) as stubs from k join ok using (page_id) group by run_id)
select g.*, coalesce(up, 0) as chunks_upserted, coalesce(again, 0) as chunks_skipped_repeat, coalesce(stubs, 0) as chunks_skipped_stub
from g left join r on g.run_id is not distinct from r.run_id left join z on g.run_id is not distinct from z.run_id"""

UNITS_OF_PAGES = f"with {units(page_sections(PAGES))} select page_id, section_index, cast(parent_index as int) as parent_index, cast(child_index as int) as child_index, section_title, parent_text, child_text from u"

LANGUAGES = f"select doc_id, {language('text')} as detected from documents"

#: Lines by class; the answer of a question is the run of other lines behind it, blank ones skipped.
FAQ_PAIRS = r"""with t as (select doc_id, string_split(regexp_replace(text, '\r\n|\r|\x0b|\x0c|\x1c|\x1d|\x1e|\x{85}|\x{2028}|\x{2029}', chr(10), 'g'), chr(10)) as ls from documents where text is not null),
l as (select doc_id, unnest(range(len(ls))) as n, """ + strip("unnest(ls)") + r""" as v from t),
k as (select *, v = '' as blank, starts_with(v, '#') or ends_with(v, '?') as stops, """ + strip("regexp_replace(" + strip("regexp_replace(v, '^#{1,6}\\s*', '')") + ", '(?i)^q:\\s*', '')") + r""" as question from l),
r as (select *, sum(case when blank or stops then 1 else 0 end) over (partition by doc_id order by n rows unbounded preceding) as run, min(case when not blank then n end) over (partition by doc_id order by n rows between 1 following and unbounded following) as next from k),
a as (select doc_id, run, min(n) as at, """ + strip("string_agg(regexp_replace(v, '(?i)^a:\\s*', ''), ' ' order by n)") + r""" as answer from r where not blank and not stops group by doc_id, run)
select r.doc_id, question, answer from r join a on r.doc_id = a.doc_id and r.next = a.at where ends_with(question, '?') and length(answer) > 0"""

_ASSET = strip(f"array_to_string(list_transform(string_split(regexp_replace(text, chr(13) || chr(10) || '?', chr(10), 'g'), chr(10)), lambda t: {strip('regexp_replace(t, ' + q('[ ' + chr(9) + ']+') + ', chr(32), chr(103))')}), chr(10))")
ASSET_CHUNKS = f"""with t as (select cast(item_id as varchar) as digest, {_ASSET} as t from eval_items where text is not null),
p as (select *, {pieces('t')} as ps from t), w as (select digest, unnest({windows('ps', 200, 40)}) as w from p where length(t) > 0),
c as (select digest, cast(w.a as int) as start_char, cast(w.a + length(w.t) as int) as end_char, w.t as text, sha1(unhex('{ids.POINTS.hex}') || encode(digest || ':' || w.a || '-' || (w.a + length(w.t)))) as h from w)
select digest, start_char, end_char, text, {uuid5('h')} as chunk_id from c"""

#: Links of sections: of the anchors with a target, the first of each target counts.
SECTION_ANCHORS = f"""with b as (select page_id, unnest(blocks) as b, unnest(range(len(blocks))) as pos from {PAGES} where len(blocks) > 0),
g as (select page_id, pos, b, sum(case when b.kind = 'heading' then 1 else 0 end) over (partition by page_id order by pos rows unbounded preceding) as g from b),
t as (select page_id, g, bool_or(length({strip(sql.block('b'))}) > 0) as has from g group by page_id, g),
i as (select page_id, g, row_number() over (partition by page_id order by g) - 1 as section_index from t where has),
a as (select page_id, g, pos, unnest(b.anchors) as a, unnest(range(len(b.anchors))) as n from g),
f as (select page_id, g, {strip("a.href")} as href, arg_min({strip("coalesce(a.label, chr(32))")}, pos * 100000 + n) as label from a where length({strip("a.href")}) > 0 group by 1, 2, 3)
select page_id, cast(section_index as int) as section_index, count(*) as links, count(*) filter (where length(label) > 0) as labelled from f join i using (page_id, g) group by page_id, section_index"""

PARENTS = f"{_run()} select page_id, chunk_key, text_digest from n where chunk_role = 'parent'"
DISTINCT_UNITS = "(select distinct unit_id, page_id, run_id, section_title, parent_index, child_index, parent_text, child_text from parent_child_units)"
ASSET_POINTS = f"""with i as (select item_id, {_ASSET} as t from eval_items where text is not null and item_id % 5 <> 0),
p as (select *, {pieces('t')} as ps from i), w as (select item_id, unnest({windows('ps', 200, 40)}) as w from p where length(t) > 0)
select 'r' || item_id as resource_id, cast(w.a as int) as start_char, cast(w.a + length(w.t) as int) as end_char, 384 as width from w"""
