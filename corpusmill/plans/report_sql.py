"""SQL of the document reports: outlines of pages, their sections, claims, findings, gaps and entities."""

from __future__ import annotations

from corpusmill.functions import text
from corpusmill.functions.generators import DIMENSIONS, MOST_MATCHES, NO_ENTITY
from corpusmill.functions.sites import SITE_PATTERN
from corpusmill.operators import evidence
from corpusmill.operators.reports import OPPORTUNITIES, READINESS
from corpusmill.plans import sql
from corpusmill.plans.sql import BLANK, PAGES, q, strip

#: `docs` of the report queries.
DOCS = f"""docs as materialized (select * from (select page_id as source_id, failure_reason is not null as partial, case when starts_with(regexp_extract(lower(origin), {q(SITE_PATTERN)}, 1), 'help.') then 'subject' else 'competitor' end as role,
  array_to_string(list_filter(list_transform(coalesce(blocks, []), lambda b: case when b.kind = 'heading' then repeat('#', cast(least(greatest(coalesce(b.level, 1), 1), 6) as int)) || ' ' || {sql.block('b')} when b.kind = 'listItem' then '- ' || {sql.block('b')} else {sql.block('b')} end), lambda t: length(t) > 0), chr(10)) as text from {PAGES}) t where length(text) > 0)"""

_HEAD = f"(?m)^(#{{1,6}})[{BLANK}]+(.+?)[{BLANK}]*$"
_PARTS = f"string_split(regexp_replace(text, {q(_HEAD)}, chr(1) || '\\2' || chr(2), 'g'), chr(1))"
_SENTENCES = f"list_filter(list_transform(string_split(regexp_replace(regexp_replace(body, '([.!?])(?:[{BLANK}]+|$)', '\\1' || chr(1), 'g'), ':\\n', ':' || chr(1), 'g'), chr(1)), lambda t: regexp_replace(t, '^[ \\n\\-*]+|[ \\n\\-*]+$', '', 'g')), lambda t: length(t) >= 3)"

#: Sections with their number, heading and body; claims, one row a sentence (none: one empty row a section).
SECTIONS = f"""parts as (select *, {_PARTS} as ps from docs),
listed as (select source_id, text, case when length({strip('ps[1]')}) > 0 then [struct_pack(heading := case when len(ps) = 1 then 'Document' else 'Preamble' end, body := {strip('ps[1]')})] else [] end
  || list_transform(ps[2:], lambda x: struct_pack(heading := {strip('split_part(x, chr(2), 1)')}, body := {strip('split_part(x, chr(2), 2)')})) as l from parts),
sections as (select source_id, text, unnest(range(len(l))) as section, unnest(l).heading as heading, unnest(l).body as body from listed)"""
CLAIMS = f"""{SECTIONS},
marked as (select *, {_SENTENCES} as ss, {sql.normalize('substr(text, 1, 40)')} as quote, {sql.normalize('text')} as whole from sections),
said as (select source_id, section, heading, quote, regexp_matches(quote, '[\\pL\\pN]') and length(quote) >= 12 and contains(whole, quote) as valid, unnest(case when len(ss) = 0 then [null] else ss end) as sentence, unnest(range(greatest(len(ss), 1))) as n from marked),
claims as (select *, coalesce(regexp_matches(sentence, {q(text.SPECIFIC)}), false) as specific, valid and (contains({sql.normalize('sentence')}, quote) or contains(quote, {sql.normalize('sentence')})) as supported from said)"""

DOCUMENT_SECTIONS = f"with {DOCS}, {SECTIONS} select source_id, 'section-' || (section + 1) as section_id, heading from sections"
CLAIM_ROWS = f"with {DOCS}, {CLAIMS} select source_id, case when sentence is not null then 'section-' || (section + 1) || '-claim-' || (n + 1) end as claim_id, specific, case when not specific then 'notFactual' when supported then 'supported' else 'unsupported' end as status from claims"
_DENSITY = """scored as (select source_id, section, count(sentence) as n, count(*) filter (where sentence is not null and specific) as facts, count(*) filter (where sentence is not null and specific and supported) as supported from claims group by source_id, section),
density as (select source_id, case when sum(n) > 0 then round(cast(sum(cast(case when n > 0 then round((facts + supported) / (2 * n) * 100, 1) else 0 end as decimal(10, 1)) * n) as double) / sum(n), 1) end as score from scored group by source_id)"""
FACT_DENSITY = f"with {DOCS}, {CLAIMS}, {_DENSITY} select source_id, score from density"


def _quotes(pattern: str, group: int) -> str:
    return f"(list_filter(list_transform(regexp_extract_all(text, {q(pattern)}, {group}), lambda t: {strip('t')}), lambda t: length(t) > 0))[1:{MOST_MATCHES}]"


def _pattern(name: str) -> str:
    flags = "(?im)" if DIMENSIONS[name].flags & 2 else "(?m)"
    return flags + DIMENSIONS[name].pattern.removeprefix("(?im)").removeprefix("(?m)").replace("\\s", f"[{BLANK}]")


#: One row a document and dimension.
FINDINGS = "found as (" + " union all ".join(f"select source_id, partial, role, {q(d)} as dimension, {_quotes(_pattern(d), p.groups)} as l from docs" for d, p in DIMENSIONS.items()) + """),
findings as (select *, len(l) as n, case when len(l) > 0 then true when not partial then false end as present from found)"""
FINDING_ROWS = f"with {DOCS}, {FINDINGS} select source_id, dimension, present, cast(n as int) as n from findings"

_FORM = f"array_to_string({sql.terms('signal')}, ' ')"
_GAPS = f"""own as (select dimension, case when bool_or(coalesce(present, false)) then true when not bool_or(partial) then false end as coverage from findings where role = 'subject' group by dimension),
others as (select dimension, count(*) filter (where present) as covering, count(*) as total from findings where role = 'competitor' group by dimension),
signals as (select distinct source_id, role, dimension, signal, {_FORM} as k from (select source_id, role, dimension, unnest(l) as signal from findings) t),
hidden as (select coalesce(bool_or(partial), false) as hidden from docs where role = 'subject'),
missing as (select k, arg_min(signal, source_id || chr(1) || signal) as signal from signals where dimension = 'topics' and role = 'competitor' and k not in (select k from signals where dimension = 'topics' and role = 'subject') group by k),
gaps as (select dimension, cast(null as varchar) as signal, case when coverage is null then 'coverageUnknown' else 'supportedGap' end as status, case when coverage is null then 'unknown' when covering = total then 'high' else 'medium' end as confidence from own join others using (dimension) where covering > 0 and coverage is distinct from true
  union all select 'topics', signal, case when hidden then 'coverageUnknown' else 'supportedGap' end, case when hidden then 'unknown' else 'medium' end from missing, hidden)"""
GAP_ROWS = f"with {DOCS}, {FINDINGS}, {_GAPS} select dimension, signal, status, confidence from gaps"


def _stable(prefix: str, *parts: str) -> str:
    return f"substr(sha256({q(prefix)} || {' || '.join(f'chr(31) || coalesce({p}, {q(str())})' for p in parts)}), 1, 24)"


_ADVICE = "case dimension " + " ".join(f"when {q(k)} then {q(v)}" for k, v in OPPORTUNITIES.items()) + " end"
ACTIONS = f"""with {DOCS}, {FINDINGS}, {_GAPS} select {_stable('action', 'dimension', 'signal', 'status')} as action_id, case when status = 'coverageUnknown' then 'low' when confidence = 'high' then 'high' else 'medium' end as tier, dimension, coalesce({_ADVICE}, '') as action, 'gap' as origin from gaps
union all select {_stable('opportunity', 'source_id', 'dimension')}, 'medium', dimension, {_ADVICE}, 'page' from findings where not present"""
ATTRIBUTES = f"with {DOCS}, {FINDINGS}, {_GAPS} select role, source_id, dimension, signal, role <> 'subject' and k not in (select k from signals x where x.role = 'subject' and x.dimension = signals.dimension) as only from signals"

#: A letter beyond ASCII is part of a word but not of a name, as an underscore is.
_NAMES = f"list_filter(list_transform(regexp_extract_all(regexp_replace(text, '[^\\x00-\\x7F\\pZ\\pP\\pS\\pC\\pM]', '_', 'g'), '\\b[A-Z][A-Za-z0-9&.-]+(?:[ \\t]+(?:[A-Z][A-Za-z0-9&.-]+|of|for|and|the)){{0,4}}\\b'), lambda t: trim(t)), lambda t: length(t) >= 3 and t not in ({', '.join(map(q, sorted(NO_ENTITY)))}))"
ENTITY_COUNTS = f"select doc_id, cast(len({_NAMES}) as int) as mentions from documents where text is not null"
ENTITIES = f"""with {DOCS}, m as (select source_id, unnest(l) as v, unnest(range(len(l))) as n from (select source_id, {_NAMES} as l from docs) t)
select source_id, substr(sha256('entity' || chr(31) || lower(v)), 1, 24) as entity_id, arg_min(v, n) as name, count(*) as mentions, cast(round(least(0.95, 0.55 + 0.1 * count(*)), 2) as double) as confidence from m group by source_id, lower(v)"""

#: Readiness of a document by dimension. There is no structured markup and no technical signal in these documents.
_HEADS = f"list_transform(regexp_extract_all(text, '(?m)^(#{{1,6}})[{BLANK}]+.+?[{BLANK}]*$', 1), lambda h: length(h))"
_FAQ = r"""fl as (select source_id, unnest(range(len(ls))) as n, """ + strip("unnest(ls)") + r""" as v from (select source_id, string_split(regexp_replace(text, '\r\n|\r|\x0b|\x0c|\x1c|\x1d|\x1e|\x{85}|\x{2028}|\x{2029}', chr(10), 'g'), chr(10)) as ls from docs) t),
fk as (select *, v = '' as blank, starts_with(v, '#') or ends_with(v, '?') as stops, """ + strip("regexp_replace(" + strip("regexp_replace(v, '^#{1,6}\\s*', '')") + ", '(?i)^q:\\s*', '')") + r""" as question from fl),
fr as (select *, sum(case when blank or stops then 1 else 0 end) over (partition by source_id order by n rows unbounded preceding) as run, min(case when not blank then n end) over (partition by source_id order by n rows between 1 following and unbounded following) as next from fk),
fa as (select source_id, min(n) as at, """ + strip("string_agg(regexp_replace(v, '(?i)^a:\\s*', ''), ' ' order by n)") + r""" as answer from fr where not blank and not stops group by source_id, run),
faq as (select fr.source_id, count(*) as pairs from fr join fa on fr.source_id = fa.source_id and fr.next = fa.at where ends_with(question, '?') and length(answer) > 0 group by fr.source_id)"""
_SIGNS = [r"(?im)^(?:by|author:)[{b}]+[^{b}]+", r"\b(?:19|20)\d{{2}}\b", r"(?im)^#{{1,6}}[{b}]+(?:sources|references)\b", r"(?i)\b(?:we tested|our experience|case study)\b", r"(?i)\baccording to\b"]
_FIRST = strip(f"regexp_replace(text, '(?m)^#{{1,6}}[{BLANK}]+.+?[{BLANK}]*$', '', 'g')")
READINESS_ROWS = f"""with {DOCS}, {CLAIMS}, {_DENSITY}, {_FAQ},
lv as (select source_id, partial, text, {_HEADS} as h, {_FIRST} as body from docs),
fs as (select *, ({_SENTENCES})[1] as first from lv),
d as (select fs.*, len(list_filter(h, lambda x, i: i > 1 and x > h[i - 1] + 1)) as skips, len(regexp_split_to_array({strip('first')}, '[{BLANK}]+')) as words, coalesce(pairs, 0) as pairs, density.score as facts from fs left join faq using (source_id) left join density using (source_id)),
r as (select source_id, unnest([{', '.join(map(q, READINESS))}]) as dimension, unnest([
  case when len(h) = 0 and partial then null when len(h) = 0 then 0.0 else greatest(0.0, 100.0 - case when list_contains(h, 1) then 0 else 30 end - 20 * skips) end,
  case when first is null then case when partial then null else 0.0 end when words <= 35 and not regexp_matches(first, '(?i)^(in this (article|post)|welcome|have you ever)') then 100.0 when words <= 60 then 65.0 else 30.0 end,
  case when pairs >= 3 then 100.0 when pairs > 0 then 70.0 when partial then null else 0.0 end, null, facts,
  case when partial then null else ({' + '.join(f'regexp_matches(text, {q(p.format(b=BLANK))})::int' for p in _SIGNS)}) * 20.0 end, null]::double[]) as score from d)
"""
READINESS_DIMENSIONS = READINESS_ROWS + "select source_id, dimension, score from r"
BEST_SCORES = READINESS_ROWS + "select dimension, max(score) as best, count(score) as known from r group by dimension"

#: Spans: each separator is set between marks, so that lengths add up to offsets.
SENTENCE_OFFSETS = f"""with m as (select doc_id, text, string_split(regexp_replace(regexp_replace(text, '([.!?])([{BLANK}]+|$)', '\\1' || chr(1) || '\\2' || chr(2), 'g'), ':(\\n)', ':' || chr(1) || '\\1' || chr(2), 'g'), chr(1)) as ps from documents where text is not null),
p as (select doc_id, text, unnest(ps) as p, unnest(range(len(ps))) as n from m),
o as (select doc_id, text, n, case when n = 0 then p else split_part(p, chr(2), 2) end as body, length(replace(p, chr(2), '')) as whole, case when n = 0 then 0 else length(split_part(p, chr(2), 1)) end as sep from p),
a as (select *, coalesce(sum(whole) over (partition by doc_id order by n rows between unbounded preceding and 1 preceding), 0) + sep as base, length(body) - length(regexp_replace(body, '^[ \\n\\-*]+', '')) as skipped, regexp_replace(body, '^[ \\n\\-*]+|[ \\n\\-*]+$', '', 'g') as s from o)
select doc_id, cast(base + skipped as int) as start, cast(base + skipped + length(s) as int) as "end", true as exact from a where length(s) >= 3"""

_TWO = "a as (select min(source_id) as id from docs where role = 'subject'), b as (select min(source_id) as id from docs where role = 'competitor')"
COVERAGE = f"""with {DOCS}, {_TWO}, m as (select source_id, unnest(l) as v, unnest(range(len(l))) as n from (select source_id, {_NAMES} as l from docs where source_id in (select id from a union all select id from b)) t),
e as (select source_id, lower(v) as entity_key, arg_min(v, n) as name from m group by source_id, lower(v))
select o.entity_key, coalesce(s.name, o.name) as name, case when s.name is null then 'missingOnSubject' else 'both' end as status from e o left join e s on s.entity_key = o.entity_key and s.source_id = (select id from a) where o.source_id = (select id from b)"""
COMPARISON = READINESS_ROWS.rstrip() + """, a as (select min(source_id) as id from docs where role = 'subject')
select x.dimension, x.score, y.best, round(x.score - y.best, 1) as delta from r x left join (select dimension, max(score) as best from r where source_id <> (select id from a) group by dimension) y using (dimension) where x.source_id = (select id from a)"""
GAP_SOURCES = f"""with {DOCS}, {FINDINGS}, {_GAPS} select f.dimension, cast(null as varchar) as signal, f.source_id from findings f join gaps g on g.dimension = f.dimension and g.signal is null where f.role = 'competitor' and f.present
union all select distinct 'topics', g.signal, s.source_id from gaps g join missing m on m.signal = g.signal join signals s on s.k = m.k and s.dimension = 'topics' and s.role = 'competitor'"""


def _fill(template: str, **values: str) -> str:
    for name, value in values.items():
        template = template.replace("{" + name + "}", f"' || {value} || '")
    return f"'{template}'"


#: A score as it is written, with one place at least.
_num = lambda x: f"(case when {x} = trunc({x}) then cast(cast({x} as bigint) as varchar) || '.0' else cast({x} as varchar) end)"
SUMMARIES = f"with {DOCS}, {FINDINGS} select source_id, dimension, case when present then {_fill(evidence.FOUND, n='n', dimension='dimension')} when present is null then {_fill(evidence.UNKNOWN, dimension='dimension')} else {_fill(evidence.ABSENT, dimension='dimension')} end as summary from findings"
DELTAS = f"""with c as ({COMPARISON}) select dimension, case when score is null and best is null then {_fill(evidence.BOTH_UNKNOWN, dimension='dimension')} when score is null then {_fill(evidence.SUBJECT_UNKNOWN, dimension='dimension', best=_num('best'))} when best is null then {_fill(evidence.BEST_UNKNOWN, dimension='dimension', score=_num('score'))}
  else {_fill(evidence.DELTA, dimension='dimension', score=_num('score'), best=_num('best'), delta=_num('delta'), relation="case when delta > 0 then 'ahead of' when delta < 0 then 'behind' else 'tied with' end")} end as summary from c"""
WARNINGS = f"with {DOCS} select source_id, {q(evidence.HEURISTIC)} || case when partial then chr(10) || {q(evidence.PARTIAL)} else '' end || case when role <> 'subject' then chr(10) || {q(evidence.DIGEST)} else '' end as warnings from docs"
PROVENANCE = f"with {DOCS}, {CLAIMS}, v as (select source_id, bool_or(valid) as valid from claims group by source_id) select source_id, url, case when valid then 'e-' || source_id else '' end as evidence_ids from docs join (select page_id as source_id, url from {PAGES}) using (source_id) left join v using (source_id)"
SENTENCE_EVIDENCE = f"""with s as ({SENTENCE_OFFSETS}), w as (select doc_id, text, case when "end" - start < 12 then greatest(0, start - (12 - ("end" - start))) else start end as a, start, "end" as e from s join documents using (doc_id)),
x as (select doc_id, text, a, case when e - start < 12 then least(length(text), greatest(e, a + 12)) else e end as z from w)
select doc_id, cast(a as int) as start_char, cast(z as int) as end_char, substr(text, a + 1, z - a) as quote, substr(sha256(doc_id || chr(31) || a || chr(31) || z || chr(31) || substr(text, a + 1, z - a)), 1, 24) as evidence_id from x"""
