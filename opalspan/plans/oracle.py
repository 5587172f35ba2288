"""DuckDB SQL for the queries, written apart from them: windows and lists in place of folds."""

from __future__ import annotations

from opalspan.functions.detect import EMAIL
from opalspan.functions.spans import MODEL_LABELS
from opalspan.operators.model_output import TASK
from opalspan.plans.queries import DECISIONS, KEY, SEED

#: The patterns without look-around, which DuckDB's engine lacks; neighbours are checked with substr instead.
_PATTERNS = {
    "EMAIL": EMAIL.removeprefix(r"(?U)(?<![\w.+-])").removesuffix(r"(?![\w-])").replace("'", "''"),
    "CREDITCARDNUMBER": r"[0-9](?:[ .-]?[0-9]){12,18}",
    "IPADDRESS": r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}",
    "TELEPHONENUM": r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,5}\)[ .-]?)?[0-9]{2,6}(?:[ .-]?[0-9]{2,6}){1,4}",
}
_DIGITS = "regexp_replace(value, '[^0-9]', '', 'g')"
_LUHN = (
    f"list_sum(list_transform(range(len({_DIGITS})), lambda i: case when i % 2 = 0 then cast(substr({_DIGITS}, cast(len({_DIGITS}) - i as bigint), 1) as int) "
    f"else (2 * cast(substr({_DIGITS}, cast(len({_DIGITS}) - i as bigint), 1) as int)) // 10 + (2 * cast(substr({_DIGITS}, cast(len({_DIGITS}) - i as bigint), 1) as int)) % 10 end)) % 10 = 0"
)
_CHECKS = {
    "EMAIL": r"not regexp_matches(before, '[\pL\pN_.+-]') and not regexp_matches(after, '[\pL\pN_-]')",
    "CREDITCARDNUMBER": rf"not regexp_matches(before, '[\pL\pN_.-]') and not regexp_matches(after, '[\pL\pN_-]') and len({_DIGITS}) between 13 and 19 and len(list_distinct(regexp_extract_all(value, '[^0-9]'))) <= 1 and {_LUHN}",
    "IPADDRESS": r"not regexp_matches(before, '[0-9.]') and not regexp_matches(after, '[0-9.]') and list_bool_and(list_transform(string_split(value, '.'), lambda p: cast(p as int) <= 255 and (p = '0' or p[1] <> '0')))",
    "TELEPHONENUM": rf"not regexp_matches(before, '[\pL\pN_.+]') and not regexp_matches(after, '[\pL\pN_-]') and case when value[1] = '+' then regexp_matches({_DIGITS}, '^1[2-9][0-9]{{2}}[2-9][0-9]{{6}}$') or regexp_matches({_DIGITS}, '^440?[1-9][0-9]{{8,9}}$') or regexp_matches({_DIGITS}, '^910?[6-9][0-9]{{9}}$') else regexp_matches({_DIGITS}, '^1?[2-9][0-9]{{2}}[2-9][0-9]{{6}}$|^0[1-9][0-9]{{8,9}}$|^[6-9][0-9]{{9}}$') end",
}


def _hits(label: str) -> str:
    """Matches with their starts. A card's pattern takes the character after it too, so that a longer run of digits is
    given up for a shorter one that ends rightly."""
    p = _PATTERNS[label] + (r"(?:[^\pL\pN_-]|$)" if label == "CREDITCARDNUMBER" else "")
    return f"""
select doc_id, text, '{label}' as label, regexp_extract(m[i], '{_PATTERNS[label]}') as value, i,
  list_sum(list_transform(a[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0) as start_at
from (select doc_id, text, regexp_extract_all(text, '{p}') as m, regexp_split_to_array(text, '{p}') as a from docs), unnest(range(1, len(m) + 1)) as u(i)
"""


def _checked(label: str) -> str:
    near = "case when start_at = 0 then '' else substr(text, cast(start_at as bigint), 1) end as before, substr(text, cast(start_at + len(value) + 1 as bigint), 1) as after"
    return f"select doc_id, cast(start_at as bigint) as start_at, cast(start_at + len(value) as bigint) as end_at, label, value from (select *, {near} from ({_hits(label)})) where {_CHECKS[label]}"


_DOCS = "docs as (select doc_id, coalesce(text, '') as text, lang, source from documents)"
_FOUND = f"""
{_DOCS}, sure as ({_checked('EMAIL')} union all {_checked('CREDITCARDNUMBER')} union all {_checked('IPADDRESS')}), tel as ({_checked('TELEPHONENUM')}),
found as (select * from sure union all select * from tel t where not exists (select 1 from sure s where s.doc_id = t.doc_id and s.start_at < t.end_at and t.start_at < s.end_at))
"""
FOUND = _FOUND


def _redacted(spans: str, replacement: str) -> str:
    """Pieces between spans and replacements, in order, joined."""
    return f"""
cuts as (select s.*, coalesce(lag(end_at) over (partition by doc_id order by start_at), 0) as left_at, {replacement} as repl from {spans} s),
parts as (select c.doc_id, string_agg(substr(d.text, cast(left_at + 1 as bigint), cast(start_at - left_at as bigint)) || repl, '' order by start_at) as head, max(end_at) as tail_at, count(*) as n from cuts c join docs d using (doc_id) group by c.doc_id)
select d.doc_id, coalesce(p.head, '') || substr(d.text, cast(coalesce(p.tail_at, 0) + 1 as bigint)) as {{name}}{{extra}} from docs d left join parts p using (doc_id)
"""


def _replace(replacement: str, name: str, extra: str = "") -> str:
    return f"with {_FOUND}, {_redacted('found', replacement)}".replace("{name}", name).replace("{extra}", extra)


_LABEL = "'[' || label || ']'"
_CROSSING = "select doc_id, start_at, end_at, label, 'validator' as source, 0 as ord from found union all select f.doc_id, start_at + 2, least(end_at + 3, len(d.text)), 'OTHER', 'llm', 1 from found f join docs d using (doc_id)"
_UNION = f"""
with {_FOUND}, every as ({_CROSSING}),
edges as (select *, max(end_at) over (partition by doc_id order by start_at, end_at desc, ord rows between unbounded preceding and 1 preceding) as edge from every),
islands as (select *, sum(case when start_at < edge then 0 else 1 end) over (partition by doc_id order by start_at, end_at desc, ord rows unbounded preceding) as island from edges)
select doc_id, min(start_at) as start_at, cast(max(end_at) as bigint) as end_at, arg_max(label, (case when source = 'validator' then 1000000 else 0 end) + end_at - start_at) as label,
  case when min(source) = max(source) then min(source) else 'merged' end as source from islands group by doc_id, island
"""
_GOLD = f"""
{_FOUND}, gold as (select distinct doc_id, start_at, end_at, label from found),
pred as (select g.doc_id, start_at, case when g.doc_id % 7 = 0 then least(end_at + 1, len(d.text)) else end_at end as end_at, label from gold g join docs d using (doc_id) where g.doc_id % 5 <> 0),
gp as (select distinct doc_id, unnest(range(start_at, end_at)) as p from gold), pp as (select distinct doc_id, unnest(range(start_at, end_at)) as p from pred),
scored as (
  select d.doc_id, d.lang, d.source,
    (select count(*) from gp where gp.doc_id = d.doc_id) as gold_chars,
    (select count(*) from gp where gp.doc_id = d.doc_id and not exists (select 1 from pp where pp.doc_id = gp.doc_id and pp.p = gp.p)) as leaked_chars,
    (select count(*) from pp where pp.doc_id = d.doc_id) as pred_chars,
    (select count(*) from pp where pp.doc_id = d.doc_id and not exists (select 1 from gp where pp.doc_id = gp.doc_id and pp.p = gp.p)) as over_chars,
    (select count(*) from gold g where g.doc_id = d.doc_id) as n_gold, (select count(*) from pred g where g.doc_id = d.doc_id) as n_pred,
    (select count(*) from gold g join pred q using (doc_id, start_at, end_at, label) where g.doc_id = d.doc_id) as strict_tp,
    (select count(*) from gold g where g.doc_id = d.doc_id and exists (select 1 from pp where pp.doc_id = g.doc_id and p >= start_at and p < end_at)) as partial_gold_hit,
    (select count(*) from pred g where g.doc_id = d.doc_id and exists (select 1 from gp where gp.doc_id = g.doc_id and p >= start_at and p < end_at)) as partial_pred_hit
  from docs d
), full_scores as (select *, cast(leaked_chars > 0 as bigint) as leaks from scored)
"""


def _ratio(a: str, b: str, empty: str = "0.0") -> str:
    return f"(case when {b} > 0 then {a} / {b} else {empty} end)"


def _f1(p: str, r: str) -> str:
    return f"(case when {p} + {r} > 0 then 2 * {p} * {r} / ({p} + {r}) else 0.0 end)"


_P, _R = _ratio("sum(strict_tp)", "sum(n_pred)", "1.0"), _ratio("sum(strict_tp)", "sum(n_gold)", "1.0")
_PP, _PR = _ratio("sum(partial_pred_hit)", "sum(n_pred)", "1.0"), _ratio("sum(partial_gold_hit)", "sum(n_gold)", "1.0")
_MEASURES = f"""count(*) as docs, cast(sum(n_gold) as bigint) as n_gold_spans, cast(sum(n_pred) as bigint) as n_pred_spans, round({_ratio('sum(leaked_chars)', 'sum(gold_chars)')}, 6) as leakage_chars,
round(sum(leaks) / count(*), 6) as leakage_docs, round({_ratio('sum(leaks)', 'sum(cast(gold_chars > 0 as int))')}, 6) as leakage_gold_docs, round({_ratio('sum(over_chars)', 'sum(pred_chars)')}, 6) as over_redaction,
round({_P}, 6) as strict_precision, round({_R}, 6) as strict_recall, round({_f1(_P, _R)}, 6) as strict_f1, round({_PP}, 6) as partial_precision, round({_PR}, 6) as partial_recall, round({_f1(_PP, _PR)}, 6) as partial_f1"""
_WORDS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w <> '')"


def _draw(*parts: str) -> str:
    key = " || '|' || ".join(f"cast({p} as varchar)" for p in parts)
    return f"cast('0x' || substr(md5({key}), 1, 15) as bigint)"


def _sample(*parts: str) -> str:
    return f"{_draw(str(SEED), *parts)}"


_LEAK = {"leak": ("leaked_chars", "gold_chars"), "over": ("over_chars", "pred_chars"), "doc": ("leaks", "has_gold")}
_WEIGHTED = ", ".join(_ratio(f"sum({a} * draws)", f"sum({b} * draws)") + f" as {k}" for k, (a, b) in _LEAK.items())
_PLAIN = ", ".join(_ratio(f"sum({a})", f"sum({b})") + f" as {k}" for k, (a, b) in _LEAK.items())
_BOOTSTRAP = f"""
with {_GOLD}, counts as (select lang as set, row_number() over (partition by lang order by doc_id) - 1 as pos, *, cast(gold_chars > 0 as int) as has_gold from full_scores),
sizes as (select set, count(*) as size from counts group by set),
picked as (select c.set, r.rep, {_sample('c.set', 'r.rep', 'c.pos')} % s.size as pos from counts c join sizes s using (set), range(100) r(rep)),
draws as (select set, rep, pos, count(*) as draws from picked group by all),
samples as (select set, rep, {_WEIGHTED} from counts join draws using (set, pos) group by set, rep),
points as (select set, {_PLAIN} from counts group by set)
select set, metric, round(point, 6) as point, round(lo, 6) as lo, round(hi, 6) as hi from (
{' union all '.join(f"select p.set, '{k}' as metric, any_value(p.{k}) as point, quantile_cont(s.{k}, 0.025) as lo, quantile_cont(s.{k}, 0.975) as hi from points p join samples s using (set) group by p.set" for k in _LEAK)}
)
"""
_RESULTS = f"results as (select source as tag, lang as testset, {_ratio('sum(leaked_chars)', 'sum(gold_chars)')} as leakage_chars, {_ratio('sum(over_chars)', 'sum(pred_chars)')} as over_redaction from full_scores group by all)"
_CANDIDATES = f"""
with {_GOLD}, {_RESULTS}, cands as (select tag, case when count(*) filter (testset = 'en') = 1 then avg(100 * leakage_chars) filter (testset = 'en') end as leak, case when count(*) filter (testset = 'en') = 1 then avg(100 * over_redaction) filter (testset = 'en') end as over,
avg(100 * leakage_chars) filter (testset in ('fr', 'de')) as in_dist from results group by tag)
"""
_MISSES = """
select 'fixed' as status, a.label from a anti join b using (doc_id, start_at, end_at) union all
select 'still_missed', a.label from a semi join b using (doc_id, start_at, end_at) union all
select 'new', b.label from b anti join a using (doc_id, start_at, end_at)
"""
_STRATA = f"""
with {_FOUND}, freq as (select label, count(*) as n from found group by label),
rare as (select doc_id, arg_min(label, (n, label)) as label from (select distinct doc_id, label from found) join freq using (label) group by doc_id),
strata as (select d.doc_id, coalesce(source, '?') || '|' || coalesce(r.label, 'NONE') as stratum from docs d left join rare r using (doc_id))
select doc_id, stratum, round((row_number() over (partition by stratum order by {_sample('doc_id')}, doc_id) - 1 + ({_draw(str(SEED), "'u'", 'doc_id')} % 1000000) / 1000000) / count(*) over (partition by stratum), 9) as place from strata
"""
_GRAMS = "select distinct {key}, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) as gram from (select {key}, regexp_extract_all(lower(coalesce(text, '')), '[\\pL\\pN\\pM_]+') as w from {t})"
_SHINGLES = f"""
tok as (select doc_id, lang, {_WORDS} as w from documents),
sh as (select doc_id, lang, list_distinct(case when len(w) > 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) else [array_to_string(w, ' ')] end) as s from tok)
"""
_TURNS = "select conv_id, turn, upper(role[1]) || lower(role[2:]) || ': ' || coalesce(text, '') as line from conversations where role <> 'action'"

_FILLED = """
with w as (select doc_id, text, regexp_extract_all(text, '[A-Za-z]+') as w from (select doc_id, coalesce(text, '') as text from documents)),
g as (select doc_id, text, [w[2], w[1], w[4]] as v from w where len(w) >= 4),
p as (select doc_id, i, g.text, v[i + 1] as value, regexp_split_to_array(chr(1) || regexp_replace(g.text, '([^\\pL\\pN\\pM_])', chr(2) || '\\1' || chr(2), 'g') || chr(1), chr(2)) as parts from g, range(3) r(i)),
t as (select doc_id, i, value, list_filter(list_transform(range(1, len(parts) + 1), lambda k: case when replace(parts[k], chr(1), '') = value then coalesce(list_sum(list_transform(parts[1:k - 1], lambda x: len(replace(x, chr(1), '')))), 0) end), lambda x: x is not null) as places from p),
a as (select doc_id, value, places, places[1] as s from t where i = 0),
b as (select t.doc_id, t.value, coalesce(list_filter(t.places, lambda x: x >= coalesce(a.s + len(a.value), 0))[1], t.places[1]) as s, coalesce(a.s + len(a.value), 0) as at from t join a using (doc_id) where i = 1),
c as (select t.doc_id, t.value, coalesce(list_filter(t.places, lambda x: x >= coalesce(b.s + len(b.value), b.at))[1], t.places[1]) as s from t join b using (doc_id) where i = 2)
select doc_id, 0 as place, cast(s as bigint) as start_at, value from a union all select doc_id, 1, cast(s as bigint), value from b union all select doc_id, 2, cast(s as bigint), value from c
"""
_DELTAS = f"""
with {_GOLD}, both_ as (select doc_id, start_at, end_at from pred union select doc_id, start_at, end_at from gold where label = 'EMAIL'), bp as (select distinct doc_id, unnest(range(start_at, end_at)) as p from both_),
w as (select d.doc_id, d.source, d.lang, (select count(*) from gp where gp.doc_id = d.doc_id) as g, (select count(*) from gp where gp.doc_id = d.doc_id and not exists (select 1 from bp where bp.doc_id = gp.doc_id and bp.p = gp.p)) as l,
  (select count(*) from bp where bp.doc_id = d.doc_id) as r, (select count(*) from bp where bp.doc_id = d.doc_id and not exists (select 1 from gp where gp.doc_id = bp.doc_id and gp.p = bp.p)) as o from docs d),
m as (select source, lang, round(100 * {_ratio('sum(leaked_chars)', 'sum(gold_chars)')}, 6) as model_leak, round(100 * {_ratio('sum(over_chars)', 'sum(pred_chars)')}, 6) as model_over from full_scores group by all),
x as (select source, lang, round(100 * {_ratio('sum(l)', 'sum(g)')}, 6) as whole_leak, round(100 * {_ratio('sum(o)', 'sum(r)')}, 6) as whole_over from w group by all)
select m.source, m.lang, model_leak, whole_leak, model_over, whole_over, round(whole_leak - model_leak, 6) as leak_change from m join x on m.source is not distinct from x.source and m.lang is not distinct from x.lang
"""


def _blob(b: bytes) -> str:
    return "'" + "".join(f"\\x{x:02X}" for x in b) + "'::blob"


_KEY = KEY.ljust(64, b"\0")
_MAC = f"sha256({_blob(bytes(x ^ 0x5C for x in _KEY))} || unhex(sha256({_blob(bytes(x ^ 0x36 for x in _KEY))} || encode('default' || chr(0) || label || chr(0) || value))))"
_HASHED = f"'<' || label || ':' || substr({_MAC}, 1, 12) || '>'"
#: Words of the conversations with their places: the character before a capitalised word must be none of a word.
_WORD = r"[\pL\pN\pM_]"
_TURN_WORDS = rf"""
turns as (select conv_id, turn, coalesce(text, '') as text from conversations),
cut as (select conv_id, turn, text, regexp_extract_all(text, '{_WORD}+') as m, regexp_split_to_array(text, '{_WORD}+') as a from turns),
said as (select conv_id, turn, text, i, m[i] as value, list_sum(list_transform(a[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0) as s from cut, unnest(range(1, len(m) + 1)) as u(i))
"""
_TOKENS = rf"""
with {_TURN_WORDS}, seen as (select conv_id, value, min((turn, -s)) as first from said where regexp_full_match(value, '\p{{Lu}}\p{{Ll}}{{3,}}') group by all),
n as (select cast(conv_id as varchar) as conversation, row_number() over (partition by conv_id order by first) as n from seen)
select conversation, 'GIVENNAME' as label, n, '<GIVENNAME_' || n || '>' as token from n
"""
#: Pieces between names and their tokens, in order, joined.
_PSEUDONYMS = rf"""
with {_TURN_WORDS}, names as (select conv_id, turn, text, value, s from said where regexp_full_match(value, '\p{{Lu}}\p{{Ll}}{{3,}}')),
seen as (select conv_id, value, min((turn, -s)) as first from names group by all),
known as (select conv_id, value, row_number() over (partition by conv_id order by first) as n from seen),
cuts as (select names.*, n, coalesce(lag(s + len(value)) over (partition by conv_id, turn order by s), 0) as left_at from names join known using (conv_id, value)),
parts as (select conv_id, turn, string_agg(substr(text, cast(left_at + 1 as bigint), cast(s - left_at as bigint)) || '<GIVENNAME_' || n || '>', '' order by s) as head, max(s + len(value)) as tail_at from cuts group by all)
select cast(t.conv_id as varchar) as conversation, t.turn, coalesce(head, '') || substr(t.text, cast(coalesce(tail_at, 0) + 1 as bigint)) as redacted from turns t left join parts using (conv_id, turn)
"""
_HIGHLIGHTS = f"""
with {_FOUND}, s as (select f.*, text, coalesce(lag(end_at) over (partition by f.doc_id order by start_at), 0) as left_at from found f join docs using (doc_id)),
parts as (select doc_id, start_at as pos, 0 as k, substr(text, cast(left_at + 1 as bigint), cast(start_at - left_at as bigint)) as segment, null::varchar as label from s
  union all select doc_id, start_at, 1, value, label from s
  union all select d.doc_id, 1000000000, 0, substr(d.text, cast(coalesce(max(end_at), 0) + 1 as bigint)), null from docs d left join found f using (doc_id) group by d.doc_id, d.text)
select doc_id, row_number() over (partition by doc_id order by pos, k) - 1 as place, segment, label from parts where len(segment) > 0
"""
_BIOES = rf"""
with {_TURN_WORDS}, tags as (select *, s + len(value) as e from said where regexp_matches(value, '^\p{{Lu}}')),
near as (select *, lag(e) over (partition by conv_id, turn order by s) as pe from tags),
isl as (select *, sum(case when pe is not null and trim(translate(substr(text, cast(pe + 1 as bigint), cast(s - pe as bigint)), chr(10) || chr(9) || chr(13), '   ')) = '' then 0 else 1 end) over (partition by conv_id, turn order by s rows unbounded preceding) as island from near)
select conv_id || ':' || turn as doc_id, cast(min(s) as bigint) as start_at, cast(max(e) as bigint) as end_at, 'NAME' as label from isl group by conv_id, turn, island
"""
#: Windows one after the other, 1,500 characters with 200 shared: where the next starts, and where this one ends.
_CHUNKS = """
with recursive docs as (select doc_id, coalesce(text, '') as text from documents),
first as (select doc_id, text, 0 as b0 from docs),
w(doc_id, text, b0, stop) as (
  select doc_id, text, b0, case when len(text) <= 1500 then len(text) when strpos(reverse(substr(text, 202, 1299)), ' ') > 0 then 1500 - strpos(reverse(substr(text, 202, 1299)), ' ') when strpos(reverse(substr(text, 202, 1299)), chr(10)) > 0 then 1500 - strpos(reverse(substr(text, 202, 1299)), chr(10)) else 1500 end from first
  union all
  select doc_id, text, n, case when len(text) <= n + 1500 then len(text) when strpos(reverse(substr(text, n + 202, 1299)), ' ') > 0 then n + 1500 - strpos(reverse(substr(text, n + 202, 1299)), ' ') when strpos(reverse(substr(text, n + 202, 1299)), chr(10)) > 0 then n + 1500 - strpos(reverse(substr(text, n + 202, 1299)), chr(10)) else n + 1500 end
  from (select doc_id, text, case when strpos(substr(text, stop - 199, 200), ' ') > 0 then stop - 200 + strpos(substr(text, stop - 199, 200), ' ') else stop - 200 end as n from w where stop < len(text))
)
select doc_id, count(*) as n_chunks, max(stop - b0) as longest from w group by doc_id
"""

ORACLE: dict[str, str] = {
    "detect_emails": f"with {_DOCS} {_checked('EMAIL')}",
    "detect_cards_luhn": f"with {_DOCS} {_checked('CREDITCARDNUMBER')}",
    "detect_ipv4": f"with {_DOCS} {_checked('IPADDRESS')}",
    "detect_phones": f"with {_DOCS} {_checked('TELEPHONENUM')}",
    "detect_validators": f"with {_FOUND} select * from found",
    "span_union_recall_first": _UNION,
    "span_union_relation": _UNION,
    "span_merge_same_label": f"with {_FOUND}, every as (select doc_id, label, start_at, end_at from found union all select f.doc_id, label, start_at + 1, least(end_at + 4, len(d.text)) from found f join docs d using (doc_id)), edges as (select *, max(end_at) over (partition by doc_id, label order by start_at, end_at rows between unbounded preceding and 1 preceding) as edge from every), islands as (select *, sum(case when start_at < edge then 0 else 1 end) over (partition by doc_id, label order by start_at, end_at rows unbounded preceding) as island from edges) select doc_id, min(start_at) as start_at, cast(max(end_at) as bigint) as end_at, label from islands group by doc_id, label, island",
    "span_drop_contained": f"with {_FOUND} select doc_id, start_at, end_at, label from found",
    "span_dedupe": f"with {_FOUND} select doc_id, start_at, end_at, label from found",
    "redact_mask_support": _replace(_LABEL, "redacted", ", coalesce(p.n, 0) as n_entities"),
    "redact_strict": _replace(_LABEL, "redacted", ", coalesce(p.n, 0) as n_entities"),
    "mask_template": _replace(_LABEL, "masked"),
    "inline_masked": _replace("'[' || label || ': ' || value || ']'", "masked"),
    "entities_by_label": f"with {_FOUND} select lang, label, 'pseudonymize' as action, count(*) as n from found join docs using (doc_id) group by all",
    "label_map_default": f"with {_FOUND} select case label when 'EMAIL' then 'EMAIL' when 'CREDITCARDNUMBER' then 'CODE' else 'IGNORE' end as label, count(*) as n from found group by 1",
    "context_window": f"with {_FOUND} select doc_id, start_at, translate('…' || substr(text, cast(greatest(0, start_at - 60) + 1 as bigint), cast(least(60, start_at) as bigint)) || '«' || value || '»' || substr(text, cast(end_at + 1 as bigint), 60) || '…', chr(10), ' ') as context from found join docs using (doc_id)",
    "shingles_5": f"with {_SHINGLES} select doc_id, len(s) as n_shingles from sh",
    "ngram_contamination_benchmark": f"select distinct doc_id from ({_GRAMS.format(key='doc_id', t='documents')}) semi join ({_GRAMS.format(key='item_id', t='benchmark')}) using (gram)",
    "near_dup_exact_jaccard": f"with {_SHINGLES}, ex as (select doc_id, lang, len(s) as n, unnest(s) as g from sh), pool as (select min(doc_id) as doc_id, s from (select doc_id, list_sort(s) as s from sh where lang = 'en') group by s), pe as (select doc_id, len(s) as n, unnest(s) as g from pool), hit as (select a.doc_id as id, b.doc_id as other, a.n as n, b.n as m, count(*) as k from ex a join pe b using (g) where a.lang <> 'en' group by all) select id, other, round(k / (n + m - k), 6) as jaccard from hit where k / (n + m - k) >= 0.8",
    "stratified_order": _STRATA,
    "equal_share_sample": f"with groups as (select lang, row_number() over (order by lang) - 1 as r, count(*) over () as g from (select distinct lang from documents)), ranked as (select doc_id, lang, row_number() over (partition by lang order by {_sample('doc_id')}, doc_id) as k from documents) select doc_id, lang from ranked join groups using (lang) where k <= 30 // g + case when r < 30 % g then 1 else 0 end",
    "transcript_assembly": f"select conv_id, md5(t) as digest, len(t) as n_chars from (select conv_id, string_agg(line, chr(10) order by turn) as t from ({_TURNS}) group by conv_id)",
    "score_docs": f"with {_GOLD} select doc_id, gold_chars, leaked_chars, pred_chars, over_chars, leaks, strict_tp, n_gold, n_pred, partial_gold_hit, partial_pred_hit from full_scores",
    "metrics_overall": f"with {_GOLD} select {_MEASURES} from full_scores",
    "metrics_by_group": f"with {_GOLD} select 'lang' as key, lang as value, {_MEASURES} from full_scores where lang is not null group by lang union all select 'source', source, {_MEASURES} from full_scores where source is not null group by source",
    "bootstrap_ci": _BOOTSTRAP,
    "wilson_error_rate": "with c as (select lang as label, count(*) as n, count(*) filter (quality is null or quality <> 1) as errors from labels join documents using (doc_id) group by lang), m as (select *, errors / n as p, 1.96 as z from c) select label, n, errors, 0 as unknown, round(p, 6) as rate, round(greatest(0, ((p + z * z / (2 * n)) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 6) as lo, round(least(1, ((p + z * z / (2 * n)) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 6) as hi from m",
    "known_misses": f"with {_GOLD}, a as (select * from gold g where not exists (select 1 from pred p where p.doc_id = g.doc_id and p.start_at < g.end_at and g.start_at < p.end_at)), b as (select * from gold where doc_id % 3 = 0) select status, label, count(*) as n from ({_MISSES}) group by all",
    "sweep_candidates": f"{_CANDIDATES} select tag, round(leak, 6) as leak, round(over, 6) as over, round(in_dist, 6) as in_dist, true as sane from cands",
    "select_winner_tie_band": f"{_CANDIDATES} select tag, round(leak, 6) as leak, round(over, 6) as over from cands where leak - (select min(leak) from cands) < 1.0 order by over, in_dist nulls last, tag limit 1",
    "decision_matrix": f"select tag, case when leak - base_leak > 0.15 and lo > 0 then 'D' when (base_leak - leak) / base_leak >= 0.2 and hi < 0 then 'A' when abs(leak - base_leak) < 0.15 and base_over - over >= 1.5 and over_hi < 0 then 'B' else 'C' end as verdict from (values {DECISIONS}) v(tag, leak, over, base_leak, base_over, lo, hi, over_hi)",
    "result_pivot": f"with {_GOLD} select source, " + ", ".join(f"round(case when count(*) filter (lang = '{x}') > 0 then coalesce({_ratio(f'sum(leaked_chars) filter (lang = {chr(39)}{x}{chr(39)})', f'sum(gold_chars) filter (lang = {chr(39)}{x}{chr(39)})')}, 0) end, 6) as {x}" for x in ("de", "en", "es", "fr")) + " from full_scores group by source",
    "latency_percentiles": "with l as (select event_type, value as ms, len(props) + 1 as chars from events) select event_type, round(quantile_cont(ms / chars * 1000, 0.5), 4) as p50_ms, round(quantile_cont(ms / chars * 1000, 0.95), 4) as p95_ms, round(sum(chars) / (sum(ms) / 1000), 4) as chars_per_s from l group by event_type",
    "rate_limit_sliding": "with c as (select event_id, user_id, ts, epoch(date_trunc('second', ts))::bigint as s from events), n as (select event_id, count(*) over (partition by user_id order by s range between 59 preceding and current row) as in_minute, count(*) over (partition by user_id, cast(ts as date) order by s range between unbounded preceding and current row) as in_day from c) select *, in_minute <= 2 and in_day <= 5 as allowed from n",
    "normalize_offsets": "select doc_id, md5(coalesce(text, '')) as digest, case when regexp_matches(coalesce(text, ''), '^[\\x00-\\x7f]*$') then 0 else len(text) end as n_origin from documents",
    "metrics_by_label": f"with {_GOLD}, labels_ as (select label from gold union select label from pred), g as (select label, count(*) as n_gold, sum((select count(*) from gp where gp.doc_id = gold.doc_id and p >= start_at and p < end_at)) as chars, sum((select count(*) from gp where gp.doc_id = gold.doc_id and p >= start_at and p < end_at and not exists (select 1 from pp where pp.doc_id = gp.doc_id and pp.p = gp.p))) as leaked from gold group by label), q as (select label, count(*) as n_pred from pred group by label), t as (select label, count(*) as tp from gold join pred using (doc_id, start_at, end_at, label) group by label), m as (select l.label, coalesce(n_gold, 0) as n_gold, coalesce(n_pred, 0) as n_pred, coalesce(tp, 0) as tp, coalesce(chars, 0) as chars, coalesce(leaked, 0) as leaked from labels_ l left join g using (label) left join q using (label) left join t using (label)), pr as (select *, case when n_pred > 0 then tp / n_pred else 1.0 end as p, case when n_gold > 0 then tp / n_gold else 1.0 end as r from m) select label, n_gold, n_pred, round(case when chars > 0 then leaked / chars else 0 end, 6) as leakage_chars, round(p, 6) as precision, round(r, 6) as recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 6) as f1 from pr",
    "extract_stats": f"with {_FOUND} select 'rows' as measure, '' as name, count(*)::double as value from docs union all select 'chars', '', sum(len(text)) from docs union all select 'length', 'p50', floor(quantile_cont(len(text), 0.5)) from docs union all select 'length', 'p95', floor(quantile_cont(len(text), 0.95)) from docs union all select 'length', 'max', max(len(text)) from docs union all select 'rows_per_language', lang, count(*) from docs group by lang union all select 'spans_per_label', label, count(*) from found group by label",
    "detect_chunked": f"with {_DOCS} select doc_id, start_at, end_at, label from ({_checked('EMAIL')})",
    "spoken_digits": "select c_custkey, concat(c_custkey, lpad(cast(c_nationkey as varchar), 2, '0'), '0055', replace(cast(cast(round(c_acctbal) as bigint) as varchar), '-', ''), '41', c_nationkey, '455500') as digits from customer",
    "split_name": "with p as (select c_custkey as k, ['Dr.', 'Ms', null, 'Prof.'][c_custkey % 4 + 1] as title, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) as given, [null, 'van ', 'de la '][c_custkey % 3 + 1] as particle, upper(r_name[1]) || lower(replace(r_name, ' ', '')[2:]) as place from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey) select k as c_custkey, case when k % 7 <> 0 then title end as title, case when k % 7 = 0 then null when k % 5 <> 0 then given when title is null then place end as given, case when k % 7 = 0 then null when k % 5 <> 0 then coalesce(particle, '') || place when title is not null then place end as surname from p",
    "parse_llm_json": "with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+') as w from documents), d as (select doc_id, w[1] as a, w[2] as b from w where len(w) >= 2) select doc_id, doc_id % 4 < 2 as valid_json, 'GIVENNAME' as label, a as text from d union all select doc_id, true, 'CITY', b || ' \"x\"' from d where doc_id % 4 < 2",
    "vault_ttl_purge": "select user_id as conversation, min(ts) as created from events group by user_id having floor(epoch(min(ts))) < (select floor(epoch(min(ts))) + 3600 from events)",
    "restore_roundtrip": "select cast(conv_id as varchar) as conversation, turn, md5(coalesce(text, '')) as digest from conversations",
    "normalize_look_alikes": "select doc_id, md5(text) as digest, len(text) as n_origin, len(text) + len(regexp_replace(text, '[^e]', '', 'g')) - 1 - case when text[-1] = 'e' then 1 else 0 end as last from documents where text <> '' and regexp_matches(text, '[aoe]|[^\\x00-\\x7f]') union all select doc_id, md5(text), null, null from documents where text <> '' and not regexp_matches(text, '[aoe]|[^\\x00-\\x7f]')",
    "iban_seeded": "with c as (select c_custkey as doc_id, lpad(cast(c_custkey as varchar), 18, '0') as b from customer) select doc_id, 7 as start_at, 29 as end_at, 'IBAN' as label, 'DE' || lpad(cast(98 - cast(b || '131400' as hugeint) % 97 as varchar), 2, '0') || b as value from c where doc_id % 3 <> 0",
    "ipv6_seeded": "with c as (select c_custkey as doc_id, case c_custkey % 4 when 0 then '2001:db8::' else '1:2:3:4:5:6:7:' end || lower(to_hex(c_custkey % 65536)) as value from customer where c_custkey % 4 < 2) select doc_id, 5 as start_at, 5 + len(value) as end_at, 'IPADDRESS' as label, value from c",
    "near_dup_exact_classes": f"with {_SHINGLES}, named as (select doc_id, list_sort(s) as s from sh), cls as (select min(doc_id) as rep, s from named group by s), ex as (select rep, len(s) as n, unnest(s) as g from cls), hit as (select a.rep as id, b.rep as other, a.n as n, b.n as m, count(*) as k from ex a join ex b using (g) where b.rep < a.rep group by all) select id, other, round(k / (n + m - k), 6) as jaccard from hit where k / (n + m - k) >= 0.8 union all select doc_id, rep, 1.0 from named join cls using (s) where doc_id <> rep",
    "fill_offsets": _FILLED,
    "prompt_messages": "select doc_id, 1 as n, 'user' as role, md5('" + TASK + "' || chr(10) || 'Labels: " + ", ".join(MODEL_LABELS) + ".' || chr(10) || chr(10) || '<text>' || chr(10) || coalesce(text, '') || chr(10) || '</text>') as digest from documents",
    "gateway_deltas": _DELTAS,
    "audit_verdicts": f"with {_FOUND}, n as (select doc_id, label, row_number() over (partition by doc_id order by start_at, end_at, label) - 1 as i from found) select label, case when quality = 0 and i = 0 then 'not_pii' else 'ok' end as verdict, count(*) as n from n left join labels using (doc_id) group by all",
    "span_validation_errors": f"with {_FOUND} select case when end_at + 1 > len(text) then 'end past text: ' else 'text differs: ' end || label as error, count(*) as n from found join docs using (doc_id) where doc_id % 2 = 0 group by 1",
    "redact_hash": _replace(_HASHED, "redacted"),
    "token_numbering": _TOKENS,
    "pseudonymize_conversations": _PSEUDONYMS,
    "highlights": _HIGHLIGHTS,
    "bioes_decode": _BIOES,
    "chunk_text": _CHUNKS,
    "missed_by_label": "select 'CITY' as label, count(*) as n from labels where toxic = 1 having count(*) > 0 union all select 'STREET', count(*) from labels where toxic = 1 having count(*) > 0",
    "audit_remarks": "select case when doc_id % 4 = 0 then 'place' else 'event_date' end as remark, case when toxic = 1 then 'CITY' else 'DATE' end as label, count(*) as n from labels where quality = 1 and doc_id % 4 < 2 group by all",
    "best_baseline_per_set": f"with {_GOLD}, {_RESULTS}, x as (select testset, tag, round(leakage_chars, 9) as leak from results where tag in ('src1', 'src2', 'src3', 'src4')) select testset, arg_min(tag, (leak, tag)) as tag, min(leak) as leak from x group by testset",
    "label_seed_mean": f"with {_GOLD}, per as (select source as seed, label, count(*) as n, sum(end_at - start_at) as chars, sum((select count(*) from gp where gp.doc_id = gold.doc_id and p >= start_at and p < end_at and not exists (select 1 from pp where pp.doc_id = gp.doc_id and pp.p = gp.p))) as leaked from gold join docs using (doc_id) where source in ('src1', 'src2', 'src3') group by all) select label, round(avg(100 * leaked / chars), 2) as leak from per group by label",
    "collect_responses": "select doc_id, case doc_id % 4 when 0 then null when 1 then 'unparseable response' when 2 then 'missing message' else 'missing value CITY' end as reason, case when doc_id % 4 = 0 then 2 else 0 end as n_spans from documents",
    "training_mixture": "select case when lang = 'en' then 'english' else 'other' end as source, lang, count(*) as n from documents where lang is not null group by all",
    "transcript_cards": "with c as (select c_custkey as k, 'Q' || translate(cast(c_custkey as varchar), '0123456789', 'abcdefghij') as q, lpad(cast(c_custkey as varchar), 7, '0') as d from customer) select k as c_custkey, 'GIVENNAME=Bob|GIVENNAME=ANN|SURNAME=' || q || '|TELEPHONENUM=(555) ' || d[1:3] || '-' || d[4:7] || '|IGNORE=ord-' || k || '|BUILDINGNUM=' || (k + 10) || '|STREET=Elm ' || q || ' Road|BUILDINGNUM=7|STREET=Elm ' || q || ' Road|CITY=leeds|IGNORE=zed' as labels from c",
}
