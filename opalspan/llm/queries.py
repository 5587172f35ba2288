"""The queries and SQL of the training-data operators."""

from __future__ import annotations

import importlib

#: Query name -> (module, function).
_NAMES = {
    "op1_cover_tree": "cover_tree",
    "op2_suffix_dedup": "suffix_dedup",
    "op3_wavelet_output": "wavelet_output",
    "op4_bm25_packing": "bm25_packing",
    "op5_disclosure": "pii_disclosure",
    "op6_simhash": "simhash",
    "op7_line_frequency": "line_quality",
    "op8_html_tag_paths": "html_paths",
    "op9_recursive_bpe": "bpe_duckdb",
    "op10_attention_quality": "mil_quality",
    "op11_byte_gru": "byte_gru",
    "op12_id_stripes": "id_stripes",
    "op13_suffix_sigma": "suffix_sigma",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"opalspan.llm.{module}"), name) for name, module in _NAMES.items()}


_SPACE = r"[\x20\x09-\x0D]"
_LINE_FREQUENCY = rf"""
with d as (select doc_id, coalesce(text, '') as t, coalesce(source, chr(0)) as h from documents),
w as (select doc_id, t, h, list_filter(regexp_split_to_array(t, '{_SPACE}+'), lambda x: x <> '') as w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d),
g as (select doc_id, i, array_to_string(w[i:i + 7], ' ') as gram from w, unnest(range(1, len(w) - 6)) as u(i)),
again as (select doc_id, i from g qualify count(*) over (partition by doc_id, gram) > 1),
covered as (select doc_id, count(distinct i + k) as n from again, range(8) r(k) group by doc_id),
texts as (select distinct h, t, lines from w), sizes as (select h, count(*) as n from texts group by h),
own as (select h, t, trim(regexp_replace(regexp_replace(lower(x), '[0-9]+', '0', 'g'), '{_SPACE}+', ' ', 'g'), ' ') as line, sum(len(list_filter(regexp_split_to_array(x, '{_SPACE}+'), lambda y: y <> ''))) as words from texts, unnest(lines) as u(x) group by all),
common as (select h, line from (select h, line, count(*) as k from own group by all) join sizes using (h) where k > 2 and k > 0.05 * n),
hit as (select h, t, cast(sum(words) as bigint) as n from own semi join common using (h, line) group by all),
m as (select w.doc_id, len(w.w) as n_words, len(regexp_replace(w.t, '{_SPACE}+', '', 'g')) as word_chars, len(w.t) - len(translate(w.t, '#*$%&|<>', '')) as n_symbols, len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(covered.n, 0) as n_repeat_words, coalesce(hit.n, 0) as n_common_words
  from w left join covered using (doc_id) left join hit on hit.h = w.h and hit.t = w.t),
f as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from m)
select *, not base_failed and not (n_common_words > 0.8 * n_words or n_common_words > 0 and n_words - n_common_words < 20) as kept from f
"""

_COLLOCATIONS = r"""
with d as (select row_number() over () as d, coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
p as (select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as w from d, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) as u(piece)),
g as (select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase from p, range(1, 4) as s(k), unnest(range(1, len(w) - k + 2)) as u(i) where len(w) >= k),
f as (select lang, cast(k as int) as k, phrase, count(*) as n from g group by all),
sizes as (select lang, cast(sum(n) as bigint) as n from f where k = 1 group by lang),
c as (select lang, k, phrase, n as a, string_split(phrase, ' ') as w from f where k > 1 and n >= 10),
cuts as (select lang, k, phrase, a, cut, array_to_string(w[1:cut], ' ') as head, array_to_string(w[cut + 1:], ' ') as rest from c, unnest(range(1, k)) as u(cut)),
scored as (select cuts.*, x.n as l, y.n as r, (1000000::hugeint * a * a) // (x.n::hugeint * y.n) as score
  from cuts join f as x on x.lang = cuts.lang and x.phrase = cuts.head join f as y on y.lang = cuts.lang and y.phrase = cuts.rest),
lowest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
around as (select lang, phrase, max(a) as around from (select lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) as phrase, a from c where k = 3) group by all),
kept as (select lowest.* from lowest left join around using (lang, phrase) where around is null or 100 * around < 50 * a)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, sizes.n as n, cast(score as bigint) as score from kept join sizes using (lang) qualify rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    """The other operators have no SQL: trees, buckets, files, tokenisers and models are tested against brute force."""
    return {"op7_line_frequency": _LINE_FREQUENCY, "op13_suffix_sigma": _COLLOCATIONS}
