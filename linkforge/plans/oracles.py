"""DuckDB twins of the registered queries, written independently as one chain of CTEs."""

from __future__ import annotations

#: The suffix words that mark a legal form, as a pattern.
_LEGAL = "co|company|corp|corporation|inc|incorporated|llc|llp|ltd|limited|private|pvt|plc|sa|sas|sarl|eurl|snc|cie"
_P = "source1_entity_id, candidate_entity_id"


def _fold(x: str) -> str:
    return f"replace(strip_accents(lower(nfc_normalize({x}))), 'ß', 'ss')"


def _anded(x: str) -> str:
    """A lone & or + as "and"; applied four times, as neighbours share the character between them."""
    return rf"regexp_replace({x}, '(^|[^\p{{L}}\p{{N}}_])[&+]($|[^\p{{L}}\p{{N}}_])', '\1 and \2', 'g')"


def _words(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"


def _grams(x: str) -> str:
    return f"flatten(list_transform(list_filter(string_split({x}, ' '), lambda w: w <> ''), lambda w: flatten(list_transform(list_filter([3, 4], lambda n: n = 3 or length(w) + 2 > n - 1), lambda n: list_transform(range(1, greatest(length(w) + 2 - n + 1, 1) + 1), lambda i: substring(' ' || w || ' ', i, n))))))"


def _informative(x: str) -> str:
    return rf"list_distinct(list_filter({x}, lambda t: length(t) >= 3 and not regexp_full_match(t, '\p{{Nd}}+')))"


def _jaccard(a: str, b: str) -> str:
    union = f"len(list_distinct(list_concat({a}, {b})))"
    return f"(case when {union} = 0 then 1.0 else len(list_intersect(list_distinct({a}), list_distinct({b})))::double / {union} end)"


def _ratio(a: str, b: str) -> str:
    return f"(case when greatest(length({a}), length({b})) = 0 then 1.0 else least(length({a}), length({b}))::double / greatest(length({a}), length({b})) end)"


def _edge(a: str, b: str) -> str:
    """Longest n with equal starts."""
    n = f"coalesce(list_max(list_filter(range(0, least(length({a}), length({b})) + 1), lambda n: substring({a}, 1, n) = substring({b}, 1, n))), 0)"
    return f"(case when greatest(length({a}), length({b})) = 0 then 1.0 else {n}::double / greatest(length({a}), length({b})) end)"


_FLAGS = {"full": "block_exact_full_name", "core": "block_exact_core_name", "sorted": "block_exact_sorted_name", "address": "block_exact_address", "cross": "block_cross_country_exact_name", "name_token": "block_rare_name_token", "address_token": "block_rare_address_token"}
_F05 = "case when n_predicted = 0 and n_true = 0 then 1.0 else 1.25 * tp / (1.25 * tp + 0.25 * (n_true - tp) + (n_predicted - tp)) end"


def _vocab(name: str, column: str, cap: int = 300000, where: str = "") -> str:
    return f"""
{name}_c as materialized (select entity_id, country_norm as country, gram, count(*) as tf from (select entity_id, country_norm, unnest({_grams(column)}) as gram from feed {where}) group by all),
{name}_v as materialized (select v.country, gram, df, ln((1 + n) / (1.0 + df)) + 1 as idf from (select country, gram, count(*) as df, row_number() over (partition by country order by sum(tf) desc, gram) as place from {name}_c group by country, gram) v
  join (select country_norm as country, count(*) as n from feed {where} group by 1) s on s.country = v.country where place <= {cap})"""


def _tfidf(name: str, column: str) -> str:
    where = f"where {column} <> ''"
    return _vocab(name, column, where=where) + f""",
{name}_w as materialized (select entity_id, country, gram, df, w / sqrt(sum(w * w) over (partition by entity_id)) as w from (select c.*, df, (1 + ln(tf)) * idf as w from {name}_c c join {name}_v v using (country, gram))),
{name}_q as materialized (select entity_id, country, gram, df, w / sqrt(sum(w * w) over (partition by entity_id)) as w from (select q.*, df, (1 + ln(tf)) * idf as w from (select entity_id, country_norm as country, gram, count(*) as tf from (select entity_id, country_norm, unnest({_grams(column)}) as gram from s1) group by all) q join {name}_v v using (country, gram)))"""


def _top(k: int | str, inner: str) -> str:
    return f"select {_P}, similarity, place from (select *, row_number() over (partition by source1_entity_id order by similarity desc, candidate_entity_id) as place from ({inner}) where similarity > 0) where place <= {k}"


def _dot(name: str) -> str:
    return f"select q.entity_id as source1_entity_id, d.entity_id as candidate_entity_id, round(sum(q.w * d.w), 9) as similarity from {name}_q q join {name}_w d using (country, gram) group by 1, 2"


def _pool(routes: str) -> str:
    return f"""(select source1_entity_id, candidate_entity_id, bit_or(bit) as route_mask, min(df) as least_df from (
  select p.entity_id as source1_entity_id, f.entity_id as candidate_entity_id, p.bit, p.df from (
    select a.*, d.df, row_number() over (partition by entity_id, a.route order by d.df, a.key) as place from ak_s a join ad d using (country, route, key)
    where route in ({routes}) and d.df <= case route when 'postcode_prefix' then @prefix_df@ when 'numeric' then @numeric_df@ when 'rare_token' then @rare_df@ else 2147483647 end) p
  join ak_f f using (country, route, key) where p.route <> 'rare_token' or p.place <= 3) group by 1, 2)"""


_THREE = "'postcode', 'numeric', 'rare_token'"


def _capped(pool: str, k: int | str) -> str:
    return f"select * from (select *, row_number() over (partition by source1_entity_id order by bit_count(route_mask) desc, least_df, candidate_entity_id) as place, count(*) over (partition by source1_entity_id) as pool_size from {pool}) where place <= {k}"


def _fallback(routes: str) -> str:
    return f"""(select * from (select *, row_number() over (partition by source1_entity_id order by least_df, candidate_entity_id) as place, count(*) over (partition by source1_entity_id) as pool_size from (
  select q.entity_id as source1_entity_id, d.entity_id as candidate_entity_id, min(q.df) as least_df from (select *, row_number() over (partition by entity_id order by df, w desc, gram) as place from (select *, (df <= @fallback_df@)::int as rare, max((df <= @fallback_df@)::int) over (partition by entity_id) as any_rare from at_q
    where entity_id not in (select source1_entity_id from {_pool(routes)})) where rare = any_rare) q join at_c d using (country, gram) where q.place <= 3 group by 1, 2)) where place <= @pool@)"""


_CTES = {
    "rec": r"""select case when cast(substr(source, 4) as int) < 4 then 'S1' when cast(substr(source, 4) as int) < 12 then 'S2' else 'S3' end || '-' || doc_id as entity_id,
  array_to_string(string_split_regex(text, '\s+')[1:6], ' ') || case doc_id % 5 when 1 then ' Ltd.' when 2 then ' Pvt Limited' when 3 then ' & Co' when 4 then ' LLC' else '' end as business_name,
  case when doc_id % 17 = 0 then '' else array_to_string(string_split_regex(text, '\s+')[7:14], ' ') || ' ' || n_chars || ' ' || lpad(cast(n_chars * 37 % 100000 as varchar), 5, '0') end as business_address, lang as country, text from documents""",
    "base": "select *, " + _words(_anded(_anded(_anded(_anded(_fold("business_name")))))) + " as name_full, " + _words(_fold("business_address")) + " as address_full, lower(country) as country_norm from rec",
    "cored": rf"select *, case when trim(regexp_replace(name_full, '(^| )({_LEGAL})( ({_LEGAL}))*$', '')) = '' then name_full else trim(regexp_replace(name_full, '(^| )({_LEGAL})( ({_LEGAL}))*$', '')) end as name_core, trim(regexp_extract(name_full, '(?:^| )((?:{_LEGAL})(?: (?:{_LEGAL}))*)$', 1)) as legal_form from base",
    "norm": r"""select *, list_filter(string_split(name_full, ' '), lambda t: t <> '') as name_tokens, list_filter(string_split(address_full, ' '), lambda t: t <> '') as address_tokens,
  list_filter(string_split(address_full, ' '), lambda t: regexp_full_match(t, '\p{Nd}+[a-z]?')) as numbers, array_to_string(list_sort(list_filter(string_split(name_core, ' '), lambda t: t <> '')), ' ') as name_sorted,
  coalesce(list_filter(string_split(regexp_replace(address_full, '[^0-9]+', ' ', 'g'), ' '), lambda t: length(t) in (5, 6))[-1], '') as postcode from cored""",
    "s1": "select * from norm where entity_id like 'S1-%'",
    "feed": "select * from norm where entity_id not like 'S1-%'",
    "truth": "select a.entity_id as source1_entity_id, b.entity_id as candidate_entity_id from (select entity_id, " + _words(_fold("text")) + " as k from s1) a join (select entity_id, " + _words(_fold("text")) + " as k from feed) b using (k)",
    "keys": "select entity_id, country_norm as country, 'full' as channel, name_full as key, country_norm as scope from norm where name_full <> '' union all select entity_id, country_norm, 'core', name_core, country_norm from norm where name_core <> '' union all select entity_id, country_norm, 'sorted', name_sorted, country_norm from norm where name_sorted <> '' union all select entity_id, country_norm, 'address', address_full, country_norm from norm where address_full <> '' union all select entity_id, country_norm, 'cross', name_full, '*' from norm where name_full <> '' union all select entity_id, country_norm, 'name_token', unnest("
    + _informative("name_tokens") + "), country_norm from norm union all select entity_id, country_norm, 'address_token', unnest(" + _informative("address_tokens") + "), country_norm from norm",
    "counts": "select channel, scope, key, count(*) as df from keys where entity_id not like 'S1-%' group by all",
    "allowed": "select * from counts where df <= case channel when 'name_token' then @name_df@ when 'address_token' then @address_df@ else @cap@ end",
    "matched": "select l.entity_id as source1_entity_id, r.entity_id as candidate_entity_id, channel, key, l.country as c1, r.country as c2 from (select * from keys where entity_id like 'S1-%') l join allowed using (channel, scope, key) join (select * from keys where entity_id not like 'S1-%') r using (channel, scope, key) where channel <> 'cross' or l.country <> r.country",
    "pairs": f"select {_P}, " + ", ".join(f"max((channel = '{c}')::int)::bigint as {f}" for c, f in _FLAGS.items()) + ", sum((channel = 'name_token')::int)::bigint as rare_name_token_hits, sum((channel = 'address_token')::int)::bigint as rare_address_token_hits, max((c1 = c2)::int)::bigint as same_country_block from matched group by 1, 2",
    "scores": "select *, 5.0 * block_exact_full_name + 4.5 * block_exact_core_name + 4.0 * block_exact_sorted_name + least(rare_name_token_hits, 3) + 3.0 * block_exact_address + 0.5 * least(rare_address_token_hits, 3) + 0.5 * same_country_block as cheap_score from pairs",
    "ranked": "select *, row_number() over (partition by source1_entity_id order by cheap_score desc, candidate_entity_id) as cheap_rank, count(*) over (partition by source1_entity_id) as raw_candidate_count from scores",
    "cand": "select * from ranked where cheap_rank <= @k@",
    "ak": "select entity_id, country_norm as country, 'postcode' as route, postcode as key, 1 as bit from norm where postcode <> '' union all select entity_id, country_norm, 'postcode_prefix', left(postcode, 3), 2 from norm where length(postcode) >= 3 union all select entity_id, country_norm, 'numeric', unnest(list_distinct(numbers)), 4 from norm union all select entity_id, country_norm, 'rare_token', unnest(" + _informative("address_tokens") + "), 8 from norm",
    "ak_s": "select * from ak where entity_id like 'S1-%'",
    "ak_f": "select * from ak where entity_id not like 'S1-%'",
    "ad": "select country, route, key, count(*) as df from ak_f group by all",
    "feat": f"""select {_P}, cheap_rank, cheap_score, {', '.join(_FLAGS.values())}, (l.name_full <> '' and l.name_full = r.name_full)::bigint as name_full_exact, (l.name_core <> '' and l.name_core = r.name_core)::bigint as name_core_exact, (l.name_sorted <> '' and l.name_sorted = r.name_sorted)::bigint as name_sorted_exact, (l.address_full <> '' and l.address_full = r.address_full)::bigint as address_exact,
  {_jaccard('l.name_tokens', 'r.name_tokens')} as name_token_jaccard, {_jaccard('l.address_tokens', 'r.address_tokens')} as address_token_jaccard, len(list_intersect(list_distinct(l.name_tokens), list_distinct(r.name_tokens))) as name_shared_token_count, len(list_intersect(list_distinct(l.address_tokens), list_distinct(r.address_tokens))) as address_shared_token_count,
  abs(len(list_distinct(l.name_tokens)) - len(list_distinct(r.name_tokens))) as name_token_count_difference, {_ratio('l.name_full', 'r.name_full')} as name_length_ratio, {_ratio('l.address_full', 'r.address_full')} as address_length_ratio, {_edge('l.name_full', 'r.name_full')} as name_prefix_ratio, {_edge('reverse(l.name_full)', 'reverse(r.name_full)')} as name_suffix_ratio,
  (len(l.numbers) > 0 and len(r.numbers) > 0 and list_sort(list_distinct(l.numbers)) = list_sort(list_distinct(r.numbers)))::bigint as numeric_token_equal, case when len(l.numbers) > 0 and len(r.numbers) > 0 then {_jaccard('l.numbers', 'r.numbers')} else 0.0 end as numeric_token_overlap,
  (len(l.numbers) > 0 and len(r.numbers) > 0 and len(list_intersect(list_distinct(l.numbers), list_distinct(r.numbers))) = 0)::bigint as numeric_token_conflict, (l.address_full = '')::bigint as address_missing_left, (r.address_full = '')::bigint as address_missing_right, (l.country_norm = '')::bigint as country_missing_left, (r.country_norm = '')::bigint as country_missing_right,
  (l.country_norm = r.country_norm)::bigint as same_country, (l.country_norm <> r.country_norm)::bigint as country_conflict, 1::bigint as both_country_present, (candidate_entity_id like 'S2-%')::bigint as source_is_s2, (candidate_entity_id like 'S3-%')::bigint as source_is_s3, l.country_norm as country
  from cand join s1 l on l.entity_id = source1_entity_id join feed r on r.entity_id = candidate_entity_id""",
    "ruled": """select *, round(greatest(0.0, least(1.0, greatest(0.5::double * name_token_jaccard + 0.25::double * name_token_jaccard + 0.2::double * address_token_jaccard + 0.05::double * name_length_ratio,
  case when name_sorted_exact = 1 then 0.85 else 0 end, case when name_core_exact = 1 then 0.88 else 0 end, case when name_full_exact = 1 then 0.90 else 0 end, case when any_exact and same_country = 1 then 0.93 else 0 end,
  case when any_exact and same_country = 1 and (address_token_jaccard >= 0.25 or numeric_token_overlap > 0 or address_exact = 1) then 0.97 else 0 end,
  case when name_token_jaccard >= 0.92 and (address_token_jaccard >= 0.6 or address_exact = 1) and same_country = 1 and numeric_token_conflict = 0 then 0.95 else 0 end,
  case when address_exact = 1 and name_token_jaccard >= 0.5 and same_country = 1 then 0.94 else 0 end) - case when country_conflict = 1 then 0.35 else 0 end - case when numeric_token_conflict = 1 then 0.12 else 0 end))::double, 9) as rule_score
  from (select *, name_full_exact + name_core_exact + name_sorted_exact > 0 as any_exact from feat)""",
    "lab": f"select r.*, (t.source1_entity_id is not null)::bigint as label from ruled r left join truth t using ({_P})",
    "pred": f"select {_P} from ruled where rule_score >= 0.9",
    "ent": """select s.entity_id as source1_entity_id, s.country_norm as country, coalesce(tp, 0) as tp, coalesce(n_predicted, 0) as n_predicted, coalesce(n_true, 0) as n_true from s1 s
  left join (select source1_entity_id, count(*) as n_predicted from pred group by 1) p on p.source1_entity_id = s.entity_id left join (select source1_entity_id, count(*) as n_true from truth group by 1) t on t.source1_entity_id = s.entity_id
  left join (select source1_entity_id, count(*) as tp from pred join truth using (source1_entity_id, candidate_entity_id) group by 1) b on b.source1_entity_id = s.entity_id""",
    "met": f"select *, {_F05} as f05, case when n_predicted = 0 and n_true = 0 then 1.0 when n_predicted = 0 then 0.0 else tp / n_predicted end as precision, case when n_predicted = 0 and n_true = 0 then 1.0 when n_true = 0 then 0.0 else tp / n_true end as recall from ent",
}
_CTES |= {
    "linkkeys": "select t.source1_entity_id, t.candidate_entity_id, l.channel, l.key, case l.channel when 'name_token' then df <= @name_df@ when 'address_token' then df <= @address_df@ else true end as frequent, df > @cap@ as capped from truth t join keys l on l.entity_id = t.source1_entity_id join keys r on r.entity_id = t.candidate_entity_id and r.channel = l.channel and r.scope = l.scope and r.key = l.key join counts c on c.channel = l.channel and c.scope = l.scope and c.key = l.key where l.channel <> 'cross' or l.country <> r.country",
    "links": "select t.*, l.country_norm as country, r.country_norm as candidate_country, l.name_core as left_name, r.name_core as right_name, case when count(*) over (partition by source1_entity_id) >= 3 then '3+' else (count(*) over (partition by source1_entity_id))::varchar end as bucket from truth t join s1 l on l.entity_id = source1_entity_id join feed r on r.entity_id = candidate_entity_id",
}
_NEEDS = {"nt": _tfidf("nt", "name_core"), "at": _tfidf("at", "address_full")}
_EXTRA = {
    "near": _top("@tk@", _dot("nt")),
    "far": _top("@ak@", _dot("at")),
    "uni": """select coalesce(c.source1_entity_id, n.source1_entity_id) as source1_entity_id, coalesce(c.candidate_entity_id, n.candidate_entity_id) as candidate_entity_id, coalesce(cheap_rank, 0) as legacy_rank, coalesce(cheap_score, 0)::double as legacy_score, coalesce(place, 0) as tfidf_rank, coalesce(similarity, 0) as tfidf_similarity,
  (cheap_rank is not null and place is null)::bigint as is_legacy_only, (cheap_rank is null)::bigint as is_tfidf_only, (cheap_rank is not null and place is not null)::bigint as supported_by_both from cand c full join (select * from near where place <= @depth@) n using (source1_entity_id, candidate_entity_id)""",
    "pre": f"""select * from (select *, row_number() over (partition by source1_entity_id order by similarity desc, candidate_entity_id) as place from (
    select p.source1_entity_id, p.candidate_entity_id, any_value(route_mask) as route_mask, any_value(pool_size) as pool_size, round(sum(q.w * d.w), 9) as similarity
    from (select {_P}, route_mask::int as route_mask, pool_size from ({_capped(_pool(_THREE), '@pool@')}) union all select {_P}, 16, pool_size from {_fallback(_THREE)}) p join at_q q on q.entity_id = p.source1_entity_id join at_w d on d.entity_id = p.candidate_entity_id and d.country = q.country and d.gram = q.gram
    group by 1, 2) where similarity > 0) where place <= @ak@""",
    "uni3p": """select coalesce(u.source1_entity_id, f.source1_entity_id) as source1_entity_id, coalesce(u.candidate_entity_id, f.candidate_entity_id) as candidate_entity_id, coalesce(legacy_rank, 0) as legacy_rank, coalesce(tfidf_rank, 0) as tfidf_rank, coalesce(f.place, 0) as address_rank,
  (coalesce(legacy_rank, 0) > 0)::bigint + (coalesce(tfidf_rank, 0) > 0)::bigint + (coalesce(f.place, 0) > 0)::bigint as retrieval_channel_count from uni u full join (select source1_entity_id, candidate_entity_id, place from pre) f using (source1_entity_id, candidate_entity_id)""",
    "uni3": """select coalesce(u.source1_entity_id, f.source1_entity_id) as source1_entity_id, coalesce(u.candidate_entity_id, f.candidate_entity_id) as candidate_entity_id, coalesce(legacy_rank, 0) as legacy_rank, coalesce(tfidf_rank, 0) as tfidf_rank, coalesce(f.place, 0) as address_rank,
  (coalesce(legacy_rank, 0) > 0)::bigint + (coalesce(tfidf_rank, 0) > 0)::bigint + (coalesce(f.place, 0) > 0)::bigint as retrieval_channel_count from uni u full join far f using (source1_entity_id, candidate_entity_id)""",
}


def _sql(body: str, tail: str = "") -> str:
    """The CTEs that a query names, directly or through others, before its body."""
    import re

    every = {**_CTES, **_EXTRA}
    wanted, todo = set(), [body]
    while todo:
        text = todo.pop()
        for name in [*every, *_NEEDS]:
            if name not in wanted and re.search(rf"\b{name}(_[vwqc])?\b", text) and (name not in _NEEDS or re.search(rf"\b{name}_[vwqc]\b", text)):
                wanted.add(name)
                todo.append(every.get(name) or _NEEDS[name])
    parts = [f"{n} as materialized ({_CTES[n]})" for n in _CTES if n in wanted] + [_NEEDS[n].strip() for n in _NEEDS if n in wanted] + [f"{n} as materialized ({_EXTRA[n]})" for n in _EXTRA if n in wanted]
    return "with " + ",\n".join(parts) + "\n" + body


_R2 = "case when legacy_rank > 0 then {0} / ({1} + legacy_rank) else 0 end + case when tfidf_rank > 0 then {2} / ({1} + tfidf_rank) else 0 end"
_RRF = _R2.format("2.0", "20.0", "1.0")
_RRF3 = _RRF + " + case when address_rank > 0 then 1.0 / (20.0 + address_rank) else 0 end"
_LATE = "case when legacy_rank > 0 then legacy_rank else 65535 end, case when tfidf_rank > 0 then tfidf_rank else 65535 end"


def _fuse(score: str, k: int | str, inner: str = "uni") -> str:
    return _sql(f"select {_P}, round(fusion_score::double, 5) as fusion_score, fusion_rank from (select *, row_number() over (partition by source1_entity_id order by fusion_score desc, supported_by_both desc, {_LATE}, candidate_entity_id) as fusion_rank from (select *, {score} as fusion_score from {inner})) where fusion_rank <= {k}")


def _fuse3(inner: str, k: int | str) -> str:
    return _sql(f"select {_P}, round(fusion_score::double, 5) as fusion_score, fusion_rank, retrieval_channel_count from (select *, row_number() over (partition by source1_entity_id order by fusion_score desc, retrieval_channel_count desc, {_LATE}, case when address_rank > 0 then address_rank else 65535 end, candidate_entity_id) as fusion_rank from ({inner})) where fusion_rank <= {k}")


def _protected(score: str, source: str, tie: str, k: int | str, least: int | str) -> str:
    return f"select * exclude (safe, place) from (select *, row_number() over (partition by source1_entity_id order by safe, case when safe = 0 then legacy_rank else 0 end, fusion_score desc, {tie} candidate_entity_id) as place from (select *, {score} as fusion_score, case when legacy_rank between 1 and {least} then 0 else 1 end as safe from {source})) where place <= {k}"


_QUOTA = """(select *, count(*) over (partition by source1_entity_id) - place + 1 as fs from (select *, row_number() over (partition by source1_entity_id order by g, case when legacy_rank > 0 then l else o end, candidate_entity_id) as place from (
  select *, case when legacy_rank > 0 and l <= @legacy_quota@ then 0 when is_tfidf_only = 1 and o <= @tfidf_quota@ then 1 when legacy_rank > 0 then 2 else 3 end as g from (select *, row_number() over (partition by source1_entity_id, legacy_rank > 0 order by legacy_rank, candidate_entity_id) as l, row_number() over (partition by source1_entity_id, is_tfidf_only order by tfidf_rank, candidate_entity_id) as o from uni))) where place <= @final_k@)"""
_MM = "case when {r} > 0 then case when {hi} > {lo} then ({v} - {lo}) / ({hi} - {lo}) else 1.0 end else 0.0 end"


def _minmax(v: str, r: str) -> str:
    return _MM.format(v=v, r=r, **{k: f"{f}(case when {r} > 0 then {v} end) over (partition by source1_entity_id)" for k, f in (("lo", "min"), ("hi", "max"))})


def _sweep(score: str, grid: list[float], source: str = "ruled", digits: int = 5, by: str = "") -> str:
    grid = "(values " + ", ".join(f"({t!r}::double)" for t in grid) + ") g(threshold)"
    return f"""select {by}threshold, round(avg({_F05}), {digits}) as macro_f05, round(case when sum(n_predicted) = 0 then 0 else sum(tp) / sum(n_predicted) end, {digits}) as micro_precision from (
  select threshold, s.entity_id, any_value(s.country_norm) as country, count(r.candidate_entity_id) as n_predicted, count(t.candidate_entity_id) as tp, any_value(coalesce(nt, 0)) as n_true from {grid} cross join s1 s left join {source} r on r.source1_entity_id = s.entity_id and {score} >= threshold
  left join truth t on t.source1_entity_id = r.source1_entity_id and t.candidate_entity_id = r.candidate_entity_id left join (select source1_entity_id, count(*) as nt from truth group by 1) n on n.source1_entity_id = s.entity_id group by 1, 2) group by {by}threshold"""


def _best(sweep: str, order: str, by: str = "") -> str:
    parts = f"partition by {by.rstrip(', ')} " if by else ""
    return f"select {by}round(threshold, 5) as threshold, round(macro_f05, 5) as macro_f05, round(micro_precision, 5) as micro_precision from (select *, row_number() over ({parts}order by macro_f05 desc, {order}) as place from ({sweep})) where place = 1"


#: Candidate metrics of rows with nt, nc and hit: numbers of true links, of candidates, and of true links among these.
_METRICS = "round(case when sum(nt) = 0 then 1.0 else sum(hit) / sum(nt) end, 5) as pair_recall, round(avg(case when nt = 0 then 1.0 else hit / nt end), 5) as entity_recall, round(avg(case when nt = 0 then 1.0 when hit = 0 then 0.0 else 1.25 * hit / (1.25 * hit + 0.25 * (nt - hit)) end), 5) as oracle_f05, round(avg(nc), 5) as mean_candidates, round(quantile_cont(nc, 0.5), 5) as median_candidates, round(quantile_cont(nc, 0.95), 5) as p95_candidates, max(nc) as max_candidates"


def _counted(pairs: str) -> str:
    return f"""(select i.entity_id, i.country_norm as country, coalesce(nt, 0) as nt, coalesce(nc, 0) as nc, coalesce(hit, 0) as hit from s1 i left join (select source1_entity_id as e, count(*) as nt from truth group by 1) a on a.e = i.entity_id
  left join (select source1_entity_id as e, count(*) as nc from {pairs} group by 1) b on b.e = i.entity_id left join (select source1_entity_id as e, count(*) as hit from {pairs} join truth using (source1_entity_id, candidate_entity_id) group by 1) c on c.e = i.entity_id)"""


def _held(seed: int) -> str:
    return f"(('0x' || substr(md5('{seed}:' || entity_id), 1, 12))::bigint / 281474976710656.0::double < 0.25)"


def _pool_stats(name: str, routes: str, limits: dict[str, int]) -> str:
    pool = _pool(routes).replace("p.place <= 3", f"p.place <= {limits['rare_tokens_per_query']}")
    for token, key in (("prefix_df", "prefix_max_df"), ("numeric_df", "numeric_max_df"), ("rare_df", "rare_token_max_df")):
        pool = pool.replace(f"@{token}@", str(limits.get(key, 2_000)))
    return f"select '{name}' as variant, count(*) as n, min(n) as minimum, round(quantile_cont(n, 0.05), 5) as p05, round(quantile_cont(n, 0.25), 5) as p25, round(quantile_cont(n, 0.5), 5) as median, round(quantile_cont(n, 0.75), 5) as p75, round(quantile_cont(n, 0.95), 5) as p95, max(n) as maximum, count(*) filter (n = 0) as empty from (select entity_id, count(candidate_entity_id) as n from s1 left join ({_capped(pool, limits['pool_cap'])}) p on p.source1_entity_id = entity_id group by 1)"


def _ranked_fusion(score: str, k: int | str, inner: str) -> str:
    """Pairs of a fusion with score and rank, as ``_fuse`` returns them rounded."""
    return f"(select * from (select *, row_number() over (partition by source1_entity_id order by fusion_score desc, supported_by_both desc, {_LATE}, candidate_entity_id) as fusion_rank from (select *, {score} as fusion_score from {inner})) where fusion_rank <= {k})"


def _universe(depth: int) -> str:
    return "(" + _EXTRA["uni"].replace("@depth@", str(depth)) + ")"


def _record(name: str, depth: int, k: int, pairs: str) -> str:
    """One record of the fusion grid."""
    links = f"(select (c.source1_entity_id is not null) as legacy, (n.source1_entity_id is not null) as near, (f.source1_entity_id is not null) as final from truth left join (select * from ranked where cheap_rank <= 50) c using ({_P}) left join (select * from near where place <= {depth}) n using ({_P}) left join {pairs} f using ({_P}))"
    return f"""select '{name}' as variant, {depth} as depth, {k} as final_k, m.*, legacy_true, legacy_retained, legacy_displaced, legacy_failures, failures_retrieved, failures_retained, failures_lost, round(case when legacy_true > 0 then legacy_retained / legacy_true else 1.0 end, 5) as retention
  from (select {_METRICS} from {_counted(pairs)}) m, (select count(*) filter (legacy) as legacy_true, count(*) filter (legacy and final) as legacy_retained, count(*) filter (legacy and not final) as legacy_displaced, count(*) filter (not legacy) as legacy_failures, count(*) filter (not legacy and near) as failures_retrieved, count(*) filter (not legacy and final) as failures_retained, count(*) filter (not legacy and near and not final) as failures_lost from {links})"""


def _grid() -> str:
    rows = []
    for depth in (20, 30):
        uni = _universe(depth).replace("from cand c", "from (select * from ranked where cheap_rank <= 50) c")
        norm = f"0.7 * {_minmax('legacy_score', 'legacy_rank')} + 0.3 * {_minmax('tfidf_similarity', 'tfidf_rank')} + 0.1 * supported_by_both"
        quota = _QUOTA.replace("@legacy_quota@", "35").replace("@tfidf_quota@", "15").replace("@final_k@", "50").replace("from uni))", f"from {uni}))")
        rows += [_record("quota 50=35+15", depth, 50, _ranked_fusion("fs", 50, quota)), _record("rrf 2:1/20", depth, 50, _ranked_fusion(_RRF, 50, uni)), _record("normalized 0.7:0.3+0.1", depth, 50, _ranked_fusion(norm, 50, uni))]
        rows.append(_record("hybrid 50>=35", depth, 50, "(" + _protected(_RRF, uni, f"supported_by_both desc, {_LATE},", 50, 35) + ")"))
    records = " union all ".join(rows)
    return f"select * exclude (place), (place = 1)::bigint as best from (select *, row_number() over (order by pair_recall desc, oracle_f05 desc, retention desc, final_k, depth, variant) as place from ({records}))"


def _block(channel: str) -> str:
    return _sql(f"select {_P}, key from matched where channel = '{channel}'")


_FLAG_LIST = list(_FLAGS.values())
_SUM = " + ".join(_FLAG_LIST)
_GRID = [0.5, 0.6, 0.7, 0.8, 0.88, 0.9, 0.93, 0.97]
_RULES = [0.70, 0.75, 0.80, 0.84, 0.86, 0.88, 0.90, 0.93, 0.95, 0.98]
_FEATURES = "name_full_exact, name_core_exact, name_sorted_exact, address_exact, round(name_token_jaccard, 5) as name_token_jaccard, round(address_token_jaccard, 5) as address_token_jaccard, name_shared_token_count, address_shared_token_count, name_token_count_difference, round(name_length_ratio, 5) as name_length_ratio, round(address_length_ratio, 5) as address_length_ratio, round(name_prefix_ratio, 5) as name_prefix_ratio, round(name_suffix_ratio, 5) as name_suffix_ratio, numeric_token_equal, round(numeric_token_overlap, 5) as numeric_token_overlap, numeric_token_conflict, address_missing_left, address_missing_right, country_missing_left, country_missing_right, same_country, country_conflict, both_country_present, source_is_s2, source_is_s3"


def _twins() -> dict[str, str]:
    from linkforge.operators.model import dense_grid, probability_grid
    from linkforge.plans.stages import STRATEGIES

    return {
        "normalize_names": _sql("select entity_id, name_full, name_core, name_sorted, case when len(string_split(name_core, ' ')) between 2 and 10 then array_to_string(list_transform(string_split(name_core, ' '), lambda t: left(t, 1)), '') else '' end as name_acronym from norm"),
        "normalize_addresses": _sql("select entity_id, address_full, country_norm from norm"),
        "legal_forms": _sql("select legal_form, count(*) as n from norm group by 1"),
        "numeric_tokens": _sql("select entity_id, array_to_string(numbers, ' ') as numbers from norm"),
        "postcode_extract": _sql("select entity_id, postcode from norm"),
        "informative_tokens": _sql(f"select entity_id, array_to_string(list_sort({_informative('name_tokens')}), ' ') as words from norm"),
        "tfidf_blocking_merge": _sql(f"""select {_P}, block_name_tfidf, round(coalesce(similarity, 0)::decimal(18, 9), 5)::double as name_tfidf_similarity, cheap_rank from (select *, row_number() over (partition by source1_entity_id order by s desc, candidate_entity_id) as cheap_rank from (
  select coalesce(c.source1_entity_id, n.source1_entity_id) as source1_entity_id, coalesce(c.candidate_entity_id, n.candidate_entity_id) as candidate_entity_id, (n.place is not null)::bigint as block_name_tfidf, similarity,
    (coalesce(cheap_score, 0)::double - 0.5 * coalesce(same_country_block, 0)::double + 0.5 * (case when n.place is not null then 1 else coalesce(same_country_block, 0) end) + 4.0::double * coalesce(similarity, 0))::float as s
  from scores c full join near n using (source1_entity_id, candidate_entity_id))) where cheap_rank <= @k@"""),
        "char_ngrams": _sql(f"select country_norm as country, gram, count(*) as n from (select country_norm, unnest({_grams('name_core')}) as gram from s1) group by all"),
        "source_violations": _sql("select unnest(['empty_id', 'wrong_prefix', 'duplicate_id']) as problem, unnest([count(*) filter (entity_id = ''), count(*) filter (entity_id not like 'S2-%'), count(*) - count(distinct entity_id)]) as rows from feed"),
        "truth_explode": _sql("select * from truth"),
        "shard_sizes": _sql("select country_norm as scope, count(*) as shard from feed group by 1"),
        "token_df": _sql("select scope, key, df from counts where channel = 'name_token'"),
        "df_eligibility_modes": _sql("select scope, mode, count(*) as tokens from (select c.scope, df, shard from counts c join (select country_norm as scope, count(*) as shard from feed group by 1) s on s.scope = c.scope where channel = 'name_token') x join (values ('absolute'), ('relative'), ('hybrid')) m(mode) on case mode when 'absolute' then df <= 10 when 'relative' then df / shard <= 0.02::double else df <= 3 or df / shard <= 0.02::double end group by all"),
        "posting_cap": _sql("select channel, count(*) as keys, sum(df)::bigint as postings from allowed group by 1"),
        **{f"block_{n}": _block(c) for n, c in (("exact_full", "full"), ("exact_core", "core"), ("exact_sorted", "sorted"), ("exact_address", "address"), ("rare_name", "name_token"), ("rare_address", "address_token"))},
        "block_cross_country": _sql("select l.entity_id as source1_entity_id, r.entity_id as candidate_entity_id, l.name_full as key from s1 l join (select *, count(*) over (partition by name_full) as df from feed) r on l.name_full = r.name_full and l.name_full <> '' and df <= @cap@ where l.country_norm <> case when regexp_extract(r.entity_id, '([0-9]+)$', 1)::bigint % 2 = 1 then r.country_norm || 'x' else r.country_norm end"),
        "block_ranked_rare": _sql("select entity_id, key from (select k.entity_id, k.key, row_number() over (partition by k.entity_id order by df, k.key) as place from keys k join counts c using (channel, scope, key) where channel = 'name_token' and k.entity_id like 'S1-%' and df <= @cap@) where place <= 2"),
        "candidates_union": _sql("select * from pairs"),
        "candidates_topk": _sql(f"select {_P}, cheap_score::double as cheap_score, cheap_rank, raw_candidate_count, least(raw_candidate_count, @k@) as final_candidate_count, left(candidate_entity_id, 2) as candidate_source from cand"),
        "candidates_at_k": _sql(f"select {_P}, cheap_rank, least(raw_candidate_count, 3) as final_candidate_count from cand where cheap_rank <= 3"),
        "cheap_margin": _sql(f"select {_P}, (cheap_score - lead(cheap_score, 1, 0) over (partition by source1_entity_id order by cheap_rank))::double as cheap_score_margin_to_next from cand"),
        "tfidf_name_topk": _sql(f"select {_P}, round(similarity::decimal(18, 9), 5)::double as name_tfidf_similarity, place as name_tfidf_rank from near"),
        "tfidf_address_topk": _sql(f"select {_P}, round(similarity::decimal(18, 9), 5)::double as address_tfidf_similarity, place as address_tfidf_rank from far"),
        "addr_pool": _sql(f"select {_P}, route_mask::bigint as route_mask, least_df, pool_size from ({_capped(_pool(_THREE), 1 << 30)})"),
        "addr_pool_capped": _sql(f"select {_P}, route_mask::bigint as route_mask, least_df from ({_capped(_pool(_THREE + ', ' + repr('postcode_prefix')), '@pool@')})"),
        "addr_pool_diagnostics": _sql(f"select count(*) as n, min(n) as minimum, round(quantile_cont(n, 0.05), 5) as p05, round(quantile_cont(n, 0.25), 5) as p25, round(quantile_cont(n, 0.5), 5) as median, round(quantile_cont(n, 0.75), 5) as p75, round(quantile_cont(n, 0.95), 5) as p95, max(n) as maximum from (select entity_id, count(candidate_entity_id) as n from s1 left join ({_capped(_pool(_THREE), '@pool@')}) p on p.source1_entity_id = entity_id group by 1)"),
        "addr_fallback": _sql(f"select {_P}, least_df, pool_size from {_fallback(repr('postcode'))}"),
        "addr_preblock_topk": _sql(f"select {_P}, round(similarity::decimal(18, 9), 5)::double as address_tfidf_similarity, place as address_tfidf_rank, bit_count(route_mask)::bigint as address_route_count from pre"),
        "fusion_universe2": _sql(f"select {_P}, legacy_rank, round(legacy_score, 5) as legacy_score, tfidf_rank, is_legacy_only, is_tfidf_only, supported_by_both from uni"),
        "fusion_universe3": _sql(f"select {_P}, legacy_rank, tfidf_rank, address_rank, retrieval_channel_count from uni3"),
        "fuse_rrf": _fuse(_RRF, "@final_k@"),
        "fuse_quota": _fuse("fs", "@final_k@", _QUOTA),
        "fuse_naive": _fuse("legacy_score + 4.0 * tfidf_similarity + 0.5 * is_tfidf_only", "@final_k@"),
        "fuse_normalized": _fuse(f"0.6 * {_minmax('legacy_score', 'legacy_rank')} + 0.4 * {_minmax('tfidf_similarity', 'tfidf_rank')} + 0.1 * supported_by_both", "@final_k@"),
        "fuse_hybrid": _fuse("score", "@final_k@", "(" + _protected(_RRF, "uni", f"supported_by_both desc, {_LATE},", "@final_k@", "@protect@").replace("fusion_score", "score") + ")"),
        "fuse_rrf3": _fuse3(f"select *, {_RRF3} as fusion_score from uni3", "@final_k@"),
        "fuse_protected3": _fuse3(_protected(_RRF3, "uni3", "retrieval_channel_count desc,", "@final_k@", "@protect@"), "@final_k@"),
        "pair_features": _sql(f"select {_P}, cheap_rank, {_FEATURES} from feat"),
        "relative_features": _sql(f"""select {_P}, row_number() over (partition by source1_entity_id order by name_token_jaccard desc, candidate_entity_id) as relative_name_rank, round(nb - coalesce(ns, nb), 5) as name_top_margin, round(nb - name_token_jaccard, 5) as name_gap_to_best,
  row_number() over (partition by source1_entity_id order by address_token_jaccard desc, candidate_entity_id) as relative_address_rank, round(ab - coalesce(asec, ab), 5) as address_top_margin, sum((name_token_jaccard >= nb - 0.05::double)::int) over (partition by source1_entity_id)::bigint as close_competitor_count
  from (select *, max(name_token_jaccard) over w as nb, max(address_token_jaccard) over w as ab, list_sort(list(name_token_jaccard) over w, 'desc')[2] as ns, list_sort(list(address_token_jaccard) over w, 'desc')[2] as asec from feat window w as (partition by source1_entity_id))"""),
        "rule_score": _sql(f"select {_P}, round(rule_score, 5) as rule_score from ruled"),
        "pair_labels": _sql(f"select {_P}, label from lab"),
        "hard_negatives": _sql(f"select {_P}, label from (select *, sum(label) over (partition by source1_entity_id) as pos, row_number() over (partition by source1_entity_id, label order by (1 / (1.0 + cheap_rank))::double + address_token_jaccard * 0.15 desc, candidate_entity_id) as place from lab) where label = 1 or place <= greatest(2, pos * 2)"),
        "hash_split": _sql("select entity_id as source1_entity_id, (('0x' || substr(md5('202603:' || entity_id), 1, 12))::bigint / 281474976710656.0::double < 0.25)::bigint as is_validation from s1"),
        "density_nested": _sql("select * from (select entity_id, left(entity_id, 2) as feed_source, row_number() over (partition by left(entity_id, 2) order by md5('202604|' || entity_id), entity_id) as distractor_rank from feed where entity_id not in (select candidate_entity_id from truth)) where distractor_rank <= 50"),
        "bounded_universe": _sql("select entity_id from feed where entity_id in (select candidate_entity_id from truth) union all select * from (select entity_id from feed where entity_id not in (select candidate_entity_id from truth) order by 1 limit 50)"),
        "entity_f05": _sql("select source1_entity_id, tp, n_predicted, n_true, round(f05, 5) as f05 from met"),
        "macro_f05": _sql("select count(*) as entities, round(avg(precision), 5) as macro_precision, round(avg(recall), 5) as macro_recall, round(avg(f05), 5) as macro_f05, round(sum(tp) / sum(n_predicted), 5) as micro_precision, round(sum(tp) / sum(n_true), 5) as micro_recall, count(*) filter (n_predicted = 0) as empty_predictions, sum(tp)::bigint as true_positives from met"),
        "f05_by_country": _sql("select country, count(*) as entities, round(avg(f05), 5) as macro_f05 from met group by 1"),
        "f05_by_bucket": _sql("select case when n_true >= 3 then '3+' else n_true::varchar end as bucket, count(*) as entities, round(avg(f05), 5) as macro_f05 from met group by 1"),
        "candidate_metrics": _sql("""select round(sum(hit) / sum(nt), 5) as pair_recall, round(avg(case when nt = 0 then 1.0 else hit / nt end), 5) as entity_recall, round(avg(case when nt = 0 then 1.0 when hit = 0 then 0.0 else 1.25 * hit / (1.25 * hit + 0.25 * (nt - hit)) end), 5) as oracle_f05, round(avg(nc), 5) as mean_candidates, round(quantile_cont(nc, 0.5), 5) as median_candidates, round(quantile_cont(nc, 0.95), 5) as p95_candidates, max(nc) as max_candidates
  from (select entity_id, (select count(*) from truth t where t.source1_entity_id = entity_id) as nt, (select count(*) from cand c where c.source1_entity_id = entity_id) as nc, (select count(*) from truth t join cand c using (source1_entity_id, candidate_entity_id) where t.source1_entity_id = entity_id) as hit from s1)"""),
        "blocker_recovery": _sql(" union all ".join(f"select '{f}' as channel, coalesce(sum({f}), 0)::bigint as recovered, count(*) filter ({f} = 1 and {_SUM} = 1) as unique_links from lab where label = 1" for f in _FLAG_LIST)),
        "channel_overlap": _sql(" union all ".join(f"select '{a}' as channel, '{b}' as other, count(*) filter ({a} = 1 and {b} = 1) as links from lab where label = 1" for i, a in enumerate(_FLAG_LIST) for b in _FLAG_LIST[i + 1 :])),
        "threshold_sweep": _sql(_sweep("rule_score", _GRID)),
        "rule_threshold": _sql(_best(_sweep("rule_score", _RULES, digits=12), "micro_precision desc, threshold desc")),
        "country_thresholds": _sql(f"select {_P}, round(rule_score, 5) as rule_score from ruled where rule_score >= case country when 'en' then 0.95 when 'fr' then 0.85 else 0.9 end"),
        "blend_sweep": _sql(" union all ".join("select *, " + f"{a}::double as alpha from (" + _sweep(f"round(rule_score * {a} + name_token_jaccard * {1 - a}, 9)", [0.5, 0.8, 0.9]) + ")" for a in (0.0, 0.5, 1.0))),
        "model_disagreement": _sql("select case when rule_score >= 0.9 and name_token_jaccard >= 0.8 then 'both' when rule_score >= 0.9 then 'only_a' when name_token_jaccard >= 0.8 then 'only_b' else 'neither' end as decision, count(*) as pairs, sum(label)::bigint as true_pairs from lab group by 1"),
        "fn_decomposition": _sql("select s.country_norm as country, case when p.source1_entity_id is not null then 'found' when c.source1_entity_id is not null then 'rejected' else 'not_retrieved' end as outcome, count(*) as links from truth t join s1 s on s.entity_id = t.source1_entity_id left join cand c using (source1_entity_id, candidate_entity_id) left join pred p using (source1_entity_id, candidate_entity_id) group by all"),
        "fp_taxonomy": _sql("select case when name_full_exact = 1 and address_exact = 0 then 'exact name, different address' when numeric_token_conflict = 1 then 'address-number conflict' when address_exact = 1 and name_core_exact = 0 then 'exact address, different name' else 'other similarity collision' end as pattern, count(*) as pairs from lab where label = 0 and rule_score >= 0.5 group by 1"),
        "average_precision": _sql("select round(sum(tp * tps / ns) / sum(tp), 5) as average_precision from (select tp, sum(tp) over (order by rule_score desc)::double as tps, sum(n) over (order by rule_score desc) as ns from (select rule_score, sum(label)::double as tp, count(*) as n from lab group by 1))"),
        "score_distribution": _sql("select label, count(*) as n, round(min(rule_score), 5) as minimum, round(quantile_cont(rule_score, 0.05), 5) as p05, round(quantile_cont(rule_score, 0.25), 5) as p25, round(quantile_cont(rule_score, 0.5), 5) as median, round(quantile_cont(rule_score, 0.75), 5) as p75, round(quantile_cont(rule_score, 0.95), 5) as p95, round(max(rule_score), 5) as maximum from lab group by 1"),
        "submission_matching": _sql("select entity_id as source1_entity_id, coalesce((select string_agg(candidate_entity_id, ',' order by candidate_entity_id) from truth t where t.source1_entity_id = entity_id), '') as matched_entity_ids from s1"),
        "submission_candidates": _sql("select entity_id as source1_entity_id, coalesce((select string_agg(candidate_entity_id, ',' order by cheap_rank) from cand t where t.source1_entity_id = entity_id and cheap_rank <= 5), '') as candidate_entity_ids from s1"),
        "truth_links": _sql(f"select {_P}, country, candidate_country, bucket, left_name, right_name from links"),
        "channel_diagnosis": _sql(f"""select channel, level, value, count(*) as true_links, count(alone) as recovered, count(*) filter (alone) as unique_links from (
  select channel, alone, unnest(['all', 'country', 'bucket']) as level, unnest(['all', country, bucket]) as value from (select l.*, channel from links l, (select unnest(['full', 'core', 'sorted', 'address', 'cross', 'name_token', 'address_token']) as channel)) l
  left join (select *, count(*) over (partition by {_P}) = 1 as alone from (select distinct {_P}, channel from linkkeys where frequent and not capped)) k using ({_P}, channel)) group by 1, 2, 3"""),
        "suppressed_postings": _sql("select channel, count(*) filter (frequent and capped) as suppressed from linkkeys group by 1"),
        "retrieval_bundle": _sql(f"select level, value, {_METRICS} from (select c.*, unnest(['overall', 'heldout', 'country']) as level, unnest(['all', case when {_held(202603)} then 'all' end, case when {_held(202603)} then country end]) as value from {_counted(_ranked_fusion(_RRF, '@final_k@', 'uni'))} c) where value is not null group by 1, 2"),
        "label_metrics": _sql(f"select 'total_candidate_pairs' as metric, 'all' as value, count(*) as n from lab union all select 'recovered_positives', 'all', count(*) from lab where label = 1 having count(*) > 0 union all select 'negatives', 'all', count(*) from lab where label = 0 union all select 'positives_by_source', left(candidate_entity_id, 2), count(*) from lab where label = 1 group by 2 union all select 'positives_by_country', country, count(*) from lab where label = 1 group by 2 union all select 'missed_positives', 'all', count(*) from truth anti join lab using ({_P}) having count(*) > 0"),
        "pair_summary": _sql("select count(distinct source1_entity_id) as entities, count(*) as pairs, sum(label)::bigint as positive_pairs, count(*) filter (label = 0) as negative_pairs, round(sum(label) / count(*) filter (label = 0), 5) as positive_negative_ratio, round(count(*) / count(distinct source1_entity_id), 5) as average_pairs, sum(source_is_s2)::bigint as pairs_s2, sum(source_is_s3)::bigint as pairs_s3, (sum(label) filter (source_is_s2 = 1))::bigint as positives_s2, (sum(label) filter (source_is_s3 = 1))::bigint as positives_s3 from lab"),
        "probability_metrics": _sql("select round(sum((n - tp) * (tps - tp + 0.5 * tp)) / (sum(tp) * sum(n - tp)), 5) as roc_auc, round(sum(tp * tps / ns) / sum(tp), 5) as average_precision, round(sum(-(tp * ln(p) + (n - tp) * ln(1 - p))) / sum(n), 5) as log_loss from (select tp, n, greatest(least(rule_score, 1 - 1e-15::double), 1e-15::double) as p, sum(tp) over (order by rule_score desc)::double as tps, sum(n) over (order by rule_score desc)::double as ns from (select rule_score, sum(label)::double as tp, count(*) as n from lab group by 1))"),
        "truth_distribution": _sql("select case when nt >= 3 then '3+' else nt::varchar end as bucket, count(*) as entities from (select entity_id, (select count(*) from truth where source1_entity_id = entity_id) as nt from s1) group by 1"),
        "dense_sweep": _sql(_best(_sweep("rule_score", dense_grid(), digits=12), "threshold")),
        "probability_threshold": _sql(_best(_sweep("rule_score", probability_grid(), digits=12), "micro_precision desc, threshold desc")),
        "country_sweep": _sql(_best(_sweep("rule_score", dense_grid(0.5, 0.98, 25), digits=12, by="country, "), "threshold", "country, ")),
        "blend_by_country": _sql(" union all ".join(f"select *, {a}::double as alpha from (" + _sweep(f"round(rule_score * {a} + name_token_jaccard * {1 - a}, 9)", [0.5, 0.8, 0.9], by="country, ") + ")" for a in (0.0, 0.25, 1.0))),
        "fused_relative_features": _sql(f"""select {_P}, row_number() over (partition by source1_entity_id order by nj desc, candidate_entity_id) as relative_name_rank, row_number() over (partition by source1_entity_id order by aj desc, candidate_entity_id) as relative_address_rank, row_number() over (partition by source1_entity_id order by tfidf_similarity desc, candidate_entity_id) as relative_tfidf_rank, row_number() over (partition by source1_entity_id order by fusion_score desc, candidate_entity_id) as relative_fusion_rank,
  round(nb[1] - coalesce(nb[2], nb[1]), 5) as name_top_margin, round(ab[1] - coalesce(ab[2], ab[1]), 5) as address_top_margin, round(tb[1] - coalesce(tb[2], tb[1]), 5) as tfidf_top_margin, round(fb - fusion_score, 5) as fusion_gap_to_best, sum((nj >= nb[1] - 0.05::double)::int) over (partition by source1_entity_id)::bigint as close_competitor_count
  from (select *, list_sort(list(nj) over w, 'desc') as nb, list_sort(list(aj) over w, 'desc') as ab, list_sort(list(tfidf_similarity) over w, 'desc') as tb, max(fusion_score) over w as fb from (select f.* replace (fusion_score::double as fusion_score), {_jaccard('l.name_tokens', 'r.name_tokens')} as nj, {_jaccard('l.address_tokens', 'r.address_tokens')} as aj from {_ranked_fusion(_RRF, '@final_k@', 'uni')} f join s1 l on l.entity_id = source1_entity_id join feed r on r.entity_id = candidate_entity_id) window w as (partition by source1_entity_id))"""),
        "address_extras": _sql(f"""select {_P}, round(coalesce(sim, 0)::decimal(18, 9), 5)::double as address_tfidf_similarity, coalesce(pr, 0) as address_tfidf_rank, {', '.join(f"coalesce((mask & {bit} > 0)::bigint, 0) as address_route_{name}" for name, bit in (("postcode", 1), ("postcode_prefix", 2), ("numeric", 4), ("rare_token", 8), ("country_fallback", 16)))},
  coalesce(bit_count(mask), 0)::bigint as address_route_count, coalesce(pool_size, 0) as pool_size, (pr is not null)::bigint as has_address_tfidf, (pr is not null)::bigint as block_address_tfidf, (pr is not null and legacy_rank = 0 and tfidf_rank = 0)::bigint as is_address_tfidf_only, retrieval_channel_count,
  row_number() over (partition by source1_entity_id order by coalesce(sim, 0) desc, candidate_entity_id) as relative_address_tfidf_rank, round((max(coalesce(sim, 0)) over (partition by source1_entity_id) - coalesce(sim, 0))::decimal(18, 9), 5)::double as address_tfidf_gap_to_best
  from ({_protected(_RRF3, "uni3p", "retrieval_channel_count desc,", "@final_k@", "@protect@")}) f left join (select {_P}, place as pr, similarity as sim, route_mask as mask, pool_size from pre) p using ({_P})"""),
        "submission_violations": _sql(f"""select problem, rows from (select unnest(['duplicate_source', 'missing_source', 'unknown_source', 'duplicate_match', 'wrong_prefix', 'unknown_match', 'match_not_candidate']) as problem, unnest([
    (select count(*) from (select e from (select entity_id as e from s1 union all select distinct source1_entity_id from truth) group by 1 having count(*) > 1)),
    (select count(*) from s1 where entity_id not in (select entity_id from s1 union all select source1_entity_id from truth)),
    (select count(*) from truth where source1_entity_id not in (select entity_id from s1)),
    (select count(*) from (select {_P} from (select * from truth union all select * from truth) group by 1, 2 having count(*) > 1)),
    (select 2 * count(*) from truth where candidate_entity_id not like 'S2-%' and candidate_entity_id not like 'S3-%'),
    (select 2 * count(*) from truth where candidate_entity_id not in (select entity_id from feed)),
    (select 2 * count(*) from truth anti join (select * from ranked where cheap_rank <= 5) c using ({_P}))]) as rows)"""),
        "displaced_links": _sql(f"select {_P}, legacy_rank, round(legacy_score, 5) as legacy_score, tfidf_rank, round(tfidf_similarity::decimal(18, 9), 5)::double as tfidf_similarity, (s.source1_entity_id is not null)::bigint as recovered from truth join uni u using ({_P}) anti join {_ranked_fusion('fs', 4, _QUOTA.replace('@legacy_quota@', '2').replace('@tfidf_quota@', '2').replace('@final_k@', '4'))} q using ({_P}) left join (select {_P}, 1 as one from {_ranked_fusion(_RRF, '@final_k@', 'uni')}) s using ({_P}) where legacy_rank > 0".replace("(s.source1_entity_id is not null)", "(s.one is not null)")),
        "blocked_out": _sql(f"select {_P}, round(similarity::decimal(18, 9), 5)::double as name_tfidf_similarity from truth anti join (select * from ranked where cheap_rank = 1) c using ({_P}) left join near using ({_P})"),
        "error_examples": _sql(f"select {_P}, round(rule_score, 5) as rule_score from lab where label = 0 and rule_score >= 0.5 order by lab.rule_score desc, {_P} limit 15"),
        "link_outcomes": _sql(f"select (c.one is not null)::bigint as candidates, (n.one is not null)::bigint as near, count(*) as links from truth left join (select {_P}, 1 as one from cand) c using ({_P}) left join (select {_P}, 1 as one from near) n using ({_P}) group by 1, 2"),
        "fusion_grid": _sql(_grid()),
        "posting_cap_scaled": _sql("select channel, count(*) as keys, sum(df)::bigint as postings from (select c.*, coalesce(shard, 0) as shard from counts c left join (select country_norm as scope, count(*) as shard from feed group by 1) s on s.scope = c.scope) where case when channel in ('name_token', 'address_token') then df <= 15 and df <= least(greatest(5, ceil(shard * 0.04::double)), 12) else df <= 5 end group by 1"),
        "stage_retrieval_union": _sql(" union all ".join(f"select '{n}@{k}' as variant, {_METRICS} from {_counted(t.format(k=k))}" for n, t in (("blocking", "(select * from ranked where cheap_rank <= {k})"), ("union", f"(select {_P} from (select *, row_number() over (partition by source1_entity_id order by s desc, candidate_entity_id) as cheap_rank from (select {_P}, (coalesce(cheap_score, 0)::double - 0.5 * coalesce(same_country_block, 0)::double + 0.5 * (case when n.place is not null then 1 else coalesce(same_country_block, 0) end) + 4.0::double * coalesce(similarity, 0))::float as s from scores c full join near n using ({_P}))) where cheap_rank <= {{k}})")) for k in (20, 30, 50, 75, 100))),
        "pool_sizes": _sql(" union all ".join(_pool_stats(n, ", ".join(map(repr, routes)), limits) for n, (routes, limits) in STRATEGIES.items())),
        "tfidf_vocab_cap": "with " + ",\n".join(f"{n} as materialized ({_CTES[n]})" for n in ("rec", "base", "cored", "norm", "feed")) + "," + _vocab("nt", "name_core", 50) + "\nselect country, gram, df, round(idf, 5) as idf from nt_v",
    }


def oracle_sql() -> dict[str, str]:
    """The twins of the catalogue's queries, with the limits of its settings put in."""
    from linkforge.plans.catalog import CAPPED, DEFAULT, SMALL

    def filled(text: str, setting) -> str:
        c = setting.config
        values = {"cap": c.posting_cap, "name_df": c.name_token_df, "address_df": c.address_token_df, "k": c.candidate_k, "tk": c.tfidf_k, "ak": c.address_k, "pool": c.pool_cap, "prefix_df": c.prefix_max_df, "numeric_df": c.numeric_max_df, "rare_df": c.rare_token_max_df, "fallback_df": c.fallback_max_df}
        values |= {k: getattr(setting, k) for k in ("depth", "final_k", "legacy_quota", "tfidf_quota", "protect")}
        for name, value in values.items():
            text = text.replace(f"@{name}@", str(value))
        return text

    twins = _twins()
    return {**{k: filled(v, DEFAULT) for k, v in twins.items()}, **{f"capped_{k}": filled(twins[k], SMALL) for k in CAPPED if k in twins}}
