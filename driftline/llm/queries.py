"""The queries that apply each operator to its whole table, and SQL for those SQL can express."""

from __future__ import annotations

from driftline.llm import (decontaminate, divergence, exact_dedup, filter_audit, language,
                           licenses, mixing, packing, pii, simhash, suffix_dedup, toxicity, warc)
from driftline.llm.common import table


def op1_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op2_mix_sources(spark, sf_dir):
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op3_language(spark, sf_dir):
    return language.identify(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op5_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_toxicity(spark, sf_dir):
    return toxicity.grade_toxicity(table(spark, sf_dir, "documents"),
                                   table(spark, sf_dir, "labels"))


def op7_decontaminate(spark, sf_dir):
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"),
                                       table(spark, sf_dir, "benchmark"))


def op8_licenses(spark, sf_dir):
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op9_pii(spark, sf_dir):
    return pii.pii_report(table(spark, sf_dir, "documents"))


def op10_pack_tokens(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark, sf_dir):
    return filter_audit.audit_filters(table(spark, sf_dir, "documents"),
                                      table(spark, sf_dir, "labels"))


def op12_warc(spark, sf_dir):
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def op13_source_divergence(spark, sf_dir):
    return divergence.audit_sources(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_mix_sources": op2_mix_sources,
    "op3_language": op3_language,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_simhash": op5_simhash,
    "op6_toxicity": op6_toxicity,
    "op7_decontaminate": op7_decontaminate,
    "op8_licenses": op8_licenses,
    "op9_pii": op9_pii,
    "op10_pack_tokens": op10_pack_tokens,
    "op11_filter_audit": op11_filter_audit,
    "op12_warc": op12_warc,
    "op13_source_divergence": op13_source_divergence,
}

_WORDS = r"""
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

ORACLES = {
    "op1_exact_dedup": """
with d as (select doc_id, coalesce(text, '') as t from documents)
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
  doc_id is not distinct from max(doc_id) over g as kept, sha256(t) as text_sha256
from d window g as (partition by t)""",
    "op2_mix_sources": r"""
with d as (select doc_id, source,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
    md5(coalesce(cast(doc_id as varchar), '') || ':' || md5(coalesce(text, ''))) as key
    from documents),
r as (select source, cast(sum(size) as bigint) as s,
    row_number() over (order by source asc nulls last) as rank from d group by source),
w as (select *, [3, 1, 2][(rank - 1) % 3 + 1] as w from r),
f as (select *, s * (6 // w) as level, sum(s) over () as s_all, sum(w) over () as w_all from w),
b as (select *, coalesce(sum(s) over o, 0) as s_before, coalesce(sum(w) over o, 0) as w_before
    from f window o as (order by level, rank rows between unbounded preceding and 1 preceding)),
c as (select *, w * (3 * s_all - 4 * s_before) >= 4 * s * (w_all - w_before) as stops from b),
e as (select *, sum(case when stops then s else 0 end) over () as s_stop,
    sum(case when stops then w else 0 end) over () as w_stop from c),
t as (select source, s, case when stops then 2 * cast(s as double)
    else cast(w * (3 * s_all - 4 * s_stop) as double) / cast(2 * (w_all - w_stop) as double) end
    as target from e),
q as (select *, cast(floor(target + 0.5) as bigint) as quota from t),
p as (select d.doc_id, d.size, q.s as source_size, q.target, q.quota,
    sum(d.size) over (partition by d.source order by d.key, d.size
      rows between unbounded preceding and current row) - d.size as start
    from d join q on d.source is not distinct from q.source)
select doc_id, cast(size as bigint) as size, source_size, target,
  cast(case when source_size = 0 then 0 else (quota // source_size) * size
    + least(greatest(quota % source_size - start, 0), size) end as bigint) as taken from p""",
    "op7_decontaminate": f"""
with d as (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
b as (select distinct cast(item_id as varchar) as item, {_WORDS} as w from benchmark
    where item_id is not null),
i as (select item, w, least(13, len(w)) as n from b where len(w) > 0),
k as (select distinct item, n, array_to_string(w[a:a + n - 1], ' ') as key
    from (select item, w, n, unnest(range(1, len(w) - n + 2)) as a from i)),
z as (select distinct n from k),
p as (select r, n, a, array_to_string(w[a:a + n - 1], ' ') as key
    from (select r, w, n, unnest(range(1, len(w) - n + 2)) as a from d, z where len(w) >= n)),
m as (select p.r, p.n, p.a, k.item from p join k on p.n = k.n and p.key = k.key),
h as (select r, count(*) as n_hit from (select distinct r, unnest(range(a, a + n)) as at from m)
    group by r),
j as (select r, count(*) as n_items, string_agg(item, ',' order by item) as items
    from (select distinct r, item from m) group by r)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join h using (r) left join j using (r)""",
    "op11_filter_audit": r"""
with w as (select doc_id, coalesce(text, '') as t, coalesce(source, '') as part,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
f as (select doc_id, part, len(w) < 200 as a, 100 * list_unique(w) < 50 * len(w) as b,
    100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t) as c,
    regexp_matches(t, '[#$%&*|]') as d,
    coalesce(min(doc_id) over (partition by t) < doc_id, false) as e from w),
l as (select doc_id, coalesce(bool_or(quality = 1), false) as good,
    coalesce(bool_or(toxic = 1), false) as toxic from labels group by doc_id),
n as (select part, [a, b, c, d, e] as fails, count(*) as n,
    count(*) filter (where coalesce(good, false)) as n_good,
    count(*) filter (where coalesce(toxic, false)) as n_toxic
    from f left join l using (doc_id) group by all),
x as (select unnest(range(1, 6)) as i),
o as (select [p.i, q.i, r.i, s.i, t.i] as o from x p, x q, x r, x s, x t
    where len(list_distinct([p.i, q.i, r.i, s.i, t.i])) = 5),
y as (select o, x.i as step, o[x.i] as own,
    array_to_string(list_transform(o, lambda k: 'ABCDE'[k]), '') as filter_order from o, x),
z as (select part, filter_order, step, n, n_good, n_toxic, own, fails[own] as here,
    len(list_filter(o[:step - 1], lambda k: fails[k])) > 0 as gone,
    len(list_filter(fails, lambda k: k)) as k from n, y)
select part, filter_order, cast(step as int) as step,
  cast(sum(case when not gone and not here then n else 0 end) as bigint) as kept,
  cast(sum(case when not gone and here then n else 0 end) as bigint) as removed,
  cast(sum(case when gone and here then n else 0 end) as bigint) as redundant,
  cast(sum(case when here and k = 1 then n else 0 end) as bigint) as unique_fails,
  cast(sum(case when not gone and here then n_good else 0 end) as bigint) as good_lost,
  cast(sum(case when not gone and here then n_toxic else 0 end) as bigint) as toxic_lost,
  cast(sum(case when here then n * (120 // k) else 0 end) as bigint) as shapley
from z group by part, filter_order, step""",
    "op12_warc": """
with p as (select page_id, coalesce(html, '') as t, sha1(coalesce(html, '')) as h from pages),
q as (select page_id, t, list_transform(range(8), lambda i:
    cast('0x' || substr(h, 5 * i + 1, 5) as bigint)) as v, min(page_id) over (partition by t) as first
    from p)
select page_id, strlen(t) as payload_bytes, array_to_string(list_transform(range(32), lambda i:
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[cast((v[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31 as int) + 1]),
    '') as payload_digest,
  case when first is null or page_id is not distinct from first then 'response' else 'revisit' end
    as record_type,
  case when page_id is distinct from first then first end as refers_to from q""",
    "op13_source_divergence": r"""
with d as (select row_number() over () as r, coalesce(lang, '') as lang,
    coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
o as (select r, lang, source, unnest(w) as term from d),
k as (select lang, term from o group by lang, term having count(distinct r) >= 10),
n as (select lang, source, term, count(*) as n from o join k using (lang, term) group by all),
v as (select lang, count(*) as v from k group by lang),
g as (select lang, source, coalesce(any_value(v), 0) as v from d left join v using (lang)
    group by all),
t as (select lang, source, sum(n) as s from n group by all),
h as (select lang, source, v, coalesce(s, 0) as s from g left join t using (lang, source)),
p as (select lang, source, term, coalesce(n, 0) as n, cast(1 + (1000000000 * (coalesce(n, 0) + 2))
    // (s + 2 * v) as bigint) as p
    from h join k using (lang) left join n using (lang, source, term)),
a as (select lang, term, cast(1 + (1000000000 * (sum(n) + 2)) // (any_value(s) + 2 * any_value(v))
    as bigint) as q from n join (select lang, sum(s) as s, any_value(v) as v from h group by lang)
    using (lang) group by lang, term),
f as (select x.lang, x.source, y.source as item,
    sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) as value
    from p x join p y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all),
u as (select x.lang, x.source, 'pair' as part, y.source as item, coalesce(value, 0) as value
    from h x join h y on x.lang = y.lang and x.source <> y.source
    left join f on f.lang = x.lang and f.source = x.source and f.item = y.source
  union all select lang, source, 'term', term, (p - q) * (p - q) // (p + q)
    from p join a using (lang, term) where n > 0 and p > q)
select lang, source, part, item, cast(value as bigint) as value, cast(row_number() over (
    partition by lang, source, part order by value desc, item) as int) as rank from u
qualify part = 'pair' or rank <= 10""",
}
