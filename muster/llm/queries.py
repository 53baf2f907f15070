"""One query per operator over its whole table, and the SQL it is checked with."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from muster.llm import (decontaminate, fill_middle, html_text, licenses, line_dedup, near_dedup, packing, quality, shards, spelling,
                        substring_dedup, token_counts, url_rules)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
VOCABULARY = "word_bpe_49k.json"
END_OF_TEXT = 49407


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    """Path of the public vocabulary, as every executor has it."""
    return public_tokenizers.path(VOCABULARY)


_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"regexp_extract_all(" + _LOW.format("text") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


@query("op1_decontamination", f"""
with d as (select doc_id, {_ALNUM} w from documents),
i as (select cast(item_id as varchar) item_id, {_ALNUM} w from benchmark),
iw as (select item_id, least(len(w), 10) n,
  unnest([array_to_string(w[k:k + least(len(w), 10) - 1], ' ') for k in range(1, len(w) - least(len(w), 10) + 2)]) win from i where len(w) > 0),
ws as (select distinct n, win from iw),
ns as (select distinct n from ws),
dw as (select doc_id, n, unnest(range(1, len(w) - n + 2)) k, unnest([array_to_string(w[k:k + n - 1], ' ') for k in range(1, len(w) - n + 2)]) win
  from d, ns where len(w) >= n),
h as (select doc_id, k, n, win from dw semi join ws using (n, win)),
hw as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(k, k + n)) p from h) group by doc_id),
hi as (select doc_id, list_sort(list(distinct item_id)) items from h join iw using (n, win) group by doc_id)
select d.doc_id, coalesce(len(w), 0)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(len(items), 0)::bigint n_items,
  sha256(coalesce(array_to_string(items, ','), '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join hw using (doc_id) left join hi using (doc_id)
""")
def _op1(spark, sf_dir):
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("longest")


@query("op2_substring_dedup", f"""
with d as (select doc_id, {_WORDS.format('text')} w from documents),
win as (select doc_id, unnest(range(1, len(w) - 18)) k, unnest([sha256(array_to_string(w[k:k + 19], ' ')) for k in range(1, len(w) - 18)]) h
  from d where len(w) >= 20),
f as (select h, min((doc_id, k)) first from win group by h),
g as (select doc_id, k from win join f using (h) where (doc_id, k) > first),
gw as (select distinct doc_id, unnest(range(k, k + 20)) p from g),
r as (select doc_id, list(p) gone from gw group by doc_id)
select d.doc_id, coalesce(len(w), 0)::bigint n_words, coalesce(len(gone), 0)::bigint n_removed,
  sha256(coalesce(array_to_string(case when gone is null then w else [w[i] for i in range(1, len(w) + 1) if not list_contains(gone, i)] end, ' '), '')) kept_sha256
from d left join r using (doc_id)
""")
def _op2(spark, sf_dir):
    return substring_dedup.repeats(table(spark, sf_dir, "documents"))


def _sql_string(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_TEMPLATES = ", ".join(f"({_sql_string(k)}, {_sql_string(v)})" for k, v in licenses.pairs_of(licenses.TEMPLATES))
_UNIT_WORDS = "string_split(trim(regexp_replace(" + _LOW.format("{}") + ", '[^a-z0-9]+', ' ', 'g')), ' ')"


@query("op3_license_scan", f"""
with t as (select name, list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) b
  from (select name, {_UNIT_WORDS.format('text')} w from (values {_TEMPLATES}) v(name, text))),
l as (select doc_id, string_split(text, chr(10)) l, text from documents),
n as (select doc_id, [x for x in (case when len(l) > 1 then list_append(l, text) else l end) if length(trim(x)) > 0] u from l),
u as (select doc_id, unnest(u) x from n),
b as (select doc_id, list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) b from (select doc_id, {_UNIT_WORDS.format('x')} w from u)),
s as (select doc_id, name, len(list_intersect(b.b, t.b)) shared, len(b.b) + len(t.b) total from b, t
  where 2 * least(len(b.b), len(t.b)) >= 0.8 * (len(b.b) + len(t.b)) and len(b.b) > 0),
ok as (select *, 2.0::double * shared / total dice from s where 2.0::double * shared / total >= 0.8 - 1e-9),
best as (select doc_id, name, shared, total, dice, row_number() over (partition by doc_id order by dice desc, name, shared desc, total desc) r from ok),
names as (select doc_id, array_to_string(list_sort(list(distinct name)), ',') licences from ok group by doc_id)
select n.doc_id, coalesce(len(u), 0)::bigint n_units, name licence, shared::bigint shared, total::bigint total, coalesce(licences, '') licences
from n left join best on n.doc_id = best.doc_id and r = 1 left join names on n.doc_id = names.doc_id
""")
def _op3(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


@query("op4_html_extraction")
def _op4(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


@query("op5_quality_rules")
def _op5(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return quality.judge(documents, quality.rules_from(documents, table(spark, sf_dir, "labels"))).drop("rule")


@query("op6_best_fit_packing")
def _op6(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary())


@query("op7_line_dedup", f"""
with l as (select doc_id, text, string_split(text, chr(10)) l from documents),
x as (select doc_id, k - 1 line, {_WORDS.format('l[k]')} w from (select doc_id, l, unnest(range(1, len(l) + 1)) k from l)),
u as (select doc_id, line, list_distinct(w) s from x where len(w) >= 5),
t as (select doc_id, line, len(s) n, unnest(s) tok from u),
df as (select tok, count(*) c from t group by tok),
p as (select * from (select doc_id, line, n, tok, row_number() over (partition by doc_id, line order by c, tok) r from t join df using (tok))
  where r <= n - ceil(n * 0.8 - 1e-9) + 1),
c as (select distinct a.doc_id d1, a.line l1, b.doc_id d2, b.line l2 from p a join p b using (tok)
  where (a.doc_id, a.line) < (b.doc_id, b.line) and 10 * a.n >= 8 * b.n and 10 * b.n >= 8 * a.n),
v as (select distinct d2 doc_id, l2 line from (select d2, l2, len(list_intersect(a.s, b.s)) i, len(a.s) + len(b.s) z from c
  join u a on a.doc_id = d1 and a.line = l1 join u b on b.doc_id = d2 and b.line = l2) where 10 * i >= 8 * (z - i)),
g as (select doc_id, list(line) gone from v group by doc_id)
select l.doc_id, coalesce(len(l), 0)::bigint n_lines, coalesce(len(gone), 0)::bigint n_removed,
  sha256(coalesce(case when gone is null then text else array_to_string([l[i] for i in range(1, len(l) + 1) if not list_contains(gone, i - 1)], chr(10)) end, '')) kept_sha256
from l left join g using (doc_id)
""")
def _op7(spark, sf_dir):
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


@query("op8_minhash_near_dedup", f"""
with recursive w as (select doc_id, {_WORDS.format(_LOW.format('text'))} w from documents),
s as (select doc_id, case when len(w) > 1 then list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))])
  when len(w) = 1 then [w[1]] else [] end s from w),
t as (select doc_id, len(s) n, unnest(s) tok from s),
df as (select tok, count(*) c from t group by tok),
p as (select * from (select doc_id, n, tok, row_number() over (partition by doc_id order by c, tok) r from t join df using (tok))
  where r <= n - ceil(n * 0.8 - 1e-9) + 1),
c as (select distinct a.doc_id a, b.doc_id b from p a join p b using (tok) where a.doc_id < b.doc_id and 10 * a.n >= 8 * b.n and 10 * b.n >= 8 * a.n),
e as (select a, b from (select c.a, c.b, len(list_intersect(x.s, y.s)) i, len(x.s) + len(y.s) z from c
  join s x on x.doc_id = c.a join s y on y.doc_id = c.b) where 100 * i >= 80 * (z - i)),
both_ways as (select a, b from e union select b, a from e),
reach as (select a, b from both_ways union select r.a, o.b from reach r join both_ways o on o.a = r.b),
m as (select a doc_id, min(b) least_id from reach group by a)
select s.doc_id, coalesce(len(s), 0)::bigint n_shingles, least(s.doc_id, coalesce(least_id, s.doc_id)) component_id,
  s.doc_id <= coalesce(least_id, s.doc_id) kept
from s left join m using (doc_id)
""")
def _op8(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op9_sharding")
def _op9(spark, sf_dir):
    return shards.with_shard(table(spark, sf_dir, "documents"), 24)


@query("op10_token_counts")
def _op10(spark, sf_dir):
    streams = token_counts.write_streams(table(spark, sf_dir, "documents"), vocabulary(), END_OF_TEXT)
    return token_counts.count_tokens(streams, END_OF_TEXT)


#: Rules of the URL filter's query: host, path, verdict.
URL_RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"),
]


@query("op11_url_filter", f"""
with r(host, path, verdict) as (values {", ".join(str(r) for r in URL_RULES)}),
p as (select row_number() over () id, page_id, coalesce({_LOW.format("regexp_extract(url, '://([^/?#]*)([^?#]*)', 1)")}, '') host,
  coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') path from pages),
fit as (select id, r.host || r.path rule, verdict, row_number() over (partition by id order by length(r.host || r.path) desc) k
  from p join r on (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path))
select page_id, host, path, rule, coalesce(verdict, 'allow') verdict from p left join fit on p.id = fit.id and k = 1
""")
def _op11(spark, sf_dir):
    return url_rules.judge(table(spark, sf_dir, "pages"), url_rules.rules_of(spark, URL_RULES)).drop("url")


def _hex_group(k: int) -> str:
    return f"('0x' || substr(h, {8 * k + 1}, 8))::bigint"


@query("op12_fill_in_middle", f"""
with t as (select doc_id, coalesce(text, '') t, sha256('7:' || coalesce(doc_id::varchar, '')) h from documents),
l as (select *, regexp_extract_all(t, '[^\\n]*\\n|[^\\n]+') l from t),
c as (select *, len(l) n, {_hex_group(0)} % (len(l) + 1) a, {_hex_group(1)} % (len(l) + 1) b, {_hex_group(2)} h3, {_hex_group(3)} h4 from l),
f as (select *, case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 100 then 'plain'
    when h4 % 100 < 50 then 'spm' else 'psm' end form,
  array_to_string(l[1:least(a, b)], '') p, array_to_string(l[least(a, b) + 1:greatest(a, b)], '') m, array_to_string(l[greatest(a, b) + 1:n], '') s from c)
select doc_id, n::bigint n, form, case when form <> 'plain' then length(p) end::bigint prefix_chars,
  case when form <> 'plain' then length(m) end::bigint middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) output_sha256,
  sha256(t) restored_sha256 from f
""")
def _op12(spark, sf_dir):
    return fill_middle.digests(table(spark, sf_dir, "documents"))


@query("op13_spelling_groups", f"""
with recursive tab as (select list_transform(range(256), lambda b: list_reduce(list_prepend(b::ubigint, range(8)::ubigint[]),
    lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end)) tab),
r as (select doc_id, unnest(regexp_extract_all({_LOW.format('text')}, '[A-Za-zÀ-ÿ]{{7,}}')) run from documents),
k as (select run, hex(encode(coalesce(doc_id::varchar, '') || ':' || run)) x from r),
b as (select run, list_transform(range(0, len(x), 2), lambda i: ('0x' || substr(x, i::bigint + 1, 2))::ubigint) bytes from k),
h as (select run, xor(list_reduce(list_prepend(4294967295::ubigint, bytes), lambda c, y: xor(c >> 8, tab[(xor(c, y) & 255)::bigint + 1])), 4294967295::ubigint)::bigint h
  from b, tab),
d as (select case when h % 31 = 0 then substr(run, 1, h % len(run)) || substr(run, h % len(run) + 2) else run end word from h),
w as materialized (select word, count(*)::bigint n from d where len(word) >= 7 group by word having count(*) >= 2),
cut as materialized (select word, n, unnest(range(1, len(word) + 1)) i, unnest(list_transform(range(1, len(word) + 1), lambda i: substr(word, 1, i - 1) || substr(word, i + 1))) rest from w),
shorter as (select distinct word, rest from cut),
near as (select a.word, b.word other, b.n from cut a join cut b using (i, rest) where a.word <> b.word
  union all select s.word, w.word, w.n from shorter s join w on w.word = s.rest
  union all select w.word, s.word, v.n from shorter s join w on w.word = s.rest join w v on v.word = s.word),
g as (select word, count(*) n_near, min((-n, other)) best from near group by word),
j as materialized (select w.word, w.n, coalesce(n_near, 0) n_near, case when -best[1] >= 10 * w.n then best[2] end form,
  case when -best[1] >= 10 * w.n then -best[1] end form_n from w left join g using (word)),
chain as (select word, form last from j where form is not null union all select chain.word, j.form from chain join j on j.word = chain.last where j.form is not null),
ends as (select chain.word, last from chain join j on j.word = chain.last where j.form is null)
select j.word, form, coalesce(last, j.word) root, n, n_near::bigint n_near, form_n::bigint form_n from j left join ends on ends.word = j.word
""")
def _op13(spark, sf_dir):
    return spelling.spelling_groups(spelling.counted_words(table(spark, sf_dir, "documents")))
