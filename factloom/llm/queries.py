"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, divergence_audit, graph_search, jaccard_join, line_dedup, maxent_lm, packing, periodic_runs, quality_classifier, secret_scan, toxicity_grammar, url_filter, warc_archive
from .common import table

def op9_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_grammar.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_search.search(table(spark, sf_dir, "embeddings"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


RULES_SQL = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in url_filter.RULES)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent_lm.score(table(spark, sf_dir, "documents"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(table(spark, sf_dir, "documents")).drop("node")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.rule_table(spark))


def op8_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_archive.digest(table(spark, sf_dir, "pages"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digest(table(spark, sf_dir, "documents"))


def op13_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_audit.audit(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_quality_classifier, op3_packing, op4_maxent_lm, op5_jaccard_join, op6_decontamination, op7_url_filter, op8_warc_archive, op9_toxicity_grammar, op10_graph_search, op11_line_dedup, op12_periodic_runs, op13_divergence_audit)}

_FOLD_CASE = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
_ASSIGN = "(" + "|".join(_FOLD_CASE(w) for w in ("password", "passwd", "secret", "token")) + "|" + "[aA][pP][iI]_?[kK][eE][yY]" + ")[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
_KIND_SQL = (("assign", _ASSIGN, 2, 8), ("access", "AKIA[A-Z0-9]+", 0, 16), ("hex", "[0-9a-f]+", 0, 32), ("live", "[A-Za-z0-9+/_=-]{20,}", 0, 20))


def _secrets_sql() -> str:
    found = "\n  union all ".join(
        f"select r, owner, repo, txt, {i} as kind, '{k}' as name, {n} as least, string_split_regex(txt, '{p}') as gaps, regexp_extract_all(txt, '{p}', 0) as hits, regexp_extract_all(txt, '{p}', {g}) as vals from d"
        for i, (k, p, g, n) in enumerate(_KIND_SQL)
    )
    return f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as txt, coalesce(source, '') as owner, concat_ws('/', coalesce(source, ''), coalesce(lang, '')) as repo from documents),
f as ({found}),
u as (select r, owner, repo, txt, kind, name, least, unnest(range(1, len(hits) + 1)) as i, gaps, hits, vals from f),
p as (select r, owner, repo, txt, kind, name, least, hits[i] as hit, vals[i] as val, (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0))::bigint as s from u),
ok as (select *, s + length(hit) as e, sha256(val) as h from p where length(val) >= least),
base as (select * from ok where kind < 3),
wide as (select * from ok w where kind = 3 and regexp_matches(val, '[0-9]') and regexp_matches(val, '[a-z]') and regexp_matches(val, '[A-Z]')
  and not exists (select 1 from base b where b.r = w.r and b.s < w.e and w.s < b.e)),
occ as (select * from base union all select * from wide),
own as (select h, count(distinct owner) < {secret_scan.MAX_OWNERS} and count(distinct repo) < {secret_scan.MAX_REPOS} as live from occ group by h),
agg as (select r,
  count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex,
  string_agg(name || ':' || s || ':' || e, ',' order by s, kind) filter (kind < 3) as base_text,
  string_agg(name || ':' || s || ':' || e, ',' order by s, kind, e) filter (kind < 3 or live) as spans,
  count(*) filter (live) as n_live, count(*) filter (not live) as n_copied
  from occ join own using (h) group by r)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex,
  sha256(coalesce(base_text, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_live, 0)::bigint as n_live, coalesce(n_copied, 0)::bigint as n_copied
from d left join agg using (r)"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE_SQL = {
    "op13_divergence_audit": f"""
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
  regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as terms from documents),
w as (select r, lang, source, unnest(terms) as term from d),
c as (select lang, source, term, count(*) as n from w group by all),
k as (select lang, term, count(*) as n from w group by all having count(distinct r) >= {divergence_audit.MIN_DOCS}),
g as (select distinct lang, source from d),
v as (select g.lang, count(k.term) as kept, coalesce(sum(k.n), 0)::hugeint as total from (select distinct lang from g) g left join k on g.lang = k.lang group by g.lang),
t as (select g.lang, g.source, coalesce(sum(c.n) filter (k.term is not null), 0)::hugeint as total from g left join c on g.lang = c.lang and g.source = c.source left join k on c.lang = k.lang and c.term = k.term group by all),
p as (select k.lang, t.source, k.term, coalesce(c.n, 0) as n, 1 + ({divergence_audit.SCALE}::hugeint * (coalesce(c.n, 0) + 2)) // (t.total + 2 * v.kept) as p,
  1 + ({divergence_audit.SCALE}::hugeint * (k.n + 2)) // (v.total + 2 * v.kept) as q
  from k join v on k.lang = v.lang join t on k.lang = t.lang left join c on c.lang = k.lang and c.source = t.source and c.term = k.term),
pair as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::bigint as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
every_pair as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(pair.value, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source
  left join pair on pair.lang = a.lang and pair.source = a.source and pair.item = b.source),
term as (select lang, source, 'term' as part, term as item, ((p - q) * (p - q) // (p + q))::bigint as value from p where n > 0 and p > q),
o as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from (select * from every_pair union all select * from term))
select * from o where part = 'pair' or rank <= {divergence_audit.TOP}""",
    "op12_periodic_runs": f"""
with d as (select row_number() over () as r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as own,
  case when doc_id is null then 0 else xor(list_reduce(list_transform(string_split(doc_id::varchar, ''), lambda x: ord(x)::bigint),
    lambda c, b: list_reduce(range(8), lambda x, k: xor(x >> 1, (x & 1) * 3988292384), xor(c, b)), 4294967295), 4294967295) end as h from documents),
s as (select r, doc_id, own, h, len(own) as n, case when len(own) > 0 then (h // 10) % len(own) end as a from d),
p as (select *, case when h % 10 = 0 and n > 0 then list_transform(range(n), lambda i: own[case when i >= a then a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) else i end + 1]) else own end as words from s),
w as (select r, n, unnest(range(n)) as i, unnest(words) as word from p),
q as (select x.r, y.i - x.i as q, x.i from w x join w y on x.r = y.r and x.word = y.word and x.i < y.i and {periodic_runs.POWER} * (y.i - x.i) <= x.n),
k as (select r, q, i, i - row_number() over (partition by r, q order by i) as island from q),
e as (select r, q, min(i) as s, count(*) + q as l from k group by r, q, island having count(*) + q >= greatest({periodic_runs.LEAST}, {periodic_runs.POWER} * q)),
u as (select r, s, l, min(q) as q from e group by r, s, l),
t as (select r, count(*) as n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' order by s, q) as listed, arg_min(struct_pack(s := s, l := l, q := q), row(-l, s, q)) as top from u group by r),
gone as (select distinct r, unnest(range(s + q, s + l)) as i from u),
c as (select w.r, string_agg(word, ' ' order by w.i) as kept from w left join gone on w.r = gone.r and w.i = gone.i where gone.i is null group by w.r)
select doc_id, coalesce(n_runs, 0)::bigint as n_runs, top.s::bigint as start, top.l::bigint as length, top.q::bigint as period, (1000 * top.l // top.q)::bigint as exponent_milli,
  sha256(coalesce(listed, '')) as runs_sha256, sha256(coalesce(kept, '')) as collapsed_sha256 from p left join t on p.r = t.r left join c on p.r = c.r""",
    "op11_line_dedup": f"""
with d as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
l as (select r, doc_id, unnest(range(1, len(lines) + 1)) as i, unnest(lines) as line from d),
k as (select *, case when length(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) >= {line_dedup.MIN_CHARS}
  then translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') end as key from l),
g as (select key, max(doc_id) as keeper from k where key is not null group by key having count(distinct doc_id) >= {line_dedup.MIN_DOCS}),
m as (select k.*, g.key is not null and k.doc_id <> g.keeper as gone from k left join g on k.key = g.key)
select any_value(doc_id) as doc_id, count(*)::bigint as n_lines, count(*) filter (gone)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256 from m group by r""",
    "op1_secret_scan": _secrets_sql(),
    "op5_jaccard_join": """
with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as words from documents),
s as (select doc_id, case when len(words) = 0 then [] when len(words) < 4 then [array_to_string(words, ' ')] else list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))) end as shingles from w),
e as (select doc_id, len(shingles) as n, unnest(shingles) as x from s),
p as (select a.doc_id as i, b.doc_id as j, any_value(a.n) as an, any_value(b.n) as bn, count(*) as c from e a join e b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2),
l as (select i, j from p where 100 * c >= 85 * (an + bn - c)),
d as (select i, j from l union all select j, i from l),
r(doc_id, m) as (select doc_id, doc_id from s union select r.doc_id, d.j from r join d on r.m = d.i)
select doc_id, len(shingles)::bigint as n_shingles, (select min(m) from r where r.doc_id = s.doc_id) as component_id, (select count(*) from d where d.i = s.doc_id) as n_links from s""",
    "op7_url_filter": f"""
with rules(verdict, host, path) as (values {RULES_SQL}),
p as (select page_id, coalesce(url, '') as url, strpos(coalesce(url, ''), '://') as pos from pages),
q as (select row_number() over () as r, page_id,
  case when pos > 0 then translate(regexp_extract(substr(url, pos + 3), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else '' end as host,
  case when pos > 0 then regexp_extract(substr(url, pos + 3), '^[^/?#]*([^?#]*)', 1) else '' end as path from p),
m as (select q.*, rules.host || rules.path as rule, rules.verdict as v,
  row_number() over (partition by r order by length(rules.host || rules.path) desc nulls last, rules.host || rules.path desc) as k
  from q left join rules on (q.host = rules.host or ends_with(q.host, '.' || rules.host)) and starts_with(q.path, rules.path))
select page_id, host, path, rule, coalesce(v, '{url_filter.DEFAULT}') as verdict from m where k = 1""",
    "op8_warc_archive": f"""
with p as (select page_id, coalesce(html, '') as body, strlen(coalesce(html, ''))::bigint as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
k as (select *, max(page_id) over (partition by payload_digest) as keeper from p)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes < {warc_archive.REVISIT_BYTES} or page_id is not distinct from keeper then 'response' else 'revisit' end as record_type,
  case when payload_bytes >= {warc_archive.REVISIT_BYTES} and page_id is distinct from keeper then keeper end as refers_to from k""",
}
