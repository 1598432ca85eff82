"""The queries of this subpackage: each operator over its whole table, with production parameters, and DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.llm import bpe, collocations, extract, importance, jaccard, licenses, linefreq, packing, pieces, quality, secretscan, suffix, vectors
from ledgerflow.llm._spark import table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents")).drop("k_id", "k_row", "left_chars")


def op2_bpe_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op3_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.linked_vectors(table(spark, sf_dir, "embeddings"))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.main_texts(table(spark, sf_dir, "pages"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.secret_spans(table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op8_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(packing.pieces(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json")))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.removed_digests(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = linefreq.drop_boilerplate(table(spark, sf_dir, "documents"))
    return rows.select("doc.doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("n_chars"), "text")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_piece_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_digests(table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_quality_rules, op2_bpe_coding, op3_vector_dedup, op4_main_text, op5_ngram_jaccard, op6_secret_scan, op7_license_scan, op8_best_two_fit, op9_suffix_dedup, op10_line_dedup, op11_importance_resampling, op12_piece_coding, op13_collocations)
    return {f.__name__: f for f in ops} | {"pipeline": pipeline}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^ \t\n\v\f\r]+')"

OP1 = rf"""
with d as (select row_number() over () as r, doc_id, coalesce(source, '') as host, coalesce(text, '') as text from documents),
w as (select r, {_WORDS.format('text')} as w, {_WORDS.format(_LOWER)} as lw from d),
win as (select r, unnest(range(1, len(w) - 3)) as i, w from w where len(w) >= 5),
keyed as (select r, i, w[i:i+4] as k from win),
twice as (select r, unnest(list(i)) as i from keyed group by r, k having count(*) > 1),
rep as (select r, count(distinct p) as n from (select r, unnest(range(i, i + 5)) as p from twice) group by r),
line as (select r, host, text, unnest(string_split(text, chr(10))) as l from d),
full_line as (select *, {_WORDS.format('l')} as lw from line where regexp_matches(l, '[^ \t\n\v\f\r]')),
dup as (select r, count(*) - count(distinct l) as n from full_line group by r),
norm as (select r, host, text, regexp_replace(translate(array_to_string(lw, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g') as k, len(array_to_string(lw, '')) as c from full_line),
freq as (select host, k from (select host, k, count(distinct text) as n from norm group by all) join (select host, count(distinct text) as docs from d group by host) using (host) where n > {quality.MAX_DOCS} and n > {quality.MAX_SHARE} * docs),
gone as (select r, sum(c) as n from norm join freq using (host, k) group by r),
m as (select doc_id, len(w) as n_words, len(array_to_string(w, '')) as word_chars, len(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols, coalesce(dup.n, 0) as n_dup_lines, coalesce(rep.n, 0) as n_repeat_words, coalesce(gone.n, 0) as gone
  from d join w using (r) left join rep using (r) left join dup using (r) left join gone using (r)),
v as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from m)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words,
  base_failed, not base_failed and word_chars - gone >= {quality.MIN_LEFT} * word_chars as kept from v
"""

OP3 = f"""
with recursive v as (select vec_id, cast(embedding as double[]) as e from embeddings),
u as (select vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) as e from v),
links as (select a.vec_id as a, b.vec_id as b from u a join u b on a.vec_id <> b.vec_id where list_dot_product(a.e, b.e) >= {vectors.LIMIT}),
reach(a, b) as (select vec_id, vec_id from v union select reach.a, links.b from reach join links on reach.b = links.a),
n as (select a, count(*) as n from links group by a),
c as (select a, min(b) as c from reach group by a)
select vec_id, cast(coalesce(n.n, 0) as bigint) as n_links, c.c as component_id, vec_id = c.c as kept from v left join n on n.a = vec_id join c on c.a = vec_id
"""

OP5 = f"""
with recursive w as (select doc_id, {_WORDS.format(_LOWER)} as w from documents),
s as (select distinct doc_id, hash(w[i:i+4]) as h from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from w where len(w) >= 5)
  union all select doc_id, hash(w) from w where len(w) between 1 and 4),
n as (select doc_id, count(*) as n from s group by doc_id),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.h = b.h and a.doc_id <> b.doc_id group by all),
links as (select a, b from shared join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= {jaccard.THRESHOLD} * (x.n + y.n - c)),
reach(a, b) as (select doc_id, doc_id from w union select reach.a, links.b from reach join links on reach.b = links.a),
c as (select a, min(b) as c from reach group by a)
select w.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, c.c as component_id from w left join n using (doc_id) join c on c.a = w.doc_id
"""

_TRIM = "trim({}, ' ' || chr(9) || chr(11) || chr(12) || chr(13))"
OP10 = f"""
with d as (select row_number() over () as r, doc_id, coalesce(source, '') as host, text from documents),
l as (select distinct r, host, {_TRIM.format('l')} as l from (select r, host, unnest(string_split(text, chr(10))) as l from d)),
f as (select host, list(l) as drop_lines from (select host, l, count(*) as n from l where l <> '' group by all) join (select host, count(*) as pages from d group by host) using (host)
  where n >= {linefreq.MIN_PAGES} and n > {linefreq.MAX_RATIO} * pages group by host),
k as (select doc_id, string_split(text, chr(10)) as a, case when drop_lines is null then string_split(text, chr(10)) else list_filter(string_split(text, chr(10)), lambda x: not list_contains(drop_lines, {_TRIM.format('x')})) end as b from d left join f using (host))
select doc_id, cast(coalesce(len(a), 0) as bigint) as n_lines, cast(coalesce(len(a) - len(b), 0) as bigint) as n_dropped, cast(len(array_to_string(b, chr(10))) as bigint) as n_chars, array_to_string(b, chr(10)) as text from k
"""

OP11 = rf"""
with b as (select i, case when i % 2 = 1 then xor(i // 2, 3988292384) else i // 2 end as v1 from range(256) r(i)),
tab as (select list(v order by i) as t from (select i, list_reduce([v1, 0, 0, 0, 0, 0, 0, 0], lambda a, z: case when a % 2 = 1 then xor(a // 2, 3988292384) else a // 2 end) as v from b)),
d as (select row_number() over () as r, doc_id, {_LOWER} as text from documents),
w as (select r, regexp_extract_all(text, '[a-z0-9\x{{80}}-\x{{10FFFF}}]+') as w from d),
t as (select r, w as w1, lead(w, 1) over p as w2, lead(w, 2) over p as w3 from (select r, unnest(w) as w, unnest(range(len(w))) as i from w) window p as (partition by r order by i)),
f as (select r, x, count(*) as k from (select r, w1 as x from t union all select r, w1 || ' ' || w2 from t where w2 is not null union all select r, w1 || ' ' || w2 || ' ' || w3 from t where w3 is not null) group by r, x),
bw as (select row_number() over () as r, regexp_extract_all({_LOWER}, '[a-z0-9\x{{80}}-\x{{10FFFF}}]+') as w from benchmark),
bt as (select r, w as w1, lead(w, 1) over p as w2, lead(w, 2) over p as w3 from (select r, unnest(w) as w, unnest(range(len(w))) as i from bw) window p as (partition by r order by i)),
bf as (select x, count(*) as k from (select w1 as x from bt union all select w1 || ' ' || w2 from bt where w2 is not null union all select w1 || ' ' || w2 || ' ' || w3 from bt where w3 is not null) group by x),
u as (select x, hex(encode(x)) as h from (select x from f union select x from bf)),
c as (select x, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(h), 2), lambda i: cast('0x' || h[i:i + 1] as bigint))), lambda a, y: xor(a // 256, t[xor(a, y) % 256 + 1])), 4294967295) % {importance.BUCKETS} as bucket from u, tab),
s as (select bucket, sum(k) as s from f join c using (x) group by bucket),
tt as (select bucket, sum(k) as t from bf join c using (x) group by bucket),
g as (select i as bucket, cast(floor(1000 * ln((cast(coalesce(t, 0) as double) + 1) * (coalesce((select sum(s) from s), 0) + {importance.BUCKETS}) / ((cast(coalesce(s, 0) as double) + 1) * (coalesce((select sum(t) from tt), 0) + {importance.BUCKETS})))) as bigint) as gain from range({importance.BUCKETS}) r(i) left join s on s.bucket = i left join tt on tt.bucket = i),
wt as (select r, sum(k) as n_features, sum(k * gain) as weight from f join c using (x) join g using (bucket) group by r),
sc as (select d.doc_id, len(w.w) as n, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight, coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((cast('0x' || sha256('{importance.SALT}:' || coalesce(cast(doc_id as varchar), ''))[1:8] as bigint) + 0.5::double) / 4294967296::double))) as bigint) as score from d join w using (r) left join wt using (r)),
o as (select *, row_number() over (partition by n >= {importance.LEAST_WORDS} order by score desc, doc_id nulls first) as place, count(*) filter (where n >= {importance.LEAST_WORDS}) over () as can from sc)
select doc_id, cast(n_features as bigint) as n_features, cast(weight as bigint) as weight, cast(score as bigint) as score, case when n >= {importance.LEAST_WORDS} and place <= {importance.PERCENT} * can // 100 then place end as rank from o
"""

OP13 = f"""
with p as (select row_number() over () as p, lang, p as text from (select coalesce(lang, 'und') as lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\n\v\f\r]')) as p from documents)),
w as (select p, lang, unnest(ws) as w, unnest(range(len(ws))) as i from (select p, lang, regexp_extract_all(text, '[^ \t]+') as ws from p)),
t as (select lang, w as w1, lead(w, 1) over (partition by p order by i) as w2, lead(w, 2) over (partition by p order by i) as w3 from w),
f1 as (select lang, w1, count(*) as f from t group by all),
f2 as (select lang, w1, w2, count(*) as f from t where w2 is not null group by all having count(*) >= {collocations.LEAST}),
f3 as (select lang, w1, w2, w3, count(*) as f from t where w3 is not null group by all having count(*) >= {collocations.LEAST}),
long as (select lang, w1, w2, max(f) as f from (select lang, w1, w2, f from f3 union all select lang, w2, w3, f from f3) group by all),
cut as (select c.lang, c.w1 || ' ' || c.w2 as phrase, 1 as j, c.f as a, l.f as l, r.f as r from f2 c join f1 l on l.lang = c.lang and l.w1 = c.w1 join f1 r on r.lang = c.lang and r.w1 = c.w2 left join long g on g.lang = c.lang and g.w1 = c.w1 and g.w2 = c.w2 where g.f is null or 100 * g.f < {collocations.SHARE} * c.f
  union all select c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, 1, c.f, l.f, r.f from f3 c join f1 l on l.lang = c.lang and l.w1 = c.w1 join f2 r on r.lang = c.lang and r.w1 = c.w2 and r.w2 = c.w3
  union all select c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, 2, c.f, l.f, r.f from f3 c join f2 l on l.lang = c.lang and l.w1 = c.w1 and l.w2 = c.w2 join f1 r on r.lang = c.lang and r.w1 = c.w3),
sc as (select *, (1000000::hugeint * a * a) // (l::hugeint * r) as score from cut),
low as (select * from sc qualify row_number() over (partition by lang, phrase order by score, j) = 1),
n as (select lang, sum(f) as n from f1 group by lang),
o as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from low)
select lang, rank, phrase, cast(a as bigint) as a, cast(l as bigint) as l, cast(r as bigint) as r, cast(n as bigint) as n, cast(score as bigint) as score from o join n using (lang) where rank <= {collocations.TOP}
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": OP1, "op3_vector_dedup": OP3, "op5_ngram_jaccard": OP5, "op10_line_dedup": OP10, "op11_importance_resampling": OP11, "op13_collocations": OP13}
