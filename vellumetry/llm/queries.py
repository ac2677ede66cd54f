"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents
from .decontamination import leaks
from .licenses import PHRASES, TEMPLATES, license_scan, ordered, words_of
from .mixing import mixed
from .quality_crf import learn, scores
from .quality_rules import quality_rules
from .repeated_passages import without_repeats
from .sharding import sharded
from .simhash import near_duplicates
from .token_counts import token_counts
from .token_store import read_sums, write_store


def vocabulary(name: str) -> str:
    """A public tokenizer's file, where the machine has it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"), limit=4096)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"), "fit_chars")


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_sums(spark, write_store(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), end_id=2))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return scores(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("key")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(documents(spark, sf_dir), 40)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(documents(spark, sf_dir))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir)).drop("longest_repeat")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline at the repository's top, which counts as part of this subpackage."""
    return importlib.import_module("corpus_pipeline").run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_token_store, op3_quality, op4_decontamination, op5_sharding, op6_mixing, op7_repeated_passages, op8_simhash, op9_quality_rules, op10_license_scan, pipeline)}

MIX_SQL = r"""
with d as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
         md5(coalesce(cast(doc_id as varchar), 'text:' || coalesce(text, ''))) as h
  from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
r as (select *, row_number() over (order by source nulls last) as source_rank from s),
w as (select *, (source_rank - 1) % 3 + 1 as weight, source_size * 3 as cap, cast(sum(source_size) over () as bigint) as total from r),
l as (select *, total - coalesce(cast(sum(cap) over b as bigint), 0) as lft,
             cast(sum(weight) over () as bigint) - coalesce(cast(sum(weight) over b as bigint), 0) as lft_weight,
             row_number() over (order by cap / weight, source_rank) as o
      from w window b as (order by cap / weight, source_rank rows between unbounded preceding and 1 preceding)),
f as (select o, lft, lft_weight from l where cap * lft_weight >= lft * weight order by o limit 1),
t as (select l.source, l.source_size, l.source_rank, l.total,
             case when l.o >= f.o then cast(l.weight * f.lft as double) / f.lft_weight else cast(l.cap as double) end as target
      from l cross join f),
q as (select d.*, t.source_size, t.source_rank, t.total, t.target, row_number() over () as n,
             cast(sum(d.size) over (partition by t.source_rank order by h, doc_id, d.size rows unbounded preceding) as bigint) as upto
      from d join t on d.source is not distinct from t.source),
i as (select n, size, total, source_rank, k, upto + k * source_size as u, cast(upto + k * source_size as double) / target as vt
      from q cross join (select unnest([0, 1, 2]) as k) where size > 0 and target > 0),
c as (select n, size, sum(size) over (order by vt, source_rank, k, u rows unbounded preceding) <= total as fits from i),
g as (select n, cast(sum(size) as bigint) as taken from c where fits group by n)
select doc_id, size, source_size, target, coalesce(taken, 0) as taken from q left join g using (n)
"""

RULES_SQL = r"""
with d as (
  select row_number() over () as r, doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w
  from documents),
p as (select r, w, unnest(range(1, len(w) + 1)) as i from d),
g as (select r, i, array_to_string(w[i:i + 4], ' ') as s from p where i + 4 <= len(w)),
t as (select r, i from (select r, i, count(*) over (partition by r, s) as n from g) where n > 1),
c as (select r, cast(count(distinct i + k) as bigint) as n from t cross join (select unnest([0, 1, 2, 3, 4]) as k) group by r),
l as (select r, text, unnest(string_split(text, chr(10))) as line from d),
m as (select r, cast(count(*) - count(distinct line) as bigint) as n from l where regexp_matches(line, '[^\x20\x09-\x0D]') group by r),
h as (select distinct r from (select r, count(*) over (partition by r, array_to_string(w[i:i + 50], ' ')) as n from p where i + 50 <= len(w)) where n > 1),
o as (select d.doc_id, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
             cast(len(regexp_extract_all(text, '[#*$%&|<>]')) as bigint) as n_symbols, coalesce(m.n, 0) as n_dup_lines,
             coalesce(c.n, 0) as n_repeat_words, h.r is not null as long
      from d left join c using (r) left join m using (r) left join h using (r))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
       not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and not long as kept
from o
"""

LEAKS_SQL = r"""
with d as (
  select distinct doc_id, coalesce(text, '') as text from documents),
k as (select row_number() over () as r, doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') as w from d),
b as (
  select row_number() over () as i, item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') as w
  from (select distinct item_id, coalesce(text, '') as text from benchmark)),
pl as (select i, unnest(list_transform(range(1, len(w) - 3), lambda x: array_to_string(w[x:x + 4], ' '))) as h from b where len(w) >= 5),
wt as (select h, greatest(1, 4 - floor(log2(count(distinct i)))) as w from pl group by h),
sh as (select i, h, count(*) as n, first(w) as w from pl join wt using (h) group by i, h),
it as (select i, sum(n * w) as whole, cast(sum(n) as bigint) as size from sh group by i),
hs as (select r, len(w) - 4 as n, list_transform(range(1, len(w) - 3), lambda x: array_to_string(w[x:x + 4], ' ')) as hs from k where len(w) >= 5),
dp as (select r, n, unnest(range(0, n)) as p, unnest(hs) as h from hs),
-- windows as long as the item (or the text), at every place where they hold a shingle of it
wi as (select distinct r, i, least(dp.n, size) as l, unnest(range(greatest(0, p - least(dp.n, size) + 1), least(p, dp.n - least(dp.n, size)) + 1)) as start
       from dp join sh using (h) join it using (i)),
ct as (select r, i, start, h, count(*) as c from (select r, i, start, unnest(hs[start + 1:start + l]) as h from wi join hs using (r)) group by all),
sc as (select r, i, start, sum(coalesce(wt.w, 4) * least(c, coalesce(sh.n, 0))) as both_, sum(coalesce(wt.w, 4) * c) as own
       from ct left join wt using (h) left join sh using (i, h) group by r, i, start),
si as (select r, i, start, both_ / (own + whole - both_) as similarity from sc join it using (i) where both_ / (own + whole - both_) >= 0.8)
select doc_id, item_id, cast(arg_max(start, (similarity, -start)) as bigint) as start, round(max(similarity), 6) as similarity
from si join k using (r) join b using (i) group by r, i, doc_id, item_id
"""


def _license_sql() -> str:
    """The scan's definition, without its filters; templates and phrases as literals."""
    words, lists = "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'", lambda ws: "[" + ", ".join(f"'{w.decode()}'" for w in ws) + "]"
    templates = ", ".join(f"('{t.label}', '{t.block}', {t.need}, {lists(t.order)})" for t in ordered(TEMPLATES, {}))
    phrases = ", ".join(f"({lists(words_of(p))}, '{label}')" for p, label in PHRASES.items())
    return f"""
with d as (select row_number() over () as r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
w as (select r, regexp_extract_all(t, {words}) as w from d),
tp(label, kind, need, tw) as (values {templates}), ph(pw, label) as (values {phrases}),
hit as (select r, w, pw, label, unnest(range(1, len(w) + 1)) as i from w cross join ph where contains(' ' || array_to_string(w, ' ') || ' ', ' ' || array_to_string(pw, ' ') || ' ')),
pos as (select r, i - 1 as i, label from hit where w[i:i + len(pw) - 1] = pw),
b as (select r, count(*) as n_base, min(i) as first_word, max(i) as last_word from pos group by r),
blocks as (select r, 'line' as kind, unnest(string_split(t, chr(10))) as block from d union all select r, 'paragraph', unnest(regexp_split_to_array(t, '\\n(?:[ \\t\\r]*\\n)+')) from d),
met as (select r, label, len(list_intersect(list_distinct(regexp_extract_all(block, {words})), tw)) as n, need, len(tw) as m from blocks join tp using (kind)),
ok as (select r, label, n / m as share from met where n >= need),
every as (select r, label, 1.0 as share, true as base from pos union all select r, label, share, false from ok),
l as (select r, string_agg(distinct label, ',' order by label) filter (base) as base_labels, string_agg(distinct label, ',' order by label) as labels, max(share) as score from every group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels,
       cast(coalesce(score, 0) as double) as score
from d join w using (r) left join b using (r) left join l using (r)
"""


ORACLE_SQL = {"op10_license_scan": _license_sql(), "op4_decontamination": LEAKS_SQL, "op6_mixing": MIX_SQL, "op9_quality_rules": RULES_SQL}
