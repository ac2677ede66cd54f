"""DuckDB SQL with the rows of the catalogue's queries."""

from __future__ import annotations

PAGES = """
ep as (select event_type as model, user_id as doc_id, event_id as page_ordinal, cast(round(value * 100) as bigint) as v from events),
pg as (select model, doc_id, page_ordinal, v / 50000e0 as lpips, 1 - ((v * 7) % 50000) / 500000e0 as cosine from ep),
sp as (select *, case when lpips <= 0.11 and cosine >= 0.98 then 'OK' when lpips <= 0.22 and cosine >= 0.97 then 'Minor'
                      when lpips <= 0.75 and cosine >= 0.92 then 'Moderate' else 'Severe' end as class from pg)"""

STRIPPED = r"regexp_replace(regexp_replace(regexp_replace({0}, '<br\s*/?>', ' ', 'gi'), '</?(b|i|strong|em)>', '', 'gi'), '<[^>]+>', ' ', 'g')"
NORM = (
    r"trim(regexp_replace(regexp_replace(regexp_replace(lower("
    + STRIPPED
    + r"), '^\s*(?:[ivxlcdmіїхсвмдл]+|[0-9]+)\.?\s+', '', 'i'), '[^\p{{L}}\p{{N}}_\s]+', ' ', 'g'), '\s+', ' ', 'g'))"
)


def norm(column: str) -> str:
    return NORM.format(column)


SETS = f"""
dn as (select doc_id, {norm('text')} as n from documents), bn as (select item_id, {norm('text')} as n from benchmark),
ds as (select doc_id, n, list_distinct(list_filter(string_split(n, ' '), lambda t: t <> '')) as w, list_distinct(list_filter(string_split(n, ''), lambda t: t <> '')) as c from dn),
bs as (select item_id, n, list_distinct(list_filter(string_split(n, ' '), lambda t: t <> '')) as w, list_distinct(list_filter(string_split(n, ''), lambda t: t <> '')) as c from bn),
dm as (select *, list_filter(w, lambda t: length(t) >= 3) as m from ds), bm as (select *, list_filter(w, lambda t: length(t) >= 3) as m from bs),
pr as (select doc_id, item_id, len(dm.c) as dc, len(bm.c) as bc, len(dm.w) as dw, len(bm.w) as bw, len(dm.m) as dl, len(bm.m) as bl,
              len(list_intersect(dm.w, bm.w)) as iw, len(list_intersect(dm.c, bm.c)) as ic, len(list_intersect(dm.m, bm.m)) as shared from dm cross join bm),
cd as (select doc_id, item_id, shared,
              case when dc = 0 and bc = 0 then 1.0 when dc = 0 or bc = 0 then 0.0
                   else round(0.5 * (iw / (dw + bw - iw)) + 0.5 * (ic / (dc + bc - ic)), 4) end as sim,
              case when dl + bl = 0 then 1.0 else shared / (dl + bl - shared) end as tj from pr),
ok as (select * from cd where sim >= 0.6 or tj >= 0.5 or shared >= 2)"""

#: Matched against the cells of the number query.
CELL = """case c_custkey % 6 when 0 then '( ' || replace(printf('%.2f', abs(c_acctbal)), '.', ',') || ' )' when 1 then '-' || printf('%.2f', abs(c_acctbal))
  when 2 then printf('%.2f', abs(c_acctbal)) || ' USD' when 3 then '—' when 4 then '<b>' || printf('%.2f', abs(c_acctbal)) || '</b>' else ' ' || c_custkey end"""

REL = "(case when {0} is null and {1} is null then 0.0 when {0} is not null and {1} is not null then abs({0}::double - {1}::double) / greatest(abs({0}::double), abs({1}::double), 1e-12) end)"
SIM = f"(case when {REL} is not null then 1 - least(1.0, {REL}) end)"
#: Rounds what a double prints as, half up.
ROUND = "cast(round(cast(cast({0} as varchar) as decimal(30, 17)), 4) as double)"


def greedy(name: str, edges: str) -> str:
    """The matching by score, then left, then right, of edges (grp, l, r, lo, ro, s): round by round, edges that are first for both their ends."""
    return f"""{name}_e as ({edges}),
{name}_g as (
  select *, false as taken from {name}_e
  union all
  select grp, l, r, lo, ro, s, hit from (
    select *, bool_or(hit) over (partition by grp, l) as l_gone, bool_or(hit) over (partition by grp, r) as r_gone from (
      select *, row_number() over (partition by grp, l order by s desc, lo, ro) = 1 and row_number() over (partition by grp, r order by s desc, lo, ro) = 1 as hit
      from {name}_g where not taken))
  where hit or not (l_gone or r_gone)),
{name} as (select grp, l, r, s from {name}_g where taken)"""


def choose(name: str, choosers: str, edges: str) -> str:
    """choosers (grp, l, lo) in order take the best edge (grp, l, r, ro, s) to one that is still free, the first of equals."""
    best = "arg_max(e.r, (e.s, -e.ro))"
    return f"""{name}_c as (select grp, l, row_number() over (partition by grp order by lo) as k from ({choosers})),
{name}_e as ({edges}),
{name}_t as (
  select grp, cast(0 as bigint) as k, cast([] as varchar[]) as used, cast(null as varchar) as l, cast(null as varchar) as r, cast(null as double) as s from (select distinct grp from {name}_c)
  union all
  select t.grp, c.k, case when max(e.s) is null then t.used else list_append(t.used, {best}) end, c.l, {best}, max(e.s)
  from {name}_t t join {name}_c c on c.grp = t.grp and c.k = t.k + 1 left join {name}_e e on e.grp = t.grp and e.l = c.l and not list_contains(t.used, e.r)
  group by t.grp, c.k, t.used, c.l),
{name} as (select grp, l, r, s from {name}_t where r is not null)"""


#: The rows of both versions as they are read: coded ones, the richest of each code, and those without code.
VERSIONS = """
p as (select p_brand || '/' || (p_partkey % 400) as pair_id, p_partkey as k, p_name, cast(round(p_retailprice) as bigint) as price from part),
g as (select pair_id, k, p_name as label, case when k % 5 <> 0 then cast(1000 + k % 9000 as varchar) else cast(price as varchar) end as code, case when k % 5 <> 0 then price end as start from p),
r as (select pair_id, k, case when k % 4 = 0 then p_name || ' total' when k % 9 = 0 then '' else upper(p_name) end as label,
             case when k % 5 = 0 then case when k % 6 <> 0 then cast(price as varchar) end when k % 7 = 0 then cast(1001 + k % 8999 as varchar) else cast(1000 + k % 9000 as varchar) end as code,
             case when k % 6 = 0 then -(price * 10 + 5) when k % 5 <> 0 then price end as start from p),
gd as (select *, row_number() over (partition by pair_id, code order by (start is not null)::int desc, k) as n from g),
rd as (select *, row_number() over (partition by pair_id, code order by (start is not null)::int desc, k) as n from r where code is not null)"""


def _compared() -> str:
    coded = lambda n, side: f"select pair_id, '{side}' as side, code, 'c' || code as ref, label, start, row_number() over (partition by pair_id order by length(code), code) as o from {n} where n = 1"
    head = lambda side: f"select distinct pair_id, '{side}', cast(null as varchar), 'n0', 'Name', cast(null as bigint), cast(0 as bigint) from p"
    union = lambda x, y: f"len(list_distinct(list_concat({x}, {y})))"
    left = lambda side, kind, *gone: f"select pair_id as grp, ref as l, o as lo from ev where side = '{side}' and code is {kind}" + "".join(f" and (pair_id, ref) not in (select grp, {c} from {t})" for t, c in gone)
    edge = lambda l, r, rule: f"select grp, {l} as l, {r} as r, {r[0]}o as ro, sim as s from ed where {rule}"
    like, near = "(sim >= 0.8 or agree)", "(sim >= 0.6 or agree)"
    free = lambda c, *gone: "".join(f" and (grp, {c}) not in (select grp, {k} from {t})" for t, k in gone)
    return f"""with recursive {VERSIONS},
ev0 as ({coded('gd', 'gt')} union all {coded('rd', 'res')} union all {head('gt')} union all {head('res')}
  union all select pair_id, 'res', null, 'n' || row_number() over (partition by pair_id order by k), label, start, row_number() over (partition by pair_id order by k) from r where code is null and {norm('label')} <> ''),
ev as (select *, list_distinct(list_filter(string_split(n, ' '), lambda t: t <> '')) as w, list_distinct(list_filter(string_split(n, ''), lambda t: t <> '')) as c from (select *, {norm('label')} as n from ev0)),
em as (select *, list_filter(w, lambda t: length(t) >= 3) as m from ev),
ed as (
  select a.pair_id as grp, a.ref as a, b.ref as b, a.o as ao, b.o as bo, a.code as ac, b.code as bc,
         case when len(a.c) = 0 and len(b.c) = 0 then 1.0 when len(a.c) = 0 or len(b.c) = 0 then 0.0
              else round(0.5 * (len(list_intersect(a.w, b.w)) / {union('a.w', 'b.w')}) + 0.5 * (len(list_intersect(a.c, b.c)) / {union('a.c', 'b.c')}), 4) end::double as sim,
         len(list_intersect(a.m, b.m)) >= 2 or len(a.m) + len(b.m) = 0 or len(list_intersect(a.m, b.m)) >= 0.5 * {union('a.m', 'b.m')} as agree
  from em a join em b on a.pair_id = b.pair_id and a.side = 'gt' and b.side = 'res'),
s1 as (select grp, a as l, b as r, sim as s from ed where ac = bc),
{choose('s2', left('gt', 'not null', ('s1', 'l')), edge('a', 'b', "ac is not null and bc is not null and sim >= 0.8" + free('b', ('s1', 'r'))))},
{choose('s3', left('gt', 'not null', ('s1', 'l'), ('s2', 'l')), edge('a', 'b', f"ac is not null and bc is null and {like}"))},
{choose('s4', left('res', 'not null', ('s1', 'r'), ('s2', 'r')), edge('b', 'a', f"ac is null and bc is not null and {like}"))},
{greedy('s5', f"select grp, a as l, b as r, ao as lo, bo as ro, sim as s from ed where ac is null and bc is null and {near}")},
li as (select 1 as stage, grp, l as a, r as b, s from s1 union all select 2, grp, l, r, s from s2 union all select 3, grp, l, r, s from s3
       union all select 4, grp, r, l, s from s4 union all select 5, grp, l, r, s from s5),
ma as (
  select stage, grp as pair_id, s, x.ref as a, y.ref as b, x.label as gl, y.label as rl, x.code as gc, y.code as rc, x.start as gs, y.start as rs
  from li join ev x on x.pair_id = grp and x.side = 'gt' and x.ref = li.a join ev y on y.pair_id = grp and y.side = 'res' and y.ref = li.b
  union all select 6, pair_id, null, ref, null, label, null, code, null, start, null from ev where side = 'gt' and (pair_id, ref) not in (select grp, a from li)
  union all select 6, pair_id, null, null, ref, null, label, null, code, null, start from ev where side = 'res' and (pair_id, ref) not in (select grp, b from li)),
nu as (
  select *, case when stage = 6 then null when stage = 1 and gs is null and rs is null then 1.0 when gs is not null and rs is not null then round((1 + {SIM.format('gs', 'rs')}) / 2, 4)
                 when gs is not null or rs is not null then 0.0 when gc is null and rc is null then 1.0 when gc is not null and rc is not null then null else 0.0 end::double as num from ma),
cv as (
  select pair_id, cast(stage as bigint) as stage, coalesce(gl, '') as gt_label, coalesce(rl, '') as res_label, case when a is null then '' else concat_ws(' ', gc, gs) end as gt_numbers,
         case when b is null then '' else concat_ws(' ', rc, rs) end as res_numbers, s as label_sim, num as num_sim,
         case when stage < 6 then {ROUND.format('case when num is null then s else (s + num) / 2 end')} end as overall_sim,
         case when stage < 6 then round(100 * {REL.format('gs', 'rs')}, 4) end as "start_rel_diff_%", case when stage < 6 then 0.0::double end as "end_rel_diff_%" from nu)"""


def pivot(expr: str) -> str:
    return ", ".join(expr.format(m) for m in ("click", "error", "purchase", "signup", "view"))


ORACLES = {
    "strip_html_pages": f"select page_id, {STRIPPED.format('html')} as plain from pages",
    "html_link_extract": "with l as (select page_id, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) as h from pages) select page_id, cast(unnest(range(0, len(h))) as integer) as place, unnest(h) as href from l",
    "html_summary_scan": f"with {PAGES}, n as (select model, count(*) as n, count(*) filter (class = 'OK') as ok from sp group by model) select model, 'Total pages checked' as key, n as value from n union all select model, 'OK', ok from n",
    "html_report_pages": f"""with {PAGES}, r as (select *, row_number() over (partition by model, doc_id order by page_ordinal) as place from sp)
        select model, doc_id, page_ordinal as page, place, {ROUND.format('cosine')} as cosine, {ROUND.format('lpips')} as lpips, class as issue, doc_id || '|p' || place as page_key from r""",
    "html_flat_classes": f"with {PAGES} select model, class, 2 * count(*) as n from sp group by model, class",
    "key_value_scan": """select c_custkey, 1::bigint as line_no, 'Name' as key, c_name as value from customer union all select c_custkey, 3, 'Segment', c_mktsegment from customer
        union all select c_custkey, 5, 'URL', 'http://x:' || c_nationkey from customer""",
    "normalize_documents": f"select doc_id, {norm('text')} as norm from documents",
    "normalize_documents_unicode": f"select doc_id, {norm("replace(text, 'ß', 'ss')")} as norm from documents",
    "page_files_read_back": "select printf('conversation-%d/page_%04d.yaml', conv_id, turn) as file, text from conversations",
    "csv_reads_back": "select n_nationkey, n_name, n_regionkey from nation",
    "layout_json_read_back": "select p_partkey, p_size::bigint as page_index, 'images/' || p_brand || '.png' as image_path, p_name as text, 1::bigint as n_blocks from part",
    "meaningful_tokens": f"with {SETS} select doc_id, len(m) as n_meaningful, len(w) as n_tokens from dm",
    "char_set_size": f"with {SETS} select doc_id, len(c) as n_chars_distinct from dm",
    "label_similarity_candidates": f"with {SETS} select doc_id, item_id, sim, round(tj, 4) as tj, shared from ok",
    "best_match_per_document": f"with {SETS} select doc_id, arg_max(item_id, (sim, -item_id)) as item_id, max(sim) as sim from ok group by doc_id",
    "parse_number_cells": f"""with c as (select c_custkey, {CELL} as cell from customer), s as (select *, trim(regexp_replace(cell, '<[^>]+>', '', 'g')) as t from c)
        select c_custkey, cell, case when t = '—' or regexp_matches(t, '[A-Za-z]') then null when t like '(%)' then -cast(regexp_replace(t, '[^0-9]', '', 'g') as bigint)
          else try_cast(regexp_replace(t, '[^0-9]', '', 'g') as bigint) end as number, regexp_full_match(t, '[0-9]{{3,4}}') as is_code, regexp_matches(cell, '[A-Za-z]') as has_letters from s""",
    "line_islands": r"""with l as (select doc_id, unnest(range(0, len(string_split(text, chr(10))))) as line_no, unnest(string_split(text, chr(10))) as line from documents),
        m as (select *, line like '%.' as hit from l), i as (select *, sum(case when hit then 0 else 1 end) over (partition by doc_id order by line_no) as island from m)
        select doc_id, min(line_no) as first_line, count(*) as n from i where hit group by doc_id, island""",
    "pipe_table_rows": r"""with l as (select doc_id, unnest(range(0, len(string_split(text, chr(10))))) as line_no, unnest(string_split(text, chr(10))) as line from documents where contains(text, '|')),
        p as (select *, line_no - row_number() over (partition by doc_id order by line_no) as island from l where contains(line, '|')),
        n as (select *, count(*) over (partition by doc_id, island) as n, list_transform(string_split(line, '|'), lambda c: trim(c, ' ' || chr(9) || chr(13))) as cells from p),
        k as (select *, dense_rank() over (partition by doc_id order by island) - 1 as table_no, row_number() over (partition by doc_id, island order by line_no) - 1 as row_no from n where n >= 2)
        select doc_id, table_no, row_no, len(cells) as n_cells, cells[1] as first_cell, len(list_filter(cells, lambda c: c <> '')) = 0 as blank from k""",
    "reconcile_order_totals": f"""with o as (select o_orderkey as code, cast(round(o_totalprice * 100) as bigint) as gs, case when o_orderstatus = 'F' then 1 end as ge from orders),
        l as (select l_orderkey as code, cast(sum(cast(round(l_extendedprice * 100) as bigint)) as bigint) as rs, count(*) as re from lineitem group by 1),
        b as (select coalesce(o.code, l.code) as code, o.code as g, l.code as r, gs, ge, rs, re from o full join l on o.code = l.code),
        s as (select *, {SIM.format('gs', 'rs')} as a, {SIM.format('ge', 're')} as e from b),
        t as (select *, case when g is not null and r is not null then round(case when a is null then e when e is null then a else (a + e) / 2 end, 4) else 0.0 end as num_sim from s)
        select code, num_sim, round(100 * {REL.format('gs', 'rs')}, 4) as start_diff, round(100 * {REL.format('ge', 're')}, 4) as end_diff, {ROUND.format('(1.0::double + num_sim) / 2')} as overall,
               concat_ws(' ', g, gs, ge) as gt_numbers from t""",
    "reconcile_one_sided": """select c_custkey as code, 'gt' as side from customer where c_custkey not in (select o_custkey from orders) union all
        select distinct o_custkey, 'res' from orders where o_custkey not in (select c_custkey from customer)""",
    "code_dedupe_richest": """with r as (select l_linestatus as pair_id, cast(l_partkey as varchar) as code, l_orderkey * 10 + l_linenumber as ordinal, max(l_returnflag) as label,
          max(case when l_quantity > 25 then cast(l_quantity as bigint) end) as start, max(case when l_tax > 0.04 then l_suppkey end) as "end" from lineitem group by all),
        k as (select *, row_number() over (partition by pair_id, code order by (start is not null)::int + ("end" is not null)::int desc, ordinal) as n from r)
        select pair_id, code, ordinal, label, start, "end" from k where n = 1""",
    "issue_level_summary": """with h as (select label, arg_min(embedding, vec_id) as head from embeddings group by label),
        p as (select e.label, vec_id, round(0.9 + list_cosine_similarity(e.embedding::double[], h.head::double[]) / 10, 4) as c, (vec_id * 37 % 100) / 100e0 as l from embeddings e join h using (label)),
        s as (select label, vec_id, case when vec_id % 50 = 0 then 'X' when c >= 0.9991 or (c >= 0.98 and l <= 0.13) then 'O' when c >= 0.98 or (c >= 0.97 and l <= 0.75) then 'M'
              when c >= 0.92 then 'D' else 'S' end as k from p)
        select label, count(distinct vec_id) as documents, count(*) filter (k <> 'X') as pages, count(*) filter (k = 'O') as ok, count(*) filter (k = 'M') as minor,
               count(*) filter (k = 'D') as moderate, count(*) filter (k = 'S') as severe, count(distinct vec_id) filter (k = 'X') as mismatch_docs from s group by label""",
    "page_positional_join": """with s as (select conv_id, role, text, row_number() over (partition by conv_id, role order by turn, text) as page, count(*) over (partition by conv_id, role) as n
          from conversations where role in ('user', 'assistant')),
        c as (select conv_id, count(*) filter (role = 'user') as un, count(*) filter (role = 'assistant') as an from conversations where role in ('user', 'assistant') group by conv_id)
        select u.conv_id, cast(u.page as integer) as page, length(u.text) as n_expected, length(a.text) as n_actual, false as mismatch
        from s u join s a on u.conv_id = a.conv_id and u.page = a.page and u.role = 'user' and a.role = 'assistant' join c on c.conv_id = u.conv_id where un = an
        union all select conv_id, null, null, null, true from c where un <> an""",
    "doc_pair_topk": "select printf('doc_%06d', doc_id) as base, printf('doc_%06d.pdf', doc_id) as expected, printf('doc_%06d.docx', doc_id) as actual from documents join labels using (doc_id) order by 2 limit 115",
    "page_selection": """select p_partkey, array_to_string(case when p_partkey % 5 = 0 then range(1, 21)
        else list_sort(list_filter(list_distinct(list_concat(range(p_size, p_size + 4), [p_partkey % 7])), lambda x: x between 1 and 20)) end, ' ') as pages from part""",
    "cosine_pairs": "select a.vec_id as a, b.vec_id as b, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 4) + 0.0::double as cosine from embeddings a join embeddings b on a.label = b.label and a.vec_id < b.vec_id",
    "class_share_by_doc": f"""with {PAGES} select doc_id, round(count(*) filter (class = 'OK') / count(*), 4) as ok, round(count(*) filter (class = 'Minor') / count(*), 4) as minor,
        round(count(*) filter (class = 'Moderate') / count(*), 4) as moderate, round(count(*) filter (class = 'Severe') / count(*), 4) as severe from sp group by doc_id""",
    "class_counts_by_model": f"""with {PAGES}, c as (select model, case when lpips <= 0.11 and cosine >= 0.99 then 'OK' when lpips <= 0.22 then 'Minor' when lpips <= 0.4 then 'Moderate' else 'Severe' end as class from pg),
        k as (select unnest(['OK', 'Minor', 'Moderate', 'Severe']) as class), m as (select distinct model from pg)
        select m.model, k.class, count(c.class) as n from m cross join k left join c on c.model = m.model and c.class = k.class group by 1, 2""",
    "class_share_total": f"with {PAGES} select model, doc_id, 1.0::double as total from sp group by 1, 2",
    "mean_score_pivot": f"with {PAGES} select doc_id, {pivot(chr(39).join(['round(avg(lpips) filter (model = ', '{0}', '), 9) as model_{0}']))} from pg group by doc_id",
    "first_issue_pivot": f"with {PAGES} select doc_id, {pivot(chr(39).join(['arg_min(class, page_ordinal) filter (model = ', '{0}', ') as model_{0}']))} from sp group by doc_id",
    "dominant_class": f"""with {PAGES}, c as (select model, doc_id, class, count(*) as n, min(page_ordinal) as f from sp group by all), k as (select *, row_number() over (partition by model, doc_id order by n desc, f) as place from c)
        select model, doc_id, class as dominant, n as pages, case class when 'OK' then 0 when 'Minor' then 1 when 'Moderate' then 2 else 3 end::bigint as dominant_ord from k where place = 1""",
    "worst_class_summary": f"""with {PAGES}, g as (select doc_id, round(avg(cosine), 4) as mean_cosine, round(avg(lpips), 4) as mean_lpips, count(*) as pages,
          max(case class when 'OK' then 0 when 'Minor' then 1 when 'Moderate' then 2 else 3 end) as w from sp group by doc_id)
        select doc_id, mean_cosine, mean_lpips, pages, ['OK', 'Minor', 'Moderate', 'Severe'][w + 1] as worst, round(pages / sum(pages) over (), 4) as share from g""",
    "class_summary": """with d as (select n_chars, quality, case when toxic = 1 then 'Severe' when quality = 1 then 'OK' when doc_id % 2 = 0 then 'Minor' end as class from documents join labels using (doc_id))
        select class, count(*) as n, round(avg(n_chars), 4) as mean_cosine, round(avg(quality), 4) as mean_lpips from d where class is not null group by class""",
    "boxplot_stats": f"""with {PAGES}, q as (select doc_id, quantile_cont(lpips, 0.25) as q1, quantile_cont(lpips, 0.5) as median, quantile_cont(lpips, 0.75) as q3 from pg group by doc_id),
        i as (select pg.doc_id, lpips, q1, median, q3, lpips >= q1 - 1.5 * (q3 - q1) and lpips <= q3 + 1.5 * (q3 - q1) as inside from pg join q using (doc_id))
        select doc_id, round(q1, 9) as q1, round(median, 9) as median, round(q3, 9) as q3, round(min(lpips) filter (inside), 9) as low, round(max(lpips) filter (inside), 9) as high,
               count(*) filter (not inside) as fliers, count(*) as n from i group by doc_id, i.q1, i.median, i.q3""",
    "histogram_20": f"""with {PAGES}, e as (select min(lpips) as lo, max(lpips) as hi, count(*) as t from pg), w as (select *, (hi - lo) / 20 as w from e),
        b as (select least(19, cast(floor((lpips - lo) / w) as integer)) as bin, count(*) as n from pg cross join w group by 1), k as (select cast(unnest(range(0, 20)) as integer) as bin)
        select k.bin, coalesce(n, 0) as n, round(coalesce(n / (t * w), 0.0), 4) as density from k left join b using (bin) cross join w""",
    "kde_grid": f"""with {PAGES}, s as (select model, min(lpips) as lo, max(lpips) as hi, count(*) as m, stddev_samp(lpips) * pow(count(*), -0.2) as h from pg group by model),
        g as (select s.*, p as point, lo + (hi - lo) * p / 49 as x from s cross join (select cast(unnest(range(0, 50)) as integer) as p))
        select g.model, point, round(x, 4) as x, round(sum(exp(-pow((x - lpips) / h, 2) / 2)) / (m * h * 2.5066282746310002), 6) as density from g join pg using (model) group by g.model, point, x, m, h""",
    "union_dedupe_reports": f"""with {PAGES} select model, doc_id, min(page_ordinal) as page_ordinal, arg_min(class, page_ordinal) as class from sp group by 1, 2 union all select model, doc_id, page_ordinal, class from sp where model = 'view'""",
    "md_assemble_conversation": "select conv_id, count(*) as pages, md5(string_agg('# Page ' || turn || chr(10) || coalesce(text, '') || chr(10), chr(10) order by turn)) as md5 from conversations group by conv_id",
    "cell_grid_markdown": """select p_partkey, 1::bigint as table_no, '| --- | --- |' || chr(10) || '|' || case when p_partkey % 3 = 0 then '' else trim(p_name) end || '|' || case when p_partkey % 3 = 1 then '' else p_brand || ' x' end || '|'
        || chr(10) || '|' || case when p_partkey % 3 = 2 then '' else trim(p_type) end || '||' as markdown from part""",
    "scaled_boxes": "select p_partkey, concat_ws(' ', cast(trunc(p_retailprice * 300 / 72) as bigint), cast(trunc(p_size * 300 / 72) as bigint), cast(trunc(-p_retailprice * 300 / 72) as bigint), 2) as box from part",
    "page_numbers": "select page_id, coalesce(try_cast(nullif(regexp_extract(regexp_extract(url, '[^/]*$'), '[0-9]+'), '') as bigint), -1) as page from pages",
    "pair_tags": "select n_nationkey, substr(md5(n_name || '.md||' || r_name || '.md'), 1, 8) as tag, n_name as stem from nation join region on n_regionkey = r_regionkey",
    "perf_summary": "select count(distinct user_id) as documents, round(avg(cast(round(value * 100) as bigint)), 2) as avg_cpu, round(avg(event_id), 2) as avg_ram_mb from events",
    "same_code_rows": """with p as (select p_brand || '/' || (p_partkey % 400) as pair_id, p_partkey as k, p_name, cast(round(p_retailprice) as bigint) as price from part),
        g as (select pair_id, k, p_name as label, case when k % 5 <> 0 then cast(1000 + k % 9000 as varchar) else cast(price as varchar) end as code, case when k % 5 <> 0 then price end as start from p),
        r as (select pair_id, k, case when k % 4 = 0 then p_name || ' total' when k % 9 = 0 then '' else upper(p_name) end as label,
                     case when k % 5 = 0 then case when k % 6 <> 0 then cast(price as varchar) end when k % 7 = 0 then cast(1001 + k % 8999 as varchar) else cast(1000 + k % 9000 as varchar) end as code,
                     case when k % 6 = 0 then -(price * 10 + 5) when k % 5 <> 0 then price end as start from p),
        gd as (select *, row_number() over (partition by pair_id, code order by (start is not null)::int desc, k) as n from g),
        rd as (select *, row_number() over (partition by pair_id, code order by (start is not null)::int desc, k) as n from r where code is not null)
        select gd.pair_id, gd.code, gd.label as gt_label, rd.label as res_label, gd.start as gt_start, rd.start as res_start,
               case when gd.start is null or rd.start is null then 1.0 else round((2 - least(1.0, abs(gd.start - rd.start)::double / greatest(abs(gd.start), abs(rd.start)))) / 2, 4) end as num_sim
        from gd join rd using (pair_id, code) where gd.n = 1 and rd.n = 1""",
    "greedy_label_match": f"with recursive {SETS}, {greedy('m', 'select 0 as grp, doc_id as l, item_id as r, doc_id as lo, item_id as ro, cast(sim as double) as s from ok')} select l as doc_id, r as item_id, s as sim from m",
    "compare_versions": f"{_compared()} select * from cv",
    "index_row": f"""{_compared()} select pair_id, {', '.join(f"{ROUND.format(f'avg({c})')} as {n}" for c, n in (('overall_sim', 'avg_over'), ('label_sim', 'avg_label'), ('num_sim', 'avg_num')))}, count(*) as rows_total,
        count(*) filter (gt_label <> '' and res_label <> '') as paired_rows, count(*) filter (gt_label <> '' and res_label = '') as gt_only_rows, count(*) filter (gt_label = '' and res_label <> '') as res_only_rows
        from cv group by pair_id""",
}
