"""The query catalogue over the test tables: each operator applied to a whole table.

Page scores come from events: the model is the event type, the document the user, the scores are made of the
value in whole hundredths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import quality as Q
from ..functions import similarity as S
from ..functions import text as T
from ..operators import analytics as A
from ..operators import grids as G
from ..operators import matching as M
from ..operators import pages as P
from ..operators import tables as B
from ..operators import vectors as V
from ..sources import files, reports, sinks
from .comparison import compare_documents
from .lineage import shared_path

MODELS = ["click", "error", "purchase", "signup", "view"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scored_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    v = F.round(F.col("value") * 100).cast("long")
    e = e.select(F.col("event_type").alias("model"), F.col("user_id").alias("doc_id"), F.col("event_id").alias("page_ordinal"), (v / F.lit(50000.0)).alias("lpips"), (1 - ((v * 7) % 50000) / F.lit(500000.0)).alias("cosine"))
    return e.withColumn("class", Q.strict_class(F.col("cosine"), F.col("lpips")))


def strip_html_pages(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", T.strip_html(F.col("html")).alias("plain"))


def html_link_extract(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("place", "href"))


def html_summary_scan(spark, d):
    n = scored_pages(spark, d).groupBy("model").agg(F.count("*").alias("n"), F.count_if(F.col("class") == "OK").alias("ok"))
    item = lambda k, v: F.concat(F.lit(f"<li><b>{k}:</b> "), v.cast("string"), F.lit(" ✅</li>"))
    text = F.concat(F.lit("<h1>Summary</h1>\n<ul class='x'>"), item("Total pages checked", F.col("n")), item("OK", F.col("ok")), F.lit("<li>no number: none</li></ul><ul><li>Other: 3</li></ul>"))
    return n.select("model", F.explode(reports.summary_block(text)).alias("key", "value")).select("model", "key", F.col("value").cast("long").alias("value"))


#: Reports of a model: documents are dealt to so many, so that none holds a whole model.
REPORTS = 64


def printed_report(pages: DataFrame) -> DataFrame:
    """model, slice, text: reports with their body twice, as they come."""
    cell = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    row = F.concat(F.lit("<tr>"), cell(F.col("page_ordinal").cast("string")), cell(F.format_string("%.4f", "cosine")), cell(F.format_string("%.4f", "lpips")), cell(F.concat("class", F.lit(" 🟡"))), F.lit("</tr>"))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_ordinal", row.alias("r")))), lambda x: x["r"]), "\n")
    docs = pages.groupBy("model", "doc_id").agg(rows.alias("rows"))
    body = lambda b, e: F.concat(F.lit(f"<h2>Document: {b}"), F.col("doc_id").cast("string"), F.lit(f"{e}</h2><table><tr><th>Page</th></tr>"), "rows", F.lit("</table>"))
    whole = docs.groupBy("model", F.pmod(F.xxhash64("doc_id"), F.lit(REPORTS)).cast("int").alias("slice")).agg(F.array_join(F.sort_array(F.collect_list(body("", ""))), "").alias("one"), F.array_join(F.sort_array(F.collect_list(body("<b>", "</b>"))), "").alias("two"))
    return whole.select("model", "slice", F.concat(F.lit("<html><body>"), "one", F.lit("</body></html>"), "two", F.lit("</body></html>")).alias("text"))


def html_report_pages(spark, d):
    found = reports.report_pages(printed_report(scored_pages(spark, d)), ["model", "slice"]).filter("copy_no = 1")
    return found.select("model", F.col("doc_id").cast("long").alias("doc_id"), F.col("page").cast("long").alias("page"), F.col("page_ordinal").cast("long").alias("place"), F.round("cosine", 4).alias("cosine"), F.round("lpips", 4).alias("lpips"), "issue", reports.page_key(F.col("doc_id"), F.col("page_ordinal")).alias("page_key"))


def html_flat_classes(spark, d):
    return reports.flat_classes(printed_report(scored_pages(spark, d)), ["model"]).groupBy("model", "class").agg(F.count("*").alias("n"))


def key_value_scan(spark, d):
    c = table(spark, d, "customer")
    text = F.concat(F.lit("=====\n Name : "), "c_name", F.lit("\n\nSegment:"), "c_mktsegment", F.lit("\nno value\nURL: http://x:"), F.col("c_nationkey").cast("string"))
    return files.key_values(c.select("c_custkey", text.alias("text"))).select("c_custkey", F.col("line_no").cast("long").alias("line_no"), "key", "value")


def normalize_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", T.normalize(F.col("text"), unicode=False).alias("norm"))


def normalize_documents_unicode(spark, d):
    return table(spark, d, "documents").select("doc_id", T.normalize(F.col("text")).alias("norm"))


def page_files_read_back(spark, d):
    """Every turn of the conversations written as a page file, found by a scan and decoded."""
    turns = table(spark, d, "conversations").select(F.concat(F.lit("conversation-"), F.col("conv_id").cast("string")).alias("doc_id"), F.col("turn").alias("page"), "text")
    folder = shared_path(spark, "pages")
    sinks.page_files(turns, folder)
    found = files.text_files(spark, folder, "*.yaml", recursive=True)
    return found.select(F.regexp_extract("path", "[^/]*/[^/]*$", 0).alias("file"), "text")


def csv_reads_back(spark, d):
    folder = shared_path(spark, "csv")
    nations = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    sinks.write_csv(nations, folder)
    return spark.read.option("header", True).schema(nations.schema).csv(folder)


def layout_json_read_back(spark, d):
    p = table(spark, d, "part")
    blocks = F.array(F.struct(F.lit("Text").alias("type"), F.array(F.lit(0), F.col("p_size")).alias("bbox"), F.col("p_name").alias("text")))
    json = p.select("p_partkey", sinks.layout_json(F.col("p_size").cast("long"), F.concat(F.lit("images/"), "p_brand", F.lit(".png")), F.col("p_name"), blocks).alias("j"))
    read = F.from_json("j", "page_index long, image_path string, text string, blocks array<struct<type: string, bbox: array<int>, text: string>>").alias("r")
    return json.select("p_partkey", read).select("p_partkey", "r.page_index", "r.image_path", "r.text", F.size("r.blocks").cast("long").alias("n_blocks"))


def meaningful_tokens(spark, d):
    docs = table(spark, d, "documents").withColumn("words", T.tokens(T.normalize(F.col("text"), unicode=False)))  # made once a row
    return docs.select("doc_id", F.size(T.meaningful(F.col("words"))).cast("long").alias("n_meaningful"), F.size("words").cast("long").alias("n_tokens"))


def char_set_size(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(T.characters(T.normalize(F.col("text"), unicode=False))).cast("long").alias("n_chars_distinct"))


def _candidates(spark, d):
    docs = M.with_sets(table(spark, d, "documents").select("doc_id", "text"), "text", unicode=False)
    items = M.with_sets(table(spark, d, "benchmark").select("item_id", "text"), "text", unicode=False)
    return M.label_candidates(docs, items, "doc_id", "item_id")


def label_similarity_candidates(spark, d):
    return _candidates(spark, d).select("doc_id", "item_id", "sim", F.round("tj", 4).alias("tj"), F.col("shared").cast("long").alias("shared"))


def best_match_per_document(spark, d):
    best = F.max_by(F.struct("item_id", "sim"), F.struct("sim", (-F.col("item_id")).alias("early"))).alias("b")
    return _candidates(spark, d).groupBy("doc_id").agg(best).select("doc_id", F.col("b.item_id").alias("item_id"), F.col("b.sim").alias("sim"))


def greedy_label_match(spark, d):
    return M.mutual_best(_candidates(spark, d), "doc_id", "item_id", "sim")


def _number_cells(spark, d):
    c = table(spark, d, "customer")
    x = F.format_string("%.2f", F.abs("c_acctbal"))
    k = F.col("c_custkey") % 6
    cell = F.when(k == 0, F.concat(F.lit("( "), F.translate(x, ".", ","), F.lit(" )"))).when(k == 1, F.concat(F.lit("-"), x)).when(k == 2, F.concat(x, F.lit(" USD"))).when(k == 3, F.lit("—")).when(k == 4, F.concat(F.lit("<b>"), x, F.lit("</b>"))).otherwise(F.concat(F.lit(" "), F.col("c_custkey").cast("string")))
    return c.select("c_custkey", cell.alias("cell"))


def parse_number_cells(spark, d):
    cell = F.col("cell")
    return _number_cells(spark, d).select("c_custkey", "cell", N.parse_number(cell).cast("long").alias("number"), N.is_code(cell).alias("is_code"), T.has_letters(cell).alias("has_letters"))


def line_islands(spark, d):
    each = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    got = B.islands(each, "doc_id", "line_no", F.col("line").endswith("."))
    return got.groupBy("doc_id", "island").agg(F.min("line_no").cast("long").alias("first_line"), F.count("*").alias("n")).drop("island")


def _piped(spark, d):
    docs = table(spark, d, "documents").filter(F.col("text").contains("|"))
    return docs.select("doc_id", F.regexp_replace("text", "(?m)^([^\\n]*\\|[^\\n]*)$", "| $1 |").alias("text"))


def pipe_table_rows(spark, d):
    rows = B.markdown_rows(_piped(spark, d))
    return rows.select("doc_id", F.col("table_no").cast("long").alias("table_no"), F.col("row_no").cast("long").alias("row_no"), F.size("cells").cast("long").alias("n_cells"), F.get("cells", F.lit(0)).alias("first_cell"), T.blank_row(F.col("cells")).alias("blank"))


def reconcile_order_totals(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("code"), F.round(F.col("o_totalprice") * 100).cast("long").alias("gs"), F.when(F.col("o_orderstatus") == "F", F.lit(1).cast("long")).alias("ge"))
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("code")).agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("rs"), F.count("*").alias("re"))
    both = o.withColumn("g", F.lit(True)).join(li.withColumn("r", F.lit(True)), "code", "full_outer")
    gs, rs, ge, re = (F.col(c) for c in ("gs", "rs", "ge", "re"))
    number = N.number_similarity_with_codes(gs, rs, ge, re, F.coalesce("g", F.lit(False)), F.coalesce("r", F.lit(False)))
    return both.select("code", number.alias("num_sim"), N.percent_difference(gs, rs).alias("start_diff"), N.percent_difference(ge, re).alias("end_diff"), N.overall_similarity(F.lit(1.0), number).alias("overall"), N.format_numbers(gs, ge, F.when(F.col("g"), F.col("code").cast("string"))).alias("gt_numbers"))


def reconcile_one_sided(spark, d):
    c, o = table(spark, d, "customer").select(F.col("c_custkey").alias("code")), table(spark, d, "orders").select(F.col("o_custkey").alias("code")).distinct()
    return c.join(o, "code", "left_anti").withColumn("side", F.lit("gt")).unionByName(o.join(c, "code", "left_anti").withColumn("side", F.lit("res")))


def code_dedupe_richest(spark, d):
    r = table(spark, d, "lineitem").select(
        F.col("l_linestatus").alias("pair_id"), F.col("l_partkey").cast("string").alias("code"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"), F.col("l_returnflag").alias("label"),
        F.when(F.col("l_quantity") > 25, F.col("l_quantity").cast("long")).alias("start"), F.when(F.col("l_tax") > 0.04, F.col("l_suppkey")).alias("end"),
    )
    return B.richest_by_code(r.groupBy("pair_id", "code", "ordinal").agg(F.max("label").alias("label"), F.max("start").alias("start"), F.max("end").alias("end")), ["pair_id"])


def issue_level_summary(spark, d):
    e = table(spark, d, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("head"))
    pages = e.join(first, "label").select("label", "vec_id", S.cosine(F.col("embedding"), F.col("head")).alias("cosine"), ((F.col("vec_id") * 37 % 100) / F.lit(100.0)).alias("lpips"))
    pages = pages.withColumn("cosine", F.round(0.9 + F.col("cosine") / 10, 4))
    return P.issue_summary(P.levelled(pages, mismatch=F.col("vec_id") % 50 == 0), "vec_id", ["label"])


def page_positional_join(spark, d):
    c = table(spark, d, "conversations")
    side = lambda r: c.filter(F.col("role") == r).select("conv_id", "turn", "text")
    out = P.positional_pages(side("user"), side("assistant"), "conv_id", "turn", "text")
    return out.select("conv_id", "page", F.length("expected").cast("long").alias("n_expected"), F.length("actual").cast("long").alias("n_actual"), "mismatch")


def doc_pair_topk(spark, d):
    a = table(spark, d, "documents").select(F.format_string("doc_%06d.pdf", "doc_id").alias("name"))
    b = table(spark, d, "labels").select(F.format_string("doc_%06d.docx", "doc_id").alias("name"))
    return P.document_pairs(a, b)


def page_selection(spark, d):
    p = table(spark, d, "part")
    spec = F.when(F.col("p_partkey") % 5 == 0, F.lit(None)).otherwise(F.concat(F.col("p_size").cast("string"), F.lit("-"), (F.col("p_size") + 3).cast("string"), F.lit(", "), (F.col("p_partkey") % 7).cast("string"), F.lit(",9-4")))
    return p.select("p_partkey", F.array_join(Q.page_selection(spec, F.lit(20)), " ").alias("pages"))


def cosine_pairs(spark, d):
    return V.cosine_within(table(spark, d, "embeddings"), "label", "vec_id", "embedding")


def class_share_by_doc(spark, d):
    return A.class_shares(scored_pages(spark, d), ["doc_id"])


def class_counts_by_model(spark, d):
    p = scored_pages(spark, d).withColumn("class", Q.perceptual_class(F.col("cosine"), F.col("lpips")))
    return A.class_counts(p, ["model"])


def class_share_total(spark, d):
    return A.share_total(scored_pages(spark, d), ["model", "doc_id"])


def mean_score_pivot(spark, d):
    return A.mean_pivot(scored_pages(spark, d), "doc_id", "model", MODELS, "lpips", digits=9)


def first_issue_pivot(spark, d):
    return A.first_pivot(scored_pages(spark, d), "doc_id", "model", MODELS, "class", "page_ordinal")


def dominant_class(spark, d):
    return A.dominant_class(scored_pages(spark, d), ["model", "doc_id"], "page_ordinal").withColumn("dominant_ord", F.col("dominant_ord").cast("long"))


def worst_class_summary(spark, d):
    return A.worst_class(scored_pages(spark, d), ["doc_id"], "page_ordinal", "cosine", "lpips")


def class_summary(spark, d):
    lab = table(spark, d, "labels")
    shown = F.when(F.col("toxic") == 1, "SEVERE 🔴").when(F.col("quality") == 1, "ok ✅").when(F.col("doc_id") % 2 == 0, "Minor issue").otherwise("unknown")
    docs = table(spark, d, "documents").join(lab, "doc_id").withColumn("class", Q.printed_class(shown))
    return A.class_summary(docs, "n_chars", "quality")


def boxplot_stats(spark, d):
    return A.boxplot(scored_pages(spark, d), ["doc_id"], "lpips", digits=9)


def histogram_20(spark, d):
    return A.histogram(scored_pages(spark, d), "lpips")


def kde_grid(spark, d):
    return A.kde(scored_pages(spark, d), ["model"], "lpips")


def union_dedupe_reports(spark, d):
    p = scored_pages(spark, d)
    twice = p.filter("page_ordinal % 3 <> 0").unionByName(p.filter("page_ordinal % 3 <> 1"))
    return A.first_copies(twice.select("model", "doc_id", "page_ordinal", "class"), ["model", "doc_id"], "page_ordinal").unionByName(twice.select("model", "doc_id", "page_ordinal", "class").distinct().filter("model = 'view'"))


def md_assemble_conversation(spark, d):
    out = G.markdown_documents(table(spark, d, "conversations"), "conv_id", "turn", "text")
    return out.select("conv_id", "pages", F.md5(F.col("markdown").cast("binary")).alias("md5"))


def cell_grid_markdown(spark, d):
    p = table(spark, d, "part")
    cell = lambda t, n: F.when(F.col("p_partkey") % 3 == n, F.struct(F.array().cast("array<double>").alias("bbox"), F.lit(None).cast("array<double>").alias("box"), t.alias("text"))).otherwise(F.struct(F.array(*[F.lit(float(x)) for x in (1, 2, 3, 4)]).alias("bbox"), F.lit(None).cast("array<double>").alias("box"), t.alias("text")))
    cells = F.array(cell(F.col("p_name"), 0), cell(F.concat(F.lit(" "), "p_brand", F.lit("\nx ")), 1), cell(F.col("p_type"), 2))
    data = F.struct(cells.alias("cells"), F.lit(2).alias("n_rows"), F.lit(2).alias("n_cols"))
    block = F.struct(F.lit("TableGroup").alias("type"), F.lit(3).alias("page_index"), data.alias("data"))
    other = F.struct(F.lit("Text").alias("type"), F.lit(1).alias("page_index"), data.alias("data"))
    json = F.to_json(F.struct(F.array(F.struct(F.array(other, block).alias("blocks"))).alias("pages")))
    t = G.layout_tables(p.select("p_partkey", json.alias("json")), "p_partkey", "json")
    cells = G.grid_cells(t, "p_partkey")
    return G.grid_markdown(cells, "p_partkey").select("p_partkey", F.col("table_no").cast("long").alias("table_no"), "markdown")


def scaled_boxes(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", F.array_join(Q.scaled_box(F.array(F.col("p_retailprice"), F.col("p_size").cast("double"), -F.col("p_retailprice"), F.lit(0.5)), 300), " ").alias("box"))


def page_numbers(spark, d):
    p = table(spark, d, "pages")
    name = F.regexp_extract("url", "[^/]*$", 0)
    return p.select("page_id", Q.page_number(name).cast("long").alias("page"))


def pair_tags(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    gt, res = F.concat("n_name", F.lit(".md")), F.concat("r_name", F.lit(".md"))
    return n.select("n_nationkey", M.pair_tag(gt, res).alias("tag"), M.stem(F.concat(F.lit("a/b.c/"), gt)).alias("stem"))


def perf_summary(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.round(F.col("value") * 100).cast("long").alias("cpu"), F.col("event_id").alias("ram_mb"))
    return A.perf_summary(e)


def _versions(spark, d):
    """Two Markdown versions of the parts of each brand: names and codes with slips, prices with slips."""
    p = table(spark, d, "part")
    k, price = F.col("p_partkey"), F.round("p_retailprice").cast("long")
    label = {"gt": F.col("p_name"), "res": F.when(k % 4 == 0, F.concat("p_name", F.lit(" total"))).when(k % 9 == 0, F.lit("")).otherwise(F.upper("p_name"))}
    code = {"gt": F.when(k % 5 != 0, (1000 + k % 9000).cast("string")).otherwise(""), "res": F.when(k % 5 == 0, "").when(k % 7 == 0, (1001 + k % 8999).cast("string")).otherwise((1000 + k % 9000).cast("string"))}
    start = {"gt": price.cast("string"), "res": F.when(k % 6 == 0, F.concat(F.lit("("), price.cast("string"), F.lit(",5)"))).otherwise(price.cast("string"))}
    out = None
    for s in ("gt", "res"):
        line = F.concat(F.lit("| "), label[s], F.lit(" | "), code[s], F.lit(" | "), start[s], F.lit(" | - |"))
        rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("l")))), lambda x: x["l"]), "\n")
        one = p.groupBy("p_brand", (k % 400).alias("slice")).agg(F.concat(F.lit("# Parts\n| Name | Code | Price | Left |\n|---|:---:|---|---|\n"), rows, F.lit("\nend")).alias("text"))
        one = one.select(F.concat_ws("/", "p_brand", F.col("slice").cast("string")).alias("pair_id"), F.lit(s).alias("side"), "text")
        out = out.unionByName(one) if out is not None else one
    return out


def compare_versions(spark, d):
    rows = compare_documents(_versions(spark, d), unicode=False)
    return rows.withColumn("stage", F.col("stage").cast("long"))


def index_row(spark, d):
    s = M.pair_summary(compare_documents(_versions(spark, d), unicode=False))
    return s.select("pair_id", *[F.round(c, 4).alias(c) for c in ("avg_over", "avg_label", "avg_num")], "rows_total", "paired_rows", "gt_only_rows", "res_only_rows")


def same_code_rows(spark, d):
    """Stage 1 alone: the join on codes."""
    docs = _versions(spark, d)
    keyed = docs.withColumn("doc_key", F.struct("pair_id", "side"))
    rows = B.markdown_rows(keyed, "doc_key", "text").select("doc_key.*", "table_no", "row_no", "cells")
    best = B.richest_by_code(B.extracted_rows(rows, ["pair_id", "side"]), ["pair_id", "side"])
    g, r = (best.filter(F.col("side") == s).select("pair_id", "code", F.col("label").alias(f"{s}_label"), F.col("start").cast("long").alias(f"{s}_start")) for s in ("gt", "res"))
    both = g.join(r, ["pair_id", "code"])
    return both.withColumn("num_sim", N.number_similarity(F.col("gt_start"), F.col("res_start"), F.lit(None).cast("long"), F.lit(None).cast("long")))


def file_pairing(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "nation")
    gt = n.select(F.concat(F.lit("gt/"), "n_name", F.lit("_report v1.md")).alias("path"))
    res = r.select(F.concat(F.lit("res/"), F.when(F.col("n_nationkey") % 2 == 0, F.lower("n_name")).otherwise(F.reverse("n_name")), F.when(F.col("n_nationkey") % 3 == 0, F.lit("-report V1.md")).otherwise(F.lit(" report v2.md"))).alias("path"))
    return M.paired_files(gt, res)


QUERIES = {
    f.__name__: f
    for f in (
        strip_html_pages, html_link_extract, html_summary_scan, html_report_pages, html_flat_classes, key_value_scan, normalize_documents, normalize_documents_unicode, page_files_read_back, csv_reads_back, layout_json_read_back, meaningful_tokens, char_set_size, label_similarity_candidates,
        best_match_per_document, greedy_label_match, parse_number_cells, line_islands, pipe_table_rows, reconcile_order_totals, reconcile_one_sided, code_dedupe_richest, issue_level_summary, page_positional_join,
        doc_pair_topk, page_selection, cosine_pairs, class_share_by_doc, class_counts_by_model, class_share_total, mean_score_pivot, first_issue_pivot, dominant_class, worst_class_summary, class_summary,
        boxplot_stats, histogram_20, kde_grid, union_dedupe_reports, md_assemble_conversation, cell_grid_markdown, scaled_boxes, page_numbers, pair_tags, perf_summary, compare_versions, index_row, same_code_rows, file_pairing,
    )
}
