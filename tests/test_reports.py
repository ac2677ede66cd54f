import json

import pytest
from pyspark.sql import functions as F

from vellumetry.operators import analytics as A
from vellumetry.operators import grids as G
from vellumetry.operators import pages as P
from vellumetry.plans import stages
from vellumetry.sources import files, reports, sinks
from vellumetry.streaming.pages import issue_counts

ROWS = "<tr><th>Page</th></tr><tr class='OK'><td>1</td><td>0.9994</td><td>0.0451</td><td>OK ✅</td></tr><tr><td>2</td><td>0.9741</td><td>0.7773</td><td>Moderate 🟠</td></tr><tr><td>x</td><td>n/a</td><td>1</td><td>OK</td></tr>"
ODD = "<h2>Document: B</h2><table><tr><th>Page</th></tr><tr><td colspan='4' style='color:red'>Page count mismatch</td></tr></table>"
REPORT = f"""<html><body><div><h1>Summary</h1><ul style="x"><li><b>Total documents:</b> 2</li><li><b>OK:</b> 1 ✅</li><li>plain</li></ul></div>
<h1>Performance Summary</h1><ul><li><b>Time:</b> 9</li></ul>
<h2>Document: A</h2>\n<table>{ROWS}</table>{ODD}</body></html>
<h2>Document: <b>A</b></h2><table>{ROWS}</table>{ODD.replace("B<", "<b>B</b><")}</body></html>"""


@pytest.fixture(scope="module")
def report(spark):
    return spark.createDataFrame([("m", REPORT), ("empty", None)], "model string, text string")


def test_report_pages(report):
    got = [(r.doc_id, r.page_ordinal, r.page, r.cosine, r.lpips, r.issue, r.copy_no) for r in reports.report_pages(report, ["model"]).orderBy("copy_no", "page").collect()]
    assert got == [("A", k, k, c, p, i, n) for n in (1, 2) for k, c, p, i in ((1, 0.9994, 0.0451, "OK"), (2, 0.9741, 0.7773, "Moderate"))]
    assert reports.flat_classes(report, ["model"]).groupBy("class").count().orderBy("class").collect() == [("Moderate", 2), ("OK", 2)]


def test_summary_block(report):
    got = {r.model: r.s for r in report.select("model", reports.summary_block(F.coalesce("text", F.lit(""))).alias("s")).collect()}
    assert got == {"m": {"Total documents": 2, "OK": 1}, "empty": {}}


def test_written_report_reads_back(spark):
    pages = spark.createDataFrame([("d1", 1, 0.9995, 0.2), ("d1", 10, 0.95, 0.3), ("d1", 2, 0.5, 0.9), ("d2", None, None, None)], "doc_id string, page int, cosine double, lpips double")
    marked = P.levelled(pages, mismatch=F.col("page").isNull())
    s = P.issue_summary(marked)
    assert s.head().asDict() == {"documents": 2, "pages": 3, "ok": 1, "minor": 0, "moderate": 1, "severe": 1, "mismatch_docs": 1}
    text = reports.page_report(marked, s, {"Total time": "1 sec"}, [("bad.docx", "ValueError: x")])
    back = reports.report_pages(spark.createDataFrame([("m", text)], "model string, text string"), ["model"])
    assert [(r.doc_id, r.page, r.cosine, r.issue, r.copy_no) for r in back.orderBy("page").collect()] == [("d1", 1, 0.9995, "OK", 1), ("d1", 2, 0.5, "Severe", 1), ("d1", 10, 0.95, "Moderate", 1)]
    assert spark.createDataFrame([(text,)], "t string").select(reports.summary_block(F.col("t")).alias("s")).head().s["Severe issues"] == 1


def test_pair_report_shows_labels_for_missing_numbers(spark):
    rows = spark.createDataFrame([("a<b", "a", "1", "", 0.5, None, 0.5), ("c", "", "", "", None, None, None)], "gt_label string, res_label string, gt_numbers string, res_numbers string, label_sim double, num_sim double, overall_sim double")
    text = reports.pair_report(rows, "x")
    assert "a&lt;b" in text and "0.5000 •" in text and "<b>Numbers:</b> —" in text and "hsl(60,70%,88%)" in text
    assert "<th>gt_label</th>" in reports.index_report(rows)


def test_key_values_and_sinks(spark, tmp_path):
    got = files.key_values(spark.createDataFrame([("=== x: y\n a : b: c\n\nno\nk:", )], "text string")).collect()
    assert [(r.key, r.value) for r in got] == [("a", "b: c"), ("k", "")]
    pages = spark.createDataFrame([("d", 1, "one"), ("d", 12, "two")], "doc_id string, page int, text string")
    assert sinks.csv_text(pages).startswith("﻿doc_id,page,text")
    sinks.write_csv(pages, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    for _ in range(2):  # a second run leaves the same files
        sinks.page_files(pages, str(tmp_path / "pages"))
        assert {p.name: p.read_text() for p in (tmp_path / "pages" / "d").iterdir() if not p.name.endswith(".crc")} == {"page_0001.yaml": "one", "page_0012.yaml": "two"}
    assert G.markdown_documents(pages, "doc_id", "page", "text").head().markdown == "# Page 1\none\n\n# Page 12\ntwo\n"
    out = pages.select(sinks.layout_json(F.col("page"), F.lit("p.png"), F.col("text"), F.array(F.struct(F.lit("й").alias("text"), F.array(F.lit(1)).alias("bbox"), F.lit("x").alias("type")))).alias("j")).head().j
    assert json.loads(out)["blocks"][0]["text"] == "й" and "й" in out


def test_file_scan(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"\xff ok")
    (tmp_path / "b.PDF").write_bytes(b"%PDF")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.md").write_text("c")
    assert [r.text for r in files.text_files(spark, str(tmp_path)).collect()] == [" ok"]
    assert files.text_files(spark, str(tmp_path), recursive=True).count() == 2
    assert files.pdf_files(spark, str(tmp_path)).count() == 1
    with pytest.raises(FileNotFoundError):
        files.pdf_files(spark, str(tmp_path / "sub"), strict=True)


def layout(spark, *docs):
    return spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "k int, j string")


def test_layout_grids(spark):
    cell = lambda t, box="bbox": {box: [1, 2, 3, 4], "text": t}
    rows = {"type": "Table", "page": 2, "data": {"rows": [[cell("a"), cell("b\nc", "box")], [{"bbox": [1], "text": "no"}]]}}
    flat = {"type": "TABLE_x", "page_index": 1, "data": {"cells": [cell("p"), cell("q"), cell("r")], "n_rows": 2, "n_cols": 2}}
    frame = layout(spark, {"blocks": [{"type": "Text"}, rows]}, {"pages": [{"blocks": [flat]}, {"blocks": None}]}, {"blocks": [], "pages": [{"blocks": [rows]}]}, {"blocks": [{"type": "table", "data": {}}]})
    tables = G.layout_tables(frame, "k", "j")
    assert [(r.k, r.table_no, r.page) for r in tables.orderBy("k").collect()] == [(0, 1, 2), (1, 1, 1), (3, 1, 0)]
    cells = G.grid_cells(tables, "k")
    assert cells.filter("k = 0 and row = 0 and col = 1").head().box == [4, 8, 12, 16]
    got = {r.k: r.markdown for r in G.grid_markdown(cells, "k").collect()}
    assert got == {0: "| --- | --- |\n|a|b c|\n|||", 1: "| --- | --- |\n|p|q|\n|r||"}


def test_pages_and_documents(spark):
    a = spark.createDataFrame([("d", 2, "a2"), ("d", 1, "a1"), ("e", 1, "x"), ("f", 1, "only")], "doc string, page int, v string")
    b = spark.createDataFrame([("d", 10, "b10"), ("d", 3, "b3"), ("e", 1, "y"), ("e", 2, "z")], "doc string, page int, v string")
    got = sorted(map(tuple, P.positional_pages(a, b, "doc", "page", "v").collect()), key=repr)
    assert got == [("d", 1, "a1", "b3", False), ("d", 2, "a2", "b10", False), ("e", None, None, None, True), ("f", None, None, None, True)]
    x, y = (spark.createDataFrame([(n,) for n in names], "name string") for names in (["b.c.pdf", "a.pdf", "z.pdf"], ["a.docx", "b.c.docx"]))
    assert [tuple(r) for r in P.document_pairs(x, y).collect()] == [("a", "a.pdf", "a.docx"), ("b.c", "b.c.pdf", "b.c.docx")]
    assert P.document_pairs(x, y, top=1).count() == 1


def test_analytics(spark):
    pages = spark.createDataFrame([("d", 1, "Minor", 0.1), ("d", 2, "OK", 0.2), ("d", 3, "Minor", 0.3), ("d", 4, "OK", 5.0), ("e", 5, "?", 0.5)], "doc string, at int, class string, s double")
    assert [(r.doc, r.dominant, r.dominant_ord) for r in A.dominant_class(pages, ["doc"], "at").orderBy("doc").collect()] == [("d", "Minor", 1), ("e", "?", 0)]
    worst = A.worst_class(pages, ["doc"], "at", "s", "s").orderBy("doc").collect()
    assert [(r.worst, r.pages, r.share) for r in worst] == [("Minor", 4, 0.8), ("?", 1, 0.2)]
    assert {(r.doc, r["class"]): r.n for r in A.class_counts(pages, ["doc"]).collect()}[("e", "OK")] == 0
    shares = {r.doc: r for r in A.class_shares(pages, ["doc"]).collect()}
    assert shares["d"].ok == 0.5 and shares["e"].ok is None
    box = A.boxplot(pages, ["doc"], "s").filter("doc = 'd'").head()
    assert (box.q1, box.median, box.q3, box.low, box.high, box.fliers) == (0.175, 0.25, 1.475, 0.1, 0.3, 1)
    h = A.histogram(pages, "s").orderBy("bin").collect()
    assert len(h) == 20 and sum(r.n for r in h) == 5 and h[19].n == 1 and abs(sum(r.density for r in h) * 4.9 / 20 - 1) < 0.01
    assert {r.doc for r in A.kde(pages, ["doc"], "s").collect()} == {"d"} and A.kde(pages, [], "s").count() == 50
    assert A.first_pivot(pages, "doc", "class", ["OK", "Minor"], "s", "at").filter("doc = 'd'").head().class_OK == 0.2
    assert A.perf_summary(spark.createDataFrame([], "doc_id string, cpu double, ram_mb double")).head().avg_cpu == 0.0


def test_model_stage(spark):
    def factory():
        return lambda x: 10 // x

    out = stages.model_stage(spark.createDataFrame([(5,), (0,)], "x long"), ["x"], "y", "long", factory)
    good, bad = stages.split_errors(out)
    assert [tuple(r) for r in good.collect()] == [(5, 2)] and bad.head().error.startswith("ZeroDivisionError")
    with pytest.raises(Exception, match="error"):
        stages.strict(out).collect()
    texts = stages.model_stage(spark.createDataFrame([("a",), (None,)], "x string"), ["x"], "t", "string", lambda: str.upper)
    assert sorted(r.t for r in stages.or_empty(texts, "t").collect()) == ["", "A"]


def test_stream_of_pages(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", "m", 0.9999, 0.1), ("2024-01-01 00:20:00", "m", 0.5, 0.1), ("2024-01-01 01:10:00", "m", 0.95, 0.1)]
    frame = spark.createDataFrame(rows, "t string, model string, cosine double, lpips double").withColumn("time", F.to_timestamp("t"))
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    counts = issue_counts(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in")), "time")
    query = counts.writeStream.outputMode("complete").format("memory").queryName("issues").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    got = [(r.pages, r.ok, r.moderate, r.severe) for r in spark.sql("select * from issues order by start").collect()]
    assert got == [(2, 1, 0, 1), (1, 0, 1, 0)]
