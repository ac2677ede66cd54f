import random
import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellumetry.operators import matching as M
from vellumetry.operators.tables import extracted, extracted_rows, label_rows, markdown_rows, richest_by_code
from vellumetry.plans.comparison import compare_documents, compare_folders

TABLE = """intro
| Name | Code | A | B |
|---|:---:|---|---|
| Незакінчені капітальні інвестиції | 1005 | | 6 366,7 |
| 1011 | 4 874,6 | 6 514,4 |
| Total <b>assets</b> | 1005 | 1 | 2 |
| | | | |
| heading only | | |
not a row
| single |
text
| x | 1 |
| y | 2 |"""


def test_rows_of_tables(spark):
    rows = markdown_rows(spark.createDataFrame([("d", TABLE), ("e", "no table"), ("f", None), ("g", "|\n|a|b|")], "doc_id string, text string"))
    got = [(r.doc_id, r.table_no, r.row_no, r.cells) for r in rows.orderBy("doc_id", "table_no", "row_no").collect()]
    assert [g[:3] for g in got] == [*[("d", 0, k) for k in range(6)], ("d", 1, 0), ("d", 1, 1), ("g", 0, 0), ("g", 0, 1)]
    assert got[0][3] == ["Name", "Code", "A", "B"] and got[2][3] == ["1011", "4 874,6", "6 514,4"] and got[8][3] == [""]


def test_extraction(spark):
    rows = [["Незакінчені капітальні інвестиції", "1005", "", "6 366,7"], ["1011", "4 874,6", "6 514,4"], ["a", "b", "123", "5", "x9", "(6)", "7"], ["123", "5", "label"], ["no code", "12", "x", "5"], [""], ["1", "<b>lab</b> el"]]
    got = [r.r for r in spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, cells array<string>").select("i", extracted(F.col("cells")).alias("r")).orderBy("i").collect()]
    want = [("1005", rows[0][0], 63667, None), ("1011", "", 48746, 65144), ("123", "b", 5, -6), ("123", "label", 5, None), (None, "no code", 12, 5), (None, "", None, None), (None, "lab el", 1, None)]
    assert [(r.code, r.label, None if r.start is None else int(r.start), None if r.end is None else int(r.end)) for r in got] == want


def test_richest_and_labels(spark):
    rows = extracted_rows(markdown_rows(spark.createDataFrame([("d", TABLE)], "doc_id string, text string")), ["doc_id"])
    codes = {r.code: (r.label, int(r.start)) for r in richest_by_code(rows, ["doc_id"]).collect()}
    assert codes == {"1005": ("Total assets", 1), "1011": ("", 48746)}
    assert [r.label for r in label_rows(rows, ["doc_id"]).orderBy("ordinal").collect()] == ["Name", "heading only", "x", "y"]


def normal(s):
    s = re.sub(r"<[^>]+>", " ", s or "").lower()
    s = unicodedata.normalize("NFKC", s).casefold()
    s = re.sub(r"^\s*(?:[ivxlcdmіїхсвмдл]+|[0-9]+)\.?\s+", "", s)
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]+", " ", s)).strip()


def sim(a, b):
    a, b = normal(a), normal(b)
    if not a or not b:
        return float(a == b)
    share = lambda x, y: len(x & y) / len(x | y)
    return round(0.5 * share(set(a.split()), set(b.split())) + 0.5 * share(set(a), set(b)), 4)


def alike(a, b):
    x, y = ({t for t in normal(s).split() if len(t) > 2} for s in (a, b))
    return len(x & y) >= 2 or (not x and not y) or len(x & y) / (len(x | y) or 1) >= 0.5


def expected_links(gt, res):
    """(stage, expected label, found label): coded rows as (code, label), others as labels."""
    (gc, gn), (rc, rn) = gt, res
    order = lambda codes: sorted(codes, key=lambda c: (len(c), c))
    out = [(1, gc[c], rc[c]) for c in order(set(gc) & set(rc))]
    free_g, free_r = order(set(gc) - set(rc)), order(set(rc) - set(gc))
    taken = set()
    for c in list(free_g):
        best, score = None, -1
        for d in free_r:
            if d not in taken and sim(gc[c], rc[d]) > score:
                best, score = d, sim(gc[c], rc[d])
        if score >= 0.8:
            taken.add(best)
            free_g.remove(c)
            out.append((2, gc[c], rc[best]))
    free_r = [d for d in free_r if d not in taken]
    for stage, codes, labels, others, flip in ((3, free_g, gc, rn, False), (4, free_r, rc, gn, True)):
        used = set()
        for c in list(codes):
            fits = [(-sim(labels[c], o), j) for j, o in enumerate(others) if j not in used and (sim(labels[c], o) >= 0.8 or alike(labels[c], o))]
            if fits:
                j = min(fits)[1]
                used.add(j)
                codes.remove(c)
                out.append((stage, others[j], labels[c]) if flip else (stage, labels[c], others[j]))
        if flip:
            gone_g = used
        else:
            gone_r = used
    edges = sorted((-sim(a, b), i, j) for i, a in enumerate(gn) for j, b in enumerate(rn) if sim(a, b) >= 0.6 or alike(a, b))
    used_g, used_r = set(), set()
    for _, i, j in edges:
        if i not in used_g and j not in used_r:
            used_g.add(i)
            used_r.add(j)
            out.append((5, gn[i], rn[j]))
    out += [(6, gc[c], "") for c in free_g] + [(6, "", rc[c]) for c in free_r]
    out += [(6, a, "") for i, a in enumerate(gn) if i not in used_g | gone_g] + [(6, "", b) for j, b in enumerate(rn) if j not in used_r | gone_r]
    return sorted(out)


def random_side(rnd):
    words = ["total", "net", "assets", "costs", "loss", "of", "the", "yearly", "і", "в"]
    label = lambda: " ".join(rnd.choices(words, k=rnd.randint(1, 4)))
    coded = {str(1000 + k): label() if rnd.random() < 0.9 else "" for k in rnd.sample(range(14), 8)}
    bare = [x for x in (label() for _ in range(6)) if normal(x)]
    return coded, bare


def test_compared_rows(spark):
    docs, want = [], {}
    for seed in range(12):
        rnd = random.Random(seed)
        sides = {s: random_side(rnd) for s in ("gt", "res")}
        for s, (coded, bare) in sides.items():
            lines = [f"| {label} | {code} | {rnd.randint(1, 99)} |" for code, label in coded.items()] + [f"| {x} | - | |" for x in bare]
            docs.append((f"p{seed}", s, "\n".join(lines)))
        want[f"p{seed}"] = expected_links(sides["gt"], sides["res"])
    got = {p: [] for p in want}
    for r in compare_documents(spark.createDataFrame(docs, "pair_id string, side string, text string")).collect():
        got[r.pair_id].append((r.stage, r.gt_label, r.res_label))
    assert {p: sorted(v) for p, v in got.items()} == want


def test_summary_and_values(spark):
    gt = "| Total assets | 1000 | 100 | 5 |\n| Costs | 2000 | 10 | |\n| Other | 1 | |"
    res = "| Total assets | 1000 | 200 | |\n| Gains | 3000 | 7 | |\n| 4000 | | |"
    docs = spark.createDataFrame([("p", "gt", gt), ("p", "res", res)], "pair_id string, side string, text string")
    rows = compare_documents(docs)
    first = rows.filter("stage = 1").head()
    assert (first.gt_numbers, first.res_numbers, first.label_sim, first.num_sim, first.overall_sim, first["start_rel_diff_%"], first["end_rel_diff_%"]) == ("1000 100 5", "1000 200", 1.0, 0.5, 0.75, 50.0, None)
    s = M.pair_summary(rows).head()
    assert s.rows_total == rows.count() >= s.paired_rows + s.gt_only_rows + s.res_only_rows
    ordered = [(bool(r.gt_label and r.res_label), r.gt_label) for r in M.report_order(rows).collect()]
    assert ordered == sorted(ordered, key=lambda x: (not x[0], x[1]))
    assert compare_documents(spark.createDataFrame([("p", "gt", "none")], docs.schema)).count() == 0


@settings(deadline=None, max_examples=8)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 5), st.sampled_from([0.1, 0.5, 0.5, 0.9])), max_size=20))
def test_mutual_best_is_greedy(spark, edges):
    edges = list({(i, j): (i, j, s) for i, j, s in edges}.values())
    used_i, used_j, want = set(), set(), []
    for s, i, j in sorted((-s, i, j) for i, j, s in edges):
        if i not in used_i and j not in used_j:
            used_i.add(i)
            used_j.add(j)
            want.append((i, j))
    got = M.mutual_best(spark.createDataFrame(edges, "i long, j long, s double"), "i", "j", "s")
    assert sorted((r.i, r.j) for r in got.collect()) == sorted(want)


def test_candidates_lose_nothing(spark):
    rnd = random.Random(1)
    label = lambda: " ".join(rnd.choices(["a", "of", "total", "net", "loss", "é", "b1"], k=rnd.randint(0, 4)))
    left, right = [(i, label()) for i in range(40)], [(i, label()) for i in range(30)]
    a, b = (M.with_sets(spark.createDataFrame(x, f"{n} int, text string"), "text") for x, n in ((left, "l"), (right, "r")))
    got = {(r.l, r.r): r.sim for r in M.label_candidates(a, b, "l", "r").collect()}
    want = {(i, j): sim(x, y) for i, x in left for j, y in right if sim(x, y) >= 0.6 or alike(x, y)}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1.1e-4 for k, v in want.items())
    with pytest.raises(ValueError, match="0.5"):
        M.label_candidates(a, b, "l", "r", 0.4)


def test_folders(spark, tmp_path):
    for side, name, text in (("gt", "Annual report 2020.md", TABLE), ("res", "annual-report_2020.md", TABLE), ("gt", "Cash flow statement.md", "| a total | 100 |\n| b net | 200 |"), ("res", "Cash flow statement (1).md", "| a total | 100 |\n| b net | 300 |"), ("gt", "zzz.md", "x"), ("res", "other.md", "y"), ("res", "note.txt", "z")):
        (tmp_path / side).mkdir(exist_ok=True)
        (tmp_path / side / name).write_text(text)
    rows, index = compare_folders(spark, str(tmp_path / "gt"), str(tmp_path / "res"))
    got = {r.gt_name: r for r in index.collect()}
    assert set(got) == {"Annual report 2020.md", "Cash flow statement.md"}
    assert got["Annual report 2020.md"].pair_reason == "exact-stem" and got["Cash flow statement.md"].pair_reason.startswith("fuzzy:0.")
    assert got["Annual report 2020.md"].avg_over == 1.0 and rows.filter("label_sim is null").count() == got["Cash flow statement.md"].gt_only_rows + got["Cash flow statement.md"].res_only_rows
    assert re.fullmatch(r"00\d_Annual_report_2020_[0-9a-f]{8}/md_compare_report.html", got["Annual report 2020.md"].report_rel)
