import random

import corpus_pipeline
from vellumetry.llm import common
from vellumetry.llm.queries import ORACLE_SQL, QUERIES


def test_stages(spark, tmp_path):
    rnd = random.Random(6)
    text = lambda: "\n".join(" ".join("".join(rnd.choices("abcdefgh", k=rnd.randint(2, 7))) for _ in range(12)) for _ in range(5))
    items = [(k, " ".join("".join(rnd.choices("ijklmnop", k=5)) for _ in range(25))) for k in range(5)]
    good = [text() for _ in range(150)]
    rows, labels = [], []
    for i, t in enumerate(good):
        rows.append((i, t, "en", f"s{i % 3}", len(t)))
    rows += [(200 + i, good[i], "en", "s0", 1) for i in range(20)]  # copies
    rows += [(300 + i, good[i + 30][:100] + " " + items[i][1] + " " + text(), "en", "s1", 1) for i in range(5)]  # leaks
    bad = [" ".join(w + "%%%" for w in text().split()) for _ in range(40)]
    rows += [(400 + i, t, "en", "s2", 1) for i, t in enumerate(bad)]
    labels = [(i, int(i < 400), 0) for i, *_ in rows if i % 2 or i >= 400]
    where = f"file://{tmp_path}"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")

    docs, left = spark.read.parquet(f"{where}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, where)
        if name != "shards":
            assert docs.columns == columns
        left.append({r.doc_id for r in docs.collect()})
    assert left[0] == {i for i, *_ in rows if i < 400}
    assert left[1] == left[0] - set(range(200, 220))
    assert left[2] == left[1] - set(range(300, 305))
    assert left[3] <= left[2] and left[4] == left[3] and docs.columns == [*columns, "slot", "shard"]
    assert corpus_pipeline.run(spark, where).count() == docs.count()


def test_odd_and_empty_tables(spark, odd, none, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}/shared")
    for name, docs, labels in (("odd", odd, [(1, 1, 0), (2, 0, 0), (None, 1, 0), (3, None, 0)]), ("unlabelled", odd, []), ("none", none, [])):
        where = f"file://{tmp_path}/{name}"
        docs.write.parquet(f"{where}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
        spark.createDataFrame([(None, None), (1, "")], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
        out = corpus_pipeline.run(spark, where)
        assert out.columns == [*docs.columns, "slot", "shard"]
        assert name == "odd" or (out.count() > 0) == (name == "unlabelled")
        assert out.select(*docs.columns).distinct().exceptAll(docs).count() == 0
        left = [p.name.split("-")[1] for p in (tmp_path / "shared/vellumetry").glob("pipeline-*")]
        assert set(left) == {"shards"}
    assert not list((tmp_path / "shared/vellumetry").glob("simhash-*"))


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "benchmark_leaks", "mix", "shards"]
    assert {f"op{n}" for n in range(1, 11)} == {q.split("_")[0] for q in QUERIES if q != "pipeline"}
    assert set(ORACLE_SQL) <= set(QUERIES)
