import random
import zlib
from collections import Counter, defaultdict

import pytest

from vellumetry.llm.sharding import SlotMap, assign, sharded


def test_balance_and_growth():
    rnd = random.Random(1)
    sizes = {s: rnd.randint(1, 1000) for s in range(4096)}
    m = SlotMap.balanced(sizes, 40)
    load = m.load(sizes)
    assert max(load) - min(load) <= 1000
    g = m.grown(sizes)
    moved = [s for s in range(4096) if m.owner[s] != g.owner[s]]
    assert g.version == 2 and g.n_shards == 41 and all(g.owner[s] == 40 for s in moved)
    assert abs(g.load(sizes)[40] - sum(sizes.values()) / 41) < 1000
    heavy = sizes | {s: 5000 for s in range(4096) if m.owner[s] == 0}
    r = m.rebalanced(heavy)
    assert r.version == 2 and max(r.load(heavy)) < max(m.load(heavy)) and max(r.load(heavy)) - min(r.load(heavy)) < 10_000


def test_versions_are_kept(spark, tmp_path):
    path, sizes = f"file://{tmp_path}/map", {s: s for s in range(4096)}
    m = SlotMap.balanced(sizes, 5)
    m.save(spark, path)
    m.grown(sizes).save(spark, path)
    assert SlotMap.read(spark, path).n_shards == 6 and SlotMap.read(spark, path, 1) == m


def test_rows(spark, odd, odd_rows, none):
    rows = sharded(odd, 4).collect()
    assert len(rows) == len(odd_rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in odd_rows)
    places = defaultdict(list)
    for r in rows:
        places[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert sharded(none, 4).count() == 0


def test_bytes_are_even(spark):
    rnd = random.Random(2)
    docs = spark.createDataFrame([(i, "x" * rnd.randint(0, 3000), "hot") for i in range(3000)], "doc_id long, text string, source string")
    load = Counter()
    for r in sharded(docs, 40).collect():
        load[r.shard] += r.size
    assert set(load) == set(range(40)) and max(load.values()) - min(load.values()) <= 6000


def test_columns_stay(spark, odd):
    out, chosen, _ = assign(odd, 3)
    assert out.columns[: len(odd.columns)] == odd.columns and out.columns[-2] == "__vslot" and chosen.n_shards == 3
    assert out.count() == odd.count()


def test_a_second_run_edits_the_map(spark, tmp_path):
    rnd = random.Random(5)
    rows = [(i, "x" * rnd.randint(0, 300)) for i in range(6000)]
    frame = lambda rs: spark.createDataFrame(rs, "doc_id long, text string")
    path = f"file://{tmp_path}/map"
    _, first, _ = assign(frame(rows), 4, map_path=path)
    _, same, _ = assign(frame(rows), 4, map_path=path)
    assert same == first and SlotMap.versions(spark, path) == [1] and len(same.owner) == 4096
    heavy = rows + [(10_000 + i, "y" * 900) for i in range(6000) if first.owner[i % 4096] == 0]
    out, second, sizes = assign(frame(heavy), 4, map_path=path)
    held = {v: b for v, (b, _) in sizes.items()}
    load = second.load(held)
    assert second.n_shards == 4 and max(load) - min(load) <= 0.02 * sum(load) and out.count() == len(heavy)
    _, third, _ = assign(frame(heavy), 5, map_path=path)
    moved = [s for s in range(4096) if second.owner[s] != third.owner[s]]
    assert third.version == SlotMap.versions(spark, path)[-1] and len(third.owner) == 4096
    assert all(third.owner[s] == 4 for s in moved) and max(third.load(held)) - min(third.load(held)) <= 0.02 * sum(load)
    _, fourth, _ = assign(frame(heavy), 3, map_path=path)
    assert set(fourth.owner) == {0, 1, 2} and max(fourth.load(held)) - min(fourth.load(held)) <= 0.02 * sum(load)
    with pytest.raises(ValueError):
        fourth.save(spark, path)
    assert SlotMap.read(spark, path, 1) == first
