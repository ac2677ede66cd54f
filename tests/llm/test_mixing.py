import random
import re
from collections import Counter, defaultdict

from vellumetry.llm.mixing import mixed, sampled


def filled(sizes):
    """Shares by weight, the excess over three times a size shared again among the others."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    target, left, total = {}, set(names), sum(sizes.values())
    while left:
        rest = total - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s for s in left if share[s] > 3 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 3 * sizes[s]
        left -= over
    return target


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def check(rows, docs):
    sizes = defaultdict(int)
    for _, t, s in docs:
        sizes[s] += words(t)
    goal, taken, biggest = filled(sizes), defaultdict(int), defaultdict(int)
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((i, words(t)) for i, t, _ in docs)
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - goal[r.source]) < 1e-6 and r.taken in {r.size * k for k in range(4)}
        taken[r.source] += r.taken
        biggest[r.source] = max(biggest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= 2 * max(biggest.values()) + 1
    assert sum(taken.values()) <= sum(sizes.values())


def test_targets_are_met(spark):
    rnd = random.Random(1)
    docs = [(i, "w " * rnd.randint(0, 40), rnd.choices(["big", "mid", "tiny", None, "É"], [60, 20, 1, 10, 5])[0]) for i in range(1500)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = mixed(frame).collect()
    check(rows, docs)
    again = mixed(frame.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)
    some = [r for r in rows if 0 < r.taken < 3 * r.size]
    assert some and sampled(frame).count() == sum(r.copies for r in rows)


def test_order_is_fair_at_every_point(spark):
    docs = [(i, "w " * 10, "ab"[i % 2]) for i in range(600)]
    rows = sorted((r for r in mixed(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect() if r.copies), key=lambda r: r.first_at)
    seen = Counter()
    for k, r in enumerate(rows):
        seen[r.source] += r.size / r.target
        if 40 < k and r.first_at < 0.7:  # "b", twice the target of "a", starts its second round at 0.75
            assert abs(seen["a"] - seen["b"]) < 0.05


def test_odd_rows(spark, odd, odd_rows, none):
    check(mixed(odd).collect(), [(r[0], r[1], r[3]) for r in odd_rows])
    assert sampled(odd).columns == odd.columns
    assert mixed(none).count() == 0 and sampled(none).count() == 0


def test_no_words_at_all(spark):
    rows = mixed(spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")).collect()
    assert [(r.size, r.taken, r.target) for r in rows] == [(0, 0, 0.0)] * 2
