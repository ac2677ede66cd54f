import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vellumetry.llm import decontamination as D


def shingles(text):
    w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def brute(docs, items):
    """Every window as long as an item, at every place."""
    out = set()
    for (i, t), (k, b) in ((d, x) for d in docs for x in items):
        have, want = shingles(t), Counter(shingles(b))
        n = sum(want.values())
        for s in range(max(1, len(have) - n + 1)) if n and have else ():
            own = Counter(have[s : s + n])
            both = sum((own & want).values())
            if both >= 0.8 * (sum(own.values()) + n - both):
                out.add((i, k))
                break
    return out


@pytest.fixture(scope="module")
def case(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choices("abcdefghij", k=4))
    items = [(k, " ".join(word() for _ in range(rnd.randint(12, 50)))) for k in range(12)] + [(20, None), (21, ""), (22, "too few words")]
    items.append((23, items[0][1]))
    docs = []
    for i in range(80):
        words = [word() for _ in range(rnd.randint(0, 150))]
        if i % 2:
            passage = items[i % 12][1].split()
            if i % 4 == 1:
                passage = [p.upper() + "," for p in passage]
            if i % 8 == 3:
                passage[0] = "changed"
            if i % 8 == 7:
                passage[len(passage) // 2 :: 2] = [word() for _ in passage[len(passage) // 2 :: 2]]
            at = rnd.randint(0, len(words))
            words[at:at] = passage
        docs.append((i, " ".join(words)))
    docs += [(100, items[1][1]), (100, items[1][1]), (101, None), (102, ""), (None, items[2][1]), (103, " ".join(items[3][1].split()[:-1]))]
    return docs, items


def test_against_brute_force(spark, case):
    docs, items = case
    found = D.leaks(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"))
    rows = found.collect()
    assert {(r.doc_id, r.item_id) for r in rows} == brute(docs, items)
    assert len(rows) == len({(r.key, r.item_id) for r in rows}) and all(r.similarity >= 0.8 for r in rows)


def test_filter_keeps_the_rest(spark, case, odd, none):
    docs, items = case
    bench = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame([(*d, 7) for d in docs], "doc_id long, text string, _key int")
    bad = {i for i, _ in brute(docs, items)}
    left = D.decontaminated(frame, bench)
    assert left.columns == frame.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in left.collect()) == sorted((i is None, i or 0) for i, _ in docs if i not in bad)
    assert D.decontaminated(odd, bench).count() == odd.count() and D.decontaminated(none, bench).count() == 0
    assert D.decontaminated(frame, bench.limit(0)).count() == len(docs)


def test_more_anchors_take_joins(spark, case, monkeypatch):
    docs, items = case
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    key = lambda d: sorted((r.key, r.item_id) for r in d.collect())
    whole = key(D.leaks(frame, bench))
    for few in (D.FEW, 0):
        monkeypatch.setattr(D, "LISTED", 0)
        monkeypatch.setattr(D, "FEW", few)
        assert key(D.leaks(frame, bench)) == whole


def test_blocks_guarantee_the_radius():
    rnd = random.Random(4)
    for _ in range(300):
        a, b = rnd.getrandbits(64), 0
        b = a
        for bit in rnd.sample(range(64), D.RADIUS):
            b ^= 1 << bit
        assert any(bin((a ^ b) >> 8 * k & 255).count("1") <= D.BLOCK_RADIUS for k in range(8))


def test_main_path_is_native(spark, case):
    docs, items = case
    found = D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    plan = found.groupBy("item_id").agg(F.count("*"))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def weighted(docs, items):
    """(doc, item): start and similarity of the most similar window of all, where it is similar enough."""
    sets = {k: Counter(shingles(b)) for k, b in items}
    weight = lambda h: max(1, 4 - ((sum(h in s for s in sets.values()) or 1).bit_length() - 1))
    mass = lambda c: sum(weight(h) * n for h, n in c.items())
    out = {}
    for (i, t), (k, want) in ((d, x) for d in docs for x in sets.items()):
        have, n = shingles(t), sum(want.values())
        scores = []
        for s in range(max(1, len(have) - n + 1)):
            own = Counter(have[s : s + n])
            both = mass(own & want)
            scores.append((both / (mass(own) + mass(want) - both), -s))
        if max(scores)[0] >= 0.8:
            out[i, k] = (-max(scores)[1], round(max(scores)[0], 6))
    return out


def test_best_window_in_line_with_no_anchor(spark):
    """Items with a common beginning, whose rarest shingles stand together; words are inserted behind them."""
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choices("abcdefghij", k=6))
    common = [word() for _ in range(40)]
    items = [(k, " ".join([*common, *(word() for _ in range(60))])) for k in range(9)]
    docs = []
    for i in range(9):
        passage = items[i][1].split()
        passage[60 + i : 60 + i] = [word() for _ in range(3 + i % 3)]
        docs.append((i, " ".join([*(word() for _ in range(7 * i)), *passage, *(word() for _ in range(5))])))
    want = weighted(docs, items)
    assert want[1, 1] == (7 + 4, round(256 / 308, 6))
    found = D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id): (r.start, r.similarity) for r in found.collect()} == want


def test_insertions_and_deletions_around_the_threshold(spark):
    rnd = random.Random(14)
    word = lambda: "".join(rnd.choices("abcdefghij", k=6))
    items = [(k, " ".join(word() for _ in range(180))) for k in range(6)]
    docs = []
    for i in range(60):
        passage = items[i % 6][1].split()
        for _ in range(rnd.randint(3, 6)):
            at = rnd.randint(0, len(passage) - 1)
            passage[at : at + rnd.randint(0, 1)] = [word() for _ in range(rnd.randint(0, 2))]
        docs.append((i, " ".join([*(word() for _ in range(rnd.randint(0, 40))), *passage, *(word() for _ in range(20))])))
    want = weighted(docs, items)
    assert 10 < len(want) < 55
    found = D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id): (r.start, r.similarity) for r in found.collect()} == want


def test_repeated_clashing_and_null_items(spark):
    rnd = random.Random(10)
    texts = [" ".join("".join(rnd.choices("abcdefghij", k=5)) for _ in range(30)) for _ in range(6)]
    items = [(0, texts[0]), (0, texts[0]), (1, texts[1]), (1, texts[2]), (None, texts[3]), (None, texts[4]), (5, texts[5])]
    docs = [*enumerate(texts), (6, f"{texts[1]} and {texts[2]}"), (7, "a text that holds none of the items")]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id, r.start, r.similarity) for r in D.leaks(frame, bench).collect()), key=repr)
    assert got == sorted([(0, 0, 0, 1.0), (1, 1, 0, 1.0), (2, 1, 0, 1.0), (3, None, 0, 1.0), (4, None, 0, 1.0), (5, 5, 0, 1.0), (6, 1, 0, 1.0), (6, 1, 31, 1.0)], key=repr)
    assert [r.doc_id for r in D.decontaminated(frame, bench).collect()] == [7]
