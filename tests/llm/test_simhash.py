import random
import re

import numpy as np
from xxhash import xxh64_intdigest

from vellumetry.llm import simhash
from vellumetry.llm.simhash import components, fingerprint, golay_index, group_keys, links, near_duplicates, near_indices, one_of_each, prints_of, segment_keys, shingles_of, similar_groups


def slow_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    h = [xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


def test_golay_code_is_perfect():
    rnd = random.Random(1)
    words = np.array([rnd.getrandbits(23) for _ in range(2000)], np.int64)
    index = golay_index(words)
    for e in (1 << 4, 1 << 20 | 1):
        code = golay_index(words ^ e)
        assert ((index == code).mean() > 0.1) and index.max() < 4096
    assert len(np.unique(golay_index(np.arange(1 << 23, dtype=np.int64)))) == 4096


def test_near_indices_hold_those_of_neighbours():
    rnd = random.Random(4)
    words = np.array([rnd.getrandbits(23) for _ in range(500)], np.int64)
    near = near_indices(words)
    assert 5 < np.mean([len(set(r)) for r in near.tolist()]) < 6
    for bit in range(23):
        assert (near == golay_index(words ^ 1 << bit)[:, None]).any(axis=1).all()


def test_fingerprints_within_two_bits_share_a_key():
    rnd = random.Random(2)
    keys = lambda v: set(segment_keys(np.array([v], np.uint64).view(np.int64))[0].tolist())
    for _ in range(1000):
        a = b = rnd.getrandbits(64)
        for bit in rnd.sample(range(64), rnd.randint(0, 2)):
            b ^= 1 << bit
        assert keys(a) & keys(b)
    assert not any(keys(rnd.getrandbits(64)) & keys(rnd.getrandbits(64)) for _ in range(1000))


def test_fingerprint(odd_rows):
    for t in [r[1] for r in odd_rows][:51]:
        assert fingerprint(t or "") == slow_fingerprint(t)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_links_and_components(spark):
    rnd = random.Random(3)
    fps = {0, (1 << 64) - 1, 1 << 63}
    for _ in range(25):
        x = rnd.getrandbits(64)
        for _ in range(rnd.randint(1, 9)):  # chains of steps of up to three bits
            fps.add(x)
            for bit in rnd.sample(range(64), rnd.randint(1, 3)):
                x ^= 1 << bit
    fps = sorted(signed(x) for x in fps)
    frame = spark.createDataFrame([(x,) for x in fps], "fp long")
    got = {r.node: r.root for r in components(links(frame)).collect()}
    want = roots(fps, lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1") <= 2)
    assert {n: got.get(n, n) for n in fps} == want


def test_links_of_a_full_key(spark, monkeypatch):
    """More fingerprints under one key than are compared pair by pair."""
    rnd = random.Random(8)
    base, fps = rnd.getrandbits(42) << 22 >> 22, set()
    for _ in range(150):
        fps.add(base ^ sum(1 << b for b in rnd.sample(range(21), rnd.randint(0, 4))))
    fps = sorted(fps)
    want = roots(fps, lambda a, b: bin(a ^ b).count("1") <= 2)
    for few in (0, 5, 1000):
        monkeypatch.setattr(simhash, "FEW", few)
        got = {r.node: r.root for r in components(links(spark.createDataFrame([(x,) for x in fps], "fp long"))).collect()}
        assert {n: got.get(n, n) for n in fps} == want


def test_long_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(300)], "a long, b long")
    assert {r.root for r in components(edges).collect()} == {0}


def test_rows(spark, odd, odd_rows, none):
    docs = [(i, slow_fingerprint(t)) for i, t, *_ in odd_rows]
    root = roots(sorted({f for _, f in docs}), lambda a, b: bin(a ^ b).count("1") <= 2)
    least = {}
    for i, f in docs:
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    key = lambda r: repr(r)
    got = sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in near_duplicates(odd).collect()), key=key)
    assert got == sorted(((i, f, least.get(root[f])) for i, f in docs), key=key)
    assert near_duplicates(none).count() == 0


def shingle_set(t):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_shingles():
    rnd = random.Random(5)
    for n in (0, 3, 60, 400, 3000):
        words = [f"w{rnd.randrange(5000)}" for _ in range(n)]
        assert len(shingles_of(" ".join(words))) == len(shingle_set(" ".join(words)))


def test_keys_of_near_copies():
    """Of pairs at a similarity of 0.8 to 0.85, nearly all share a key."""
    rnd = random.Random(9)
    shared = []
    while len(shared) < 300:
        words = [f"w{rnd.randrange(3000)}" for _ in range(rnd.randint(60, 500))]
        a, b = " ".join(words), " ".join(f"edit{rnd.randrange(10**6)}" if rnd.random() < 0.02 else w for w in words)
        if 0.8 <= jaccard(shingle_set(a), shingle_set(b)) < 0.85:
            x, y = np.array([prints_of(a), prints_of(b)], np.int64)
            keys = [set(k.tolist()) for k in group_keys(np.stack([x, y]))]
            shared.append(bool(keys[0] & keys[1]) and np.bitwise_count((x ^ y).view(np.uint64)).sum() <= simhash.NEAR)
    assert np.mean(shared) >= 0.95


def test_one_of_each_near_group(spark):
    rnd = random.Random(7)
    texts = []
    for _ in range(60):
        words = [f"w{rnd.randrange(3000)}" for _ in range(rnd.randint(60, 500))]
        for _ in range(4):
            texts.append(" ".join(f"edit{rnd.randrange(10**6)}" if rnd.random() < 0.008 else w for w in words))
    docs = [(1000 - i, t) for i, t in enumerate(texts)]
    sets = [shingle_set(t) for _, t in docs]
    kept = {r.doc_id for r in one_of_each(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    near = [[j for j in range(4 * (i // 4), 4 * (i // 4) + 4) if j != i and jaccard(sets[i], sets[j]) >= 0.8] for i in range(len(docs))]
    # the least id of a family is the last of its texts; one that is like it goes
    gone = [i for i, others in enumerate(near) if any(j > i for j in others)]
    assert len(gone) > 100 and sum(docs[i][0] not in kept for i in gone) >= 0.95 * len(gone)
    assert all(docs[i][0] in kept for i, others in enumerate(near) if not others)


def test_one_of_each_odd_rows(spark, odd, odd_rows, none):
    kept = one_of_each(odd)
    rows = kept.collect()
    sets = {t: shingle_set(t) for t in {r[1] or "" for r in odd_rows}}
    root = roots(sorted(sets), lambda a, b: jaccard(sets[a], sets[b]) >= 0.8)
    assert kept.columns == odd.columns and {root[r.text or ""] for r in rows} == set(root.values()) and len(rows) == len(set(root.values()))
    assert one_of_each(none).count() == 0


def test_near_copies_among_reorderings(spark):
    """All have the same words, so the same fingerprints; the reorderings are like none of the others."""
    rnd = random.Random(11)
    docs, want = [], set()
    for family in range(10):
        words = [f"w{family}x{k}" for k in range(300)]
        for _ in range(4):
            rnd.shuffle(words)
            swapped = list(words)
            swapped[100], swapped[101] = swapped[101], swapped[100]
            want.add(len(docs))
            docs += [" ".join(words), " ".join(swapped)]
        for _ in range(4):
            want.add(len(docs))
            docs.append(" ".join(rnd.sample(words, len(words))))
    order = rnd.sample(range(len(docs)), len(docs))
    kept = one_of_each(spark.createDataFrame([(i, docs[i]) for i in order], "doc_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == want


def test_large_groups(spark, monkeypatch):
    """A family of many near copies, some of them chained, dealt into many blocks."""
    rnd = random.Random(12)
    base = [f"w{rnd.randrange(3000)}" for _ in range(150)]
    docs = [" ".join(f"e{rnd.randrange(10**6)}" if rnd.random() < p else w for w in base) for p in [0.006] * 60 + [0.012] * 60 + [0.02] * 40]
    docs += docs[:5]
    sets = [shingle_set(t) for t in docs]
    root = roots(list(range(len(docs))), lambda a, b: jaccard(sets[a], sets[b]) >= 0.8)
    assert 3 < len(set(root.values())) < 100
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    for block in (8 << 20, 20_000):
        monkeypatch.setattr(simhash, "BLOCK", block)
        assert {r.doc_id: r.component_id for r in similar_groups(frame).collect()} == root


def test_unlike_leaders(spark):
    """Texts that go on from a key whose least text is unlike them meet there."""
    key = lambda *bits: tuple(-1 if k in bits else 0 for k in range(simhash.PRINTS))
    rows = [(1, 10, *key(0, 1, 2)), (1, 11, *key(0, 1, 2)), (1, 12, *key(0, 1)), (1, 13, *key()), (2, 10, *key(0, 1, 2)), (2, 14, *key(0))]
    frame = spark.createDataFrame(rows, f"key long, node long, {simhash.PRINTS_SCHEMA}").coalesce(1).sortWithinPartitions("key", "node")
    got = {(r.a, r.b) for r in frame.mapInArrow(simhash._leaders, "a long, b long").collect()}
    assert got == {(11, 10), (12, 10), (14, 10)}


def test_long_texts_near_the_threshold(spark):
    """Pairs of long texts just on either side of 0.8; the same words, so the same fingerprints."""
    rnd = random.Random(13)
    docs = []
    for name, swaps in (("p", 55), ("q", 56)):
        words = [f"{name}{k}" for k in range(3000)]
        other = list(words)
        for k in rnd.sample(range(10, 2980, 10), swaps):
            other[k], other[k + 1] = other[k + 1], other[k]
        a, b = " ".join(words), " ".join(other)
        assert (jaccard(shingle_set(a), shingle_set(b)) >= 0.8) == (name == "p")
        docs += [a, b]
    kept = one_of_each(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3]
