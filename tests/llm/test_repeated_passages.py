import hashlib
import random

import numpy as np
import pytest

import vellumetry.llm.repeated_passages as R


def brute(rows):
    seen = {}
    known = sorted(((i, (t or "").encode()) for i, t in rows), key=lambda r: (r[0] is None, r[0] or 0))
    for i, b in known:
        for p in range(len(b) - R.LENGTH + 1):
            seen.setdefault(b[p : p + R.LENGTH], R.LAST if i is None else i)
    out = []
    for i, b in known:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - R.LENGTH + 1):
            if seen[b[p : p + R.LENGTH]] < (R.LAST if i is None else i):
                gone[p : p + R.LENGTH] = True
        runs = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


def got(frame):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in R.without_repeats(frame).collect()), key=repr)


def case(seed, letters):
    rnd = random.Random(seed)
    pool = ["".join(rnd.choices(letters, k=rnd.randint(40, 140))) for _ in range(12)]
    docs = []
    for i in range(70):
        parts = [rnd.choice(pool) if rnd.random() < 0.5 else "".join(rnd.choices(letters, k=rnd.randint(0, 90))) for _ in range(rnd.randint(0, 6))]
        docs.append((rnd.randrange(60), "".join(parts)))
    return [*docs, (None, pool[0] * 2), (None, pool[0] * 2), (61, None), (62, ""), (63, docs[0][1]), (64, "é" * 80), (65, "é" * 90), (66, "\0" * 120), (67, "\0" * 60)]


@pytest.mark.parametrize(("seed", "letters"), [(1, "abcdefghij klmn"), (2, "ab"), (3, "aéß\0\n")])
def test_against_brute_force(spark, seed, letters):
    rows = case(seed, letters)
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute(rows)


def test_small_chunks_and_slices_give_the_same(spark, monkeypatch):
    rows = case(4, "abcdef gh")
    monkeypatch.setattr(R, "CHUNK", 300)
    monkeypatch.setattr(R, "SLICE_BITS", 9)
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_column_wise_order():
    rnd = np.random.default_rng(3)
    text = rnd.integers(97, 99, (60, R.FRAME)).astype(np.uint8)
    text[30:, :60] = text[:30, :60]
    first, last = np.zeros(60, np.uint8), np.full(60, R.REACH - 1, np.uint8)
    doc = rnd.integers(0, 9, 60)
    lo, hi = R.earlier(text, first, last, doc)
    for i in range(60):
        cols = [c for c in range(R.REACH) if any(doc[j] < doc[i] and (text[j, c : c + R.LENGTH] == text[i, c : c + R.LENGTH]).all() for j in range(60))]
        assert (lo[i], hi[i]) == ((cols[0], cols[-1]) if cols else (R.FRAME, -1))


def test_odd_rows_and_kept_bytes(spark, odd, odd_rows, none):
    assert got(odd) == brute([(r[0], r[1]) for r in odd_rows])
    assert R.without_repeats(none).count() == 0
    for r in R.without_repeats(odd, keep=True).collect():
        assert hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed
