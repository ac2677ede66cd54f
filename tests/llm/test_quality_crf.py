import itertools
import random

import numpy as np

from vellumetry.llm.quality_crf import accepted, fit, learn, line_features, marginals, scores, with_neighbours


def test_marginals_against_all_labellings():
    rnd = np.random.default_rng(1)
    sizes, step = np.array([3, 1, 4]), rnd.normal(size=(2, 2))
    odds = rnd.normal(size=8)
    good, pairs, total = marginals(odds, step, sizes)
    at, want_pairs, want_total = 0, np.zeros((2, 2)), 0.0
    for n in sizes:
        weights = {y: np.exp(sum(o for o, k in zip(odds[at : at + n], y, strict=True) if k) + sum(step[a, b] for a, b in zip(y, y[1:], strict=False))) for y in itertools.product((0, 1), repeat=int(n))}
        z = sum(weights.values())
        for t in range(n):
            assert abs(good[at + t] - sum(w for y, w in weights.items() if y[t]) / z) < 1e-9
        for y, w in weights.items():
            for a, b in zip(y, y[1:], strict=False):
                want_pairs[a, b] += w / z
        want_total += np.log(z)
        at += n
    assert np.allclose(pairs, want_pairs) and abs(total - want_total) < 1e-9


def test_neighbours_stay_in_their_text():
    x = with_neighbours(np.array([[1.0], [2.0], [3.0]]), np.array([True, False, True]))
    assert x[:, :3].tolist() == [[1, 0, 2], [2, 1, 0], [3, 0, 0]] and x[:, 3:].tolist() == [[1, 0], [0, 1], [1, 1]]


def test_fit_separates():
    x, y = np.array([[0.0, 1], [0.2, 1], [3, 1], [2.8, 1]]), np.array([1.0, 0.0])
    chain = fit(x, y, np.array([2, 2]))
    assert (chain.odds(x) > 0).tolist() == [True, True, False, False]


def test_lines_of_mixed_documents_are_told_apart():
    """Only documents have labels: bad where most lines are junk. The junk lines are found all the same."""
    rnd = random.Random(5)

    def line(junk):
        words = [f"{rnd.choice('abcde')}{rnd.randrange(300)}" for _ in range(rnd.randint(8, 16))]
        return " ".join(w + "%%%" for w in words) if junk else " ".join(words)

    texts, y, marks = [], [], []
    for i in range(400):
        n, bad = rnd.randint(4, 12), i % 3 == 0
        k = rnd.randint(n * 6 // 10, n - 1) if bad else rnd.randint(0, n * 3 // 10)
        at = rnd.randint(0, n - k)
        marks.append([at <= j < at + k for j in range(n)])
        texts.append("\n".join(line(j) for j in marks[-1]))
        y.append(float(not bad))
    made = [line_features(t) for t in texts]
    sizes, weight = np.array([len(w) for _, w in made]), np.concatenate([w for _, w in made])
    flat, first = np.concatenate([r for r, _ in made]), np.zeros(sum(len(w) for _, w in made), bool)
    first[np.cumsum(sizes) - sizes] = True
    x, seen = with_neighbours(flat, first).astype(float), sizes[:250].sum()
    chain = fit(x[:seen], np.array(y[:250]), sizes[:250], weight[:seen])
    good, _, _ = marginals(chain.odds(x[seen:]), chain.step, sizes[250:])
    assert ((good < 0.5) == np.concatenate(marks[250:])).mean() > 0.95


def corpus(spark, n=240):
    rnd = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        words = [f"{rnd.choice('abcde')}{rnd.randrange(300)}" for _ in range(60)]
        if i % 4 == 0:
            words = [w + "%%%" for w in words]
        rows.append((i, "\n".join(" ".join(words[k : k + 12]) for k in range(0, 60, 12)), i))
        labels.append((i, int(i % 4 != 0), 0))
    return spark.createDataFrame(rows, "doc_id long, text string, score long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    got = {r.doc_id: r for r in scores(docs, learn(docs, labels)).collect()}
    held = [i for i, r in got.items() if r.held_out]
    assert len(held) > 40 and all(got[i].predicted == int(i % 4 != 0) for i in held)


def test_labels_of_the_held_out_fold_do_not_matter(spark):
    docs, labels = corpus(spark, 120)
    held = [r.doc_id for r in scores(docs, learn(docs, labels)).filter("held_out").collect()]
    turned = labels.withColumn("quality", labels.quality * 0 + 1).filter(labels.doc_id.isin(held)).unionByName(labels.filter(~labels.doc_id.isin(held)))
    a, b = learn(docs, labels), learn(docs, turned)
    assert np.array_equal(a.weight, b.weight) and a.bias == b.bias


def test_odd_rows(spark, odd, odd_rows, none):
    chain = learn(odd, spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, quality int"))
    got = scores(odd, chain).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    kept = accepted(odd, chain)
    assert kept.columns == odd.columns and kept.count() == sum(r.predicted for r in got)
    assert scores(none, chain).count() == 0 and accepted(none, chain).count() == 0


def test_without_labels_nothing_is_rejected(spark, odd, odd_rows):
    chain = learn(odd, spark.createDataFrame([], "doc_id long, quality int"))
    assert accepted(odd, chain).count() == len(odd_rows)


def test_empty_text_is_a_line():
    rows, weight = line_features("")
    assert len(rows) == 1 and weight.tolist() == [1]
