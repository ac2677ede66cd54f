import math
import random
import re
import time

from vellumetry.llm.licenses import PHRASES, TEMPLATES, blocks_of, license_scan, ordered, phrase_places, words_of


def slow_words(t):
    return [w.encode() for w in re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))]


def slow(i, t):
    w = slow_words(t)
    places = [(k, label) for phrase, label in PHRASES.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.encode().split()]
    labels, score = {x for _, x in places}, float(bool(places))
    for label, kind, least, text in TEMPLATES:
        want = set(slow_words(text))
        for block in blocks_of(t or "")[kind]:
            hits = len(want & set(slow_words(block)))
            if hits >= math.ceil(round(least * len(want), 9)):
                labels.add(label)
                score = max(score, hits / len(want))
    at = [k for k, _ in places]
    return (i, len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})), ",".join(sorted(labels)), score)


def test_against_brute_force(spark, odd, odd_rows, none):
    rnd = random.Random(1)
    docs = [(300, "Released under the MIT License.\nMIT license mit license"), (301, "apache license-apache\nLICENSE cc by cc-by")]
    for k in range(60):
        w = rnd.choice(TEMPLATES)[3].split()
        for _ in range(rnd.randint(0, len(w) // 3)):
            w[rnd.randrange(len(w))] = rnd.choice(["other", "words", ""])
        for _ in range(rnd.randint(0, 3)):
            w.insert(rnd.randrange(len(w)), "\n")
        docs.append((310 + k, "Before.\n" * rnd.randint(0, 1) + " ".join(w) + "\n\nAfter."))
    frame = odd.select("doc_id", "text").unionByName(spark.createDataFrame(docs, "doc_id long, text string"))
    got = license_scan(frame).collect()
    want = [slow(r[0], r[1]) for r in odd_rows] + [slow(*d) for d in docs]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert sum(bool(r.labels) for r in got) > 20 and license_scan(none).count() == 0


def test_filters_lose_nothing():
    rnd = random.Random(2)
    for t in ordered(TEMPLATES, {w: rnd.randint(0, 9) for x in TEMPLATES for w in words_of(x[3])}):
        for _ in range(200):
            block = set(rnd.sample(t.order, rnd.randint(0, len(t.order)))) | {b"x", b"y"}
            hits = len(block & set(t.order))
            assert t.share(block) == (hits / len(t.order) if hits >= t.need else 0.0)


def test_places_may_share_a_border():
    assert phrase_places(words_of("mit license mit license"), PHRASES)[0] == [(0, "mit"), (2, "mit")]


def test_many_places_in_linear_time():
    words = b"mit license x ".split() * 100_000
    start = time.perf_counter()
    places, n = phrase_places(words, PHRASES)
    assert places == [(3 * k, "mit") for k in range(100_000)] and n == 300_000 and time.perf_counter() - start < 5


def test_texts_of_more_licenses(spark):
    texts = {label: text for label, kind, _, text in TEMPLATES if kind == "paragraph"}
    docs = [(i, f"Intro.\n\n{t}\n \t\r\nMore.") for i, t in enumerate(texts.values())]
    got = {r.doc_id: r.labels.split(",") for r in license_scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(label in got[i] for i, label in enumerate(texts))
