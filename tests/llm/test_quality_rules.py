import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from vellumetry.llm.quality_rules import quality_rules, repeats


def slow_repeats(t):
    out = []
    for i in range(len(t)):
        best = 0
        for j in range(len(t)):
            n = 0
            while j != i and max(i, j) + n < len(t) and t[i + n] == t[j + n]:
                n += 1
            best = max(best, n)
        out.append(best)
    return out


@settings(deadline=None, max_examples=60)
@given(st.lists(st.lists(st.integers(0, 3), max_size=25), max_size=5))
def test_suffix_array(texts):
    words = np.array([w for t in texts for w in t], np.int64)
    no = np.repeat(np.arange(len(texts)), [len(t) for t in texts]) if texts else np.zeros(0, np.int64)
    assert repeats(words, no).tolist() == [n for t in texts for n in slow_repeats(t)]


def slow(i, text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    n = slow_repeats(w)
    inside = {p for s, k in enumerate(n) if k >= 5 for p in range(s, s + k)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 10 or 100 * len(inside) > 20 * len(w)
    return (i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside), max(n, default=0), failed, not failed and max(n, default=0) <= 50)


def test_rows(spark, odd, odd_rows, none):
    rnd = random.Random(1)
    block = [f"b{k}" for k in range(60)]
    extra = [(200, " ".join(rnd.choices("ab", k=200))), (201, "same line\nsame line\n\n \nother #*$"), (202, " ".join(block + [f"u{k}" for k in range(600)] + block))]
    frame = spark.createDataFrame(extra, "doc_id long, text string")
    rows = [r for r in odd_rows if r[1] is None or len(r[1]) < 9000]
    got = quality_rules(odd.filter("text is null or length(text) < 9000").select("doc_id", "text").unionByName(frame)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([slow(r[0], r[1]) for r in rows] + [slow(*r) for r in extra], key=repr)
    assert quality_rules(odd).count() == len(odd_rows) and quality_rules(none).count() == 0
    assert next(r for r in got if r.doc_id == 202).kept is False
