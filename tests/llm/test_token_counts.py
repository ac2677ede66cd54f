import random

import public_tokenizers
import pytest

from vellumetry.llm.token_counts import PrefixCounter, fitting, prefix_counts, token_counts, total

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def counter():
    return PrefixCounter(MODEL)


def texts():
    rnd = random.Random(1)
    letters = "aeinrst ,.\nÉç日<>s/0 1  \t"
    return ["", " ", "  ", " a", "a  b ", "<s> hi </s>", "日本語 テキスト\n\n x", "é́x ﬁ\x00\t\t  \r", "a" * 700, *("".join(rnd.choices(letters, k=rnd.randint(1, 60))) for _ in range(60))]


def test_every_prefix_is_counted_as_the_library_does(counter):
    for t in texts():
        assert prefix_counts(counter.deltas(t)).tolist() == [len(counter.lib.encode(t[:k])) for k in range(len(t) + 1)], t
        assert total(counter.deltas(t)) == len(counter.lib.encode(t)), t


def test_marks_that_the_library_takes_for_spaces(counter):
    rnd = random.Random(2)
    for letters in ("ab▁ ", "a▁ .,\n\t\x00\x7f", "É▁ é́ﬁ日\u200b\ufeff"):
        for _ in range(1500):
            t = "".join(rnd.choices(letters, k=rnd.randint(0, 12)))
            counts = prefix_counts(counter.deltas(t)).tolist()
            assert counts == [len(counter.lib.encode(t[:k])) for k in range(len(t) + 1)], repr(t)
            for limit in (0, 1, 3):
                assert fitting(counter.deltas(t), limit) == max(k for k, c in enumerate(counts) if c <= limit)


def test_a_full_cache_changes_nothing(counter, monkeypatch):
    import vellumetry.llm.token_counts as module

    monkeypatch.setattr(module, "KEPT", 3)
    for t in texts()[-20:]:
        assert total(counter.deltas(t)) == len(counter.lib.encode(t))


def test_rows(spark, odd, odd_rows, counter):
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in token_counts(odd, MODEL).collect())
    assert got == sorted((i is None, i or 0, len((t or "").encode()), len(counter.lib.encode(t or ""))) for i, t, *_ in odd_rows)


def test_store_and_empty_table(spark, odd, none):
    assert token_counts(none, MODEL).count() == 0
    for r in token_counts(odd, MODEL, limit=10, store=True).collect():
        assert prefix_counts(bytes(r.deltas))[-1] == r.n_tokens and fitting(bytes(r.deltas), 10) == r.fit_chars
