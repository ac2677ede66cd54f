"""Rules on repetition within a text, by a suffix array over its words.

Suffixes are ordered by prefix doubling, for a batch of texts at once; the
longest common prefixes of neighbours in that order give, for every place, the
longest string of words that stands elsewhere in the text too. The union of such
strings of at least WINDOW words, as a share of the words, and the longest one
are limited.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few_rows, text_of

WINDOW = 5
MIN_WORDS, MAX_SHARE, MAX_LONGEST = 10, 0.20, 50
SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\x0b\x0c\r"


def repeats(words: np.ndarray, text_no: np.ndarray) -> np.ndarray:
    """For each place of the concatenated texts, the words of the longest string that starts there and stands elsewhere in the same text.

    words: an integer a word; text_no: ascending, the text of each.
    """
    n = len(words)
    if not n:
        return np.zeros(0, np.int64)
    end = np.searchsorted(text_no, text_no, "right")  # of each place's text
    key = text_no.astype(np.int64) * (int(words.max()) + 1) + words
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    first = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    by_word, undo, step = rank.astype(np.int32), [], 1  # of each doubling, the places it ranked and their ranks before

    def shared(ranks: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Of these places, those whose rank another place has."""
        size = np.bincount(ranks[which], minlength=n)
        return which[size[ranks[which]] > 1]

    active = shared(rank, np.arange(n))
    while len(active):
        ahead = active + step
        follow = np.where(ahead < end[active], rank[np.minimum(ahead, n - 1)] + 1, 0)
        by = np.lexsort((follow, rank[active]))
        places, heads, tails = active[by], rank[active][by], follow[by]
        new_head = np.concatenate([[True], heads[1:] != heads[:-1]])
        new = new_head | np.concatenate([[True], tails[1:] != tails[:-1]])
        at = np.arange(len(places))
        undo.append((places.astype(np.int32), heads.astype(np.int32)))
        rank[places] = heads + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(new_head, at, 0))
        active, step = shared(rank, active), step * 2
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    a, b = suffixes[:-1], suffixes[1:]
    pair = np.flatnonzero(by_word[a] == by_word[b])
    a, b = a[pair], b[pair]
    common = np.zeros(len(pair), np.int64)
    for level in range(len(undo), -1, -1):
        x, y = a + common, b + common
        inside = (x < end[a]) & (y < end[b])
        same = inside & (rank[np.minimum(x, n - 1)] == rank[np.minimum(y, n - 1)])
        common += np.where(same, 1 << level, 0)
        if level:
            places, before = undo.pop()
            rank[places] = before
    out = np.zeros(n, np.int64)
    np.maximum.at(out, a, common)
    np.maximum.at(out, b, common)
    return out


def covered(length: np.ndarray, least: int) -> np.ndarray:
    """The places that a string of at least `least` words covers."""
    start = np.flatnonzero(length >= least)
    edge = np.bincount(start, minlength=len(length) + 1) - np.bincount(start + length[start], minlength=len(length) + 1)
    return np.cumsum(edge[:-1]) > 0


def _measured(batches):
    for b in few_rows(batches, 2000, 4 << 20):
        texts = b.column("text").to_pylist()
        raw = [t.encode() for t in texts]
        split = [r.split() for r in raw]
        counts = np.array([len(w) for w in split], np.int64)
        ids = pd.factorize(np.array([w for ws in split for w in ws], object))[0]
        text_no = np.repeat(np.arange(len(texts)), counts)
        length = repeats(ids, text_no)
        inside = covered(length, WINDOW)
        repeated = np.bincount(text_no, weights=inside, minlength=len(texts)).astype(np.int64)
        longest = np.zeros(len(texts), np.int64)
        np.maximum.at(longest, text_no, length)
        rows = []
        for t, r in zip(texts, raw, strict=True):
            lines = [x for x in t.split("\n") if x.strip(BLANKS.decode())]
            rows.append((len(t) - len(r) + len(r.translate(None, BLANKS)), len(r) - len(r.translate(None, SYMBOLS)), len(lines) - len(set(lines))))
        chars, symbols, lines = (np.array(c, np.int64) for c in (zip(*rows, strict=True) if rows else ((), (), ())))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, (counts, chars, symbols, lines, repeated, longest))], names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "longest_repeat"])


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_share: float = MAX_SHARE, max_longest: int = MAX_LONGEST) -> DataFrame:
    """One row per record: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, longest_repeat, base_failed, kept.

    n_repeat_words is the union of all strings of WINDOW or more words found twice in the text. kept needs
    base_failed false, the union at most max_share of the words and longest_repeat at most max_longest words.
    Null text is empty and fails for its few words. Null ids and repeated rows pass through, ids are cast to long; no
    shuffle. A text of n words takes about 100 n bytes, and 8 more for each doubling in which a word still has a
    twin: under 300 n for a text of a million times the same word. An empty table gives no rows.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), text_of(df, text_col).alias("text"))
    got = docs.mapInArrow(_measured, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, longest_repeat long")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return got.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("n_repeat_words") <= max_share * F.col("n_words")) & (F.col("longest_repeat") <= max_longest))
