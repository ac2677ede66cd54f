"""Document quality by a linear-chain conditional random field over lines.

Each line is good or bad. Its features, those of the lines before and after it, and
the step from label to label decide. A document's score is the mean of its lines'
probabilities of being good, by forward and backward sums, weighted by the lines'
lengths. Only documents have labels, so lines' labels are latent: the fit maximises the
likelihood of the documents' labels given their scores, and lines of both kinds may stand in one
document.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import few_rows, text_of

#: Labelled documents to learn from at most, those with the least hashes of their id; steps of the fit; its ridge.
SAMPLE, STEPS, RIDGE = 6000, 150, 1e-3
#: How sharply a document's score decides its label; the step of the difference that gives its slope.
SHARP, DELTA = 16.0, 1e-4
UPPER, DIGITS, SYMBOLS, MARKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>{}[]~^=_\\/@+", b"!?"
N = 13


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for each line, and the lines' weights (words, at least one)."""
    rows, weights, seen_lines, seen = [], [], set(), set()
    for line in text.split("\n"):
        words = line.split()
        n, raw = len(words), line.encode()
        size = len(raw) or 1
        three = list(zip(words, words[1:], words[2:], strict=False))
        own = set(three)
        fresh = len(own - seen) if seen else len(own)
        seen |= own
        share = lambda chars, raw=raw, size=size: (len(raw) - len(raw.translate(None, chars))) / size
        symbols = share(SYMBOLS)
        rows.append(
            (
                np.log1p(n),
                len(line) / (n or 1),
                share(UPPER),
                share(DIGITS),
                symbols,
                min(symbols * size / (n or 1), 5.0),
                share(MARKS) * size / (n or 1),
                sum(map(str.isupper, words)) / (n or 1),
                len(set(words)) / (n or 1),
                sum(map(eq, words, words[1:])) / (n or 1),
                1 - fresh / len(three) if three else 0.0,
                float(bool(n) and line in seen_lines),
                float(not n),
            )
        )
        weights.append(n or 1)
        seen_lines.add(line)
    return np.array(rows, np.float32), np.array(weights, np.float64)


def with_neighbours(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each line's features beside those of the lines before and after it in its text (0 where there are none). first: where a text begins."""
    before, after = np.zeros_like(rows), np.zeros_like(rows)
    before[1:] = np.where(first[1:, None], 0, rows[:-1])
    after[:-1] = np.where(first[1:, None], 0, rows[1:])
    edges = np.stack([first, np.append(first[1:], True)], axis=1).astype(rows.dtype)
    return np.concatenate([rows, before, after, edges], axis=1)


@dataclass
class Chain:
    """Weights: of features, for good over bad; of steps, from label to label (0 bad, 1 good)."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    step: np.ndarray

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.scale) @ self.weight + self.bias, -30, 30)


def marginals(odds: np.ndarray, step: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Probability of good for each line; expected counts of steps; log of the sum over all labellings. sizes: lines of each text.

    All texts go together, longest first: the texts that still have a line at some step are the first so many.
    """
    start = np.cumsum(sizes) - sizes
    by = np.argsort(-sizes, kind="stable")
    start, sizes = start[by], sizes[by]
    longest = int(sizes[0]) if len(sizes) else 0
    live = np.searchsorted(-sizes, -np.arange(longest), "left")  # texts with more lines than t
    emit = np.stack([np.zeros_like(odds), odds], axis=1)
    emit -= emit.max(axis=1, keepdims=True)
    total = float(np.maximum(odds, 0).sum())
    emit, move = np.exp(emit), np.exp(step - step.max())
    total += step.max() * float((sizes - 1).sum())
    forward, back, norm = np.zeros_like(emit), np.ones_like(emit), np.ones(len(odds))
    for t in range(longest):
        at = start[: live[t]] + t
        f = emit[at] * (forward[at - 1] @ move if t else 0.5)
        norm[at] = f.sum(axis=1)
        forward[at] = f / norm[at][:, None]
    total += float(np.log(norm).sum()) + len(sizes) * np.log(2)
    for t in range(longest - 2, -1, -1):
        at = start[: live[t + 1]] + t
        back[at] = (emit[at + 1] * back[at + 1]) @ move.T / norm[at + 1][:, None]
    both = forward * back
    good = both[:, 1] / both.sum(axis=1)
    later = np.ones(len(odds), bool)
    later[start] = False
    j = np.flatnonzero(later)
    pair = forward[j - 1][:, :, None] * move[None] * (emit[j] * back[j])[:, None, :] / norm[j][:, None, None]
    return good, pair.sum(axis=0), total


def fit(x: np.ndarray, y: np.ndarray, sizes: np.ndarray, weight: np.ndarray | None = None, steps: int = STEPS) -> Chain:
    """Maximum likelihood of the documents' labels y, by Adam over all lines. sizes: lines of each document; weight: of each line.

    A document's score s is the weighted mean of its lines' marginals, and it is good with the logistic
    probability of SHARP (2 s - 1). The slope of s by the lines' odds and the steps is the covariance of the labels
    with their weighted sum: the difference of the marginals when all odds move by their weights.
    """
    weight = np.ones(len(x)) if weight is None else weight
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(3 * N + 2), np.ones(3 * N + 2))
    z = (x - mean) / scale
    k = z.shape[1]
    theta, m, v = np.zeros(k + 5), np.zeros(k + 5), np.zeros(k + 5)
    start = np.cumsum(sizes) - sizes
    part = weight / np.repeat(np.add.reduceat(weight, start), sizes) if len(x) else weight
    for i in range(1, steps + 1 if len(y) else 1):
        odds, step = np.clip(z @ theta[:k] + theta[k], -30, 30), theta[k + 1 :].reshape(2, 2)
        good, _, _ = marginals(odds, step, sizes)
        score = np.add.reduceat(good * part, start)
        gap = y - 1 / (1 + np.exp(-SHARP * (2 * score - 1)))  # slope of the likelihood by SHARP (2 s - 1)
        pull = np.repeat(gap * sizes, sizes) * part  # documents count by their lines
        up, pairs_up, _ = marginals(odds + DELTA * pull, step, sizes)
        down, pairs_down, _ = marginals(odds - DELTA * pull, step, sizes)
        line, pair = SHARP * (up - down) / DELTA, SHARP * (pairs_up - pairs_down) / DELTA
        grad = -np.concatenate([z.T @ line, [line.sum()], pair.ravel()]) / len(x) + RIDGE * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta -= 0.1 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-9)
    return Chain(mean, scale, theta[:k], float(theta[k]), theta[k + 1 :].reshape(2, 2))


def _features(batches):
    for b in few_rows(batches):
        made = [line_features(t) for t in b.column("text").to_pylist()]
        rows, weights = (pa.array([m[i].tobytes() for m in made], pa.binary()) for i in range(2))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), rows, weights], names=["doc_id", "y", "features", "weights"])


def held_out(df: DataFrame, id_col: str = "doc_id") -> Column:
    """The fold that is never learned from: crc32 of the id as text, modulo 3, is 1. Null ids are in no fold."""
    return F.coalesce(F.crc32(df[id_col].cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Chain:
    """Fits to at most `sample` labelled documents outside the held-out fold: those whose ids hash least.

    Their line features reach the driver, 60 bytes a line. Without labelled documents all weights are 0. Null ids,
    labels of null and labels of documents that are not there are left out; of several labels of an id the higher
    counts; records that share an id are learned from each, as are repeated rows.
    """
    known = labels.select(labels["doc_id"].cast("long").alias("_id"), labels["quality"].cast("int").alias("y")).filter("_id is not null and y is not null").groupBy("_id").agg(F.max("y").alias("y"))
    known = known.filter(~held_out(known, "_id")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), text_of(df, text_col).alias("text"))
    chosen = docs.join(F.broadcast(known), docs["doc_id"] == known["_id"]).select("doc_id", "text", "y")
    rows = chosen.mapInArrow(_features, "doc_id long, y int, features binary, weights binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["weights"]), bytes(r["features"])))
    if not rows:
        return fit(np.zeros((0, 3 * N + 2)), np.zeros(0), np.zeros(0, np.int64))
    weight = [np.frombuffer(r["weights"], np.float64) for r in rows]
    sizes, flat = np.array([len(w) for w in weight]), np.concatenate([np.frombuffer(r["features"], np.float32).reshape(-1, N) for r in rows])
    first = np.zeros(len(flat), bool)
    first[np.cumsum(sizes) - sizes] = True
    return fit(with_neighbours(flat, first).astype(np.float64), np.array([float(r["y"] > 0) for r in rows]), sizes, np.concatenate(weight))


def _scored(chain: Chain):
    def run(batches):
        for b in few_rows(batches, 2000, 8 << 20):
            made = [line_features(t) for t in b.column("text").to_pylist()]
            sizes = np.array([len(w) for _, w in made])
            flat, weight = np.concatenate([r for r, _ in made]), np.concatenate([w for _, w in made])
            start = np.cumsum(sizes) - sizes
            first = np.zeros(len(flat), bool)
            first[start] = True
            good, _, _ = marginals(chain.odds(with_neighbours(flat, first)), chain.step, sizes)
            score = np.clip(np.add.reduceat(good * weight, start) / np.add.reduceat(weight, start), 0, 1)
            bad = np.add.reduceat((good < 0.5).astype(np.int64), start)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in b.schema.names if c != "text"), pa.array(score), pa.array(sizes.astype(np.int64)), pa.array(bad)], names=[*(c for c in b.schema.names if c != "text"), "score", "n_lines", "n_bad_lines"])

    return run


def scores(df: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per record: doc_id, held_out, score (0 to 1, higher: better), n_lines, n_bad_lines, predicted (1 if score >= 0.5).

    Null text is one empty line; so is an empty one. Null ids and repeated rows pass through, ids are cast to long. A
    text's time and memory grow with its lines and words. An empty table gives no rows. No shuffle.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), held_out(df, id_col).alias("held_out"), text_of(df, text_col).alias("text"))
    got = docs.mapInArrow(_scored(chain), "doc_id long, held_out boolean, score double, n_lines long, n_bad_lines long")
    return got.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accepted(df: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """df without the records that are predicted bad; columns as they were. Nulls, long texts and empty tables as in scores."""

    def run(batches):
        score = _scored(chain)
        for b in few_rows(batches, 2000, 8 << 20):
            texts = b.column(text_col).to_pylist()
            only = pa.RecordBatch.from_arrays([pa.array(["" if t is None else t for t in texts], pa.string())], names=["text"])
            keep = np.concatenate([x.column("score").to_numpy() for x in score([only])] or [np.zeros(0)]) >= 0.5
            yield b.filter(pa.array(keep))

    return df.mapInArrow(run, df.schema)
