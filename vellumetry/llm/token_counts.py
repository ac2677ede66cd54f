"""Exact token counts of every prefix, by dynamic programming over prefixes.

A byte-pair encoding of a prefix ends in one certain piece. So the state of a
prefix is its count and its last piece, and the state of a longer prefix follows
from a shorter one: the last piece is the one piece ending there that the
encoder leaves apart from the last piece before it. Pieces never hold a space
after another character, so a text falls into units that start with its spaces,
each with its own states; units are kept in a bounded cache.

A text's row is, a byte a character, how the count changes from prefix to prefix:
counts, truncations and budgets then need sums only, no encoder. All columns come from it.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few_rows, text_of, worker_state

LIMIT = 4096
#: Units that a worker keeps; the longest unit kept; characters of a text split at a time.
KEPT, LONGEST, SLAB = 2_200_000, 256, 1 << 20
SPACE, APART = "▁", "\n"
#: A word and the marks after it.
TAIL = re.compile(r"([^\W\d_]+)([!-/:-@\[-`{-~]+)")


class PrefixCounter:
    """States of prefixes under a sentencepiece model of kind BPE without normalization rules."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = range(self.lib.get_piece_size())
        pieces = [self.lib.id_to_piece(i) for i in ids if not (self.lib.is_control(i) or self.lib.is_unknown(i) or self.lib.is_byte(i) or self.lib.is_unused(i))]
        if any(APART in p or re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces):
            raise ValueError("pieces cross spaces: units would not be independent")
        #: Pieces that the encoder makes of their own characters; others never occur.
        self.pieces = {p: 1 for p in pieces if self.raw(p) == [p]}
        self.longest = max(map(len, pieces))
        self.apart: dict[tuple[str, str], bool] = {}
        #: Neighbours that some piece holds.
        self.joined = {a + b for p in pieces for a, b in zip(p, p[1:], strict=False)}
        self.units: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}

    def raw(self, s: str) -> list[str]:
        """The pieces of s without the space that the encoder puts before a text."""
        return self.lib.encode(APART + s.replace(SPACE, " "), out_type=str)[2:]

    def stays_apart(self, a: str, b: str) -> bool:
        if (got := self.apart.get((a, b))) is None:
            if len(self.apart) > 4 * KEPT:
                self.apart.clear()
            got = self.apart[a, b] = self.raw(a + b) == self.raw(a) + self.raw(b)
        return got

    def states(self, s: str) -> list[int]:
        """The count of each prefix of a unit, from the empty one on."""
        count, last = [0] * (len(s) + 1), [""] * (len(s) + 1)
        pieces, apart = self.pieces, self.apart
        for end in range(1, len(s) + 1):
            for start in range(end - 1, max(0, end - self.longest) - 1, -1):  # only one fits, and most are short
                piece = s[start:end]
                if (cost := pieces.get(piece)) is None:
                    if start < end - 1:
                        continue
                    cost = len(self.raw(piece))  # a character without a piece: its bytes
                before = last[start]
                if not start or apart.get((before, piece)) or (before, piece) not in apart and self.stays_apart(before, piece):
                    count[end], last[end] = count[start] + cost, piece
                    break
            else:
                return self.slow(s)
        return count

    def slow(self, s: str) -> list[int]:
        return [len(self.raw(s[:k])) for k in range(len(s) + 1)]

    def learn(self, keys: list[str]) -> None:
        """Adds the changes of units (named without their first space), a byte a character; each unit's total is held against the library, which decides all its prefixes where the program differs.

        Marks after a letter part from it where no piece has them together; then the unit's counts are those of
        the unit without them, and theirs on top.
        """
        for key, ids in zip(keys, self.lib.encode([APART + " " + k for k in keys], num_threads=1), strict=True):
            if (m := TAIL.fullmatch(key)) and m[1][-1] + m[2][0] not in self.joined:
                base, tail = m.groups()
                if (own := self.units.get(base)) is None:
                    own = self.units[base] = changes(self.states(SPACE + base))
                if (more := self.tails.get(tail)) is None:
                    more = self.tails[tail] = changes(self.slow(tail))
                own += more
            else:
                own = changes(self.states(SPACE + key.replace(" ", SPACE)))
            if total(own) != len(ids) - 2:
                own = changes(self.slow(SPACE + key.replace(" ", SPACE)))
            self.units[key] = own

    def known(self, keys: list[str]) -> dict[str, bytes]:
        new = {k for k in keys if k not in self.units}
        if new:
            if len(self.units) + len(new) > KEPT:
                self.units.clear()
                self.tails.clear()
                new = set(keys)
            self.learn(list(new))
        return self.units

    def keys(self, text: str) -> Iterator[list[str]]:
        """The units of a text, a slab at a time. The library takes SPACE itself for a space."""
        text = text.replace(SPACE, " ")
        at = 0
        while text and at <= len(text):
            end = at + SLAB
            while end < len(text) and not (text[end] == " " and text[end - 1] != " "):
                end += 1
            slab = text[at:end]
            keys = slab.split(" ")
            yield [u[1:] for u in re.findall(" +[^ ]*", " " + slab)] if "" in keys else keys
            at = end + 1
            if end >= len(text):
                break

    def deltas(self, text: str) -> bytes:
        """A signed byte for the space before the text, then one a character: how much the count changes."""
        out = []
        for keys in self.keys(text):
            out.append(b"".join(map(self.known(keys).__getitem__, keys)))
            if max(map(len, keys)) > LONGEST:
                for k in keys:
                    if len(k) > LONGEST:
                        self.units.pop(k, None)
        return b"".join(out)


def changes(counts: list[int]) -> bytes:
    return array("b", [b - a for a, b in zip(counts, counts[1:], strict=False)]).tobytes()


def total(deltas: bytes) -> int:
    return int(np.frombuffer(deltas, np.int8).sum(dtype=np.int64))


def prefix_counts(deltas: bytes) -> np.ndarray:
    """The count of each prefix, by its characters, from 0 on."""
    counts = np.cumsum(np.frombuffer(deltas, np.int8), dtype=np.int64)
    return np.concatenate([[0], counts[1:]]) if len(counts) else np.zeros(1, np.int64)


def fitting(deltas: bytes, limit: int) -> int:
    """Characters of the longest prefix of at most `limit` tokens."""
    return int(np.flatnonzero(prefix_counts(deltas) <= limit)[-1])


def _counted(model_file: str, limit: int, store: bool):
    def run(batches):
        counter = worker_state(f"prefix-{model_file}", lambda: PrefixCounter(model_file))
        for b in few_rows(batches):
            texts = b.column("text").to_pylist()
            n, fit, deltas = [], [], []
            for t in texts:
                changed = counter.deltas(t)
                n.append(total(changed))
                fit.append(fitting(changed, limit) if n[-1] > limit else len(t))
                deltas.append(changed if store else b"")
            cols = [b.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array(fit, pa.int64()), *([pa.array(deltas, pa.binary())] if store else [])]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "n_tokens", "fit_chars", *(["deltas"] if store else [])])

    return run


def token_counts(df: DataFrame, model_file: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", store: bool = False) -> DataFrame:
    """One row per record: doc_id, n_bytes, n_tokens, fit_chars (longest prefix within limit), and with store=True deltas.

    No shuffle. Null text counts as empty: no bytes, no tokens. Null ids and repeated rows pass through; ids are cast
    to long. Texts of any length are split a slab at a time; their row, a byte a character, must fit in memory. Other
    columns are not read. An empty table gives no rows.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), text_of(df, text_col).alias("text"))
    return docs.mapInArrow(_counted(model_file, limit, store), "doc_id long, n_bytes long, n_tokens long, fit_chars long" + ", deltas binary" * store)
