"""Removal of passages that an earlier document has, by column-wise construction.

A byte goes if a LENGTH-byte string that covers it also starts in a document with a
smaller id. The search is exact and moves little:

1. Documents are packed into chunks of a few MB.
2. Each string has an anchor: the place in it where the hash of GRAM bytes is least, the
   first of equals. Equal strings have equal anchors at equal offsets, so an anchor whose
   hash no other document has needs no further look. Chunks send their distinct hashes, six
   bytes each, to the hash's bucket, and are told which ones others have too.
3. Of such anchors, chunks send the text around them, in a frame aligned at the anchor, once
   for equal frames with the least id. Whatever else has that frame in the chunk goes.
4. A bucket builds its frames' order column by column, from the last one to the first:
   each round puts one symbol before every suffix and keeps the order of the suffixes and
   the common prefixes of neighbours. As only equal offsets to the anchor can match, a round
   needs the order of its own column, not of all rounds merged into one file. Where
   neighbours share LENGTH symbols, the class's least id decides.
5. Chunks cut what is told to them.

A frequent passage costs one hash and a frame or two a chunk, so no bucket gets a row for each copy.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few_rows, text_of, written

LENGTH, GRAM = 50, 20
#: Starts that can share an anchor; bytes of a frame.
REACH = LENGTH - GRAM + 1
FRAME = LENGTH + REACH - 1
#: Bytes of text in a chunk and, about, of text for a bucket.
CHUNK, BUCKET = 4 << 20, 12 << 20
#: Stands for a null id: after all others.
LAST = (1 << 63) - 1
SLICE_BITS = 22


def packed(blob: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(blob)


def unpacked(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def gram_hashes(buf: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each place on, from hashes of half as many."""
    h = buf.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(31)
    by_size, size = {1: h}, 1
    while 2 * size <= GRAM:
        by_size[2 * size] = _beside(by_size[size], size, by_size[size], size)
        size *= 2
    out = by_size[size]
    for more in sorted(by_size, reverse=True):
        if size + more <= GRAM:
            out, size = _beside(out, size, by_size[more], more), size + more
    out = out ^ out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ out >> np.uint64(32)


def _beside(a: np.ndarray, size: int, b: np.ndarray, more: int) -> np.ndarray:
    return a[: len(b) - size] * np.uint64(pow(0x5851F42D4C957F2D, more, 1 << 64)) + b[size:] if len(b) > size else a[:0]


def anchors(buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first start, last start, anchor, hash) of the runs of starts that share an anchor; texts end at `ends`."""
    parts, step = [], (1 << SLICE_BITS) - FRAME
    for at in range(0, max(1, len(buf)), step):
        piece = buf[at : at + step + LENGTH - 1]
        if len(piece) < LENGTH:
            continue
        h = gram_hashes(piece)
        key = h & np.uint64(~((1 << SLICE_BITS) - 1) & (1 << 64) - 1) | np.arange(len(h), dtype=np.uint64)
        size = 1
        while 2 * size <= REACH:
            key = np.minimum(key[: len(key) - size], key[size:])
            size *= 2
        key = np.minimum(key[: len(key) - (REACH - size)], key[REACH - size :])
        place = (key & np.uint64((1 << SLICE_BITS) - 1)).astype(np.int64)
        start = np.arange(len(place)) + at
        text = np.searchsorted(ends, start, "right")
        whole = start + LENGTH <= ends[np.minimum(text, len(ends) - 1)]
        start, place, text = start[whole], place[whole], text[whole]
        if not len(start):
            continue
        new = np.concatenate([[True], (place[1:] != place[:-1]) | (text[1:] != text[:-1])])
        heads = np.flatnonzero(new)
        tails = np.concatenate([heads[1:], [len(start)]]) - 1
        parts.append((start[heads], start[tails], place[heads] + at, h[place[heads]]))
    if not parts:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def frames(buf: np.ndarray, first: np.ndarray, last: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frames around anchors, 0 outside the runs' strings, and the first and last column where a string starts."""
    left = place - (REACH - 1)
    at = left[:, None] + np.arange(FRAME)
    inside = (at >= first[:, None]) & (at < last[:, None] + LENGTH)
    return np.where(inside, buf[np.clip(at, 0, len(buf) - 1)], 0).astype(np.uint8), (first - left).astype(np.uint8), (last - left).astype(np.uint8)


def distinct_frames(text: np.ndarray, first: np.ndarray, last: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that puts equal frames together, least id first, and where a new frame begins in it."""
    wide = np.ascontiguousarray(text).view(np.uint64)
    mark = np.zeros(len(text), np.uint64)
    for column in wide.T:
        mark = (mark ^ column) * np.uint64(0x9E3779B97F4A7C15)
        mark ^= mark >> np.uint64(32)
    order = np.lexsort((doc, last, first, mark))
    rows = text[order]
    new = np.ones(len(order), bool)
    new[1:] = (rows[1:] != rows[:-1]).any(axis=1) | (first[order][1:] != first[order][:-1]) | (last[order][1:] != last[order][:-1])
    return order, new


def earlier(text: np.ndarray, first: np.ndarray, last: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each frame the first and last column at which a string starts that a frame of a smaller id has too; first > last for none.

    Column by column from the right. order: the suffixes in order; common: the symbols that each shares with
    the one before it. A symbol put before all suffixes sorts them anew, stably; neighbours with the same
    symbol share one more than the least common value between their old places.
    """
    n = len(text)
    order, common = np.arange(n), np.zeros(n, np.uint8)
    lo, hi = np.full(n, FRAME), np.full(n, -1)
    levels = [np.zeros(n, np.uint8) for _ in range(max(1, n.bit_length()))]
    for column in range(FRAME - 1, -1, -1):
        symbol = text[order, column]
        by = np.argsort(symbol, kind="stable")
        levels[0] = common
        for j in range(1, len(levels)):
            half = 1 << j - 1
            levels[j] = np.minimum(levels[j - 1][: max(0, len(levels[j - 1]) - half)], levels[j - 1][half:])
        least = np.zeros(n, np.uint8)
        a, b = by[:-1], by[1:]
        same = np.flatnonzero(symbol[a] == symbol[b])
        a, b = a[same] + 1, b[same]  # old places a..b; within a symbol they ascend
        level = np.frexp((b - a + 1).astype(float))[1] - 1
        got = np.empty(len(a), np.uint8)
        for j in np.unique(level):
            which = level == j
            got[which] = np.minimum(levels[j][a[which]], levels[j][b[which] - (1 << j) + 1])
        least[same + 1] = got + 1
        order, common = order[by], least
        if column < REACH:
            heads = np.flatnonzero(common < LENGTH)
            starts = (first <= column) & (column <= last)
            owner = np.where(starts, doc, LAST)[order]
            best = np.minimum.reduceat(owner, heads) if n else owner
            best = np.repeat(best, np.diff(np.append(heads, n)))
            gone = order[(best < doc[order]) & starts[order]]
            lo[gone] = np.minimum(lo[gone], column)
            hi[gone] = np.maximum(hi[gone], column)
    return lo, hi


def _pack(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Chunks: id, then document ids, ends of texts and bytes, compressed."""
    part, n = TaskContext.get().partitionId(), 0
    ids, texts, size = [], [], 0

    def row():
        body = np.cumsum([len(t) for t in texts], dtype=np.int64).tobytes() + b"".join(texts)
        known = np.array([LAST if i is None else i for i in ids], np.int64).tobytes()
        null = np.array([i is None for i in ids], np.uint8).tobytes()
        return pa.RecordBatch.from_arrays([pa.array([part << 32 | n], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([packed(known + null + body)], pa.binary())], names=["chunk", "n", "body"])

    for b in few_rows(batches, 500, 1 << 20):
        for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            raw = t.encode()
            if texts and size + len(raw) > limit:
                yield row()
                ids, texts, size, n = [], [], 0, n + 1
            ids.append(i)
            texts.append(raw)
            size += len(raw)
    if ids:
        yield row()


def _open(n: int, body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids (null as LAST), which are null, ends of texts, bytes."""
    raw = unpacked(body)
    return np.frombuffer(raw, np.int64, n), np.frombuffer(raw, np.uint8, n, 8 * n), np.frombuffer(raw[9 * n : 17 * n], np.int64), np.frombuffer(raw, np.uint8, offset=17 * n)


def six(h: np.ndarray) -> np.ndarray:
    """The high six bytes of hashes."""
    return h >> np.uint64(16)


def _six_bytes(h: np.ndarray) -> bytes:
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "chunk", "blob"])


MESSAGE = "bucket int, chunk long, blob binary"


def _hashes(buckets: int):
    """What step 2 sends."""

    def run(batches):
        for b in few_rows(batches, 1):
            for chunk, n, body in zip(*(b.column(c).to_pylist() for c in ("chunk", "n", "body")), strict=True):
                ids, _, ends, buf = _open(n, body)
                h = np.unique(six(anchors(buf, ends)[3]))
                at = (h % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(at, kind="stable")
                cut = np.searchsorted(at[order], np.arange(buckets + 1))
                yield _rows([(k, chunk, _six_bytes(h[order[cut[k] : cut[k + 1]]])) for k in range(buckets) if cut[k + 1] > cut[k]])

    return run


def _whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[int], list[bytes]]]:
    """Bucket, chunks and blobs; a task's rows are sorted by bucket."""
    at, chunks, blobs = None, [], []
    for b in batches:
        for k, c, x in zip(*(b.column(c).to_pylist() for c in ("bucket", "chunk", "blob")), strict=True):
            if k != at:
                if chunks:
                    yield at, chunks, blobs
                at, chunks, blobs = k, [], []
            chunks.append(c)
            blobs.append(x)
    if chunks:
        yield at, chunks, blobs


def _shared(batches):
    """Step 2's answers: to each chunk those of its hashes that another chunk has too."""
    for bucket, chunks, blobs in _whole_buckets(batches):
        lists = [_from_six(x) for x in blobs]
        every = np.sort(np.concatenate(lists))
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        out = []
        for c, h in zip(chunks, lists, strict=True):
            mine = h[np.isin(h, twice, assume_unique=True)]
            if len(mine):
                out.append((bucket, c, _six_bytes(mine)))
        yield _rows(out)


def _frames(buckets: int):
    """Step 3: frames to buckets; to the chunk itself (bucket -1 - k) what is known here to go."""

    def run(batches):
        for b in few_rows(batches, 1):
            for chunk, n, body, told in zip(*(b.column(c).to_pylist() for c in ("chunk", "n", "body", "told")), strict=True):
                ids, _, ends, buf = _open(n, body)
                first, last, place, h = anchors(buf, ends)
                short, doc = six(h), ids[np.searchsorted(ends, first, "right")]
                order = np.lexsort((doc, short))
                s, d = short[order], doc[order]
                heads = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
                many = s[heads][np.minimum.reduceat(d, heads) < np.maximum.reduceat(d, heads)] if len(s) else s
                hot = np.flatnonzero(np.isin(short, np.concatenate([many, *(_from_six(x) for x in told or [])])))
                if not len(hot):
                    continue
                first, last, place, short, doc = first[hot], last[hot], place[hot], short[hot], doc[hot]
                text, c1, c2 = frames(buf, first, last, place)
                order, new = distinct_frames(text, c1, c2, doc)
                group = np.cumsum(new) - 1
                rep = order[new]
                here = doc[order] > doc[rep][group]
                same, own = order[~here], group[~here]  # a frame may stand in its least document more than once
                times = np.bincount(own, minlength=len(rep))
                gone = np.stack([first[order[here]], last[order[here]] + LENGTH], axis=1).astype("<i8")
                bucket = (short[rep] % np.uint64(buckets)).astype(np.int64)
                out = [(-1 - chunk % buckets, chunk, packed(gone.tobytes()))] if len(gone) else []
                for k in np.unique(bucket):
                    r, places = rep[bucket == k], place[same[bucket[own] == k]]
                    head = [np.array([len(r), len(places)]), doc[r], times[bucket == k], places]
                    out.append((int(k), chunk, packed(b"".join(x.astype("<i8").tobytes() for x in head) + c1[r].tobytes() + c2[r].tobytes() + text[r].tobytes())))
                yield _rows(out)

    return run


def _judged(batches):
    """Step 4: to each chunk the bytes that go, as starts and ends; passes on what chunks sent to themselves."""
    for bucket, chunks, blobs in _whole_buckets(batches):
        if bucket < 0:
            yield _rows([(bucket, c, x) for c, x in zip(chunks, blobs, strict=True)])
            continue
        docs, places, times, c1, c2, texts = [], [], [], [], [], []
        for x in blobs:
            raw = unpacked(x)
            n, m = np.frombuffer(raw, "<i8", 2).tolist()
            docs.append(np.frombuffer(raw, "<i8", n, 16))
            times.append(np.frombuffer(raw, "<i8", n, 16 + 8 * n))
            places.append(np.frombuffer(raw, "<i8", m, 16 + 16 * n))
            at = 16 + 16 * n + 8 * m
            c1.append(np.frombuffer(raw, np.uint8, n, at))
            c2.append(np.frombuffer(raw, np.uint8, n, at + n))
            texts.append(np.frombuffer(raw, np.uint8, n * FRAME, at + 2 * n).reshape(n, FRAME))
        lo, hi = earlier(np.concatenate(texts), np.concatenate(c1), np.concatenate(c2), np.concatenate(docs))
        out, at = [], 0
        for c, place, often in zip(chunks, places, times, strict=True):
            a, b = (np.repeat(x[at : at + len(often)], often) for x in (lo, hi))
            some = np.flatnonzero(a <= b)
            if len(some):
                left = place[some] - (REACH - 1)
                out.append((bucket, c, packed(np.stack([left + a[some], left + b[some] + LENGTH], axis=1).astype("<i8").tobytes())))
            at += len(often)
        yield _rows(out)


def _cut(keep: bool):
    """Step 5."""

    def run(batches):
        for b in few_rows(batches, 1):
            for n, body, told in zip(*(b.column(c).to_pylist() for c in ("n", "body", "told")), strict=True):
                ids, null, ends, buf = _open(n, body)
                edge = np.zeros(len(buf) + 1, np.int32)
                for x in told or []:
                    spans = np.frombuffer(unpacked(x), "<i8").reshape(-1, 2)
                    np.add.at(edge, spans[:, 0], 1)
                    np.add.at(edge, spans[:, 1], -1)
                gone = np.cumsum(edge[:-1]) > 0
                rows, start = [], 0
                for end in ends.tolist():
                    mask = gone[start:end]
                    removed = int(mask.sum())
                    runs = int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum()) if removed else 0
                    left = buf[start:end][~mask].tobytes() if removed else buf[start:end].tobytes()
                    rows.append((end - start, removed, runs, hashlib.sha256(left).hexdigest(), left))
                    start = end
                cols = [pa.array(ids, pa.int64(), mask=null.astype(bool)), *(pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())[: 4 + keep]))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if keep else [])])

    return run


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: bool = False, chunk: int | None = None, bucket: int | None = None) -> DataFrame:
    """One row per record: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with keep=True the bytes kept.

    Null text is empty; texts under LENGTH bytes lose nothing. A null id counts as larger than any other.
    Rows of one id do not remove each other's bytes. An empty table gives no rows.

    chunk and bucket (bytes, by default CHUNK and BUCKET) set what one task holds. A chunk sends each bucket
    one message, so for tens of TB they should grow together (64 MB and 256 MB keep messages at some hundred bytes).
    """
    limit = chunk or CHUNK
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), text_of(df, text_col).alias("text"))
    chunks = written(docs.mapInArrow(lambda batches: _pack(batches, limit), "chunk long, n long, body binary"), "passage-chunks")
    size = chunks.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0))).head()[0] * 3
    buckets = max(64, size // (bucket or BUCKET))
    by_bucket = lambda sent: sent.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    told = lambda answers: answers.groupBy("chunk").agg(F.collect_list("blob").alias("told"))
    shared = written(by_bucket(chunks.mapInArrow(_hashes(buckets), MESSAGE)).mapInArrow(_shared, MESSAGE), "passage-hashes")
    sent = chunks.join(told(shared), "chunk", "left").mapInArrow(_frames(buckets), MESSAGE)
    judged = written(by_bucket(sent).mapInArrow(_judged, MESSAGE), "passage-spans")
    columns = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep
    return chunks.join(told(judged), "chunk", "left").mapInArrow(_cut(keep), columns)
