"""Token ids in a content-addressed store.

A rolling hash over the ids cuts each document's stream into chunks where the
content says so, so equal passages give equal chunks. Layout of a store:

    chunks/    digest, n, ids: each distinct chunk once, ids little-endian (2 bytes each, 4 for large vocabularies)
    recipes/   doc_id, start, n_tokens, digests, lengths, root, part: ascending by doc_id over the files in order of name
    manifest/  part, first_id, last_id, docs, tokens, root: a Merkle root over each part's documents

A document's root is the Merkle root of its chunk digests. Reading checks the manifest
against the recipes, the root of each recipe, the digest of each chunk's bytes, and that no chunk is missing.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import done_with, few_rows, new_path, text_of, worker_state, written

#: Ids in a window of the rolling hash; ids in a chunk: at least, on average about, at most.
WINDOW, LEAST, MEAN, MOST = 8, 64, 256, 2048
KEPT, LONGEST = 520_000, 256
#: Bytes of texts encoded at a time.
SLICE = 8 << 20
#: What special strings begin with, and marks that compose with ASCII letters; a letter and a mark after it.
WHOLE, TAIL = "<\\||[\\x{0300}-\\x{036f}]", r"([a-z])([!-&(-/:-@\[-`{-~])"


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root over pairs of pairs of digests; an odd node moves up."""
    level = leaves or [digest(b"")]
    while len(level) > 1:
        level = [digest(b"\1" + b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


class MerkleStream:
    """The same kind of root over a stream of leaves, with a node a level in memory."""

    def __init__(self):
        self.full: list[bytes | None] = []

    def add(self, leaf: bytes) -> None:
        node = leaf
        for i, left in enumerate(self.full):
            if left is None:
                self.full[i] = node
                return
            node, self.full[i] = digest(b"\1" + left + node), None
        self.full.append(node)

    def root(self) -> bytes:
        node = None
        for left in self.full:
            node = left if node is None else node if left is None else digest(b"\1" + left + node)
        return node or digest(b"")


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one stream: where the hash of the last WINDOW ids has its low bits 0, within LEAST and MOST."""
    mix = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mix ^= mix >> np.uint64(29)
    mix *= np.uint64(0xBF58476D1CE4E5B9)
    step = 1
    while step < WINDOW:  # hashes of twice as many ids from two hashes
        mix[step:] = mix[step:] + (mix[:-step] << np.uint64(step)) if len(mix) > step else mix[step:]
        step *= 2
    marks = np.flatnonzero((mix >> np.uint64(40)) % np.uint64(MEAN - LEAST) == 0) + 1
    ends, start, n = [], 0, len(ids)
    for m in marks.tolist():
        while m - start > MOST:
            start += MOST
            ends.append(start)
        if m - start >= LEAST and m < n:
            ends.append(m)
            start = m
    while n - start > MOST:
        start += MOST
        ends.append(start)
    return [*ends, n] if n > start else ends


class Encoder:
    """Whole texts through a tokenizers file. Parts between spaces or line ends have the same ids alone as in the text (such characters end every word and are dropped), so they are encoded once and kept."""

    def __init__(self, file: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(file)
        self.width = np.dtype("<u2" if self.lib.get_vocab_size() <= 1 << 16 else "<u4")
        self.mark = "<|endoftext|>"
        self.mark_id = self.lib.token_to_id(self.mark)
        #: Ids of parts: those seen lately, and those seen before these.
        self.parts: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        probe = "A b\nć d"
        if self.mark_id is None or self.lib.encode(probe, add_special_tokens=False).ids != [i for p in probe.replace("\n", " ").split(" ") for i in self.lib.encode(p, add_special_tokens=False).ids]:
            raise ValueError("this tokenizer keeps white space: parts would not be independent")

    def learn(self, parts: list[str]) -> dict[str, bytes]:
        plain = [p for p in parts if "<|" not in p]
        out = {p: np.array(self.lib.encode(p, add_special_tokens=False).ids, self.width).tobytes() for p in parts if "<|" in p}
        pages = [plain[at : at + 5000] for at in range(0, len(plain), 5000)]
        w = self.width.itemsize
        for some, got in zip(pages, self.lib.encode_batch_fast([self.mark.join([*p, ""]) for p in pages], add_special_tokens=False), strict=True):
            ids = np.array(got.ids, self.width)
            ends, data = np.flatnonzero(ids == self.mark_id).tolist(), ids.tobytes()
            if len(ends) != len(some):
                raise ValueError("the mark between parts is not kept apart")
            out.update({p: data[(i + 1) * w : j * w] for p, i, j in zip(some, [-1, *ends], ends, strict=False)})
        return out

    def alone(self, parts: list[str]) -> list[bytes]:
        """The ids of each part, from the cache where they are known."""
        if len(self.parts) > KEPT:
            self.parts, self.older = {}, self.parts
        known, older = self.parts, self.older
        found = list(map(known.get, parts))
        if None not in found:
            return found
        new = {p for p, x in zip(parts, found, strict=True) if x is None}
        known.update({p: older[p] for p in new if p in older})
        new = [p for p in new if p not in known]
        known.update(self.learn(new))
        found = [known[p] if x is None else x for p, x in zip(parts, found, strict=True)]
        for p in new:
            if len(p) > LONGEST:
                known.pop(p, None)
        return found

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text. Distinct parts of a batch are told apart by Arrow, so that Python sees each once.

        ASCII capitals are lower-cased first, as the normalizer does, and marks after letters are parted from
        them, as the pattern of words does (but for the apostrophe's). Texts where that could change what marks
        compose with or which special strings stand there go to the library as a whole.
        """
        whole = pc.match_substring_regex(texts, WHOLE).to_numpy(zero_copy_only=False).astype(bool)
        parted = pc.replace_substring_regex(pc.ascii_lower(texts), TAIL, r"\1 \2")
        parts = pc.split_pattern(pc.replace_substring(parted, "\n", " "), " ")
        coded = parts.flatten().dictionary_encode()
        ids = self.alone(coded.dictionary.to_pylist())
        size = np.fromiter(map(len, ids), np.int32, len(ids)) // self.width.itemsize
        every, start = np.frombuffer(b"".join(ids), self.width), np.cumsum(size, dtype=np.int32) - size
        which = coded.indices.to_numpy(zero_copy_only=False)
        each = size[which]
        before = np.cumsum(each, dtype=np.int32) - each
        flat = every[np.repeat(start[which] - before, each) + np.arange(int(each.sum()), dtype=np.int32)]
        ends = np.append(before, len(flat))[parts.offsets.to_numpy() - parts.offsets[0].as_py()]
        out = [flat[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]
        for k in np.flatnonzero(whole):
            out[k] = np.array(self.lib.encode(texts[k].as_py(), add_special_tokens=False).ids, self.width)
        return out


def _encoded(file: str, end_id: int):
    def run(batches):
        enc = worker_state(f"encoder-{file}", lambda: Encoder(file))
        end = np.array([end_id], enc.width).tobytes()
        w = enc.width.itemsize
        for b in few_rows(batches, 5000, SLICE):
            n, roots, digests, lengths, chunks = [], [], [], [], []
            for ids in enc.encode(b.column("text")):
                data = ids.tobytes() + end
                ends = cuts(np.frombuffer(data, enc.width))
                parts = [data[i * w : j * w] for i, j in zip([0, *ends], ends, strict=False)]
                n.append(len(data) // w)
                digests.append([digest(p) for p in parts])
                lengths.append([len(p) // w for p in parts])
                roots.append(merkle(digests[-1]))
                chunks.append(parts)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(roots, pa.binary()), pa.array(digests, pa.list_(pa.binary())), pa.array(lengths, pa.list_(pa.int32())), pa.array(chunks, pa.list_(pa.binary()))],
                names=["doc_id", "n_tokens", "root", "digests", "lengths", "chunks"],
            )

    return run


def _manifest(batches):
    """A row for each part of recipes; parts are whole and sorted within a task."""
    part, tree, row, rows = None, MerkleStream(), None, []
    for b in batches:
        for p, i, n, root in zip(*(b.column(c).to_pylist() for c in ("part", "doc_id", "n_tokens", "root")), strict=True):
            if p != part:
                if row:
                    rows.append((*row, tree.root()))
                part, tree, row = p, MerkleStream(), [p, i, i, 0, 0]
            tree.add(root)
            row[2], row[3], row[4] = i, row[3] + 1, row[4] + n
    if row:
        rows.append((*row, tree.root()))
    names = ["part", "first_id", "last_id", "docs", "tokens", "root"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def write_store(df: DataFrame, tokenizer_file: str, end_id: int = 2, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encodes df's whole texts, each with end_id after it, into a store; returns its path.

    Null text is empty: its stream is the end id alone. Null ids come first; rows of one id stand by root. Ids are
    cast to long. Very long texts are encoded whole, so each must fit in memory several times over.
    An empty table gives an empty store. Ids move once (to their chunk's partition), and copies of a chunk
    meet before they move.
    """
    spark = df.sparkSession
    path = path or new_path(spark, "token-store")
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), text_of(df, text_col).alias("text"))
    encoded = written(docs.mapInArrow(_encoded(tokenizer_file, end_id), "doc_id long, n_tokens long, root binary, digests array<binary>, lengths array<int>, chunks array<binary>"), "token-streams")
    each = encoded.select(F.explode(F.arrays_zip("digests", "lengths", "chunks")).alias("c")).select(F.col("c.digests").alias("digest"), F.col("c.lengths").alias("n"), F.col("c.chunks").alias("ids"))
    each.groupBy("digest").agg(F.first("n").alias("n"), F.first("ids").alias("ids")).write.option("compression", "zstd").parquet(f"{path}/chunks")
    ranged = encoded.select("doc_id", "n_tokens", "root", "digests", "lengths").repartitionByRange("doc_id", "root").withColumn("part", F.spark_partition_id())
    ranged = written(ranged, "token-recipes")
    before, starts = 0, []
    for r in ranged.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():  # a row a partition
        starts.append((r["part"], before))
        before += r["n"]
    run = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("doc_id", "root").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
    run = ranged.withColumn("run", run).join(F.broadcast(spark.createDataFrame(starts, "part int, before long")), "part")
    run.select("doc_id", (F.col("before") + F.col("run")).alias("start"), "n_tokens", "digests", "lengths", "root", "part").repartitionByRange("start").sortWithinPartitions("start").write.parquet(f"{path}/recipes")
    _parts(spark, path).write.parquet(f"{path}/manifest")
    done_with(encoded, ranged)
    return path


def _parts(spark: SparkSession, path: str) -> DataFrame:
    """The manifest that the recipes make."""
    recipes = spark.read.parquet(f"{path}/recipes").select("part", "start", "doc_id", "n_tokens", "root").repartition("part").sortWithinPartitions("part", "start")
    return recipes.mapInArrow(_manifest, "part int, first_id long, last_id long, docs long, tokens long, root binary")


def check_manifest(spark: SparkSession, path: str) -> None:
    """Raises where a part's documents, tokens or root are not those that its recipes make."""
    told, made = spark.read.parquet(f"{path}/manifest"), _parts(spark, path)
    both = told.unionByName(made).groupBy(*told.columns).agg(F.count("*").alias("n"))
    wrong = [r["part"] for r in both.filter("n <> 2").select("part").distinct().limit(5).collect()]
    if wrong:
        raise ValueError(f"the store in {path} is damaged: the recipes of parts {sorted(wrong)} are not those of its manifest")


def _complete(links: DataFrame, chunks: DataFrame) -> DataFrame:
    """links with their chunks; raises where one is missing."""
    found = links.join(chunks, "digest", "left")
    missing = F.raise_error(F.concat(F.lit("the store is damaged, chunk missing: "), F.hex("digest"))).cast("int")
    return found.withColumn("n", F.coalesce("n", missing))


POLY = 0xEDB88320


def times_mod(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials modulo CRC-32's, bits reflected."""
    out, b = np.zeros_like(b), b.copy()
    for bit in range(31, -1, -1):
        out ^= np.where(a >> bit & 1, b, 0)
        b = np.where(b & 1, b >> 1 ^ POLY, b >> 1)
    return out


def crc_shift(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """Raw CRCs after so many zero bytes: crc times x^(8 n)."""
    out, power, left = crc.astype(np.int64), np.array([1 << 30], np.int64), n_bytes.astype(np.int64) * 8
    while left.any():
        out = np.where(left & 1, times_mod(np.broadcast_to(power, out.shape), out), out)
        power, left = times_mod(power, power), left >> 1
    return out


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each chunk of each recipe, with the ids after it; checks roots."""
    for b in few_rows(batches):
        digests, lengths = b.column("digests"), b.column("lengths").flatten().to_numpy()
        at = digests.offsets.to_numpy() - digests.offsets[0].as_py()
        flat, n = digests.flatten(), b.column("n_tokens").to_numpy()
        leaves, roots, upto = flat.to_pylist(), b.column("root").to_pylist(), np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        whole = upto[at[1:]] - upto[at[:-1]] == n
        for k, (i, j) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
            if not whole[k] or merkle(leaves[i:j]) != roots[k]:
                raise ValueError(f"recipe of document {b.column('doc_id')[k]} is damaged")
        of = np.repeat(np.arange(len(n)), np.diff(at))
        yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(of)), b.column("start").take(pa.array(of)), flat, pa.array(upto[at[1:]][of] - upto[1:])], names=["doc_id", "start", "digest", "after"])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The raw CRC-32 of each chunk's ids as 4-byte integers; checks digests."""
    for b in few_rows(batches):
        crc, parts = [], b.column("ids").to_pylist()
        sizes = b.column("n").to_numpy()
        narrow = sum(map(len, parts)) == 2 * int(sizes.sum())
        wide, at = memoryview(np.frombuffer(b"".join(parts), "<u2" if narrow else "<u4").astype("<u4").tobytes()), 0
        for d, n, ids in zip(b.column("digest").to_pylist(), sizes.tolist(), parts, strict=True):
            if digest(ids) != d or len(ids) != n * (2 if narrow else 4):
                raise ValueError(f"chunk {d.hex()} is damaged")
            crc.append(zlib.crc32(wide[at : at + 4 * n], 0xFFFFFFFF) ^ 0xFFFFFFFF)
            at += 4 * n
        yield pa.RecordBatch.from_arrays([b.column("digest"), b.column("n"), pa.array(crc, pa.int64())], names=["digest", "n", "crc"])


def read_sums(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the store's chunks.

    A CRC is linear: a document's is the xor of its chunks' raw CRCs, each shifted by what follows it, so
    the chunks' bytes are read where they lie and only digests meet recipes.
    """

    @F.pandas_udf("long")
    def shifted(crc: pd.Series, ids_after: pd.Series) -> pd.Series:
        return pd.Series(crc_shift(crc.to_numpy(), ids_after.to_numpy() * 4))

    @F.pandas_udf("long")
    def finished(xor: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(xor.to_numpy() ^ crc_shift(np.full(len(n), 0xFFFFFFFF, np.int64), n.to_numpy() * 4) ^ 0xFFFFFFFF)

    check_manifest(spark, path)
    recipes = spark.read.parquet(f"{path}/recipes").select("doc_id", "start", "n_tokens", "digests", "lengths", "root")
    links = recipes.mapInArrow(_links, "doc_id long, start long, digest binary, after long")
    chunks = spark.read.parquet(f"{path}/chunks").mapInArrow(_sums, "digest binary, n int, crc long")
    per_doc = _complete(links, chunks).select("doc_id", "start", "n", shifted("crc", "after").alias("crc")).groupBy("doc_id", "start").agg(F.bit_xor("crc").alias("xor"), F.sum("n").alias("n_tokens"))
    return per_doc.select("doc_id", "start", "n_tokens", finished("xor", "n_tokens").alias("ids_crc32"))


def read_ids(spark: SparkSession, path: str, doc_ids: DataFrame | None = None) -> DataFrame:
    """doc_id, start, ids (array of int): documents put together again, all or those of doc_ids (column doc_id)."""

    @F.pandas_udf("array<int>")
    def joined(parts: pd.Series, n: pd.Series) -> pd.Series:
        whole = [b"".join(p) for p in parts]
        return pd.Series([np.frombuffer(w, "<u2" if len(w) == 2 * k else "<u4").astype(np.int32) for w, k in zip(whole, n, strict=True)])

    check_manifest(spark, path)
    recipes = spark.read.parquet(f"{path}/recipes")
    if doc_ids is not None:
        recipes = recipes.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")
    links = recipes.mapInArrow(_links, "doc_id long, start long, digest binary, after long")
    parts = _complete(links, spark.read.parquet(f"{path}/chunks")).groupBy("doc_id", "start").agg(F.sort_array(F.collect_list(F.struct("after", "n", "ids")), asc=False).alias("c"), F.sum("n").alias("n_tokens"))
    return parts.select("doc_id", "start", joined("c.ids", "n_tokens").alias("ids"))
