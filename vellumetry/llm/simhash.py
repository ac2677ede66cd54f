"""Near-duplicates by SimHash fingerprints, searched with Golay codes.

The binary Golay code is perfect: each 23-bit word has one code word within 3 bits,
whose 12-bit index stands for it. A fingerprint is cut into segments of at most 23
bits. A segment's near indices are those of itself and of all words one bit away, about
five; two segments one bit apart have the index of each among the near ones of the other.

near_duplicates links fingerprints of 64 bits that differ in RADIUS (two) bits or fewer.
They have three segments, so by the pigeonhole principle there is a segment without an
error followed, in a circle, by one with at most one. Keys therefore pair each
segment with the near indices of the next; fingerprints that share a key are verified.

similar_groups links texts whose five-word shingles are SIMILARITY alike or more. Each
text has long fingerprints of its distinct words, GROUPS groups of three segments. A key
is a group's three indices, or one near index and the other two. Texts that share a key
and have fingerprints within NEAR bits come together in a loose group, whose texts are
then compared by all their shingles.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import done_with, few_rows, labelled, text_of, unused_name, worker_state, written

SHINGLE, SEED, RADIUS = 3, 42, 2
#: The generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
WIDTH = 23
#: near_duplicates: the segments' lowest bits and widths; fingerprints of a key that are compared pair by pair.
SEGMENTS, FEW = ((42, 22), (21, 21), (0, 21)), 64
#: similar_groups: words of a shingle, least Jaccard similarity, words of 64 bits and groups of three segments of a text's fingerprint, differing bits of texts that come together.
SIMILAR_SHINGLE, SIMILARITY, PRINTS, GROUPS, NEAR = 5, 0.8, 9, 8, 80
#: Bytes of shingle hashes that one task compares with others at a time.
BLOCK = 4 << 20
#: Rows of a table of groups (16 bytes each) that may be broadcast.
FEW_GROUPS = 500_000


def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of the 4096 high parts, and the error pattern of each remainder."""
    high = np.zeros(4096, np.int64)
    for m in range(4096):
        r = m << 11
        for bit in range(22, 10, -1):
            if r >> bit & 1:
                r ^= GENERATOR << bit - 11
        high[m] = r
    leader = np.zeros(2048, np.int64)
    for weight in (1, 2, 3):
        for bits in combinations(range(WIDTH), weight):
            e = sum(1 << b for b in bits)
            leader[high[e >> 11] ^ e & 2047] = e
    return high, leader


def golay_index(words: np.ndarray) -> np.ndarray:
    """The index (12 bits) of the code word nearest to each 23-bit word."""
    high, leader = worker_state("golay", golay_tables)
    return (words ^ leader[high[words >> 11] ^ words & 2047]) >> 11


def near_indices(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """In a new last axis, each word's own index and those of the words one of its `width` bits away."""
    return golay_index(words[..., None] ^ np.append(0, 1 << np.arange(width, dtype=np.int64)))


def each_once(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of each row, one row after another, and how many each row has."""
    keys = np.sort(keys, axis=1)
    new = np.concatenate([np.ones((len(keys), 1), bool), keys[:, 1:] != keys[:, :-1]], axis=1)
    return keys[new], new.sum(axis=1)


def segment_keys(fp: np.ndarray) -> np.ndarray:
    """The keys of 64-bit fingerprints: segment, its bits, a near index of the next segment."""
    parts = [(fp.view(np.uint64) >> np.uint64(low)).astype(np.int64) & (1 << width) - 1 for low, width in SEGMENTS]
    made = []
    for i, (_, width) in enumerate(SEGMENTS):
        j = (i + 1) % len(SEGMENTS)
        made.append((i << 40 | parts[i] << 12)[:, None] | near_indices(parts[j], SEGMENTS[j][1]))
    return np.concatenate(made, axis=1)


def group_keys(prints: np.ndarray) -> np.ndarray:
    """The keys of long fingerprints (rows of PRINTS words): group, its three indices, at most one of them a near one."""
    bits = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8).reshape(len(prints), -1), axis=1, bitorder="little")
    words = bits[:, : GROUPS * 3 * WIDTH].reshape(-1, GROUPS, 3, WIDTH) @ (1 << np.arange(WIDTH, dtype=np.int64))
    near, made = near_indices(words), []
    for s, low in enumerate((24, 12, 0)):
        rest = sum(near[:, :, o, 0] << (24, 12, 0)[o] for o in range(3) if o != s)
        made.append((rest + (np.arange(GROUPS, dtype=np.int64) << 36))[:, :, None] + (near[:, :, s] << low))
    return np.concatenate(made, axis=2).reshape(len(prints), -1)


def fingerprint(text: str) -> int:
    """Of the word shingles' XXH64 values, repeats included, the bits that more than half have; 0 without words."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxh64_intdigest(b" ".join(words), SEED)
    join = b" ".join
    return _bits(np.array([xxh64_intdigest(join(s), SEED) for s in zip(words, words[1:], words[2:], strict=False)], np.uint64)) & (1 << 64) - 1


def _bits(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    by_value = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + np.arange(0, 2048, 256, dtype=np.int64)).ravel(), minlength=2048).reshape(8, 256)
    ones = by_value @ worker_state("byte-bits", lambda: np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64))
    return int(np.packbits((2 * ones > len(hashes)).ravel(), bitorder="little").view(np.int64)[0])


def _fingerprints(batches):
    for b in few_rows(batches):
        fp = np.array([fingerprint(t) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp of each record."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), text_of(df, text_col).alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


def _segment_keys(batches):
    """(key, fp): the keys of each fingerprint."""
    for b in few_rows(batches, 20_000):
        fp = b.column("fp").to_numpy(zero_copy_only=False)
        keys, each = each_once(segment_keys(fp))
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(fp, each))], names=["key", "fp"])


def _words(batches):
    """(key, word, fp): each fingerprint's own word and those one bit away."""
    flips = np.append(np.uint64(0), np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64)))
    for b in few_rows(batches, 20_000):
        key, fp = (b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp"))
        words = (fp.view(np.uint64)[:, None] ^ flips).view(np.int64).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(key, 65)), pa.array(words), pa.array(np.repeat(fp, 65))], names=["key", "word", "fp"])


def links(distinct_fps: DataFrame) -> DataFrame:
    """Edges (a, b), a > b, that join all fingerprints RADIUS or fewer bits apart; not every pair, but the same components.

    The fingerprints of a key are verified pair by pair where they are FEW or fewer. Where they are more, those
    that share a word within one bit of both, as all RADIUS bits apart do, are verified with the least of them.
    """
    keyed = distinct_fps.select("fp").mapInArrow(_segment_keys, "key long, fp long")
    shared = written(keyed.withColumn("n", F.count("*").over(Window.partitionBy("key"))).filter("n > 1"), "simhash-keys")
    few = shared.filter(F.col("n") <= FEW).groupBy("key").agg(F.collect_list("fp").alias("fps"))
    few = few.select("fps", F.explode("fps").alias("a")).select("a", F.explode(F.filter("fps", lambda b: (b < F.col("a")) & (F.bit_count(b.bitwiseXOR(F.col("a"))) <= RADIUS))).alias("b"))
    words = shared.filter(F.col("n") > FEW).select("key", "fp").mapInArrow(_words, "key long, word long, fp long")
    hub = F.min("fp").over(Window.partitionBy("key", "word"))  # of at most 65 fingerprints
    many = words.withColumn("b", hub).filter("fp <> b").select(F.col("fp").alias("a"), "b")
    return few.unionByName(many.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)).distinct()


def _tree_roots(parents: DataFrame) -> DataFrame:
    """(node, root) of a forest given by (node, root), each with a lower node of its tree: nodes take the root of their root until that changes nothing."""
    def jump(label: DataFrame) -> DataFrame:
        up = label.select(F.col("node").alias("root"), F.col("root").alias("above"))
        return label.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"), F.isnotnull("above").alias("moved"))

    label = written(parents, "component-labels")
    while True:
        jumped = written(jump(jump(label).drop("moved")), "component-labels")
        done_with(label)
        label = jumped
        if jumped.filter("moved").isEmpty():
            return jumped


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each node of the edges with the least node of its component.

    Each node that has a lower neighbour goes to its least one. The trees that this makes become single nodes, the
    edges between them go on as edges of their roots, until none is left. All is written each round, so rounds do
    not add up lineage.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b"), "component-edges")
    whole = None
    while whole is None or not edges.isEmpty():
        label = _tree_roots(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))).select("node", "root")
        if whole is None:
            lowest = edges.select(F.col("b").alias("node")).distinct().join(label, "node", "left_anti")
            whole = label.unionByName(lowest.withColumn("root", F.col("node")))
        else:
            higher = label.select(F.col("node").alias("root"), F.col("root").alias("above"))
            whole = whole.join(higher, "root", "left").select("node", F.coalesce("above", "root").alias("root"))
        whole = written(whole, "component-roots")
        of = lambda n: label.select(F.col("node").alias(n), F.col("root").alias(f"root_{n}"))
        ra, rb = F.col("root_a"), F.coalesce("root_b", "b")
        over = edges.join(of("a"), "a").join(of("b"), "b", "left").filter(ra != rb)
        edges = written(over.select(F.greatest(ra, rb).alias("a"), F.least(ra, rb).alias("b")).distinct(), "component-edges")
    return whole


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per record: doc_id, fp (64 bits as long), component_id (least doc_id reachable over links of RADIUS or fewer bits).

    Copies meet by fingerprint before anything moves, so a group of copies costs one row in the search. Null
    and blank texts have fingerprint 0 and link like any other. A null id has no say in component_id; where a
    component has only null ids, that is null. Very long texts are read whole, one in memory at a time. Ids are
    cast to long. An empty table gives no rows.
    """
    docs = written(fingerprints(df, id_col, text_col), "simhash-fingerprints")
    fps = written(docs.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-distinct")
    rooted = fps.join(components(links(fps)).withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = written(rooted, "simhash-roots")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    found = labelled(rooted.withColumnRenamed("n", "copies"), least, "root")
    return labelled(docs, found.select("fp", F.col("copies").alias("n"), "component_id"), "fp").select("doc_id", "fp", "component_id")


def prints_of(text: str) -> list[int]:
    """PRINTS words of 64 bits: SimHash of the distinct words under as many hash functions; 0 without words."""
    from xxhash import xxh64_intdigest

    words = set(text.encode("utf-8", "surrogatepass").lower().split())
    if not words:
        return [0] * PRINTS
    own, prints = np.fromiter((xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words)), []
    for k in range(PRINTS):
        mixed = (own + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0x94D049BB133111EB)
        prints.append(_bits(mixed ^ mixed >> np.uint64(29)))
    return prints


def shingles_of(text: str) -> np.ndarray:
    """The hashes of the distinct five-word shingles in order; of fewer words, of them all; none without words."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    join, n = b" ".join, SIMILAR_SHINGLE
    own = set(map(join, zip(*(words[i:] for i in range(n)), strict=False))) or ({join(words)} if words else set())
    return np.unique(np.fromiter((xxh64_intdigest(s, SEED) for s in own), np.uint64, len(own)))


P = [f"p{k}" for k in range(PRINTS)]
PRINTS_SCHEMA = ", ".join(f"{p} long" for p in P)


def _prints(batches):
    """(digest, doc_id, prints); copies within a batch are read once."""
    for b in few_rows(batches):
        own = {}
        for d, t in zip(b.column("digest").to_pylist(), b.column("text").to_pylist(), strict=True):
            if d not in own:
                own[d] = prints_of(t)
        made = np.array([own[d] for d in b.column("digest").to_pylist()], np.int64).reshape(-1, PRINTS)
        yield pa.RecordBatch.from_arrays([b.column("digest"), b.column("doc_id"), *map(pa.array, np.ascontiguousarray(made.T))], names=["digest", "doc_id", *P])


def _group_keys(batches):
    """(key, node): the keys of each text."""
    for b in few_rows(batches, 2000):
        keys, each = each_once(group_keys(np.stack([b.column(p).to_numpy(zero_copy_only=False) for p in P], axis=1)))
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(b.column("node").to_numpy(zero_copy_only=False), each))], names=["key", "node"])


def _leaders(batches):
    """(a, b): of the texts of each key (rows sorted by key), each with every leader within twice NEAR bits; a text with no leader within NEAR becomes one."""
    key, nodes, prints = None, [], np.zeros((0, PRINTS), np.int64)
    for batch in few_rows(batches, 20_000):
        rows, made = np.stack([batch.column(p).to_numpy(zero_copy_only=False) for p in P], axis=1), []
        for k, node, own in zip(batch.column("key").to_pylist(), batch.column("node").to_pylist(), rows, strict=True):
            if k != key:
                key, nodes, prints = k, [], np.zeros((0, PRINTS), np.int64)
            apart = np.bitwise_count((prints ^ own).view(np.uint64)).sum(axis=1, dtype=np.int64)
            made += [(node, nodes[i]) for i in np.flatnonzero(apart <= 2 * NEAR)]
            if not (apart <= NEAR).any():
                nodes.append(node)
                prints = np.concatenate([prints, own[None]])
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in made], pa.int64()), pa.array([b for _, b in made], pa.int64())], names=["a", "b"])


def digest_of(df: DataFrame, text_col: str) -> Column:
    return F.unhex(F.md5(text_of(df, text_col).cast("binary")))


def distinct_texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """node, digest, doc_id, n, prints of each distinct text: its least id (null if it has none) and how many records have both."""
    source = df.select(digest_of(df, text_col).alias("digest"), F.col(id_col).cast("long").alias("doc_id"), text_of(df, text_col).alias("text"))
    made = source.mapInArrow(_prints, f"digest binary, doc_id long, {PRINTS_SCHEMA}")
    first = [F.first(p).alias(p) for p in P]
    ids = made.groupBy("digest", "doc_id").agg(F.count("*").alias("n"), *first)
    texts = ids.groupBy("digest").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "n")).alias("r"), *first)
    return written(texts.select(F.monotonically_increasing_id().alias("node"), "digest", "r.doc_id", "r.n", *P), "simhash-texts")


def loose_groups(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b) edges, and (node, root) of the groups they make: texts that share a key and are within NEAR bits are in one group.

    Each text is compared with the least of a key. Texts within NEAR bits of each other that are not both within
    NEAR of it are either both within twice NEAR, hence joined by it, or go on together; among those that go on, leaders
    do the same. So no pairs of a key's texts are made.
    """
    keyed = texts.mapInArrow(_group_keys, "key long, node long")
    keys = written(keyed.withColumn("hub", F.min("node").over(Window.partitionBy("key"))).filter("node <> hub"), "simhash-keys")
    of = lambda n, mark: texts.select(F.col("node").alias(n), *(F.col(p).alias(p + mark) for p in P)).hint("merge")
    apart = reduce(lambda x, y: x + y, (F.bit_count(F.col(p).bitwiseXOR(F.col(p + "_"))) for p in P))
    pairs = keys.select("node", "hub").distinct().join(of("hub", "_"), "hub").join(of("node", ""), "node").select("node", "hub", apart.alias("apart"))
    pairs = written(pairs, "simhash-apart")
    edges = pairs.filter(F.col("apart") <= 2 * NEAR).select(F.col("node").alias("a"), F.col("hub").alias("b"))
    on = keys.join(pairs.filter(F.col("apart") > NEAR).hint("merge"), ["node", "hub"]).select("key", "node")
    on = on.withColumn("n", F.count("*").over(Window.partitionBy("key"))).filter("n > 1").select("key", "node")
    led = on.join(of("node", ""), "node").repartition("key").sortWithinPartitions("key").mapInArrow(_leaders, "a long, b long").distinct()
    edges = written(edges.unionByName(led), "simhash-edges")
    done_with(keys, pairs)
    return edges, components(edges)


def _full(batches):
    """(node, root, size, shingles); a record that repeats the one before is left out."""
    last = None
    for b in few_rows(batches, 200):
        keep, made = [], []
        for at, (node, text) in enumerate(zip(b.column("node").to_pylist(), b.column("text").to_pylist(), strict=True)):
            if node != last:
                keep.append(at)
                made.append(shingles_of(text).tobytes())
            last = node
        b = b.take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([b.column("node"), b.column("root"), pa.array([len(m) + 64 for m in made], pa.int64()), pa.array(made, pa.binary())], names=["node", "root", "size", "shingles"])


class Block:
    """Sets of one block, looked up by their members."""

    def __init__(self, sets: list[np.ndarray]):
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        every = np.concatenate([np.zeros(0, np.uint64), *sets])
        by = np.argsort(every, kind="stable")
        self.values, start, each = np.unique(every[by], return_index=True, return_counts=True)
        self.start, self.each, self.owner, self.sizes = start, each, owner[by], np.array([len(s) for s in sets])

    def alike(self, own: np.ndarray) -> np.ndarray:
        """Places of the sets that are SIMILARITY or more like own; all empty ones of an empty one."""
        if not len(own) or not len(self.values):
            return np.flatnonzero(self.sizes == 0) if not len(own) else np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.values, own), len(self.values) - 1)
        at = at[self.values[at] == own]
        each = self.each[at]
        places = np.arange(each.sum()) + np.repeat(self.start[at] - (np.cumsum(each) - each), each)
        shared = np.bincount(self.owner[places], minlength=len(self.sizes))
        return np.flatnonzero((shared > 0) & (shared >= SIMILARITY * (self.sizes + len(own) - shared)))


def _linked(batches):
    """(a, b): links that join all texts of a group that are alike and not joined yet (strict).

    Rows are sorted by group, part and other, asked ones first: those make the block that all are held against.
    """

    def fresh(group):
        return {"group": group, "nodes": [], "sets": [], "strict": [], "block": None, "root": {}, "seen": set()}

    def find(root, x):
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    def compare(state, node, own, strict, upto=None):
        found = []
        for at in state["block"].alike(own):
            if upto is None or at < upto:
                a, b = find(state["root"], strict), find(state["root"], state["strict"][at])
                if a != b:
                    state["root"][a] = b
                    found.append((node, state["nodes"][at]))
        return found

    def closed(state):
        """The block is complete: its texts are held against each other."""
        if state["block"] is not None:
            return []
        state["block"] = Block(state["sets"])
        rows = zip(state["nodes"], state["sets"], state["strict"], strict=True)
        found = [x for at, (n, s, r) in enumerate(rows) for x in compare(state, n, s, r, at)]
        state["sets"] = None
        return found

    def out(found):
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(2)], names=["a", "b"])

    state = None
    for batch in few_rows(batches, 500):
        found = []
        columns = (batch.column(c).to_pylist() for c in ("group", "part", "other", "asked", "node", "strict", "shingles"))
        for group, part, other, asked, node, strict, raw in zip(*columns, strict=True):
            if state is None or state["group"] != (group, part, other):
                found += closed(state) if state else []
                state = fresh((group, part, other))
            if (asked, node) in state["seen"]:
                continue
            own = np.frombuffer(raw, np.uint64)
            if asked:
                state["seen"].add((asked, node))
                state["nodes"].append(node)
                state["sets"].append(own)
                state["strict"].append(strict)
            else:
                found += closed(state)
                found += compare(state, node, own, strict)
        yield out(found)
    if state:
        yield out(closed(state))


COMPARED = ("group", "part", "other", "asked", "node", "strict", "shingles")


def _compared(rows: DataFrame) -> DataFrame:
    dealt = rows.select(*COMPARED).repartition("group", "part", "other").sortWithinPartitions("group", "part", "other", F.desc("asked"))
    return dealt.mapInArrow(_linked, "a long, b long")


def verified(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that join all texts of a loose group that are alike. sets: node, root, size, shingles.

    A loose group of up to BLOCK bytes is compared in one task. Larger ones are dealt into blocks: first each text
    is held against those it has an edge with, then those not yet joined to the group's largest class against
    all of the group, block by block.
    """
    sizes = sets.groupBy("root").agg(F.ceil(F.sum("size") / BLOCK).cast("int").alias("blocks")).filter("blocks > 1")
    sizes = written(sizes, "simhash-sizes")
    n_large = sizes.count()
    sized = sets.join(F.broadcast(sizes) if n_large < FEW_GROUPS else sizes.hint("merge"), "root", "left")
    zero, small = F.lit(0), sized.filter("blocks is null")
    links = _compared(small.select(F.col("root").alias("group"), zero.alias("part"), zero.alias("other"), F.lit(True).alias("asked"), "node", F.col("node").alias("strict"), "shingles"))
    if not n_large:
        return written(links, "simhash-links")
    block = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    large = written(sized.filter("blocks is not null").withColumn("block", block("blocks")), "simhash-large")
    mine = large.select("node", "block", "shingles", F.lit(False).alias("asked")).hint("merge")
    met = edges.join(mine, edges["a"] == mine["node"]).select(F.col("b").alias("group"), "block", "node", "asked", "shingles")
    hubs = met.select("group", "block").distinct().join(large.select(F.col("node").alias("group"), "shingles").hint("merge"), "group")
    rows = met.unionByName(hubs.select("group", "block", F.col("group").alias("node"), F.lit(True).alias("asked"), "shingles"))
    star = written(_compared(rows.select("group", F.col("block").alias("part"), zero.alias("other"), "asked", "node", F.col("node").alias("strict"), "shingles")), "simhash-star")
    strict = components(star).withColumnRenamed("root", "strict")
    large = large.join(strict.hint("merge"), "node", "left").withColumn("strict", F.coalesce("strict", "node"))
    classes = large.groupBy("root", "strict").agg(F.count("*").alias("n")).groupBy("root").agg(F.max(F.struct("n", "strict"))["strict"].alias("main"))
    large = written(large.join(classes.hint("merge"), "root"), "simhash-strict")
    out = large.filter("strict <> main")
    parts = out.groupBy("root").agg(F.ceil(F.sum("size") / BLOCK).cast("int").alias("parts"))
    every = lambda n: F.explode(F.sequence(zero, F.col(n) - 1))
    rest = lambda df, asked: df.select(F.col("root").alias("group"), "part", "other", F.lit(asked).alias("asked"), "node", "strict", "shingles")
    asked = out.join(parts.hint("merge"), "root").withColumn("part", block("parts")).withColumn("other", every("blocks"))
    against = large.join(parts.hint("merge"), "root").withColumn("other", F.col("block")).withColumn("part", every("parts"))
    return written(links.unionByName(star).unionByName(_compared(rest(asked, True).unionByName(rest(against, False)))), "simhash-links")


def grouped_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """digest, doc_id, n, root of each distinct text: the least id of its copies, the records that have both, its class."""
    texts = distinct_texts(df, id_col, text_col)
    edges, loose = loose_groups(texts)
    found = texts.select("node", "digest", "doc_id").join(loose.hint("merge"), "node")
    found = found.select("node", "root", F.col("digest").alias("_digest"), F.col("doc_id").alias("_id")).hint("merge")
    source = df.select(digest_of(df, text_col).alias("digest"), F.col(id_col).cast("long").alias("doc_id"), text_of(df, text_col).alias("text"))
    bodies = source.join(found, (F.col("digest") == F.col("_digest")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select("node", "root", "text")
    sets = written(bodies.mapInArrow(_full, "node long, root long, size long, shingles binary"), "simhash-sets")
    label = components(verified(edges, sets))
    rooted = texts.select("node", "digest", "doc_id", "n").join(label.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    return written(rooted.select("digest", "doc_id", "n", "root"), "simhash-roots")


def similar_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, component_id of each record, over links of SIMILARITY or more in five-word shingles.

    Similarity is exact, over all shingles. Texts without words are alike, and so are those of fewer than five words
    that have the same ones. A pair is missed only where the texts share none of their keys, or their fingerprints
    differ in more than NEAR of 576 bits, and no third text links them; README has the measured share.
    Nulls, ties and empty tables as in near_duplicates.
    """
    docs = df.select(digest_of(df, text_col).alias("digest"), F.col(id_col).cast("long").alias("doc_id"))
    copies = docs.groupBy("digest").agg(F.count("*").alias("n"))
    texts = grouped_texts(df, id_col, text_col)
    least = texts.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n"))
    label = labelled(texts.select("digest", "root"), least, "root").select("digest", "component_id").join(copies, "digest")
    return labelled(docs, label, "digest").select("doc_id", "component_id")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with one record of each of similar_groups' classes: that with the least id; of records that share it, the one whose text's digest is least, once. Null ids come last.

    Ids and digests are chosen first. Then texts meet what was chosen by a sort-merge join, at every size: the
    chosen ids grow with the corpus, so they are never broadcast. Copies differ in id, so they meet in different tasks.
    """
    have, mark, many = (unused_name(df, n) for n in ("_kept", "_hash", "_many"))
    chosen = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "digest", "n")).alias("r")
    found = grouped_texts(df, id_col, text_col).groupBy("root").agg(chosen)
    found = written(found.select(F.col("r.doc_id").alias(have), F.col("r.digest").alias(mark), (F.col("r.n") > 1).alias(many)), "simhash-kept")
    kept = df.join(found.hint("merge"), df[id_col].cast("long").eqNullSafe(found[have]) & (digest_of(df, text_col) == found[mark]))
    once = kept.filter(~F.col(many)).select(*df.columns)
    again = kept.filter(F.col(many)).groupBy(have, mark).agg(F.first(F.struct(*df.columns)).alias("r")).select("r.*")
    return once.unionByName(again)
