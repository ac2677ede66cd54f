"""Benchmark decontamination with DataFrame functions only.

Windows of a document as long as an item (in words) are compared with the item by
their five-word shingles. A pair counts if its weighted Jaccard similarity is
SIMILARITY or more. The search:

1. Anchors. Of an item's shingles, the rarest that together weigh over 1 - SIMILARITY
   of it. A window without any of them cannot be similar enough, so only documents
   with an anchor go on. Of their windows, at every place, those go on whose shingles
   that the item has too, counted with repeats, weigh enough: a bound from running sums.
2. SimHash. Each such window and each item has a 64-bit weighted fingerprint.
3. Blocks. Eight blocks of eight bits; two fingerprints RADIUS or fewer bits apart have
   a block that differs in at most two bits, so items are listed under all such values.
4. Windows within the radius are verified by the exact similarity.

At similarity 0.8 fingerprints differ in 9.6 bits on average, with deviation 2.9:
RADIUS 23 lies over four deviations beyond.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of, unused_name, written

SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 23
BLOCKS, BLOCK_BITS, BLOCK_RADIUS = 8, 8, 2
#: Weight of a shingle that no item or one item has; it falls with every doubling of items.
TOP_WEIGHT = 4
#: Rows of a table of anchors (16 bytes each) that may be broadcast.
FEW = 2_000_000
#: Anchors (8 bytes each) that may go to the driver as a set.
LISTED = 100_000
#: Counters to a long: weights of less than 2^31 in one window.
FIELDS, FIELD_BITS = 2, 31


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), "")


def hashes(ws: Column) -> Column:
    """The hash of each five-word shingle in order; none for fewer words. A one-element array binds the words once."""
    each = lambda w: F.when(F.size(w) >= SHINGLE, F.transform(F.sequence(F.lit(1), F.size(w) - (SHINGLE - 1)), lambda i: F.xxhash64(F.slice(w, i, SHINGLE)))).otherwise(F.array().cast("array<bigint>"))
    return F.element_at(F.transform(F.array(ws), each), 1)


def row_key(df: DataFrame, id_col: str, text_col: str) -> Column:
    """Names a record by id and text; repeated rows share it."""
    return F.concat_ws(":", F.coalesce(df[id_col].cast("string"), F.lit("null")), F.md5(text_of(df, text_col).cast("binary")))


def item_tables(bench: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Of the items: names (item, item_id), weights (h, w), shingles (item, h, n, w) and anchors (item, q, h, m).

    An item is a distinct pair of id and text.
    """
    name = F.concat(F.coalesce(F.concat(F.lit("="), bench[id_col].cast("string")), F.lit("")), F.lit(":"), F.md5(text_of(bench, text_col).cast("binary")))
    each = bench.select(name.alias("item"), bench[id_col].alias("item_id"), words(text_of(bench, text_col)).alias("ws")).dropDuplicates(["item"])
    items = each.select("item", "item_id", F.size("ws").alias("m"), hashes(F.col("ws")).alias("hs"))
    places = written(items.select("item", "item_id", "m", F.posexplode("hs").alias("q", "h")), "bench-shingles")
    in_items = places.groupBy("h").agg(F.countDistinct("item").alias("in_items"))
    weights = in_items.select("h", F.greatest(F.lit(1), F.lit(TOP_WEIGHT) - F.floor(F.log2("in_items"))).cast("long").alias("w"), "in_items")
    weighed = places.join(weights, "h")
    shingles = weighed.groupBy("item", "h").agg(F.count("*").alias("n"), F.first("w").alias("w"))
    rarest = Window.partitionBy("item").orderBy("in_items", "q").rowsBetween(Window.unboundedPreceding, -1)
    whole = F.sum("w").over(Window.partitionBy("item"))
    anchors = weighed.withColumn("before", F.coalesce(F.sum("w").over(rarest), F.lit(0))).withColumn("whole", whole).filter(F.col("before") <= F.col("whole") * (1 - SIMILARITY))
    return places.select("item", "item_id").distinct(), weights.select("h", "w"), shingles, written(anchors.select("item", "q", "h", "m"), "bench-anchors")


def counters(weight: Column) -> list[Column]:
    """Sums by bit of a hash h, FIELDS bits to a long."""
    bit = lambda b: F.shiftright("h", b).bitwiseAND(F.lit(1)) if b < 64 else F.lit(0)
    return [F.sum(weight * sum((bit(FIELDS * j + f) * (1 << FIELD_BITS * f) for f in range(1, FIELDS)), bit(FIELDS * j))).alias(f"c{j}") for j in range(math.ceil(64 / FIELDS))]


def fingerprint(total: Column) -> Column:
    """The bits that more than half of the weight has."""
    out = F.lit(0).cast("long")
    for b in range(64):
        count = F.shiftright(f"c{b // FIELDS}", FIELD_BITS * (b % FIELDS)).bitwiseAND(F.lit((1 << FIELD_BITS) - 1))
        out = out.bitwiseOR(F.when(2 * count > total, F.lit(1 << b if b < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def blocks(fp: Column) -> Column:
    return F.array(*[F.struct(F.lit(b).alias("block"), F.shiftright(fp, BLOCK_BITS * b).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).alias("value")) for b in range(BLOCKS)])


def leaks(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per record and item that it holds: key, doc_id, item_id, start (first word of the most similar window, the earliest of equals), similarity.

    Words are runs of letters and digits, lower-cased. Texts and items of fewer than five words (null and
    empty ones too) have no shingles and match nothing; a text shorter than an item is one window. Repeated
    rows give one row, and so do repeated rows of the benchmark; texts that share an item_id are items of their
    own, with a row each, and a null item_id is an id like any other. Every shingle of every text is looked up; no text moves.
    """
    names, weights, shingles, anchors = item_tables(bench, item_id, item_text)
    hashed = docs.select(row_key(docs, id_col, text_col).alias("key"), docs[id_col].alias("doc_id"), words(text_of(docs, text_col)).alias("ws")).select("key", "doc_id", F.size("ws").alias("n"), hashes(F.col("ws")).alias("hs"))
    found = written(_with_anchor(hashed, anchors.select("h").distinct()).dropDuplicates(["key"]), "decontamination-found")
    return _verified(found, weights, shingles, anchors).join(names, "item").select("key", "doc_id", "item_id", "start", "similarity")


def _with_anchor(hashed: DataFrame, wanted: DataFrame) -> DataFrame:
    """The records with an anchor among their shingles: by a set of up to LISTED anchors, beyond that by a join."""
    listed = [r["h"] for r in wanted.limit(LISTED + 1).collect()]
    if len(listed) > LISTED:
        return hashed.select("*", F.explode("hs").alias("h")).join(_side(wanted), "h").drop("h")
    in_set = ",".join(f"{h}L" if h > -(1 << 63) else "(-9223372036854775807L - 1L)" for h in sorted(listed))
    return hashed.filter(F.expr(f"exists(hs, h -> h in ({in_set}))") if listed else F.lit(False))


def _side(table: DataFrame) -> DataFrame:
    """A table of the benchmark as one side of a join: broadcast if it has at most FEW rows, else sorted and merged."""
    return F.broadcast(table) if table.count() <= FEW else table.hint("merge")


def _windows(found: DataFrame, weights: DataFrame, shingles: DataFrame, anchors: DataFrame, wholes: DataFrame) -> DataFrame:
    """key, item, start, len of each window, at every place, that may be similar enough to an item of which the record has an anchor.

    Each place's shingle adds its weight to `own`, and to `held` if the item has it; `held` of a window, at most
    the item's whole weight, is at least what they share.
    """
    places = written(found.select("key", "n", F.posexplode("hs").alias("p", "h")), "decontamination-places")
    pairs = places.join(_side(anchors.select("item", "h", "m").distinct()), "h").select("key", "item", "m").distinct()
    weighed = places.join(weights, "h", "left").select("key", "n", "p", "h", F.coalesce("w", F.lit(TOP_WEIGHT)).alias("w"))
    held = F.when(F.col("has"), F.col("w")).otherwise(F.lit(0))
    each = weighed.join(pairs, "key").join(shingles.select("item", "h", F.lit(True).alias("has")), ["item", "h"], "left").withColumn("v", held)
    upto = Window.partitionBy("key", "item").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    sums = each.select("key", "item", "n", "m", "p", F.sum("w").over(upto).alias("own"), F.sum("v").over(upto).alias("held"))
    sums = sums.groupBy("key", "item", "n", "m").agg(F.sort_array(F.collect_list(F.struct("p", "own", "held"))).alias("s"), F.max("held").alias("most"))
    sums = sums.join(wholes, "item").filter(F.col("most") >= SIMILARITY * F.col("whole")).withColumn("len", F.least("m", "n") - (SHINGLE - 1))
    before = lambda at, c: F.when(at == 0, F.lit(0)).otherwise(F.get("s", at - 1)[c])
    within = lambda at, c: F.get("s", at + F.col("len") - 1)[c] - before(at, c)

    def able(at: Column) -> Column:
        both = F.least(within(at, "held"), F.col("whole"))
        return both / (within(at, "own") + F.col("whole") - both) >= SIMILARITY

    return sums.select("key", "item", F.explode(F.filter(F.sequence(F.lit(0), F.size("s") - F.col("len")), able)).alias("start"), "len")


def _verified(found: DataFrame, weights: DataFrame, shingles: DataFrame, anchors: DataFrame) -> DataFrame:
    items = shingles.groupBy("item").agg(F.sum(F.col("w") * F.col("n")).alias("whole"), *counters(F.col("w") * F.col("n")))
    items = items.select("item", "whole", fingerprint(F.col("whole")).alias("item_fp"))
    windows = _windows(found, weights, shingles, anchors, items.select("item", "whole"))
    inside = windows.join(found.select("key", "doc_id", "hs"), "key").select("key", "doc_id", "item", "start", F.explode(F.slice("hs", F.col("start") + 1, F.col("len"))).alias("h"))
    counted = inside.groupBy("key", "doc_id", "item", "start", "h").agg(F.count("*").alias("c"))
    joined = counted.join(weights, "h", "left").join(shingles.select("item", "h", "n"), ["item", "h"], "left").withColumn("w", F.coalesce("w", F.lit(TOP_WEIGHT)))
    both = F.sum(F.col("w") * F.least("c", F.coalesce("n", F.lit(0)))).alias("both")
    scored = joined.groupBy("key", "doc_id", "item", "start").agg(both, F.sum(F.col("w") * F.col("c")).alias("own"), *counters(F.col("w") * F.col("c")))
    scored = scored.select("key", "doc_id", "item", "start", "both", "own", fingerprint(F.col("own")).alias("fp"))
    near = F.filter(F.sequence(F.lit(0).cast("long"), F.lit((1 << BLOCK_BITS) - 1).cast("long")), lambda v: F.bit_count(v.bitwiseXOR(F.col("b.value"))) <= BLOCK_RADIUS)
    listed = items.select("item", "whole", "item_fp", F.explode(blocks(F.col("item_fp"))).alias("b")).select("item", "whole", "item_fp", F.col("b.block").alias("block"), F.explode(near).alias("value"))
    probes = scored.withColumn("b", F.explode(blocks(F.col("fp")))).select(*scored.columns, F.col("b.block").alias("block"), F.col("b.value").alias("value"))
    close = probes.join(listed, ["item", "block", "value"]).filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)
    sure = close.withColumn("similarity", F.col("both") / (F.col("own") + F.col("whole") - F.col("both"))).filter(F.col("similarity") >= SIMILARITY)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("best")
    return sure.groupBy("key", "doc_id", "item").agg(best).select("key", "doc_id", "item", (-F.col("best.back")).cast("long").alias("start"), F.round("best.similarity", 6).alias("similarity"))


def decontaminated(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the records that hold an item; columns as they were.

    The records found grow with the corpus, so they are joined by sort and merge at every size.
    """
    key = unused_name(docs, "_key")
    held = written(leaks(docs, bench, id_col, text_col).select(F.col("key").alias(key)).distinct(), "leaking")
    return docs.withColumn(key, row_key(docs, id_col, text_col)).join(held.hint("merge"), key, "left_anti").select(*docs.columns)
