"""Mixing sources to target weights by weighted fair queueing.

Documents of a source are shuffled by a hash of their id. Each gets a virtual
finish time: the source's words so far, over the source's target. All are
ordered by virtual time and cut at the total budget, so that at any point of the
order the sources stand in proportion to their targets. A source whose target
exceeds its size starts over, at most COPIES times in all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of, unused_name, written

COPIES = 3
WORD = "[^\\x20\\x09-\\x0D]+"
BINS = 1024


def n_words(df: DataFrame, text_col: str = "text") -> Column:
    return F.regexp_count(text_of(df, text_col), F.lit(WORD)).cast("long")


def order_hash(df: DataFrame, id_col: str, text_col: str) -> Column:
    """Of the id; of the text where there is none, so that records without id spread too."""
    return F.md5(F.coalesce(df[id_col].cast("string"), F.concat(F.lit("text:"), text_of(df, text_col))).cast("binary"))


def targets(per_source: DataFrame) -> DataFrame:
    """Rows (source, source_size) with rank, weight and target.

    Weights are 1, 2, 3, repeating over sources by code point, null last. A target is weight x level, at most
    COPIES x size; the level is such that targets add up to all sizes. Sources whose limit over weight is
    lowest meet their limits first, so the level is found in that order. The windows without keys hold one
    row a source.
    """
    w = per_source.withColumn("source_rank", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")))
    w = w.withColumn("weight", (F.col("source_rank") - 1) % 3 + 1).withColumn("cap", F.col("source_size") * COPIES)
    by_limit = Window.orderBy(F.col("cap") / F.col("weight"), "source_rank")
    w = w.withColumn("total", F.sum("source_size").over(Window.partitionBy())).withColumn("all_weight", F.sum("weight").over(Window.partitionBy()))
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("left_weight", F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    # the first source whose limit is not below its share of what is left sets the level for itself and all after it
    w = w.withColumn("open", F.col("cap") * F.col("left_weight") >= F.col("left") * F.col("weight"))
    first = F.min(F.when(F.col("open"), F.struct((F.col("cap") / F.col("weight")).alias("limit"), "source_rank", "left", "left_weight"))).over(Window.partitionBy())
    w = w.withColumn("first", first)
    above = F.struct((F.col("cap") / F.col("weight")).alias("limit"), "source_rank") >= F.struct(F.col("first.limit").alias("limit"), F.col("first.source_rank").alias("source_rank"))
    shared = (F.col("weight") * F.col("first.left")).cast("double") / F.col("first.left_weight")
    return w.select("source", "source_size", "source_rank", F.when(above, shared).otherwise(F.col("cap").cast("double")).alias("target"), "total")


def queued(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: bool = False) -> DataFrame:
    """Each record with its size, its source's size, rank and target, and `upto`: the source's words in shuffled order up to and with it.

    The running sum goes over buckets of the hash (4096 a source), so that a source with a third of all
    rows spreads over thousands of window groups. carry keeps the text.
    """
    kept = df.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(df, text_col).alias("size"), order_hash(df, id_col, text_col).alias("order_hash"), *([df[text_col].alias("text")] if carry else [])
    )
    kept = kept.withColumn("skey", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).withColumn("bucket", F.conv(F.substring("order_hash", 1, 3), 16, 10).cast("int"))
    kept = written(kept, "mix-sizes")
    buckets = kept.groupBy("skey", "bucket").agg(F.sum("size").alias("bucket_size"))
    start = F.sum("bucket_size").over(Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = buckets.select("skey", "bucket", F.coalesce(start, F.lit(0)).alias("start"))
    per_source = buckets.groupBy("skey").agg(F.sum("bucket_size").alias("source_size")).select(F.when(F.col("skey") != "n", F.substring("skey", 2, 1 << 30)).alias("source"), "source_size")
    goals = targets(per_source).select(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("skey"), "source_size", "source_rank", "target", "total")
    within = F.sum("size").over(Window.partitionBy("skey", "bucket").orderBy("order_hash", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    run = kept.withColumn("within", within)
    return run.join(starts.join(goals, "skey"), ["skey", "bucket"]).select(*[c for c in kept.columns if c not in ("skey", "bucket")], "source_size", "source_rank", "target", "total", (F.col("start") + F.col("within")).alias("upto"))


def finish_key(copy: int) -> Column:
    """What the mix is ordered by, for a record's copy 0, 1 or 2; null where the source has no words."""
    upto = F.col("upto") + F.lit(copy) * F.col("source_size")
    return F.when(F.col("target") > 0, F.struct((upto.cast("double") / F.col("target")).alias("at"), F.col("source_rank").alias("source_rank"), F.lit(copy).alias("copy"), upto.alias("upto")))


def cut(queue: DataFrame) -> tuple | None:
    """The last key whose running total stays within the budget, by three passes over ever finer ranges of virtual time.

    A pass brings the sums of at most some thousands of ranges to the driver; only the records of one range,
    about a millionth of all, are ordered in one task.
    """
    items = queue.select("size", "total", F.explode(F.array(*[finish_key(k) for k in range(COPIES)])).alias("key")).filter("key is not null and size > 0")
    items = items.withColumn("level", F.log2(1 + F.col("key.at")) * BINS)
    total = queue.select("total").head()
    if total is None:
        return None
    before, budget, inside = 0, total[0], items
    for fine in (F.floor("level"), F.floor((F.col("level") - F.floor("level")) * BINS)):
        ranges = inside.groupBy(fine.alias("range")).agg(F.sum("size").alias("size")).orderBy("range").collect()
        over = None
        for r in ranges:
            if before + r["size"] > budget:
                over = r["range"]
                break
            before += r["size"]
        if over is None:  # all fit
            last = inside.agg(F.max("key")).head()[0]
            return tuple(last) if last else None
        inside = inside.filter(fine == over)
    run = F.sum("size").over(Window.orderBy("key").rowsBetween(Window.unboundedPreceding, 0))
    fits = inside.withColumn("run", run).filter(F.col("run") + F.lit(before) <= budget).agg(F.max("key")).head()[0]
    if fits is None:  # the cut falls on the edge before this range
        first = inside.agg(F.min("key")).head()[0]
        fits = items.filter(F.col("key") < key_literal(tuple(first))).agg(F.max("key")).head()[0]
    return tuple(fits) if fits else None


def key_literal(key: tuple) -> Column:
    at, rank, copy, upto = key
    return F.struct(F.lit(at).alias("at"), F.lit(rank).alias("source_rank"), F.lit(copy).alias("copy"), F.lit(upto).cast("long").alias("upto"))


def mixed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: bool = False) -> DataFrame:
    """One row per record: doc_id, source, size, source_size, target, copies (0 to 3), taken (copies x size), first_at (virtual time of copy 0).

    Sizes are words; the budget is the sum of all sizes. Null text has size 0; null is a source of its own,
    ranked last. Empty records and sources without words get copies 0. Rows that agree in id and size stand
    next to each other; which of them is first does not matter. An empty table gives no rows.
    """
    queue = written(queued(df, id_col, text_col, source_col, carry), "mix-queue")
    last = cut(queue)
    took = [F.coalesce((finish_key(k) <= key_literal(last)) & (F.col("size") > 0), F.lit(False)).cast("int") for k in range(COPIES)] if last else [F.lit(0)]
    copies = sum(took[1:], took[0])
    out = queue.withColumn("copies", copies)
    return out.select("doc_id", "source", *(["text"] if carry else []), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"), finish_key(0)["at"].alias("first_at"))


def sampled(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """df with each record as often as the mix takes it (0 to COPIES times); columns as they were.

    Records that share an id are each taken as often as the most taken of them (ids are distinct in the
    pipeline). Texts meet the counts by a sort-merge join at every size, as the counts grow with the corpus.
    """
    have, many = unused_name(df, "_have"), unused_name(df, "_copies")
    taken = mixed(df, id_col, text_col, source_col).groupBy("doc_id").agg(F.max("copies").alias(many)).filter(F.col(many) > 0)
    taken = written(taken.withColumnRenamed("doc_id", have), "mix-taken")
    each = df.join(taken.hint("merge"), df[id_col].eqNullSafe(taken[have])).withColumn(many, F.explode(F.array_repeat(F.lit(1), F.col(many).cast("int"))))
    return each.select(*df.columns)
