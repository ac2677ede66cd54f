"""Aggregates of page scores by document and model. All results are ready to plot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quality import CLASSES, ordinal


def class_counts(pages: DataFrame, by: list[str], cls: str = "class", names: tuple[str, ...] = CLASSES) -> DataFrame:
    """A row for each group and class, 0 where a class does not occur."""
    wide = pages.groupBy(*by).agg(*[F.count_if(F.col(cls) == n).alias(n) for n in names])
    return wide.unpivot(by, list(names), cls, "n")


def class_shares(pages: DataFrame, by: list[str], cls: str = "class", names: tuple[str, ...] = CLASSES) -> DataFrame:
    """A column for each class: its share of the group's pages."""
    total = F.count_if(F.col(cls).isin(*names))
    return pages.groupBy(*by).agg(*[F.round(F.try_divide(F.count_if(F.col(cls) == n), total), 4).alias(n.lower()) for n in names])


def mean_pivot(pages: DataFrame, row: str, column: str, values: list, score: str, digits: int = 4) -> DataFrame:
    """Mean score, rows by columns; the columns are named, so no extra pass looks for them."""
    return pages.groupBy(row).agg(*[F.round(F.avg(F.when(F.col(column) == v, F.col(score))), digits).alias(f"{column}_{v}") for v in values])


def first_pivot(pages: DataFrame, row: str, column: str, values: list, value: str, order: str) -> DataFrame:
    """The value that comes first in `order`, rows by columns."""
    return pages.groupBy(row).agg(*[F.min_by(F.when(F.col(column) == v, F.col(value)), F.when(F.col(column) == v, F.col(order))).alias(f"{column}_{v}") for v in values])


def dominant_class(pages: DataFrame, by: list[str], order: str, cls: str = "class") -> DataFrame:
    """The most frequent class of each group; of equals the one that occurs first."""
    n = pages.groupBy(*by, cls).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    best = F.max_by(F.col(cls), F.struct("n", (-F.col("first")).alias("early")))
    out = n.groupBy(*by).agg(best.alias("dominant"), F.max("n").alias("pages"))
    return out.withColumn("dominant_ord", ordinal(F.col("dominant")))


def worst_class(pages: DataFrame, by: list[str], order: str, cosine: str, lpips: str, cls: str = "class") -> DataFrame:
    """Means, pages, worst class (of equals the first) and share of all pages. Unknown labels count as the best class."""
    worst = F.max_by(F.col(cls), F.struct(ordinal(F.col(cls)).alias("o"), (-F.col(order)).alias("early")))
    out = pages.groupBy(*by).agg(F.round(F.avg(cosine), 4).alias("mean_cosine"), F.round(F.avg(lpips), 4).alias("mean_lpips"), F.count("*").alias("pages"), worst.alias("worst"))
    total = pages.agg(F.count("*").alias("_all"))  # one row
    return out.crossJoin(F.broadcast(total)).withColumn("share", F.round(F.col("pages") / F.col("_all"), 4)).drop("_all")


def class_summary(pages: DataFrame, cosine: str, lpips: str, cls: str = "class") -> DataFrame:
    return pages.filter(F.col(cls).isNotNull()).groupBy(cls).agg(F.count("*").alias("n"), F.round(F.avg(cosine), 4).alias("mean_cosine"), F.round(F.avg(lpips), 4).alias("mean_lpips"))


def boxplot(pages: DataFrame, by: list[str], score: str, digits: int = 4) -> DataFrame:
    """Quartiles (linear), whiskers to the last value within 1.5 times their range, and how many lie beyond."""
    q = pages.groupBy(*by).agg(F.percentile(score, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    q = q.select(*by, *[F.col("q")[i].alias(n) for i, n in enumerate(("q1", "median", "q3"))])
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    low, high = F.col("q1") - reach, F.col("q3") + reach
    inside = (F.col(score) >= low) & (F.col(score) <= high)
    out = pages.join(q, by).groupBy(*by, "q1", "median", "q3").agg(F.min(F.when(inside, F.col(score))).alias("low"), F.max(F.when(inside, F.col(score))).alias("high"), F.count_if(~inside).alias("fliers"), F.count("*").alias("n"))
    return out.select(*by, *[F.round(c, digits).alias(c) for c in ("q1", "median", "q3", "low", "high")], "fliers", "n")


def histogram(pages: DataFrame, score: str, bins: int = 20) -> DataFrame:
    """bin (from 0), n, density over equal widths from least to greatest; the greatest value is in the last bin."""
    ends = pages.agg(F.min(score).alias("lo"), F.max(score).alias("hi"), F.count(score).alias("total"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col(score) - F.col("lo")) / width))).otherwise(F.lit(0))
    counted = pages.filter(F.col(score).isNotNull()).join(F.broadcast(ends), F.lit(True)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"), F.max("total").alias("total"), F.max(width).alias("width"))
    every = pages.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counted, "bin", "left").select("bin", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.round(F.coalesce(F.try_divide(F.col("n"), F.col("total") * F.col("width")), F.lit(0.0)), 4).alias("density"))


def kde(pages: DataFrame, by: list[str], score: str, points: int = 50) -> DataFrame:
    """Gaussian density of each group on `points` places from least to greatest value, bandwidth by Scott's rule.

    Groups of one distinct value are left out. The grid is summed where the values are: a row carries its group's
    grid only inside the aggregate, whose size is groups times points.
    """
    stats = pages.groupBy(*by).agg(F.min(score).alias("lo"), F.max(score).alias("hi"), F.count(score).alias("m"), F.stddev_samp(score).alias("sd"))
    stats = stats.filter("hi > lo").withColumn("h", F.col("sd") * F.pow(F.col("m").cast("double"), F.lit(-0.2)))
    at = pages.sparkSession.range(points).select(F.col("id").cast("int").alias("point"))
    rows = pages.select(*by, score).join(stats, by) if by else pages.select(score).join(F.broadcast(stats), F.lit(True))
    x = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("point") / (points - 1)
    grid = rows.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    bump = F.exp(-F.pow((x - F.col(score)) / F.col("h"), 2) / 2)
    out = grid.groupBy(*by, "point").agg(F.max(x).alias("x"), (F.sum(bump) / (F.max("m") * F.max("h") * F.lit(2.5066282746310002))).alias("density"))
    return out.select(*by, "point", F.round("x", 4).alias("x"), F.round("density", 6).alias("density"))


def first_copies(pages: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key."""
    rest = [c for c in pages.columns if c not in keys]
    return pages.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("r")).select(*keys, "r.*")


def share_total(pages: DataFrame, by: list[str], cls: str = "class") -> DataFrame:
    """The sum of the class shares: 1 wherever there are pages."""
    shares = class_shares(pages, by, cls)
    return shares.select(*by, F.round(sum((F.col(n.lower()) for n in CLASSES), F.lit(0.0)), 2).alias("total"))


def perf_summary(samples: DataFrame) -> DataFrame:
    mean = lambda c: F.coalesce(F.round(F.avg(c), 2), F.lit(0.0)).alias(f"avg_{c}")
    return samples.agg(F.countDistinct("doc_id").alias("documents"), mean("cpu"), mean("ram_mb"))


def mean_or_null(c: Column) -> Column:
    return F.avg(F.when(~F.isnan(c), c))
