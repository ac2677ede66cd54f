"""Tables of a page layout: cells, boxes, grids, Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quality import scaled_box

CELL = "struct<bbox:array<double>,box:array<double>,text:string>"
BLOCK = f"struct<type:string,page:int,page_index:int,data:struct<rows:array<array<{CELL}>>,cells:array<{CELL}>,n_rows:int,n_cols:int>>"
LAYOUT = f"blocks array<{BLOCK}>, pages array<struct<blocks:array<{BLOCK}>>>"


def layout_tables(df: DataFrame, key: str, json: str) -> DataFrame:
    """key, table_no (from 1), page, data: table blocks of layout JSON. Blocks win over pages even when they are empty."""
    parsed = df.select(key, F.from_json(F.col(json), LAYOUT).alias("l"))
    of_pages = F.flatten(F.transform(F.coalesce("l.pages", F.array().cast(f"array<struct<blocks:array<{BLOCK}>>>")), lambda p: F.coalesce(p["blocks"], F.array().cast(f"array<{BLOCK}>"))))
    blocks = F.filter(F.coalesce("l.blocks", of_pages), lambda b: F.lower(b["type"]).contains("table"))
    each = parsed.select(key, F.posexplode(blocks).alias("at", "b"))
    page = F.coalesce(F.nullif(F.col("b.page"), F.lit(0)), F.nullif(F.col("b.page_index"), F.lit(0)), F.lit(0))
    return each.select(key, (F.col("at") + 1).alias("table_no"), page.alias("page"), F.col("b.data").alias("data"))


def box_of(cell: Column) -> Column:
    box = F.when(F.size(cell["bbox"]) > 0, cell["bbox"]).otherwise(cell["box"])
    return F.when(F.size(box) == 4, box)


def grid_cells(tables: DataFrame, key: str, dpi: int = 300) -> DataFrame:
    """key, table_no, page, row, col, box (in pixels, null without one), text: every cell of each grid, text '' where a cell is not there.

    The grid is the rows as listed, as wide as the widest, else n_rows by n_cols over a flat list; a table
    with neither is left out. A place beyond a list is a cell without box.
    """
    d = "data"
    by_rows = F.col(f"{d}.rows").isNotNull()
    n_rows = F.when(by_rows, F.size(f"{d}.rows")).otherwise(F.col(f"{d}.n_rows"))
    widest = F.aggregate(F.transform(f"{d}.rows", F.size), F.lit(0), lambda a, b: F.greatest(a, b))
    n_cols = F.when(by_rows, widest).otherwise(F.col(f"{d}.n_cols"))
    sized = tables.withColumn("n_rows", n_rows).withColumn("n_cols", n_cols).filter("n_rows > 0 and n_cols > 0")
    steps = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    places = sized.withColumn("row", F.explode(steps("n_rows"))).withColumn("col", F.explode(steps("n_cols")))
    cell = F.when(by_rows, F.get(F.get(F.col(f"{d}.rows"), F.col("row")), F.col("col"))).otherwise(F.get(F.col(f"{d}.cells"), F.col("row") * F.col("n_cols") + F.col("col")))
    box = box_of(F.col("cell"))
    got = places.withColumn("cell", cell).withColumn("box", box)
    return got.select(key, "table_no", "page", "row", "col", scaled_box(F.col("box"), dpi).alias("box"), F.when(F.col("box").isNotNull(), F.coalesce("cell.text", F.lit(""))).otherwise("").alias("text"))


def grid_markdown(cells: DataFrame, key: str) -> DataFrame:
    """A Markdown text for each table: the separator line, then a line for each row."""
    clean = F.regexp_replace(F.regexp_replace("text", "\n", " "), "^\\s+|\\s+$", "")
    line = F.concat(F.lit("|"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", clean.alias("t")))), lambda c: c["t"]), "|"), F.lit("|"))
    rows = cells.groupBy(key, "table_no", "row").agg(line.alias("line"), F.count("*").alias("n"))
    head = F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit(" --- "), F.max("n").cast("int")), "|"), F.lit("|"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda r: r["line"]), "\n")
    return rows.groupBy(key, "table_no").agg(F.concat_ws("\n", head, body).alias("markdown"))


def markdown_documents(pages: DataFrame, key: str, page: str, text: str, head: str = "# Page ") -> DataFrame:
    """Pages of each document under headings, in order, as one text."""
    part = F.concat(F.lit(head), F.col(page).cast("string"), F.lit("\n"), F.coalesce(F.col(text), F.lit("")), F.lit("\n"))
    parts = F.array_sort(F.collect_list(F.struct(F.col(page).alias("page"), part.alias("part"))))
    return pages.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p["part"]), "\n").alias("markdown"), F.count("*").alias("pages"))
