"""Sheets and HTML tables to pipe tables."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions import text as T


def cell_value() -> Column:
    """Text of a cell (value, vtype, formula, cached): formulas with their cached result."""
    plain = F.when(F.col("value").isNull(), F.lit("")).when(F.col("vtype") == "boolean", F.upper("value")).otherwise(T.strip(F.col("value")))
    formula = F.coalesce("formula", F.lit("表达式不可用"))
    return F.when(F.col("vtype") != "formula", plain).when(F.col("cached").isNull(), F.concat(F.lit("公式："), formula, F.lit("（无缓存结果）"))).otherwise(F.concat(T.strip(F.col("cached")), F.lit("（缓存结果；公式："), formula, F.lit("）")))


def expand_merges(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """(sheet, row, col, text) where each cell of a merged area has its top-left text: a range join within a sheet, then one back to the corner."""
    c = cells.withColumn("text", cell_value()).select("sheet", "row", "col", "text")
    m = merges.select(F.col("sheet").alias("ms"), "min_row", "min_col", "max_row", "max_col")
    # Areas are spread over their own cells, so the join is by equality and no sheet meets all of its areas.
    inside = m.withColumn("row", F.explode(F.sequence("min_row", "max_row"))).withColumn("col", F.explode(F.sequence("min_col", "max_col"))).select(F.col("ms").alias("sheet"), "row", "col", "min_row", "min_col")
    rows = c.join(inside, ["sheet", "row", "col"], "full_outer")
    corner = c.select("sheet", F.col("row").alias("min_row"), F.col("col").alias("min_col"), F.col("text").alias("corner"))
    return rows.join(corner, ["sheet", "min_row", "min_col"], "left").select("sheet", "row", "col", F.when(F.col("min_row").isNotNull(), F.coalesce("corner", F.lit(""))).otherwise(F.coalesce("text", F.lit(""))).alias("text"))


def regions(cells: DataFrame) -> DataFrame:
    """(sheet, region, row, col, text): rows with some text, numbered by the runs between blank rows."""
    filled = cells.where("text <> ''")
    w = Window.partitionBy("sheet").orderBy("row")
    rows = filled.select("sheet", "row").distinct().withColumn("gap", F.when(F.col("row") - F.lag("row").over(w) > 1, 1).otherwise(0))
    rows = rows.withColumn("region", F.sum("gap").over(w)).select("sheet", "row", "region")
    return rows.join(filled, ["sheet", "row"])


def sheet_chunks(cells: DataFrame, header_rows: int = 1, rows_per_chunk: int = 50) -> DataFrame:
    """Chunks of each region: header labels, at most rows_per_chunk data rows, and where they lie. A region that is all header stays as one chunk."""
    found = regions(cells)
    by = ["sheet", "region"]
    box = found.groupBy(*by).agg(F.min("col").alias("left"), F.max("col").alias("right"))
    rn = F.dense_rank().over(Window.partitionBy(*by).orderBy("row"))
    rows = found.withColumn("rn", rn).groupBy(*by, "row", "rn").agg(F.map_from_entries(F.collect_list(F.struct("col", "text"))).alias("cells"))
    rows = rows.join(box, by)
    cols = F.sequence("left", "right")
    texts = F.transform(cols, lambda c: F.coalesce(F.element_at("cells", c), F.lit("")))
    rows = rows.withColumn("texts", texts)
    head = rows.where(F.col("rn") <= header_rows).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("rn", "row", "texts"))).alias("h"))
    rows = rows.join(head, by, "left")

    def label(c: Column, i: Column) -> Column:
        seen = F.filter(F.transform("h", lambda r: F.get(r["texts"], i)), lambda x: x != "")
        seen = F.filter(seen, lambda x, k: (k == 0) | (x != F.get(seen, k - 1)))
        return F.when(F.size(seen) > 0, F.array_join(seen, " / ")).otherwise(F.concat(T.column_letters(c), F.lit("列")))

    heads = F.when(F.col("h").isNull(), F.transform(cols, lambda c: F.concat(T.column_letters(c), F.lit("列")))).otherwise(F.transform(cols, lambda c, i: label(c, i)))
    rows = rows.withColumn("labels", F.transform(heads, T.escape_cell))
    n = F.max("rn").over(Window.partitionBy(*by))
    rows = rows.withColumn("n", n).withColumn("data", F.col("rn") > header_rows).where(F.col("data") | (F.col("n") <= header_rows))
    rows = rows.withColumn("slice", F.when(F.col("data"), F.floor((F.col("rn") - header_rows - 1) / rows_per_chunk)).otherwise(F.lit(0)))
    line = F.when(F.col("data"), F.concat(F.lit("| "), F.col("row"), F.lit(" | "), F.array_join(F.transform("texts", T.escape_cell), " | "), F.lit(" |")))
    out = rows.groupBy(*by, "slice", "left", "right", "labels").agg(F.array_sort(F.collect_list(F.struct("row", line.alias("line")))).alias("lines"), F.min("row").alias("row_start"), F.max("row").alias("row_end"), F.min(F.get(F.col("h.row"), 0)).alias("header_row_start"), F.min(F.element_at(F.col("h.row"), -1)).alias("header_row_end"))
    content = F.array_join(
        F.concat(
            F.array(F.concat(F.lit("工作表："), F.col("sheet")), F.concat(F.lit("| 原文行 | "), F.array_join("labels", " | "), F.lit(" |")), F.concat(F.lit("| --- | "), F.array_join(F.transform("labels", lambda _: F.lit("---")), " | "), F.lit(" |"))),
            F.filter(F.col("lines.line"), lambda x: x.isNotNull()),
        ),
        "\n",
    )
    return out.select("sheet", "row_start", "row_end", T.column_letters(F.col("left")).alias("column_start"), T.column_letters(F.col("right")).alias("column_end"), "header_row_start", "header_row_end", content.alias("content"))


class _Cells(HTMLParser):
    """Collects cells with their spans; the grid is laid out afterwards."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list[tuple[str, int, int]]] = []
        self.row: list | None = None
        self.text: list[str] | None = None
        self.span = (1, 1)

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.row = []
        elif tag in ("td", "th"):
            size = lambda v: int(v) if v and v.isdigit() and int(v) > 0 else 1
            given = dict(attrs)
            self.text, self.span = [], (size(given.get("colspan")), size(given.get("rowspan")))
        elif tag in ("br", "p") and self.text is not None:
            self.text.append(" ")

    def handle_data(self, data):
        if self.text is not None:
            self.text.append(data)

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.row is not None and self.text is not None:
            self.row.append((re.sub(r"\s+", " ", "".join(self.text)).strip(), *self.span))
            self.text = None
        elif tag == "tr" and self.row is not None:
            self.rows.append(self.row)
            self.row = None


def html_grid(html: str | None) -> list[list[str]]:
    """Rows of cell texts; a cell that spans leaves empty cells to its right and, in its first column, below."""
    reader = _Cells()
    reader.feed(html or "")
    reader.close()
    held: dict[int, int] = {}  # column: rows below that it still fills
    grid = []
    for cells in reader.rows:
        line: list[str] = []
        fresh: dict[int, int] = {}
        for text, wide, tall in cells:
            while held.get(len(line), 0) > 0:
                held[len(line)] -= 1
                line.append("")
            if tall > 1:
                fresh[len(line)] = tall - 1
            line += [text, *[""] * (wide - 1)]
        held.update(fresh)
        grid.append(line)
    return grid


def html_tables(tables: DataFrame, html_col: str = "html") -> DataFrame:
    """Adds grid array<array<string>>, read from HTML in Arrow batches."""

    @F.pandas_udf("array<array<string>>")
    def read(html):
        return html.map(html_grid)

    return tables.withColumn("grid", read(F.col(html_col).cast("string")))


def grid_chunks(tables: DataFrame, rows_per_chunk: int = 50, min_rows: int = 2, min_columns: int = 2) -> DataFrame:
    """Explodes each grid into slices (content, row_start, row_end); grids without enough rows or columns, or with a header only, give none."""
    filled = lambda row: F.exists(row, lambda x: T.strip(x) != "")
    rows = F.filter("grid", filled)
    t = tables.withColumn("grid", rows).where(F.size("grid") >= min_rows)
    t = t.withColumn("width", F.array_max(F.transform("grid", F.size)))
    t = t.withColumn("grid", F.transform("grid", lambda r: F.concat(r, F.array_repeat(F.lit(""), F.col("width") - F.size(r)))))
    t = t.withColumn("used", F.filter(F.sequence(F.lit(0), F.col("width") - 1), lambda i: F.exists("grid", lambda r: T.strip(F.get(r, i)) != ""))).where(F.size("used") >= min_columns)
    t = t.withColumn("grid", F.transform("grid", lambda r: F.concat(F.lit("| "), F.array_join(F.transform("used", lambda i: T.escape_cell(F.get(r, i))), " | "), F.lit(" |")))).where(F.size("grid") >= 2)
    n = F.size("grid") - 1
    t = t.withColumn("start", F.explode(F.sequence(F.lit(0), F.floor((n - 1) / rows_per_chunk)))).withColumn("row_start", (F.col("start") * rows_per_chunk + 1).cast("int"))
    t = t.withColumn("row_end", F.least(F.col("row_start") + rows_per_chunk - 1, n).cast("int"))
    where = F.concat(F.lit("（第 "), F.col("row_start"), F.lit("—"), F.col("row_end"), F.lit(" 行）"))
    title = F.when(F.coalesce("caption", F.lit("")) != "", F.concat(F.lit("表格："), F.col("caption"), where)).otherwise(F.concat(F.lit("表格"), where))
    line = F.concat(F.lit("| "), F.array_join(F.transform("used", lambda _: F.lit("---")), " | "), F.lit(" |"))
    content = F.array_join(F.concat(F.array(title, F.get("grid", 0), line), F.slice("grid", F.col("row_start") + 1, F.lit(rows_per_chunk))), "\n")
    return t.withColumn("content", content).drop("grid", "width", "used", "start")
