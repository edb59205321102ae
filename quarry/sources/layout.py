"""Page-layout items (JSON rows of a layout model) as blocks: texts, tables and figures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions import text as T
from quarry.operators import tables

#: A file's JSON array of items.
ITEMS = (
    "array<struct<type:string,page_idx:int,bbox:array<double>,text:string,text_level:int,table_body:string,img_path:string,"
    "table_caption:array<string>,chart_caption:array<string>,image_caption:array<string>>>"
)
#: Kinds that repeat on every page or only lead elsewhere, and kinds of figures.
SKIPPED = ("header", "footer", "page_number", "page_footnote", "page_aside_text", "aside_text", "index")
FIGURES = ("image", "chart")


def read(spark: SparkSession, path: str) -> DataFrame:
    """One JSON array of items a file: (source, pos, item columns)."""
    raw = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("source"), F.from_json("value", ITEMS).alias("items"))
    return raw.select("source", F.posexplode("items").alias("pos", "item")).select("source", "pos", "item.*")


def described(figures: DataFrame, describe: Callable[[list[bytes], list[str]], list[str]], prompt: str = "描述图片", batch: int = 12) -> DataFrame:
    """figures with content: the caption, and below it what `describe` says of the image. A batch that fails is tried again one by one; an image that fails by itself is left out."""
    columns = [c for c in figures.columns if c != "content"]
    schema = ", ".join(f"`{n}` {t}" for n, t in figures.select(*columns).dtypes) + ", content string"
    asked = figures.select(*columns, T.figure_prompt(F.lit(prompt), F.col("caption")).alias("_prompt"))

    def run(batches):
        import pyarrow as pa

        for rows in batches:
            items, told = rows.to_pylist(), []
            for at in range(0, len(items), batch):
                some = items[at : at + batch]
                try:
                    got = describe([x["image"] for x in some], [x["_prompt"] for x in some])
                    if len(got) != len(some):
                        raise ValueError("one description an image is needed")
                except Exception:  # noqa: BLE001 - one image must not take the others with it
                    got = []
                    for x in some:
                        try:
                            got += describe([x["image"]], [x["_prompt"]])[:1] or [None]
                        except Exception:  # noqa: BLE001
                            got.append(None)
                told += got
            keep = [i for i, t in enumerate(told) if t and t.strip()]
            text = [f"{items[i]['caption']}\n{told[i].strip()}" if items[i]["caption"] else told[i].strip() for i in keep]
            kept = rows.take(pa.array(keep, pa.int64())).select(columns)
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(text, pa.string())], names=[*columns, "content"])

    return asked.mapInArrow(run, schema)


def file_blocks(files: DataFrame, describe: Callable[[list[bytes], list[str]], list[str]] | None = None, **how) -> DataFrame:
    """Blocks of files (source, content) that hold a JSON array of layout items, and an error row for each that holds none. Figures need a function that describes them."""
    parsed = files.select("source", F.from_json(F.try_validate_utf8(F.col("content").cast("string")), ITEMS).alias("items"))
    items = parsed.select("source", F.posexplode("items").alias("pos", "item")).select("source", "pos", "item.*")
    made = blocks(items, **how)
    good = made.where("type <> 'figure'")
    if describe is not None:
        good = good.unionByName(described(made.where("type = 'figure'"), describe))
    slice_ = F.coalesce("table_index", F.lit(0))
    good = good.withColumn("ord", F.row_number().over(Window.partitionBy("source").orderBy("pos", slice_))).drop("pos", "image")
    bad = parsed.join(good.select("source").distinct(), "source", "left_anti").select("source", F.lit(0).alias("ord"), F.when(F.col("items").isNull(), "the file holds no layout items").otherwise("no usable content").alias("error"))
    return good.unionByName(bad, allowMissingColumns=True)


def caption() -> Column:
    one = lambda c: F.nullif(T.normalize_caption(F.array_join(F.filter(c, lambda x: x != ""), " ")), F.lit(""))
    return F.coalesce(*[one(F.col(c)) for c in ("table_caption", "chart_caption", "image_caption")], F.lit(""))


def blocks(items: DataFrame, rows_per_chunk: int = 50, min_rows: int = 2, min_columns: int = 2, min_width: float = 0.15, min_height: float = 0.05) -> DataFrame:
    """(source, pos, page, block_index, type, block_kind, heading_path, content, caption, table_index, row_start, row_end); figures have their image and no content until one describes them."""
    rows = items.where(~F.coalesce("type", F.lit("")).isin(*SKIPPED)).withColumn("page", F.coalesce("page_idx", F.lit(0)) + 1)
    rows = rows.withColumn("block_index", F.row_number().over(Window.partitionBy("source", "page").orderBy("pos"))).withColumn("caption", caption())
    text = T.strip(F.coalesce("text", F.lit("")))
    plain = ~F.col("type").isin("table", *FIGURES)
    rows = rows.withColumn("level", F.when(plain, T.heading_level(text)))
    w = Window.partitionBy("source").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    # Levels are 1 to 3: the open heading of each level is the last one at or above it, if it is of that level.
    last = [F.last(F.when(F.col("level") <= n, F.struct("level", text.alias("t"))), ignorenulls=True).over(w) for n in (1, 2, 3)]
    rows = rows.withColumn("heading_path", F.concat_ws(" > ", *[F.when(x["level"] == n, x["t"]) for n, x in enumerate(last, 1)]))
    base = ["source", "pos", "page", "block_index", "heading_path", "bbox"]
    texts = rows.where(plain & (text != "")).select(*base, F.lit("text").alias("type"), F.when(F.col("type").isin("code", "list"), F.col("type")).alias("block_kind"), text.alias("content"))
    grids = tables.grid_chunks(tables.html_tables(rows.where("type = 'table'"), "table_body"), rows_per_chunk, min_rows, min_columns)
    nth = F.row_number().over(Window.partitionBy("source", "pos").orderBy("row_start"))
    tabs = grids.select(*base, F.lit("table").alias("type"), F.lit("table").alias("block_kind"), "content", F.nullif("caption", F.lit("")).alias("caption"), nth.alias("table_index"), "row_start", "row_end")
    box = F.coalesce("bbox", F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0)))
    large = (F.abs(F.get(box, 2) - F.get(box, 0)) >= min_width) & (F.abs(F.get(box, 3) - F.get(box, 1)) >= min_height)
    image = F.try_to_binary(F.element_at(F.split("img_path", ";base64,"), -1), F.lit("base64"))
    figs = rows.where(F.col("type").isin(*FIGURES) & large & F.contains("img_path", F.lit(";base64,"))).select(*base, F.lit("figure").alias("type"), F.lit("figure").alias("block_kind"), F.nullif("caption", F.lit("")).alias("caption"), image.alias("image")).where("image is not null")
    return texts.unionByName(tabs, allowMissingColumns=True).unionByName(figs, allowMissingColumns=True)
