"""From parsed blocks to chunks: sentences cut by meaning, headings put back, whole units kept."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions import text as T
from quarry.operators import chunking as C

VERSION = "2"


@dataclass(frozen=True)
class SplitSettings:
    """threshold: percentile of a block's distances above which it is cut; buffer: sentences to either side that an embedder sees too."""

    threshold: float = 82.0
    buffer: int = 1
    min_chars: int = 20
    most_bytes: int = C.MAX_BYTES


@dataclass
class Chunker:
    """embed: from a text to its vector (array<double>), as a Column function; without one blocks are not cut by meaning. embed_name goes into the fingerprint, as another model cuts elsewhere."""

    embed: Callable[[Column], Column] | None = None
    embed_name: str = ""
    settings: SplitSettings = field(default_factory=SplitSettings)

    @property
    def fingerprint(self) -> str:
        s = self.settings
        return f"chunk-{VERSION}-" + "|".join(map(str, ("percentile", s.threshold, s.buffer, T.SENTENCE_END, s.min_chars, s.most_bytes, self.embed_name if self.embed else "none")))

    def split_texts(self, prose: DataFrame) -> DataFrame:
        """Rows of prose with `piece` (their number in the block) and their own content: cut by meaning, then headings at a piece's end moved to the next one of the same source."""
        rows = prose.withColumn("piece", F.lit(0).cast("long"))
        if self.embed is not None:
            key = F.struct("source", "ord")
            sents = prose.select(key.alias("block"), F.posexplode(T.sentences(F.col("content"))).alias("i", "sentence"))
            n = F.count("*").over(Window.partitionBy("block"))
            many = sents.withColumn("n", n).where("n > 1")
            seen = C.sentence_windows(many, self.settings.buffer)
            cut = C.semantic_chunks(seen.withColumn("v", self.embed(F.col("embed")).cast("array<double>")), amount=self.settings.threshold)
            cut = cut.where(T.strip(F.col("content")) != "")  # what follows a last sentence end; a heading must not move there
            cut = cut.select(F.col("block.source").alias("source"), F.col("block.ord").alias("ord"), F.col("chunk").alias("piece"), F.col("content").alias("_part"))
            rows = prose.join(cut, ["source", "ord"], "left").withColumn("piece", F.coalesce("piece", F.lit(0).cast("long"))).withColumn("content", F.coalesce("_part", "content")).drop("_part")
        rows = rows.withColumn("_at", F.struct("ord", "piece"))
        return C.restore_headings(rows, self.settings.min_chars, order="_at").drop("_at")

    def split(self, blocks: DataFrame) -> DataFrame:
        """Chunks of blocks (source, ord, type, block_kind, content, ...): prose cut and filtered by length, then code and lists, tables and figures whole, in this order; what is oversized is packed. ord is numbered anew."""
        code = F.coalesce(F.col("block_kind").isin(*C.WHOLE_UNITS), F.lit(False))
        kind = F.when(F.col("type") == "figure", 3).when(F.col("type") == "table", 2).when(code, 1).otherwise(0)
        rows = blocks.where(F.col("content").isNotNull()).withColumn("_class", kind)
        prose = self.split_texts(rows.where("_class = 0"))
        prose = C.keep_meaningful(prose, self.settings.min_chars)
        every = prose.unionByName(rows.where("_class > 0").withColumn("piece", F.lit(0).cast("long")))
        columns = [c for c in every.columns if c != "content"]
        parts = every.select(*columns, F.posexplode(C.split_oversized(F.col("content"), self.settings.most_bytes)).alias("_k", "content"))
        at = Window.partitionBy("source").orderBy("_class", "ord", "piece", "_k")
        return parts.withColumn("ord", F.row_number().over(at)).select(*blocks.columns)


def by_block(blocks: DataFrame, min_chars: int = 20) -> DataFrame:
    """Blocks as they are, without what is too short, tables included."""
    return C.keep_meaningful(blocks.where(F.col("content").isNotNull()), min_chars)


def by_length(blocks: DataFrame, size: int = 800, overlap: int = 100, min_chars: int = 20) -> DataFrame:
    """Blocks cut by length at separators, without what is too short."""
    columns = [c for c in blocks.columns if c != "content"]
    rows = blocks.where(F.col("content").isNotNull()).select(*columns, F.explode(C.recursive_split(F.col("content"), size, overlap)).alias("content"))
    return C.keep_meaningful(rows, min_chars).select(*blocks.columns)
