"""What several operators share: tables in the shared folder and connected components."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. In local mode, where driver and executors are one process, a folder of our own if that is unset."""
    sc = spark.sparkContext
    given = sc.getConf().get("spark.checkpoint.dir", None)
    if given:
        return given
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not getattr(sc, "_quarry_dir", None):
        sc._quarry_dir = tempfile.mkdtemp(prefix="quarry-")
    return sc._quarry_dir


def _remover(spark: SparkSession, path: str):
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def drop() -> None:
        try:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
        except Exception:  # the session may have ended before the interpreter
            pass

    return drop


def written(df: DataFrame, name: str = "t") -> DataFrame:
    """df as Parquet in the shared folder, read again: lineage ends there and a lost executor costs nothing. Gone at the interpreter's end, or with discard()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quarry-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quarry_drop = _remover(spark, path)
    atexit.register(out._quarry_drop)
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for df in tables:
        df._quarry_drop()
        atexit.unregister(df._quarry_drop)


def _width(df: DataFrame) -> Column:
    """About how many bytes a row takes once sent."""
    total = F.lit(16 * len(df.columns))
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("string", "binary"):
            total = total + F.coalesce(F.octet_length(c), F.lit(0))
        elif kind.startswith("array"):
            total = total + 16 * F.coalesce(F.size(c), F.lit(0))
    return total.cast("long")


def sent(df: DataFrame, most_bytes: int = 8 << 20) -> DataFrame:
    """df to be sent to every task if its measured size is small; else as it is, for a join by exchange. df should be a written table."""
    size = df.agg(F.coalesce(F.sum(_width(df)), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= most_bytes else df


#: Bits of a key filter, 8 MB at most, dealt over rows of 32,768 bits.
FILTER_BITS = 26


def flagged(df: DataFrame, key: Column, wanted: DataFrame, wanted_key: str, flag: str) -> DataFrame:
    """df with a boolean column: false where the key surely is not in wanted. One hash bit a key, in a filter whose size does not
    depend on the tables, so that most rows can be told apart before anything is exchanged."""
    bit = lambda c: F.shiftrightunsigned(F.xxhash64(c, F.lit("filter")), 64 - FILTER_BITS)
    spot = wanted.select(bit(F.col(wanted_key)).alias("_bit"))
    rows = spot.groupBy(F.shiftright("_bit", 15).alias("_row")).agg(F.bitmap_construct_agg(F.col("_bit") % 32768).alias("_bits"))
    at = df.withColumn("_bit", bit(key)).withColumn("_row", F.shiftright("_bit", 15))
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.shiftright(F.col("_bit") % 32768, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    inside = byte.bitwiseAND(F.pow(F.lit(2), F.col("_bit") % 8).cast("int")) != 0
    return at.join(F.broadcast(rows), "_row", "left").select(*[f"`{c}`" for c in df.columns], F.coalesce(inside, F.lit(False)).alias(flag))


def maybe_in(df: DataFrame, key: Column, wanted: DataFrame, wanted_key: str) -> DataFrame:
    """The rows of df whose key may be in wanted, for a join to follow."""
    return flagged(df, key, wanted, wanted_key, "_maybe").where("_maybe").drop("_maybe")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts go to Python workers in batches of fewer rows than Spark's default, so that a batch of long texts stays small. A session's own setting is kept."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000" and spark.sparkContext.getConf().get(key, None) is None:
        spark.conf.set(key, str(rows))


def trim() -> None:
    """At a task's end: gives free memory back, as Python workers live on."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back:
        give_back(0)


_resident: dict = {}


def resident(key=None, make=None):
    """What a Python worker keeps under this key for its next tasks, made if it is not there. Workers live on and serve all operators: what another one keeps goes first, and without a key
    that is all, so that tables of one operator are held at a time."""
    if key not in _resident:
        if _resident:
            _resident.clear()
            trim()
        if key is not None:
            _resident[key] = make()
    return _resident.get(key)


def sweep(spark: SparkSession) -> None:
    """Lets Spark drop shuffle files that nothing needs any more, and gives the driver's free memory back."""
    gc.collect()
    trim()
    spark._jvm.System.gc()


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """Connected components of edges(a long, b long): rows (node, root) of every node in an edge, root the smallest node reachable.

    Alternates large-star and small-star steps, each a grouped minimum and an equi-join, until no edge
    changes; the edges stay distributed and no group of neighbours is gathered. After a given number of rounds the groups
    are parts of components. Self-loops and nulls are ignored; an empty table gives an empty table.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = written(e, "edges")
    mark, done = None, 0
    while rounds is None or done < rounds:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        kept = low.select("u", F.col("m").alias("v"))
        moved = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, e, done = e, written(kept.union(moved).distinct(), "edges"), done + 1
        discard(before)
        if rounds is None:
            digest = lambda k: F.sum(F.xxhash64("u", "v", F.lit(k)).cast("decimal(38,0)"))
            now = e.agg(F.count("*"), digest(1), digest(2)).first()
            if now == mark:
                break
            mark = now
    roots = e.groupBy("u").agg(F.min("v").alias("root"))
    return roots.select(F.col("u").alias("node"), "root").union(e.select("v").distinct().join(e.select("u").distinct(), F.col("v") == F.col("u"), "left_anti").select(F.col("v").alias("node"), F.col("v").alias("root")))
