"""Where chunks, manifests and caches live: versioned Parquet folders with a pointer to the current one."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions import text as T


#: The fields that tell where in its file a chunk lies.
LOCATION = (
    "heading_path", "line_start", "line_end", "block_kind", "block_index", "paragraph_start", "paragraph_end", "table_index", "sheet_name", "sheet_state", "row_start", "row_end",
    "column_start", "column_end", "header_row_start", "header_row_end",
)


class Store:
    """A chunk table and its manifest under one folder, which any file system of Spark's can hold.

    A publish writes a new version, then its pointer CURRENT-<version> under a name of its own; the highest pointer that can be read counts, so there is always one, whenever a writer stops. While a write
    is open, PENDING stands and reads are refused until a publish or discard. The version before the current one is kept for readers that are still at it, older ones go.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    @property
    def _fs(self):
        return self._path("x").getFileSystem(self._conf)

    def _put(self, name: str, text: str) -> None:
        """A new file, whole or not at all."""
        temporary = self._path(f".{name}.{uuid.uuid4().hex}")
        out = self._fs.create(temporary, True)
        out.write(bytearray(text.encode()))
        out.close()
        if not self._fs.rename(temporary, self._path(name)) and not self._fs.exists(self._path(name)):
            raise OSError(f"{self.folder}/{name} could not be written")

    def _get(self, name: str) -> str | None:
        if not self._fs.exists(self._path(name)):
            return None
        return self.spark.read.text(f"{self.folder}/{name}", wholetext=True).first()[0]

    def _names(self) -> list[str]:
        return [x.getPath().getName() for x in self._fs.listStatus(self._path(""))] if self._fs.exists(self._path("")) else []

    def current(self) -> dict:
        """Version and fingerprint; {} where nothing was published or no pointer can be read."""
        versions = sorted((int(n.removeprefix("CURRENT-")) for n in self._names() if n.startswith("CURRENT-") and n[8:].isdigit()), reverse=True)
        for v in versions:
            try:
                got = json.loads(self._get(f"CURRENT-{v}") or "{}")
            except ValueError:
                continue
            if isinstance(got, dict) and got.get("version") == v:
                return got
        return {}

    revision = property(lambda self: self.current().get("version"))

    def assert_ready(self) -> None:
        if self._fs.exists(self._path("PENDING")):
            raise RuntimeError("a write was not finished; a full build is needed")

    def begin_write(self) -> None:
        if not self._fs.exists(self._path("PENDING")):
            self._put("PENDING", "open")

    def publish(self, chunks: DataFrame, manifest: DataFrame, fingerprint: str) -> int:
        if chunks.isEmpty():
            raise ValueError("there are no chunks to publish")
        known = [int(n[1:]) for n in self._names() if n.startswith("v") and n[1:].isdigit()]
        before = self.revision
        version = max([*known, before or 0]) + 1  # a version that was never finished is not written into
        chunks.write.parquet(f"{self.folder}/v{version}/chunks")
        manifest.write.parquet(f"{self.folder}/v{version}/manifest")
        self._put(f"CURRENT-{version}", json.dumps({"version": version, "fingerprint": fingerprint}))
        self._fs.delete(self._path("PENDING"), False)
        for v in known:
            if v != before:
                self._fs.delete(self._path(f"CURRENT-{v}"), False)
                self._fs.delete(self._path(f"v{v}"), True)
        return version

    def discard(self) -> None:
        for name in self._names():
            if name.startswith("CURRENT-") or name == "PENDING":
                self._fs.delete(self._path(name), True)

    def chunks(self) -> DataFrame | None:
        self.assert_ready()
        v = self.revision
        return self.spark.read.parquet(f"{self.folder}/v{v}/chunks") if v else None

    def manifest(self) -> DataFrame | None:
        self.assert_ready()
        v = self.revision
        return self.spark.read.parquet(f"{self.folder}/v{v}/manifest") if v else None

    def check_schema(self, new: DataFrame) -> None:
        """Refuses new rows whose columns the stored table cannot hold."""
        old = self.chunks()
        if old is not None:
            held = dict(old.dtypes)
            if wrong := [c for c, t in new.dtypes if c in held and held[c] != t]:
                raise ValueError(f"columns of another type: {wrong}")

    # Vectors beside the chunks: rows (id, source, embedding) in a folder for each source's digest.

    def vectors(self) -> DataFrame | None:
        path = self._path("vectors")
        return self.spark.read.parquet(f"{self.folder}/vectors") if self._fs.exists(path) else None

    def replace_vectors(self, rows: DataFrame) -> None:
        if rows.isEmpty():
            raise ValueError("there are no vectors to write")
        rows.write.mode("overwrite").partitionBy("source").parquet(f"{self.folder}/vectors")

    def add_vectors(self, rows: DataFrame) -> None:
        if not rows.isEmpty():
            rows.write.mode("append").partitionBy("source").parquet(f"{self.folder}/vectors")

    def delete_sources(self, names: list[str]) -> None:
        """Drops the vectors of these sources: their folders, without a look at the others."""
        quote = self._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        for name in names:
            self._fs.delete(self._path(f"vectors/source={quote(name)}"), True)

    # The parse cache: chunks by file digest and fingerprint, a folder for each.

    def cached(self, files: DataFrame, fingerprint: str) -> tuple[DataFrame | None, DataFrame]:
        """(chunks of the files (source, digest) that are cached, the files that are not)."""
        path = f"cache/fingerprint={digest(fingerprint)}"
        if not self._fs.exists(self._path(path)):
            return None, files
        held = self.spark.read.parquet(f"{self.folder}/{path}")
        # A file that was put twice has equal rows under both writes; one of them counts.
        one = held.select("source", "digest", "written").groupBy("source", "digest").agg(F.max("written").alias("written"))
        hit = held.join(one, ["source", "digest", "written"]).join(files.select("source", "digest"), ["source", "digest"], "left_semi")
        return hit.drop("digest", "written"), files.join(one, ["source", "digest"], "left_anti")

    def put_cache(self, chunks: DataFrame, files: DataFrame, fingerprint: str) -> None:
        rows = chunks.join(files.select("source", "digest"), "source").withColumn("written", F.current_timestamp())
        rows.write.mode("append").parquet(f"{self.folder}/cache/fingerprint={digest(fingerprint)}")

    def clear_cache(self) -> None:
        self._fs.delete(self._path("cache"), True)

    # Reports.

    def write_report(self, name: str, report: dict) -> None:
        self._fs.delete(self._path(f"{name}.json"), False)
        self._put(f"{name}.json", json.dumps(report, ensure_ascii=False, default=str))

    def read_report(self, name: str) -> dict:
        """{} where there is none or it cannot be read."""
        try:
            got = json.loads(self._get(f"{name}.json") or "{}")
        except ValueError:
            return {}
        return got if isinstance(got, dict) else {}


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()[:24]


def export_record(columns: list[str]) -> Column:
    """A chunk's fields as they are exported: four that are always there, and those of its place that it has."""
    text = lambda c, default: F.coalesce(F.col(c), F.lit(default)).alias(c) if c in columns else F.lit(default).alias(c)
    page = F.col("page") if "page" in columns else F.lit(None).cast("int").alias("page")
    return F.struct(text("source", ""), page, text("type", "text"), text("content", ""), *[F.col(c) for c in LOCATION if c in columns])


def filter_chunks(chunks: DataFrame, type_: str | None = None, source: str | None = None, limit: int | None = None, order: str = "ord") -> DataFrame:
    """Chunks of a type whose source holds some text, the first ones by order."""
    rows = chunks.where(F.col("type") == type_) if type_ else chunks
    rows = rows.where(F.contains("source", F.lit(source))) if source else rows
    return rows.orderBy(order).limit(limit) if limit is not None else rows


def export(chunks: DataFrame, path: str, kind: str) -> None:
    """Chunks as json or jsonl (one object a line), csv (the place columns that occur) or md (by source, with numbered headings)."""
    rows = chunks.select(export_record(chunks.columns).alias("r"), *(["ord"] if "ord" in chunks.columns else []))
    if kind in ("json", "jsonl"):
        rows.select("r.*").write.mode("overwrite").option("ignoreNullFields", "true").json(path)
    elif kind == "csv":
        flat = rows.select("r.*")
        places = [c for c in flat.columns if c in LOCATION]
        found = flat.agg(*[F.count(c).alias(c) for c in places]).first() if places else {}
        out = flat.select("source", "page", "type", "content", *[c for c in places if found[c]])
        mark = out.withColumnRenamed("source", "\ufeffsource")  # spreadsheets know the encoding by it
        mark.coalesce(1).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)
    elif kind == "md":
        by = Window.partitionBy("source").orderBy("ord")
        full = chunks.select(*[c for c in chunks.columns], *[F.lit(None).cast("string").alias(c) for c in ("page", *LOCATION) if c not in chunks.columns])
        n = F.count("*").over(Window.partitionBy("source"))
        head = F.concat(F.lit("### ["), F.row_number().over(by), F.lit("] "), T.location_label(), F.lit("（"), T.type_label(F.col("type")), F.lit("）\n\n"), F.coalesce("content", F.lit("")), F.lit("\n"))
        title = F.when(F.row_number().over(by) == 1, F.concat(F.lit("## "), "source", F.lit("（"), n, F.lit(" chunks）\n\n"))).otherwise("")
        rows = full.select("source", "ord", F.concat(title, head).alias("part"))
        rows.repartitionByRange("source").sortWithinPartitions("source", "ord").select("part").write.mode("overwrite").text(path)
    else:
        raise ValueError(f"unknown export format {kind}")


def export_store(store: Store, path: str, kind: str, **which) -> None:
    """Chunks of a store, filtered; an error where nothing was built."""
    chunks = store.chunks()
    if chunks is None:
        raise ValueError(f"{store.folder} holds no chunks; build first")
    export(filter_chunks(chunks, **which), path, kind)
