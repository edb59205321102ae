"""Directory scans, digests and the plain readers; every parser turns (source, path, content, digest) rows into blocks.

Blocks share one schema (BLOCKS): what a format lacks is null. A file that cannot be read gives one row with `error` set and no content,
so that a build can keep what it had for it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCKS = (
    "source string, ord int, content string, type string, block_kind string, heading_path string, page int, bbox array<double>, line_start int, line_end int, block_index int, paragraph_start int, paragraph_end int, "
    "table_index int, sheet_name string, sheet_state string, row_start int, row_end int, column_start string, column_end string, header_row_start int, header_row_end int, caption string, error string"
)
COLUMNS = [c.strip().split()[0] for c in BLOCKS.split(", ")]


def scan(spark: SparkSession, folder: str, suffixes: list[str], max_files: int | None = None) -> DataFrame:
    """Files of the folder's first level: (source, path, content, digest), by path; lock files and other suffixes are left out."""
    if max_files is not None and (isinstance(max_files, bool) or max_files < 1):
        raise ValueError("max_files must be positive")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    rows = files.where(suffix.isin([s.lower() for s in suffixes]) & ~(suffix.isin(".docx", ".xlsx") & F.startswith(name, F.lit("~$"))))
    rows = rows.select(F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))).alias("source"), "path", "content", F.sha2("content", 256).alias("digest"))
    return rows.orderBy("path").limit(max_files) if max_files else rows


def digests(spark: SparkSession, folder: str, suffixes: list[str]) -> DataFrame:
    """(source, digest, path) of the files that scan finds: contents are digested where they are read, and go no further."""
    return scan(spark, folder, suffixes).select("source", "digest", "path")


def block(source: str, ord_: int, **fields) -> dict:
    return dict.fromkeys(COLUMNS) | {"source": source, "ord": ord_} | fields


def parser(read: Callable[[str, bytes], list[dict]]) -> Callable[[DataFrame], DataFrame]:
    """A reader of one file's bytes as an operator over file rows; its exceptions become the file's error row."""

    def run(batches: Iterator):
        import pyarrow as pa

        kinds = {"int": pa.int32(), "string": pa.string(), "array<double>": pa.list_(pa.float64())}
        schema = pa.schema([(n, kinds[k]) for n, k in (c.strip().split() for c in BLOCKS.split(", "))])
        for batch in batches:
            out = []
            for source, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    found = read(source, bytes(content or b""))
                    if not found:
                        raise ValueError("no usable content")
                    out += found
                except Exception as e:  # noqa: BLE001 - whatever is wrong with a file is told in its row
                    out.append(block(source, 0, error=f"{type(e).__name__}: {e}"))
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return lambda files: files.select("source", "content").mapInArrow(run, BLOCKS)


def utf8(content: bytes) -> str:
    """Strict UTF-8 without its mark; blank texts and NUL are errors."""
    text = content.decode("utf-8-sig")
    if not text.strip():
        raise ValueError("the file is blank")
    if "\0" in text:
        raise ValueError("the file holds NUL")
    return text


def read_text(source: str, content: bytes) -> list[dict]:
    return [block(source, 0, content=utf8(content), type="text")]


class Registry:
    """Parsers by suffix."""

    def __init__(self, parsers: dict[str, Callable[[str, bytes], list[dict]]]):
        if not parsers:
            raise ValueError("no parsers")
        low = [s.lower() for s in parsers]
        if any(not s.startswith(".") or len(s) < 2 for s in low) or len(set(low)) < len(low):
            raise ValueError("suffixes must start with a dot and differ in more than case")
        self.parsers = dict(zip(low, parsers.values(), strict=True))

    @property
    def suffixes(self) -> list[str]:
        return sorted(self.parsers)

    @property
    def fingerprint(self) -> str:
        return ";".join(f"{s}={getattr(f, 'fingerprint', f.__name__)}" for s, f in sorted(self.parsers.items()))

    def parse(self, files: DataFrame) -> DataFrame:
        """Each format's files through its parser; a file without one is an error row."""
        suffix = F.lower(F.regexp_extract("source", r"(\.[^.]+)$", 1))
        parts = [parser(f)(files.where(suffix == s)) for s, f in sorted(self.parsers.items())]
        other = files.where(~suffix.isin(self.suffixes)).select("source", F.lit(0).alias("ord"), F.lit("unsupported format").alias("error"))
        out = parts[0]
        for p in [*parts[1:], other]:
            out = out.unionByName(p, allowMissingColumns=True)
        return out
