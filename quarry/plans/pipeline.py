"""Builds and questions: the operators composed as the command line and a service need them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.storagelevel import StorageLevel

from quarry.functions import text as T
from quarry.operators import incremental, retrieval
from quarry.plans.chunker import Chunker, SplitSettings
from quarry.sources import files as S
from quarry.sources import layout
from quarry.sources.excel import workbook_chunks
from quarry.sources.markdown import read_markdown
from quarry.sources.store import Store
from quarry.sources.word import read_word

TEXT_FORMATS = {".txt": S.read_text, ".md": read_markdown, ".docx": read_word}


@dataclass
class Outcome:
    processed: list[str] = field(default_factory=list)
    removed: list[str] = field(default_factory=list)
    failed: dict[str, str] = field(default_factory=dict)


LAYOUT = ".json"
#: The sections of a prompt.
TEMPLATE = "{memory}{history}【文档片段】\n{context}\n\n【问题】\n{question}\n\n【回答】"


def chunk(blocks: DataFrame, min_chars: int = 20) -> DataFrame:
    """Blocks as chunks, without cuts by meaning."""
    return Chunker(settings=SplitSettings(min_chars=min_chars)).split(blocks)


def build(
    spark: SparkSession, folder: str, store: Store, incremental_: bool = False, only: list[str] | None = None, max_files: int | None = None, registry: S.Registry | None = None, chunker: Chunker | None = None,
    describe: Callable[[list[bytes], list[str]], list[str]] | None = None, most_failures: int = 3, cache: bool = True,
) -> Outcome:
    """Full or incremental: parses what changed, and publishes chunks and manifest together. A full build stops at any failure, an incremental one keeps the failed files' old rows.

    Parsers and chunk settings make the fingerprint: with another one an incremental build is a full one. Files whose digest was parsed under the same fingerprint before come from the store's cache. Layout files (.json) that
    fail `most_failures` times in a row, by path, stop the build.
    """
    registry, chunker = registry or S.Registry(TEXT_FORMATS), chunker or Chunker()
    fingerprint = f"{registry.fingerprint};.xlsx=workbook_chunks;{LAYOUT}=layout+{'figures' if describe else 'text'}|{chunker.fingerprint}"
    if only is not None and (not incremental_ or not only):
        raise ValueError("only needs an incremental build and at least one name")
    listing = S.scan(spark, folder, [*registry.suffixes, ".xlsx", LAYOUT])
    names = S.digests(spark, folder, [*registry.suffixes, ".xlsx", LAYOUT])
    manifest = None
    if incremental_:
        store.assert_ready()
        manifest = store.manifest()
        if manifest is None or store.current().get("fingerprint") != fingerprint:
            if only is not None:
                raise ValueError("only needs an index of this parser and these chunk settings")
            incremental_, manifest = False, None
    if only is not None:
        wanted = spark.createDataFrame([(n,) for n in dict.fromkeys(only)], "source string")
        if lost := sorted(r.source for r in incremental.missing(wanted, names).collect()):
            raise ValueError(f"files not found: {lost}")
        target = names.join(F.broadcast(wanted), "source", "left_semi")
    else:
        target = names.orderBy("path").limit(max_files) if max_files else names
        if manifest is not None:
            target = incremental.changed(target, manifest)
    held_back: list[DataFrame] = []

    def kept(df: DataFrame) -> DataFrame:
        held_back.append(df.persist(StorageLevel.DISK_ONLY))
        return held_back[-1]

    target = kept(target)
    gone = incremental.removed(manifest, names) if manifest is not None and only is None else spark.createDataFrame([], "source string")
    held, misses = store.cached(target, fingerprint) if cache and only is None else (None, target)
    # Contents are read of the files to parse only.
    todo = listing.join(misses.select("source"), "source", "left_semi")
    suffix = F.lower(F.regexp_extract("source", r"(\.[^.]+)$", 1))
    parsed = registry.parse(todo.where(~suffix.isin(".xlsx", LAYOUT)))
    for part in (workbook_chunks(todo.where(suffix == ".xlsx")), layout.file_blocks(todo.where(suffix == LAYOUT), describe)):
        parsed = parsed.unionByName(part, allowMissingColumns=True)
    try:
        parsed = kept(parsed)
        errors = kept(parsed.where("error is not null").groupBy("source").agg(F.min("error").alias("error")))
        in_order = misses.where(F.lower("source").endswith(LAYOUT)).join(errors.select("source", F.lit(True).alias("failed")), "source", "left")
        in_order = in_order.select(F.row_number().over(Window.orderBy("path")).alias("pos"), "source", F.coalesce("failed", F.lit(False)).alias("failed"))
        if not incremental.breaker(in_order, most_failures).where("stop").isEmpty():
            raise RuntimeError(f"{most_failures} layout files in a row failed; the build stopped before any change")
        fresh = chunker.split(parsed.where("error is null").join(errors.select("source"), "source", "left_anti")).drop("error")
        good = kept(fresh if held is None else held.unionByName(fresh, allowMissingColumns=True))
        ok = kept(good.select("source").distinct())
        if cache:
            # What was parsed is kept whatever becomes of this build.
            store.put_cache(good.join(misses.select("source"), "source", "left_semi"), misses, fingerprint)
        failed = {r.source: r.error or "no usable chunks" for r in target.join(ok, "source", "left_anti").join(errors, "source", "left").select("source", "error").collect()}
        done, removed = sorted(r.source for r in ok.collect()), sorted(r.source for r in gone.collect())
        if manifest is None and (failed or not done):
            raise RuntimeError(f"full build stopped before any change: {failed or 'no documents'}")
        if not done and not removed:
            return Outcome(failed=failed)
        hashes = target.select("source", "digest")
        if manifest is None:
            chunks, new_manifest = good, hashes
        else:
            store.check_schema(good)
            sources = incremental.replaced(ok, gone)
            chunks = incremental.merge_chunks(store.chunks(), good, sources)
            new_manifest = incremental.merge_manifest(manifest, hashes, sources, ok)
        store.begin_write()
        store.publish(chunks, new_manifest, fingerprint)
        return Outcome(done, removed, failed)
    finally:
        for df in reversed(held_back):
            df.unpersist()


def prompts(hits: DataFrame, queries: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """(qid, prompt) of ranked hits with their chunk columns: numbered, labelled contexts in the template's places."""
    head = F.concat(F.lit("[片段 "), F.col("rank"), F.lit(" | "), T.type_label(F.col("type")), F.lit(" | 来源: "), T.source_label(), F.lit("]\n"), "content")
    context = hits.select("qid", F.struct("rank", head.alias("b")).alias("x")).groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["b"]), "\n\n").alias("context"))
    rows = queries.join(context, "qid")
    given = {"memory": "memory", "history": "history", "context": "context", "question": "query"}
    parts: list[Column] = []
    rest = template
    while rest:
        at, name = min(((rest.find("{" + n + "}"), n) for n in given if "{" + n + "}" in rest), default=(-1, ""))
        if at < 0:
            parts.append(F.lit(rest))
            break
        parts.append(F.lit(rest[:at]))
        column = given[name]
        parts.append(F.coalesce(F.col(column), F.lit("")) if column in rows.columns else F.lit(""))
        rest = rest[at + len(name) + 2 :]
    return rows.select("qid", F.concat(*parts).alias("prompt"))


def retrieve(chunks: DataFrame, queries: DataFrame, embed: Callable[[Column], Column] | None = None, k: int = 20, hybrid: bool = True, rescore: Callable[[Column, Column], Column] | None = None, context_k: int = 5) -> DataFrame:
    """Ranked chunk ids of each query: BM25, vectors (where an embedder is given; chunks then have `embedding`) or both, then optionally rescored."""
    if k < 1:
        raise ValueError("k must be positive")
    sparse = retrieval.bm25(chunks, queries, k=k, id_col="id", text_col="content").withColumnRenamed("id", "key")
    if embed is None:
        hits = sparse.select("qid", "key", "rank", F.col("score").alias("bm25_score"))
    else:
        dense = retrieval.dense(chunks, queries.select("qid", embed(F.col("query")).alias("v")), k=k, id_col="id").withColumnRenamed("id", "key")
        hits = retrieval.rrf(dense, sparse, k) if hybrid else dense.select("qid", "key", "rank", F.col("score").alias("dense_score"))
    if rescore is None:
        return hits
    full = hits.join(chunks.select(F.col("id").alias("key"), "content"), "key").join(queries, "qid")
    return retrieval.rerank(full, rescore(F.col("query"), F.col("content")), context_k).drop("content", "query")
