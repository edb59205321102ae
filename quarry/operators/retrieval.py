"""Lexical, dense and hybrid retrieval over chunk tables."""

from __future__ import annotations

from collections.abc import Callable
from decimal import ROUND_HALF_UP, Context, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.window import Window

from quarry.functions import text as T

#: Queries up to this many rows are sent to every task; more are dealt in blocks.
QUERY_BLOCK = 2_000


def counted(t: Column) -> Column:
    """(term, tf) of each distinct value of an array, by sorting it: nothing is exchanged, and the work is in proportion to the array."""

    def starts(s):
        return F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | ~F.get(s, i).eqNullSafe(F.get(s, i - 1)))

    def lengths(x):
        return F.transform(x["at"], lambda at, j: F.struct(F.get(x["s"], at).alias("term"), (F.coalesce(F.get(x["at"], j + 1), F.size(x["s"])) - at).cast("long").alias("tf")))

    # Arrays of one give what they hold a name, so that it isn't computed anew for each element.
    held = F.transform(F.array(F.sort_array(t)), lambda s: F.struct(s.alias("s"), F.when(F.size(s) > 0, starts(s)).otherwise(F.array().cast("array<int>")).alias("at")))
    return F.transform(held, lengths)[0]


def postings(chunks: DataFrame, tokenizer: Callable[[Column], Column] = T.tokens, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, term, dl, tf): how often each chunk holds each term, and the chunk's length in tokens. Chunks that share their id and text count as one, with that length.

    Tokens are counted inside the chunk's row; only chunks that share an id are exchanged.
    """
    alone, again = by_repetition(chunks, id_col, text_col)
    out = None
    if alone is not None:
        out = cut(alone, tokenizer).select("id", F.size("t").cast("long").alias("dl"), F.explode(counted(F.col("t"))).alias("x")).select("id", "x.term", "dl", "x.tf")
    if again is not None:
        toks = again.select("id", F.sha2("text", 256).alias("same"), tokenizer(F.coalesce("text", F.lit(""))).alias("t"))
        more = toks.select("id", "same", F.size("t").cast("long").alias("dl"), F.explode("t").alias("term")).groupBy("id", "term", "dl", "same").agg(F.count("*").alias("tf")).drop("same")
        out = more if out is None else out.union(more)
    return out


def document_frequencies(chunks: DataFrame, tokenizer: Callable[[Column], Column] = T.tokens, id_col: str = "doc_id", text_col: str = "text", unnamed: bool = True) -> DataFrame:
    """Rows (term, df): in how many chunks each term is. Chunks that share an id count once; those without one count as one, or not if unnamed is false.

    A task adds up its chunks before the exchange, which so has a row for each term and task.
    """
    n = F.count("*" if unnamed else "id").alias("df")
    alone, again = by_repetition(chunks, id_col, text_col)
    out = []
    if alone is not None:
        out.append(cut(alone, tokenizer).select("id", F.explode(F.array_distinct("t")).alias("term")).groupBy("term").agg(n))
    if again is not None:
        out.append(cut(again, tokenizer).select("id", F.explode(F.array_distinct("t")).alias("term")).distinct().groupBy("term").agg(n))
    return out[0] if len(out) == 1 else out[0].union(out[1]).groupBy("term").agg(F.sum("df").alias("df"))


def corpus_stats(chunks: DataFrame, tokenizer: Callable[[Column], Column] = T.tokens, text_col: str = "text") -> DataFrame:
    """One row (n, avgdl): number of chunks and their mean length in tokens."""
    return chunks.agg(F.count("*").alias("n"), (F.coalesce(F.sum(F.size(tokenizer(F.coalesce(F.col(text_col), F.lit(""))))), F.lit(0)) / F.greatest(F.count("*"), F.lit(1))).alias("avgdl"))


#: Query terms, rows of them, and terms times queries up to so many are told to every task; with more, postings meet them by an exchange.
MOST_TERMS, MOST_TOLD, MOST_CELLS = 10_000, 200_000, 4_000_000


def query_terms(queries: DataFrame, tokenizer: Callable[[Column], Column] = T.tokens, qid_col: str = "qid", query_col: str = "query") -> DataFrame:
    """Rows (qid, term, qtf): a term that a query repeats counts as often."""
    return queries.select(F.col(qid_col).alias("qid"), F.explode(tokenizer(F.coalesce(F.col(query_col), F.lit("")))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))


def by_name(chunks: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return chunks.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))


#: Ids of several chunks up to this many are told to every task.
MOST_REPEATED = 100_000


def by_repetition(chunks: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame | None, DataFrame | None]:
    """Rows (id, text) of the chunks that have their id alone, and of the others; None for what there is not. Where very many ids repeat, all chunks are among the others."""
    rows = by_name(chunks, id_col, text_col)
    again = rows.groupBy(F.col("id").alias("other")).agg(F.count("*").alias("n")).where("n > 1").select("other")
    n = again.limit(MOST_REPEATED + 1).count()
    if n > MOST_REPEATED:
        return None, rows
    same = F.col("id").eqNullSafe(F.col("other"))
    return (rows.join(F.broadcast(again), same, "left_anti"), rows.join(F.broadcast(again), same, "left_semi")) if n else (rows, None)


def cut(rows: DataFrame, tokenizer: Callable[[Column], Column]) -> DataFrame:
    return rows.select("id", tokenizer(F.coalesce("text", F.lit(""))).alias("t"))


def merged(rows: DataFrame, tokenizer: Callable[[Column], Column]) -> DataFrame:
    """Postings (id, term, tf, dl) of chunks that share ids, which count as one chunk with the length of the longest."""
    return cut(rows, tokenizer).select("id", F.size("t").cast("long").alias("dl"), F.explode("t").alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"), F.max("dl").alias("dl"))


def scored(post: DataFrame, stats: DataFrame, q: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """Rows (qid, id, score) of postings, statistics by term (the null term's: of all chunks) and query terms."""
    if k1 <= 0 or not 0 <= b <= 1:
        raise ValueError("k1 must be positive and b between 0 and 1")
    whole = stats.where("term is null").agg(F.coalesce(F.max("df"), F.lit(0)).alias("n"), (F.coalesce(F.max("total"), F.lit(0)) / F.greatest(F.coalesce(F.max("df"), F.lit(0)), F.lit(1))).alias("avgdl"))  # one row
    idf = stats.where("term is not null").crossJoin(F.broadcast(whole)).select("term", "avgdl", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))
    weight = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    rows = post.join(q.join(idf, "term"), "term").groupBy("qid", "id").agg(F.round(F.sum(weight * F.col("qtf")), 6).alias("score"))
    return rows.where("score > 0")


def bm25(chunks: DataFrame, queries: DataFrame, k: int = 20, k1: float = 1.5, b: float = 0.75, tokenizer: Callable[[Column], Column] = T.tokens, id_col: str = "doc_id", text_col: str = "text", qid_col: str = "qid", query_col: str = "query") -> DataFrame:
    """Rows (qid, id, score, rank): the k best chunks of each query; a term that a query repeats counts as often; ties go to the lower id.

    Chunks are scored for all queries inside their rows, and each task keeps k chunks a query. With more terms than can be told, postings meet the queries by term, and contributions are summed for
    each query and chunk before anything is ranked. Chunks that share an id count as one with all their tokens.
    """
    if k < 1:
        raise ValueError("k must be positive")
    if k1 <= 0 or not 0 <= b <= 1:
        raise ValueError("k1 must be positive and b between 0 and 1")
    q = query_terms(queries, tokenizer, qid_col, query_col)
    told = q.limit(MOST_TOLD + 1).collect()
    terms, qids = sorted({r.term for r in told if r.term is not None}), list(dict.fromkeys(r.qid for r in told))
    alone, again = by_repetition(chunks, id_col, text_col)
    if alone is not None and len(told) <= MOST_TOLD and len(terms) <= MOST_TERMS and len(terms) * len(qids) <= MOST_CELLS:
        return top(_scored_in_rows(alone, again, q, told, terms, qids, k, k1, b, tokenizer), k)
    post = postings(chunks, tokenizer, id_col, text_col).select("id", "term", "tf", "dl") if again is None else merged(by_name(chunks, id_col, text_col), tokenizer)
    post = post.join(q.select("term").distinct(), "term", "left_semi")
    whole = corpus_stats(chunks, tokenizer, text_col).select(F.lit(None).cast("string").alias("term"), F.col("n").alias("df"), (F.col("n") * F.col("avgdl")).alias("total"))
    stats = post.groupBy("term").agg(F.count("*").alias("df"), F.lit(None).cast("double").alias("total")).union(whole)
    return top(scored(post, stats, q, k1, b), k)


#: Chunks whose tokens are looked up at a time, and scores held at a time.
LOOKED_UP, SCORES = 1_000, 200_000


def _held(batches, terms: list[str]):
    """(ids, lengths, chunk, term, tf) of batches (id, t): numbers of chunks and terms, by chunk, and how often it holds the term."""
    wanted = pa.array(terms, pa.string())
    for batch in batches:
        for at in range(0, batch.num_rows, LOOKED_UP):
            ids, toks = batch.slice(at, LOOKED_UP).columns
            size = pc.fill_null(pc.list_value_length(toks), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            place = pc.fill_null(pc.index_in(toks.flatten().cast(pa.string()), value_set=wanted), -1).to_numpy(zero_copy_only=False)
            key = (np.repeat(np.arange(len(size)), size) * max(1, len(terms)) + place)[place >= 0]
            key, tf = np.unique(key, return_counts=True)
            yield ids, size, *np.divmod(key, max(1, len(terms))), tf


def _scored_in_rows(alone: DataFrame, again: DataFrame | None, q: DataFrame, told: list, terms: list[str], qids: list, k: int, k1: float, b: float, tokenizer: Callable[[Column], Column]) -> DataFrame:
    """Rows (qid, id, score), the k best of each query and task at least: a chunk is scored for all queries where it is read, once the terms' frequencies are known.

    Chunks that share ids (again) are scored by an exchange, as one.
    """

    def count(batches):
        df, n, total = np.zeros(len(terms), np.int64), 0, 0
        for _, size, _, term, _ in _held(batches, terms):
            df += np.bincount(term, minlength=len(terms))
            n, total = n + len(size), total + int(size.sum())
        yield pa.RecordBatch.from_pydict({"at": pa.array(range(-2, len(terms)), pa.int32()), "n": pa.array([n, total, *df.tolist()], pa.int64())})

    counts = {r["at"]: r.n for r in cut(alone, tokenizer).mapInArrow(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()}
    n, total, df = counts.get(-2, 0), counts.get(-1, 0), np.array([counts.get(i, 0) for i in range(len(terms))], np.float64)
    if again is not None:
        post = merged(again, tokenizer).join(F.broadcast(q.select("term").distinct()), "term", "left_semi")
        number = {t: i for i, t in enumerate(terms)}
        for r in post.groupBy("term").agg(F.count("*").alias("n")).collect():
            df[number[r.term]] += r.n
        more = cut(again, tokenizer).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("t").cast("long")), F.lit(0)).alias("total")).first()
        n, total = n + more.n, total + more.total
    mean = total / max(n, 1)
    number, place = {t: i for i, t in enumerate(terms)}, {x: i for i, x in enumerate(qids)}
    weights = [(number[r.term], place[r.qid], r.qtf) for r in told if r.term is not None]

    def find(batches):
        best, table = Best(len(qids), k), np.zeros((len(terms), len(qids)))
        if weights:
            i, j, qtf = (np.array(x) for x in zip(*weights, strict=True))
            table[i, j] = np.log((n - df[i] + 0.5) / (df[i] + 0.5) + 1) * (k1 + 1) * qtf
        step = max(1, SCORES // max(1, len(qids)))
        for ids, size, chunk, term, tf in _held(batches, terms):
            weight = tf / (tf + k1 * (1 - b + b * size[chunk] / (mean or 1)))
            rows, starts = np.unique(chunk, return_index=True)
            ends = np.append(starts[1:], len(chunk))
            for at in range(0, len(rows), step):
                s = np.stack([weight[x:y] @ table[term[x:y]] for x, y in zip(starts[at : at + step], ends[at : at + step], strict=True)])
                r, c = np.nonzero((s > 0) & (s >= best.floor))
                best.add(c, ids.take(pa.array(rows[at + r])), s[r, c])
        at, ids, scores = best.rows()
        if ids is not None:
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), ids, scores], ["at", "id", "score"])

    kinds = S.StructType([S.StructField("at", S.IntegerType()), S.StructField("id", alone.schema["id"].dataType), S.StructField("score", S.DoubleType())])
    names = alone.sparkSession.createDataFrame(list(enumerate(qids)), S.StructType([S.StructField("at", S.IntegerType()), S.StructField("qid", q.schema["qid"].dataType)]))
    found = cut(alone, tokenizer).mapInArrow(find, kinds).join(F.broadcast(names), "at").select("qid", "id", F.round("score", 6).alias("score")).where("score > 0")
    if again is None:
        return found
    stats = alone.sparkSession.createDataFrame([(t, int(x), None) for t, x in zip(terms, df, strict=True) if x] + [(None, n, float(total))], "term string, df long, total double")
    return found.unionByName(scored(post, F.broadcast(stats), q, k1, b).select("qid", "id", "score"))


def top(scored: DataFrame, k: int) -> DataFrame:
    """The k best rows (qid, id, score) of each query with their rank; ties go to the lower id."""
    w = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def rounded(x: np.ndarray, digits: int = 6) -> np.ndarray:
    """As Spark's round: half up of the shortest decimal form."""
    unit = 10.0**digits
    with np.errstate(all="ignore"):
        out = np.rint(x * unit) / unit
        near = np.isfinite(x) & ((np.abs(x * unit - np.floor(x * unit) - 0.5) < 1e-3) | (np.abs(x) > 1e8))
    for i in np.flatnonzero(near):
        at = Decimal(repr(float(x[i])))
        out[i] = float(at.quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP, Context(prec=400)))
    return out


def _by_id(ids: pa.Array) -> np.ndarray:
    """The place of each id, nulls last; equal ids share one."""
    return pc.rank(ids, sort_keys="ascending", null_placement="at_end", tiebreaker="dense").to_numpy()


#: What rounding to six digits can move two scores towards each other, and a little more.
SLACK = 1.1e-6


class Best:
    """The k best ids of each query among the pairs given so far, by the rounded score, then by id; null scores come last. Holds a bounded number of pairs, however many are given or tie."""

    def __init__(self, queries: int, k: int):
        self.k, self.room, self.held, self.n = k, 2 * k * queries + 200_000, [], 0
        #: Scores below a query's floor are not among its best.
        self.floor = np.full(queries, -np.inf)

    def add(self, q: np.ndarray, ids: pa.Array, scores: np.ndarray, null: bool = False) -> None:
        self.held.append((q, ids, scores, np.full(len(q), null)))
        self.n += len(q)
        if self.n > self.room:
            self.cut()

    def cut(self) -> None:
        q, scores, null = (np.concatenate([x[i] for x in self.held]) for i in (0, 2, 3))
        ids = pa.concat_arrays([x[1] for x in self.held])
        nan, r = np.isnan(scores), rounded(scores)
        by_id = _by_id(ids)
        order = np.lexsort((by_id, np.where(nan, 0.0, -r), ~nan, null, q))
        q = q[order]
        place = np.arange(len(q)) - np.searchsorted(q, q, "left")
        kept, last = order[place < self.k], order[place == self.k - 1]
        last = last[~null[last] & ~nan[last]]
        at = np.concatenate([x[0] for x in self.held])
        self.floor[at[last]] = r[last] - SLACK
        self.held, self.n = [(at[kept], ids.take(pa.array(kept)), scores[kept], null[kept])], len(kept)

    def rows(self) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """Queries, ids and scores as they were given."""
        if not self.held:
            return np.zeros(0, np.int64), None, None
        self.cut()
        q, ids, scores, null = self.held[0]
        return q, ids, pa.array(scores, mask=null, from_pandas=False)


def _vectors(column: pa.ListArray) -> tuple[np.ndarray, list]:
    """The length of each list, -1 for null ones and those with a null; and (numbers of the rows, matrix) of each length."""
    values, size = column.flatten(), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(size)
    kind = np.where(column.is_null().to_numpy(zero_copy_only=False), -1, size)
    if values.null_count:
        gone = np.concatenate([[0], np.cumsum(values.is_null().to_numpy(zero_copy_only=False))])
        kind = np.where(gone[ends] > gone[ends - size], -1, kind)
    numbers = values.to_numpy(zero_copy_only=False)
    groups = []
    for n in np.unique(kind[kind >= 0]):
        rows = np.flatnonzero(kind == n)
        groups.append((int(n), rows, numbers[(ends - size)[rows][:, None] + np.arange(n)[None, :]].astype(np.float64)))
    return kind, groups


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, added in dot's order."""
    out = np.zeros(len(a))
    with np.errstate(all="ignore"):
        for j in range(a.shape[1]):
            out = out + a[:, j] * b[:, j]
    return out


def _few_alike(rows: np.ndarray, x: np.ndarray, ids: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of equal vectors the k rows of the least ids; more are not among the best of any query."""
    if len(x) <= k or not x.shape[1]:
        return rows, x
    alike = np.unique(np.ascontiguousarray(x).view(f"V{x.shape[1] * 8}").ravel(), return_inverse=True)[1].ravel()
    order = np.lexsort((_by_id(ids.take(pa.array(rows))), alike))
    alike = alike[order]
    kept = np.sort(order[np.arange(len(order)) - np.searchsorted(alike, alike, "left") < k])
    return rows[kept], x[kept]


#: Rows that are multiplied with a block of queries at a time, and pairs that are multiplied without screening.
TILE, PAIRS = 512, 200_000


def nearest(ids: pa.Array, e: pa.ListArray, v: pa.ListArray, k: int) -> Best:
    """The k best of the rows (ids, e) for each of the vectors v. Products in single precision, with their error's bound, say which pairs to multiply as dot does."""
    best = Best(len(v), k)
    kind, groups = _vectors(e)
    kinds, asked = _vectors(v)
    for n, qs, q in asked:
        rows, x = next(((r, m) for l, r, m in groups if l == n), (np.zeros(0, np.int64), np.zeros((0, n))))
        rows, x = _few_alike(rows, x, ids, k)
        usual_q, usual = ((np.abs(m) < 1e15).all(axis=1) for m in (q, x))  # not for those with NaN
        a, b = x[usual].astype(np.float32), np.ascontiguousarray(q[usual_q].astype(np.float32).T)
        mine, own = qs[usual_q], rows[usual]
        norms = [np.sqrt((m * m).sum(axis=1)) for m in (x[usual], q[usual_q])]
        slack = 2 * (n + 8) * 2.0**-24 * norms[0].max(initial=0.0) * norms[1] + SLACK
        x64, q64 = x[usual], q[usual_q]
        for at in range(0, len(a) if len(mine) else 0, TILE):
            s = a[at : at + TILE] @ b
            if not at and len(s) >= k:
                best.floor[mine] = np.partition(s, len(s) - k, axis=0)[len(s) - k].astype(np.float64) - slack
            r, c = np.nonzero(s >= (best.floor[mine] - slack).astype(np.float32))
            for i in range(0, len(r), PAIRS):
                ri, ci = r[i : i + PAIRS] + at, c[i : i + PAIRS]
                best.add(mine[ci], ids.take(pa.array(own[ri])), _products(x64[ri], q64[ci]))
        for some_q, some_x in ((~usual_q, np.ones(len(x), bool)), (usual_q, ~usual)):
            left = np.flatnonzero(some_x)
            step = max(1, PAIRS // max(1, int(some_q.sum())))
            for at in range(0, len(left) if some_q.any() else 0, step):
                ri, ci = (m.ravel() for m in np.meshgrid(left[at : at + step], np.flatnonzero(some_q), indexing="ij"))
                best.add(qs[ci], ids.take(pa.array(rows[ri])), _products(x[ri], q[ci]))
    # Vectors of another length, or with a null: a null score, of which the first k by id can matter.
    by_id = None
    for n in np.unique(kinds):
        other = np.ones(len(kind), bool) if n < 0 else kind != n
        if other.any():
            by_id = np.argsort(_by_id(ids), kind="stable") if by_id is None else by_id
            first = by_id[other[by_id]][:k]
            for i in np.flatnonzero(kinds == n):
                best.add(np.full(len(first), i), ids.take(pa.array(first)), np.zeros(len(first)), True)
    return best


#: Rows are dealt to parts of at least and at most so many, of which MANY are enough.
LEAST_ROWS, MOST_ROWS, MANY = 2_048, 32_768, 64


def dense(chunks: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (qid, id, score, rank): exact top k by inner product of unit vectors, queries (qid, v) against all rows.

    Both sides are counted and dealt, rows to parts and queries to blocks of about QUERY_BLOCK; each part meets each block in one task, which keeps k rows a query. All pairs are multiplied, so the
    work grows with rows times queries; what a task holds doesn't grow, and nothing goes to the driver.
    """
    if isinstance(k, bool) or not isinstance(k, int) or k < 1:
        raise ValueError("k must be a positive integer")
    n, m = chunks.count(), queries.count()
    parts, blocks = max(-(-n // MOST_ROWS), min(MANY, -(-n // LEAST_ROWS)), 1), max(1, -(-m // QUERY_BLOCK))
    tasks = min(parts * blocks, 2_000)
    number = lambda c, df: F.col(c) if df.schema[c].dataType == S.ArrayType(S.FloatType(), df.schema[c].dataType.containsNull) else F.col(c).cast("array<double>")
    deal = lambda c, by, n: F.pmod(F.xxhash64(c, F.lit(by)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = chunks.select(deal(id_col, "part", parts).alias("part"), every(blocks).alias("block"), F.col(id_col).alias("id"), number(vector_col, chunks).alias("e"))
    asked = queries.select(every(parts).alias("part"), deal("qid", "block", blocks).alias("block"), "qid", number("v", queries).alias("v"))
    kinds = S.StructType([S.StructField("qid", queries.schema["qid"].dataType), S.StructField("id", chunks.schema[id_col].dataType), S.StructField("score", S.DoubleType())])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        whole = lambda t, c: t[c].combine_chunks() if t.num_rows else pa.array([], t[c].type)
        q, ids, scores = nearest(whole(left, "id"), whole(left, "e"), whole(right, "v"), k).rows() if left.num_rows and right.num_rows else (None, None, None)
        if ids is None:
            return pa.table({"qid": pa.array([], right["qid"].type), "id": pa.array([], left["id"].type), "score": pa.array([], pa.float64())})
        return pa.table({"qid": whole(right, "qid").take(pa.array(q)), "id": ids, "score": scores})

    dealt = [df.repartition(tasks, "part", "block").groupBy("part", "block") for df in (rows, asked)]
    return top(dealt[0].cogroup(dealt[1]).applyInArrow(meet, kinds).withColumn("score", F.round("score", 6)), k)


def first_of_each(hits: DataFrame, key: str = "key", pos: str = "pos", by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """Drops later hits of a key and ranks what is left from 1."""
    seen = Window.partitionBy(*by, key).orderBy(pos)
    again = Window.partitionBy(*by).orderBy(pos)
    return hits.withColumn("_k", F.row_number().over(seen)).where("_k = 1").drop("_k").withColumn("rank", F.row_number().over(again))


def rrf(dense_hits: DataFrame, sparse_hits: DataFrame, k: int = 20, rrf_k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of (qid, key, rank, score) rows of both branches: the full outer join on the key.

    Ties: dense order first, then sparse order. Rows (qid, key, dense_score, bm25_score, rrf_score, rank).
    """
    if k < 1:
        raise ValueError("k must be positive")
    d = dense_hits.select("qid", "key", F.col("rank").alias("dr"), F.col("score").alias("dense_score"))
    s = sparse_hits.select("qid", "key", F.col("rank").alias("sr"), F.col("score").alias("bm25_score"))
    both = d.join(s, ["qid", "key"], "full_outer")
    share = lambda r: F.coalesce(1.0 / (F.lit(rrf_k) + F.col(r)), F.lit(0.0))
    both = both.withColumn("rrf_score", F.round(share("dr") + share("sr"), 9))
    w = Window.partitionBy("qid").orderBy(F.desc("rrf_score"), F.asc_nulls_last("dr"), F.asc_nulls_last("sr"))
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("qid", "key", "dense_score", "bm25_score", "rrf_score", "rank")


def rerank(hits: DataFrame, score: Column, k: int = 5) -> DataFrame:
    """The k best of each query by a new score; ties keep their order. A score that is null or not finite is an error."""
    checked = F.when(score.isNull() | F.isnan(score) | (F.abs(score) == float("inf")), F.raise_error(F.lit("rerank scores must be finite"))).otherwise(score)
    w = Window.partitionBy("qid").orderBy(F.desc("rerank_score"), "rank")
    return hits.withColumn("rerank_score", checked.cast("double")).withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k).drop("rank").withColumnRenamed("pos", "rank")
