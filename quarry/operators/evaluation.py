"""Retrieval and answer metrics."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions import text as T

KS = (1, 3, 5, 10)
#: Phrases of a refusal, and metric names.
REFUSALS = ("无法回答", "无法确定", "不能回答", "没有提供", "未提供", "未包含", "未提及")
SCORES = ("faithfulness", "answer_relevancy", "context_precision", "context_recall")


def query_metrics(ranked: DataFrame, annotations: DataFrame) -> DataFrame:
    """One row a question: recall, precision, hit and nDCG at 1, 3, 5, 10 and MRR.

    ranked: (qid, rank, content); annotations: (qid, relevant array<string>); questions without annotations are left out.
    """
    q = annotations.where(F.size(F.coalesce("relevant", F.array().cast("array<string>"))) > 0)
    rows = q.join(ranked, "qid", "left").withColumn("rel", F.when(F.col("rank").isNotNull(), T.relevant(F.col("content"), F.col("relevant")).cast("int")))
    n_rel = F.first(F.size("relevant"))
    aggs = []
    for k in KS:
        inside = F.col("rank") <= k
        hits = F.coalesce(F.sum(F.when(inside, F.col("rel"))), F.lit(0))
        n = F.sum(F.when(inside, F.lit(1)))
        ideal = F.aggregate(F.sequence(F.lit(1), F.least(n_rel, F.lit(k))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
        dcg = F.coalesce(F.sum(F.when(inside, F.col("rel") / F.log2(F.col("rank") + 1))), F.lit(0.0))
        aggs += [
            F.least(F.lit(1.0), hits / n_rel).alias(f"recall_{k}"), F.coalesce(hits / n, F.lit(0.0)).alias(f"precision_{k}"),
            (hits > 0).cast("double").alias(f"hit_{k}"), F.round(F.least(F.lit(1.0), dcg / ideal), 9).alias(f"ndcg_{k}"),
        ]
    return rows.groupBy("qid").agg(*aggs, F.coalesce(1.0 / F.min(F.when(F.col("rel") == 1, F.col("rank"))), F.lit(0.0)).alias("mrr"))


def macro_average(per_query: DataFrame) -> DataFrame:
    cols = [c for c in per_query.columns if c != "qid"]
    return per_query.agg(*[F.round(F.avg(c), 4).alias(c) for c in cols])


def average_scores(scores: DataFrame) -> DataFrame:
    return scores.agg(F.count("*").alias("n"), *[F.round(F.avg(c), 4).alias(c) for c in SCORES])


def refusals(samples: DataFrame) -> DataFrame:
    negative = F.col("type") == "negative"
    refused = negative & F.coalesce(F.col("answer"), F.lit("")).rlike("|".join(REFUSALS))
    return samples.agg(F.count_if(negative).alias("n"), F.count_if(refused).alias("refused"), F.round(F.count_if(refused) / F.nullif(F.count_if(negative), F.lit(0)), 4).alias("rate"))


def numbers(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(\d+(?:\.\d+)?)")))


def unsupported(answer: Column, contexts: Column) -> Column:
    """Numbers of the answer that no context holds as written."""
    text = F.array_join(F.coalesce(contexts, F.array().cast("array<string>")), "")
    return F.array_sort(F.filter(numbers(answer), lambda x: ~F.contains(text, x)))


def numeric_support(samples: DataFrame) -> DataFrame:
    n, bad = F.size(numbers(F.col("answer"))), F.size(unsupported(F.col("answer"), F.col("contexts")))
    rows = samples.select(n.alias("n"), bad.alias("bad")).where("n > 0")
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("numbers"), F.coalesce(F.sum("bad"), F.lit(0)).alias("unsupported"), F.round(F.sum("bad") / F.sum("n"), 4).alias("unsupported_rate"))


def alignment(annotations: DataFrame, chunks: DataFrame, most: int = 20_000, gram: int = 12) -> DataFrame:
    """How many annotations (qid, annotation) lie word for word in some chunk. Up to `most` of them go to every task; with more, chunks and annotations meet by the annotation's least hash of `gram` characters
    before they are compared, shorter annotations excepted."""
    a = annotations.select("qid", "annotation", T.strip_layout(F.col("annotation")).alias("needle"))
    text = chunks.select(T.strip_layout(F.col("content")).alias("text"))
    needles = a.where("needle <> ''").select("needle").distinct()
    if needles.limit(most + 1).count() <= most:
        found = text.join(F.broadcast(needles), F.contains(F.col("text"), F.col("needle"))).select("needle")
    else:
        grams = lambda c: F.transform(F.sequence(F.lit(1), F.length(c) - gram + 1), lambda i: F.xxhash64(F.substring(c, i, gram)))
        long_ = needles.where(F.length("needle") >= gram).withColumn("g", F.array_min(grams(F.col("needle"))))
        places = text.where(F.length("text") >= gram).withColumn("g", F.explode(F.array_distinct(grams(F.col("text"))))).join(long_, "g").where(F.contains("text", F.col("needle"))).select("needle")
        short = text.join(needles.where(F.length("needle") < gram), F.contains(F.col("text"), F.col("needle"))).select("needle")
        found = places.union(short)
    found = found.distinct().withColumn("ok", F.lit(1))
    return a.join(found, "needle", "left").agg(F.count("*").alias("annotations"), F.count("ok").alias("aligned"), F.round(F.count("ok") / F.nullif(F.count("*"), F.lit(0)), 4).alias("rate"))


def stratified(questions: DataFrame, limit: int, seed: int = 17, types: list[str] | None = None) -> DataFrame:
    """Round-robin over types in an order fixed by the seed."""
    rows = questions.where(F.col("type").isin(types)) if types else questions
    rows = rows.withColumn("type", F.coalesce("type", F.lit("")))
    w = Window.partitionBy("type").orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), "id")
    return rows.withColumn("turn", F.row_number().over(w)).orderBy("turn", "type").limit(limit)


def longest_common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by rows of bits."""
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for ch in b:
        both = row & places.get(ch, 0)
        row = ((row + both) | (row - both)) & full
    return len(a) - row.bit_count()


def lcs_f1(reference: Column, answer: Column) -> Column:
    """ROUGE-L by characters; 0 where either is empty."""

    def f1(refs, answers):
        import pandas as pd

        out = []
        for r, a in zip(refs, answers, strict=True):
            n = longest_common(r or "", a or "")
            out.append(2 * n / (len(r) + len(a)) if n else 0.0)
        return pd.Series(out, dtype="float64")

    return F.pandas_udf(f1, "double")(reference, answer)


def lexical_report(samples: DataFrame) -> DataFrame:
    """One row of means over samples (reference, answer, contexts): ROUGE-L, character overlap with the reference, and with the contexts."""
    rows = samples.select(lcs_f1(F.col("reference"), F.col("answer")).alias("r"), char_overlap(F.col("reference"), F.col("answer")).alias("o"), char_overlap(F.array_join(F.coalesce("contexts", F.array().cast("array<string>")), ""), F.col("answer")).alias("f"))
    return rows.agg(F.count("*").alias("n"), *[F.round(F.avg(c), 4).alias(name) for c, name in (("r", "rouge_l"), ("o", "char_overlap"), ("f", "char_faithfulness"))])


def char_overlap(reference: Column, answer: Column) -> Column:
    """Share of the answer's distinct characters that the reference has."""
    r, a = T.char_set(F.coalesce(reference, F.lit(""))), T.char_set(F.coalesce(answer, F.lit("")))
    return F.when((F.size(r) == 0) | (F.size(a) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(r, a)) / F.size(a))


def fingerprint(chunks: DataFrame, order: list[str], position: list[str], content: str = "content", source: str = "source") -> DataFrame:
    """(fingerprint, chunks): a digest of all positions and contents, in the order of `order` within each source.

    Each source's rows are digested in order; the sources' digests, sorted by name, give the whole. So a task holds one source's 64-character digests, and another order of a source's chunks is another fingerprint.
    """
    row = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in position], F.sha2(F.coalesce(F.col(content), F.lit("")), 256)), 256)
    name = F.coalesce(F.col(source).cast("string"), F.lit(""))
    each = chunks.select(name.alias("s"), F.struct(*order, row.alias("d")).alias("x")).groupBy("s").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["d"]), ""), 256).alias("d"), F.count("*").alias("n"))
    whole = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s", "d"))), lambda x: F.concat(x["s"], F.lit(":"), x["d"])), "|"), 256)
    return each.agg(F.substring(whole, 1, 16).alias("fingerprint"), F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"))


#: Where the bins of a heat map begin.
EDGES = (0.5, 0.7, 0.85)


def heat_bin(score: Column) -> Column:
    """0 to 3; null stays null."""
    out = F.when(score.isNull(), F.lit(None).cast("int"))
    for i, edge in enumerate(EDGES):
        out = out.when(score < edge, F.lit(i))
    return out.otherwise(F.lit(len(EDGES)))


def scores_by_type(scores: DataFrame) -> DataFrame:
    """Means of each type, the negative questions apart: (negative, type, n, means); the row without a type is of all questions of its kind."""
    rows = scores.withColumn("negative", F.coalesce(F.col("type") == "negative", F.lit(False)))
    both = rows.withColumn("type", F.explode(F.array(F.col("type"), F.lit(None).cast("string"))))
    return both.groupBy("negative", "type").agg(F.count("*").alias("n"), *[F.round(F.avg(c), 4).alias(c) for c in SCORES])


def labelled(annotations: DataFrame, col: str = "relevant") -> DataFrame:
    return annotations.where(F.size(F.coalesce(F.col(col), F.array().cast("array<string>"))) > 0)


def selected(questions: DataFrame, types: list[str] | None = None, col: str = "question") -> DataFrame:
    """Questions that are not blank, of some types."""
    rows = questions.where(T.strip(F.coalesce(F.col(col), F.lit(""))) != "")
    return rows.where(F.col("type").isin(types)) if types else rows


def resumed(questions: DataFrame, samples: DataFrame, stored: str, current: str) -> DataFrame:
    """Earlier samples (question, pos, ...) of the questions (n, question), in the questions' order; of repeated ones the last. None if the index has another fingerprint by now (an empty one: not asked for)."""
    usable = samples.where(F.lit(not current or stored == current))
    last = usable.groupBy("question").agg(F.max_by(F.struct(*[c for c in samples.columns if c != "question"]), "pos").alias("x"))
    return questions.select("question", "n").join(last, "question").select("n", "question", "x.*").drop("pos")


def with_types(rows: DataFrame, questions: DataFrame, key: str = "qid") -> DataFrame:
    return rows.join(questions.select(key, "type").dropDuplicates([key]), key, "left").withColumn("type", F.coalesce("type", F.lit("")))


def headline(results: DataFrame, modes: list[str]) -> DataFrame:
    """(strategy, mode, value) as one row a strategy."""
    return results.groupBy("strategy").pivot("mode", modes).agg(F.first("value"))


def compared(blocks: DataFrame, strategies: dict[str, Callable[[DataFrame], DataFrame]], evaluate: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Chunk statistics and retrieval metrics of each strategy: (strategy, chunks, chars, mean, longest, shortest) and evaluate's rows with the strategy's name."""
    stats, metrics = [], []
    for name, chunk in strategies.items():
        made = chunk(blocks)
        n = F.length("content")
        stats.append(made.agg(F.lit(name).alias("strategy"), F.count("*").alias("chunks"), F.coalesce(F.sum(n), F.lit(0)).alias("chars"), F.coalesce(F.round(F.avg(n), 1), F.lit(0.0)).alias("mean"), F.coalesce(F.max(n), F.lit(0)).alias("longest"), F.coalesce(F.min(n), F.lit(0)).alias("shortest")))
        metrics.append(evaluate(made).withColumn("strategy", F.lit(name)))
    return reduce(DataFrame.unionByName, stats), reduce(DataFrame.unionByName, metrics)


def chunk_stats(chunks: DataFrame, by: str = "source", col: str = "content") -> DataFrame:
    """Number, sum, mean, longest and shortest length in characters, for each source."""
    n = F.length(col)
    return chunks.groupBy(by).agg(F.count("*").alias("n"), F.sum(n).alias("chars"), F.round(F.avg(n), 1).alias("mean"), F.max(n).cast("long").alias("longest"), F.min(n).cast("long").alias("shortest"))


def counts_by(chunks: DataFrame, *cols: str) -> DataFrame:
    """Counts by each column alone, and of all."""
    return chunks.groupingSets([[c] for c in cols] + [[]], *cols).agg(F.count("*").alias("n"))


def most_common(chunks: DataFrame, col: str = "source", order: str = "ord", limit: int | None = None) -> DataFrame:
    """(col, n), the most frequent first, then the one seen first."""
    rows = chunks.groupBy(col).agg(F.count("*").alias("n"), F.min(order).alias("_first")).orderBy(F.desc("n"), "_first")
    return (rows.limit(limit) if limit else rows).select(col, "n")


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy(F.when(F.col("failed"), "failed").otherwise("processed").alias("state")).agg(F.count("*").cast("int").alias("n"))


def yes_probability(yes: Column, no: Column) -> Column:
    """The share of yes in a softmax of two logits."""
    return 1 / (1 + F.exp(no - yes))


def context_keys(evidence: DataFrame) -> DataFrame:
    """(qid, keys): source, page, type, block and table of each piece of evidence, in order."""
    key = F.struct("source", "page", "type", "block_index", "table_index")
    return evidence.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", key.alias("k")))), lambda x: x["k"]).alias("keys"))
