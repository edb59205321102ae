"""More queries: the single steps inside the composed ones, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions import text as T
from quarry.operators import chunking as C
from quarry.operators import evaluation as E
from quarry.operators import incremental as I
from quarry.operators import memory as M
from quarry.operators import retrieval as R
from quarry.plans import catalog as K
from quarry.plans.catalog import add, read
from quarry.plans.fixtures import Fixture
from quarry.plans.pipeline import TEXT_FORMATS
from quarry.sources.files import Registry

FILES = Fixture("name string, size int", (("b.PDF", 3), ("a.pdf", 1), ("~$x.docx", 1), ("c.docx", 2), ("d.png", 9), ("noext", 1)))


@add("src1_file_filter", f"SELECT name FROM {FILES.sql} WHERE lower(regexp_extract(name, '(\\.[^.]+)$', 1)) IN ('.pdf', '.docx') AND NOT name LIKE '~$%' ORDER BY name LIMIT 2")
def _(spark, d):
    suffix = F.lower(F.regexp_extract("name", r"(\.[^.]+)$", 1))
    return FILES.df(spark).where(suffix.isin(".pdf", ".docx") & ~F.startswith("name", F.lit("~$"))).orderBy("name").limit(2).select("name")


@add("src4_parser_fingerprint", "SELECT '.docx=read_word;.md=read_markdown;.txt=read_text' AS fingerprint")
def _(spark, d):
    return spark.createDataFrame([(Registry(TEXT_FORMATS).fingerprint,)], "fingerprint string")


WORDS = Fixture("k int, t string", ((1, "短标题"), (2, "这一句是正文。"), (3, "长" * 41), (4, "  恰好四十个字以内的标题  ")))


@add("src12_heading_plausible", f"SELECT k, length(trim(t)) <= 40 AND NOT contains(t, '。') AS ok FROM {WORDS.sql}")
def _(spark, d):
    return WORDS.df(spark).select("k", ((F.length(T.strip(F.col("t"))) <= 40) & ~F.contains("t", F.lit("。"))).alias("ok"))


BOXES = Fixture("k int, bbox array<double>", ((1, [0.0, 0.0, 0.5, 0.5]), (2, [0.0, 0.0, 0.1, 0.5]), (3, [0.9, 0.5, 0.1, 0.52]), (4, None)))


@add("src22_figure_size", f"SELECT k FROM (SELECT k, coalesce(bbox, [0.0, 0.0, 1.0, 1.0]) AS b FROM {BOXES.sql}) WHERE abs(b[3] - b[1]) >= 0.15 AND abs(b[4] - b[2]) >= 0.05")
def _(spark, d):
    b = F.coalesce("bbox", F.array(*map(F.lit, (0.0, 0.0, 1.0, 1.0))))
    return BOXES.df(spark).where((F.abs(b[2] - b[0]) >= 0.15) & (F.abs(b[3] - b[1]) >= 0.05)).select("k")


IMAGES = Fixture("k int, url string", ((1, "data:image/png;base64,aGVsbG8="), (2, "no image"), (3, None)))


@add("src26_image_decode", "SELECT * FROM (VALUES (1, '68656C6C6F'), (2, NULL), (3, NULL)) t(k, bytes)")
def _(spark, d):
    has = F.contains("url", F.lit(";base64,"))
    return IMAGES.df(spark).select("k", F.when(has, F.hex(F.try_to_binary(F.element_at(F.split("url", ";base64,"), -1), F.lit("base64")))).alias("bytes"))


@add("src29_parse_cache", f"SELECT source, 'hit' AS state FROM {K.FILES.sql} WHERE source = 'a.pdf' UNION ALL SELECT source, 'miss' FROM {K.FILES.sql} WHERE source <> 'a.pdf'")
def _(spark, d):
    cache = K.MANIFEST.df(spark).withColumn("fingerprint", F.lit("p1"))
    hit, miss = I.cached(K.FILES.df(spark), cache, "p1")
    return hit.select("source", F.lit("hit").alias("state")).union(miss.select("source", F.lit("miss")))


@add("prj2_scores", "SELECT * FROM (VALUES (1, 0.5::DOUBLE, NULL::DOUBLE), (2, NULL, 2.5)) t(k, dense, bm25)")
def _(spark, d):
    rows = spark.createDataFrame([(1, 0.5, float("nan")), (2, None, 2.5)], "k int, dense_score double, bm25_score double")
    return rows.select("k", T.json_safe(F.col("dense_score")).alias("dense"), T.json_safe(F.col("bm25_score")).alias("bm25"))


@add("prj3_evidence_numbers", f"SELECT qid, key, row_number() OVER (PARTITION BY qid ORDER BY pos) AS n FROM (SELECT qid, key, min(pos) AS pos FROM {K.HITS.sql} WHERE branch = 'sparse' GROUP BY qid, key)")
def _(spark, d):
    return R.first_of_each(K.HITS.df(spark).where("branch = 'sparse'"), by=("qid",)).select("qid", "key", F.col("rank").alias("n"))


@add("prj4_timings", "SELECT * FROM (VALUES ('rewrite', NULL::DOUBLE), ('retrieval', 0.5), ('rerank', NULL), ('context', NULL), ('generation', 1.5)) t(stage, seconds)")
def _(spark, d):
    given = F.create_map(F.lit("retrieval"), F.lit(0.5), F.lit("generation"), F.lit(1.5))
    return spark.range(1).select(F.explode(T.timings(given)).alias("x")).select("x.*")


KINDS = Fixture("k int, block_kind string, content string", ((1, "code", "x"), (2, "list", "- a"), (3, None, "太短"), (4, "section", "这一段正文足够长所以应该保留下来用于检索测试")))


@add("flt2_whole_units", f"SELECT k FROM {KINDS.sql} WHERE coalesce(block_kind IN ('code', 'list'), false) OR len(regexp_extract_all(content, '{T.MEANINGFUL}')) >= 20")
def _(spark, d):
    from quarry.plans.chunker import Chunker

    return Chunker().split(KINDS.df(spark).select("k", "block_kind", "content", F.lit("text").alias("type"), F.lit("s").alias("source"), F.col("k").alias("ord"))).select("k")


@add("flt5_question_types", f"SELECT question FROM {K.SAMPLES.sql} WHERE trim(question) <> '' AND type IN ('numeric', 'negative')")
def _(spark, d):
    return E.selected(K.SAMPLES.df(spark), ["numeric", "negative"]).select("question")


@add("flt6_unlabelled", f"SELECT qid FROM {K.LABELS.sql} WHERE len(relevant) > 0")
def _(spark, d):
    return E.labelled(K.LABELS.df(spark)).select("qid")


GRID = Fixture("k int, row array<string>", ((1, ["a", " "]), (2, ["", " "]), (3, []), (4, ["", "b"])))


@add("flt7_blank_rows", f"SELECT k FROM {GRID.sql} WHERE len(list_filter(row, lambda x: trim(x) <> '')) > 0")
def _(spark, d):
    return GRID.df(spark).where(F.exists("row", lambda x: F.trim(x) != "")).select("k")


@add("arr1_pad_rows", f"SELECT k, array_to_string(row || [ '-' FOR _ IN range(2 - len(row))], ',') AS r FROM {GRID.sql}")
def _(spark, d):
    return GRID.df(spark).select("k", F.array_join(F.concat("row", F.array_repeat(F.lit("-"), F.lit(2) - F.size("row"))), ",").alias("r"))


@add("arr2_slices", "SELECT s + 1 AS row_start, least(s + 2, 5) AS row_end FROM range(0, 5, 2) t(s)")
def _(spark, d):
    return spark.range(0, 5, 2).select((F.col("id") + 1).alias("row_start"), F.least(F.col("id") + 2, F.lit(5)).alias("row_end"))


@add("jn10_relevance", "SELECT * FROM (VALUES (1, 1, false), (1, 2, true), (1, 3, true), (2, 1, false), (3, 1, true)) t(qid, rank, rel)")
def _(spark, d):
    rows = K.RANKED.df(spark).join(K.LABELS.df(spark).where(F.size("relevant") > 0), "qid")
    return rows.select("qid", "rank", T.relevant(F.col("content"), F.col("relevant")).alias("rel"))


@add("jn12_resume", f"SELECT n, question, CASE WHEN question = 'q2' THEN 'later' ELSE answer END AS answer FROM {K.SAMPLES.sql} JOIN (VALUES (1, 'q4'), (2, 'q2'), (3, 'q9')) q(n, question) USING (question)")
def _(spark, d):
    samples = K.SAMPLES.df(spark).withColumn("pos", F.monotonically_increasing_id())
    again = samples.where("question = 'q2'").select("question", F.lit("numeric").alias("type"), F.lit("later").alias("answer"), "contexts", F.lit(1 << 40).alias("pos"))
    asked = spark.createDataFrame([(1, "q4"), (2, "q2"), (3, "q9")], "n int, question string")
    now = E.fingerprint(read(spark, d, "documents"), ["doc_id"], ["source", "doc_id"], "text").first().fingerprint
    same, other = (E.resumed(asked, samples.union(again), now, x) for x in (now, "another"))
    return same.union(other).select("n", "question", "answer")


@add("jn13_question_types", f"SELECT r.qid, coalesce(q.type, '') AS type FROM (SELECT DISTINCT qid FROM {K.RANKED.sql}) r LEFT JOIN (VALUES (1, 'table'), (3, 'figure')) q(qid, type) USING (qid)")
def _(spark, d):
    types = spark.createDataFrame([(1, "table"), (3, "figure"), (1, "table")], "qid int, type string")
    return E.with_types(K.RANKED.df(spark).select("qid").distinct(), types)


@add("mth1_idf", f"WITH {K.BM25.split('dfs AS')[0]} dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term) SELECT term, round(ln((n - df + 0.5) / (df + 0.5) + 1), 6) AS idf FROM dfs, stats")
def _(spark, d):
    docs = read(spark, d, "documents")
    df = R.document_frequencies(docs)
    return df.crossJoin(F.broadcast(R.corpus_stats(docs))).select("term", F.round(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1), 6).alias("idf"))


@add("mth2_cosine", "SELECT a.vec_id, round(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]), 5) AS norm FROM embeddings a")
def _(spark, d):
    e = F.col("embedding")
    return read(spark, d, "embeddings").select("vec_id", F.round(R.dot(e, e), 5).alias("norm"))


LOGITS = Fixture("k int, yes double, no double", ((1, 1.0, 0.0), (2, -2.0, 3.0), (3, 0.0, 0.0)))


@add("mth5_yes_probability", f"SELECT k, round(1 / (1 + exp(no - yes)), 9) AS p FROM {LOGITS.sql}")
def _(spark, d):
    return LOGITS.df(spark).select("k", F.round(E.yes_probability(F.col("yes"), F.col("no")), 9).alias("p"))


@add("mth8_char_faithfulness", f"SELECT question, round(CASE WHEN answer = '' OR array_to_string(contexts, '') = '' THEN 0.0 ELSE len(list_intersect(list_distinct(string_split(answer, '')), list_distinct(string_split(array_to_string(contexts, ''), '')))) / len(list_distinct(string_split(answer, ''))) END, 9)::DOUBLE AS r FROM {K.SAMPLES.sql}")
def _(spark, d):
    return K.SAMPLES.df(spark).select("question", F.round(E.char_overlap(F.array_join("contexts", ""), F.col("answer")), 9).alias("r"))


@add("agg8_macro_average", "SELECT round(avg(r), 4) AS recall_1, round(avg(m), 4) AS mrr FROM (VALUES (0.0, 0.5), (0.0, 0.0), (1.0, 1.0), (0.0, 0.0)) t(r, m)")
def _(spark, d):
    return E.macro_average(E.query_metrics(K.RANKED.df(spark), K.LABELS.df(spark))).select("recall_1", "mrr")


@add("agg16_outcome_counts", f"SELECT CASE WHEN failed THEN 'failed' ELSE 'processed' END AS state, count(*)::INTEGER AS n FROM {K.OUTCOMES.sql} GROUP BY 1")
def _(spark, d):
    return E.outcome_counts(K.OUTCOMES.df(spark))


RESULTS = Fixture("strategy string, mode string, value double", (("semantic", "vector", 0.75), ("semantic", "hybrid", 1.0), ("recursive", "vector", 0.5)))


@add("agg19_headline_pivot", f"SELECT strategy, max(value) FILTER (mode = 'vector') AS vector, max(value) FILTER (mode = 'hybrid') AS hybrid FROM {RESULTS.sql} GROUP BY strategy")
def _(spark, d):
    return E.headline(RESULTS.df(spark), ["vector", "hybrid"])


@add("agg14_index_fingerprint", """WITH r AS (SELECT coalesce(source, '') AS s, doc_id, sha256(coalesce(source, '') || '|' || coalesce(doc_id::VARCHAR, '') || '|' || sha256(coalesce(text, ''))) AS d FROM documents),
e AS (SELECT s, sha256(string_agg(d, '' ORDER BY doc_id, d)) AS d, count(*) AS n FROM r GROUP BY s)
SELECT substr(sha256(string_agg(s || ':' || d, '|' ORDER BY s)), 1, 16) AS fingerprint, sum(n)::BIGINT AS chunks FROM e""")
def _(spark, d):
    return E.fingerprint(read(spark, d, "documents"), ["doc_id"], ["source", "doc_id"], "text")


@add("win1_branch_rank", f"SELECT qid, key, row_number() OVER (PARTITION BY qid ORDER BY score DESC NULLS LAST, pos) AS rank FROM {K.HITS.sql} WHERE branch = 'dense'")
def _(spark, d):
    w = Window.partitionBy("qid").orderBy(F.desc_nulls_last("score"), "pos")
    return K.HITS.df(spark).where("branch = 'dense'").select("qid", "key", F.row_number().over(w).alias("rank"))


@add("win4_distances", f"SELECT block, i, round(1 - list_cosine_similarity(v, lead(v) OVER (PARTITION BY block ORDER BY i)), 9) AS distance FROM {K.SENTS.sql}")
def _(spark, d):
    nxt = F.lead("v").over(Window.partitionBy("block").orderBy("i"))
    v = F.col("v")
    return K.SENTS.df(spark).select("block", "i", F.round(1 - R.dot(v, nxt) / F.sqrt(R.dot(v, v) * R.dot(nxt, nxt)), 9).alias("distance"))


@add("win13_first_relevant", "SELECT * FROM (VALUES (1, 0.5::DOUBLE), (2, 0.0), (3, 1.0), (5, 0.0)) t(qid, mrr)")
def _(spark, d):
    return E.query_metrics(K.RANKED.df(spark), K.LABELS.df(spark)).select("qid", "mrr")


LABEL_RUNS = Fixture("k int, labels array<string>", ((1, ["a", "a", "b", "a"]), (2, ["", "x", "x"]), (3, [])))


@add("win16_label_runs", "SELECT * FROM (VALUES (1, 'a / b / a'), (2, 'x'), (3, '')) t(k, label)")
def _(spark, d):
    seen = F.filter("labels", lambda x: x != "")
    return LABEL_RUNS.df(spark).select("k", F.array_join(F.filter(seen, lambda x, i: (i == 0) | (x != F.get(seen, i - 1))), " / ").alias("label"))


@add("srt10_head_of_list", f"SELECT question, x[1:2] AS first FROM (SELECT question, list_distinct(regexp_extract_all(answer, '\\d+')) AS x FROM {K.SAMPLES.sql}) WHERE len(x) = 1")
def _(spark, d):
    x = F.array_distinct(F.regexp_extract_all("answer", F.lit(r"(\d+)")))
    return K.SAMPLES.df(spark).select("question", F.slice(x, 1, 2).alias("first")).where(F.size("first") == 1)


@add("set4_gram_sets", f"SELECT k, len(list_intersect(g, h))::INTEGER AS both, len(list_distinct(g || h))::INTEGER AS either FROM (SELECT k, {K.GRAMS} AS g, {K.GRAMS.replace('(s)', '(u)').replace('s[i', 'u[i')} AS h FROM (SELECT k, replace(replace(a, chr(10), ''), ' ', '') AS s, replace(replace(b, chr(10), ''), ' ', '') AS u FROM {K.PAIRS.sql}))")
def _(spark, d):
    g, h = T.ngrams(F.col("a")), T.ngrams(F.col("b"))
    return K.PAIRS.df(spark).select("k", F.size(F.array_intersect(g, h)).alias("both"), F.size(F.array_union(g, h)).alias("either"))


@add("str13_strip_layout", f"SELECT k, replace(replace(t, chr(10), ''), ' ', '') AS r FROM {K.CELL_ROWS}")
def _(spark, d):
    return K.cells(spark, d).select("k", T.strip_layout(F.col("t")).alias("r"))


@add("str17_trailing_heading", "SELECT * FROM (VALUES ('a', 1, '（三）推进构网型技术应用。'), ('a', 2, ''), ('a', 3, '（四）标题。'), ('b', 1, '')) t(source, ord, heading)")
def _(spark, d):
    return K.RESTORE.df(spark).select("source", "ord", T.trailing_heading(F.col("content"))["heading"].alias("heading"))


@add("str19_type_labels", "SELECT * FROM (VALUES ('table', '表格'), ('figure', '图表'), ('text', '正文'), ('other', '正文'), (NULL, '正文')) t(type, label)")
def _(spark, d):
    return spark.createDataFrame([("table",), ("figure",), ("text",), ("other",), (None,)], "type string").select("type", T.type_label(F.col("type")).alias("label"))


@add("jsn1_json_roundtrip", f"SELECT qid, key, score FROM {K.HITS.sql}")
def _(spark, d):
    rows = K.HITS.df(spark).select(F.to_json(F.struct("qid", "key", "score")).alias("j"))
    return rows.select(F.from_json("j", "qid int, key string, score double").alias("x")).select("x.*")


DAYS = Fixture("days int", ((0,), (3,), (7,), (30,)))


@add("dat4_recency_groups", f"SELECT days, CASE WHEN days = 0 THEN 'today' WHEN days <= 7 THEN 'week' ELSE 'older' END AS label FROM {DAYS.sql}")
def _(spark, d):
    return DAYS.df(spark).select("days", T.recency(F.col("days")).alias("label"))


SHOWN = Fixture("k int, s double", ((1, None), (2, 12.34), (3, 0.1234), (4, 0.00161)))


@add("str23_score_format", f"SELECT k, CASE WHEN s IS NULL THEN '-' WHEN s >= 10 THEN printf('%.1f', s) WHEN s >= 0.1 THEN printf('%.3f', s) ELSE printf('%.4f', s) END AS shown FROM {SHOWN.sql}")
def _(spark, d):
    return SHOWN.df(spark).select("k", T.score_format(F.col("s")).alias("shown"))


@add("src30_session_parse", "SELECT * FROM (VALUES ('s', 1, 'user', '问题'), ('s', 2, 'assistant', '回答' || chr(10) || '## 不是边界')) t(conv_id, turn, role, text)")
def _(spark, d):
    md = "# 标题\n\n## 用户\n\n问题\n\n## 助手\n\n回答\n\\## 不是边界\n\n### 参考来源\n\n1. a.pdf\n"
    return M.parse(spark.createDataFrame([("s", md)], "conv_id string, markdown string"))


@add("ext_event_windows", "SELECT time_bucket(INTERVAL '5 minutes', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _(spark, d):
    from quarry.streaming.ingest import windowed

    return windowed(read(spark, d, "events")).select("start", "event_type", "n", F.round("total", 4).alias("total"))


@add("agg15_lexical_report", f"SELECT count(*) AS n, round(avg(r), 4) AS rouge_l, round(avg(o), 4) AS char_overlap, round(avg(f), 4) AS char_faithfulness FROM (SELECT CASE WHEN a = '' OR b = '' THEN 0.0 ELSE 2 * {K.LCS} / (length(a) + length(b)) END AS r, CASE WHEN a = '' OR b = '' THEN 0.0 ELSE len(list_intersect(list_distinct(string_split(a, '')), list_distinct(string_split(b, '')))) / len(list_distinct(string_split(b, ''))) END AS o, CASE WHEN b = '' THEN 0.0 ELSE 1.0 END AS f FROM {K.PAIRS.sql})")
def _(spark, d):
    rows = K.PAIRS.df(spark).select(F.col("a").alias("reference"), F.col("b").alias("answer"), F.array("b", F.lit("")).alias("contexts"))
    return E.lexical_report(rows)


@add("prj5_context_keys", """SELECT 1 AS qid, '[{"source":"a","page":2,"type":"text","block_index":4},{"source":"b","type":"table","table_index":1}]' AS keys""")
def _(spark, d):
    rows = spark.createDataFrame([(1, 2, "b", None, "table", None, 1), (1, 1, "a", 2, "text", 4, None)], "qid int, rank int, source string, page int, type string, block_index int, table_index int")
    return E.context_keys(rows).select("qid", F.to_json("keys").alias("keys"))


PLACES = f"SELECT k, CASE k WHEN 1 THEN '第3页 | 标题: 总则' WHEN 2 THEN '所属原文块: 第1—9行' WHEN 3 THEN '所属原文段落: 第2—5段 | 第1个表格' WHEN 4 THEN '工作表: S | 第2—9行 | A—C列 | 表头: 第1—1行' ELSE '' END AS label FROM {K.META.sql}"


@add("str9_location_label", PLACES)
def _(spark, d):
    return K.META.df(spark).select("k", T.location_label().alias("label"))


GROWING = Fixture("k int, t string", ((1, "one\n\ntwo"), (2, "```\n\ncode"), (3, "```\ncode\n```\n\nafter"), (4, "no blank"), (5, ""), (6, "a\n\nb\n\nc")))


@add("str22_committed_prefix", f"SELECT k, CASE k WHEN 1 THEN 5 WHEN 3 THEN 14 WHEN 6 THEN 6 ELSE 0 END AS n FROM {GROWING.sql}")
def _(spark, d):
    return GROWING.df(spark).select("k", T.committed_length(F.col("t")).alias("n"))


@add("mth10_remaining", "SELECT turn, conv_id, CASE WHEN turn > 0 THEN 60.0 / turn * (10 - turn) END AS seconds FROM conversations")
def _(spark, d):
    return read(spark, d, "conversations").select("turn", "conv_id", T.remaining_seconds(F.lit(60.0), F.col("turn"), F.lit(10)).alias("seconds"))


@add("api11_recursive_split", "SELECT doc_id, true AS whole FROM documents WHERE length(text) <= 800 AND trim(text, ' ' || chr(10) || chr(9) || chr(13)) <> ''")
def _(spark, d):
    """Texts that fit stay whole; the parts of others are tested against a plain version."""
    docs = read(spark, d, "documents").where(F.length("text") <= 800)
    return docs.select("doc_id", C.recursive_split(F.col("text")).alias("p"), "text").where(F.size("p") > 0).select("doc_id", ((F.size("p") == 1) & (F.get("p", 0) == T.strip(F.col("text")))).alias("whole"))
