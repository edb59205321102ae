"""Queries over the tables and over literal inputs, each with the SQL that DuckDB answers alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window  # noqa: F401  for the tests

from quarry.functions import text as T
from quarry.operators import chunking as C
from quarry.operators import evaluation as E
from quarry.operators import incremental as I
from quarry.operators import memory as M
from quarry.operators import retrieval as R
from quarry.operators import tables as G
from quarry.plans.fixtures import Fixture
from quarry.sources.store import export_record, filter_chunks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def add(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


TOKENS = f"regexp_extract_all(lower(coalesce(text, '')), '{T.WORD}')"
#: Sentence ends are marked first, as RE2 has no look-behind.
SENTENCES = "string_split(regexp_replace(text, '([。！？；;.!?])', '\\1' || chr(1), 'g'), chr(1))"

# Whole tables: documents, conversations, embeddings.


@add("str1_meaningful_len", f"SELECT doc_id, len(regexp_extract_all(text, '{T.MEANINGFUL}'))::INTEGER AS n FROM documents")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", T.meaningful_len(F.col("text")).alias("n"))


@add("str2_sentences", f"SELECT doc_id, len(s)::INTEGER AS n, md5(array_to_string(s, '|')) AS digest FROM (SELECT doc_id, {SENTENCES} AS s FROM documents)")
def _(spark, d):
    s = T.sentences(F.col("text"))
    return read(spark, d, "documents").select("doc_id", F.size(s).alias("n"), F.md5(F.array_join(s, "|")).alias("digest"))


@add("str4_tokens", f"SELECT doc_id, len(t)::INTEGER AS n, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {TOKENS} AS t FROM documents)")
def _(spark, d):
    t = T.tokens(F.col("text"))
    return read(spark, d, "documents").select("doc_id", F.size(t).alias("n"), F.md5(F.array_join(t, " ")).alias("digest"))


@add("src2_content_hash", "SELECT doc_id, sha256(text) AS digest FROM documents")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@add("flt1_noise_filter", f"SELECT doc_id FROM documents WHERE len(regexp_extract_all(text, '{T.MEANINGFUL}')) >= 20")
def _(spark, d):
    return C.keep_meaningful(read(spark, d, "documents"), col="text").select("doc_id")


@add("flt4_type_source_limit", "SELECT doc_id, source FROM documents WHERE lang = 'en' AND contains(source, '1') ORDER BY doc_id LIMIT 100")
def _(spark, d):
    return filter_chunks(read(spark, d, "documents").withColumn("type", F.col("lang")), "en", "1", 100, order="doc_id").select("doc_id", "source")


@add("agg1_term_frequency", f"SELECT doc_id AS id, term, len({TOKENS})::BIGINT AS dl, count(*) AS tf FROM (SELECT doc_id, text, unnest({TOKENS}) AS term FROM documents) GROUP BY doc_id, term, text")
def _(spark, d):
    return R.postings(read(spark, d, "documents"))


@add("agg2_length_average", f"SELECT count(*) AS n, round(coalesce(sum(len({TOKENS})), 0) / greatest(count(*), 1), 6) AS avgdl FROM documents")
def _(spark, d):
    return R.corpus_stats(read(spark, d, "documents")).select("n", F.round("avgdl", 6).alias("avgdl"))


@add("agg3_document_frequency", f"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({TOKENS}) AS term FROM documents) GROUP BY term")
def _(spark, d):
    return R.document_frequencies(read(spark, d, "documents"), unnamed=False)


BM25 = f"""post AS (SELECT doc_id AS id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len({TOKENS}) AS dl, unnest({TOKENS}) AS term FROM documents) GROUP BY ALL),
stats AS (SELECT count(*) AS n, sum(len({TOKENS})) / greatest(count(*), 1) AS avgdl FROM documents),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
q AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({TOKENS.replace("text", "query")}) AS term FROM questions) GROUP BY ALL),
scored AS (SELECT qid, id, round(sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM q JOIN post USING (term) JOIN dfs USING (term), stats GROUP BY ALL),
sparse AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM scored WHERE score > 0 QUALIFY rank <= 20)"""

#: A few short questions, with repeated and unknown words.
QUESTIONS = Fixture("qid int, query string", ((1, "the license of the software"), (2, "password token secret"), (3, "zzzz unknown"), (4, "Licensed under the Apache License, Version 2.0."), (5, "le de la des eau"), (6, "and and and for"), (7, "der die und von"), (8, "email example phone")))


@add("api5_bm25_search", f"WITH questions AS {QUESTIONS.sql}, {BM25} SELECT qid, id, score, rank FROM sparse")
def bm25_search(spark, d):
    return R.bm25(read(spark, d, "documents"), QUESTIONS.df(spark))


@add("jn2_bm25_benchmark", f"WITH questions AS (SELECT item_id AS qid, text AS query FROM benchmark), {BM25} SELECT qid, id, score, rank FROM sparse")
def bm25_benchmark(spark, d):
    return R.bm25(read(spark, d, "documents"), read(spark, d, "benchmark"), qid_col="item_id", query_col="text")


DENSE = """dense AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (SELECT q.vec_id AS qid, e.vec_id AS id,
round(list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0) QUALIFY rank <= 20)"""


@add("jn3_dense_search", f"WITH {DENSE} SELECT qid, id, score, rank FROM dense")
def dense_search(spark, d):
    e = read(spark, d, "embeddings")
    return R.dense(e, e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("v")))


HYBRID = f"""questions AS (SELECT item_id AS qid, text AS query FROM benchmark), {BM25},
dense AS (SELECT item_id AS qid, id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, id) AS rank FROM (SELECT b.item_id, e.vec_id AS id, round(list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score
FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id, embeddings e) QUALIFY rank <= 20),
fused AS (SELECT coalesce(d.qid, s.qid) AS qid, coalesce(d.id, s.id) AS key, d.score AS dense_score, s.score AS bm25_score, d.rank AS dr, s.rank AS sr,
round(coalesce(1.0::DOUBLE / (60 + d.rank), 0) + coalesce(1.0::DOUBLE / (60 + s.rank), 0), 9) AS rrf_score FROM dense d FULL JOIN sparse s ON d.qid = s.qid AND d.id = s.id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rrf_score DESC, dr NULLS LAST, sr NULLS LAST) AS rank FROM fused QUALIFY rank <= 20)"""


@add("api1_hybrid_retrieve", f"WITH {HYBRID} SELECT qid, key, dense_score, bm25_score, rrf_score, rank FROM ranked")
def hybrid(spark, d):
    """Benchmark items as questions; chunk i's vector is the embedding with its number, and so is question i's."""
    e, b = read(spark, d, "embeddings"), read(spark, d, "benchmark")
    vectors = b.join(e, b.item_id == e.vec_id).select(F.col("item_id").alias("qid"), F.col("embedding").alias("v"))
    dense = R.dense(e, vectors).withColumnRenamed("id", "key")
    return R.rrf(dense, bm25_benchmark(spark, d).withColumnRenamed("id", "key"))


@add("agg6_counts_by_source_and_lang", "SELECT lang, source, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang), (source), ())")
def _(spark, d):
    return E.counts_by(read(spark, d, "documents"), "lang", "source")


@add("agg7_chunk_stats", "SELECT source, count(*) AS n, sum(length(text))::BIGINT AS chars, round(avg(length(text)), 1) AS mean, max(length(text)) AS longest, min(length(text)) AS shortest FROM documents GROUP BY source")
def _(spark, d):
    return E.chunk_stats(read(spark, d, "documents"), col="text")


@add("srt9_sources_most_common", "SELECT source, n FROM (SELECT source, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY source) ORDER BY n DESC, first LIMIT 10")
def _(spark, d):
    return E.most_common(read(spark, d, "documents"), order="doc_id", limit=10)


@add("agg18_session_summaries", "SELECT conv_id, count(*) AS messages, max(turn) AS last, count(*) OVER () AS total FROM conversations GROUP BY conv_id")
def _(spark, d):
    return M.summaries(read(spark, d, "conversations"))


@add("srt8_sessions_newest", "SELECT conv_id, count(*) AS messages, max(turn) AS last, count(*) OVER () AS total FROM conversations GROUP BY conv_id ORDER BY last DESC, conv_id LIMIT 20")
def _(spark, d):
    return M.summaries(read(spark, d, "conversations"), 20)


LINE = "CASE WHEN role = 'assistant' THEN '助手' ELSE '用户' END || '：' || trim(coalesce(text, ''), ' ' || chr(10) || chr(9) || chr(13))"


@add("win9_history_block", f"""SELECT conv_id, '【历史对话】' || chr(10) || string_agg(line, chr(10) ORDER BY turn) || chr(10) || chr(10) AS history FROM (SELECT *, sum(length(line)) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS total FROM
(SELECT conv_id, turn, {LINE} AS line, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 6) WHERE total <= 2000 GROUP BY conv_id""")
def _(spark, d):
    return M.history(read(spark, d, "conversations"), 6, 2000)


@add("snk7_session_roundtrip", "SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn))::INTEGER AS turn, CASE WHEN role = 'assistant' THEN role ELSE 'user' END AS role, regexp_replace(replace(text, chr(13), chr(10)), '^\\n+|\\n+$', '', 'g') AS text FROM conversations")
def session_roundtrip(spark, d):
    """Every conversation rendered as a session file and parsed again."""
    turns = read(spark, d, "conversations").withColumn("sources", F.array(F.lit("a `b`")))
    return M.parse(M.render(turns, F.lit("")))


@add("jn11_annotation_alignment", """SELECT count(*) AS annotations, count(*) FILTER (ok) AS aligned, round(count(*) FILTER (ok) / nullif(count(*), 0), 4) AS rate FROM
(SELECT EXISTS (SELECT 1 FROM documents d WHERE contains(replace(replace(d.text, chr(10), ''), ' ', ''), replace(replace(b.text, chr(10), ''), ' ', ''))) AS ok FROM benchmark b)""")
def _(spark, d):
    b = read(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("annotation"))
    return E.alignment(b, read(spark, d, "documents").select(F.col("text").alias("content")))


#: Lines, long ones cut, dealt to parts one after the other; the line breaks that join them again do not count.
PACKED = """WITH RECURSIVE lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE strlen(text) > 30000),
pieces AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS k, x FROM (SELECT doc_id, i, j, substr(x, j * 7500 + 1, 7500) AS x FROM lines, generate_series(0, 100000) g(j) WHERE strlen(x) > 30000 AND j * 7500 < length(x)
UNION ALL SELECT doc_id, i, 0, x FROM lines WHERE strlen(x) <= 30000)),
dealt AS (SELECT doc_id, k, 1 AS part, strlen(x) AS n FROM pieces WHERE k = 1 UNION ALL SELECT p.doc_id, p.k, d.part + (d.n + strlen(p.x) > 30000)::INTEGER, CASE WHEN d.n + strlen(p.x) > 30000 THEN strlen(p.x) ELSE d.n + strlen(p.x) END FROM dealt d JOIN pieces p ON p.doc_id = d.doc_id AND p.k = d.k + 1),
parts AS (SELECT doc_id, part, string_agg(x, chr(10) ORDER BY k) AS x FROM dealt JOIN pieces USING (doc_id, k) GROUP BY doc_id, part),
kept AS (SELECT doc_id, list(md5(x) ORDER BY part) AS digests, sum(strlen(x))::BIGINT AS bytes FROM parts WHERE trim(x, ' ' || chr(10) || chr(9) || chr(13)) <> '' GROUP BY doc_id)
SELECT doc_id, len(coalesce(digests, [md5(text)]))::INTEGER AS parts, coalesce(bytes, strlen(text)) AS bytes, array_to_string(coalesce(digests, [md5(text)]), ',') AS digests FROM documents LEFT JOIN kept USING (doc_id)"""


@add("win10_byte_packing", PACKED)
def _(spark, d):
    rows = read(spark, d, "documents").select("doc_id", C.split_oversized(F.col("text")).alias("p"))
    return rows.select("doc_id", F.size("p").alias("parts"), F.aggregate("p", F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x)).alias("bytes"), F.array_join(F.transform("p", lambda x: F.md5(x)), ",").alias("digests"))


@add("prj1_export_records", "SELECT doc_id, to_json({'source': source, 'page': n_chars, 'type': 'text', 'content': text, 'line_start': 3, 'line_end': 9}) AS record FROM documents")
def _(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "source", F.col("n_chars").cast("int").alias("page"), F.lit("text").alias("type"), F.col("text").alias("content"), F.lit(None).cast("string").alias("heading_path"), F.lit(3).alias("line_start"), F.lit(9).alias("line_end"))
    return docs.select("doc_id", F.to_json(export_record(docs.columns)).alias("record"))


@add("win15_stratified_questions", "SELECT doc_id AS id, lang AS type, k AS turn FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('17:' || doc_id), doc_id) AS k FROM documents) ORDER BY k, lang LIMIT 80")
def _(spark, d):
    q = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("type"))
    return E.stratified(q, 80)


# Literal inputs.

TEXTS = Fixture("k int, t string", (
    (1, "第一章 总则"), (2, "一、指导思想"), (3, "（二）主要目标"), (4, "1.2 范围"), (5, "1.2、范围"), (6, "3. Scope"), (7, "第十二节电力"), (8, "普通正文。"), (9, ""), (10, None), (11, "  （三）推进应用  "), (12, "一、" + "长" * 60), (13, "1．概述"), (14, "12.3.4. 结论 x"),
))
LEVEL = "CASE WHEN s = '' OR length(s) > 40 THEN NULL " + " ".join(f"WHEN regexp_matches(s, '{p}') THEN {n}" for n, p in T.HEADINGS) + " END"


@add("str3_heading_level", f"SELECT k, {LEVEL} AS level FROM (SELECT k, trim(coalesce(t, '')) AS s FROM {TEXTS.sql})")
def _(spark, d):
    return TEXTS.df(spark).select("k", T.heading_level(F.col("t")).alias("level"))


CELLS = Fixture("k int, t string", ((1, "a|b"), (2, "x\r\ny\nz"), (3, "<b>&'\"</b>"), (4, "back\\slash"), (5, ""), (6, "【问题】和【回答】"), (7, "【历史对话】a【其他】"), (8, "  line one \n two\t `code` "), (9, "# title\n \\x\n  ## 助手\nplain"), (10, "  【长期记忆】记住这件事情，很长很长  ")))
CELL_ROWS = f"(SELECT doc_id AS k, text AS t FROM documents UNION ALL SELECT -k, t FROM {CELLS.sql})"


def cells(spark, d):
    return read(spark, d, "documents").select(F.col("doc_id").alias("k"), F.col("text").alias("t")).union(CELLS.df(spark).select((-F.col("k")).cast("long"), "t"))


ESC = "replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"
ESC = f"replace(replace(replace(replace({ESC}, '\\', '\\\\'), '|', '\\|'), chr(13) || chr(10), chr(10)), chr(10), '<br>')"
DEF = "t"
for _m in T.MARKERS:
    DEF = f"replace({DEF}, '{_m}', '[{_m[1:-1]}]')"


@add("str5_escape_cell", f"SELECT k, {ESC} AS r FROM {CELL_ROWS}")
def _(spark, d):
    return cells(spark, d).select("k", T.escape_cell(F.col("t")).alias("r"))


@add("str6_defuse", f"SELECT k, {DEF} AS r FROM {CELL_ROWS}")
def _(spark, d):
    return cells(spark, d).select("k", T.defuse(F.col("t")).alias("r"))


@add("str7_memory_section", f"SELECT k, CASE WHEN b = '' THEN '' ELSE '【长期记忆】' || chr(10) || CASE WHEN length(b) > 10 THEN b[1:10] || chr(10) || '（长期记忆超过 10 字上限，后续内容未注入）' ELSE b END || chr(10) || chr(10) END AS r FROM (SELECT k, trim({DEF}, ' ' || chr(10)) AS b FROM {CELLS.sql})")
def _(spark, d):
    return CELLS.df(spark).select("k", T.memory_section(F.col("t"), 10).alias("r"))


@add("str11_escape_lines", f"SELECT k, array_to_string(list_transform(string_split(regexp_replace(t, '\\r\\n?', chr(10), 'g'), chr(10)), lambda x: regexp_replace(x, '^( *)([\\\\#])', '\\1\\\\\\2')), chr(10)) AS escaped, regexp_replace(t, '\\r\\n?', chr(10), 'g') AS back FROM {CELL_ROWS}")
def _(spark, d):
    e = T.escape_lines(F.col("t"))
    return cells(spark, d).select("k", e.alias("escaped"), T.unescape_lines(e).alias("back"))


@add("str12_one_line", f"SELECT k, trim(regexp_replace(t, '\\s+', ' ', 'g')) AS title, replace(trim(regexp_replace(t, '\\s+', ' ', 'g')), '`', '''') AS label FROM {CELL_ROWS}")
def _(spark, d):
    return cells(spark, d).select("k", T.one_line(F.col("t")).alias("title"), T.sanitize_label(F.col("t")).alias("label"))


GRAMS = "CASE WHEN length(s) >= 3 THEN list_distinct([s[i : i + 2] FOR i IN range(1, length(s) - 1)]) ELSE [] END"
PAIRS = Fixture("k int, a string, b string", ((1, "能源 规划\n纲要", "能源规划纲要"), (2, "abcdef", "abcxyz"), (3, "ab", "ab"), (4, "", "x"), (5, "电力系统安全稳定运行", "电力系统安全稳定"), (6, "abcabcabc", "abc"), (7, "完全不同的内容", "毫无关系")))


PAIR_ROWS = f"(SELECT a.item_id AS k, a.text AS a, b.text AS b FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1 UNION ALL SELECT -k, a, b FROM {PAIRS.sql})"


def pairs(spark, d):
    b = read(spark, d, "benchmark")
    rows = b.select(F.col("item_id").alias("k"), F.col("text").alias("a")).join(b.select((F.col("item_id") - 1).alias("k"), F.col("text").alias("b")), "k")
    return rows.union(PAIRS.df(spark).select((-F.col("k")).cast("long"), "a", "b"))


@add("mth3_jaccard_ngrams", f"SELECT k, len(g)::INTEGER AS n, round(CASE WHEN len(g) = 0 OR len(h) = 0 THEN 0.0 ELSE len(list_intersect(g, h)) / (len(g) + len(h) - len(list_intersect(g, h))) END, 9)::DOUBLE AS j FROM (SELECT k, {GRAMS} AS g, {GRAMS.replace('(s)', '(u)').replace('s[i', 'u[i')} AS h FROM (SELECT k, replace(replace(a, chr(10), ''), ' ', '') AS s, replace(replace(b, chr(10), ''), ' ', '') AS u FROM {PAIR_ROWS}))")
def _(spark, d):
    g = T.ngrams(F.col("a"))
    return pairs(spark, d).select("k", F.size(g).alias("n"), F.round(T.jaccard(g, T.ngrams(F.col("b"))), 9).alias("j"))


@add("mth7_char_overlap", f"SELECT k, round(CASE WHEN a = '' OR b = '' THEN 0.0 ELSE len(list_intersect(list_distinct(string_split(a, '')), list_distinct(string_split(b, '')))) / len(list_distinct(string_split(b, ''))) END, 9)::DOUBLE AS r FROM {PAIR_ROWS}")
def _(spark, d):
    return pairs(spark, d).select("k", F.round(E.char_overlap(F.col("a"), F.col("b")), 9).alias("r"))


#: The table of the longest common subsequence, row by row as lists.
LCS = """list_last(list_reduce([[0 FOR _ IN range(0, length(a) + 1)]] || [[ord(c)] FOR c IN list_filter(string_split(b, ''), lambda c: c <> '')],
lambda r, c: list_reduce([[0]] || [[i] FOR i IN range(1, length(a) + 1)], lambda acc, i: acc || [CASE WHEN ord(substr(a, i[1], 1)) = c[1] THEN r[i[1]] + 1 ELSE greatest(list_last(acc), r[i[1] + 1]) END])))"""


@add("mth6_rouge_l", f"SELECT k, round(CASE WHEN a = '' OR b = '' THEN 0.0 ELSE 2 * {LCS} / (length(a) + length(b)) END, 9)::DOUBLE AS f1 FROM {PAIRS.sql}")
def rouge(spark, d):
    return PAIRS.df(spark).select("k", F.round(E.lcs_f1(F.col("a"), F.col("b")), 9).alias("f1"))


CAPTIONS = Fixture("k int, c string", ((1, "**续表**"), (2, "图 1  能 源 结构"), (3, ""), (4, None), (5, "表 2 全国"), (6, "  **发 电 量** ")))


@add("src25_caption", "SELECT * FROM (VALUES (1, '续表'), (2, '图 1  能源结构'), (3, ''), (4, ''), (5, '表 2 全国'), (6, '发电量')) t(k, r)")
def _(spark, d):
    return CAPTIONS.df(spark).select("k", T.normalize_caption(F.col("c")).alias("r"))


@add("str16_figure_prompt", f"SELECT k, CASE WHEN coalesce(c, '') = '' THEN '描述' ELSE '这张图的标题是「' || c || '」。' || chr(10) || '描述' END AS r FROM {CAPTIONS.sql}")
def _(spark, d):
    return CAPTIONS.df(spark).select("k", T.figure_prompt(F.lit("描述"), F.col("c")).alias("r"))


REWRITES = Fixture("k int, c string, q string", ((1, "「新的问题」", "旧"), (2, "", "旧"), (3, "两行\n文字", "旧"), (4, "字" * 201, "旧"), (5, "【问题】", "旧"), (6, None, "旧"), (7, '  "quoted" ', "旧")))


@add("flt10_rewrite_acceptance", f"SELECT k, CASE WHEN s = '' OR contains(s, chr(10)) OR length(s) > 200 OR contains(s, '【') OR contains(s, '】') THEN q ELSE s END AS r FROM (SELECT k, q, trim(trim(coalesce(c, '')), '「」『』\"''“”') AS s FROM {REWRITES.sql})")
def _(spark, d):
    return REWRITES.df(spark).select("k", T.accept_rewrite(F.col("c"), F.col("q")).alias("r"))


NUMS = Fixture("n long", tuple((x,) for x in (1, 2, 26, 27, 52, 53, 702, 703, 16384)))


@add("mth9_column_letters", f"SELECT n, CASE WHEN n <= 26 THEN chr((64 + n)::INTEGER) WHEN n <= 702 THEN chr((64 + (n - 1) // 26)::INTEGER) || chr((65 + (n - 1) % 26)::INTEGER) ELSE chr((64 + ((n - 1) // 26 - 1) // 26)::INTEGER) || chr((65 + ((n - 1) // 26 - 1) % 26)::INTEGER) || chr((65 + (n - 1) % 26)::INTEGER) END AS r FROM {NUMS.sql}")
def _(spark, d):
    return NUMS.df(spark).select("n", T.column_letters(F.col("n")).alias("r"))


@add("str20_duration", f"SELECT n, CASE WHEN n >= 3600 THEN printf('%d:%02d:%02d', n // 3600, n % 3600 // 60, n % 60) ELSE printf('%02d:%02d', n // 60, n % 60) END AS r FROM {NUMS.sql}")
def _(spark, d):
    return NUMS.df(spark).select("n", T.duration(F.col("n")).alias("r"))


HITS = Fixture("qid int, branch string, pos int, key string, score double", ((1, "dense", 1, "a", 0.9), (1, "dense", 2, "b", None), (1, "dense", 3, "b", None), (1, "sparse", 1, "a", 2.5), (1, "sparse", 2, "a", 2.5), (2, "dense", 1, "x", 0.5), (2, "sparse", 1, "y", 1.5), (2, "sparse", 2, "z", 1.0)))
UNIQUE = f"(SELECT qid, branch, key, score, pos, row_number() OVER (PARTITION BY qid, branch ORDER BY pos) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid, branch, key ORDER BY pos) AS k FROM {HITS.sql}) WHERE k = 1)"


@add("win2_first_occurrence", f"SELECT qid, branch, key, rank FROM {UNIQUE}")
def _(spark, d):
    return R.first_of_each(HITS.df(spark), by=("qid", "branch")).select("qid", "branch", "key", "rank")


@add("jn1_rrf", f"""SELECT qid, key, dense_score, bm25_score, rrf_score, row_number() OVER (PARTITION BY qid ORDER BY rrf_score DESC, dr NULLS LAST, sr NULLS LAST) AS rank FROM (SELECT coalesce(d.qid, s.qid) AS qid, coalesce(d.key, s.key) AS key, d.score AS dense_score, s.score AS bm25_score, d.rank AS dr, s.rank AS sr,
round(coalesce(1.0::DOUBLE / (60 + d.rank), 0) + coalesce(1.0::DOUBLE / (60 + s.rank), 0), 9) AS rrf_score FROM (SELECT * FROM {UNIQUE} WHERE branch = 'dense') d FULL JOIN (SELECT * FROM {UNIQUE} WHERE branch = 'sparse') s ON d.qid = s.qid AND d.key = s.key)""")
def _(spark, d):
    u = R.first_of_each(HITS.df(spark), by=("qid", "branch"))
    return R.rrf(u.where("branch = 'dense'"), u.where("branch = 'sparse'"))


RERANK = Fixture("qid int, key string, rank int, s double", ((1, "a", 1, 0.1), (1, "b", 2, 0.9), (1, "c", 3, 0.9), (1, "d", 4, 0.5), (2, "e", 1, 0.3)))


@add("srt4_rerank_top_k", f"SELECT qid, key, s AS rerank_score, row_number() OVER (PARTITION BY qid ORDER BY s DESC, rank) AS rank FROM {RERANK.sql} QUALIFY row_number() OVER (PARTITION BY qid ORDER BY s DESC, rank) <= 3")
def _(spark, d):
    return R.rerank(RERANK.df(spark), F.col("s"), 3).drop("s")


MANIFEST = Fixture("source string, digest string", (("a.pdf", "a1"), ("b.pdf", "b1"), ("d.pdf", "d1")))
FILES = Fixture("source string, digest string", (("a.pdf", "a1"), ("b.pdf", "b2"), ("c.pdf", "c1")))
CHUNKS = Fixture("source string, content string", (("a.pdf", "old a"), ("b.pdf", "old b1"), ("b.pdf", "old b2"), ("d.pdf", "old d")))
FRESH = Fixture("source string, content string", (("b.pdf", "new b"), ("c.pdf", "new c")))


@add("jn4_changed_files", f"SELECT f.source, f.digest FROM {FILES.sql} f LEFT JOIN {MANIFEST.sql} m USING (source) WHERE m.digest IS DISTINCT FROM f.digest")
def _(spark, d):
    return I.changed(FILES.df(spark), MANIFEST.df(spark))


@add("jn5_removed_files", f"SELECT source FROM {MANIFEST.sql} WHERE source NOT IN (SELECT source FROM {FILES.sql})")
def _(spark, d):
    return I.removed(MANIFEST.df(spark), FILES.df(spark))


@add("jn6_merge_chunks", f"SELECT source, content FROM {CHUNKS.sql} WHERE source NOT IN ('b.pdf', 'c.pdf', 'd.pdf') UNION ALL SELECT source, content FROM {FRESH.sql}")
def _(spark, d):
    files, manifest = FILES.df(spark), MANIFEST.df(spark)
    sources = I.replaced(I.changed(files, manifest), I.removed(manifest, files))
    return I.merge_chunks(CHUNKS.df(spark), FRESH.df(spark), sources)


@add("jn7_merge_manifest", "SELECT * FROM (VALUES ('a.pdf', 'a1'), ('b.pdf', 'b2'), ('c.pdf', 'c1')) t(source, digest)")
def _(spark, d):
    files, manifest = FILES.df(spark), MANIFEST.df(spark)
    ok = I.changed(files, manifest)
    return I.merge_manifest(manifest, files, I.replaced(ok, I.removed(manifest, files)), ok)


@add("jn8_only_missing", f"SELECT * FROM (VALUES ('x.pdf')) t(source) EXCEPT SELECT source FROM {FILES.sql}")
def _(spark, d):
    return I.missing(spark.createDataFrame([("x.pdf",), ("a.pdf",), ("x.pdf",)], "source string"), FILES.df(spark))


@add("jn9_source_counts", f"SELECT m.source, count(c.source) AS chunks FROM {MANIFEST.sql} m LEFT JOIN {FRESH.sql} c USING (source) GROUP BY 1")
def _(spark, d):
    return I.source_counts(MANIFEST.df(spark), FRESH.df(spark))


PIECES = Fixture("source string, ord int, type string, block_kind string, content string", (
    ("a", 1, "table", "table", "| t |"), ("a", 2, "text", "section", "这一段正文足够长所以应该保留下来用于检索测试"), ("a", 3, "text", "code", "x = 1"), ("a", 4, "figure", "figure", "图"), ("a", 5, "text", None, "太短"), ("a", 6, "text", "list", "- 甲"), ("b", 1, "text", "section", "另一个文件里同样足够长的正文内容也会保留下来"),
))


@add("set1_union_in_class_order", f"SELECT source, (row_number() OVER (PARTITION BY source ORDER BY c, ord))::INTEGER AS ord, type, content FROM (SELECT *, CASE WHEN type = 'figure' THEN 3 WHEN type = 'table' THEN 2 WHEN block_kind IN ('code', 'list') THEN 1 ELSE 0 END AS c FROM {PIECES.sql}) WHERE c > 0 OR len(regexp_extract_all(content, '{T.MEANINGFUL}')) >= 20")
def _(spark, d):
    from quarry.plans.chunker import Chunker

    return Chunker().split(PIECES.df(spark)).select("source", "ord", "type", "content")


@add("set2_replaced_sources", f"SELECT source FROM {FRESH.sql} UNION SELECT 'd.pdf'")
def _(spark, d):
    return I.replaced(FRESH.df(spark), I.removed(MANIFEST.df(spark), FILES.df(spark)))


OUTCOMES = Fixture("pos int, source string, failed boolean", ((1, "a", True), (2, "b", False), (3, "c", True), (4, "d", True), (5, "e", True), (6, "f", False)))


@add("stm7_failures_in_a_row", "SELECT * FROM (VALUES (1, 'a', true, 1, false), (2, 'b', false, 0, false), (3, 'c', true, 1, false), (4, 'd', true, 2, false), (5, 'e', true, 3, true), (6, 'f', false, 0, false)) t(pos, source, failed, in_row, stop)")
def _(spark, d):
    return I.breaker(OUTCOMES.df(spark)).withColumn("in_row", F.col("in_row").cast("int"))


RANKED = Fixture("qid int, rank int, content string", ((1, 1, "无关内容"), (1, 2, "能源 规划纲要"), (1, 3, "能源规划"), (2, 1, "电力市场"), (3, 1, "x"), (4, 1, "未标注")))
LABELS = Fixture("qid int, relevant array<string>", ((1, ["能源规划纲要", "另一条"]), (2, ["完全不同的标注"]), (3, ["x"]), (4, []), (5, ["没有结果"])))


@add("mth4_retrieval_metrics", """WITH r(qid, rank, rel) AS (VALUES (1, 1, 0), (1, 2, 1), (1, 3, 1), (2, 1, 0), (3, 1, 1)), q(qid, n) AS (VALUES (1, 2), (2, 1), (3, 1), (5, 1)) SELECT qid, """ + ", ".join(
    f"least(1.0::DOUBLE, coalesce(sum(rel) FILTER (rank <= {k}), 0) / n) AS recall_{k}, coalesce(avg(rel) FILTER (rank <= {k}), 0.0) AS precision_{k}, (coalesce(sum(rel) FILTER (rank <= {k}), 0) > 0)::INTEGER::DOUBLE AS hit_{k}, round(least(1.0, coalesce(sum(rel / log2(rank + 1)) FILTER (rank <= {k}), 0.0) / list_sum([1 / log2(i + 1) FOR i IN range(1, least(n, {k}) + 1)])), 9)::DOUBLE AS ndcg_{k}"
    for k in E.KS) + ", coalesce(1.0::DOUBLE / min(rank) FILTER (rel = 1), 0.0) AS mrr FROM q LEFT JOIN r USING (qid) GROUP BY qid, n")
def _(spark, d):
    return E.query_metrics(RANKED.df(spark), LABELS.df(spark))


SAMPLES = Fixture("question string, type string, answer string, contexts array<string>", (
    ("q1", "negative", "无法回答该问题", ["x"]), ("q2", "negative", "答案是 12", ["13"]), ("q3", "numeric", "增长 3.5% 到 120 万", ["3.5 与 12", "0"]), ("q4", "text", "没有数字", []), ("q5", "numeric", "2020 2020 2021", ["2020"]),
))


@add("agg12_refusals", f"SELECT count(*) FILTER (type = 'negative') AS n, count(*) FILTER (type = 'negative' AND regexp_matches(answer, '{'|'.join(E.REFUSALS)}')) AS refused, round(count(*) FILTER (type = 'negative' AND regexp_matches(answer, '{'|'.join(E.REFUSALS)}')) / count(*) FILTER (type = 'negative'), 4) AS rate FROM {SAMPLES.sql}")
def _(spark, d):
    return E.refusals(SAMPLES.df(spark))


@add("agg13_numeric_support", f"SELECT count(*) AS n, sum(len(x))::BIGINT AS numbers, sum(len(u))::BIGINT AS unsupported, round(sum(len(u)) / sum(len(x)), 4) AS unsupported_rate FROM (SELECT x, list_filter(x, lambda v: NOT contains(c, v)) AS u FROM (SELECT list_distinct(regexp_extract_all(answer, '\\d+(?:\\.\\d+)?')) AS x, array_to_string(contexts, '') AS c FROM {SAMPLES.sql})) WHERE len(x) > 0")
def _(spark, d):
    return E.numeric_support(SAMPLES.df(spark))


SCORES = Fixture("question string, type string, faithfulness double, answer_relevancy double, context_precision double, context_recall double", (("a", "table", 0.5, None, 1.0, 0.25), ("b", "figure", 1.0, 0.75, None, 0.5), ("c", "table", None, 0.5, 0.5, None), ("d", "negative", 1.0, 0.0, 0.5, 0.0)))


@add("agg9_average_scores", f"SELECT count(*) AS n, {', '.join(f'round(avg({c}), 4) AS {c}' for c in E.SCORES)} FROM {SCORES.sql}")
def _(spark, d):
    return E.average_scores(SCORES.df(spark))


@add("agg10_scores_by_type", f"SELECT negative, type, count(*) AS n, {', '.join(f'round(avg({c}), 4) AS {c}' for c in E.SCORES)} FROM (SELECT *, coalesce(type = 'negative', false) AS negative FROM {SCORES.sql}) GROUP BY GROUPING SETS ((negative, type), (negative))")
def _(spark, d):
    return E.scores_by_type(SCORES.df(spark))


BLOCKS = Fixture("source string, ord int, level int, title string", (("a", 1, 1, "总则"), ("a", 2, 2, "目标"), ("a", 3, None, None), ("a", 4, 2, "范围"), ("a", 5, 3, "细则"), ("a", 6, 1, "附则"), ("b", 1, 2, "独立"), ("b", 2, None, None)))


@add("src8_heading_stack", "SELECT * FROM (VALUES ('a', 1, '总则'), ('a', 2, '总则 > 目标'), ('a', 3, '总则 > 目标'), ('a', 4, '总则 > 范围'), ('a', 5, '总则 > 范围 > 细则'), ('a', 6, '附则'), ('b', 1, '独立'), ('b', 2, '独立')) t(source, ord, heading_path)")
def _(spark, d):
    return C.heading_paths(BLOCKS.df(spark)).select("source", "ord", "heading_path")


RESTORE = Fixture("source string, ord int, content string", (("a", 1, "这一段足够长的正文内容用来保留下来继续使用。（三）推进构网型技术应用。"), ("a", 2, "后面的正文。"), ("a", 3, "短。（四）标题。"), ("b", 1, "另一个文件的正文。")))


@add("win7_restore_headings", f"SELECT source, ord, CASE WHEN source = 'a' AND ord = 1 THEN '这一段足够长的正文内容用来保留下来继续使用。' WHEN source = 'a' AND ord = 2 THEN '（三）推进构网型技术应用。' || content ELSE content END AS content FROM {RESTORE.sql}")
def _(spark, d):
    return C.restore_headings(RESTORE.df(spark))


SENTS = Fixture("block int, i int, sentence string, v array<double>", ((1, 0, "A。", [1.0, 0.0]), (1, 1, "B。", [0.9, 0.1]), (1, 2, "C。", [0.0, 1.0]), (1, 3, "D。", [0.1, 0.9]), (2, 0, "单句。", [1.0, 1.0])))


@add("win3_sentence_windows", f"SELECT block, i, array_to_string(list(sentence) OVER (PARTITION BY block ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), ' ') AS combined FROM {SENTS.sql}")
def _(spark, d):
    return C.sentence_windows(SENTS.df(spark)).select("block", "i", "combined")


@add("win5_semantic_chunks", f"""WITH s AS {SENTS.sql}, d AS (SELECT *, 1 - list_cosine_similarity(v, lead(v) OVER (PARTITION BY block ORDER BY i)) AS dist FROM s), l AS (SELECT block, quantile_cont(dist, 0.82) AS lim FROM d GROUP BY block),
c AS (SELECT d.*, coalesce(sum(CASE WHEN dist > lim THEN 1 ELSE 0 END) OVER (PARTITION BY d.block ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS chunk FROM d JOIN l USING (block)) SELECT block, chunk, string_agg(sentence, ' ' ORDER BY i) AS content FROM c GROUP BY block, chunk""")
def _(spark, d):
    return C.semantic_chunks(SENTS.df(spark))


HTML = Fixture("k int, html string, caption string", (
    (1, "<table><tr><td>a|b</td><td>x<br/>y</td></tr><tr><td>1</td><td>2</td></tr></table>", "题注"), (2, "<table><tr><td>only</td><td>row</td></tr></table>", ""), (3, "<table><tr><th>h1</th><th>h2</th></tr>" + "".join(f"<tr><td>{i}</td><td>v{i}</td></tr>" for i in range(5)) + "</table>", None),
    (4, "<table><tr><td rowspan='2'>r</td><td>1</td></tr><tr><td>2</td></tr><tr><td colspan=2>w</td></tr></table>", None), (5, "<table><tr><td>x</td></tr><tr><td>y</td></tr></table>", None),
))


@add("src24_html_table_slices", "SELECT * FROM (VALUES (1, 1, 1, '表格：题注（第 1—1 行）|n|| a\\|b | x y ||n|| --- | --- ||n|| 1 | 2 |'), (3, 1, 2, '表格（第 1—2 行）|n|| h1 | h2 ||n|| --- | --- ||n|| 0 | v0 ||n|| 1 | v1 |'), (3, 3, 4, '表格（第 3—4 行）|n|| h1 | h2 ||n|| --- | --- ||n|| 2 | v2 ||n|| 3 | v3 |'), (3, 5, 5, '表格（第 5—5 行）|n|| h1 | h2 ||n|| --- | --- ||n|| 4 | v4 |'), (4, 1, 2, '表格（第 1—2 行）|n|| r | 1 ||n|| --- | --- ||n||  | 2 ||n|| w |  |')) t(k, row_start, row_end, content)")
def _(spark, d):
    out = G.grid_chunks(G.html_tables(HTML.df(spark)), rows_per_chunk=2)
    return out.select("k", "row_start", "row_end", F.replace("content", F.lit("\n"), F.lit("|n|")).alias("content"))


SHEET = Fixture("sheet string, row int, col int, value string, vtype string, formula string, cached string", (
    ("S", 1, 2, "名称", "string", None, None), ("S", 1, 3, "数量", "string", None, None), ("S", 2, 2, "a|b", "string", None, None), ("S", 2, 3, None, "formula", "=1+1", "2"), ("S", 3, 2, "c", "string", None, None), ("S", 3, 3, "true", "boolean", None, None),
    ("S", 5, 1, "仅表头", "string", None, None), ("T", 1, 1, "合并", "string", None, None), ("T", 2, 1, "x", "string", None, None), ("T", 2, 2, None, "formula", "=A1", None),
))
MERGES = Fixture("sheet string, min_row int, min_col int, max_row int, max_col int", (("T", 1, 1, 1, 2),))


@add("src15_merged_cells", "SELECT * FROM (VALUES ('T', 1, 1, '合并'), ('T', 1, 2, '合并'), ('T', 2, 1, 'x'), ('T', 2, 2, '公式：=A1（无缓存结果）')) t(sheet, row, col, text)")
def _(spark, d):
    return G.expand_merges(SHEET.df(spark).where("sheet = 'T'"), MERGES.df(spark))


@add("src17_sheet_chunks", """SELECT * FROM (VALUES ('S', 2, 2, 'B', 'C', 1, 1, '工作表：S/| 原文行 | 名称 | 数量 |/| --- | --- | --- |/| 2 | a\\|b | 2（缓存结果；公式：=1+1） |'), ('S', 3, 3, 'B', 'C', 1, 1, '工作表：S/| 原文行 | 名称 | 数量 |/| --- | --- | --- |/| 3 | c | TRUE |'),
('S', 5, 5, 'A', 'A', 5, 5, '工作表：S/| 原文行 | 仅表头 |/| --- | --- |'), ('T', 2, 2, 'A', 'B', 1, 1, '工作表：T/| 原文行 | 合并 | 合并 |/| --- | --- | --- |/| 2 | x | 公式：=A1（无缓存结果） |')) t(sheet, row_start, row_end, column_start, column_end, header_row_start, header_row_end, content)""")
def _(spark, d):
    return G.sheet_chunks(G.expand_merges(SHEET.df(spark), MERGES.df(spark)), rows_per_chunk=1).withColumn("content", F.replace("content", F.lit("\n"), F.lit("/")))


META = Fixture("k int, source string, page int, caption string, heading_path string, line_start int, line_end int, paragraph_start int, paragraph_end int, table_index int, sheet_name string, row_start int, row_end int, column_start string, column_end string, header_row_start int, header_row_end int", (
    (1, "a.pdf", 3, "图 1", "总则", None, None, None, None, None, None, None, None, None, None, None, None), (2, "b.md", None, None, None, 1, 9, None, None, None, None, None, None, None, None, None, None),
    (3, "c.docx", 0, "", "", None, None, 2, 5, 1, None, None, None, None, None, None, None), (4, "d.xlsx", None, None, None, None, None, None, None, None, "S", 2, 9, "A", "C", 1, 1), (5, None, None, None, None, None, None, None, None, None, None, None, None, None, None, None, None),
))


@add("str8_source_label", "SELECT * FROM (VALUES (1, 'a.pdf 第3页 | 图 1 | 标题: 总则'), (2, 'b.md | 所属原文块: 第1—9行'), (3, 'c.docx | 所属原文段落: 第2—5段 | 第1个表格'), (4, 'd.xlsx | 工作表: S | 第2—9行 | A—C列 | 表头: 第1—1行'), (5, '?')) t(k, label)")
def _(spark, d):
    return META.df(spark).select("k", T.source_label().alias("label"))


@add("agg11_heat_bins", f"SELECT question, CASE WHEN faithfulness IS NULL THEN NULL WHEN faithfulness < 0.5 THEN 0 WHEN faithfulness < 0.7 THEN 1 WHEN faithfulness < 0.85 THEN 2 ELSE 3 END AS bin FROM {SCORES.sql}")
def _(spark, d):
    return SCORES.df(spark).select("question", E.heat_bin(F.col("faithfulness")).alias("bin"))


FRAMES = Fixture("k int, name string, payload string", ((1, "token", "hello"), (2, "sources", "[1,\n2]"), (3, "done", "a\r\nb")))


@add("snk9_event_frames", f"SELECT k, 'event: ' || name || chr(10) || 'data: ' || replace(replace(payload, chr(13), '\\r'), chr(10), chr(10) || 'data: ') || chr(10) || chr(10) AS frame FROM {FRAMES.sql}")
def _(spark, d):
    return FRAMES.df(spark).select("k", T.sse_frame(F.col("name"), F.col("payload")).alias("frame"))


@add("jsn2_event_decode", f"SELECT k, name AS event, replace(payload, chr(13), '\\r') AS data FROM {FRAMES.sql}")
def _(spark, d):
    x = T.sse_decode(T.sse_frame(F.col("name"), F.col("payload")))
    return FRAMES.df(spark).select("k", x["event"].alias("event"), x["data"].alias("data"))


IDS = Fixture("id string", (("20240101-120000-a1b2c3",), ("20240101-120000-A1B2C3",), ("20240101-120000-a1b2c3\n",), ("x",), ("",)))


@add("flt8_session_ids", "SELECT '20240101-120000-a1b2c3' AS id")
def _(spark, d):
    return IDS.df(spark).where(F.col("id").rlike(M.SESSION_ID))


@add("map1_json_safe", "SELECT * FROM (VALUES (1, 0.5::DOUBLE), (2, NULL), (3, NULL), (4, NULL)) t(k, v)")
def _(spark, d):
    rows = spark.createDataFrame([(1, 0.5), (2, float("nan")), (3, float("inf")), (4, None)], "k int, v double")
    return rows.select("k", T.json_safe(F.col("v")).alias("v"))


STAMPS = Fixture("ms long", ((0,), (1700000000000,), (1735689599000,)))


@add("dat1_timestamps", f"SELECT ms, CASE WHEN ms = 0 THEN '' ELSE strftime(make_timestamp(ms * 1000), '%Y-%m-%d %H:%M:%S') END AS shown, nullif(ms, 0) AS back FROM {STAMPS.sql}")
def _(spark, d):
    shown = T.shown_time(F.col("ms"))
    return STAMPS.df(spark).select("ms", shown.alias("shown"), T.time_shown(shown).alias("back"))
