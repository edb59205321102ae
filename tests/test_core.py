"""The queries against DuckDB, and readers, builds and streams on small files."""

import base64
import datetime
import json
import os
import shutil
import subprocess
import sys
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import chunking, evaluation, tables
from quarry.plans import catalog, details, pipeline  # noqa: F401
from quarry.sources import files, layout, markdown, store, word
from quarry.sources.excel import workbook_chunks
from quarry.streaming import ingest
from tests_paths import ROOT, SMALL


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations", "labels", "pages", "events"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_agrees_with_sql(spark, db, name):
    q = db.execute(catalog.SQL[name])
    cols = [c[0] for c in q.description]
    want = sorted((tuple(map(plain, r)) for r in q.fetchall()), key=repr)
    df = catalog.QUERIES[name](spark, SMALL)
    assert sorted(df.columns) == sorted(cols)
    assert sorted((tuple(map(plain, r)) for r in df.select(*cols).collect()), key=repr) == want


def test_rouge(spark):
    def lcs(a, b):
        prev = [0] * (len(b) + 1)
        for x in a:
            row = [0]
            for j, y in enumerate(b):
                row.append(prev[j] + 1 if x == y else max(prev[j + 1], row[-1]))
            prev = row
        return prev[-1]

    for r in catalog.rouge(spark, SMALL).join(catalog.PAIRS.df(spark), "k").collect():
        n = lcs(r.a, r.b)
        want = 2 * (n / len(r.a)) * (n / len(r.b)) / (n / len(r.a) + n / len(r.b)) if n else 0.0
        assert abs(r.f1 - want) < 1e-8


@pytest.mark.parametrize("gone", [("quarry/llm", "tests/llm", "corpus_pipeline.py"), ("quarry/llm", "tests/llm")])
def test_entry_without_the_training_data_package(tmp_path, gone):
    """A copy of the repository without the package imports, and keeps the other queries."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__"))
    for name in gone:
        shutil.rmtree(copy / name) if (copy / name).is_dir() else (copy / name).unlink()
    code = "import __spark_entry__ as e; from quarry.plans import catalog; assert set(e.queries()) == set(catalog.QUERIES); assert set(e.oracle_sql()) == set(catalog.SQL)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, check=True, timeout=120)


MD = "# 标题 A\n\n引言段落。\n\n- 一\n- 二\n\n## 小节\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n```py\n# not a heading\n```\n\n结尾。\n\nSetext\n======\n\ntext\n"


def test_markdown_covers_every_line_once():
    got = markdown.read_markdown("x.md", MD.encode())
    lines = MD.splitlines()
    seen = [n for b in got for n in range(b["line_start"], b["line_end"] + 1) if lines[n - 1].strip()]
    assert seen == [n for n, x in enumerate(lines, 1) if x.strip()]
    assert [(b["block_kind"], b["heading_path"]) for b in got] == [("section", "标题 A"), ("list", "标题 A"), ("section", "标题 A > 小节"), ("table", "标题 A > 小节"), ("code", "标题 A > 小节"), ("section", "标题 A > 小节"), ("section", "Setext")]
    assert got[1]["content"] == "引言段落。\n\n- 一\n- 二\n"
    for bad in (b"", b"  \n", b"\xff", b"a\0b"):
        with pytest.raises(ValueError):
            markdown.read_markdown("x.md", bad)


def docx(path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, style="": f'<w:p>{f"<w:pPr><w:pStyle w:val=\"{style}\"/></w:pPr>" if style else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    body = p("能源报告", "H1") + p("概述文字足够长的一段内容用于测试切分与保留") + p("电力", "H2") + "<w:p><w:ins><w:r><w:t>插入</w:t></w:r></w:ins><w:del><w:r><w:delText>删</w:delText><w:t>除</w:t></w:r></w:del></w:p>" + f"<w:tbl><w:tr>{cell('a|b')}{cell('c')}</w:tr></w:tbl>" + p("表后的正文也要足够长才能通过长度门槛的检查")
    styles = '<w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style><w:style w:styleId="H2"><w:name w:val="x"/><w:basedOn w:val="H3"/></w:style><w:style w:styleId="H3"><w:name w:val="标题 2"/></w:style>'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f"<w:styles {w}>{styles}</w:styles>")


def xlsx(path):
    m = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    r = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {m} xmlns:r="{r}"><sheets><sheet name="S" sheetId="1" r:id="r1"/><sheet name="H" sheetId="2" state="hidden" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="worksheets/s2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {m}><si><t>名称</t></si><si><t>值</t></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {m}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/s1.xml", f'<worksheet {m}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="2"><c r="A2" s="1"><v>45292</v></c><c r="B2"><f>1+1</f><v>2</v></c></row><row r="3"><c r="A3"><v>0</v></c><c r="B3" t="b"><v>0</v></c></row></sheetData><mergeCells count="1"><mergeCell ref="A3:A4"/></mergeCells></worksheet>')
        z.writestr("xl/worksheets/s2.xml", f'<worksheet {m}><sheetData><row r="1"><c r="C1" t="inlineStr"><is><t>仅表头</t></is></c></row></sheetData></worksheet>')


def test_word(tmp_path):
    docx(tmp_path / "a.docx")
    got = word.read_word("a.docx", (tmp_path / "a.docx").read_bytes())
    assert [(b["block_kind"], b["block_index"], b["heading_path"]) for b in got] == [("section", 1, "能源报告"), ("section", 3, "能源报告 > 电力"), ("table", 5, "能源报告 > 电力"), ("section", 6, "能源报告 > 电力")]
    assert got[1]["content"] == "电力\n\n插入" and "a\\|b" in got[2]["content"] and got[3]["paragraph_start"] == 5


def test_workbook(spark, tmp_path):
    xlsx(tmp_path / "a.xlsx")
    (tmp_path / "b.xlsx").write_bytes(b"broken")
    rows = workbook_chunks(files.scan(spark, str(tmp_path), [".XLSX"])).collect()
    good = {(r.source, r.sheet_name): r for r in rows if r.error is None}
    s = good["a.xlsx", "S"]
    day = datetime.datetime(2024, 1, 1).isoformat()
    assert s.content.split("\n") == ["工作表：S", "| 原文行 | 名称 | 值 |", "| --- | --- | --- |", f"| 2 | {day} | 2（缓存结果；公式：=1+1） |", "| 3 | 0 | FALSE |", "| 4 | 0 |  |"]
    assert good["a.xlsx", "H"].sheet_state == "hidden" and good["a.xlsx", "H"].column_start == "C"
    assert [r.source for r in rows if r.error is not None] == ["b.xlsx"]


def test_layout(spark, tmp_path):
    image = "data:image/png;base64," + base64.b64encode(b"png").decode()
    items = [
        {"type": "header", "text": "页眉", "page_idx": 0}, {"type": "text", "text": "一、总则", "page_idx": 0}, {"type": "table", "page_idx": 0, "table_body": "<table><tr><td>a</td><td>b</td></tr><tr><td>1</td><td>2</td></tr></table>", "table_caption": ["表", "一"]},
        {"type": "text", "text": "（二）目标", "page_idx": 1}, {"type": "image", "page_idx": 1, "img_path": image, "bbox": [0, 0, 0.5, 0.5], "image_caption": ["图 一"]}, {"type": "image", "page_idx": 1, "img_path": image, "bbox": [0, 0, 0.01, 0.5]}, {"type": "list", "text": "1. 甲", "page_idx": 1},
    ]
    (tmp_path / "a.json").write_text(json.dumps(items), encoding="utf-8")
    got = sorted(layout.blocks(layout.read(spark, str(tmp_path))).collect(), key=lambda r: r.pos)
    assert [(r.type, r.page, r.block_index) for r in got] == [("text", 1, 1), ("table", 1, 2), ("text", 2, 1), ("figure", 2, 2), ("text", 2, 4)]
    assert got[1].caption == "表一" and got[1].row_end == 1 and bytes(got[3].image) == b"png" and got[4].block_kind == "list"
    assert [r.heading_path for r in got] == ["一、总则", "一、总则", "一、总则 > （二）目标", "一、总则 > （二）目标", "一、总则 > （二）目标 > 1. 甲"]


def test_build_incremental_and_questions(spark, tmp_path):
    docs, idx = tmp_path / "docs", store.Store(spark, str(tmp_path / "index"))
    docs.mkdir()
    text = "这是一份足够长的文本文件内容，用来测试构建与增量更新流程。"
    (docs / "a.txt").write_text(text + "甲", encoding="utf-8")
    (docs / "b.md").write_text(MD + text, encoding="utf-8")
    (docs / "~$c.docx").write_bytes(b"lock")
    assert sorted(pipeline.build(spark, str(docs), idx).processed) == ["a.txt", "b.md"]
    assert pipeline.build(spark, str(docs), idx, incremental_=True) == pipeline.Outcome()
    (docs / "a.txt").write_bytes(b"\xff")
    (docs / "b.md").unlink()
    docx(docs / "d.docx")
    out = pipeline.build(spark, str(docs), idx, incremental_=True)
    assert out.processed == ["d.docx"] and out.removed == ["b.md"] and list(out.failed) == ["a.txt"]
    chunks = idx.chunks()
    assert {r.source for r in chunks.select("source").distinct().collect()} == {"a.txt", "d.docx"}
    with pytest.raises(RuntimeError):
        pipeline.build(spark, str(docs), idx)  # a full build stops at the failure, before any change
    with pytest.raises(ValueError):
        pipeline.build(spark, str(docs), idx, incremental_=True, only=["nope.txt"])
    table = chunks.withColumn("id", F.row_number().over(catalog.Window.orderBy("source", "ord", "content")))
    q = spark.createDataFrame([(1, "电力 能源报告"), (2, "zzz")], "qid int, query string")
    hits = pipeline.retrieve(table, q)
    assert {r.qid for r in hits.collect()} == {1}
    full = hits.join(table.withColumnRenamed("id", "key"), "key")
    prompt = pipeline.prompts(full, q).collect()
    assert len(prompt) == 1 and "[片段 1 | " in prompt[0].prompt and "电力 能源报告" in prompt[0].prompt
    idx.begin_write()
    with pytest.raises(RuntimeError):
        idx.chunks()


def test_registry():
    for bad in ({}, {"txt": files.read_text}, {".txt": files.read_text, ".TXT": files.read_text}):
        with pytest.raises(ValueError):
            files.Registry(bad)
    assert files.Registry({".txt": files.read_text}).fingerprint == ".txt=read_text"


def test_stream_of_files(spark, tmp_path):
    src, seen = tmp_path / "in", []
    src.mkdir()
    (src / "a.txt").write_text("one")
    for _ in range(2):
        ingest.follow(spark, str(src), str(tmp_path / "cp"), lambda df, n: seen.extend(r.source for r in df.select("source").collect())).awaitTermination()
        (src / "b.txt").write_text("two")
    assert seen == ["a.txt", "b.txt"]


def test_oversized_and_recursive(spark):
    text = "\n".join(["x" * 50] * 30 + ["长" * 200])
    parts = spark.createDataFrame([(text,)], "t string").select(chunking.split_oversized(F.col("t"), 400).alias("p"), chunking.recursive_split(F.col("t"), 300, 50).alias("r")).first()
    assert all(len(p.encode()) <= 410 for p in parts.p) and "".join("".join(parts.p).split()) == "".join(text.split())
    assert all(len(p) <= 300 for p in parts.r)


def test_fingerprint_follows_chunks_and_their_order(spark):
    rows = [("a", 1, 1, "x"), ("a", 2, 2, "y"), ("b", 1, None, "z")]
    f = lambda r: evaluation.fingerprint(spark.createDataFrame(r, "source string, ord int, page int, content string"), ["ord"], ["source", "page"]).first()
    assert f(rows) == f(rows[::-1]) and f(rows).chunks == 3
    assert len({f(r).fingerprint for r in (rows, [("a", 1, 1, "y"), *rows[1:]], [("a", 1, 3, "x"), *rows[1:]], [("a", 2, 1, "x"), ("a", 1, 2, "y"), rows[2]], rows[:2])}) == 5


def test_html_spans():
    assert tables.html_grid("<table><tr><td rowspan='2'>a</td><td>b</td></tr><tr><td>c</td></tr></table>") == [["a", "b"], ["", "c"]]
    assert tables.html_grid("<tr><td colspan='2'>w</td><td>x &amp; y</td></tr>") == [["w", "", "x & y"]]
    assert tables.html_grid(None) == []


def test_rerank_rejects_bad_scores(spark):
    from quarry.operators.retrieval import rerank

    hits = spark.createDataFrame([(1, "a", 1, float("nan"))], "qid int, key string, rank int, s double")
    with pytest.raises(Exception, match="finite"):
        rerank(hits, F.col("s")).collect()
    assert T.WORD


LONG = "这是一份足够长的文本文件内容，用来测试构建与增量更新流程。"


def test_build_scenarios(spark, tmp_path):
    """Cache, fingerprints, only, max_files, failures, layout files and their breaker, interrupted writes."""
    docs, idx = tmp_path / "docs", store.Store(spark, str(tmp_path / "index"))
    docs.mkdir()
    for n in "ab":
        (docs / f"{n}.txt").write_text(LONG + n, encoding="utf-8")
    item = {"type": "text", "text": LONG, "page_idx": 0}
    (docs / "p.json").write_text(json.dumps([item, {"type": "image", "page_idx": 0, "img_path": "data:image/png;base64,cG5n", "image_caption": ["图 一"]}]), encoding="utf-8")
    seen = []

    def parse(source, content):
        (tmp_path / f"seen-{source}").write_text("x")
        return files.read_text(source, content)

    parse.fingerprint = "counted"
    reg = files.Registry({".txt": parse})
    figures = lambda images, prompts: [f"{p}:{len(i)}" for i, p in zip(images, prompts, strict=True)]
    build = lambda **how: pipeline.build(spark, str(docs), idx, registry=reg, describe=figures, **how)
    assert build().processed == ["a.txt", "b.txt", "p.json"]
    assert {(r.source, r.type, r.content[:3]) for r in idx.chunks().collect()} >= {("p.json", "figure", "图一\n")}
    for n in "ab":
        (tmp_path / f"seen-{n}.txt").unlink()
    assert build().processed == ["a.txt", "b.txt", "p.json"] and not list(tmp_path.glob("seen-*"))  # from the cache
    (docs / "a.txt").write_text(LONG + "new a", encoding="utf-8")
    (docs / "b.txt").write_bytes(b"\xff")
    out = build(incremental_=True)
    assert out.processed == ["a.txt"] and list(out.failed) == ["b.txt"]
    assert {r.content for r in idx.chunks().where("source <> 'p.json'").collect()} == {LONG + "new a", LONG + "b"}
    (docs / "b.txt").write_text(LONG + "new b", encoding="utf-8")
    (docs / "c.txt").write_text(LONG + "c", encoding="utf-8")
    assert build(incremental_=True, max_files=1) == pipeline.Outcome()
    assert build(incremental_=True, only=["c.txt", "c.txt"]).processed == ["c.txt"]
    other = pipeline.Chunker(settings=pipeline.SplitSettings(min_chars=5))
    with pytest.raises(ValueError, match="settings"):
        build(incremental_=True, only=["a.txt"], chunker=other)
    assert build(incremental_=True, chunker=other).processed == ["a.txt", "b.txt", "c.txt", "p.json"]  # other settings: a full build
    assert len([n for n in os.listdir(tmp_path / "index") if n.startswith("v")]) == 2
    for n in "xyz":
        (docs / f"{n}.json").write_text("no json")
    with pytest.raises(RuntimeError, match="in a row"):
        build(incremental_=True, chunker=other)
    idx.begin_write()
    with pytest.raises(RuntimeError):
        build(incremental_=True)
    idx.discard()
    assert idx.current() == {} and not seen
    with pytest.raises(ValueError):
        idx.publish(spark.createDataFrame([], "source string"), spark.createDataFrame([], "source string, digest string"), "f")


def test_semantic_build(spark, tmp_path):
    """Blocks cut where their sentences change, headings moved to what follows, in the order of classes."""
    one, two = "甲一句话写得足够长以便保留下来使用。", "乙两句话说的是完全不同的另一件事情，而且它也写得足够长。"
    rows = [("a", 1, one + one + two + "（三）推进应用。", "text", None), ("a", 2, "后面的正文同样要写得足够长才能够保留下来。", "text", None), ("a", 3, "| t |", "table", "table"), ("a", 4, "短", "text", None)]
    df = spark.createDataFrame(rows, "source string, ord int, content string, type string, block_kind string")
    embed = lambda c: F.when(F.contains(c, F.lit("乙")) | F.contains(c, F.lit("（三）")), F.array(F.lit(0.0), F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(0.0)))
    got = pipeline.Chunker(embed, "fake", pipeline.SplitSettings(threshold=60.0, buffer=0)).split(df).orderBy("ord").collect()
    assert [(r.ord, r.type) for r in got] == [(i + 1, "text") for i in range(len(got) - 1)] + [(len(got), "table")]
    assert [r.content.strip() for r in got] == [f"{one} {one}", two, "（三）推进应用。" + rows[1][2], "| t |"]
    assert pipeline.Chunker(embed, "fake").fingerprint != pipeline.Chunker(embed, "other").fingerprint


def test_figures_one_by_one(spark):
    rows = spark.createDataFrame([("a", bytearray(b"1"), "甲"), ("a", bytearray(b"bad"), None), ("a", bytearray(b"22"), None)], "source string, image binary, caption string").repartition(1)

    def describe(images, prompts):
        if any(i == b"bad" for i in images):
            raise ValueError("bad image")
        return [f"说明 {len(i)}" for i in images]

    assert sorted(r.content for r in layout.described(rows, describe).collect()) == ["甲\n说明 1", "说明 2"]


def test_store_parts(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    v = spark.createDataFrame([(1, "a b", [1.0]), (2, "c", [2.0])], "id int, source string, embedding array<double>")
    s.replace_vectors(v)
    s.add_vectors(spark.createDataFrame([(3, "d", [3.0])], v.schema))
    s.delete_sources(["a b", "none"])
    assert sorted(r.id for r in s.vectors().collect()) == [2, 3]
    with pytest.raises(ValueError):
        s.replace_vectors(v.where("false"))
    s.write_report("r", {"a": 1})
    s.write_report("r", {"a": 2})
    (tmp_path / "s" / "bad.json").write_text("{")
    assert s.read_report("r") == {"a": 2} and s.read_report("bad") == {} == s.read_report("none")
    chunks = spark.createDataFrame([("a", 1, "text", "正文", 2, None), ("b", 1, "table", "| x |", None, 7)], "source string, ord int, type string, content string, page int, line_start int")
    for kind in ("json", "jsonl", "csv", "md"):
        store.export(chunks, str(tmp_path / kind), kind)
    read = lambda k: "".join(p.read_text(encoding="utf-8") for p in sorted((tmp_path / k).glob("part-*")))
    assert {json.loads(x)["content"] for x in read("jsonl").splitlines()} == {"正文", "| x |"} and "line_end" not in read("json")
    assert read("csv").splitlines()[0] == "﻿source,page,type,content,line_start"
    assert "## a（1 chunks）" in read("md") and "### [1] 第2页（正文）" in read("md")


def test_bm25_by_hand(spark):
    """Against the formula in Python, by told terms and by an exchange, with repeated and unknown words."""
    import math
    from collections import Counter

    from quarry.operators import retrieval as R

    docs_ = {1: "a b a c", 2: "b c", 3: "", 4: "a a a a d"}
    qs = {1: "a b b", 2: "zz", 3: "d c"}
    d = spark.createDataFrame(list(docs_.items()), "doc_id int, text string")
    q = spark.createDataFrame(list(qs.items()), "qid int, query string")
    tok = {i: t.split() for i, t in docs_.items()}
    avg = sum(map(len, tok.values())) / 4
    want = {}
    for qid, text in qs.items():
        for i, t in tok.items():
            s = 0.0
            for w in text.split():
                df = sum(w in x for x in tok.values())
                tf = Counter(t)[w]
                s += math.log((4 - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / avg)) if tf else 0
            if s:
                want[qid, i] = round(s, 6)
    for most in (10_000, 1):
        R.MOST_TERMS, old = most, R.MOST_TERMS
        try:
            got = {(r.qid, r.id): r.score for r in R.bm25(d, q).collect()}
        finally:
            R.MOST_TERMS = old
        assert got == pytest.approx(want)


def test_alignment_both_ways(spark):
    a = spark.createDataFrame([(1, "能源 规划\n纲要的一段足够长的文字"), (2, "不在其中的一段同样足够长的文字"), (3, "短句"), (4, "")], "qid int, annotation string")
    c = spark.createDataFrame([("前文能源规划纲要的一段足够 长的文字后文",), ("有短句",)], "content string")
    want = evaluation.alignment(a, c).collect()
    assert want == evaluation.alignment(a, c, most=0, gram=6).collect() and want[0].aligned == 2


def test_longest_common():
    import random as rnd

    rng = rnd.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randint(0, 30))) for _ in range(2))
        prev = [0] * (len(b) + 1)
        for x in a:
            row = [0]
            for j, y in enumerate(b):
                row.append(prev[j] + 1 if x == y else max(prev[j + 1], row[-1]))
            prev = row
        assert evaluation.longest_common(a, b) == prev[-1]


def test_strategies_compared(spark):
    from quarry.plans import chunker

    blocks = spark.createDataFrame([("a", 1, "第一段。" * 60, "text", None), ("a", 2, "| t |", "table", "table")], "source string, ord int, content string, type string, block_kind string")
    stats, metrics = evaluation.compared(blocks, {"block": chunker.by_block, "length": lambda b: chunker.by_length(b, 100, 20), "whole": chunker.Chunker().split}, lambda c: c.agg(F.count("*").alias("n")))
    got = {r.strategy: (r.chunks, r.longest) for r in stats.collect()}
    assert got["block"] == (1, 240) and got["whole"][0] == 2 and got["length"][0] > 2 and got["length"][1] <= 100
    assert {r.strategy for r in metrics.collect()} == set(got)
    assert chunking.cut_text("a" * 250, 100, 10) and max(map(len, chunking.cut_text("词，" * 400, 100, 10))) <= 100


def test_dense_deals_rows_and_queries(spark, monkeypatch):
    """Odd vectors, ties and several blocks, against sums in Python; no task meets all rows or all queries."""
    import math
    import random as rnd

    from quarry.operators import retrieval as R

    rng = rnd.Random(3)
    vectors = [[float(rng.randint(-2, 2)) for _ in range(3)] for _ in range(120)]
    for at, odd in ((5, None), (17, [1.0]), (40, [1.0, None, 0.0]), (41, [math.nan] * 3), (90, [1e30, 0.0, 0.0]), (91, [])):
        vectors[at] = odd
    asked = {1: [1.0, 2.0, -1.0], 2: [0.0, 0.1, 0.0], 3: None, 4: [1e25, 1.0, 0.0], 5: [2.0], 6: [0.1234565, 0.0, 0.0], 7: [0.0] * 3}
    want = []
    for qid, v in asked.items():
        found = []
        for i, e in enumerate(vectors):
            if v is None or e is None or len(e) != len(v) or None in e:
                found.append((1, False, 0.0, i, None))
            else:
                s = 0.0
                for x, y in zip(e, v, strict=True):
                    s += x * y
                s = float(R.rounded(R.np.array([s]))[0])
                found.append((0, s == s, 0.0 if s != s else -s, i, s))
        want += [(qid, i, repr(s), k) for k, (*_, i, s) in enumerate(sorted(found, key=lambda x: x[:4])[:9], 1)]
    rows = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    queries = spark.createDataFrame(list(asked.items()), "qid int, v array<double>")
    for name, to in (("QUERY_BLOCK", 2), ("LEAST_ROWS", 20), ("TILE", 8), ("PAIRS", 50)):
        monkeypatch.setattr(R, name, to)
    got = R.dense(rows, queries, k=9)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "Cartesian" not in plan
    assert sorted((r.qid, r.id, repr(None if r.score is None else r.score + 0.0), r["rank"]) for r in got.collect()) == sorted((q, i, s.replace("-0.0", "0.0") if s == "-0.0" else s, k) for q, i, s, k in want)


ODD_DOCUMENTS = [(1, "a b a c"), (2, "b c"), (3, None), (5, "a b a c"), (5, "a b a c"), (4, "a b a c"), (6, "d, D e-f"), (None, "a a a a d"), (7, "x"), (7, "x"), (8, "")]


def odd_db():
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", ODD_DOCUMENTS)
    return c


@pytest.mark.parametrize("most", [{}, {"MOST_TERMS": 1}, {"MOST_REPEATED": 0}, {"LOOKED_UP": 2, "SCORES": 1}])
def test_bm25_of_odd_rows_agrees_with_sql(spark, monkeypatch, most):
    """Chunks that share an id count as one; a chunk without an id comes last among ties. Scores are made inside the rows where the terms can be told."""
    from quarry.operators import retrieval as R

    for name, to in most.items():
        monkeypatch.setattr(R, name, to)
    questions = [(1, "a b b"), (2, "zz"), (3, "d c"), (4, "x"), (5, "")]
    c = odd_db()
    c.execute("CREATE TABLE questions (qid INT, query VARCHAR)")
    c.executemany("INSERT INTO questions VALUES (?, ?)", questions)
    want = sorted(c.execute(f"WITH {catalog.BM25} SELECT qid, id, score, rank FROM sparse").fetchall(), key=repr)
    got = R.bm25(spark.createDataFrame(ODD_DOCUMENTS, "doc_id long, text string"), spark.createDataFrame(questions, "qid int, query string"))
    assert ("MapInArrow" in got._jdf.queryExecution().executedPlan().toString()) == (not {"MOST_TERMS", "MOST_REPEATED"} & set(most))
    assert sorted((tuple(map(plain, r)) for r in got.select("qid", "id", "score", "rank").collect()), key=repr) == [tuple(map(plain, r)) for r in want]


def test_hybrid_of_odd_rows_agrees_with_sql(spark, tmp_path):
    """Chunks that share an id, and null and equal texts, in both branches and their fusion."""
    import random as rnd

    rng, c = rnd.Random(5), odd_db()
    c.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO benchmark VALUES (?, ?)", [(1, "a b b"), (2, "x a"), (4, None), (8, "c d"), (99, "x")])
    c.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    c.executemany("INSERT INTO embeddings VALUES (?, ?)", [(i, [float(rng.randint(-1, 1)) for _ in range(3)]) for i in range(60)])
    for name in ("documents", "benchmark", "embeddings"):
        c.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet'")
    q = c.execute(catalog.SQL["api1_hybrid_retrieve"])
    cols = [x[0] for x in q.description]
    want = sorted((tuple(map(plain, r)) for r in q.fetchall()), key=repr)
    df = catalog.QUERIES["api1_hybrid_retrieve"](spark, str(tmp_path))
    assert "MapInArrow" in df._jdf.queryExecution().executedPlan().toString()
    assert sorted((tuple(map(plain, r)) for r in df.select(*cols).collect()), key=repr) == want


@pytest.mark.parametrize("name", ["agg3_document_frequency", "mth1_idf"])
@pytest.mark.parametrize("most", [100_000, 0])
def test_frequencies_of_odd_rows_agree_with_sql(spark, monkeypatch, tmp_path, name, most):
    """Chunks that share an id count once; the exchange has terms, not chunks."""
    from quarry.operators import retrieval as R

    monkeypatch.setattr(R, "MOST_REPEATED", most)
    c = odd_db()
    c.execute("INSERT INTO documents VALUES (NULL, 'y a'), (NULL, 'z'), (5, 'other a')")
    c.execute(f"COPY documents TO '{tmp_path}/documents.parquet'")
    got = {tuple(map(plain, r)) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()}
    assert got == {tuple(map(plain, r)) for r in c.execute(catalog.SQL[name]).fetchall()}
    plan = R.document_frequencies(spark.createDataFrame([(1, "a b")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


@pytest.mark.parametrize("most", [100_000, 0])
def test_postings_of_odd_rows_agree_with_sql(spark, monkeypatch, tmp_path, most):
    """Chunks that share id and text count as one, others of the id apart; where ids differ, nothing is exchanged but the count of ids."""
    from quarry.operators import retrieval as R

    monkeypatch.setattr(R, "MOST_REPEATED", most)
    c = odd_db()
    c.execute("INSERT INTO documents VALUES (NULL, 'y a'), (NULL, 'y a'), (5, 'a q'), (5, 'a r'), (9, 'Z z-1 z 1')")
    c.execute(f"COPY documents TO '{tmp_path}/documents.parquet'")
    q = c.execute(catalog.SQL["agg1_term_frequency"])
    cols = [x[0] for x in q.description]
    got = catalog.QUERIES["agg1_term_frequency"](spark, str(tmp_path)).select(*cols).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(q.fetchall(), key=repr)
    alone = spark.createDataFrame([(1, "b a b"), (2, ""), (3, None), (4, "c")], "doc_id long, text string")
    post = R.postings(alone)
    assert sorted(map(tuple, post.collect())) == [(1, "a", 3, 1), (1, "b", 3, 2), (4, "c", 1, 1)]
    assert "Exchange" not in post._jdf.queryExecution().executedPlan().toString()


def test_counted(spark):
    from quarry.operators import retrieval as R

    rows = spark.createDataFrame([(1, ["b", None, "a", "b", None]), (2, []), (3, None), (4, ["x"] * 3)], "k int, t array<string>")
    got = {r.k: r.n and [(x.term, x.tf) for x in r.n] for r in rows.select("k", R.counted(F.col("t")).alias("n")).collect()}
    assert got == {1: [(None, 2), ("a", 1), ("b", 2)], 2: [], 3: [], 4: [("x", 3)]}
