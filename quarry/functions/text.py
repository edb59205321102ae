"""Text functions as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as a meaningful character, sentence ends, section markers, labels.
MEANINGFUL = "[一-鿿A-Za-z0-9]"
SENTENCE_END = "(?<=[。！？；;.!?])"
MARKERS = ("【长期记忆】", "【历史对话】", "【文档片段】", "【问题】", "【回答】")
TYPE_LABELS = {"table": "表格", "figure": "图表", "text": "正文"}
ROLE_LABELS = {"user": "用户", "assistant": "助手"}
#: Numbering of headings, by level.
HEADINGS = (
    (1, "^第[一二三四五六七八九十百]+[章节篇]"),
    (1, "^[一二三四五六七八九十]+、"),
    (2, "^（[一二三四五六七八九十]+）"),
    (3, r"^\d+(?:\.\d+)*[、．]\s*\S"),
    (3, r"^\d+(?:\.\d+)*\.\s+\S"),
)
HEADING_CHARS = 40
WORD = "[一-鿿]|[0-9A-Za-zÀ-ɏͰ-ӿ]+"


def strip(c: Column) -> Column:
    """Without white space at either end, as Unicode sees it."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def meaningful_len(c: Column) -> Column:
    return F.regexp_count(c, F.lit(MEANINGFUL))


def sentences(c: Column) -> Column:
    """The text cut after each sentence end; a text that ends with one leaves an empty last part."""
    return F.split(c, SENTENCE_END, -1)


def tokens(c: Column) -> Column:
    """Lower-case words and single Chinese characters; the default where no segmenter is given."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"({WORD})"))


def heading_level(c: Column) -> Column:
    text = strip(F.coalesce(c, F.lit("")))
    out = F.when((text == "") | (F.length(text) > HEADING_CHARS), F.lit(None).cast("int"))
    for level, pattern in HEADINGS:
        out = out.when(text.rlike(pattern), F.lit(level))
    return out


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape_cell(c: Column) -> Column:
    """Safe in a cell of a pipe table."""
    c = escape_html(c)
    for a, b in (("\\", "\\\\"), ("|", "\\|"), ("\r\n", "\n"), ("\n", "<br>")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def defuse(c: Column) -> Column:
    """Section markers get half-width brackets."""
    return reduce(lambda x, m: F.replace(x, F.lit(m), F.lit("[" + m[1:-1] + "]")), MARKERS, c)


def memory_section(c: Column, max_chars: int) -> Column:
    body = defuse(strip(F.coalesce(c, F.lit(""))))
    cut = F.concat(F.substring(body, 1, max_chars), F.lit(f"\n（长期记忆超过 {max_chars} 字上限，后续内容未注入）"))
    return F.when(body == "", F.lit("")).otherwise(F.concat(F.lit("【长期记忆】\n"), F.when(F.length(body) > max_chars, cut).otherwise(body), F.lit("\n\n")))


def type_label(c: Column) -> Column:
    return reduce(lambda w, kv: w.when(c == kv[0], F.lit(kv[1])), list(TYPE_LABELS.items())[1:], F.when(c == "table", F.lit("表格"))).otherwise(F.lit("正文"))


def _range(a: str, b: str, before: str, after: str) -> Column:
    return F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.concat(F.lit(before), F.col(a), F.lit("—"), F.col(b), F.lit(after)))


def _filled(c: str) -> Column:
    return F.col(c).isNotNull() & (F.col(c) != "")


def source_label() -> Column:
    """Where a chunk comes from, of the chunk's columns; parts that are missing are left out."""
    page = F.col("page").cast("string")
    first = F.when(page.isNotNull() & ~page.isin("", "0", "?"), F.concat(F.coalesce("source", F.lit("?")), F.lit(" 第"), page, F.lit("页"))).otherwise(F.coalesce("source", F.lit("?")))
    sheet = F.when(
        _filled("sheet_name"),
        F.concat(F.lit("工作表: "), "sheet_name", F.lit(" | 第"), "row_start", F.lit("—"), "row_end", F.lit("行 | "), "column_start", F.lit("—"), "column_end", F.lit("列"), F.coalesce(_range("header_row_start", "header_row_end", " | 表头: 第", "行"), F.lit(""))),
    )
    return F.concat_ws(
        " | ", first, F.when(_filled("caption"), F.col("caption")), F.when(_filled("heading_path"), F.concat(F.lit("标题: "), "heading_path")),
        _range("line_start", "line_end", "所属原文块: 第", "行"), _range("paragraph_start", "paragraph_end", "所属原文段落: 第", "段"),
        F.when(F.col("table_index").isNotNull(), F.concat(F.lit("第"), "table_index", F.lit("个表格"))), sheet,
    )


def escape_lines(c: Column) -> Column:
    """Lines that look like headings or escapes get a backslash; line ends become \\n."""
    return F.regexp_replace(F.regexp_replace(c, "\r\n?", "\n"), r"(?m)^( *)(?=[\\#])", r"$1\\")


def unescape_lines(c: Column) -> Column:
    return F.regexp_replace(c, r"(?m)^( *)\\(?=[\\#])", "$1")


def one_line(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)[\s\x1c-\x1f]+", " "))


def sanitize_label(c: Column) -> Column:
    return F.replace(one_line(c), F.lit("`"), F.lit("'"))


def strip_layout(c: Column) -> Column:
    return F.translate(c, "\n ", "")


def ngrams(c: Column, n: int = 3) -> Column:
    """Distinct runs of n characters, layout removed."""
    s = strip_layout(c)
    return F.when(F.length(s) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(s) - n + 1), lambda i: F.substring(s, i, n)))).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 0 where either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def relevant(text: Column, annotations: Column, threshold: float = 0.6) -> Column:
    """Whether a text holds, lies in, or is much like one of the annotations."""
    t = strip_layout(text)

    def one(a: Column) -> Column:
        s = strip_layout(a)
        return F.contains(s, t) | F.contains(t, s) | (jaccard(ngrams(text), ngrams(a)) >= threshold)

    return F.exists(annotations, one)


def normalize_caption(c: Column) -> Column:
    c = strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)(?<=[一-鿿])\s+(?=[一-鿿])", ""))
    return strip(F.regexp_replace(c, r"^\*+|\*+$", ""))


def figure_prompt(prompt: Column, caption: Column) -> Column:
    return F.when(F.coalesce(caption, F.lit("")) == "", prompt).otherwise(F.concat(F.lit("这张图的标题是「"), caption, F.lit("」。\n"), prompt))


def trailing_heading(c: Column) -> Column:
    """struct(heading, rest): the text after its second-to-last sentence end, if that is a heading; else ('', text).

    A text with fewer than two ends stays whole. A tail without an end counts with the last full sentence.
    """
    parts = sentences(c)
    n = F.size(parts) - 1  # sentence ends
    tail = strip(F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), ""))
    rest = F.regexp_replace(F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 2, F.lit(0))), ""), r"(?U)\s+$", "")
    ok = (n >= 2) & heading_level(tail).isNotNull()
    return F.struct(F.when(ok, tail).otherwise(F.lit("")).alias("heading"), F.when(ok, rest).otherwise(c).alias("rest"))


def duration(seconds: Column) -> Column:
    s = F.greatest(seconds.cast("long"), F.lit(0))
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%02d:%02d", m, r))


def column_letters(n: Column) -> Column:
    """1 to A, 27 to AA, up to three letters."""
    letter = lambda k: F.chr((F.lit(65) + k).cast("long"))
    m = n - 1
    one, two = letter(m % 26), letter((F.floor(m / 26) - 1) % 26)
    three = letter(F.floor((F.floor(m / 26) - 1) / 26) - 1)
    return F.when(n <= 26, one).when(n <= 702, F.concat(two, one)).otherwise(F.concat(three, two, one))


def accept_rewrite(candidate: Column, query: Column, most: int = 200) -> Column:
    """The candidate without quotes, or the query where it is empty, too long, of several lines or has section brackets."""
    text = F.regexp_replace(strip(F.coalesce(candidate, F.lit(""))), "^[「」『』\"'“”]+|[「」『』\"'“”]+$", "")
    return F.when((text == "") | F.contains(text, F.lit("\n")) | (F.length(text) > most) | F.contains(text, F.lit("【")) | F.contains(text, F.lit("】")), query).otherwise(text)


def char_set(c: Column) -> Column:
    return F.filter(F.array_distinct(F.split(c, "")), lambda x: x != "")


def json_safe(c: Column) -> Column:
    """A double as JSON can hold it: null where it is not finite."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(None)).otherwise(c)


def sse_frame(name: Column, payload: Column) -> Column:
    """An event frame: one data line for each line of the payload."""
    lines = F.transform(F.split(F.replace(payload, F.lit("\r"), F.lit("\\r")), "\n"), lambda x: F.concat(F.lit("data: "), x, F.lit("\n")))
    return F.concat(F.lit("event: "), name, F.lit("\n"), F.array_join(lines, ""), F.lit("\n"))


def sse_decode(frame: Column) -> Column:
    """struct(event, data) of a frame; comment lines are skipped and data lines joined."""
    lines = F.filter(F.split(frame, "\n"), lambda x: ~F.startswith(x, F.lit(":")))
    event = F.element_at(F.concat(F.transform(F.filter(lines, lambda x: F.startswith(x, F.lit("event:"))), lambda x: F.trim(F.substring(x, 7, 1 << 30))), F.array(F.lit("message"))), 1)
    data = F.array_join(F.transform(F.filter(lines, lambda x: F.startswith(x, F.lit("data:"))), lambda x: F.regexp_replace(F.substring(x, 6, 1 << 30), "^ ", "")), "\n")
    return F.struct(event.alias("event"), data.alias("data"))


def location_label() -> Column:
    """Where a chunk lies, without its file's name; parts that are missing are left out."""
    page = F.col("page").cast("string")
    sheet = _filled("sheet_name")
    return F.concat_ws(
        " | ", F.when(page.isNotNull() & ~page.isin("", "0", "?"), F.concat(F.lit("第"), page, F.lit("页"))), F.when(_filled("heading_path"), F.concat(F.lit("标题: "), "heading_path")),
        _range("line_start", "line_end", "所属原文块: 第", "行"), _range("paragraph_start", "paragraph_end", "所属原文段落: 第", "段"), F.when(F.col("table_index").isNotNull(), F.concat(F.lit("第"), "table_index", F.lit("个表格"))),
        F.when(sheet, F.concat(F.lit("工作表: "), "sheet_name")), F.when(sheet, _range("row_start", "row_end", "第", "行")), F.when(sheet, _range("column_start", "column_end", "", "列")), F.when(sheet, _range("header_row_start", "header_row_end", "表头: 第", "行")),
    )


def committed_length(c: Column) -> Column:
    """Characters up to and with the last blank line outside a code fence: what of a text that still grows will not change."""
    lines = F.split(c, "\n")
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("safe"), F.lit(False).alias("fence"))

    def step(s: Column, line: Column) -> Column:
        fence = s["fence"] != line.rlike("^\\s*(```|~~~)")
        end = s["at"] + F.length(line) + 1
        return F.struct(end.cast("int").alias("at"), F.when(~fence & (F.trim(line) == "") & (end <= F.length(c)), end).otherwise(s["safe"]).cast("int").alias("safe"), fence.alias("fence"))

    return F.aggregate(lines, start, step, lambda s: s["safe"])


def score_format(s: Column) -> Column:
    """A score with as many decimals as its size needs."""
    return F.when(s.isNull(), "-").when(s >= 10, F.format_string("%.1f", s)).when(s >= 0.1, F.format_string("%.3f", s)).otherwise(F.format_string("%.4f", s))


def recency(days: Column) -> Column:
    return F.when(days == 0, "today").when(days <= 7, "week").otherwise("older")


def shown_time(ms: Column) -> Column:
    return F.when(F.coalesce(ms, F.lit(0)) == 0, F.lit("")).otherwise(F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd HH:mm:ss"))


def time_shown(text: Column) -> Column:
    """Milliseconds of a shown time; null where it is none."""
    return F.unix_millis(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")))


def remaining_seconds(elapsed: Column, done: Column, total: Column) -> Column:
    """What is left at the pace so far; null before anything is done."""
    return F.when(done > 0, elapsed / done * (total - done))


#: The stages of an answer.
STAGES = ("rewrite", "retrieval", "rerank", "context", "generation")


def timings(given: Column) -> Column:
    """array<struct<stage, seconds>> of a map; stages that it lacks have null."""
    return F.transform(F.array(*map(F.lit, STAGES)), lambda s: F.struct(s.alias("stage"), F.element_at(given, s).alias("seconds")))
