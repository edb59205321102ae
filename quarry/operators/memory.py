"""Conversations: session text, history and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions import text as T

#: How session files are named and laid out.
SESSION_ID = r"^[0-9]{8}-[0-9]{6}-[0-9a-z]{6}\z"
BOUNDARY = r"^ {0,3}##[ \t]*(用户|助手)[ \t]*#*[ \t]*$"
SOURCES = r"^ {0,3}###[ \t]*参考来源[ \t]*#*[ \t]*$"


def role_label(c: Column) -> Column:
    return F.when(c == "assistant", F.lit("助手")).otherwise(F.lit("用户"))


def history(turns: DataFrame, max_turns: int, max_chars: int, heading: bool = True) -> DataFrame:
    """(conv_id, history): the last max_turns turns, the oldest dropped until their length fits. Conversations without any left give none."""
    last = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    rows = turns.withColumn("k", F.row_number().over(last)).where(F.col("k") <= max_turns)
    rows = rows.withColumn("line", F.concat(role_label(F.col("role")), F.lit("："), T.defuse(T.strip(F.coalesce("text", F.lit(""))))))
    rows = rows.withColumn("total", F.sum(F.length("line")).over(last.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("total") <= max_chars)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n")
    return rows.groupBy("conv_id").agg((F.concat(F.lit("【历史对话】\n"), text, F.lit("\n\n")) if heading else text).alias("history"))


def render(turns: DataFrame, title: Column, time_zone_time: Column | None = None) -> DataFrame:
    """(conv_id, markdown): a session file of (conv_id, turn, role, text, sources)."""
    listed = F.transform("sources", lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), T.sanitize_label(s)))
    tail = F.when((F.col("role") == "assistant") & (F.size("sources") > 0), F.concat(F.array(F.lit("### 参考来源"), F.lit("")), listed, F.array(F.lit("")))).otherwise(F.array().cast("array<string>"))
    block = F.concat(F.array(F.concat(F.lit("## "), role_label(F.col("role"))), F.lit(""), T.escape_lines(F.coalesce("text", F.lit(""))), F.lit("")), tail)
    rows = turns.withColumn("sources", F.coalesce("sources", F.array().cast("array<string>"))).withColumn("block", block)
    name = T.one_line(title)
    head = F.concat(F.array(F.concat(F.lit("# "), F.when(name == "", F.lit("新对话")).otherwise(name)), F.lit("")), F.array(F.concat(F.lit("- 创建时间："), time_zone_time), F.lit("")) if time_zone_time is not None else F.array().cast("array<string>"))
    body = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("turn", "block"))), lambda x: x["block"]))
    return rows.groupBy("conv_id").agg(F.array_join(F.concat(head, body), "\n").alias("markdown"))


def parse(sessions: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of session files (conv_id, markdown): a message runs from its boundary line to the next; source lists go."""
    lines = sessions.select("conv_id", F.posexplode(F.split(F.regexp_replace("markdown", "\r\n?", "\n"), "\n")).alias("n", "line"))
    w = Window.partitionBy("conv_id").orderBy("n")
    lines = lines.withColumn("label", F.when(F.col("line").rlike(BOUNDARY), F.regexp_extract("line", BOUNDARY, 1)))
    lines = lines.withColumn("turn", F.count("label").over(w)).where("turn > 0")
    inside = Window.partitionBy("conv_id", "turn").orderBy("n")
    lines = lines.withColumn("listed", F.max(F.when(F.col("line").rlike(SOURCES), 1).otherwise(0)).over(inside))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("label").isNull() & (F.col("listed") == 0), F.struct("n", "line")))), lambda x: x["line"]), "\n")
    rows = lines.groupBy("conv_id", "turn").agg(F.max("label").alias("label"), text.alias("text"))
    return rows.select("conv_id", F.col("turn").cast("int").alias("turn"), F.when(F.col("label") == "助手", F.lit("assistant")).otherwise(F.lit("user")).alias("role"), T.unescape_lines(F.regexp_replace("text", r"^\n+|\n+\z", "")).alias("text"))


def summaries(turns: DataFrame, limit: int | None = None) -> DataFrame:
    """(conv_id, messages, last, total): newest first; total counts all conversations before any limit."""
    rows = turns.groupBy("conv_id").agg(F.count("*").alias("messages"), F.max("turn").alias("last"))
    rows = rows.crossJoin(F.broadcast(rows.agg(F.count("*").alias("total"))))  # one row
    rows = rows.orderBy(F.desc("last"), "conv_id")
    return rows.limit(limit) if limit else rows
