"""XLSX cells and merged areas as tables; regions and chunks are made of them by operators.tables."""

from __future__ import annotations

import datetime
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import tables

M = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
CELLS = "source string, sheet string, sheet_state string, row int, col int, value string, vtype string, formula string, cached string, to_row int, to_col int, error string"


def place(ref: str) -> tuple[int, int]:
    letters, digits = re.fullmatch(r"\$?([A-Za-z]+)\$?(\d+)", ref).groups()
    col = 0
    for c in letters.upper():
        col = col * 26 + ord(c) - 64
    return int(digits), col


def _date(serial: float, fmt: str) -> str:
    when = datetime.datetime(1899, 12, 30) + datetime.timedelta(days=serial)
    if not re.search("[yd]", fmt, re.I):
        return when.time().isoformat()
    return when.isoformat()


def read_cells(source: str, content: bytes, max_cells: int = 5_000_000) -> list[dict]:
    """Rows of CELLS: each cell, and each merged area as a row with to_row and to_col."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        load = lambda n: ElementTree.fromstring(z.read(n))
        strings = ["".join(t.text or "" for t in si.iter(M + "t")) for si in load("xl/sharedStrings.xml").findall(M + "si")] if "xl/sharedStrings.xml" in names else []
        formats: list[str] = []
        if "xl/styles.xml" in names:
            styles = load("xl/styles.xml")
            own = {int(f.get("numFmtId")): f.get("formatCode") for f in styles.iter(M + "numFmt")}
            for xf in (styles.find(M + "cellXfs") if styles.find(M + "cellXfs") is not None else ()):
                k = int(xf.get("numFmtId") or 0)
                code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", own.get(k, ""))
                formats.append("yyyy-mm-dd" if 14 <= k <= 17 or k == 22 else "h:mm" if 18 <= k <= 21 or 45 <= k <= 47 else code if re.search("[ymdhs]", code, re.I) else "")
        targets = {r.get("Id"): r.get("Target") for r in load("xl/_rels/workbook.xml.rels")}
        for sheet in load("xl/workbook.xml").iter(M + "sheet"):
            target = targets[sheet.get(R + "id")]
            data = load(target.lstrip("/") if target.startswith("/") else f"xl/{target}")
            head = {"source": source, "sheet": sheet.get("name"), "sheet_state": sheet.get("state") or "visible"}
            high = wide = 0
            for c in data.iter(M + "c"):
                row, col = place(c.get("r"))
                high, wide = max(high, row), max(wide, col)
                kind, v, f = c.get("t") or "n", c.findtext(M + "v"), c.find(M + "f")
                shown = "".join(t.text or "" for t in c.iter(M + "t")) if kind == "inlineStr" else strings[int(v)] if kind == "s" and v is not None else v
                if kind == "b" and v is not None:
                    shown = "TRUE" if v == "1" else "FALSE"
                elif kind == "n" and v is not None and int(c.get("s") or 0) < len(formats) and formats[int(c.get("s") or 0)]:
                    shown = _date(float(v), formats[int(c.get("s") or 0)])
                if f is not None:
                    out.append(head | {"row": row, "col": col, "vtype": "formula", "formula": "=" + f.text if f.text else None, "cached": shown})
                elif shown is not None:
                    out.append(head | {"row": row, "col": col, "value": shown, "vtype": "boolean" if kind == "b" else "string"})
            if high * wide > max_cells:
                raise ValueError(f"sheet {sheet.get('name')} spans more than {max_cells} cells")
            for area in data.iter(M + "mergeCell"):
                a, _, b = area.get("ref").partition(":")
                (r0, c0), (r1, c1) = place(a), place(b or a)
                out.append(head | {"row": r0, "col": c0, "vtype": "area", "to_row": r1, "to_col": c1})
    if not any(x["vtype"] != "area" for x in out):
        raise ValueError("the workbook holds no data")
    return out


def cells(files: DataFrame) -> DataFrame:
    def run(batches: Iterator):
        import pyarrow as pa

        kinds = {"int": pa.int32(), "string": pa.string()}
        schema = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in CELLS.split(", "))])
        for batch in batches:
            out = []
            for source, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    out += read_cells(source, bytes(content or b""))
                except Exception as e:  # noqa: BLE001 - told in the file's row
                    out.append({"source": source, "error": f"{type(e).__name__}: {e}"})
            yield pa.RecordBatch.from_pylist([dict.fromkeys(schema.names) | x for x in out], schema=schema)

    return files.select("source", "content").mapInArrow(run, CELLS)


def workbook_chunks(files: DataFrame, header_rows: int = 1, rows_per_chunk: int = 50) -> DataFrame:
    """Table chunks of all sheets, hidden ones too; a file that fails gives its error row."""
    found = cells(files)
    good = found.where("error is null").withColumn("sheet", F.concat_ws("\x1f", "source", "sheet_state", "sheet"))
    areas = good.where("vtype = 'area'").select("sheet", F.col("row").alias("min_row"), F.col("col").alias("min_col"), F.col("to_row").alias("max_row"), F.col("to_col").alias("max_col"))
    chunks = tables.sheet_chunks(tables.expand_merges(good.where("vtype <> 'area'"), areas), header_rows, rows_per_chunk)
    part = F.split("sheet", "\x1f")
    chunks = chunks.select(part[0].alias("source"), F.lit("table").alias("type"), part[2].alias("sheet_name"), part[1].alias("sheet_state"), "row_start", "row_end", "column_start", "column_end", "header_row_start", "header_row_end", F.regexp_replace("content", "^工作表：[^\x1f]*\x1f[^\x1f]*\x1f", "工作表：").alias("content"))
    return chunks.unionByName(found.where("error is not null").select("source", "error"), allowMissingColumns=True)
