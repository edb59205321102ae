"""DOCX bodies as blocks, read from the package's XML."""

from __future__ import annotations

import io
import re
import zipfile
from html import escape
from xml.etree import ElementTree

from quarry.sources.files import block

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
MAX_HEADING = 40


def text_of(p) -> str:
    """All text of a paragraph with insertions, without deletions."""
    if p.tag == W + "del":
        return ""
    if p.tag == W + "t":
        return p.text or ""
    return "".join(map(text_of, p))


def content_of(body) -> list:
    """Paragraphs and tables in order, through content controls."""
    out = []
    for x in body:
        if x.tag in (W + "p", W + "tbl"):
            out.append(x)
        elif x.tag == W + "sdt" and (inner := x.find(W + "sdtContent")) is not None:
            out += content_of(inner)
    return out


def _number(x, path: str, key: str = "val") -> int | None:
    found = x.find(path, {"w": W[1:-1]})
    return int(found.get(W + key)) if found is not None and (found.get(W + key) or "").lstrip("-").isdigit() else None


def heading_level(p, styles: dict) -> int | None:
    """By outline level, else through the style and those it is based on."""
    outline = _number(p, "w:pPr/w:outlineLvl")
    ref = p.find("w:pPr/w:pStyle", {"w": W[1:-1]})
    name, seen = ref.get(W + "val") if ref is not None else None, set()
    while outline is None and name in styles and name not in seen:
        seen.add(name)
        style = styles[name]
        outline = style["outline"]
        if outline is None:
            if style["name"].lower() == "title" or style["name"] == "标题":
                return 0
            if m := re.fullmatch(r"(?:heading|标题)\s*([1-9])", style["name"], re.I):
                return int(m[1])
            name = style["base"]
    return outline + 1 if outline is not None and 0 <= outline <= 8 else None


def cell_text(tc) -> str:
    parts = [table_text(x) if x.tag == W + "tbl" else text_of(x) for x in content_of(tc)]
    return "\n".join(p for p in parts if p.strip())


def table_text(tbl) -> str:
    """A pipe table under numbered headers; cells that span are repeated, as the grid shows them."""
    rows: list[list[str]] = []
    above: dict[int, str] = {}
    for tr in tbl.findall(W + "tr"):
        line = [""] * (_number(tr, "w:trPr/w:gridBefore") or 0)
        for tc in tr.findall(W + "tc"):
            merge = tc.find("w:tcPr/w:vMerge", {"w": W[1:-1]})
            at = len(line)
            if merge is not None and merge.get(W + "val") in (None, "continue"):
                shown = above.get(at, "")
            else:
                shown = escape(cell_text(tc).strip()).replace("\\", "\\\\").replace("|", "\\|").replace("\n", "<br>")
            for k in range(_number(tc, "w:tcPr/w:gridSpan") or 1):
                above[at + k] = shown
                line.append(shown)
        rows.append(line + [""] * (_number(tr, "w:trPr/w:gridAfter") or 0))
    if not any(any(r) for r in rows):
        return ""
    wide = max(map(len, rows))
    head = [[f"第{i}列" for i in range(1, wide + 1)], ["---"] * wide]
    return "\n".join("| " + " | ".join(r + [""] * (wide - len(r))) + " |" for r in head + rows)


def read_word(source: str, content: bytes) -> list[dict]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(W + "body")
        styles = {}
        if "word/styles.xml" in z.namelist():
            for s in ElementTree.fromstring(z.read("word/styles.xml")).findall(W + "style"):
                get = lambda tag, s=s: (x.get(W + "val") if (x := s.find(W + tag)) is not None else None)
                styles[s.get(W + "styleId")] = {"name": get("name") or "", "base": get("basedOn"), "outline": _number(s, "w:pPr/w:outlineLvl")}
    out: list[dict] = []
    path: list[tuple[int, str]] = []
    open_: list[tuple[int, int, str]] = []
    n_paragraph = n_table = 0

    def flush() -> None:
        if open_:
            out.append(block(source, len(out), content="\n\n".join(t for _, _, t in open_), type="text", block_kind="section", heading_path=" > ".join(t for _, t in path), block_index=open_[0][0], paragraph_start=open_[0][1], paragraph_end=open_[-1][1]))
            open_.clear()

    for index, x in enumerate(content_of(body), 1):
        if x.tag == W + "tbl":
            flush()
            n_table += 1
            if shown := table_text(x):
                out.append(block(source, len(out), content=shown, type="table", block_kind="table", heading_path=" > ".join(t for _, t in path), block_index=index, table_index=n_table))
            continue
        n_paragraph += 1
        text = text_of(x)
        if not text.strip():
            continue
        level = heading_level(x, styles)
        if level is not None and len(text.strip()) <= MAX_HEADING and "。" not in text:
            flush()
            path = [*[p for p in path if p[0] < level], (level, text.strip())]
        open_.append((index, n_paragraph, text))
    flush()
    return out
