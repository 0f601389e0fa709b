"""Readers for the file formats of a dataset upload, each a DataFrame with provenance columns."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from functools import reduce
from io import BytesIO
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import chunks
from .pdf import read_pdf

FORMATS = ("csv", "json", "jsonl", "parquet", "xlsx", "pdf", "docx")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header row, every column a string, quoted newlines; of repeated headers the last column stays. Values beyond the header are lost."""
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')
    # the header as it stands, quotes, commas and line ends within them included: Spark renames repeated names
    head = spark.read.csv(path, header=False, inferSchema=False, multiLine=True, escape='"').first()
    names = [(h or "").lstrip("\ufeff") for h in head] if head else []
    if len(names) != len(df.columns):
        return df
    last = {n: i for i, n in enumerate(names)}
    renamed = df.toDF(*[f"_{i}" for i in range(len(names))])
    return renamed.select(*[F.col(f"_{i}").alias(n) for n, i in sorted(last.items(), key=lambda x: x[1])])


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """An array of objects, an object that holds a list under rows, data or examples (the first of these that is a list), or a single object. What
    is no object in such a list is left out; a file that is neither is an error."""
    df = spark.read.json(path, multiLine=True, mode="FAILFAST")
    for name in ("rows", "data", "examples"):
        if name in df.columns and df.schema[name].dataType.typeName() == "array":
            inner = df.schema[name].dataType.elementType
            return df.select(F.inline(F.filter(name, lambda x: x.isNotNull()))) if inner.typeName() == "struct" else spark.createDataFrame([], "text string").limit(0)
    return df


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One object a line, blank lines skipped; any other line is an error."""
    return spark.read.json(path, mode="FAILFAST")


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]*", ref)[0]:
        n = 26 * n + ord(ch) - 64
    return n - 1


def workbook_rows(content: bytes, sheet: str | None = None) -> tuple[list[str], list[list[str]]]:
    """(header, rows) of a sheet, the first unless named: the header is the first row with a value, blank rows are dropped, short
    ones padded with empty strings."""
    with zipfile.ZipFile(BytesIO(content)) as z:
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = {s.get("name"): targets[s.get(_REL)] for s in book.iterfind("m:sheets/m:sheet", _NS)}
        name = sheet or next(iter(sheets))
        if name not in sheets:
            raise ValueError(f"no sheet {name!r}; there are {', '.join(sheets)}")
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        target = sheets[name].lstrip("/")
        tree = ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
    table = []
    for row in tree.iterfind("m:sheetData/m:row", _NS):
        cells: dict[int, str] = {}
        for i, c in enumerate(row.iterfind("m:c", _NS)):
            kind, value = c.get("t"), c.find("m:v", _NS)
            text = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t")) if kind == "inlineStr" else (value.text or "" if value is not None else "")
            cells[_column(c.get("r")) if c.get("r") else i] = shared[int(text)] if kind == "s" and text else text
        values = [cells.get(i, "") for i in range(max(cells, default=-1) + 1)]
        if any(v.strip() for v in values):
            table.append(values)
    if not table:
        return [], []
    header = [h.strip() for h in table[0]]
    return header, [(r + [""] * len(header))[: len(header)] for r in table[1:]]


def read_xlsx(spark: SparkSession, path: str, sheet: str | None = None, required: tuple[str, ...] = ()) -> DataFrame:
    """One row per sheet row, all strings; one task per workbook. The header of the first workbook names the columns; ``required`` ones that it
    lacks are an error."""
    books = spark.read.format("binaryFile").load(path)
    header = workbook_rows(bytes(books.select("content").first()[0]), sheet)[0]
    if lacking := [c for c in required if c not in header]:
        raise ValueError(f"columns missing: {', '.join(lacking)}")

    def run(it: Iterator) -> Iterator:
        import pandas as pd

        for b in it:
            for content in b["content"]:
                own, rows = workbook_rows(bytes(content), sheet)
                yield pd.DataFrame(rows, columns=own).reindex(columns=header, fill_value="")

    return books.select("content").mapInPandas(run, ", ".join(f"`{h}` string" for h in header))


def read_pdf_literals(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): the literal strings shown by ``Tj`` operators of each PDF, blank ones dropped, joined by newlines."""
    shown = F.regexp_extract_all(F.decode("content", "ISO-8859-1"), F.lit(r"\(([^()]*)\)\s*Tj"), F.lit(1))
    return spark.read.format("binaryFile").load(path).select("path", F.array_join(F.filter(shown, lambda x: F.trim(x) != ""), "\n").alias("text"))


def docx_text(content: bytes) -> str:
    """Paragraphs, then tables with cells joined by bars; text inside tables therefore stands twice, as paragraphs and as rows."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    said = lambda node: " ".join(t.text.strip() for t in node.iter(f"{w}t") if t.text and t.text.strip())
    lines = [said(p) for p in body.iter(f"{w}p")]
    lines += [" | ".join(said(c) for c in r.iter(f"{w}tc")) for t in body.iter(f"{w}tbl") for r in t.iter(f"{w}tr")]
    return "\n".join(x for x in lines if x)


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of each document."""

    def run(it: Iterator) -> Iterator:
        for b in it:
            b["text"] = [docx_text(bytes(c)) for c in b["content"]]
            yield b[["path", "text"]]

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, text string")


def read_docx_chunks(spark: SparkSession, path: str) -> DataFrame:
    """(path, chunk_index, text) of each document."""
    return read_docx(spark, path).select("path", F.posexplode(chunks(F.col("text"))).alias("chunk_index", "text")).withColumn("chunk_index", F.col("chunk_index").cast("long"))


def html_sections(html: str) -> list[dict]:
    """Headings of a page with the text under each, in order: position, level, title, text."""
    from html.parser import HTMLParser

    out: list[dict] = []

    class Parser(HTMLParser):
        level, skip = 0, 0

        def handle_starttag(self, tag, attrs):
            if re.fullmatch("h[1-6]", tag):
                self.level = int(tag[1])
                out.append({"pos": len(out), "level": self.level, "title": "", "text": ""})
            self.skip += tag in ("script", "style")

        def handle_endtag(self, tag):
            if re.fullmatch("h[1-6]", tag):
                self.level = 0
            self.skip -= tag in ("script", "style") and self.skip > 0

        def handle_data(self, data):
            words = " ".join(data.split())
            if not words or self.skip:
                return
            if not out:
                out.append({"pos": 0, "level": 0, "title": "", "text": ""})
            field = "title" if self.level else "text"
            out[-1][field] = f"{out[-1][field]} {words}".strip()

    Parser().feed(html or "")
    return out


def sections(pages: DataFrame) -> DataFrame:
    """(page_id, pos, level, title, text) of (page_id, html)."""

    def run(it: Iterator) -> Iterator:
        import pandas as pd

        for b in it:
            rows = [(i, s["pos"], s["level"], s["title"], s["text"]) for i, h in zip(b["page_id"], b["html"]) for s in html_sections(h)]
            yield pd.DataFrame(rows, columns=["page_id", "pos", "level", "title", "text"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, pos int, level int, title string, text string")


def notebook_markdown(text: str) -> str:
    """A notebook as Markdown; hidden and removed cells are left out, bad JSON comes back unchanged."""
    import json

    try:
        cells = json.loads(text)["cells"]
    except (ValueError, KeyError, TypeError):
        return text
    out = []
    for c in cells:
        tags = " ".join(c.get("metadata", {}).get("tags", []))
        if re.search("hide|hidden|remove", tags):
            continue
        body = "".join(c.get("source", [])) if isinstance(c.get("source"), list) else str(c.get("source", ""))
        out.append(f"```python\n{body}\n```" if c.get("cell_type") == "code" else body)
    return "\n\n".join(out)


def read_any(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """Rows of a file by its extension, with source_file and source_format where the rows have none."""
    ext = path.lower().rsplit(".", 1)[-1]
    if ext not in FORMATS:
        raise ValueError(f"Unsupported dataset extension: .{ext}")
    df = {
        "csv": read_csv, "json": read_json, "jsonl": read_jsonl, "parquet": lambda s, p: s.read.parquet(p), "xlsx": lambda s, p: read_xlsx(s, p, sheet),
        "pdf": read_pdf, "docx": read_docx_chunks,
    }[ext](spark, path)
    name = re.split(r"[/\\]", path)[-1]
    for column, value in (("source_file", name), ("source_format", ext)):
        df = df.withColumn(column, F.coalesce(df[column], F.lit(value)) if column in df.columns else F.lit(value))
    return df


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """UNION ALL by name in the order given; a column of different types becomes text."""
    types: dict[str, set] = {}
    for f in frames:
        for n, t in f.dtypes:
            types.setdefault(n, set()).add(t)
    mixed = {n for n, t in types.items() if len(t) > 1}
    same = [f.select(*[(F.to_json(c) if t.startswith(("struct", "array", "map")) else F.col(c).cast("string")).alias(c) if c in mixed else F.col(c) for c, t in f.dtypes]) for f in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), same)
