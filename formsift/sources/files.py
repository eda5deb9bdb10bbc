"""Files and tables in, texts out.

Documents come as (path, content) rows of Spark's binary file source; each file
gets its text, pages, and a status of its own, so a bad file spoils no batch."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formsift.functions.text import extension, strip
from formsift.operators.extract import opened

IMAGES = (".png", ".jpg", ".jpeg")
SUPPORTED = (".pdf", ".docx", ".xlsx", ".xls", *IMAGES)
#: Texts below so many characters are read by OCR instead.
LEAST_TEXT = 20
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
LOADED = "path string, text string, needs_ocr boolean, pages array<struct<page:int,text:string>>, status string, error string"


def docx_text(content: bytes) -> str:
    """Paragraphs, then all tables, a row's cells divided by bars; blanks left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{WORD}body")

    def said(p) -> str:
        marks = {f"{WORD}t": lambda x: x.text or "", f"{WORD}tab": lambda x: "\t", f"{WORD}br": lambda x: "\n"}
        return "".join(marks[x.tag](x) for x in p.iter() if x.tag in marks).strip()

    lines = [said(p) for p in body.findall(f"{WORD}p")]
    for table in body.findall(f"{WORD}tbl"):
        for row in table.findall(f"{WORD}tr"):
            cells = ["\n".join(said(p) for p in cell.findall(f"{WORD}p")).strip() for cell in row.findall(f"{WORD}tc")]
            lines.append(" | ".join(c for c in cells if c))
    return "\n".join(x for x in lines if x)


def _cell(cell, shared: list[str]) -> str | None:
    kind, v = cell.get("t"), cell.find(f"{SHEET}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{SHEET}t"))
    if v is None or v.text is None:
        return None
    if kind == "s":
        return shared[int(v.text)]
    if kind == "b":
        return "True" if v.text == "1" else "False"
    return v.text


def xlsx_text(content: bytes) -> str:
    """Each sheet's name, then its rows, cells divided by bars; empty ones left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{SHEET}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        lines = []
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{SHEET}sheet"):
            lines.append(f"Sheet: {sheet.get('name')}")
            target = targets[sheet.get(RELATION)].lstrip("/")
            for row in ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{SHEET}row"):
                cells = [_cell(c, shared) for c in row.iter(f"{SHEET}c")]
                if any(c is not None for c in cells):
                    lines.append(" | ".join(c for c in cells if c is not None))
    return "\n".join(lines)


def pdf_pages(content: bytes) -> list[str]:
    """Pages' texts with a PDF library, if one is installed."""
    try:
        import fitz
    except ImportError as e:
        raise ValueError("no PDF library is installed") from e
    with fitz.open(stream=content, filetype="pdf") as pdf:
        return [page.get_text("text").strip() for page in pdf]


def first_read(engines: list, path: str, content: bytes) -> list[tuple[int, str]]:
    """(page, text) of the first engine that finds any text; one that fails finds
    none, unless all do."""
    failed = None
    for ocr in engines:
        try:
            read = [(i, t.strip()) for i, t in enumerate(ocr(path, content), 1) if t.strip()]
        except Exception as e:
            failed = e
            continue
        if read:
            return read
    if failed and len(engines) == 1:
        raise failed
    return []


def load_one(path: str, content: bytes, pdf: Callable[[bytes], list[str]] = pdf_pages, ocr: Callable[[str, bytes], list[str]] | None = None) -> tuple:
    """(text, needs_ocr, pages, status, error) of one file.

    ocr: path and bytes to the texts of pages, or several such, of which the first
    that finds any text is taken; it replaces what was read only then, and
    multi-page results are headed by their page numbers."""
    kind = path[path.rfind(".") :].lower() if "." in path else ""
    try:
        if kind == ".docx":
            texts, head = [docx_text(content)], False
        elif kind == ".xlsx":
            texts, head = [xlsx_text(content)], False
        elif kind == ".pdf":
            texts, head = pdf(content), True
        elif kind in IMAGES:
            texts, head = [], False
        else:
            return "", False, [], "rejected", f"unsupported file type: {kind or 'none'}"
        text = "\n".join(t for t in texts if t)
        needs = kind in IMAGES or (kind == ".pdf" and len(text.strip()) < LEAST_TEXT)
        if needs and ocr:
            read = first_read(ocr if isinstance(ocr, list | tuple) else [ocr], path, content)
            if read:
                text = "\n".join(f"Page {i}\n{t}" if head else t for i, t in read)
                texts = [t for _, t in read]
        pages = [{"page": i, "text": t} for i, t in enumerate(texts, 1)]
        return text, needs, pages, "success" if text.strip() else "no_text", None
    except Exception as e:  # one bad file must not end the batch
        return "", False, [], "failed", f"{type(e).__name__}: {e}"[:200]


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of all files below a path that have any bytes."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").select("path", "content")


def load_documents(files: DataFrame, pdf: Callable[[bytes], list[str]] = pdf_pages, ocr: Callable[[str, bytes], list[str]] | None = None) -> DataFrame:
    """Texts of (path, content) rows. pdf and ocr are made once a task if they have a method `open`."""

    def run(batches):
        engines = [opened(o) for o in (ocr if isinstance(ocr, list | tuple) else [ocr] if ocr else [])]
        read_pdf = opened(pdf)
        for batch in batches:
            rows = [(p, *load_one(p, c, read_pdf, engines)) for p, c in zip(batch["path"], batch["content"])]
            yield pd.DataFrame(rows, columns=["path", "text", "needs_ocr", "pages", "status", "error"])

    return files.select("path", "content").mapInPandas(run, LOADED)


def accepted(files: DataFrame, name: str = "path", needed: bool = False) -> DataFrame:
    """Files of supported types, one a file name, whatever folder it lies in: that
    of the least path. needed: it is an error if there is none."""
    own = F.regexp_extract(name, r"[^/\\]*$", 0)
    first = files.where(extension(F.col(name)).isin(*SUPPORTED)).groupBy(own.alias("__name")).agg(F.min(name).alias("__path"))
    out = files.join(first.select("__path"), F.col(name) == F.col("__path"), "left_semi").dropDuplicates([name])
    if needed and out.isEmpty():
        raise ValueError("no supported file with any bytes")
    return out


def ocr_lines(lines):
    """(text, mean score) of an array of recognised (text, score) lines."""
    good = F.filter(F.transform(lines, lambda x: F.struct(strip(x["text"]).alias("text"), x["score"].alias("score"))), lambda x: x["text"] != "")
    mean = F.aggregate(good, F.lit(0.0), lambda n, x: n + x["score"]) / F.greatest(F.size(good), F.lit(1))
    return F.struct(F.array_join(good["text"], "\n").alias("text"), mean.alias("score"))


def first_text(*texts):
    """The first of several OCR results that isn't blank, else an empty string."""
    return F.coalesce(*[F.when(strip(t) != "", t) for t in texts], F.lit(""))


def page_texts(pages: DataFrame, key: str = "path") -> DataFrame:
    """(key, text) of (key, page, text) rows: non-empty pages in order, each headed by its number."""
    said = F.struct("page", F.concat(F.lit("Page "), F.col("page").cast("string"), F.lit("\n"), F.col("text")).alias("t"))
    return pages.where(strip(F.col("text")) != "").groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(said))["t"], "\n").alias("text"))


def regions(width, height):
    """Two places of an identity card where its number stands, as (left, top, right, bottom)."""
    box = lambda top, bottom: F.struct(F.floor(width * 0.04).cast("int").alias("left"), F.floor(height * top).cast("int").alias("top"), F.floor(width * 0.68).cast("int").alias("right"), F.floor(height * bottom).cast("int").alias("bottom"))
    return F.array(box(0.22, 0.67), box(0.50, 0.99))


EXAMPLES = "text string, entities array<struct<start:int,end:int,label:string>>"


def read_examples(spark: SparkSession, *paths: str) -> DataFrame:
    """Training examples (text, entities) of JSON files."""
    return spark.read.schema(EXAMPLES).option("multiLine", True).json(list(paths))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def write_splits(df: DataFrame, path: str, kind: str = "json") -> None:
    """One folder a split."""
    df.write.partitionBy("split").format(kind).save(path)
