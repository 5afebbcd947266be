"""Document files of several formats, read by Spark's binary file source, as rows of blocks."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptoria.operators import etl

#: What a file holds before its texts are parted: form says by which rule, and ready parts have a kind and level.
PARTS = "path string, error string, form string, parts array<struct<page:int,kind:string,level:int,body:string>>"
BLOCKS = "path string, status string, error string, ord int, kind string, level int, text string, page int"

# RTF destinations whose text is none of the document's.
RTF_HIDDEN = set("fonttbl colortbl stylesheet info pict header footer listtable listoverridetable rsidtbl generator xmlnstbl themedata colorschememapping latentstyles datastore mmathPr".split())
# RTF words that stand for a character.
RTF_SIGNS = {"par": "\n", "line": "\n", "sect": "\n", "page": "\n", "tab": " ", "emdash": "—", "endash": "–", "lquote": "'", "rquote": "'", "ldblquote": '"', "rdblquote": '"'}


def decoded(data: bytes) -> str:
    """UTF-8, or else the Central European code page; without a byte order mark."""
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        return data.decode("cp1250", "replace")


def block(text: str, kind: str = "para", level: int | None = None, page: int | None = None) -> dict | None:
    text = re.sub(r"\s+", " ", text).strip()
    return {"page": page, "kind": kind, "level": level, "body": text} if text else None


def rtf_text(data: bytes) -> str:
    """The text of an RTF file, a line for each paragraph or line: groups, escapes in the code page that the file names (or
    Latin-1), \\uN with what stands in for it, and words for signs."""
    if not data.startswith(rb"{\rtf"):
        raise ValueError("not an RTF file")
    page = "cp1250" if rb"\ansicpg1250" in data else "latin-1"
    source, out, stack, hidden, skip, instead = data.decode("latin-1"), [], [], False, 0, 1
    for m in re.finditer(r"\\([a-z]{1,32})(-?\d+)? ?|\\'([0-9a-fA-F]{2})|\\([^a-z])|([{}])|([^\\{}\r\n]+)|[\r\n]", source, re.I):
        word, number, code, sign, brace, run = m.groups()
        if brace == "{":
            stack.append((hidden, instead))
        elif brace == "}":
            hidden, instead = stack.pop() if stack else (False, 1)
        elif sign == "*" or word in RTF_HIDDEN:
            hidden = True
        elif hidden:
            continue
        elif word == "uc":
            instead = int(number or 1)
        elif word == "u":
            out.append(chr(int(number or 0) % 65536))
            skip = instead
        elif word in RTF_SIGNS:
            out.append(RTF_SIGNS[word])
        elif code:
            if skip:
                skip -= 1
            else:
                out.append(bytes.fromhex(code).decode(page, "replace"))
        elif sign:
            out.append({"~": " ", "_": "-", "-": "\u00ad"}.get(sign, sign if sign in "\\{}" else ""))
        elif run:
            out.append(run[min(skip, len(run)) :])
            skip = max(0, skip - len(run))
    return "".join(out)


def xml_text(node) -> str:
    return "".join(node.itertext())


def odt_blocks(data: bytes) -> list[dict]:
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for node in ElementTree.fromstring(z.read("content.xml")).iter():
            name = node.tag.rpartition("}")[2]
            if name == "h":
                level = next((int(v) for k, v in node.attrib.items() if k.endswith("outline-level")), 1)
                out.append(block(xml_text(node), "heading", level))
            elif name == "p":
                out.append(block(xml_text(node)))
    return [b for b in out if b]


def docx_blocks(data: bytes) -> list[dict]:
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for node in ElementTree.fromstring(z.read("word/document.xml")).iter():
            if node.tag.rpartition("}")[2] == "p":
                style = next((v for s in node.iter() if s.tag.endswith("}pStyle") for k, v in s.attrib.items() if k.endswith("}val")), "")
                text = "".join(t.text or "" for t in node.iter() if t.tag.rpartition("}")[2] == "t")
                level = re.fullmatch(r"(?:Heading|Nagwek|Title)(\d?)", style)
                out.append(block(text, "heading", int(level[1] or 1)) if level else block(text))
    return [b for b in out if b]


def epub_chapters(data: bytes) -> list[dict]:
    """Chapters in the order of the spine; a chapter's number is its page."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        package = re.search(r'full-path="([^"]+)"', z.read("META-INF/container.xml").decode())[1]
        opf = ElementTree.fromstring(z.read(package))
        hrefs = {n.get("id"): n.get("href") for n in opf.iter() if n.tag.endswith("}item")}
        spine = [hrefs[n.get("idref")] for n in opf.iter() if n.tag.endswith("}itemref")]
        folder = package.rpartition("/")[0]
        return [whole(z.read(f"{folder}/{href}" if folder else href), number) for number, href in enumerate(spine, 1)]


def whole(data: bytes, page: int | None = None) -> dict:
    return {"page": page, "kind": None, "level": None, "body": decoded(data)}


#: By ending: the rule that parts the texts, and what takes them out of the file.
READERS = {
    **dict.fromkeys(("md", "markdown"), ("md", lambda d: [whole(d)])),
    "txt": ("txt", lambda d: [whole(d)]),
    **dict.fromkeys(("html", "htm", "xhtml"), ("html", lambda d: [whole(d)])),
    "epub": ("html", epub_chapters),
    "rtf": ("ready", lambda d: [b for b in map(block, rtf_text(d).split("\n")) if b]),
    "odt": ("ready", odt_blocks),
    "docx": ("ready", docx_blocks),
}


def opened_file(path: str, data: bytes) -> dict:
    """A row of PARTS for one file; a file that cannot be read is a row with an error, and never fails the job."""
    ending = path.rpartition(".")[2].lower()
    try:
        if ending not in READERS:
            raise ValueError(f"no reader for .{ending}")
        form, read = READERS[ending]
        return {"path": path, "error": None, "form": form, "parts": read(data)}
    except Exception as e:  # a broken file may fail in any way
        return {"path": path, "error": f"{type(e).__name__}: {e}"[:200], "form": None, "parts": []}


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of all files under a path, which Spark's binary file source reads. Files are opened in tasks; texts, pages and
    Markdown are parted by expressions, the same as for tables. A file without text is a row with an error, like one that
    cannot be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, data in zip(batch["path"], batch["content"], strict=True):
                yield pd.DataFrame([opened_file(p, data)])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return parted_blocks(files.select("path", "content").mapInPandas(run, PARTS))


def parted_blocks(opened: DataFrame) -> DataFrame:
    """Blocks of opened files (see PARTS), however they were opened."""

    def parted(part):
        ready = F.array(F.struct(part.kind.alias("kind"), part.level.alias("level"), part.body.alias("text")).cast(etl.BLOCK))
        made = (
            F.when(F.col("form") == "html", etl.html_block_array(part.body))
            .when(F.col("form") == "md", etl.markdown_block_array(part.body))
            .when(F.col("form") == "txt", F.flatten(etl.text_parts(part.body)))
            .otherwise(ready)
        )
        return F.transform(made, lambda b: F.struct(b.kind.alias("kind"), b.level.alias("level"), b.text.alias("text"), part.page.alias("page")))

    rows = opened.select("path", "error", F.posexplode_outer(F.flatten(F.transform("parts", parted))).alias("ord", "b"))
    error = F.coalesce("error", F.when(F.col("b").isNull(), F.lit("ValueError: no text")))
    status = F.when(error.isNull(), "ok").otherwise("error")
    return rows.select("path", status.alias("status"), error.alias("error"), "ord", "b.kind", "b.level", "b.text", "b.page")
