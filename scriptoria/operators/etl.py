"""From texts and pages to blocks, chunks and hashes; duplicates, and what a new version of a document changes."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptoria.functions import text as T

#: Characters that a chunk aims at, and that a paragraph may have before it is split.
TARGET, MOST = 1500, 2500
#: Chunks that are kept because something cites them come after all others.
RETIRED_ORD = 100_000

# Tags whose text is a block, tags that only end one, and the entities that have names.
BLOCK_TAGS = "h[1-6]|p|li|blockquote|td|th|dt|dd|div|caption|figcaption"
END_TAGS = "ul|ol|table|tr"
DROPPED_TAGS = "script style head nav svg".split()
ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "sect": "§", "ndash": "–", "mdash": "—", "bdquo": "„", "rdquo": "”", "ldquo": "“", "amp": "&"}


def code_point(number: Column) -> Column:
    """The character of a code point, null if there is none."""
    fits = (number > 0) & (number < 0x110000) & ~number.between(0xD800, 0xDFFF)
    return F.when(fits, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))


def decoded_entities(text: Column) -> Column:
    """Named and numeric entities, in one pass over the text, so that nothing is decoded twice; unknown ones stay."""
    named = F.create_map(*[F.lit(x) for kv in ENTITIES.items() for x in kv])

    def decoded(piece: Column) -> Column:
        hexed = F.conv(F.regexp_extract(piece, "^&#[xX]([0-9a-fA-F]{1,8});$", 1), 16, 10).cast("long")
        decimal = F.regexp_extract(piece, "^&#([0-9]{1,9});$", 1)
        known = F.try_element_at(named, F.lower(F.regexp_extract(piece, "^&([A-Za-z]+);$", 1)))
        one = F.when(piece.rlike("^&#[xX]"), code_point(hexed)).when(decimal != "", code_point(F.try_to_number(decimal, F.lit("999999999")).cast("long"))).otherwise(known)
        return F.when(F.length(piece) > 2, F.coalesce(F.when(F.left(piece, F.lit(1)) == "&", one), piece)).otherwise(piece)

    pieces = F.regexp_extract_all(text, F.lit(r"&(?:#[xX][0-9a-fA-F]+|#[0-9]+|[A-Za-z]+);|[^&]+|&"), F.lit(0))
    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(pieces, decoded), "")).otherwise(text)


BLOCK = "struct<kind:string,level:int,text:string>"


def a_block(kind: str, level: Column, body: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), level.cast("int").alias("level"), body.alias("text")).cast(BLOCK)


def html_parts(html: Column) -> Column:
    """Array of (tag, text): the stretches of a page that a tag begins, in order; tag is '' if that opens no block.

    Comments, scripts, styles, heads, navigation and drawings go. Every block tag becomes a mark with its name; the text
    after a mark is a block if the tag opened one, without the tags inside it. Text outside of blocks does not count.
    """
    body = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    for tag in DROPPED_TAGS:
        body = F.regexp_replace(body, rf"(?is)<{tag}\b.*?</{tag}>", "")
    body = F.regexp_replace(body, r"(?i)<br\s*/?>", " ")
    marked = F.regexp_replace(body, rf"(?i)<(/?)({BLOCK_TAGS}|{END_TAGS})\b[^>]*>", "\u0001$1$2\u0002")

    def part(x: Column) -> Column:
        tag = F.lower(F.regexp_extract(x, f"^((?i:{BLOCK_TAGS}))\u0002", 1))
        inner = F.regexp_replace(F.regexp_replace(x, "^[^\u0002]*\u0002", ""), "<[^>]+>", "")
        return F.struct(tag.alias("tag"), F.when(tag != "", T.collapsed(decoded_entities(inner))).alias("text"))

    return F.transform(F.split(marked, "\u0001"), part)


def html_blocks(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, ord, tag and text of a page's blocks: headings and paragraphs (see html_parts)."""
    parts = pages.select(key, F.posexplode(html_parts(F.col(html))).alias("ord", "x"))
    return parts.where("x.tag != '' and x.text != ''").select(key, "ord", "x.tag", "x.text")


def html_block_array(html: Column) -> Column:
    """The blocks of a page as an array."""
    kept = F.filter(html_parts(html), lambda x: (x.tag != "") & (x.text != ""))
    level = lambda x: F.regexp_extract(x.tag, "^h([1-6])$", 1)
    return F.transform(kept, lambda x: F.when(level(x) != "", a_block("heading", level(x).try_cast("int"), x.text)).otherwise(a_block("para", F.lit(None), x.text)))


# The marks of headings, list items, pictures, links, strong, slanted and literal words in Markdown.
MD_LINE = r"(?m)^[ \t]*(#{1,6}[ \t]+\S.*|(?:[-*+]|\d+[.)])[ \t]+.*)$"
MD_INLINE = ((r"!\[[^\]]*\]\([^)]*\)", ""), (r"\[([^\]]+)\]\([^)]*\)", "$1"), (r"(\*\*|__)(.+?)\1", "$2"), (r"(\*|_)(.+?)\1", "$2"), (r"`([^`]+)`", "$1"))


def markdown_block_array(text: Column) -> Column:
    """The blocks of a Markdown text: a line that is a heading or a list item is one, and so is what stands between these
    and empty lines."""
    unix = F.regexp_replace(text, "\r\n?", "\n")
    parts = F.split(F.regexp_replace(unix, MD_LINE, "\u0001$1\u0001"), "\u0001|\n[ \t]*\n")

    def made(part: Column) -> Column:
        marks = F.length(F.regexp_extract(part, r"^(#{1,6})\s", 1))
        bare = F.when(marks > 0, F.regexp_replace(part, r"^#{1,6}\s+|\s*#*\s*$", "")).otherwise(part)
        for pattern, left in MD_INLINE:
            bare = F.regexp_replace(bare, pattern, left)
        return F.when(marks > 0, a_block("heading", marks, T.collapsed(bare))).otherwise(a_block("para", F.lit(None), T.collapsed(bare)))

    return F.filter(F.transform(parts, made), lambda x: x.text != "")


def html_title(html: Column) -> Column:
    title = T.collapsed(decoded_entities(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))
    return F.when(title != "", title)


# Words that begin a heading of the first level. A letter that is no plain one ends in no word boundary in
# the form that this agrees with, so such a keyword must go on in a plain letter, digit or underscore.
HEADING_WORDS = r"(?iu)^((rozdział|dział|część)(?=[A-Za-z0-9_])|(wykład|temat)(?![A-Za-z0-9_]))"
FIRST_LEVEL = r"(?iu)^((rozdział|dział|część)(?=[A-Za-z0-9_])|wykład(?![A-Za-z0-9_]))"
LIST_ITEM = r"(?i)^(\d+[.)]|[-*•]|[a-z]\))\s+\S"


def looks_like_heading(line: Column) -> Column:
    """A short line without an end mark that begins with a heading's word or a number, or is in capitals."""
    letters = F.regexp_replace(line, "[^A-Za-zĄĆĘŁŃÓŚŹŻąćęłńóśźż]", "")
    numbered = line.rlike(r"^([IVXLC]+|\d+(\.\d+)*)[.)]\s+\S") & (F.length(line) < 70)
    loud = (F.length(letters) >= 4) & (letters == F.upper(letters))
    return (F.length(line) <= 90) & ~line.rlike("[.,;]$") & (line.rlike(HEADING_WORDS) | numbered | loud)


def heading_level(line: Column) -> Column:
    number = F.regexp_extract(line, r"^(\d+(?:\.\d+)*)[.)]?\s", 1)
    depth = F.size(F.split(number, r"\."))
    return F.when(line.rlike(FIRST_LEVEL), 1).when(number != "", F.least(F.lit(3), depth + 1)).otherwise(2)


def text_parts(text: Column) -> Column:
    """For each paragraph of a plain text the array of its blocks.

    Empty lines part paragraphs. A paragraph of list items only is a block for each item; a line alone that looks like a
    heading is one, and so is a first line of fewer than 80 characters without an end mark.
    """
    joined, none = lambda xs: F.array_join(xs, " "), F.lit(None)

    def made(lines: Column) -> Column:
        first, n = F.get(lines, F.lit(0)), F.size(lines)
        heading = F.array(a_block("heading", heading_level(first), first))
        return (
            F.when(n == 0, F.array().cast(f"array<{BLOCK}>"))
            .when((n > 1) & F.forall(lines, lambda x: x.rlike(LIST_ITEM)), F.transform(lines, lambda x: a_block("para", none, x)))
            .when((n == 1) & looks_like_heading(first), heading)
            .when((n > 1) & looks_like_heading(first) & (F.length(first) < 80) & ~first.rlike("[.:,;]$"), F.concat(heading, F.array(a_block("para", none, joined(F.slice(lines, F.lit(2), F.greatest(n, F.lit(1))))))))
            .otherwise(F.array(a_block("para", none, joined(lines))))
        )

    def lines_of(body: Column) -> Column:
        return F.filter(F.transform(F.split(body, "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")

    unix = F.regexp_replace(text, "\r\n?", "\n")
    return F.transform(F.transform(F.split(unix, r"\n\s*\n"), lines_of), made)


def text_blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, ord (paragraph, place in it), kind (heading or para), level and text of a plain text's blocks (see text_parts)."""
    parts = docs.select(key, F.posexplode(text_parts(F.col(text))).alias("part", "made"))
    rows = parts.select(key, "part", F.posexplode("made").alias("at", "b"))
    return rows.select(key, F.struct("part", "at").alias("ord"), "b.kind", "b.level", "b.text")


# What a sentence is when long paragraphs are split, and where a text may be cut.
SENTENCE = re.compile(r"[^.!?;]+[.!?;]+(?:\s|$)|[^.!?;]+$")
CUT = re.compile(r"(?<=\n\n)|(?<=[.!?;:])\s+(?=\S)")


def filled(units: Iterable[tuple[str, int]], room: int, gap: int = 0) -> Iterator[list[str]]:
    """Units (text, size) in order, in groups of at most `room`, with `gap` for each one that is in already; a unit that is
    larger than that is a group by itself."""
    group, used = [], 0
    for text, size in units:
        if group and used + size > room:
            yield group
            group, used = [], 0
        group.append(text)
        used += size + gap
    if group:
        yield group


def sliced(text: str, most: int, step: int) -> list[tuple[str, int]]:
    """A unit, or slices of one that is too long, sized so that each stays alone."""
    return [(text, len(text))] if len(text) <= most else [(text[i : i + step], most + 1) for i in range(0, len(text), step)]


def split_long(text: str) -> list[str]:
    """Pieces of at most MOST characters, filled with sentences up to TARGET."""
    if len(text) <= MOST:
        return [text]
    units = [u for sentence in SENTENCE.findall(text) or [text] for u in sliced(sentence, MOST, TARGET)]
    return [t for group in filled(units, TARGET) if (t := "".join(group).strip())]


def sections(blocks) -> Iterator[tuple[list[str], list[tuple[str, int | None]]]]:
    """(heading path, paragraphs with pages) between one heading and the next."""
    path: dict[int, str] = {}
    inside: list[tuple[str, int | None]] = []
    for b in blocks:
        if b["kind"] != "heading":
            inside.append((b["text"], None if b["page"] is None else int(b["page"])))
            continue
        yield [path[k] for k in sorted(path) if path[k]], inside
        level = max(1, min(6, int(b["level"] or 1)))
        path, inside = {**{k: v for k, v in path.items() if k < level}, level: b["text"]}, []
    yield [path[k] for k in sorted(path) if path[k]], inside


def packed(blocks) -> list[dict]:
    """Chunks of one document from its blocks (kind, level, text, page) in order: a section's paragraphs fill chunks of about
    TARGET characters, which have its heading path and the range of their pages."""
    chunks = []
    for path, paragraphs in sections(blocks):
        pieces = [(piece, page) for text, page in paragraphs for piece in split_long(plain_paragraph(text)) if piece]
        at = 0
        for group in filled([(piece, len(piece)) for piece, _ in pieces], TARGET, 2):
            pages = [page for _, page in pieces[at : at + len(group)] if page is not None]
            at += len(group)
            chunks.append({"ord": len(chunks), "heading_path": path, "page_from": min(pages, default=None), "page_to": max(pages, default=None), "text": "\n\n".join(group)})
    return chunks


def plain_paragraph(text: str) -> str:
    return re.sub(r" *\n *", "\n", re.sub("[ \u00a0\u2007\u202f\t]+", " ", text.replace("\u00ad", ""))).strip()


CHUNK = "array<struct<ord:int,heading_path:array<string>,page_from:int,page_to:int,text:string>>"


def chunk_blocks(blocks: DataFrame, key: str) -> DataFrame:
    """Chunks (ord, heading_path, page_from, page_to, text, text_hash) of documents given as rows of blocks. A document's
    blocks meet in one task; a document is what one task can hold."""
    page = F.col("page") if "page" in blocks.columns else F.lit(None)
    rows = blocks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", "kind", F.col("level").cast("int").alias("level"), "text", page.cast("int").alias("page")))).alias("blocks"))

    @F.pandas_udf(CHUNK)
    def run(docs: pd.Series) -> pd.Series:
        return docs.map(packed)

    out = rows.select(key, F.inline(run("blocks")))
    return out.withColumn("text_hash", T.content_hash(F.col("text")))


def split_text(text: str, most: int) -> list[str]:
    """Pieces of at most `most` characters, cut at paragraph or sentence ends as far as there are any. Sentences are joined
    by a blank, paragraphs by what stands between them."""
    if len(text) <= most:
        return [text]
    pieces = [""]
    for unit in filter(None, CUT.split(text)):
        if len(unit) > most:
            pieces += [*(unit[i : i + most] for i in range(0, len(unit), most)), ""]
        elif pieces[-1] and len(pieces[-1]) + 1 + len(unit) > most:
            pieces.append(unit)
        else:
            pieces[-1] += (" " if pieces[-1] and not pieces[-1].endswith("\n") else "") + unit
    return [t for piece in pieces if (t := piece.strip())]


def exact_duplicates(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Each row with the smallest key of its content: a copy where that is another one."""
    rows = docs.select(key, T.content_hash(F.col(text)).alias("text_hash"))
    first = rows.groupBy("text_hash").agg(F.min(key).alias("first_id"), F.count("*").alias("copies"))
    return rows.join(first, "text_hash").select(key, "text_hash", "first_id", "copies")


def version_diff(old: DataFrame, new: DataFrame, doc: str, cited: DataFrame | None = None) -> DataFrame:
    """What a new version does to a document's chunks (doc, ord, text_hash; old ones with chunk_id): equal chunks are paired
    one by one in order and keep their id (reused), others are inserted, and old ones without a partner go (dropped), or
    stay behind all others if cited (retired)."""
    n = lambda df: df.withColumn("n", F.row_number().over(Window.partitionBy(doc, "text_hash").orderBy("ord")))
    a = n(old).select(doc, "text_hash", "n", "chunk_id", F.col("ord").alias("old_ord"))
    rows = a.join(n(new).select(doc, "text_hash", "n", F.col("ord").alias("new_ord")), [doc, "text_hash", "n"], "full")
    if cited is not None:
        rows = rows.join(cited.select("chunk_id", F.lit(True).alias("cited")).distinct(), "chunk_id", "left")
    gone = F.when(F.col("cited"), "retired").otherwise("dropped") if cited is not None else F.lit("dropped")
    action = F.when(F.col("old_ord").isNull(), "inserted").when(F.col("new_ord").isNull(), gone).otherwise("reused")
    late = F.lit(RETIRED_ORD) + F.col("old_ord")
    return rows.select(doc, "chunk_id", "text_hash", action.alias("action"), F.coalesce("new_ord", F.when(action == "retired", late)).alias("ord"))


#: Spans that a task sorts, about.
SPAN_ROWS = 500_000


def union_of_spans(spans: DataFrame, key: str) -> DataFrame:
    """Overlapping or touching spans (start, end) of a key as one. Nulls come last, as in the SQL: a span without a start joins
    the key's last one, if any before it has an end. Keys are dealt out in parts of about SPAN_ROWS rows, so that a task's memory does not
    grow with the table."""
    spans = spans.repartition(max(1, -(-spans.count() // SPAN_ROWS)), key)
    w = Window.partitionBy(key).orderBy(F.asc_nulls_last("start"), F.asc_nulls_last("end"))
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.withColumn("new", F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0)).withColumn("part", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "part").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("part")
