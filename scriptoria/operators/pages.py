"""Paragraphs and headings of printed pages: page numbers by vote, running heads, words and sentences joined across lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptoria.functions import text as T

# Lines that are nothing but a page's number, and with what letters a broken word goes on.
PAGE_NUMBER = r"(?i)^(-\s*)?(\d{1,9}|[ivxlc]{1,6})(\s*-)?$|^(str\.|strona)\s*\d+"
GOES_ON = "^[a-ząćęłńóśźż]"
#: Digits that a bare page number has at most, or one more than the last page's place if that is more.
NUMBER_DIGITS = 4
#: Lines at a page's top and bottom that may be running ones; the share of pages on which such a line repeats; the share that
#: must agree on how far printed numbers are from the file's.
EDGE_LINES, REPEATED, AGREED = 2, 0.3, 0.5
#: How much larger than the body a heading is, and how long at most; the gap, in sizes, that parts paragraphs.
LARGER, HEADING, GAP = 1.15, 120, 1.9


def joined_lines(lines: Column) -> Column:
    """An array of lines as one text: a blank between two, none where a line ends with a hyphen and the next goes on in small
    letters, and then no hyphen either."""

    def add(text: Column, line: Column) -> Column:
        broken = text.endswith("-") & line.rlike(GOES_ON)
        return F.when(text == "", line).when(broken, F.concat(F.left(text, F.length(text) - 1), line)).otherwise(F.concat(text, F.lit(" "), line))

    return F.aggregate(lines, F.lit(""), add)


def lines_of(glyphs: DataFrame, doc: str) -> DataFrame:
    """doc, page, y, size, text, edge: pieces at one height of a page are a line, read from the left; empty ones go."""
    pieces = F.array_sort(F.collect_list(F.struct("x", "str")))
    lines = glyphs.groupBy(doc, "page", F.round("y").alias("y")).agg(F.array_join(F.transform(pieces, lambda g: g["str"]), " ").alias("text"), F.max("size").alias("size"))
    lines = lines.withColumn("text", T.collapsed(F.col("text"))).where("text <> ''")
    page = Window.partitionBy(doc, "page")
    top, bottom = F.row_number().over(page.orderBy(F.desc("y"))), F.row_number().over(page.orderBy("y"))
    return lines.withColumn("edge", F.least(top, bottom) <= EDGE_LINES)


def numbered_lines(lines: DataFrame, doc: str) -> DataFrame:
    """lines with number: whether a line is a page's number at an edge, of as many digits as the document's pages can have."""
    last = lines.groupBy(doc).agg((F.max(F.length(F.col("page").cast("string"))) + 1).alias("digits"))
    bare = F.length(F.regexp_extract("text", r"^(?:-\s*)?(\d+)", 1)) <= F.greatest(F.lit(NUMBER_DIGITS), F.col("digits"))
    return lines.join(last, doc, "left").withColumn("number", F.col("edge") & F.col("text").rlike(PAGE_NUMBER) & F.coalesce(bare, F.lit(True))).drop("digits")


def page_offsets(lines: DataFrame, doc: str) -> DataFrame:
    """doc, pages and shift: by how much printed page numbers are ahead of the file's. Each number at a page's edge is a vote;
    the difference with most votes, the smallest of equals, holds if at least AGREED of the pages back it, otherwise 0."""
    pages = lines.groupBy(doc).agg(F.count_distinct("page").alias("pages"))
    numbers = numbered_lines(lines, doc).where("number").withColumn("printed", F.regexp_extract("text", r"\d+", 0).try_cast("int")).where("printed IS NOT NULL")
    votes = numbers.groupBy(doc, (F.col("printed") - F.col("page")).alias("ahead")).agg(F.count("*").alias("votes"))
    best = votes.groupBy(doc).agg(F.max(F.struct("votes", (-F.col("ahead")).alias("back"))).alias("best"))
    agreed = F.col("best.votes") >= F.greatest(F.lit(1), F.ceil(F.col("pages") * AGREED))
    return pages.join(best, doc, "left").select(doc, "pages", F.when(agreed, -F.col("best.back")).otherwise(0).cast("int").alias("shift"))


def page_blocks(glyphs: DataFrame, doc: str) -> DataFrame:
    """doc, ord (from 1), kind, level, page (as printed, where pages agree), text of the blocks of pages given as text positions
    (doc, page, y, x, size, str).

    Page numbers and lines that repeat on REPEATED of the pages, numbers apart, go where they stand at an edge. The body's size
    is the one that most characters have, the smaller of equals. Larger short lines are headings, levels by size, and several
    of one size are one heading. Other lines make paragraphs, also from one page to the next; a new one begins after a wide
    gap or a short line that ends a sentence. A document without lines has no rows.
    """
    lines = lines_of(glyphs, doc).withColumn("plain", F.lower(F.regexp_replace("text", r"\d+", "#")))
    offsets = page_offsets(lines, doc)
    often = lines.where("edge").groupBy(doc, "plain").agg(F.count_distinct("page").alias("n")).join(offsets, doc)
    often = often.where((F.col("pages") >= 2) & (F.col("n") >= F.greatest(F.lit(2.0), F.col("pages") * REPEATED))).select(doc, "plain", F.lit(True).alias("edge"))
    kept = numbered_lines(lines, doc).where(~F.col("number")).drop("number").join(often, [doc, "plain", "edge"], "left_anti").join(offsets.select(doc, "shift"), doc)

    by_size = kept.groupBy(doc, F.round("size").alias("rounded")).agg(F.sum(F.length("text")).alias("chars"))
    body = by_size.groupBy(doc).agg(F.max(F.struct("chars", (-F.col("rounded")).alias("less"))).alias("most")).select(doc, (-F.col("most.less")).alias("body"))
    kept = kept.join(body, doc).withColumn("head", (F.col("size") >= LARGER * F.col("body")) & (F.length("text") < HEADING)).withColumn("rounded", F.round("size"))
    ranks = kept.where("head").select(doc, "rounded").distinct().withColumn("level", F.least(F.lit(3), F.row_number().over(Window.partitionBy(doc).orderBy(F.desc("rounded")))))
    rows = kept.join(ranks, [doc, "rounded"], "left").withColumn("level", F.when(F.col("head"), F.col("level")))

    line = Window.partitionBy(doc).orderBy("page", F.desc("y"))
    before = lambda c: F.lag(c).over(line)
    same_page = before("page") == F.col("page")
    far = same_page & (before("y") - F.col("y") > F.col("size") * GAP)
    ended = before("text").rlike("[.:;]$") & (F.length(before("text")) < 55)
    begins = F.when(before("head").isNull() | (before("head") != F.col("head")), True).when(F.col("head"), before("rounded") != F.col("rounded")).otherwise(far | ended)
    rows = rows.withColumn("begins", begins.cast("int"))
    rows = rows.withColumn("ord", F.sum("begins").over(line.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    entry = F.struct("page", (-F.col("y")).alias("down"), "text")
    blocks = rows.groupBy(doc, "ord").agg(F.array_sort(F.collect_list(entry)).alias("lines"), F.first("head").alias("head"), F.first("level").alias("level"), F.first("shift").alias("shift"))
    text = F.when(F.col("head"), F.array_join("lines.text", " ")).otherwise(joined_lines(F.col("lines.text")))
    page = (F.get("lines.page", F.lit(0)) + F.col("shift")).cast("int")
    return blocks.select(doc, "ord", F.when(F.col("head"), "heading").otherwise("para").alias("kind"), "level", page.alias("page"), text.alias("text"))
