"""Acts, judgments and papers from outside: ranking, articles of an act, layout of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptoria.functions import text as T

# Fixed value: how an article begins.
ARTICLE = r"(?iu)^\s*art\.\s*(\d+[a-z]{0,3})\.?"


def ranked_acts(acts: DataFrame, key: str, by: list[str], limit: int) -> DataFrame:
    """Consolidated texts first, then the newest."""
    order = [F.col("title").rlike("(?i)jednolit").desc(), F.col("date").desc(), F.col(key)]
    return acts.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= limit)


def act_articles(lines: DataFrame, act: str, ord_col: str, text: str) -> DataFrame:
    """Articles of acts from their lines: a line that begins an article begins one, lines before the first are left out, and
    of several articles with one number the first counts."""
    w = Window.partitionBy(act).orderBy(ord_col)
    number = F.lower(F.regexp_extract(text, ARTICLE, 1))
    rows = lines.withColumn("start", F.when(number != "", F.col(ord_col))).withColumn("number", F.when(number != "", number))
    rows = rows.withColumn("start", F.last("start", ignorenulls=True).over(w)).withColumn("number", F.last("number", ignorenulls=True).over(w)).where("start is not null")
    first = F.min("start").over(Window.partitionBy(act, "number"))
    rows = rows.withColumn("first", first).where("start = first")
    return rows.groupBy(act, F.col("number").alias("article")).agg(F.count("*").alias("lines"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(ord_col, text))), lambda x: x[text]), "\n").alias("text"))


def wanted_articles(articles: DataFrame, wanted: DataFrame, act: str) -> DataFrame:
    """act, article, found and text for every different article that wanted (act, article) names, in any spelling of its number:
    what an import finds of an act (see act_articles), and what it has to report as missing, also of acts that are not there."""
    key = F.lower(F.regexp_replace(F.col("article"), r"(?i)^\s*art\.?\s*|[\s.]+", ""))
    asked = wanted.select(act, key.alias("article")).where("article <> ''").distinct()
    out = asked.join(articles.select(act, "article", "text"), [act, "article"], "left")
    return out.select(act, "article", F.col("text").isNotNull().alias("found"), "text")


def article_order(article: Column) -> list[Column]:
    """118 before 118a before 119."""
    return [F.regexp_extract(article, r"^\d+", 0).cast("int"), article]


def papers(works: DataFrame, least: int = 80) -> DataFrame:
    """Works with an abstract worth reading, those in the home language first."""
    return works.where(F.length("abstract") > least).withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.col("home").desc(), F.col("year").desc(), "work_id")))


def page_lines(glyphs: DataFrame, doc: str) -> DataFrame:
    """Lines of pages from text positions (doc, page, y, x, size, str): pieces at one height are a line, read from the left.
    A line that stands first or last on half of a document's pages or more, numbers apart, is a running head and goes; a
    line in a size well above the body's, the size that most characters have, is a heading."""
    lines = glyphs.groupBy(doc, "page", F.round("y").alias("y")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "str"))), lambda g: g["str"]), " ").alias("text"), F.max("size").alias("size"))
    lines = lines.withColumn("text", T.collapsed(F.col("text"))).where("text != ''")
    w = Window.partitionBy(doc, "page")
    lines = lines.withColumn("edge", (F.col("y") == F.max("y").over(w)) | (F.col("y") == F.min("y").over(w))).withColumn("plain", F.regexp_replace("text", r"\d+", "#"))
    pages = lines.groupBy(doc).agg(F.count_distinct("page").alias("pages"))
    running = lines.where("edge").groupBy(doc, "plain").agg(F.count_distinct("page").alias("n")).join(pages, doc).where((F.col("n") >= 2) & (F.col("n") * 2 >= F.col("pages"))).select(doc, "plain")
    body = lines.groupBy(doc, F.round("size").alias("size")).agg(F.sum(F.length("text")).alias("chars")).groupBy(doc).agg(F.max_by("size", "chars").alias("body"))
    kept = lines.join(running.withColumn("edge", F.lit(True)), [doc, "plain", "edge"], "left_anti").join(body, doc)
    place = F.row_number().over(Window.partitionBy(doc).orderBy("page", F.desc("y")))
    return kept.select(doc, "page", place.alias("ord"), F.when(F.col("size") >= 1.15 * F.col("body"), "heading").otherwise("para").alias("kind"), "text")
