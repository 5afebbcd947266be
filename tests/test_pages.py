import math
import random

from pyspark.sql import functions as F
from test_sources import FILES

from scriptoria.functions import text as T
from scriptoria.operators import pages as G
from scriptoria.sources.datasource import read_document_files
from scriptoria.sources.files import read_blocks

GLYPH = "d long, page int, y double, x double, size double, str string"


def page(d, n, lines, printed=None):
    rows = [(d, n, 800.0, 10.0, 8.0, f"Podręcznik, rozdz. {n}")]
    rows += [(d, n, 700.0 - 12 * i, 10.0, size, text) for i, (text, size) in enumerate(lines)]
    return rows + ([(d, n, 20.0, 50.0, 8.0, printed)] if printed else [])


def blocks(spark, rows):
    return [(r.kind, r.level, r.page, r.text) for r in sorted(G.page_blocks(spark.createDataFrame(rows, GLYPH), "d").collect(), key=lambda r: (r.d, r.ord))]


def test_words_and_sentences_go_on_across_lines_and_pages(spark):
    body = lambda *texts: [(t, 10.0) for t in texts]
    rows = page(1, 1, [("Tytuł", 16.0), ("książki", 16.0), *body("Pierwszy akapit ma słowo prze-", "łamane i ciągnie się dalej przez tę całą stronę aż po kres, któ-")], "41")
    rows += page(1, 2, [*body("ry jest na drugiej.", "Nowy akapit po krótkim końcu i z imieniem Anna-", "Maria w środku zdania."), ("Podtytuł", 13.0), *body("Treść tej części książki idzie tu.")], "42") + page(1, 3, body("Koniec."), "- 43 -")
    got = blocks(spark, rows)
    assert got == [
        ("heading", 1, 41, "Tytuł książki"), ("para", None, 41, "Pierwszy akapit ma słowo przełamane i ciągnie się dalej przez tę całą stronę aż po kres, który jest na drugiej."),
        ("para", None, 42, "Nowy akapit po krótkim końcu i z imieniem Anna- Maria w środku zdania."), ("heading", 2, 42, "Podtytuł"), ("para", None, 42, "Treść tej części książki idzie tu."), ("para", None, 43, "Koniec."),
    ]


def test_page_numbers_need_most_pages_to_agree(spark):
    text = [("Zwykła długa linia tekstu bez końca", 10.0)]
    shift = lambda printed: {r.shift for r in G.page_offsets(G.lines_of(spark.createDataFrame([x for n, p in enumerate(printed, 1) for x in page(1, n, text, p)], GLYPH), "d"), "d").collect()}
    assert shift(["11", "12", "99", None]) == {10} and shift(["11", "40", "99", None]) == {0} and shift(["strona 5", "str. 6"]) == {4} and shift([None, None]) == {0} and shift(["xi", "xii"]) == {0}


def test_wide_gaps_repeats_and_odd_pages(spark):
    rows = [(1, 1, 700.0, 10.0, 10.0, "raz"), (1, 1, 688.0, 10.0, 10.0, "dwa"), (1, 1, 640.0, 10.0, 10.0, "trzy"), (1, 1, 640.2, 90.0, 10.0, "cztery"), (1, 1, 600.0, 1.0, 10.0, " "), (2, 1, 9.0, 1.0, 10.0, "7")]
    assert blocks(spark, rows) == [("para", None, 1, "raz dwa"), ("para", None, 1, "trzy cztery")]
    assert blocks(spark, []) == []


def order(seed, items):
    """The same order by a plain loop; the product is a double."""
    x, a = seed or 1, list(items)
    for i in range(len(a) - 1, 0, -1):
        x = int(float(x) * 1103515245.0 + 12345.0) & 0x7FFFFFFF
        j = min(math.floor(x / 0x7FFFFFFF * (i + 1)), i)
        a[i], a[j] = a[j], a[i]
    return a


def test_shuffle_is_fixed_by_its_seed(spark):
    rng = random.Random(1)
    rows = [(seed, [f"w{i}" for i in range(rng.randrange(0, 40))]) for seed in [0, 1, 2, 42, 43, 2**31 - 1, 123456789, *(rng.randrange(2**31) for _ in range(40))]]
    got = spark.createDataFrame(rows, "seed long, items array<string>").select("seed", "items", T.shuffled(F.col("items"), F.col("seed")).alias("out")).collect()
    assert all(r.out == order(r.seed, r["items"]) for r in got)
    pool = [f"w{i}" for i in range(30)]
    draw = lambda n, seed, avoid: spark.createDataFrame([(pool, seed, avoid)], "p array<string>, s long, a array<string>").select(T.drawn(F.col("p"), n, F.col("s"), F.col("a"))).head()[0]
    first = draw(10, 42, [])
    assert len(set(first)) == 10 and draw(10, 42, None) == first == order(42, pool)[:10] and not set(draw(10, 43, first)) & set(first)
    assert draw(10, 43, pool[:25]) == draw(10, 43, []) and len(draw(50, None, [])) == 30


def test_document_files_as_a_data_source(spark, tmp_path):
    for name, data in FILES.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "k.txt").write_text("głęboko")
    (tmp_path / "_hidden.txt").write_text("x")
    names = lambda df: sorted((r.path.rpartition("/")[2], r.status, r.ord or 0, r.kind or "", r.level or 0, r.text or "", r.page or 0) for r in df.collect())
    got = names(read_document_files(spark, str(tmp_path)))
    assert got == [r for r in names(read_blocks(spark, str(tmp_path))) if r[0] != "_hidden.txt"] and ("k.txt", "ok", 0, "para", 0, "głęboko", 0) in got
    assert {r[0] for r in names(read_document_files(spark, f"file://{tmp_path}", "txt, .MD"))} == {"b.md", "c.txt", "j.txt", "k.txt"}
    raw = spark.read.format("document_files").load(str(tmp_path))
    assert raw.rdd.getNumPartitions() == len(FILES) + 1 and raw.where("error IS NOT NULL").count() == 2


def test_numbers_of_five_digits_and_pages_of_many_lines(spark, tmp_path):
    from scriptoria.plans import page_plans as P

    text = [("Zwykła długa linia tekstu bez końca", 10.0)]
    shift = lambda first: {r.shift for r in G.page_offsets(G.lines_of(spark.createDataFrame([x for n in range(first, first + 4) for x in page(1, n, text, str(n + 5))], GLYPH), "d"), "d").collect()}
    assert shift(12_000) == {5} and shift(9_994) == {5} and shift(40) == {5}
    small = G.lines_of(spark.createDataFrame(page(1, 1, text, "12345") + page(1, 2, text, "7"), GLYPH), "d")
    assert [r.text for r in G.numbered_lines(small, "d").where("number").collect()] == ["7"]  # five digits number no page of a small file
    lines = "\n".join(f"this is line {'abcdefghij'[i % 10]} of it" for i in range(900))
    docs = [(i, lines if i == 0 else "short one", "src0") for i in range(0, 200, 20)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = P.page_blocks(spark, str(tmp_path)).collect()
    assert not any("reserved" in r.text or r.text in ("6", "96") for r in found) and sum(r.text.count("this is line") for r in found) == 900
