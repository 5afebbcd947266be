from pyspark.sql import functions as F

from scriptoria import catalog as C
from scriptoria.operators import external as X
from scriptoria.operators import review as V


def test_page_lines(spark):
    rows = []
    for page in range(1, 5):
        rows += [(1, page, 800.0, 10.0, 9.0, "Podręcznik prawa"), (1, page, 700.2, 60.0, 10.0, f"treść {page}"), (1, page, 699.9, 10.0, 10.0, "Zwykła"), (1, page, 600.0, 10.0, 10.0, "Dalej długi akapit tekstu"), (1, page, 20.0, 10.0, 9.0, f"strona {page + 10}")]
    rows.append((1, 2, 750.0, 10.0, 14.0, "Rozdział II"))
    got = X.page_lines(spark.createDataFrame(rows, "d long, page int, y double, x double, size double, str string"), "d").orderBy("ord").collect()
    assert [(r.page, r.kind, r.text) for r in got][:4] == [(1, "para", "Zwykła treść 1"), (1, "para", "Dalej długi akapit tekstu"), (2, "heading", "Rozdział II"), (2, "para", "Zwykła treść 2")]
    assert len(got) == 9


def test_small_rules(spark):
    df = spark.createDataFrame([("maintenance", 0.9), ("maintenance", None), ("active", None), ("active", 0.95)], "s string, t double")
    assert [r[0] for r in df.select(V.retention(F.col("s"), F.col("t"), 0.9)).collect()] == [0.8, 0.8, 0.9, 0.95]
    assert spark.range(1).select(V.prompt_budget(F.lit(8192), F.lit(1000), F.lit("x" * 100))).head()[0] == 7536 - 1000 - 40 - 32
    arts = spark.createDataFrame([("119",), ("118a",), ("118",), ("2",)], "a string")
    assert [r.a for r in arts.orderBy(*X.article_order(F.col("a"))).collect()] == ["2", "118", "118a", "119"]


def test_catalog(spark):
    df = spark.createDataFrame([("s1", " Prawo", "active", "0.9"), ("s2", " ", "gone", "0.5")], "id string, name string, status string, target_retention string")
    new = C.conformed(df, "subject")
    assert new.columns == C.schema_of("subject").names and "learn_article_numbers" not in C.conformed(df, "subject", 1).columns
    good, bad = C.split_valid(new, C.subject_rules())
    assert [r.id for r in good.collect()] == ["s1"] and bad.head().broken == ["name", "status", "retention"]
    assert spark.range(1).select(*[c.alias(k) for k, c in C.clamped({"a": F.lit(9), "b": F.lit(1)}, {"a": (0, 5)}).items()]).head() == (5, 1)
