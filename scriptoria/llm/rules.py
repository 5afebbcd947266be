"""Quality classifier: a sparse rule ensemble over text statistics, compiled to one Column expression."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptoria.llm.common import bounded_sample, cut, fresh

#: Labelled rows that a model is fitted on at most, picked by a hash of their key.
TRAIN_ROWS = 20_000
TREES, DEPTH, LASSO, SEED = 16, 3, 0.002, 17


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text; null is an empty text."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    words = F.split(F.lower(F.trim(t)), r"\s+")
    lines = F.split(t, "\n")
    chars = F.greatest(F.length(t), F.lit(1)).cast("double")
    n_words = F.greatest(F.size(words), F.lit(1)).cast("double")
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]+", ""))
    upper = F.length(F.regexp_replace(t, r"[^\p{Lu}]+", ""))
    symbols = F.regexp_replace(t, r"[\p{L}\p{N}\s]+", "")
    return {
        "length": F.log1p(F.length(t).cast("double")),
        "word_length": letters / n_words,
        "letters": letters / chars,
        "upper": upper / F.greatest(letters, F.lit(1)),
        "symbols": F.length(symbols) / chars,
        "plain_stops": F.length(F.regexp_replace(symbols, r"[^.,;:?'-]+", "")) / n_words,
        "loud": F.length(F.regexp_replace(symbols, "[^!]+", "")) / n_words,
        "odd_signs": F.length(F.regexp_replace(symbols, r"[^#$%&*|<>{}\\^~=+@_]+", "")) / n_words,
        "bars": F.length(F.regexp_replace(symbols, "[^|]+", "")) / n_words,
        "distinct_words": F.size(F.array_distinct(words)) / F.sqrt(n_words),
        "distinct_share": F.size(F.array_distinct(words)) / n_words,
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines),
        "line_words": n_words / F.size(lines),
        "digits": F.length(F.regexp_replace(t, r"[^\p{N}]+", "")) / chars,
    }


@dataclass(frozen=True)
class Rule:
    """A conjunction: for each statistic at most one interval low < x <= high."""

    bounds: tuple[tuple[str, float, float], ...]

    def column(self, stats: dict[str, Column]) -> Column:
        out = F.lit(True)
        for name, low, high in self.bounds:
            x = stats[name]
            out = out & (x > low if low > float("-inf") else F.lit(True)) & (x <= high if high < float("inf") else F.lit(True))
        return out


@dataclass(frozen=True)
class Ensemble:
    names: tuple[str, ...]
    rules: tuple[tuple[Rule, float], ...]
    intercept: float

    def score(self, stats: dict[str, Column]) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(rule.column(stats), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def tree_paths(node, names: list[str], bounds: dict[str, tuple[float, float]]) -> list[Rule]:
    """A rule for every node of a tree but its root."""
    if node.subtreeDepth() == 0:
        return []
    name, at, out = names[node.split().featureIndex()], float(node.split().threshold()), []
    low, high = bounds.get(name, (float("-inf"), float("inf")))
    for child, interval in ((node.leftChild(), (low, min(high, at))), (node.rightChild(), (max(low, at), high))):
        inner = {**bounds, name: interval}
        out += [Rule(tuple(sorted((n, *b) for n, b in inner.items()))), *tree_paths(child, names, inner)]
    return out


def fit(labelled: DataFrame, text_col: str, label_col: str, key_col: str, most: int = TRAIN_ROWS, lasso: float = LASSO) -> Ensemble:
    """Fit on labelled rows, `most` of them at most: trees over the statistics, their paths as rules, and a logistic
    regression with an L1 penalty over the rules, which leaves most without weight. With no labelled rows, or with one
    label only, the ensemble is a constant. Null texts are empty ones, texts of any length count whole, and labels other
    than 0 and 1 or null do not count. Repeated rows count as often as they stand there; splits of equal gain go to the
    statistic that is listed first. Statistics are made where the texts are read and written once; only their short rows
    are drawn together."""
    stats = statistics(F.col(text_col))
    names, label = list(stats), F.col(label_col).cast("double")
    rows = cut(bounded_sample(labelled.where(label.isin(0.0, 1.0)), key_col, most).select(label.alias("label"), *[c.cast("double").alias(n) for n, c in stats.items()]), "statistics").coalesce(8)
    n, positive = rows.agg(F.count("*"), F.sum("label")).head()
    if not n or positive in (0, n):
        rate = ((positive or 0) + 0.5) / (n + 1)
        import math

        return Ensemble(tuple(names), (), math.log(rate / (1 - rate)))
    vectors = rows.select("label", array_to_vector(F.array(*names)).alias("features"))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="onethird", subsamplingRate=0.7, maxBins=64).fit(vectors)
    rules = sorted({r for tree in forest.trees for r in tree_paths(tree._java_obj.rootNode(), names, {})}, key=lambda r: r.bounds)
    if not rules:
        return Ensemble(tuple(names), (), 0.0)
    here = {name: F.col(name) for name in names}
    hits = rows.select("label", array_to_vector(F.array(*[r.column(here).cast("double") for r in rules])).alias("features"))
    model = LogisticRegression(elasticNetParam=1.0, regParam=lasso, maxIter=60, standardization=False).fit(hits)
    weights = model.coefficients.toArray().tolist()
    return Ensemble(tuple(names), tuple((r, w) for r, w in zip(rules, weights, strict=True) if w), float(model.intercept))


def score_quality(df: DataFrame, model: Ensemble, text_col: str = "text") -> DataFrame:
    """df with score (0 to 1) and predicted (1 from 0.5 on), one Column expression over the text's statistics. Null texts
    count as empty ones and get a score as well, texts of any length count whole. Rows are scored one by one, repeated ones
    alike; an empty frame gives an empty one. Columns of these names are replaced."""
    names = dict(zip(model.names, fresh(df, *[f"stat_{n}" for n in model.names]), strict=True))
    stats = {n: c.cast("double") for n, c in statistics(df[text_col]).items()}
    out = df.select("*", *[stats[n].alias(names[n]) for n in model.names])
    out = out.withColumn("score", model.score({n: F.col(c) for n, c in names.items()}))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int")).drop(*names.values())
