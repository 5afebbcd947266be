"""Toxicity: a lexicon trie intersected with Levenshtein automata, hits weighed by their context, and a logistic score."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptoria.llm.common import cut, fresh, with_texts_mapped

#: Labelled rows that lexicon and weights are fitted on at most, picked by a hash of their key.
TRAIN_ROWS = 20_000
#: Learned terms at most, those that most toxic documents have.
LEARNED_TERMS = 200
#: Tokens to each side of a hit that its context consists of.
CONTEXT = 6
#: Words whose verdict a worker remembers, and states of the automaton that it keeps before it begins anew.
MEMORY, MOST_STATES = 400_000, 100_000

# Terms of abuse that the lexicon starts from, and the words of its contexts.
SEED_TERMS = """
asshole bastard bitch clown coward cretin cunt degenerate despicable disgusting dumbass fool freak garbage idiot idiotic imbecile
jerk loser lowlife maggot moron moronic parasite pathetic pervert pig repulsive retard scoundrel scum scumbag shithead sleazy slut
stupid swine trash ugly vermin vile whore worthless
arschloch abschaum dummkopf drecksau hurensohn schlampe schwachkopf wichser widerlich
connard connasse crétin imbécile minable ordure pourriture salaud salope
cabrón escoria estúpido gilipollas imbécil inútil pendejo patético
""".split()
ADDRESS_WORDS = set("you your youre yourself u ur du dich dir dein deine ihr euch tu toi te ton ta vous votre eres tú ti tus usted ustedes".split())
REPORT_WORDS = set(
    "said says wrote quote quoted quotes quoting called calling word words term phrase insult insults insulted slur means meaning "
    "sagte schrieb zitat wort begriff nannte dit écrit cite mot terme insulte dijo escribió cita palabra término insulto llamó".split()
)
QUOTES = set("\"“”„«»‹›‘’")

TOKEN = re.compile(r"\w+|[\"“”„«»‹›‘’!]")


def allowed_errors(term: str) -> int:
    """Edits that a spelling may differ from a term: short terms must stand as they are."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class FuzzyLexicon:
    """The intersection of a trie of terms with the Levenshtein automaton of the word that is read.

    A state is a set of (trie node, edits so far); a character takes it to all nodes that a match, a replaced, an added or
    a left out character reaches within the edits that some term below allows. States are made and numbered when a word
    first reaches them, so the automaton becomes deterministic as it is used, and a word is over when its state is empty.
    """

    def __init__(self, terms: Iterable[str]):
        self.terms = sorted(set(terms))
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[str | None] = [None]
        self.most: list[int] = [0]
        for term in self.terms:
            node, edits = 0, allowed_errors(term)
            self.most[0] = max(self.most[0], edits)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                    self.most.append(0)
                node = self.children[node][c]
                self.most[node] = max(self.most[node], edits)
            self.ends[node] = term
        self.alphabet = {c for t in self.terms for c in t}
        self.longest = max((len(t) + allowed_errors(t) for t in self.terms), default=0)
        self.forget()

    def forget(self) -> None:
        """Begin with the start state only."""
        self.numbers: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.found: list[tuple[str, int] | None] = []
        self.start = self.number(self.closed({(0, 0)}))

    def closed(self, state: set) -> frozenset:
        """With the nodes that left out characters reach, and without those that fewer edits reach as well."""
        least: dict[int, int] = {}
        todo = sorted(state, key=lambda x: x[1])
        while todo:
            node, edits = todo.pop(0)
            if edits > self.most[node] or least.get(node, 99) <= edits:
                continue
            least[node] = edits
            todo += [(child, edits + 1) for child in self.children[node].values()]
        return frozenset(least.items())

    def number(self, state: frozenset) -> int:
        if not state:
            return -1
        if state not in self.numbers:
            self.numbers[state] = len(self.states)
            self.states.append(state)
            self.moves.append({})
            ends = [(edits, self.ends[node]) for node, edits in state if self.ends[node] and edits <= allowed_errors(self.ends[node])]
            self.found.append(min(ends)[::-1] if ends else None)
        return self.numbers[state]

    def step(self, at: int, c: str) -> int:
        after = set()
        for node, edits in self.states[at]:
            after.add((node, edits + 1))
            for label, child in self.children[node].items():
                after.add((child, edits + (label != c)))
        return self.number(self.closed(after))

    def match(self, word: str) -> tuple[str, int] | None:
        """The term with the fewest edits to the word, and their number, or None; ties go to the term that sorts first."""
        if len(word) > self.longest:
            return None
        if len(self.states) > MOST_STATES:
            self.forget()
        at = self.start
        for c in word:
            if at < 0:
                return None
            if c not in self.alphabet:
                c = ""
            moves = self.moves[at]
            to = moves.get(c)
            if to is None:
                to = moves[c] = self.step(at, c)
            at = to
        return self.found[at] if at >= 0 else None


FEATURES = ("exact", "fuzzy", "quoted", "density", "strongest")


class Weigher:
    """Features of a text from its hits and their contexts."""

    def __init__(self, terms: Iterable[str]):
        self.lexicon, self.memory = FuzzyLexicon(terms), {}

    def verdict(self, word: str):
        memory = self.memory
        if word in memory:
            return memory[word]
        if len(memory) > MEMORY:
            memory.clear()
        memory[word] = found = self.lexicon.match(word)
        return found

    def __call__(self, text: str | None) -> tuple[float, ...]:
        if not text:
            return (0.0,) * len(FEATURES)
        low = text.lower()
        words = set(WORDS.findall(low))
        hits = {w: v for w in words if (v := self.verdict(w))}
        if not hits:
            return (0.0,) * len(FEATURES)
        tokens = TOKEN.findall(low)
        n_words, inside, exact, fuzzy, quoted, strongest = 0, False, 0.0, 0.0, 0.0, 0.0
        for i, token in enumerate(tokens):
            if token in QUOTES:
                inside = not inside
                continue
            n_words += 1
            if token not in hits:
                continue
            near = tokens[max(0, i - CONTEXT) : i] + tokens[i + 1 : i + 1 + CONTEXT]
            marks = sum(t in QUOTES for t in near)
            quote = 0.5 * (inside and marks > 0) + 0.4 * any(t in REPORT_WORDS for t in near) + 0.2 * (marks >= 2)
            abuse = 0.5 * any(t in ADDRESS_WORDS for t in near) + 0.2 * ("!" in near) + 0.5 * any(t in hits for t in near)
            weight = max(0.1, 1 + abuse - quote) * (1.0, 0.6, 0.4)[hits[token][1]]
            if hits[token][1]:
                fuzzy += weight
            else:
                exact += weight
            quoted += quote
            strongest = max(strongest, weight)
        density = min(1.0, 10 * (exact + fuzzy) / max(1, n_words))
        return math.log1p(exact), math.log1p(fuzzy), math.log1p(quoted), density, strongest


WORDS = re.compile(r"\w+")


@dataclass(frozen=True)
class Model:
    terms: tuple[str, ...]
    weights: tuple[float, ...]
    intercept: float


def learned_terms(rows: DataFrame) -> list[str]:
    """Words of four letters or more that toxic texts have and others hardly ever (rows: text, label).

    A term needs one in a hundred toxic texts (three at least), nine in ten of its texts toxic, and different words before
    it in six of ten: words of a passage that copies share have the same one before them each time.
    """

    def make():
        def work(text):
            words = WORDS.findall((text or "").lower())
            first = {}
            for before, word in zip(["", *words], words, strict=False):
                first.setdefault(word, before)
            return ([{"word": w, "before": b} for w, b in first.items() if len(w) >= 4 and w.isalpha()],)

        return work

    item = T.StructType([T.StructField("word", T.StringType()), T.StructField("before", T.StringType())])
    pairs = with_texts_mapped(rows, "text", ["label"], make, [("items", T.ArrayType(item))], batch_bytes=500_000).select("label", F.inline("items"))
    toxic = rows.where("label = 1").count()
    found = pairs.groupBy("word").agg(F.sum("label").alias("toxic"), F.count("*").alias("n"), F.count_distinct(F.when(F.col("label") == 1, F.col("before"))).alias("contexts"))
    found = found.where((F.col("toxic") >= max(3, toxic / 100)) & (F.col("toxic") >= 0.9 * F.col("n")) & (F.col("contexts") >= 0.6 * F.col("toxic")))
    return [r.word for r in found.orderBy(F.desc("toxic"), "word").limit(LEARNED_TERMS).collect()]


def weighed(df: DataFrame, text_col: str, terms: Iterable[str], keep: list[str], names: list[str]) -> DataFrame:
    terms = tuple(terms)  # SEED_TERMS and LEARNED_TERMS at most
    return with_texts_mapped(df, text_col, keep, lambda: Weigher(terms), [(n, T.DoubleType()) for n in names])


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "toxic") -> Model:
    """Lexicon and weights from a bounded frame of labelled rows (see TRAIN_ROWS). Labels other than 0 and 1 do not count.
    Without both labels the weights are set by hand: any plain hit is toxic. Null texts are empty, long ones are read whole,
    repeated rows count as often as they stand there, and no rows make the lexicon of the seed terms with weights by hand."""
    label = F.col(label_col).cast("double")
    rows = cut(labelled.where(label.isin(0.0, 1.0)).select(F.col(text_col).alias("text"), label.alias("label")), "labelled")
    n, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).head()
    terms = tuple(sorted({*SEED_TERMS, *(learned_terms(rows) if toxic else [])}))
    if toxic in (0, n):
        return Model(terms, (3.0, 1.0, -1.0, 1.0, 1.0), -3.0)
    rows = cut(weighed(rows, "text", terms, ["label"], list(FEATURES)).coalesce(4), "features")
    model = LogisticRegression(regParam=0.0005, maxIter=60).fit(rows.select("label", array_to_vector(F.array(*FEATURES)).alias("features")))
    return Model(terms, tuple(model.coefficients.toArray().tolist()), float(model.intercept))


def score_toxicity(df: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """keep's columns (all unless given), score (0 to 1) and predicted (1 from 0.5 on).

    Null and empty texts have no hits and get the score of that. Only the text is looked at. A whole text is read; only
    texts with a hit are read a second time for contexts. Repeated rows get equal scores, an empty frame gives an empty one.
    Columns of these names are replaced.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c not in ("score", "predicted")]
    names = fresh(df, *[f"tox_{n}" for n in FEATURES])
    out = weighed(df, text_col, model.terms, keep, names)
    total: Column = F.lit(model.intercept)
    for name, weight in zip(names, model.weights, strict=True):
        total = total + F.col(name) * F.lit(weight)
    out = out.withColumn("score", 1 / (1 + F.exp(-total)))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int")).drop(*names)
