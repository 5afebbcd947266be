"""Text functions as Column expressions: folding, tokens, provisions, numbers, facts, passages, gaps, spelling."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that searches leave out. Tokens are folded and these are not, so forms with diacritics never match.
STOP_WORDS = (
    "a aby ale albo bez by być czy dla do gdy i ich im iż jak jako je jego jej jest jeśli już lub ma może na nie nie niż o od oraz po "
    "pod przez przy się są ta tak te tego to tym u w we z za ze że który która które których którym"
).split()
# Words without content when passages are compared; these are folded.
CONTENT_STOP_WORDS = (
    "a aby albo ale bez by być czy dla do gdy i ich im iż jak jako je jego jej jest jeśli już lub ma może na nie niż o od oraz po pod "
    "przez przy się są ta tak te tego to tym u w we z za ze że który która które których którym jeżeli albo"
).split()
# Number words and what they count; "one" is left out, as it mostly is none.
NUMBER_WORDS = {
    2: "dwa dwóch dwu dwie dwoma dwom", 3: "trzy trzech trzema", 4: "cztery czterech czterema", 5: "pięć pięciu", 6: "sześć sześciu",
    7: "siedem siedmiu", 8: "osiem ośmiu", 9: "dziewięć dziewięciu", 10: "dziesięć dziesięciu", 12: "dwanaście dwunastu",
    14: "czternaście czternastu", 15: "piętnaście piętnastu", 20: "dwadzieścia dwudziestu", 30: "trzydzieści trzydziestu",
    40: "czterdzieści czterdziestu", 50: "pięćdziesiąt pięćdziesięciu", 100: "sto stu",
}
# Months in the genitive, as dates have them.
MONTHS = "stycznia lutego marca kwietnia maja czerwca lipca sierpnia września października listopada grudnia".split()
# Abbreviations of acts and the form of a reference to a provision.
ACTS = (
    r"k\.?\s?p\.?\s?c\.?|k\.?\s?p\.?\s?k\.?|k\.?\s?p\.?\s?a\.?|k\.?\s?r\.?\s?o\.?|k\.?\s?s\.?\s?h\.?|k\.?\s?k\.?\s?w\.?|k\.?\s?c\.?|k\.?\s?k\.?|k\.?\s?w\.?|"
    r"k\.?\s?p\.?|Konstytucji(?:\s+RP)?|u\.\s?k\.?\s?w\.?|p\.?\s?u\.?\s?s\.?\s?a\.?"
)
PROVISION = (
    r"(?iu)\bart\.\s*(\d+[a-z]{0,3})(?:\s*[-–]\s*(\d+[a-z]{0,3}))?(?:\s*§\s*(\d+[a-z]?))?(?:\s*(?:pkt|ust\.)\s*(\d+[a-z]?))?"
    rf"(?:\s+({ACTS})(?![a-ząćęłńóśźż]))?"
)

def _letters() -> tuple[str, str]:
    """Letters up to U+024F that are a plain Latin letter with marks, and those letters."""
    pairs = [(chr(c), unicodedata.normalize("NFKD", chr(c))[0]) for c in range(0xC0, 0x250)]
    pairs = [(a, b) for a, b in pairs if a != b and b.isascii() and b.isalpha() and len(unicodedata.normalize("NFD", a)) > 1] + [("ł", "l"), ("Ł", "L")]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


MARKED, PLAIN = _letters()
FOLDED_CONTENT_STOP_WORDS = sorted({w.translate(str.maketrans(MARKED, PLAIN)) for w in CONTENT_STOP_WORDS})


def fold(text: Column) -> Column:
    """Lower case without marks on Latin letters."""
    return F.translate(F.lower(text), MARKED, PLAIN)


def clean(text: Column) -> Column:
    """Without soft hyphens, with plain and single blanks, trimmed; line breaks stay."""
    t = F.regexp_replace(text, "\u00ad", "")
    t = F.regexp_replace(t, "[\u00a0\u2007\u202f\t ]+", " ")
    return F.regexp_replace(F.regexp_replace(t, " *\n *", "\n"), r"(?U)^\s+|\s+$", "")


def collapsed(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")


def content_hash(text: Column) -> Column:
    """SHA-256 of the text in lower case with its white space collapsed: layout does not make a new text."""
    return F.sha2(F.lower(collapsed(text)), 256)


def normalized_for_match(text: Column) -> Column:
    t = F.translate(F.lower(text), "„”“«»‘’–—−", "\"\"\"\"\"''---")
    return collapsed(F.regexp_replace(t, r"-\s*\n\s*", ""))


def search_tokens(text: Column) -> Column:
    """Folded tokens for search: no stop words, one letter only if a digit, numbers whole, others cut to six characters."""
    words = F.regexp_extract_all(fold(text), F.lit("[a-z0-9§]+"), F.lit(0))
    kept = F.filter(words, lambda t: ~t.isin(*dict.fromkeys(STOP_WORDS)) & ((F.length(t) > 1) | t.rlike("[0-9]")))
    return F.transform(kept, lambda t: F.when(t.rlike("^[0-9]"), t).otherwise(F.substring(t, 1, 6)))


def stems(text: Column) -> Column:
    """Folded words cut to five characters; numbers whole."""
    words = F.regexp_extract_all(fold(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.transform(words, lambda t: F.when(t.rlike("^[0-9]"), t).otherwise(F.substring(t, 1, 5)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if one is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(shared, F.size(F.array_union(a, b))), F.lit(0.0)) * F.when((F.size(a) > 0) & (F.size(b) > 0), 1.0).otherwise(0.0)


def normalized_act(act: Column) -> Column:
    t = F.regexp_replace(F.lower(act), r"[\s.]", "")
    return F.when(t.startswith("konstytucj"), "konst").otherwise(t)


def provisions(text: Column) -> Column:
    """References to provisions: array of (article, paragraph, point, act, raw); a range of up to 20 gives each article."""
    # the text is searched once, and the parts of a reference in what was found of it
    part = lambda raw, g: F.regexp_extract(raw, PROVISION, g)
    names = ("first", "last", "paragraph", "point", "act")
    zipped = F.transform(F.regexp_extract_all(text, F.lit(PROVISION), F.lit(0)), lambda raw: F.struct(raw.alias("raw"), *[part(raw, g).alias(n) for g, n in enumerate(names, 1)]))

    def articles(p: Column) -> Column:
        low, high = p["first"].try_cast("int"), p["last"].try_cast("int")
        span = (high > low) & (high - low <= 20)
        many = F.transform(F.sequence(low, F.greatest(high, low)), lambda x: x.cast("string"))
        listed = F.when(p["last"] == "", F.array(F.lower(p["first"]))).when(span, many).otherwise(F.array(F.lower(p["first"]), F.lower(p["last"])))
        none = lambda c: F.when(c != "", c)
        return F.transform(listed, lambda a: F.struct(a.alias("article"), none(p["paragraph"]).alias("paragraph"), none(p["point"]).alias("point"), normalized_act(p["act"]).alias("act"), F.trim(p["raw"]).alias("raw")))

    return F.flatten(F.transform(zipped, articles))


def provision_key(p: Column) -> Column:
    return F.concat(p.act, F.lit(":"), p.article, F.coalesce(F.concat(F.lit("§"), p.paragraph), F.lit("")), F.coalesce(F.concat(F.lit("pkt"), p.point), F.lit("")))


def provision_supported(p: Column, source: Column) -> Column:
    """Whether a source names the article, and the same paragraph, point and act where both name one."""
    same = lambda a, b: a.isNull() | b.isNull() | (a == b)
    return F.exists(source, lambda s: (s.article == p.article) & same(s.paragraph, p.paragraph) & same(s.point, p.point) & ((s.act == "") | (p.act == "") | (s.act == p.act)))


def numbers(text: Column) -> Column:
    """Distinct numbers in digits (comma as point) or as words."""
    digits = F.transform(F.regexp_extract_all(text, F.lit(r"\d+(?:[.,]\d+)?"), F.lit(0)), lambda n: F.replace(n, F.lit(","), F.lit(".")))
    known = F.create_map(*[F.lit(x) for n, forms in NUMBER_WORDS.items() for w in forms.split() for x in (w, str(n))])
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-ząćęłńóśźż]+"), F.lit(0))
    return F.array_distinct(F.concat(digits, F.filter(F.transform(words, lambda w: F.try_element_at(known, w)), lambda n: n.isNotNull())))


def unsupported_facts(claim: Column, source: Column) -> Column:
    """Provisions and numbers of a claim that its source does not have."""
    backed = provisions(source)
    acts = F.transform(F.filter(provisions(claim), lambda p: ~provision_supported(p, backed)), lambda p: p.raw)
    return F.array_distinct(F.concat(acts, F.array_except(numbers(F.regexp_replace(claim, PROVISION, " ")), numbers(source))))


# Fixed value: a sentence is looked for only where one can begin, so a long line without an end is gone over once.
SENTENCE = r"(?<![^.!?;\n])[^.!?;\n]+(?:[.!?;]+|$)"


def sentences(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0)), lambda s: collapsed(s) != "")


def wanted_stems(claim: Column) -> Column:
    """Distinct stems of a claim's content words."""
    stops = F.array(*[F.lit(w) for w in FOLDED_CONTENT_STOP_WORDS])
    words = F.filter(F.regexp_extract_all(fold(claim), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: (F.length(w) >= 3) & ~F.array_contains(stops, w))
    return F.array_distinct(F.transform(words, lambda t: F.when(t.rlike("^[0-9]"), t).otherwise(F.substring(t, 1, 5))))


def closest_passage(claim: Column, text: Column) -> Column:
    """(score, passage): the sentence, or two neighbouring ones at 0.05 less, with the largest share of the claim's content
    stems; null for claims of fewer than three stems or texts without sentences. Ties (to nine digits) go to the earlier and
    shorter one."""

    def best(x: Column) -> Column:
        n = F.size(x.parts)

        def at(i: Column) -> Column:
            share = lambda have: F.size(F.array_intersect(x.want, have)) / F.size(x.want)
            one = F.struct(F.round(share(F.get(x.stems, i)), 9).alias("score"), (-2 * i).alias("order"), F.get(x.parts, i).alias("passage"))
            two = F.struct(F.round(share(F.concat(F.get(x.stems, i), F.get(x.stems, i + 1))) - 0.05, 9).alias("score"), (-2 * i - 1).alias("order"), F.concat(F.get(x.parts, i), F.get(x.parts, i + 1)).alias("passage"))
            return F.when(i + 1 < n, F.array(one, two)).otherwise(F.array(one))

        found = F.array_max(F.flatten(F.transform(F.sequence(F.lit(0), n - 1), at)))
        return F.when((F.size(x.want) >= 3) & (n > 0), F.struct(F.greatest(F.lit(0.0), found.score).alias("score"), collapsed(found.passage).alias("passage")))

    parts = F.transform(F.array(F.struct(wanted_stems(claim).alias("want"), sentences(text).alias("parts"))), lambda x: F.struct(x.want.alias("want"), x.parts.alias("parts"), F.transform(x.parts, stems).alias("stems")))
    return F.get(F.transform(parts, best), F.lit(0))


# Fixed value: a gap is {{c<number>::<answer>}} or {{c<number>::<answer>::<hint>}}.
CLOZE = r"\{\{c(\d+)::(.*?)(?:::(.*?))?\}\}"


def cloze_keys(text: Column) -> Column:
    """Distinct keys of a text's gaps in the order of their numbers."""
    numbers_ = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(CLOZE), F.lit(1)), lambda n: n.cast("int"))))
    return F.transform(numbers_, lambda n: F.concat(F.lit("c"), n.cast("string")))


def cloze_filled(text: Column) -> Column:
    return F.regexp_replace(text, CLOZE, "[$2]")


def plain_word(text: Column) -> Column:
    return collapsed(F.regexp_replace(fold(text), "[^a-z0-9 ]", ""))


def same_word(expected: Column, answer: Column) -> Column:
    """Whether an answer names a word: case, marks, one typo (two from eight letters) or another ending do not matter."""
    e, a = plain_word(expected), plain_word(answer)
    ending = (F.length(e) >= 6) & (F.length(a) >= 6) & (F.substring(e, 1, 5) == F.substring(a, 1, 5))
    typo = F.levenshtein(e, a) <= F.when(F.length(e) >= 8, 2).otherwise(1)
    return F.when(a == "", F.lit(False)).when(e == a, F.lit(True)).when(F.length(e) <= 4, F.lit(False)).otherwise(ending | typo)


# The form of a case number, and what looks like one and is none.
CASE_NUMBER = r"\b((?:[IVX]{1,4}\s+)?(?:[A-Z][A-Za-z]{0,4}(?:p|P)?)\s+\d{1,5}/\d{2})\b"
NO_CASE = r"(?i)^(Dz|U|Art|Poz|Nr|Pkt|Ust|Str|S)\b"


def case_numbers(text: Column) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit(CASE_NUMBER), F.lit(1)), collapsed)
    return F.array_distinct(F.filter(found, lambda s: ~s.rlike(NO_CASE)))


def detected_date(text: Column) -> Column:
    """The first date: 2026-10-06, else 6.10.2026, else day, month name and year; null if it is none that can be."""
    # fixed values: the forms of dates
    iso, local = r"\b(20\d{2})[-_.](\d{1,2})[-_.](\d{1,2})\b", r"\b(\d{1,2})[.\-_/](\d{1,2})[.\-_/](20\d{2})\b"
    named = r"\b(\d{1,2})\s+([a-ząćęłńóśźż]+)\s+(20\d{2})\b"
    g = lambda t, p, i: F.regexp_extract(t, p, i)
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), g(F.lower(text), named, 2))
    plain = F.array_position(F.array(*[F.lit(m.translate(str.maketrans(MARKED, PLAIN))) for m in MONTHS]), g(F.lower(text), named, 2))
    make = lambda y, m, d: F.when(m.cast("int").between(1, 12) & d.cast("int").between(1, 31), F.concat_ws("-", y, F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")))
    word = F.greatest(month, plain)
    return (
        F.when(text.rlike(iso), make(g(text, iso, 1), g(text, iso, 2), g(text, iso, 3)))
        .when(text.rlike(local), make(g(text, local, 3), g(text, local, 2), g(text, local, 1)))
        .when(word > 0, make(g(F.lower(text), named, 3), word, g(F.lower(text), named, 1)))
    )


def interval_label(ms: Column) -> Column:
    """A short label of a span of time."""
    half_up = lambda x: F.floor(x + 0.5)
    minutes = F.greatest(F.lit(1), half_up(ms / 60_000))
    hours, days = half_up(minutes / 60), half_up(half_up(minutes / 60) / 24)
    months, tenths = half_up(days / 30.4), half_up(days / 365 * 10)
    years, rest = tenths / 10, tenths % 10
    # digits of whole numbers, as doubles from ten millions on are written with an exponent
    year_text = F.concat(F.floor(years).cast("string"), F.when(rest > 0, F.concat(F.lit(","), rest.cast("string"))).otherwise(""))
    return (
        F.when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min")))
        .when(hours < 24, F.concat(hours.cast("string"), F.lit(" h")))
        .when(days < 31, F.when(days == 1, F.lit("1 dzień")).otherwise(F.concat(days.cast("string"), F.lit(" dni"))))
        .when(months < 12, F.concat(months.cast("string"), F.lit(" mies.")))
        .otherwise(F.concat(year_text, F.when(years < 2, F.lit(" rok")).when(years < 5, F.lit(" lata")).otherwise(F.lit(" lat"))))
    )


def abstract_from_index(index: Column) -> Column:
    """The text of a map from words to their positions."""
    places = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e.value, lambda p: F.struct(p.alias("at"), e.key.alias("word")))))
    return F.array_join(F.transform(F.array_sort(places), lambda x: x.word), " ")


def estimated_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 2.5)


def same_phrase(expected: Column, answer: Column) -> Column:
    """Whether an answer has three in five of the words (three letters or more) of a phrase; a phrase without such words is
    compared as one word. A null answer is an empty one."""
    answer = F.coalesce(answer, F.lit(""))
    words = lambda x: F.filter(F.split(plain_word(x), " "), lambda w: F.length(w) >= 3)
    want, have = words(expected), words(answer)
    found = F.size(F.filter(want, lambda w: F.exists(have, lambda h: same_word(w, h))))
    return F.when(F.size(want) == 0, same_word(expected, answer)).otherwise(found >= 0.6 * F.size(want))


def recalled(expected: Column, answers: Column) -> Column:
    """For each expected word, whether the answer in its place names it; missing answers are wrong."""
    return F.transform(expected, lambda e, i: same_word(e, F.coalesce(F.get(answers, i), F.lit(""))))


# Codes by their normalised abbreviation: title, usual abbreviation.
CODES = {
    "kc": ("Kodeks cywilny", "k.c."),
    "kk": ("Kodeks karny", "k.k."),
    "kpc": ("Kodeks postępowania cywilnego", "k.p.c."),
    "kpk": ("Kodeks postępowania karnego", "k.p.k."),
    "kro": ("Kodeks rodzinny i opiekuńczy", "k.r.o."),
    "kp": ("Kodeks pracy", "k.p."),
    "kpa": ("Kodeks postępowania administracyjnego", "k.p.a."),
    "ksh": ("Kodeks spółek handlowych", "k.s.h."),
    "kw": ("Kodeks wykroczeń", "k.w."),
    "kkw": ("Kodeks karny wykonawczy", "k.k.w."),
    "konst": ("Konstytucja Rzeczypospolitej Polskiej", "Konstytucja RP"),
}


def act_title(abbreviation: Column) -> Column:
    """The title of a code by its abbreviation in any spelling; null if it is none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for key, (title, _) in CODES.items() for x in (key, title)]), normalized_act(abbreviation))


def act_abbreviation(title: Column) -> Column:
    """The abbreviation of the code that a title names, the longest name first; null if it names none."""
    by_length = sorted(CODES.values(), key=lambda c: -len(c[0]))
    return F.coalesce(*[F.when(F.contains(F.lower(title), F.lit(name.lower())), F.lit(short)) for name, short in by_length])


# What is read out for abbreviations of codes, and patterns of further ones with their words.
SPOKEN_CODES = {
    "k.c.": "kodeksu cywilnego", "k.k.": "kodeksu karnego", "k.p.c.": "kodeksu postępowania cywilnego", "k.p.k.": "kodeksu postępowania karnego",
    "k.r.o.": "kodeksu rodzinnego i opiekuńczego", "k.p.": "kodeksu pracy", "k.p.a.": "kodeksu postępowania administracyjnego",
    "k.s.h.": "kodeksu spółek handlowych", "k.w.": "kodeksu wykroczeń",
}
SPOKEN = {
    r"(?i)\bart\.\s*": "artykuł ", r"§\s*": "paragraf ", r"(?i)\bust\.\s*": "ustęp ", r"(?i)\bpkt\s*": "punkt ", r"\bnp\.": "na przykład",
    r"\bm\.in\.": "między innymi", r"\bitd\.": "i tak dalej", r"\btzw\.": "tak zwany", r"\bSN\b": "Sąd Najwyższy", r"\bTK\b": "Trybunał Konstytucyjny",
}


def spoken(text: Column, more: dict[str, str] | None = None) -> Column:
    """A text for reading aloud, its legal abbreviations in full. more has further patterns with the words for them."""
    for short, full in SPOKEN_CODES.items():
        text = F.replace(text, F.lit(short), F.lit(full))
    for pattern, full in (SPOKEN | (more or {})).items():
        text = F.regexp_replace(text, pattern.replace(r"\s", "[\\s\u00a0\u202f]"), full)
    return collapsed(text)


# How model servers say that a prompt is too long.
CONTEXT_ERROR = r"(?i)context (length|window|size|overflow)|n_ctx|exceeds the (available )?context|prompt is (too )?long|tokens to keep|too many tokens|maximum context"


def is_context_error(message: Column) -> Column:
    return F.coalesce(message.rlike(CONTEXT_ERROR), F.lit(False))


# The generator of the seeded shuffle, whose product is a double, and the mask of its 31 bits.
SHUFFLE_FACTOR, SHUFFLE_STEP, SHUFFLE_MASK = 1103515245, 12345, 0x7FFFFFFF


def shuffled(items: Column, seed: Column) -> Column:
    """An array in an order that a seed fixes; 0 and null are the seed 1. From the last place down, each item changes places with
    one at or before it that the generator names. The same seed gives the same order wherever it runs."""

    def step(s: Column, i: Column) -> Column:
        product = s.x.cast("double") * float(SHUFFLE_FACTOR) + float(SHUFFLE_STEP)
        x = product.cast("bigint").bitwiseAND(F.lit(SHUFFLE_MASK))

        def exchanged(y: Column) -> Column:
            j = F.least(F.floor(y / float(SHUFFLE_MASK) * (i + 1)).cast("int"), i)
            a = s.a
            return F.struct(y.alias("x"), F.transform(a, lambda v, k: F.when(k == i, F.get(a, j)).when(k == j, F.get(a, i)).otherwise(v)).alias("a"))

        return F.get(F.transform(F.array(x), exchanged), F.lit(0))

    first = F.when(F.coalesce(seed, F.lit(0)) == 0, F.lit(1)).otherwise(seed).cast("bigint")
    start = F.struct(first.alias("x"), items.alias("a"))
    return F.when(F.size(items) < 2, items).otherwise(F.aggregate(F.sequence(F.size(items) - 1, F.lit(1), F.lit(-1)), start, step, lambda s: s.a))


def drawn(pool: Column, n: int, seed: Column, avoid: Column) -> Column:
    """n items of a pool in an order that the seed fixes, without those to avoid if enough are left; all, if there are fewer."""
    fresh = F.filter(pool, lambda w: ~F.coalesce(F.array_contains(avoid, w), F.lit(False)))
    return F.slice(shuffled(F.when(F.size(fresh) >= n, fresh).otherwise(pool), seed), 1, n)
