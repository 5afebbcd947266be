"""Personal data: regular expressions propose spans, checksums confirm them, and words nearby adjust their scores.

DataFrame functions only.
"""

from __future__ import annotations

import string
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptoria.llm.common import fresh
from scriptoria.llm.secrets import blanked, bound_to, running, with_stretches_replaced

#: Code points before and after a candidate, up to the next candidate of its pattern, in which words are looked for.
CONTEXT = 40
#: Hundredths that a word nearby gives or takes, and those that a span of an added kind must have.
WORD_GAIN, ENOUGH = 20, 60
SPAN = "struct<start:int,listed:int,end:int,kind:string,score:double>"

# Letters and digits of an account number by country, from the public IBAN registry.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24,
    "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28,
    "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20,
    "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29,
    "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26,
    "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}

ABOUT_PHONES = ("phone", "telephone", "tel", "call", "mobile", "cell", "fax", "telefon", "telefono", "handy", "portable", "movil", "whatsapp")
ABOUT_NUMBERS = ("order", "invoice", "isbn", "serial", "tracking", "version", "part")


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def characters(text: Column) -> Column:
    return F.filter(F.split(text, "", -1), lambda c: c != "")


def passes_luhn(digits: Column) -> Column:
    """Whether digits have a right last digit: every second one from the right counts twice, and the sum ends in 0."""

    def worth(c: Column, i: Column) -> Column:
        value = c.cast("int")
        return F.when(i % 2 == 0, value).when(value > 4, 2 * value - 9).otherwise(2 * value)

    total = F.aggregate(F.transform(characters(F.reverse(digits)), worth), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def remainder_97(code: Column) -> Column:
    """The remainder by 97 of digits and capital letters, letters read as 10 to 35."""

    def step(rest: Column, c: Column) -> Column:
        return F.when(c >= "A", (rest * 100 + F.ascii(c) - 55) % 97).otherwise((rest * 10 + F.ascii(c) - 48) % 97)

    return F.aggregate(characters(code), F.lit(0), step)


def parts_up_to_255(match: Column) -> Column:
    def small(part: Column) -> Column:
        value = F.ltrim(part, F.lit("0"))
        return (F.length(value) < 3) | ((F.length(value) == 3) & (value <= "255"))

    return F.forall(F.split(match, r"\.", -1), small)


def _card(match: Column) -> Column:
    return bound_to(digits_of(match), lambda d: F.when(F.length(d).between(12, 19), passes_luhn(d)).otherwise(False))


def _phone(match: Column) -> Column:
    return F.length(digits_of(match)).between(9, 15)


def _iban_size(match: Column) -> Column:
    """Characters of the account number that begins a candidate, by its country; null for unknown countries."""
    lengths = F.create_map(*[F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair])
    whole = F.try_element_at(lengths, F.left(match, F.lit(2)))
    return F.when(F.substring(match, 5, 1) == " ", whole + F.ceil(whole / 4).cast("int") - 1).otherwise(whole)


def _iban(match: Column) -> Column:
    return bound_to(F.replace(match, F.lit(" "), F.lit("")), lambda c: remainder_97(F.concat(F.substr(c, F.lit(5)), F.left(c, F.lit(4)))) == 1)


def _nir(match: Column) -> Column:
    d = digits_of(match)
    return F.substring(d, 4, 2).between("01", "12") & (97 - F.left(d, F.lit(13)).cast("long") % 97 == F.right(d, F.lit(2)).cast("long"))


def _ssn(match: Column) -> Column:
    area = F.left(match, F.lit(3))
    return ~area.isin("000", "666") & (area < "900") & (F.substring(match, 5, 2) != "00") & (F.right(match, F.lit(4)) != "0000")


@dataclass(frozen=True)
class Kind:
    """pattern proposes matches, confirmed() says which of them count, prior is their score in hundredths before words nearby.
    size() gives how much of a match counts, null for none of it. No character of `apart` may stand next to it."""

    pattern: str
    prior: int
    confirmed: Callable[[Column], Column] = lambda m: F.lit(True)
    helped_by: tuple[str, ...] = ()
    hurt_by: tuple[str, ...] = ()
    apart: str = ""
    size: Callable[[Column], Column] = field(default=F.length)
    #: The pattern as a regular expression without look-behind or possessive repeats, for other engines.
    plain: str = ""


# Patterns repeat groups possessively, so a match needs no stack, and begin where a run of their characters begins (or where the
# last match has ended), so no run is read again from each of its places. Neither changes what is matched.
BASE_KINDS = {
    "email": Kind(
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        90,
        plain=r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    ),
    "ip": Kind(
        r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        60,
        parts_up_to_255,
        ("ip", "ipv", "host", "server", "address", "adresse", "login", "client"),
        ("version", "release", "ver", "v", "section", "chapter"),
        plain=r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    ),
    "card": Kind(
        r"[0-9](?:[\x20-]?[0-9])++",
        70,
        _card,
        ("card", "visa", "mastercard", "credit", "debit", "cvv", "karte", "kreditkarte", "carte", "tarjeta"),
        ABOUT_NUMBERS,
        plain=r"[0-9]([\x20-]?[0-9])+",
    ),
    "phone": Kind(r"\+[0-9][\x20().0-9-]+[0-9]", 80, _phone, ABOUT_PHONES, ABOUT_NUMBERS),
}
#: Account numbers are found beside base spans, the last three only in what base spans and account numbers leave.
BESIDE_BASE = {
    "iban": Kind(
        r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)",
        80,
        _iban,
        ("iban", "account", "bank", "konto", "compte", "cuenta"),
        ABOUT_NUMBERS,
        "A-Za-z0-9",
        _iban_size,
    ),
}
IN_THE_REST = {
    "nir": Kind(r"[12](?:\x20?[0-9]){14}", 60, _nir, ("insee", "nir", "sociale", "vitale"), ABOUT_NUMBERS, "0-9"),
    "ssn": Kind(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", 40, _ssn, ("ssn", "social", "security", "taxpayer"), ABOUT_NUMBERS, "0-9-"),
    "local_phone": Kind(r"[0-9(](?:[\x20()./-]{0,2}[0-9]){6,14}", 40, helped_by=ABOUT_PHONES, hurt_by=ABOUT_NUMBERS, apart="0-9"),
}
KINDS = BASE_KINDS | BESIDE_BASE | IN_THE_REST


def word_pattern(words: tuple[str, ...]) -> str:
    return f"(^|[^a-z])({'|'.join(words)})([^a-z]|$)"


def candidates(text: Column, pattern: str) -> Column:
    """A pattern's matches: array of (match, start, before, after), before and after being what stands around a match, up to
    CONTEXT code points and up to the next match. Matches are leftmost and do not overlap; running sums of the pieces between
    them tell where each one starts, so a text is read once whatever it holds."""

    def placed(found: Column) -> Column:
        def made(end: Column, i: Column) -> Column:
            m = F.get(found.m, i)
            before, after = F.right(F.get(found.gaps, i), F.lit(CONTEXT)), F.left(F.coalesce(F.get(found.gaps, i + 1), F.lit("")), F.lit(CONTEXT))
            return F.struct(m.alias("match"), (end - F.length(m)).alias("start"), before.alias("before"), after.alias("after"))

        lengths = F.transform(found.m, lambda m, i: F.length(F.get(found.gaps, i)) + F.length(m))
        return bound_to(running(lengths, lambda x, y: x + y), lambda ends: F.transform(ends, made))

    matches = F.filter(F.array(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), lambda m: F.size(m) > 0)
    return F.flatten(F.transform(matches, lambda m: bound_to(F.struct(m.alias("m"), F.split(text, pattern, -1).alias("gaps")), placed)))


def spans_of(text: Column, name: str) -> Column:
    """The spans of a kind: candidates that are confirmed and, for the added kinds, whose score is enough."""
    kind, listed = KINDS[name], list(KINDS).index(name)

    def span(c: Column) -> Column:
        size = kind.size(c.match)
        good = size.isNotNull() & (size <= F.length(c.match))
        if kind.apart:
            tail = F.concat(F.substr(c.match, size + 1), c.after)
            good = good & ~c.before.rlike(f"[{kind.apart}]$") & ~tail.rlike(f"^[{kind.apart}]")
        good = F.when(good, kind.confirmed(F.substr(c.match, F.lit(1), size) if kind.size is not F.length else c.match)).otherwise(False)
        around = F.translate(F.concat(c.before, F.lit(" "), c.after), string.ascii_uppercase, string.ascii_lowercase)
        score = F.lit(kind.prior)
        for words, gain in ((kind.helped_by, WORD_GAIN), (kind.hurt_by, -WORD_GAIN)):
            if words:
                score = score + F.when(around.rlike(word_pattern(words)), F.lit(gain)).otherwise(F.lit(0))
        score = F.least(score, F.lit(100))
        if name not in BASE_KINDS:
            good = good & (score >= ENOUGH)
        made = F.struct(c.start.alias("start"), F.lit(listed).alias("listed"), (c.start + size).alias("end"), F.lit(name).alias("kind"), (score / 100).alias("score"))
        return F.when(good, made)

    return F.filter(F.transform(candidates(text, kind.pattern), span), lambda s: s.isNotNull()).cast(f"array<{SPAN}>")


def find_pii(df: DataFrame, text_col: str = "text", span_col: str = "pii_spans") -> DataFrame:
    """df and span_col: array of (start, listed, end, kind, score), sorted by start and then by the kinds' order.

    Kinds are those of KINDS. E-mail addresses, IP addresses with parts up to 255, card numbers that pass Luhn and phone
    numbers of 9 to 15 digits are base spans: they stay whatever their score and whatever overlaps them. Account numbers are
    confirmed by country, length and the remainder by 97, French insurance numbers by theirs; insurance and phone numbers
    without a checksum need a word nearby that speaks for them. Words nearby raise or lower every score.

    Null and empty texts have no spans; offsets are code points of the whole text, of any length. A column span_col is
    replaced, other columns stay. Rows are handled one by one, repeated ones each for itself; an empty frame gives an empty
    one; nothing is shuffled.
    """
    text = F.coalesce(df[text_col].cast("string"), F.lit(""))
    first, rest = fresh(df, "first_spans", "rest_of_text")
    # a text without the one character that a kind cannot do without is not searched for it
    holds = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+")), "ip": text.rlike(r"[0-9]\.[0-9]"), "iban": text.rlike("[A-Z]{2}[0-9]{2}")}
    nothing = F.array().cast(f"array<{SPAN}>")
    found = [F.when(holds[k], spans_of(text, k)).otherwise(nothing) if k in holds else spans_of(text, k) for k in BASE_KINDS | BESIDE_BASE]
    out = df.withColumn(first, F.array_sort(F.concat(*found)))
    out = out.withColumn(rest, F.when(text.rlike("|".join(KINDS[k].pattern for k in IN_THE_REST)), blanked(text, F.col(first))))
    more = [F.coalesce(spans_of(F.col(rest), k), nothing) for k in IN_THE_REST]
    return out.withColumn(span_col, F.array_sort(F.concat(F.col(first), *more))).drop(first, rest)


def base_only(spans: Column) -> Column:
    return F.filter(spans, lambda s: s.listed < len(BASE_KINDS))


def mask_pii(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with each stretch of text that spans cover replaced by its kind in capitals and brackets, as in [EMAIL].

    Stretches that overlap are one, named by the span that starts first. Null and empty texts stay as they are, repeated
    rows are treated alike, other columns stay, an empty frame gives an empty one.
    """
    (spans,) = fresh(df, "spans_to_mask")
    found = find_pii(df, text_col, spans)
    mark = lambda s, _, before: F.when(s.start >= before, F.concat(F.lit("["), F.upper(s.kind), F.lit("]"))).otherwise(F.lit(""))
    masked = with_stretches_replaced(F.col(text_col), F.col(spans), mark)
    return found.withColumn(text_col, F.when(F.size(spans) > 0, masked).otherwise(F.col(text_col))).select(*df.columns)
