"""Secret scans: fixed formats by regular expression and, over candidate strings, sliding-window Shannon entropy.

DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptoria.llm.common import fresh

# The base kinds in the order in which ties are listed: pattern, group that is measured, characters it needs.
BASE_KINDS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]{12,}", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),
}

#: Candidates of the entropy scan: long runs of the characters that keys are made of.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Characters in a window.
WINDOW = 20
#: Bits a character that some window must reach, by the class of the candidate's characters.
THRESHOLDS = {"hex": 3.0, "alnum": 3.6, "base64": 3.75}
#: Stretches that are no secrets and are taken out of a candidate before what is left of it is judged: UUIDs, labelled digests,
#: lower-case path parts, a much quoted sample key, and the usual placeholders. No group is repeated, so no
#: stack grows with a run, and letters before a slash are bounded, so that no run is read again from each of its places.
STRETCHES = (
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    r"(?i:sha1|sha256|sha384|sha512|md5|digest|integrity|checksum|etag)[-_=][A-Za-z0-9+/]{16,}={0,2}",
    r"[a-z]{2,40}/[a-z]{2,40}/",
    r"wJalrXUtnFEMI/K7MDENG/bPxRfiCY",
    r"(?i:example|placeholder|changeme|dummy|sample|xxxx|your[-_]|0123456789|abcdefgh)",
)
STRETCH = "|".join(STRETCHES)
#: What is left of a candidate is no secret if it has no digits, or nothing but digits.
ALLOWED = (r"^[A-Za-z_=/+-]+$", r"^[0-9_=/+-]+$")

SPAN = "struct<start:int,listed:int,end:int,kind:string>"
#: Code points in the blocks that texts are cut into before stretches of them are taken.
BLOCK = 4096


def running(values: Column, both) -> Column:
    """The running result of an associative function over an array, itself included: ever longer steps double what each
    place has taken in, so n places cost n log n."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(values).cast("double"))).cast("int"))

    def double(a: Column, p: Column) -> Column:
        far = F.pow(F.lit(2), p).cast("int")
        return F.transform(a, lambda x, i: F.when(i >= far, both(x, F.get(a, i - far))).otherwise(x))

    return F.when(F.size(values) < 2, values).otherwise(F.aggregate(steps, values, double))


def bound_to(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def spans_of(text: Column, kind: str, listed: int, pattern: str, group: int, least: int, keep=None) -> Column:
    """The spans of a pattern's matches whose group has `least` characters: from 0, end exclusive, in code points.

    Matches are leftmost and do not overlap. The pieces between them, which split() gives, and running sums tell where
    each one starts; only texts with a match are split. keep takes a match and says whether it counts.
    """

    def placed(found: Column) -> Column:
        lengths = F.transform(found.m, lambda m, i: F.length(F.get(found.gaps, i)) + F.length(m))

        def span(end: Column, i: Column) -> Column:
            good = F.length(F.get(found.part, i)) >= least
            good = good & keep(F.get(found.m, i)) if keep else good
            made = F.struct((end - F.length(F.get(found.m, i))).alias("start"), F.lit(listed).alias("listed"), end.alias("end"), F.lit(kind).alias("kind"))
            return F.when(good, made)

        return F.filter(bound_to(running(lengths, lambda x, y: x + y), lambda ends: F.transform(ends, span)), lambda s: s.isNotNull())

    def split_at(m: Column) -> Column:
        part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else m
        return bound_to(F.struct(m.alias("m"), F.split(text, pattern, -1).alias("gaps"), part.alias("part")), placed)

    matches = F.filter(F.array(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), lambda m: F.size(m) > 0)
    return F.flatten(F.transform(matches, split_at)).cast(f"array<{SPAN}>")


def with_stretches_replaced(text: Column, spans: Column, filler) -> Column:
    """The text with filler(span, covered from) for each stretch that spans, sorted by their start, cover.

    covered from is where the span's own part begins, after all earlier spans' ends. The text is cut into blocks by one
    pass, so a stretch is found without counting from the text's start.
    """

    def between(blocks: Column, a: Column, b: Column) -> Column:
        first, last = F.floor(a / BLOCK).cast("int"), F.floor((b - 1) / BLOCK).cast("int")
        one = F.substr(F.get(blocks, first), a % BLOCK + 1, b - a)
        head, tail = F.substr(F.get(blocks, first), a % BLOCK + 1), F.substr(F.get(blocks, last), F.lit(1), (b - 1) % BLOCK + 1)
        inner = F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
        return F.when(a >= b, F.lit("")).when(first == last, one).otherwise(F.concat(head, inner, tail))

    def replaced(x: Column) -> Column:
        def piece(s: Column, i: Column) -> Column:
            before = F.coalesce(F.when(i > 0, F.get(x.ends, i - 1)), F.lit(0))
            return F.concat(between(x.blocks, before, s.start), filler(s, F.greatest(before, s.start), before))

        rest = between(x.blocks, F.element_at(x.ends, -1), F.length(text))
        return F.concat(F.array_join(F.transform(spans, piece), ""), rest)

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    ends = running(F.transform(spans, lambda s: s.end), F.greatest)
    return F.when(F.size(spans) > 0, bound_to(F.struct(blocks.alias("blocks"), ends.alias("ends")), replaced)).otherwise(text)


def blanked(text: Column, spans: Column) -> Column:
    """The text with a blank for each character that spans cover: what is left keeps its place."""
    return with_stretches_replaced(text, spans, lambda s, begins, _: F.repeat(F.lit(" "), F.greatest(s.end - begins, F.lit(0))))


def class_bits(candidate: Column) -> Column:
    """The threshold of a candidate's character class."""
    return (
        F.when(candidate.rlike(r"^[0-9a-fA-F-]+$"), F.lit(THRESHOLDS["hex"]))
        .when(candidate.rlike(r"^[A-Za-z0-9]+$"), F.lit(THRESHOLDS["alnum"]))
        .otherwise(F.lit(THRESHOLDS["base64"]))
    )


def window_entropy(candidate: Column, window: int = WINDOW) -> Column:
    """The largest Shannon entropy, in bits a character, of the candidate's windows of `window` (at most 31) characters.

    One pass: a count of five bits for each character code ('+' to 'z'), twelve counts in a long, and the sum of c*log2(c)
    over the counts, both brought up to date by the character that comes in and the one that goes out. Shorter candidates
    have one window, all of them.
    """
    if window > 31:
        raise ValueError("counts have five bits, so a window has at most 31 characters")
    terms = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])
    size = F.least(F.length(candidate), F.lit(window))

    def over(bound: Column) -> Column:
        def place(i: Column) -> Column:
            code = F.ascii(F.get(bound.chars, i)) - 43
            return F.struct(F.floor(code / 12).cast("int").alias("word"), (code % 12 * 5).alias("shift"))

        def step(state: Column, i: Column) -> Column:
            def moved(x: Column) -> Column:
                def count(p: Column) -> Column:
                    return F.call_function("shiftright", F.get(state.counts, p.word), p["shift"]).bitwiseAND(F.lit(31)).cast("int")

                stays = x.come.eqNullSafe(x.gone)
                bit = lambda p, at: F.when(p.word == at, F.call_function("shiftleft", F.lit(1).cast("long"), p["shift"])).otherwise(F.lit(0).cast("long"))
                changed = F.transform(state.counts, lambda c, at: c + bit(x.come, at) - bit(x.gone, at))
                up = F.get(terms, count(x.come) + 1) - F.get(terms, count(x.come))
                down = F.when(x.gone.isNull(), F.lit(0.0)).otherwise(F.get(terms, count(x.gone)) - F.get(terms, count(x.gone) - 1))
                total = F.when(stays, state.total).otherwise(state.total + up - down)
                bits = F.log2(bound.size.cast("double")) - total / bound.size
                best = F.when(i >= bound.size - 1, F.greatest(state.best, bits)).otherwise(state.best)
                return F.struct(F.when(stays, state.counts).otherwise(changed).alias("counts"), total.alias("total"), best.alias("best"))

            gone = F.when(i >= window, place(i - window))
            return bound_to(F.struct(place(i).alias("come"), gone.alias("gone")), moved)

        start = F.struct(F.array_repeat(F.lit(0).cast("long"), 7).alias("counts"), F.lit(0.0).alias("total"), F.lit(0.0).alias("best"))
        return F.aggregate(F.sequence(F.lit(0), F.size(bound.chars) - 1), start, step, lambda s: s.best)

    chars = F.filter(F.split(candidate, "", -1), lambda c: c != "")
    return bound_to(F.struct(chars.alias("chars"), size.alias("size")), over)


def looks_random(candidate: Column) -> Column:
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | candidate.rlike(pattern)
    return F.when(allowed, F.lit(False)).otherwise(window_entropy(candidate) >= class_bits(candidate))


def find_secrets(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df and secret_spans: array of (start, listed, end, kind), sorted by start and then by the kinds' order.

    Kinds are those of BASE_KINDS and then `entropy`: candidates are what is left of the long runs once the base spans and
    the stretches that the allow-list knows are taken out, so a harmless part does not hide a secret that is glued to it;
    one is a secret if some window reaches its class's threshold. Base spans always stay, those that overlap a span of
    another kind too. Null and empty texts have no spans; offsets are code points of the whole text, of any length. A
    column secret_spans is replaced. Rows are handled one by one, repeated ones each for itself; an empty frame gives an
    empty one; nothing is shuffled.
    """
    text = F.coalesce(df[text_col].cast("string"), F.lit(""))
    base, plain = fresh(df, "base_spans", "plain_text")
    parts = [spans_of(text, kind, i, *rule) for i, (kind, rule) in enumerate(BASE_KINDS.items())]
    out = df.withColumn(base, F.array_sort(F.concat(*parts)))
    # only texts with a long run are read again
    out = out.withColumn(plain, F.when(text.rlike(CANDIDATE), blanked(text, F.col(base))))
    known = spans_of(F.col(plain), "allowed", 0, STRETCH, 0, 1)
    out = out.withColumn(plain, bound_to(known, lambda spans: blanked(F.col(plain), spans)))
    added = spans_of(F.col(plain), "entropy", len(BASE_KINDS), CANDIDATE, 0, 20, looks_random)
    nothing = F.array().cast(f"array<{SPAN}>")
    return out.withColumn("secret_spans", F.array_sort(F.concat(F.col(base), F.coalesce(added, nothing)))).drop(base, plain)


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def base_only(spans: Column) -> Column:
    return F.filter(spans, lambda s: s.listed < len(BASE_KINDS))


def of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: s.kind == kind)


def redact(df: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """df with each stretch of text that spans cover replaced by the mark; other texts, null ones too, stay as they are.
    Spans that overlap are one stretch. Repeated rows are treated alike, and an empty frame gives an empty one."""
    (spans,) = fresh(df, "found_spans")
    # a user's column secret_spans stays as it is
    ours = df.withColumnsRenamed({c: f"{spans}_of_{c}" for c in df.columns if c.lower() == "secret_spans"})
    found = find_secrets(ours, text_col).withColumnRenamed("secret_spans", spans)
    clean = with_stretches_replaced(ours[text_col], F.col(spans), lambda s, _, before: F.when(s.start >= before, F.lit(mark)).otherwise(F.lit("")))
    return found.withColumn(text_col, F.when(F.size(spans) > 0, clean).otherwise(ours[text_col])).drop(spans).select(*ours.columns).toDF(*df.columns)
