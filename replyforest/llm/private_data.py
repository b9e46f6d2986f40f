"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust their score.

Everything is built-in functions on the row.  Quantifiers are possessive wherever nothing that follows could need
their characters back, so that runs of any length are matched in one pass and without recursion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replyforest.llm.common import text_of

LOCAL = "[A-Za-z0-9._%+-]"
LABEL = "[A-Za-z0-9-]++"
# A match that begins inside a run of characters fails as the run does, so only its start, or the end of the match
# before, is tried.
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{LABEL}(?:\.{LABEL})++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # What may belong to the number is only looked at, so that the next match can begin inside it.
    "iban": r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])))[A-Z]{2}[0-9]{2}",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "secret": r"(?<![A-Za-z0-9])[0-9a-f]{32,128}(?![A-Za-z0-9])",
}
BASE = ("email", "ip", "card", "phone")
KINDS = tuple(PATTERNS)
AHEAD = {"iban": 4}  # characters that a match takes where the proposed span is its group 1
NEEDS = {"email": "@", "phone": "+"}  # characters without which nothing matches; all others need a digit

# A proposed span starts with a score; a checksum and context words before it add to it.
ACCEPTED = 0.6
PROPOSED = {"iban": 0.3, "ssn": 0.4, "secret": 0.4}
CONFIRMED = 0.4
NEARBY = 0.3
NEAR = 40  # characters before a span
CONTEXT = {
    "iban": "iban|account|konto|cuenta|compte|bank",
    "ssn": "ssn|social security|sozialversicherung|seguridad social",
    "secret": "token|secret|key|password|passwd|credential",
}
BLOCK = 256
# Characters of an account number by country.
LENGTHS = "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"


def _running_ends(lengths: Column) -> Column:
    """Running sums of an array, block by block, so that no list is copied more than ``BLOCK`` times."""

    def sums(values: Column, start: Column) -> Column:
        begin = F.struct(F.array().cast("array<bigint>").alias("list"), start.cast("bigint").alias("sum"))

        def add(a: Column, x: Column) -> Column:
            return F.struct(F.concat(a["list"], F.array(a["sum"] + x)).alias("list"), (a["sum"] + x).alias("sum"))

        return F.aggregate(values, begin, add, lambda a: a["list"])

    blocks = F.transform(F.sequence(F.lit(1), F.size(lengths), F.lit(BLOCK)), lambda i: F.slice(lengths, i, BLOCK))
    totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("bigint"), lambda a, x: a + x))
    starts = F.zip_with(sums(totals, F.lit(0)), totals, lambda end, own: end - own)
    return F.flatten(F.zip_with(blocks, starts, sums))


def _matches(kind: str, text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(int(kind in AHEAD)))
    possible = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else F.col("_digit")
    return F.when(possible, found).otherwise(F.array().cast("array<string>"))


def _located(kind: str, text: Column, found: Column) -> Column:
    """The matches with their places in code points; what lies between them tells where they are."""
    taken = lambda v: F.lit(AHEAD[kind]) if kind in AHEAD else F.length(v)
    between = F.slice(F.split(text, PATTERNS[kind], -1), F.lit(1), F.size(found))
    lengths = F.zip_with(between, found, lambda b, v: (F.length(b) + taken(v)).cast("bigint"))
    spans = F.zip_with(
        found,
        _running_ends(lengths),
        lambda v, end: F.struct((end - taken(v)).alias("start"), (end - taken(v) + F.length(v)).alias("end"), v.alias("value")),
    )
    empty = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")
    return F.when(F.size(found) > 0, spans).otherwise(empty)


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the checksum of a card number holds."""
    places = F.transform(
        F.split(F.reverse(digits), ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)),
    )
    return F.aggregate(places, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an account number, its first four characters moved to the end, leaves 1 when divided by 97."""
    plain = F.regexp_replace(value, " ", "")
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    rest = F.aggregate(
        F.split(turned, ""),
        F.lit(0),
        lambda a, c: F.when(c.between("0", "9"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97),
    )
    return F.length(plain).between(15, 34) & (rest == 1)


def account_number(value: Column) -> Column:
    """The part of a proposed span, from its start to a blank or its end, that is an account number; null if none is.

    Of several that pass ``mod97`` the one of its country's length, else the longest.
    """
    parts = F.split(value, " ")
    begins = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), " "))
    country = f"{LENGTHS} "
    own = lambda v: F.contains(F.lit(country), F.concat(F.substring(v, 1, 2), F.length(F.regexp_replace(v, " ", "")).cast("string"), F.lit(" ")))
    right = F.filter(begins, mod97)
    return F.coalesce(F.get(F.filter(right, own), F.lit(0)), F.get(F.reverse(right), F.lit(0)))


def _account_spans(spans: Column) -> Column:
    """Proposed spans cut to their account numbers; without those that have none."""
    cut = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), account_number(s["value"]).alias("value")))
    found = F.filter(cut, lambda s: s["value"].isNotNull())
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), (s["start"] + F.length(s["value"])).alias("end"), s["value"].alias("value")))


def _valid(kind: str, value: Column) -> Column:
    count = F.length(digits_of(value))
    if kind == "ip":
        part = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255)
        return F.forall(F.split(value, r"\."), part)
    if kind == "card":
        return F.when(count.between(14, 19), luhn(digits_of(value))).otherwise(False)
    if kind == "phone":
        return count.between(10, 15)
    return F.lit(True)


def _score(kind: str, text: Column, span: Column) -> Column:
    start = F.greatest(span["start"] - NEAR, F.lit(0)).cast("int")
    before = F.lower(F.substring(text, start + 1, span["start"].cast("int") - start))
    score = F.lit(PROPOSED[kind]) + F.when(before.rlike(CONTEXT[kind]), NEARBY).otherwise(0.0)
    if kind == "iban":
        score = score + CONFIRMED  # the spans are account numbers
    return score


def with_spans(docs: DataFrame, text: str = "text", column: str = "spans") -> DataFrame:
    """``docs`` with an array of ``(start, kind, end, value, score)`` by start, then kind as in ``KINDS``.

    Places are in code points, the end exclusive.  Spans of the kinds in ``BASE`` are the leftmost, non-overlapping
    matches of their patterns that meet the rule of the kind (parts up to 255, 14 to 19 digits with a right checksum,
    10 to 15 digits); a match that fails is dropped with its characters.  The others need a score of ``ACCEPTED``.
    An account number may be followed or preceded by words that look like groups of it; every start is tried.
    Kinds may overlap, and so may account numbers.  Null and empty texts have no spans; an empty table stays empty; ``kind`` is a number; a
    column of the result's name is replaced.
    """
    # The row travels as one column, so that no name of its own can clash with those used here.
    found = docs.select(F.struct("*").alias("own"), text_of(F.col(f"`{text}`")).alias("_text"))
    found = found.select("*", F.col("_text").rlike("[0-9]").alias("_digit"))
    found = found.select("*", *[_matches(k, F.col("_text")).alias(f"_{k}") for k in KINDS])
    located = found.select("*", *[_located(k, F.col("_text"), F.col(f"_{k}")).alias(f"_at_{k}") for k in KINDS])
    located = located.withColumn("_at_iban", _account_spans(F.col("_at_iban")))

    def kept(place: int, kind: str) -> Column:
        if kind in BASE:
            spans = F.filter(F.col(f"_at_{kind}"), lambda s: _valid(kind, s["value"]))
            score = lambda s: F.lit(1.0)
        else:
            spans = F.filter(F.col(f"_at_{kind}"), lambda s: _score(kind, F.col("_text"), s) >= ACCEPTED)
            score = lambda s: _score(kind, F.col("_text"), s)
        return F.transform(
            spans,
            lambda s: F.struct(
                s["start"].alias("start"), F.lit(place).alias("kind"), s["end"].alias("end"), s["value"].alias("value"), score(s).alias("score")
            ),
        )

    spans = F.array_sort(F.concat(*[kept(i, k) for i, k in enumerate(KINDS)]))
    fields = [F.col("own")[name].alias(name) for name in docs.columns if name != column]
    return located.select(*fields, spans.alias(column))


def listed(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def count_of(kind: str, spans: Column) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("bigint")


def base_spans(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["kind"] < len(BASE))


def redacted(text: Column, spans: Column) -> Column:
    """The text with ``[KIND]`` in place of every span; of overlapping spans the later one only where it goes on."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    begin = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).cast("bigint").alias("done"))

    def put(a: Column, s: Column) -> Column:
        between = F.substring(text, (a["done"] + 1).cast("int"), F.greatest(s["start"] - a["done"], F.lit(0)).cast("int"))
        fresh = s["start"] >= a["done"]
        parts = F.when(fresh, F.concat(a["parts"], F.array(between, names[s["kind"]]))).otherwise(a["parts"])
        return F.struct(parts.alias("parts"), F.greatest(a["done"], s["end"]).alias("done"))

    def end(a: Column) -> Column:
        rest = F.substring(text, (a["done"] + 1).cast("int"), F.length(text))
        return F.concat(F.array_join(a["parts"], ""), rest)

    return F.when(F.size(spans) > 0, F.aggregate(spans, begin, put, end)).otherwise(text)


def find_private_data(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: the id, the numbers of base spans, their digest, and all spans listed."""
    plain = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    found = with_spans(plain)
    base = F.sha2(listed(base_spans(F.col("spans"))).cast("binary"), 256)
    counts = [count_of(k, F.col("spans")).alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, base.alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def without_private_data(docs: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """``docs`` with their spans replaced; where that changed a text, ``length`` tells its new number of characters."""
    own = docs.select(F.struct("*").alias("own"), F.col(f"`{text}`").alias("text"))
    found = with_spans(own, "text", "spans")
    clean = found.withColumn("clean", redacted(F.col("text"), F.col("spans")))
    columns = {text: F.col("clean")}
    if length in docs.columns:
        count = F.length("clean").cast(docs.schema[length].dataType)
        columns[length] = F.when(F.size("spans") > 0, count).otherwise(F.col("own")[length])
    return clean.select(*[columns.get(c, F.col("own")[c]).alias(c) for c in docs.columns])
