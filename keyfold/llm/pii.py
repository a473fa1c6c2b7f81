"""Personal data in texts: patterns propose spans, checksums confirm them, nearby words adjust the score.

All of it is Spark SQL functions. A pattern's matches come from ``regexp_extract_all`` and what lies
between them from ``split``; the running sum of both lengths gives the positions in code points.
Patterns use possessive quantifiers wherever nothing follows that could need a retry: the matches
are the same, and neither the stack nor the time grows with the square of a long run.

Cases: a null text counts as empty and has no spans; repeated rows give repeated results; other
columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyfold.session import write_stage

# Code points looked at on either side of a proposed span for context words.
CONTEXT = 48
# Code points in a piece of text that context is read from, more than CONTEXT.
PIECE = 1024
# Score from which a proposed span counts.
ACCEPT = 0.6


@dataclass(frozen=True)
class Kind:
    """One kind of personal data.

    base: score of a proposal that passes its checks; context adds ``bonus`` to it.
    words: lower-case pattern of context words. check: name of the checks in ``_valid``.
    """

    name: str
    pattern: str
    base: float
    bonus: float = 0.3
    words: str = ""


# Kinds whose proposals count on their checks alone.
BASE_KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9,
         words=r"e-?mail|contact|write|correo|kontakt|courriel"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)", 0.7,
         words=r"\bip\b|host|server|address|login"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", 0.8, words=r"card|visa|master|credit|karte|tarjeta|carte"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0.7, words=r"phone|tel|call|mobile|fax|anruf"),
)
# Kinds that the method adds: an account number stands on its mod-97 check, the weaker proposals
# (a short card number, a number without country code) need a context word nearby.
ADDED_KINDS = (
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])", 0.8,
         words=r"iban|account|konto|bank|cuenta|compte"),
    Kind("card_short", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,14}+(?![\x20-]?[0-9])", 0.4,
         words=r"card|visa|master|amex|credit|karte|tarjeta|carte"),
    Kind("phone_local", r"(?<![0-9+])(?<![0-9+][\x20().-])\(?[0-9]{2,4}\)?(?:[\x20.-][0-9]{2,4}){2,4}+(?![\x20.-]?[0-9])", 0.4,
         words=r"phone|\btel|call|mobile|fax|anruf|tel[eé]fono"),
)


def _bind(value: Column, use) -> Column:
    """Evaluate ``value`` once however often ``use`` mentions it."""
    return F.transform(F.array(value), use)[0]


def _matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, found) of the leftmost non-overlapping matches, in code points.

    Positions are running sums. Appending to an array copies it, so the sums are taken in blocks of the
    root of the number of matches, within each block and over the blocks.
    """
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"),
                    F.split(text, pattern, -1).alias("g"))
    spans = "array<struct<start:bigint,end:bigint,found:string>>"
    zero = lambda kind: F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(kind).alias("out"))

    def span(start: Column, end: Column, found: Column) -> Column:
        return F.struct(start.cast("bigint").alias("start"), end.cast("bigint").alias("end"), found.alias("found"))

    def within(block: Column) -> Column:
        start = lambda acc, p: acc["at"] + F.length(p["g"])
        end = lambda acc, p: start(acc, p) + F.length(p["m"])
        return F.aggregate(block, zero(spans), lambda acc, p: F.struct(
            end(acc, p).cast("bigint").alias("at"),
            F.concat(acc["out"], F.array(span(start(acc, p), end(acc, p), p["m"]))).alias("out")))

    def over(blocks: Column) -> Column:
        moved = lambda acc, b: F.transform(
            b["out"], lambda s: span(acc["at"] + s["start"], acc["at"] + s["end"], s["found"]))
        return F.flatten(F.aggregate(blocks, zero(f"array<{spans}>"), lambda acc, b: F.struct(
            (acc["at"] + b["at"]).alias("at"), F.concat(acc["out"], F.array(moved(acc, b))).alias("out")),
            lambda acc: acc["out"]))

    def walk(b: Column) -> Column:
        return _bind(F.arrays_zip(b["m"].alias("m"), F.slice(b["g"], 1, F.size(b["m"])).alias("g")), in_blocks)

    def in_blocks(pairs: Column) -> Column:
        size = F.greatest(F.ceil(F.sqrt(F.size(pairs))), F.lit(1)).cast("int")
        count = F.greatest(F.ceil(F.size(pairs) / size), F.lit(1)).cast("int")
        return over(F.transform(F.sequence(F.lit(1), count), lambda i: within(
            F.slice(pairs, (i - 1) * size + 1, size))))

    return _bind(both, walk)


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(
        i % 2 == 0, c.try_cast("int")).otherwise((c.try_cast("int") * 2) % 10 + F.floor(c.try_cast("int") / 5).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number, without spaces, leaves 1 when divided by 97 in the standard way."""
    moved = F.concat(F.substr(account, F.lit(5)), F.substr(account, F.lit(1), F.lit(4)))
    value = lambda c: F.when(c.rlike("[0-9]"), c.try_cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: (
        a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97) == 1


def _valid(kind: Kind, found: Column) -> Column:
    digits = _digits(found)
    if kind.name == "email":
        return F.lit(True)
    if kind.name == "ip":
        return F.forall(F.split(found, r"\."), lambda p: (
            F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(p.try_cast("bigint"), F.lit(999)) <= 255))
    if kind.name == "card":
        return _bind(digits, lambda d: F.when(F.length(d).between(16, 19), luhn(d)).otherwise(False))
    if kind.name == "card_short":
        return _bind(digits, lambda d: F.when(F.length(d).between(13, 15), luhn(d)).otherwise(False))
    if kind.name == "phone":
        return F.length(digits).between(8, 15)
    if kind.name == "phone_local":
        return F.length(digits).between(7, 12)
    if kind.name == "iban":
        return _bind(F.replace(found, F.lit(" "), F.lit("")), lambda a: F.when(
            F.length(a).between(15, 34), mod97(a)).otherwise(False))
    raise ValueError(kind.name)


def _context(pieces: Column, span: Column) -> Column:
    """Lower-case text around a span, from the pieces of a text, so that none is counted from its beginning."""
    def near(start: Column, length: Column) -> Column:
        at = F.floor(start / PIECE).cast("int")
        joined = F.concat(*[F.coalesce(F.get(pieces, at + i), F.lit("")) for i in (0, 1)])
        return F.substr(joined, (start % PIECE + 1).cast("int"), length)

    before = F.greatest(span["start"] - CONTEXT, F.lit(0))
    return F.lower(F.concat(near(before, (span["start"] - before).cast("int")), F.lit(" "),
                            near(span["end"], F.lit(CONTEXT))))


def _spans(text: Column, kind: Kind) -> Column:
    """Confirmed spans of a kind, each with its score."""
    valid = F.filter(_matches(text, kind.pattern), lambda s: _valid(kind, s["found"]))
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    scored = lambda spans, parts: F.transform(spans, lambda s: F.struct(
        F.lit(kind.name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
        F.least(F.lit(1.0), F.lit(kind.base) + F.when(
            _context(parts, s).rlike(kind.words), kind.bonus).otherwise(0.0)).alias("score")))
    # Only a text with spans is cut into pieces.
    found = _bind(valid, lambda v: _bind(
        F.when(F.size(v) > 0, pieces).otherwise(F.array().cast("array<string>")), lambda parts: scored(v, parts)))
    return F.filter(found, lambda s: s["score"] >= ACCEPT)


def find_personal_data(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id, base, added)``: arrays of (kind, start, end, score), positions in code points.

    ``base`` holds e-mail addresses, IP addresses, card and phone numbers in this order of kinds and
    by start within each. ``added`` holds account numbers with a valid checksum, and short card
    numbers and local phone numbers that stand near a word which explains them; an added span that
    overlaps a base one is left out.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(F.col(id_column), text.alias("_text"))
    # The few spans are written, so that what follows reads them and repeats no matching.
    found = write_stage(rows.select(id_column, *[
        _spans(F.col("_text"), k).alias(k.name) for k in BASE_KINDS + ADDED_KINDS]), "spans")
    base = F.concat(*[F.col(k.name) for k in BASE_KINDS])
    both = found.select(id_column, base.alias("base"), F.concat(*[F.col(k.name) for k in ADDED_KINDS]).alias("added"))
    apart = F.filter("added", lambda a: ~F.exists(
        "base", lambda b: (a["start"] < b["end"]) & (b["start"] < a["end"])))
    return both.select(id_column, "base", apart.alias("added"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data_digest(docs: DataFrame) -> DataFrame:
    """Counts by base kind, digest of the base spans, and the list of all spans, per document."""
    found = find_personal_data(docs.select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return found.select(
        "doc_id", *[count(k.name) for k in BASE_KINDS],
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.concat("base", "added")).alias("spans"),
        F.round(F.aggregate(F.concat("base", "added"), F.lit(0.0), lambda a, s: F.greatest(a, s["score"])), 6)
        .alias("top_score"))
