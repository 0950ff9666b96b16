"""Personal data: regular expressions propose spans, checksums confirm them,
nearby context words adjust a score.  DataFrame functions only.

Kinds: email, ip, card, phone (the base kinds) and iban.  A card must pass
Luhn, an IBAN mod-97.  Positions are code points, end exclusive; within a kind
matches are leftmost and do not overlap; a match that fails its check is
dropped.  Patterns are possessive and anchored at the start of their run of
characters (or at the end of the previous match), so long runs cost linear
time and no recursion while the matches stay those of the plain patterns.  Positions
of n matches in a text take n * GROUP + (n / GROUP) ** 2 steps at most.

Defined results: a null or empty text has no spans; rows are judged one by
one, so repeated rows repeat their result; an empty table gives an empty
result; texts of any length are read whole; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the kinds in their order, their patterns, and cheap tests that
# every text with a match passes
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # a run of fewer digits than any card has is not proposed
    "card": r"(?<![0-9])(?=(?:[0-9][\x20-]?){13}[0-9])[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
}
HINTS = {
    "email": r"@[A-Za-z0-9-]",
    "ip": r"[0-9]\.[0-9]",
    "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]",
    "phone": r"\+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11}",
}
BASE = ("email", "ip", "card", "phone")
# fixed values: score before context, and words that raise it when near
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.5, "iban": 0.9}
CONTEXT = {
    "email": r"(?i)\b(e-?mail|mail|contact|write|reach)\b",
    "ip": r"(?i)\b(ip|host|server|address|login)\b",
    "card": r"(?i)\b(card|visa|mastercard|credit|payment|pay)\b",
    "phone": r"(?i)\b(phone|tel|call|mobile|fax)\b",
    "iban": r"(?i)\b(iban|bank|account|konto|transfer)\b",
}
CONTEXT_CHARS = 40
#: matches whose positions are added up at once
GROUP = 256
CONTEXT_BONUS = 0.1


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if a string of digits has a valid Luhn check digit."""
    n = F.length(digits)

    def term(i):
        d = F.substring(digits, (n - i + 1).cast("int"), F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))
    total = F.aggregate(F.transform(F.sequence(F.lit(1), n), term), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def mod97(iban: Column) -> Column:
    """True if an IBAN's check digits are right."""
    moved = F.concat(F.substring(iban, 5, 64), F.substring(iban, 1, 4))

    def step(acc, i):
        c = F.substring(moved, i, F.lit(1))
        return F.when(c.between("0", "9"), (acc * 10 + c.cast("int")) % 97) \
                .otherwise((acc * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), step) == 1


def confirmed(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike("^[0-9]{0,3}$")
                        & (F.coalesce(F.substring(F.regexp_replace(p, "^0+", ""), 1, 4).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        d = digits_of(match)
        return F.when(F.length(d).between(14, 19), luhn(d)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits_of(match)).between(10, 15)
    if kind == "iban":
        return mod97(match)
    return F.lit(True)


def _pieces(text: Column, kind: str) -> Column:
    """The matches of a kind, each with the text since the one before it."""
    pairs = F.arrays_zip(F.split(text, PATTERNS[kind], -1).alias("gap"),
                         F.regexp_extract_all(text, F.lit(PATTERNS[kind]), 0).alias("hit"))
    return F.when(text.rlike(HINTS[kind]), pairs).otherwise(F.array().cast("array<struct<gap:string,hit:string>>"))


def kind_spans(pieces: str, kind: str) -> Column:
    """Confirmed spans of one kind, from a column of ``_pieces``.  Lengths of pieces
    and matches are added up from the left, in groups of ``GROUP`` that are then moved
    by the lengths of the groups before, as a growing array is copied at every step."""
    no = list(PATTERNS).index(kind)
    none = F.array().cast("array<struct<start:int,stop:int,hit:string,near:string>>")

    def add(acc, x):
        start = acc["at"] + F.length(x["gap"])
        stop = start + F.length(F.coalesce(x["hit"], F.lit("")))
        near = F.substring(x["gap"], F.greatest(F.lit(1), F.length(x["gap"]) - CONTEXT_CHARS + 1), F.lit(CONTEXT_CHARS))
        found = F.when(x["hit"].isNotNull(), F.array(F.struct(start.alias("start"), stop.alias("stop"),
                                                              x["hit"].alias("hit"), near.alias("near")))).otherwise(none)
        return F.struct(stop.alias("at"), F.concat(acc["found"], found).alias("found"))
    groups = F.transform(F.sequence(F.lit(1), F.greatest(F.size(pieces), F.lit(1)), F.lit(GROUP)), lambda at: F.aggregate(
        F.slice(pieces, at, F.lit(GROUP)), F.struct(F.lit(0).alias("at"), none.alias("found")), add))
    moved = F.array().cast("array<struct<by:int,found:array<struct<start:int,stop:int,hit:string,near:string>>>>")

    def move(acc, x):
        return F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["found"], F.array(
            F.struct(acc["at"].alias("by"), x["found"].alias("found")))).alias("found"))
    matches = F.aggregate(groups, F.struct(F.lit(0).alias("at"), moved.alias("found")), move, lambda a: a["found"])

    def span(m, by):
        return F.struct(
            (m["start"] + by).alias("start"), F.lit(no).alias("kind_no"), (m["stop"] + by).alias("stop"), F.lit(kind).alias("kind"),
            F.when(m["near"].rlike(CONTEXT[kind]), F.lit(round(SCORES[kind] + CONTEXT_BONUS, 3)))
            .otherwise(F.lit(SCORES[kind])).alias("score"))
    return F.flatten(F.transform(matches, lambda g: F.transform(
        F.filter(g["found"], lambda m: confirmed(kind, m["hit"])), lambda m: span(m, g["by"]))))


def find_spans(docs: DataFrame) -> DataFrame:
    """``(doc_id, spans)``: every confirmed span with kind, position and score,
    ordered by start, then kind."""
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # behind a one-row explode: merged with what follows, they would be made again for every group
    held = F.explode(F.array(F.struct(*[_pieces(F.col("text"), k).alias(k) for k in PATTERNS]))).alias("p")
    found = base.select("doc_id", held).select("doc_id", *[F.col(f"p.{k}").alias(k) for k in PATTERNS])
    found = found.select("doc_id", *[kind_spans(k, k).alias(k) for k in PATTERNS])
    return found.select("doc_id", F.sort_array(F.concat(*PATTERNS)).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                                 s["stop"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    spans = find_spans(docs)

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return spans.select("doc_id", *[count(k) for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"), count("iban"),
                        F.transform("spans", lambda s: s["score"]).alias("scores"))
