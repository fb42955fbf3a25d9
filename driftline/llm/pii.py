"""Personal data: patterns propose spans, checksums confirm them, context words score them.

Everything here is a column expression; no Python runs on the executors.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import whole_text

# Fixed values. The patterns of the base kinds are those of the contract, written so that
# the engine looks at each byte a bounded number of times: quantifiers that never need to
# give anything back are possessive, and a run of characters is entered at its start only
# (or where the previous match has ended).
EMAIL = (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++"
         r"(?:\.[A-Za-z0-9-]++)++")
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
IP_VALID = rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"

#: kind, pattern, a cheap test that the text can hold it at all, score without context
KINDS = (("email", EMAIL, "@", 0.9), ("ip", IP, r"[0-9]\.[0-9]", 0.6),
         ("card", CARD, r"[0-9][\x20-]?[0-9]", 0.8), ("phone", PHONE, r"\+[0-9]", 0.6),
         ("iban", IBAN, r"[A-Z]{2}[0-9]{2}", 0.9))
BASE_KINDS = ("email", "ip", "card", "phone")
CONTEXT = {"email": "mail|contact|write|reply", "ip": "address|host|server|login|addr",
           "card": "card|visa|credit|payment|account", "phone": "phone|call|mobile|fax|tel",
           "iban": "iban|bank|account|transfer"}
CONTEXT_CHARS = 40
CONTEXT_GAIN = 0.1
#: Matches that are folded at a time.
PART_MATCHES = 256


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn_valid(digits: Column) -> Column:
    """Luhn's checksum: every second digit from the right doubled, digits summed."""
    reverse = F.reverse(digits)
    swapped = F.translate(reverse, "0123456789", "0246813579")
    total = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0),
        lambda acc, i: acc + F.when(i % 2 == 1, F.substring(reverse, i, F.lit(1)))
        .otherwise(F.substring(swapped, i, F.lit(1))).cast("int"))
    return (total % 10) == 0


def mod97_valid(compact: Column) -> Column:
    """The check of account numbers: country and check digits last, letters as 10 to 35."""
    moved = F.concat(F.substring(compact, 5, 64), F.substring(compact, 1, 4))

    def step(acc, char):
        code = F.ascii(char)
        return F.when(code >= 65, (acc * 100 + code - 55) % 97).otherwise((acc * 10 + code - 48) % 97)

    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), step) == 1


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(IP_VALID)
    if kind == "card":
        digits = _digits(match)
        return F.when(F.length(digits).between(14, 19), luhn_valid(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(match)).between(10, 15)
    if kind == "iban":
        compact = F.replace(match, F.lit(" "), F.lit(""))
        return F.when(F.length(compact).between(15, 34), mod97_valid(compact)).otherwise(F.lit(False))
    return F.lit(True)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def _placed(judged: Column) -> Column:
    """Confirmed matches (start, m, before) of the pieces and matches of a text, in order.

    A fold copies what it has gathered with every match, so it goes over parts of some
    hundred matches, each from where the ones before it end; the work grows with the text.
    """
    def length(x):
        return F.length(x["gap"]) + F.coalesce(F.length(x["m"]), F.lit(0))

    def step(acc, x):
        return F.struct(
            (acc["at"] + length(x)).alias("at"),
            F.when(x["m"].isNull() | ~x["ok"], acc["out"])
            .otherwise(F.concat(acc["out"], F.array(F.struct(
                (acc["at"] + F.length(x["gap"])).alias("start"), x["m"].alias("m"),
                F.right(x["gap"], F.lit(CONTEXT_CHARS)).alias("before"))))).alias("out"))

    def within(part, at):
        return F.aggregate(part, F.struct(at.alias("at"), F.array().cast(
            "array<struct<start:int,m:string,before:string>>").alias("out")), step,
            lambda acc: acc["out"])

    def folded(parts):
        sums = F.transform(parts, lambda p: F.aggregate(
            p, F.lit(0), lambda total, x: total + length(x)))
        ends = F.aggregate(sums, F.struct(F.lit(0).alias("at"),
                                          F.array().cast("array<int>").alias("out")),
                           lambda acc, n: F.struct(
                               (acc["at"] + n).alias("at"),
                               F.concat(acc["out"], F.array(acc["at"])).alias("out")),
                           lambda acc: acc["out"])
        return F.flatten(F.zip_with(parts, ends, within))

    numbers = F.sequence(F.lit(0), F.greatest(F.floor((F.size(judged) - 1) / PART_MATCHES),
                                              F.lit(0)).cast("int"))
    return _let(F.transform(numbers, lambda i: F.slice(
        judged, i * PART_MATCHES + 1, F.lit(PART_MATCHES))), folded)


def _spans(kind: str, order: int, pattern: str, hint: str, score: float, text: Column) -> Column:
    """Confirmed spans of one kind: start and end in code points, kind, score.

    The matches and the pieces between them add up to the text, so positions follow from
    the lengths of what stands before.
    """
    empty = F.array().cast("array<struct<start:int,order:int,end:int,kind:string,score:double>>")
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    pieces = F.split(text, pattern, -1)
    judged = F.zip_with(pieces, found, lambda gap, m: F.struct(
        gap.alias("gap"), m.alias("m"), F.coalesce(_valid(kind, m), F.lit(False)).alias("ok")))
    placed = _let(judged, _placed)
    kept = F.transform(
        placed,
        lambda s: F.struct(
            s["start"].alias("start"), F.lit(order).alias("order"),
            (s["start"] + F.length(s["m"])).alias("end"), F.lit(kind).alias("kind"),
            F.when(F.lower(s["before"]).rlike(CONTEXT[kind]), F.lit(score + CONTEXT_GAIN))
            .otherwise(F.lit(score)).alias("score")))
    return F.when(text.rlike(hint), kept).otherwise(empty)


def find_pii(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id and ``spans``: start, end (code points, end exclusive), kind and score, in text order.

    Kinds are email, ip, card (Luhn), phone and iban (mod 97); matches of a kind are the
    leftmost ones that don't overlap, and a match that fails its check is dropped without
    another try. Spans of different kinds may overlap. A context word in the 40 characters
    between the previous match and the span raises its score. A null or empty text has no
    spans; every row gives a row, repeated ids included; other columns are not looked at.
    """
    text = whole_text(text_column)
    lists = [_spans(kind, i, pattern, hint, score, F.col("__text"))
             for i, (kind, pattern, hint, score) in enumerate(KINDS)]
    return (docs.select(F.col(id_column).alias(id_column), text.alias("__text"))
            .select(id_column, F.array_sort(F.concat(*lists)).alias("spans")))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_report(docs: DataFrame) -> DataFrame:
    """Counts per base kind, a digest of the base spans, and all spans as text."""
    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: reduce(lambda a, b: a | b,
                                              [s["kind"] == k for k in BASE_KINDS]))
    # one wide expression; kept apart from the scan's stage so that spans are computed once
    found = find_pii(docs)
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0))
        .alias("score"))
