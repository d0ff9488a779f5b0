"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicgrove.llm.storage import scanned

# Runs are possessive and begin where a run begins, so that a long run of one class is read once; \G allows for a
# run that the last match ended in.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
NUMBER = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# The length of an IBAN in each country, so that what follows one is no part of it.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}
_BY_LENGTH = "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())
IBAN = rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{_BY_LENGTH})(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"
SECRET = r"(?i)\b(?:password|passwd|secret|token|api[_-]?key)[\x22']?\x20?[=:]\x20?[\x22']?[A-Za-z0-9+/_-]{12,}"
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
BYTES = rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"

#: kind -> (pattern, score once confirmed, gain from a context word, context words)
KINDS = {
    "email": (EMAIL, 0.90, 0.10, "mail|contact|write"),
    "ip": (IP, 0.60, 0.30, "ip|host|server|address"),
    "card": (NUMBER, 0.80, 0.20, "card|visa|master|credit|pay"),
    "phone": (PHONE, 0.70, 0.30, "phone|tel|call|mobile|fax"),
    "iban": (IBAN, 0.80, 0.20, "iban|account|bank"),
    "short_card": (NUMBER, 0.30, 0.40, "card|amex|diners|credit"),
    "ssn": (SSN, 0.40, 0.40, "ssn|social|security"),
    "secret": (SECRET, 0.80, 0.00, "(?!)"),
}
BASE = ("email", "ip", "card", "phone")
LEAST_SCORE = 0.5
#: code points before a span in which context words count
NEARBY = 40


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def mod97(match: Column) -> Column:
    """Whether an IBAN's letters and digits, country and check digits last, leave 1 modulo 97."""
    code = F.replace(match, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, 1, 4))

    def add(rest: Column, c: Column) -> Column:
        letter = F.ascii(c) - 55
        return F.when(letter >= 10, (rest * 100 + letter) % 97).otherwise((rest * 10 + letter + 7) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), add) == 1


def _confirmed(kind: str, match: Column) -> Column:
    n = F.length(_digits(match))
    if kind == "ip":
        return match.rlike(BYTES)
    if kind == "card":
        return n.between(16, 19) & luhn(_digits(match))
    if kind == "short_card":
        return n.between(13, 15) & luhn(_digits(match))
    if kind == "phone":
        return n.between(8, 15)
    if kind == "iban":
        return mod97(match)
    return F.lit(True)


def _spans(text: Column, kind: str) -> Column:
    """Confirmed spans of one kind in order: matches and the text between them give the places in code points."""
    pattern, score, gain, context = KINDS[kind]
    between, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    span = "array<struct<start:int,end:int,score:double>>"

    def last(piece: Column) -> Column:
        return F.substring(piece, F.greatest(F.lit(1), F.length(piece) - NEARBY + 1), F.lit(NEARBY))

    def state(at: Column, near: Column, spans: Column) -> Column:
        return F.struct(at.alias("at"), near.alias("near"), spans.alias("spans"))

    def carry(piece: Column) -> Column:
        """The length of a piece's text, and its end."""
        whole = F.aggregate(piece, F.lit(0), lambda n, p: n + F.length(p["between"]) + F.length(p["match"]))
        tail = F.slice(piece, F.greatest(F.lit(1), F.size(piece) - NEARBY + 1), F.lit(NEARBY))  # a match has a character at least
        near = F.array_join(F.transform(tail, lambda p: last(F.concat(last(p["between"]), last(p["match"])))), "")
        return F.struct(whole.alias("length"), last(near).alias("near"))

    def joined(before: Column, piece: Column) -> Column:
        return state(before["at"] + piece["length"], last(F.concat(before["near"], piece["near"])), before["spans"])

    def step(before: Column, pair: Column) -> Column:
        start = before["at"] + F.length(pair["between"])
        end = start + F.length(pair["match"])
        near = last(F.concat(before["near"], last(pair["between"])))
        worth = F.lit(score) + F.when(near.rlike(rf"(?i)\b(?:{context})"), gain).otherwise(0.0)
        keep = _confirmed(kind, pair["match"])
        if kind not in BASE:
            keep = keep & (worth >= LEAST_SCORE)
        one = F.array(F.struct(start.alias("start"), end.alias("end"), worth.alias("score")))
        return state(end, last(F.concat(near, last(pair["match"]))), F.when(keep, F.concat(before["spans"], one)).otherwise(before["spans"]))

    pairs = F.zip_with(F.slice(between, F.lit(1), F.size(matches)), matches, lambda b, m: F.struct(b.alias("between"), m.alias("match")))
    found = scanned(pairs, state(F.lit(0), F.lit(""), F.array().cast(span)), carry, joined, step, lambda s: s["spans"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(span))


def _named(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score")))


def personal_data(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``pii``: array of (kind, start, end, score), by kind as in KINDS, then by start.

    Places are code points, the end exclusive; whole texts are searched, leftmost matches without overlap in each
    kind. E-mail addresses, IPv4 addresses (parts of at most 255), cards (16 to 19 digits, Luhn) and phones (8 to
    15 digits) are base kinds and always stay; IBANs (mod 97), shorter cards (Luhn), social security numbers and
    secrets after a naming word are added if their score, raised by context words in the 40 code points before,
    reaches LEAST_SCORE. Null and empty texts hold nothing; rows are independent, so repeated rows get equal spans.
    A column named ``pii`` is replaced, others may have any name; an empty table stays empty. Time grows with the text
    and its spans.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.withColumn("pii", F.concat(*[_named(_spans(text, kind), kind) for kind in KINDS]))


def joined_spans(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(kind: str) -> Column:
    return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long")
