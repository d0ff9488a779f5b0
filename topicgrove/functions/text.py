"""Scalar expressions over phrases, prefixes, years and words; all are built-in functions, none a UDF."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the input format: the tags around a phrase and their lengths.
OPEN, CLOSE = "<phrase>", "</phrase>"
# The first bound of the five-year periods, the last, and the step.
FIRST_PERIOD, LAST_PERIOD, PERIOD = 1965, 2020, 5


def extract_phrases(text: Column) -> Column:
    """Tagged phrases of a line in order, inner spaces as underscores; null has none. Case is kept."""
    inner = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"{OPEN}(.+?){CLOSE}"), F.lit(1))
    return F.transform(inner, lambda p: F.concat(F.lit(OPEN), F.translate(p, " ", "_"), F.lit(CLOSE)))


def strip_phrase_tags(phrase: Column) -> Column:
    return F.translate(F.substring(phrase, F.lit(len(OPEN) + 1), F.length(phrase) - len(OPEN) - len(CLOSE)), "_", " ")


def add_phrase_tags(phrase: Column) -> Column:
    return F.concat(F.lit(OPEN), F.translate(F.lower(phrase), " ", "_"), F.lit(CLOSE))


def tokens(line: Column) -> Column:
    """Words of a line parted by spaces and tabs; carriage returns vanish and words are cut at 299 characters."""
    parts = F.split(F.translate(F.coalesce(line, F.lit("")), "\r", ""), r"[ \t]+")
    return F.transform(F.array_remove(parts, ""), lambda w: F.substring(w, 1, 299))


def is_phrase(word: Column) -> Column:
    return word.startswith(OPEN)


def parse_prefix(prefix: Column) -> Column:
    return F.transform(F.split(prefix, "/"), lambda x: x.cast("int"))


def parent_prefix(prefix: Column) -> Column:
    """The prefix above; a root's is null."""
    return F.when(prefix.contains("/"), F.regexp_replace(prefix, "/[^/]*$", ""))


def level_of(prefix: Column) -> Column:
    return F.size(F.split(prefix, "/")) - 1


def file_safe(prefix: Column) -> Column:
    return F.translate(prefix, "/", "_")


def period_of(year: Column) -> Column:
    """The first period bound above the year, 1965 at least; null from the last bound on."""
    bound = (F.floor(year / F.lit(PERIOD)) + 1) * PERIOD
    return F.when(year < LAST_PERIOD, F.greatest(bound, F.lit(FIRST_PERIOD))).cast("int")


def contrast_equation(distinct: Column, tf: Column, idf: Column, tf_lift: float, idf_lift: float) -> Column:
    return distinct * F.pow(tf, F.lit(tf_lift)) * F.pow(idf, F.lit(idf_lift))


def decayed(lift: float, level: int, decay: float = 0.9) -> float:
    return lift * decay**level


def keep_probability(count: Column, total: Column, sample: float = 1e-4) -> Column:
    """The chance that subsampling keeps an occurrence of a word; over 1 means always."""
    ratio = count / (F.lit(sample) * total)
    return (F.sqrt(ratio) + 1) / ratio


def sigmoid(x: Column) -> Column:
    """1 / (1 + exp(-x)), saturated beyond 6."""
    return F.when(x > 6, 1.0).when(x < -6, 0.0).otherwise(1 / (1 + F.exp(-x)))


def uniform(*keys: Column | str, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the keys and the seed alone, so that a task run again draws the same.

    52 bits of the MD5 of the keys and the seed, joined by bars: any SQL engine can draw the same numbers.
    """
    named = [F.col(k) if isinstance(k, str) else k for k in keys]
    digits = F.substring(F.md5(F.concat_ws("|", *[k.cast("string") for k in named], F.lit(str(seed)))), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


def parse_metapath(path: str) -> list[tuple[str, str, int]]:
    """``A->P<-B`` as steps (source type, target type, direction): 1 along the edge, -1 against it."""
    types, arrows = re.split(r"->|<-", path), re.findall(r"->|<-", path)
    if len(types) < 2 or not all(t.strip() for t in types):
        raise ValueError(f"not a meta-path: {path!r}")
    types = [t.strip() for t in types]
    return [(a, b, 1 if arrow == "->" else -1) for a, b, arrow in zip(types[:-1], types[1:], arrows, strict=True)]
