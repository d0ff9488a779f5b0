"""Licence scans: signature rules in order, gated by keywords, overlaps resolved by priority and containment."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicgrove.llm.license_rules import BASE_PHRASES, rules
from topicgrove.llm.storage import let, named_again, numbered, place_of, scanned

_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_SPAN = "struct<start:int,length:int,priority:int,rule:int,label:string>"
#: trust in a detection by its priority
SCORES = (0.25, 0.6, 0.9, 1.0)


def _indexed(pattern: str) -> str:
    """A word pattern made to match ``i:word`` text; group 1 is the first word's index."""
    spaced = pattern.replace(" ?", "(?: [0-9]+:)?").replace(" ", " [0-9]+:").replace("(?: [0-9]+:[0-9]+:)?", "(?: [0-9]+:)?")
    return rf"([0-9]+):(?:{spaced})(?= |\z)"


def _places(indexed: Column, pattern: Column) -> Column:
    """(start, words) of each match: the first index is in the text, the length is that of the match."""
    whole = F.regexp_extract_all(indexed, pattern, F.lit(0))
    return F.transform(whole, lambda m: F.struct(F.substring_index(m, ":", 1).cast("int").alias("start"), (F.length(m) - F.length(F.replace(m, F.lit(" "), F.lit(""))) + 1).alias("length")))


def _labelled(places: Column, label: str) -> Column:
    return F.transform(places, lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"), F.lit(label).alias("label")))


def _rule_table() -> Column:
    """keyword -> its rules, as one literal."""
    by_key: dict[str, list[tuple[int, int, str, str]]] = {}
    for i, (label, priority, keyword, pattern) in enumerate(rules()):
        by_key.setdefault(keyword, []).append((i, priority, label, _indexed(pattern)))
    entries = []
    for keyword, some in by_key.items():
        each = [F.struct(F.lit(i).alias("rule"), F.lit(p).alias("priority"), F.lit(label).alias("label"), F.lit(re_).alias("pattern")) for i, p, label, re_ in some]
        entries.append(F.struct(F.lit(f":{keyword}").alias("keyword"), F.array(*each).alias("rules")))
    return F.array(*entries)


def _by_letter(keys: list[str]) -> str:
    """An expression for any of the keys, none of which begins another, that reads a letter they share once."""
    if len(keys) == 1:
        return re.escape(keys[0])
    rest: dict[str, list[str]] = {}
    for k in keys:
        rest.setdefault(k[0], []).append(k[1:])
    ways = [re.escape(c) + _by_letter(some) for c, some in rest.items()]
    return ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})"


def gate() -> str:
    """One expression that finds a keyword at a word's start; texts without any hold no detection."""
    keys = {k for _, _, k, _ in rules()} | {p.split()[0] if label == "cc-by" else p.split()[-1] for p, label in BASE_PHRASES}
    least = sorted(k for k in keys if not any(k != o and k.startswith(o) for o in keys))
    return r"(?i)(?:\A|[^0-9A-Za-z])" + _by_letter(least)


def _n_words(text: Column) -> Column:
    """The number of words, from what stands between separators: only before the first and after the last it may be empty."""
    empty = lambda w: (w == "").cast("int")
    return let(F.split(text, _BETWEEN), lambda p: F.size(p) - empty(F.get(p, F.lit(0))) - F.when(F.size(p) > 1, empty(F.element_at(p, -1))).otherwise(0))


def _unsuppressed(found: Column) -> Column:
    """Detections not contained in one of equal or higher priority that comes before them.

    In order of start, longer first, higher priority first, every interval that contains another precedes it, so the
    farthest end seen at each priority tells whether a detection is contained.
    """
    ordered = F.array_sort(F.transform(found, lambda d: F.struct(d["start"].alias("start"), (-d["length"]).alias("shorter"), (-d["priority"]).alias("lower"), d["rule"].alias("rule"), d["label"].alias("label"))))
    ends = [f"end{p}" for p in range(len(SCORES))]
    last = lambda d: d["start"] - d["shorter"]

    def moved(state: Column, d: Column) -> list[Column]:
        return [F.when(d["lower"] == -p, F.greatest(state[e], last(d))).otherwise(state[e]).alias(e) for p, e in enumerate(ends)]

    def step(state: Column, d: Column) -> Column:
        priority = -d["lower"]
        reached = F.greatest(*[F.when(F.lit(p) >= priority, state[ends[p]]).otherwise(0) for p in range(len(SCORES))])
        one = F.array(F.struct(d["start"].alias("start"), (-d["shorter"]).alias("length"), priority.alias("priority"), d["rule"].alias("rule"), d["label"].alias("label")))
        kept = F.when(last(d) > reached, F.concat(state["kept"], one)).otherwise(state["kept"])
        return F.struct(*moved(state, d), kept.alias("kept"))

    none = [F.lit(0).alias(e) for e in ends]
    carry = lambda piece: F.aggregate(piece, F.struct(*none), lambda s, d: F.struct(*moved(s, d)))
    joined = lambda s, c: F.struct(*[F.greatest(s[e], c[e]).alias(e) for e in ends], s["kept"].alias("kept"))
    first = F.struct(*none, F.array().cast(f"array<{_SPAN}>").alias("kept"))
    return scanned(ordered, first, carry, joined, step, lambda s: s["kept"])


def license_scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``scan``: struct(n_words, base array of (start, length, label), detections array, score).

    Words are runs of ASCII letters and digits and of anything beyond ASCII, A-Z lower-cased, counted from 0. Texts
    that hold a keyword are written as ``index:word`` and searched with the rules of the keywords they hold; a
    detection inside another of equal or higher priority is suppressed (equal intervals: the higher priority, then
    the earlier rule). Base phrases are found at all their places and never suppressed. ``score`` is the trust in the
    best detection, base phrases counting as 0.6. Null and empty texts have no words; rows are independent, so
    repeated rows get equal results. Time grows with the text; an empty table stays empty. A column named ``scan`` is
    replaced, others may have any name.
    """
    rows = numbered(docs)
    text = F.coalesce(F.col(f"c{place_of(docs, text_col)}").cast("string"), F.lit(""))
    gated = rows.withColumn("_open", text.rlike(gate()))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = F.regexp_extract_all(F.translate(text, upper, lower), F.lit(_WORD), F.lit(0))
    indexed_words = F.array_join(F.transform(words, lambda w, i: F.concat(i.cast("string"), F.lit(":"), w)), " ")
    gated = gated.withColumn("_indexed", F.when(F.col("_open"), indexed_words).otherwise(F.lit("")))
    indexed = F.col("_indexed")

    held = F.filter(_rule_table(), lambda k: F.contains(indexed, k["keyword"]))
    tried = F.flatten(F.transform(held, lambda k: k["rules"]))
    found = F.flatten(
        F.transform(tried, lambda r: F.transform(_places(indexed, r["pattern"]), lambda p: F.struct(p["start"].alias("start"), p["length"].alias("length"), r["priority"].alias("priority"), r["rule"].alias("rule"), r["label"].alias("label"))))
    )
    none = F.array().cast(f"array<{_SPAN}>")
    base_kind = "array<struct<start:int,length:int,label:string>>"
    base = F.concat(*[_labelled(_places(indexed, F.lit(_indexed(p))), label) for p, label in BASE_PHRASES])
    made = gated.withColumns(
        {
            "_base": F.when(F.col("_open"), base).otherwise(F.array().cast(base_kind)),
            "_found": F.when(F.col("_open"), _unsuppressed(found)).otherwise(none),
        }
    )
    trust = F.transform(F.col("_found"), lambda d: F.element_at(F.array(*map(F.lit, SCORES)), d["priority"] + 1))
    best = F.greatest(F.coalesce(F.array_max(trust), F.lit(0.0)), F.when(F.size("_base") > 0, 0.6).otherwise(0.0))
    scan = F.struct(_n_words(text).cast("long").alias("n_words"), F.col("_base").alias("base"), F.col("_found").alias("detections"), best.alias("score"))
    return named_again(made, docs.columns, scan=scan)


def labels_joined(arrays: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(arrays)), ",")
