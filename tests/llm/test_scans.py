"""Licence scans and personal data against plain Python over whole texts."""

import hashlib
import re
import time

from pyspark.sql import functions as F

from topicgrove.llm import license_scan, pii, queries
from topicgrove.llm.license_rules import BASE_PHRASES, rules

from .conftest import DATA


def words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def base_places(text):
    w, found = words(text), []
    for phrase, label in BASE_PHRASES:
        p = phrase.split()
        found += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
    return len(w), found


def detections(text):
    """Every rule over the words, then suppression by comparing all pairs."""
    w = words(text)
    joined = " ".join(w)
    starts = {m.start(): i for i, m in enumerate(re.finditer("[^ ]+", joined))}
    found = []
    for i, (label, priority, keyword, pattern) in enumerate(rules()):
        if not any(x.startswith(keyword) for x in w):
            continue
        pattern = pattern.replace(" ?", "(?: )?").replace("\\S", "[^ ]")
        for m in re.finditer(rf"(?<![^ ])(?:{pattern})(?![^ ])", joined):
            a = starts[m.start()]
            found.append((a, a + m[0].count(" ") + 1, priority, i, label))
    found.sort(key=lambda d: (d[0], -d[1], -d[2], d[3]))
    return [d for k, d in enumerate(found) if not any(o[0] <= d[0] and o[1] >= d[1] and o[2] >= d[2] for o in found[:k])]


def test_rules_are_hundreds_and_hold_their_keyword():
    table = rules()
    assert len(table) >= 200
    for label, priority, keyword, pattern in table:
        assert 0 <= priority <= 3 and re.search(rf"\b{keyword}|[|:( ]{keyword}", pattern), (label, pattern)


def test_license_query_equals_brute_force(spark, corpus):
    got = {r["doc_id"]: r for r in queries.license_scans(spark, DATA).collect()}
    _, rows = corpus
    assert len(got) == len(rows)
    for doc_id, text in rows:
        n, base = base_places(text)
        r, at = got[doc_id], [i for i, _ in base]
        assert (r["n_words"], r["n_base"]) == (n, len(base))
        assert (r["first_word"], r["last_word"]) == ((min(at), max(at)) if at else (None, None))
        labels = {x for _, x in base}
        assert r["base_labels"] == ",".join(sorted(labels))
        assert r["labels"] == ",".join(sorted(labels | {d[4] for d in detections(text)})), doc_id
        assert 0 <= r["score"] <= 1


def test_license_overlaps_and_edges(spark, edge, empty):
    texts = [
        "Licensed under CC BY-NC 4.0. cc-by cc by",
        "GNU General Public License, version 3. The MIT License (MIT). MIT license",
        "Apache License, Version 2.0 " * 400,
        "all rights, reserved; ALL RIGHTS RESERVED all rights reserved",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for r in license_scan.license_scan(df).collect():
        got = [(d["start"], d["start"] + d["length"], d["priority"], d["rule"], d["label"]) for d in r["scan"]["detections"]]
        assert got == detections(r["text"])
        assert sorted((b["start"], b["label"]) for b in r["scan"]["base"]) == sorted(base_places(r["text"])[1])
    scanned = license_scan.license_scan(edge)
    assert scanned.columns == [*edge.columns, "scan"]
    for r in scanned.collect():
        assert r["scan"]["n_words"] == len(words(r["text"]))
    assert license_scan.license_scan(empty).count() == 0


def luhn(d):
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, d[::-1]))) % 10 == 0


def base_spans(text):
    found, count = [], {}
    for kind, pattern in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                "card": 16 <= len(digits) <= 19 and luhn(digits),
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if ok:
                found.append(f"{kind}:{m.start()}:{m.end()}")
                count[kind] = count.get(kind, 0) + 1
    return found, count


HARD = [
    "a@b.c_d@e.f x@y@z.com a@b..c m@n.o. é@é.é a.b+c@d-e.f-g.h",
    "1.2.3.4.5.6.7.8 256.1.1.1 000255.01.1.1 1.2.3 9999999999999999999999.1.1.1 1.1.1.99999999999999999999",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111111111111111 2 41111111111111112222222",
    "+1 (212) 555-1234 +12 +1234567 +12345678901234567 +1-- call +49 30 1234567.",
    "\U0001f600 a@b.cc \U0001f600 漢 10.0.0.1",
    "x" * 2_000 + "@" + "1" * 2_000 + " " + "1." * 3_000 + "a" * 9 + "@b" + ".c" * 9_000,
    "7" * 5_000 + " " + "12 " * 5_000,
    "a@b.cc " * 3_000,
]


def test_base_spans_on_hard_texts(spark):
    df = spark.createDataFrame(list(enumerate(HARD)), "doc_id int, text string")
    for r in pii.personal_data(df).collect():
        got = [f"{s['kind']}:{s['start']}:{s['end']}" for s in r["pii"] if s["kind"] in pii.BASE]
        assert got == base_spans(r["text"])[0], r["doc_id"]


def test_long_runs_take_linear_time(spark):
    runs = ["x" * 300_000 + "@" + "1" * 300_000, "7" * 300_000, "1." * 150_000, "A" * 300_000, "a@b" + ".c" * 100_000]
    df = spark.createDataFrame(list(enumerate(runs)), "doc_id int, text string")
    assert [len(r["pii"]) for r in pii.personal_data(df).orderBy("doc_id").collect()] == [0, 0, 37_500, 0, 1]


def test_very_many_spans_take_linear_time(spark):
    """Lists of 75,000 spans and of 40,000 detections, in one text each: a fold that copies its list takes minutes."""
    began = time.time()
    df = spark.createDataFrame([(1, "1." * 300_000)], "doc_id int, text string")
    assert pii.personal_data(df).select(F.size("pii")).first()[0] == 75_000
    df = spark.createDataFrame([(1, "MIT licence " * 20_000)], "doc_id int, text string")
    assert license_scan.license_scan(df).select(F.size("scan.detections")).first()[0] >= 20_000
    assert time.time() - began < 60


def test_license_phrases_before_any_line_end(spark):
    """U+0085, U+2028 and U+2029 are characters of words: a phrase's word that ends in one is another word."""
    texts = [f"{phrase}{end}{more}" for phrase, _ in BASE_PHRASES for end in ("\u0085", "\u2028", "\u2029", "\n", "\r", "") for more in ("", " x")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for r in license_scan.license_scan(df).collect():
        assert sorted((b["start"], b["label"]) for b in r["scan"]["base"]) == sorted(base_places(r["text"])[1]), repr(r["text"])
        got = [(d["start"], d["start"] + d["length"], d["priority"], d["rule"], d["label"]) for d in r["scan"]["detections"]]
        assert got == detections(r["text"]), repr(r["text"])


def test_added_kinds(spark):
    texts = [
        "IBAN DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432",
        "IBAN DE89 3704 0044 0532 0130 01",
        "IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX; GB82 WEST 1234 5698 7654 32 NL91 ABNA 0417 1643 00 X",
        "amex card 378282246310005",
        "number 378282246310005",
        "ssn 219-09-9999, social security 000-12-3456",
        "219-09-9999",
        'token = "1d46e940c38b6b02bbe8d98b2da087fb"',
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["doc_id"]: [(s["kind"], r["text"][s["start"] : s["end"]]) for s in r["pii"]] for r in pii.personal_data(df).collect()}
    assert got[0] == [("iban", "DE89 3704 0044 0532 0130 00"), ("iban", "GB82WEST12345698765432")]
    assert got[1] == []
    assert [s for _, s in got[2]] == ["DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "NL91 ABNA 0417 1643 00"]
    assert got[3] == [("short_card", "378282246310005")]
    assert got[4] == []
    assert got[5] == [("ssn", "219-09-9999")]
    assert got[6] == []
    assert [k for k, _ in got[7]] == ["secret"]


def test_pii_query_equals_brute_force(spark, corpus):
    got = {r["doc_id"]: r for r in queries.pii_spans(spark, DATA).collect()}
    _, rows = corpus
    for doc_id, text in rows:
        spans, count = base_spans(text)
        r = got[doc_id]
        assert [r[f"n_{k}"] for k in pii.BASE] == [count.get(k, 0) for k in pii.BASE]
        assert r["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()
        kept = [s for s in r["spans"].split(",") if s.split(":")[0] in pii.BASE]
        assert kept == spans


def test_pii_edges(edge, empty):
    found = pii.personal_data(edge)
    assert found.where(F.size("pii") > 0).count() == 0 and found.count() == edge.count()
    assert pii.personal_data(empty).count() == 0


def test_context_words_count_before_other_matches(spark):
    texts = ["Amex card no. 2: 378282246310005", "SSN 219-09-9998, 219-09-9997", "SSN 219-09-9998" + " and so on" * 5 + " 219-09-9997"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = [[(s["kind"], r["text"][s["start"] : s["end"]]) for s in r["pii"]] for r in pii.personal_data(df).orderBy("doc_id").collect()]
    assert got == [[("short_card", "378282246310005")], [("ssn", "219-09-9998"), ("ssn", "219-09-9997")], [("ssn", "219-09-9998")]]


def test_openrail_in_one_word_is_found(spark):
    texts = ["OpenRAIL license", "the CreativeML OpenRAIL M license", "an Open RAIL license", "openrail license and a rail"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = [[d["label"] for d in r["scan"]["detections"]] for r in license_scan.license_scan(df).orderBy("doc_id").collect()]
    assert got == [["rail"]] * 4


def test_license_gate_reads_a_letter_once_and_opens_as_before(spark):
    """At a word's start the gate tries a way for each letter, not one for each keyword; words are counted without a list of matches."""
    gate, keys = license_scan.gate(), {k for _, _, k, _ in rules()} | {"cc", "license", "reserved"}
    least = sorted(k for k in keys if not any(k != o and k.startswith(o) for o in keys))
    depth, firsts = 0, []
    for i, c in enumerate(gate.partition("[^0-9A-Za-z])")[2]):
        depth += (c == "(") - (c == ")")
        if depth == 1 and (c == "|" or not i):
            firsts.append(gate.partition("[^0-9A-Za-z])")[2][i + (1 if c == "|" else 3)])
    assert sorted(firsts) == sorted({k[0] for k in least})
    texts = [f"{before}{w}{after}" for k in least for w in (k, k.upper(), k[:-1], k[1:]) for before in ("", "x ", "9", "\u00e9", "\n") for after in ("", "s", "-")]
    texts += ["", " ", "a", " a", "a ", " a  b ", "\u00e9", "\u2028", "--", "a-\U0001f600-b\x7f", "\x00", None]
    plain = re.compile("(?<![0-9A-Za-z])(?:" + "|".join(least) + ")", re.I | re.A)
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in license_scan.license_scan(df).withColumn("open", F.col("text").rlike(gate)).collect():
        assert r["scan"]["n_words"] == len(words(r["text"])), repr(r["text"])
        assert r["text"] is None or r["open"] == bool(plain.search(r["text"])), repr(r["text"])
    plan = license_scan.license_scan(df).select("scan.n_words")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan
