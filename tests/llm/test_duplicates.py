"""Near-duplicates, repeated lines, contamination and union-find against brute force on whole small inputs."""

import random
import re
from collections import defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

from topicgrove.llm import decontamination, line_dedup, queries, simhash
from topicgrove.llm.components import components

from .conftest import DATA


def union_find(nodes, edges):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 140)] + [(500, i) for i in range(501, 560)] + [(7, 7), (9, 8), (8, 9), (None, 4)]
    edges += [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(120)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["root"] for r in components(df).collect()}
    known = [(a, b) for a, b in edges if a is not None and b is not None]
    want = union_find({x for e in known for x in e}, known)
    assert got == {n: r for n, r in want.items() if n != r}
    assert components(df.limit(0)).count() == 0


def plain_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Component of each document by comparing all pairs of distinct fingerprints."""
    distinct = sorted(set(prints.values()))
    edges = [(a, b) for i, a in enumerate(distinct) for b in distinct[i + 1 :] if (a ^ b).bit_count() <= 4]
    root, least = union_find(distinct, edges), {}
    for d, p in prints.items():
        least[root[p]] = min(d, least.get(root[p], d))
    return {d: least[root[p]] for d, p in prints.items()}


def test_simhash_query_equals_all_pairs(spark, corpus):
    _, rows = corpus
    prints = {d: plain_fingerprint(t) for d, t in rows}
    want = plain_components(prints)
    got = queries.simhash_near_dedup(spark, DATA).collect()
    assert {r["doc_id"]: r["fingerprint"] for r in got} == {d: f"{p:016x}" for d, p in prints.items()}
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_every_pair_within_four_bits_shares_a_posting():
    rng = random.Random(5)
    for _ in range(3000):
        spoiled = set(rng.sample(range(8), 4))
        assert any(not spoiled & set(t) for t in simhash.POSITIONS)
    assert len(simhash.POSITIONS) == 20


def test_the_count_of_shared_bytes_loses_no_link_and_spares_pairs():
    rng = random.Random(6)
    center = rng.getrandbits(64)
    prints = np.array([center ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 9))) for _ in range(400)], np.uint64)
    differing = (prints[:, None] ^ prints[None, :]).reshape(-1)
    retained = simhash.shared_bytes(differing) >= simhash.LEAST_SHARED
    linked = np.bitwise_count(differing) <= simhash.MOST_BITS
    assert not (linked & ~retained).any()
    assert (~retained).sum() > 0.3 * len(differing)


def test_dense_clusters_lose_no_link(spark):
    """Fingerprints around a few centers 5 to 9 bits apart, in lists longer than a block."""
    rng, prints = random.Random(11), set()
    centers = [rng.getrandbits(64)]
    centers += [centers[0] ^ sum(1 << b for b in rng.sample(range(64), k)) for k in (5, 7, 9, 12)]
    for c in centers:
        for _ in range(150):
            prints.add(c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 5))))
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    want = plain_components(dict(enumerate(prints)))
    block, simhash.BLOCK = simhash.BLOCK, 16
    try:
        df = spark.createDataFrame([(p,) for p in signed], "fp long")
        got = {r["node"]: r["root"] for r in simhash.print_components(df).collect()}
    finally:
        simhash.BLOCK = block
    groups, plain = defaultdict(set), defaultdict(set)
    for i, p in enumerate(signed):
        groups[got.get(p, p)].add(p)
        plain[want[i]].add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, plain.values()))


def test_simhash_edges(spark, edge, empty):
    got = simhash.simhash_components(edge).collect()
    assert len(got) == edge.count()
    blank = {r["doc_id"]: r["component_id"] for r in got if r["fp"] == 0}
    assert blank == {1: 1, 2: 1, 3: 1, 8: 1}
    assert {r["component_id"] for r in got if r["doc_id"] in (5, 6, None)} == {5}
    assert simhash.simhash_components(empty).count() == 0
    kept = simhash.one_of_each(edge)
    assert kept.columns == edge.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 4, 5, 7]


_ASCII = "".join(re.escape(chr(c)) for c in range(128) if not chr(c).isalnum())
_PARTS = re.compile(f"[{_ASCII}\u00a0\u00ab\u00bb\u2010-\u2027\u3000-\u3003]+")


def item_words(text):
    return [w for w in _PARTS.split((text or "").lower()) if w]


def shingle_set(words, width):
    return {" ".join(words[i : i + width]) for i in range(len(words) - width + 1)}


def plain_contamination(docs, items):
    found, doc_words = set(), [(d, item_words(t)) for d, t in docs]
    for item_id, text in items:
        w = item_words(text)
        if not w:
            continue
        width = min(5, len(w))
        mine = shingle_set(w, width)
        for d, words in doc_words:
            shared = len(mine & shingle_set(words, width))
            if shared >= 0.8 * len(mine):
                found.add((d, item_id, shared, len(mine)))
    return found


def test_decontamination_query_equals_brute_force(spark, corpus):
    _, docs = corpus
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    sets = {d: item_words(t) for d, t in docs}
    shingled = {d: shingle_set(w, 5) for d, w in sets.items()}
    want = set()
    for i, t in items:
        mine = shingle_set(item_words(t), 5)
        want |= {(d, i, len(mine & s), len(mine)) for d, s in shingled.items() if mine and len(mine & s) >= 0.8 * len(mine)}
    got = {(r["doc_id"], r["item_id"], r["n_shared"], r["n_item"]) for r in queries.benchmark_decontamination(spark, DATA).collect()}
    assert got == want and len(want) > 5


def test_decontamination_small_items_edits_and_edges(spark, edge, empty):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(400)]
    item = [rng.choice(vocabulary) for _ in range(120)]
    few, many = item[:], item[:]
    few[10] = few[90] = "x"
    for i in range(0, 120, 9):
        many[i] = "x"
    noise = [rng.choice(vocabulary) for _ in range(3000)]
    docs = [(1, " ".join(noise + few + noise)), (2, " ".join(noise + many)), (3, "A, b! C d? e"), (4, "two words"), (None, "said: TWO-words."), (5, None), (6, ""), (4, "two words")]
    items = [(10, " ".join(item)), (11, "a b c d"), (12, "two words"), (13, ""), (14, None), (12, "two words"), (15, "zz")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    got = {(r["doc_id"], r["item_id"], r["n_shared"], r["n_item"]) for r in decontamination.contaminated(d, i).collect()}
    assert got == plain_contamination(docs, items)
    assert {(x, y) for x, y, *_ in got} == {(1, 10), (3, 11), (4, 12), (None, 12)}
    kept = decontamination.decontaminated(d, i)
    assert kept.columns == d.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 5, 6]
    assert decontamination.contaminated(empty, i).count() == 0
    assert decontamination.contaminated(d, i.limit(0)).count() == 0
    assert decontamination.contaminated(edge, i).count() == 0


def test_need_bounds_the_chance_of_a_miss():
    for n in (17, 30, 31, 32, 100, 1000):
        k = decontamination.sketch_length(n)
        assert 1 <= decontamination.hits_needed(k, False) <= k * 0.8
    assert [decontamination.hits_needed(k, True) for k in (1, 2, 5, 10)] == [1, 2, 4, 8]


def line_set(line):
    return {line[i : i + 12] for i in range(max(1, len(line) - 11))}


def plain_line_groups(docs):
    """(doc, line number) to drop, comparing all pairs of distinct lines that share a shingle.

    Also those of them that only a near copy explains: the first place of each line but the first of a component.
    """
    places = defaultdict(list)
    for d, text in docs:
        for i, line in enumerate((text or "").split("\n")):
            if line.strip(" \t\r\x0b\x0c"):
                places[line].append((d, i))
    lines = sorted(places)
    sets, by = [line_set(x) for x in lines], defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            by[x].append(i)
    edges = set()
    for i, s in enumerate(sets):
        near = defaultdict(int)
        for x in s:
            for j in by[x]:
                near[j] += j > i
        edges |= {(i, j) for j, n in near.items() if n and n >= 0.8 * (len(s) + len(sets[j]) - n)}
    root, groups, heads = union_find(range(len(lines)), edges), defaultdict(list), defaultdict(list)
    for i, line in enumerate(lines):
        groups[root[i]] += places[line]
        heads[root[i]].append(min(places[line]))
    drop = {p for g in groups.values() for p in g if p != min(g)}
    return drop, {p for g in heads.values() for p in g if p != min(g)}


def test_line_query_against_all_pairs(spark, corpus):
    _, docs = corpus
    want, fuzzy = plain_line_groups(docs)
    got = set()
    for r in queries.fuzzy_line_dedup(spark, DATA).collect():
        numbers = [int(x) for x in r["dropped"].split(",") if x]
        assert len(numbers) == r["n_dropped"] <= r["n_lines"] and numbers == sorted(numbers)
        got |= {(r["doc_id"], n) for n in numbers}
    assert not got - want  # nothing is dropped that has no copy or near copy
    assert not want - got - fuzzy  # no exact copy is missed
    assert len(fuzzy) > 50 and len(fuzzy & got) >= 0.97 * len(fuzzy)  # banding is of high recall, not exact


def test_lines_fuzzy_edges_and_rebuilding(spark, edge, empty):
    words = "the harbour keeps a quiet ledger of ships and tides that nobody has read for forty years and more because the keeper left one winter without a word and his daughter sold the house to strangers from the north".split()
    near = words[:]
    near[9] = "boats"
    far = words[:5] + ["otherwise", "nothing", "of", "this", "line", "is", "the", "same", "as", "before", "it"]
    a, b, c = " ".join(words), " ".join(near), " ".join(far)
    cjk = "漢字" * 20
    docs = [(1, f"{a}\n\n{c}\nx"), (2, f"{b}\nkept here"), (3, f"{a}\n{b}"), (4, None), (5, " \n"), (6, cjk + "一二三四五六七八九十" * 5), (7, cjk + "もの" * 25)]
    df = spark.createDataFrame([(d, t, "p") for d, t in docs], "doc_id long, text string, line_no string")
    out = line_dedup.without_repeated_lines(df)
    assert out.columns == df.columns
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: docs[0][1], 2: "kept here", 4: None, 5: " \n", 6: docs[5][1], 7: docs[6][1]}
    report = line_dedup.line_report(edge)
    assert report.count() == edge.count()
    got = {(r["doc_id"]): list(r["dropped"]) for r in report.collect()}
    assert got[5] == [0] and got[6] == [0] and got[None] == []  # nulls come first
    assert line_dedup.line_report(empty).count() == 0


def test_lines_of_a_template_link_to_any_line_of_their_bucket(spark):
    """Lines that share a bucket's head are linked among themselves, in one block and in many."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("bcdfghjklmnp", k=8))
    template = [word() for _ in range(14)]
    texts = []
    for _ in range(150):
        own = [word() for _ in range(8)]
        texts += [" ".join(template[:7] + own + template[7:]), " ".join(template[:7] + own + template[7:-1] + [word()])]
    sets = [line_set(x) for x in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    near = {(i, j) for i in range(300) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert near == {(i, i - 1) for i in range(1, 300, 2)}
    # one bucket for all, so that a pair can only be missed inside it
    lines = line_dedup._lines(df, "doc_id", "text")
    bands = lines.select("k1", "k2", F.lit(1).alias("places"), F.col("place").alias("pick"), *[F.lit(i).cast("long").alias(f"b{i}") for i in range(line_dedup.BANDS)])
    block = line_dedup.BLOCK
    for line_dedup.BLOCK in (block, 64):
        try:
            label = line_dedup._near_lines(bands, lines).collect()
        finally:
            line_dedup.BLOCK = block
        assert len(label) == 150
    got = {r["doc_id"] for r in line_dedup.line_report(df).where("n_dropped > 0").collect()}
    assert len(got) >= 147 and got <= set(range(1, 300, 2))


def test_lines_without_spaces_survive_an_insertion(spark):
    rng = random.Random(8)
    japanese = "".join(chr(rng.randrange(0x3042, 0x3090)) for _ in range(70))
    row = "\t".join(str(rng.randrange(10**4, 10**6)) for _ in range(30))
    url = "://example.org/" + "".join(rng.choices("abcdefgh/-0123", k=90))
    wide = "\u3000".join("".join(chr(rng.randrange(0x3042, 0x3090)) for _ in range(5)) for _ in range(30))
    texts = [japanese, "\u3001" + japanese, row, "1" + row, "http" + url, "https" + url, wide, "\u3042" + wide]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in line_dedup.line_report(df).where("n_dropped > 0").collect()} == {1, 3, 5, 7}


def test_short_lines_meet_as_often_as_stated(spark):
    rng = random.Random(4)
    letters = ["".join(rng.choices("abcdefghijkl", k=16)) for _ in range(1500)]
    texts = [w[:n] for w in letters for n in (15, 16)]  # 4 shingles and 5
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    dropped = line_dedup.line_report(df).where("n_dropped > 0").count()
    assert 0.97 * 1500 <= dropped <= 1500  # a chance of 1 % each


def test_shared_shingles_are_counted_exactly(spark):
    """Lines with repeats, shorter than a shingle, beginnings of one another and beyond the BMP: only what differs is hashed."""
    rng, pairs = random.Random(1), []
    for _ in range(1500):
        letters, n = rng.choice(["ab", "abcdefghij", "a\U0001f600\u00e9\u6f22 b"]), rng.choice([1, 5, 11, 12, 13, 20, 60, 200])
        a = b = "".join(rng.choices(letters, k=n)) * rng.choice([1, 1, 2, 3])
        for _ in range(rng.randrange(1, 4)):
            k = rng.randrange(len(b) + 1)
            b = b[:k] + "".join(rng.choices(letters, k=rng.randrange(3))) + b[k + rng.randrange(3) :]
        b = rng.choice([b] * 6 + [a + b, b + a, a[: len(a) // 2], a[len(a) // 3 :]])
        if a and b and a != b:
            pairs.append((a, b, len(line_set(a)), len(line_set(b)), len(line_set(a) & line_set(b))))
    df = spark.createDataFrame(pairs, "of_a string, of_b string, a_size int, b_size int, want int")
    both = line_dedup.let(F.encode("of_a", "UTF-32"), lambda p: line_dedup.let(F.encode("of_b", "UTF-32"), lambda q: line_dedup._shared_shingles(p, q)))
    assert len(pairs) > 1000 and df.where(both != F.col("want")).count() == 0


def test_marks_are_of_sets_and_made_in_compiled_code(spark, monkeypatch):
    """Lines with repeats, of one shingle, about a run's length, long and beyond the BMP: each moves once, and no list is interpreted."""
    rng = random.Random(9)
    run = line_dedup.RUN
    texts = ["a", "ab" * 40, "x" * 500, "\U0001f600é漢" * 30, "only eleven", "just twelve!"]
    texts += ["".join(rng.choices("abcdefghij é漢\U0001f600", k=n)) for n in (run + 10, run + 11, run + 12, 2 * run + 11, 2 * run + 12, 3000)]
    texts += [x + x[: len(x) // 2] for x in texts[6:]]
    df = spark.createDataFrame(list(enumerate(texts)), "k1 long, line string")
    monkeypatch.setattr(line_dedup, "written", lambda made, name: made)
    marks = line_dedup._marks(df)
    got = {r["k1"]: (r["size"], [r[f"p{w}"] % 2**64 for w in range(line_dedup.PARITY)]) for r in marks.collect()}
    want = {}
    for i, text in enumerate(texts):
        hashes = {xxhash.xxh64_intdigest(s.encode("utf-32-be"), 42) for s in line_set(text)}
        words = [0] * line_dedup.PARITY
        for h in hashes:
            words[(h >> 6) % line_dedup.PARITY] ^= 1 << (h & 63)
        want[i] = (len(hashes), words)
    assert got == want
    plan = marks._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan.lower() and plan.split("Initial Plan")[0].count("Exchange hashpartitioning") == 1
