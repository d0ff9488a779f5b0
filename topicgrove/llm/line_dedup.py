"""Line dedup: exact and fuzzy copies of lines across documents; one line of each component stays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicgrove.llm.components import components
from topicgrove.llm.storage import let, maybe_among, named_again, numbered, place_of, written

#: A line's shingles are the SHINGLE characters (code points) from each of its places on; a shorter line is one shingle.
SHINGLE, THRESHOLD = 12, 0.8
#: One order of the shingles' 64-bit hashes a band: the hashes turned by TURN bits more, so that other bits lead. Its
#: smallest and largest value are two MinHash values. A pair with c of u shingles in common misses all bands with chance
#: (1 - c (c - 1) / (u (u - 1)))^5: 1.0 % at 4 of 5, 0.8 % at 8 of 10, 0.6 % for long lines, at a similarity of 0.8.
BANDS, TURN = 5, 13
#: Lines of a bucket, by expectation, with which all others are compared, and rows of a block of the full comparison.
PIVOTS, BLOCK = 32, 1024
#: Longs of a set's parity, 64 bits each.
PARITY = 8
#: Bytes of a character in UTF-32, so that a place is found without reading what is before it.
_WIDE = 4
#: Octets by which a common beginning or end of two lines is told, in turn: to 8 characters, of 16,376 at most.
STEPS = tuple(_WIDE << k for k in range(13, 2, -1))
#: Shingles of a row of the exploded lines: their values are compared before the row is looked up in the aggregation.
STRIDE = 4
#: Hashes that compiled code puts in one array; functions over lists of places are interpreted, at several times the cost.
RUN = 32


def _last(points: str) -> Column:
    return F.greatest(F.lit(0), F.octet_length(points) - F.lit(_WIDE * SHINGLE))


def _hashed(points: Column, at: Column) -> Column:
    return F.xxhash64(F.substring(points, at + 1, F.lit(_WIDE * SHINGLE)))


def _set_hashes(rows: DataFrame, key: str, line: str) -> DataFrame:
    """(key, hashes): the 64-bit hashes of each line's set of shingles, for rows that are dealt by ``key``, one a key.

    Compiled code makes them, RUN in an array, and a line's arrays come together where they are made. The last array
    repeats its last hash, and lines repeat shingles: each hash stays once.
    """
    coded = rows.select(key, F.encode(line, "UTF-32").alias("points")).withColumn("last", _last("points"))
    each = coded.select(key, "points", "last", F.explode(F.sequence(F.lit(0), F.col("last"), F.lit(_WIDE * RUN))).alias("at"))
    some = F.array(*[_hashed(F.col("points"), F.least(F.col("at") + _WIDE * j, F.col("last"))) for j in range(RUN)])
    return each.select(key, some.alias("some")).groupBy(key).agg(F.array_distinct(F.flatten(F.collect_list("some"))).alias("hashes"))


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, doc_hash, line_no, line, k1, k2, place) of the lines that are not blank."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(text).alias("doc_hash"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    rows = rows.where(F.ltrim("line", F.lit(" \t\r\x0b\x0c")) != "")  # trimming an end lists all characters before it
    return rows.withColumns({"k1": F.xxhash64("line"), "k2": F.xxhash64(F.lit(7), "line"), "place": F.xxhash64("doc_id", "doc_hash", "line_no")})


def _bands(lines: DataFrame) -> DataFrame:
    """Each distinct line once: the number of its places, one of them, and its bands.

    Shingles are exploded and come together again in the map-side aggregation of the same stage, so that no list of
    hashes is made and what is shuffled is a row a distinct line of each task.
    """
    coded = lines.select("k1", "k2", "place", F.encode("line", "UTF-32").alias("points")).withColumn("last", _last("points"))
    each = coded.select("k1", "k2", "place", "points", "last", F.explode(F.sequence(F.lit(0), F.col("last"), F.lit(_WIDE * STRIDE))).alias("at"))
    some = [_hashed(F.col("points"), F.least(F.col("at") + _WIDE * j, F.col("last")) if j else F.col("at")).alias(f"s{j}") for j in range(STRIDE)]
    hashed = each.select("k1", "k2", "place", "at", *some)
    turn = lambda h, i: F.shiftleft(h, TURN * i).bitwiseOR(F.shiftrightunsigned(h, 64 - TURN * i)) if i else F.col(h)
    turned = hashed.select("k1", "k2", "place", "at", *[turn(f"s{j}", i).alias(f"t{i}_{j}") for i in range(BANDS) for j in range(STRIDE)])
    ends = [(name, i, f(*[F.col(f"t{i}_{j}") for j in range(STRIDE)])) for i in range(BANDS) for name, f in (("least", F.least), ("most", F.greatest))]
    met = turned.select("k1", "k2", "place", "at", *[c.alias(f"{name}{i}") for name, i, c in ends])
    values = [f(f"{name}{i}").alias(f"{name}{i}") for i in range(BANDS) for name, f in (("least", F.min), ("most", F.max))]
    signed = met.groupBy("k1", "k2").agg(F.sum((F.col("at") == 0).cast("long")).alias("places"), F.min("place").alias("pick"), *values)
    return signed.select("k1", "k2", "places", "pick", *[F.xxhash64(F.lit(i), f"least{i}", f"most{i}").alias(f"b{i}") for i in range(BANDS)])


def _texts(wanted: DataFrame, lines: DataFrame) -> DataFrame:
    """(k1, line) of the wanted lines, each read at its picked place alone."""
    rows = maybe_among(lines.select(F.col("place").alias("pick"), "k1", "line"), wanted, "pick")
    once = rows.groupBy("pick", "k1").agg(F.any_value("line").alias("line"))  # rows that repeat a document
    return written(once.join(wanted.select("pick", "k1"), ["pick", "k1"], "left_semi").dropDuplicates(["k1"]).select("k1", "line"), "texts")


def _common(p: Column, q: Column, at: Callable[[Column, Column, Column], Column], most: Column) -> Column:
    """Octets, ``most`` at most, of a stretch of ``p`` and ``q`` that is equal: all of it but for few, found by halving."""
    equal = lambda n, w: (n + w <= most) & (F.substring(p, at(p, n, w) + 1, w) == F.substring(q, at(q, n, w) + 1, w))
    return F.aggregate(F.array(*map(F.lit, STEPS)), F.lit(0), lambda n, w: F.when(equal(n, w), n + w).otherwise(n))


def _shared_shingles(p: Column, q: Column) -> Column:
    """How many shingles the sets of two lines share, of ``a_size`` and ``b_size``.

    Shingles inside a common beginning or end are in both sets. Of those that touch what is between, the ones that
    the other line has not between are missing from it, unless its beginning or end repeats them: they are then
    repeated in their own line too, so a line as many of whose shingles differ as it has places cannot hold one. Where
    both lines repeat shingles, those of one between are sought in the whole other line.
    """
    size = F.octet_length
    least = F.least(size(p), size(q))
    whole = least < _WIDE * SHINGLE  # a shorter line is a shingle of its own, which no longer line has
    ahead = F.when(whole, 0).otherwise(_common(p, q, lambda x, n, w: n, least))
    behind = lambda n: F.when(whole, 0).otherwise(_common(p, q, lambda x, m, w: size(x) - m - w, least - n))

    def counted(n: Column, m: Column) -> Column:
        first = F.greatest(F.lit(0), n - _WIDE * (SHINGLE - 1))
        last = lambda x: F.least(F.greatest(F.lit(0), size(x) - _WIDE * SHINGLE), size(x) - m - _WIDE)
        places = lambda x: F.when(first <= last(x), F.sequence(first, last(x), F.lit(_WIDE))).otherwise(F.array().cast("array<int>"))
        between = lambda x: F.transform(places(x), lambda at: _hashed(x, at))
        every = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), size(q) - _WIDE * SHINGLE), F.lit(_WIDE)), lambda at: _hashed(q, at))
        once = lambda x, n_: whole | (size(x) - _WIDE * (SHINGLE - 1) == _WIDE * n_)
        lacks = lambda x, y: F.size(F.array_except(x, y))
        a, b = F.col("a_size"), F.col("b_size")
        return F.when(once(p, a), a - lacks(between(p), between(q))).when(once(q, b), b - lacks(between(q), between(p))).otherwise(a - lacks(between(p), every))

    return let(ahead, lambda n: let(behind(n), lambda m: counted(n, m)))


def _alike(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of lines whose shingle sets have an exact Jaccard similarity of THRESHOLD at least."""
    one = texts.select(F.col("k1").alias("a"), F.col("line").alias("of_a"))
    two = texts.select(F.col("k1").alias("b"), F.col("line").alias("of_b"))
    both = let(F.encode("of_a", "UTF-32"), lambda p: let(F.encode("of_b", "UTF-32"), lambda q: _shared_shingles(p, q)))
    # filtered once it is written: the filter would move below and make the sets again
    measured = written(pairs.join(one, "a").join(two, "b").select("a", "b", "a_size", "b_size", both.alias("both")), "alike")
    return measured.where(F.col("both") >= F.lit(THRESHOLD) * (F.col("a_size") + F.col("b_size") - F.col("both"))).select("a", "b")


def _named(rows: DataFrame, label: DataFrame, key: str, name: str) -> DataFrame:
    """``rows`` with the component of the line in ``key`` as a column ``name``."""
    step = label.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    return rows.join(step, F.col(key) == F.col("_node"), "left").withColumn(name, F.coalesce("_root", key)).drop("_node", "_root")


def _merged(label: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, root) once the components of ``label`` are joined by further links between lines."""
    if label is None:
        return written(components(links), "lines")
    if links.isEmpty():
        return label
    between = _named(_named(links, label, "a", "x"), label, "b", "y").select("x", "y")
    over = components(between, "x", "y")
    step = over.select(F.col("node").alias("old"), F.col("root").alias("new"))
    moved = label.join(step, label.root == step.old, "left").select("node", F.coalesce("new", "root").alias("root"))
    return written(moved.unionByName(over), "lines")


def _mixed(shared: DataFrame, label: DataFrame, least: int) -> DataFrame:
    """(bucket, k1, n, comp) of the buckets that have more than ``least`` lines and several components."""
    named = _named(shared.where(F.col("n") > least), label, "k1", "comp")
    several = named.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("bucket")
    return written(named.join(several, "bucket"), "mixed")


def _marks(texts: DataFrame) -> DataFrame:
    """(k1, size, p0, p1, ...): the size of each line's shingle set, and its parity.

    A bit of the parity is that of the number of elements that hash to it, so sets that differ in d elements have
    parities that differ in d bits at most. Lines are dealt by k1 once: nothing made of a line moves again.
    """
    each = _set_hashes(texts.repartition("k1"), "k1", "line").select("k1", F.explode("hashes").alias("h"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(F.lit(63)).cast("int"))
    word = F.shiftrightunsigned("h", 6).bitwiseAND(F.lit(PARITY - 1)).cast("int")
    words = each.select("k1", word.alias("word"), bit.alias("bit")).groupBy("k1", "word").agg(F.count("*").alias("n"), F.bit_xor("bit").alias("bits"))
    parity = [F.bit_xor(F.when(F.col("word") == w, F.col("bits")).otherwise(F.lit(0).cast("long"))).alias(f"p{w}") for w in range(PARITY)]
    return written(words.groupBy("k1").agg(F.sum("n").cast("int").alias("size"), *parity), "marks")


def _members(mixed: DataFrame, marks: DataFrame, wanted: DataFrame) -> DataFrame:
    """``mixed`` with the lines' marks, their buckets, the number of the bucket's band, and whether they are pivots."""
    band = F.lit(BANDS - 1)
    for i in reversed(range(BANDS - 1)):
        band = F.when(F.col("bucket") == F.col(f"b{i}"), i).otherwise(band)
    return mixed.join(marks, "k1").join(wanted.drop("pick"), "k1").withColumn("band", band)


def _is_pivot() -> Column:
    return F.pmod(F.xxhash64("k1"), "n") < PIVOTS


_LIGHT = ["k1", "size", *[f"p{w}" for w in range(PARITY)]]


def _side(rows: DataFrame, name: str, *keys: Column, more: tuple[str, ...] = ("comp", *[f"b{i}" for i in range(BANDS - 1)])) -> DataFrame:
    return rows.select(*keys, *[F.col(c).alias(f"{name}_{c}") for c in (*_LIGHT, *more)])


def _may_be_alike() -> Column:
    """Two sets of Jaccard similarity t differ in (1 - t) / (1 + t) of both sizes at most: at 0.8, in a ninth."""
    bits = sum(F.bit_count(F.col(f"a_p{w}").bitwiseXOR(F.col(f"b_p{w}"))) for w in range(PARITY))
    return (5 * F.least("a_size", "b_size") >= 4 * F.greatest("a_size", "b_size")) & (9 * bits <= F.col("a_size") + F.col("b_size"))


def _met_first() -> Column:
    """Whether the lines meet in no bucket of an earlier band."""
    first = F.lit(True)
    for i in range(BANDS - 1):
        first = first & ((F.col("band") <= i) | (F.col(f"a_b{i}") != F.col(f"b_b{i}")))
    return first


def _pairs(met: DataFrame) -> DataFrame:
    return written(met.select(F.col("a_k1").alias("a"), F.col("b_k1").alias("b"), "a_size", "b_size"), "pairs")


def _with_heads(shared: DataFrame, marks: DataFrame) -> DataFrame:
    """Pairs of each line with the smallest one of each of its buckets."""
    pairs = shared.where("k1 <> head").select(F.col("k1").alias("a_k1"), F.col("head").alias("b_k1")).distinct()
    return _pairs(pairs.join(_side(marks, "a", more=()), "a_k1").join(_side(marks, "b", more=()), "b_k1").where(_may_be_alike()))


def _blocks() -> Column:
    return F.ceil(F.col("n") / F.lit(BLOCK))


def _with_pivots(members: DataFrame) -> DataFrame:
    """Pairs of each line of a bucket with each of about PIVOTS of its lines: with all, where it has no more."""
    block = F.pmod(F.xxhash64("k1", F.lit(1)), _blocks()).alias("i")
    every = F.explode(F.sequence(F.lit(0).cast("long"), _blocks() - 1)).alias("i")
    marked = members.withColumn("pivot", _is_pivot())
    left = _side(marked, "a", F.col("bucket"), block, more=("comp", "pivot"))
    right = _side(marked.where("pivot"), "b", F.col("bucket"), every, more=("comp",))
    once = ~F.col("a_pivot") | (F.col("a_k1") < F.col("b_k1"))
    met = left.join(right, ["bucket", "i"]).where(once & (F.col("a_comp") != F.col("b_comp")) & _may_be_alike())
    return _pairs(met.select("a_k1", "b_k1", "a_size", "b_size").distinct())


def _in_blocks(members: DataFrame) -> DataFrame:
    """Pairs of all lines of each bucket that were no pivots, compared in blocks of BLOCK by BLOCK lines."""
    dealt = members.where(~_is_pivot()).withColumn("mine", F.pmod(F.xxhash64("k1", F.lit(1)), _blocks())).withColumn("end", _blocks() - 1)
    left = _side(dealt, "a", F.col("bucket"), F.col("band"), F.col("mine").alias("i"), F.explode(F.sequence(F.col("mine"), F.col("end"))).alias("j"))
    right = _side(dealt, "b", F.col("bucket"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("mine"))).alias("i"), F.col("mine").alias("j"))
    once = (F.col("i") < F.col("j")) | (F.col("a_k1") < F.col("b_k1"))
    met = left.join(right, ["bucket", "i", "j"]).where(once & (F.col("a_comp") != F.col("b_comp")) & _met_first() & _may_be_alike())
    return _pairs(met)


def _near_lines(bands: DataFrame, lines: DataFrame) -> DataFrame:
    """(node, root): components of the distinct lines, named by k1, that are alike and share a bucket.

    1. In each bucket every line is compared with the smallest one, a row a line: near copies by the thousand become
       one component without a pair each.
    2. In buckets that still hold several components every line is compared with about PIVOTS others of other
       components. Buckets of no more lines than that are then compared in full.
    3. The larger ones of them that still hold several components are compared in full, in blocks.

    Sizes and parities, which stand in the rows, spare all but the pairs that may be alike, and each of
    these is then verified on the texts. No pair of a bucket is left out: the work on a bucket of n lines of many
    components grows with the square of n, spread over its blocks.
    """
    names = [f"b{i}" for i in range(BANDS)]
    rows = bands.select("k1", F.explode(F.array(*names)).alias("bucket"))
    several = written(rows.groupBy("bucket").agg(F.min("k1").alias("head"), F.count("*").alias("n")).where("n > 1"), "several")
    shared = written(maybe_among(rows, several, "bucket").join(several, "bucket"), "shared")
    wanted = written(bands.select("k1", "pick", *names).join(shared.select("k1").distinct(), "k1", "left_semi"), "wanted")
    texts = _texts(wanted, lines)
    marks = _marks(texts)
    label = _merged(None, _alike(_with_heads(shared, marks), texts))
    mixed = _mixed(shared.drop("head"), label, 2)
    if mixed.isEmpty():
        return label
    label = _merged(label, _alike(_with_pivots(_members(mixed, marks, wanted)), texts))
    mixed = _mixed(mixed.drop("comp"), label, PIVOTS)
    if mixed.isEmpty():
        return label
    return _merged(label, _alike(_in_blocks(_members(mixed, marks, wanted)), texts))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, doc_hash, line_no, root): places of lines that repeat an earlier line, to be dropped.

    Lines are parted by line feeds; blank ones are never dropped. Equal lines are one vertex. Distinct lines meet
    by bands of MinHash over their character shingles, those of a common bucket are linked at an exact Jaccard
    similarity of 0.8 of the sets, and a
    distributed union-find gives the components; in each the first place in (doc_id, doc_hash, line_no) stays.
    ``doc_hash`` is xxhash64 of the whole text: rows with equal id and text are one place each line, rows with equal id
    and other texts are documents of their own. Null ids come first; null and empty texts have no lines; an empty
    table has no places. A line of any length is read whole, in time and memory that grow with it.
    """
    lines = _lines(docs, id_col, text_col)
    bands = written(_bands(lines), "bands")
    label = _near_lines(bands, lines)
    near = label.select(F.col("node").alias("k1"), "root").unionByName(label.select(F.col("root").alias("k1"), "root").distinct())
    copied = bands.where("places > 1").select("k1", "k2").join(near, "k1", "left_anti")
    groups = written(near.select("k1", F.lit(None).cast("long").alias("only"), "root").unionByName(copied.select("k1", F.col("k2").alias("only"), F.lit(None).cast("long").alias("root"))), "groups")
    # of each group, named by (root) or (k1, k2), only the places move
    places = maybe_among(lines.select("doc_id", "doc_hash", "line_no", "k1", "k2"), groups, "k1").join(groups, "k1")
    places = places.where("only is null or only = k2").select("doc_id", "doc_hash", "line_no", F.coalesce("root", "k1").alias("root"), F.coalesce("only", F.lit(0)).alias("only"))
    places = written(places, "places")
    place = F.struct("doc_id", "doc_hash", "line_no")
    # written, so that the join deals both sides itself and may split a group of very many places
    first = written(places.groupBy("root", "only").agg(F.min(place).alias("first")), "first")
    return places.join(first, ["root", "only"]).where(place != F.col("first")).select("doc_id", "doc_hash", "line_no", "root").distinct()


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, doc_hash, n_lines, n_dropped, dropped): a row a row of ``docs``; numbers of dropped lines, ascending.

    Rows that repeat id and text get equal reports: they are one document. An empty table gives an empty report.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    dropped = repeated_lines(docs, id_col, text_col).groupBy("doc_id", "doc_hash").agg(F.sort_array(F.collect_list("line_no")).alias("dropped"))
    filled = F.regexp_count(text, F.lit(r"(?md)^[ \t\r\x0B\x0C]*+[^ \t\r\x0B\x0C\n]"))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(text).alias("doc_hash"), filled.cast("long").alias("n_lines")).alias("r")
    d = dropped.alias("d")
    same = F.col("r.doc_id").eqNullSafe(F.col("d.doc_id")) & (F.col("r.doc_hash") == F.col("d.doc_hash"))
    none = F.array().cast("array<int>")
    return rows.join(d, same, "left").select("r.doc_id", "r.doc_hash", "n_lines", F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), F.coalesce("dropped", none).alias("dropped"))


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated lines taken out of their texts, all columns kept, whatever they are called.

    A document that keeps no line but blank ones is left out; one that had none stays as it is. Rows that repeat id
    and text are treated alike; an empty table stays empty.
    """
    rows, at = numbered(docs), place_of(docs, text_col)
    id_at, text_at = f"c{place_of(docs, id_col)}", f"c{at}"
    d = repeated_lines(rows, id_at, text_at).groupBy(F.col("doc_id").alias("_id"), F.col("doc_hash").alias("_hash")).agg(F.collect_list("line_no").alias("_dropped"))
    text = F.coalesce(F.col(text_at).cast("string"), F.lit(""))
    joined = rows.join(d, F.col(id_at).eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_hash")), "left")
    parts = F.split(text, "\n")
    left = let(parts, lambda p: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(p) - 1), F.col("_dropped")), lambda i: F.get(p, i)), "\n"))
    made = joined.withColumn("_kept", F.when(F.col("_dropped").isNotNull(), left))
    made = made.where(F.col("_dropped").isNull() | F.col("_kept").rlike(r"[^ \t\r\x0B\x0C\n]"))
    return named_again(made.withColumn(text_at, F.coalesce("_kept", F.col(text_at))), docs.columns)
