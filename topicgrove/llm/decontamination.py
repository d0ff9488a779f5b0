"""Benchmark decontamination: MinHash containment search, partitioned by size, with exact verification."""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicgrove.llm.storage import bounded, maybe_among, named_again, numbered, place_of, without, written

WORDS, THRESHOLD = 5, 0.8
#: chance that an item contained to the threshold has fewer sketch hits than are asked for
MISS = 1e-6
#: ASCII characters that part words, each named alone so that the class is one table look-up, and other punctuation
_PARTING = "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum())
_SEPARATOR = f"[{_PARTING}\\u00A0\\u00AB\\u00BB\\u2010-\\u2027\\u3000-\\u3003]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), _SEPARATOR), "")


def _starts(words: str, width: int) -> Column:
    n = F.size(words)
    return F.when(n >= width, F.sequence(F.lit(0), n - width)).otherwise(F.array().cast("array<int>"))


def shingle_hashes(words: str, width: int) -> Column:
    return F.array_distinct(F.transform(_starts(words, width), lambda i: F.xxhash64(*[F.get(F.col(words), i + k) for k in range(width)])))


def shingles(words: str, width: int) -> Column:
    return F.array_distinct(F.transform(_starts(words, width), lambda i: F.array_join(F.slice(F.col(words), i + 1, width), " ")))


def sketch_length(n: int) -> int:
    """Values kept of an item of n shingles: all up to 16, then 4 more for each doubling."""
    return min(n, 16 + 4 * max(0, n.bit_length() - 5))


def hits_needed(k: int, whole: bool) -> int:
    """Sketch hits to ask of an item: exact if the sketch is the whole set, else missed with chance MISS at most.

    The hits of a contained item are hypergeometric, which the binomial tail bounds.
    """
    if whole:
        return max(1, -int(-THRESHOLD * k // 1))
    tail = need = 0
    while True:
        tail += comb(k, need) * THRESHOLD**need * (1 - THRESHOLD) ** (k - need)
        if tail > MISS:
            return max(1, need)
        need += 1


def item_sketches(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, width, n, k, shingles, sketch): items partitioned by size, each with a bottom-k MinHash sketch.

    ``width`` is the shingle length: 5 words, or all of an item's words if it has fewer. ``k`` depends on the size
    class (doublings of the shingle count) alone.
    """
    sized = items.select(F.col(id_col).alias("item_id"), words_of(F.col(text_col)).alias("words"))
    sized = sized.where(F.size("words") > 0).withColumn("width", F.least(F.lit(WORDS), F.size("words")))
    each = None
    for width in range(1, WORDS + 1):
        some = sized.where(F.col("width") == width).select("item_id", "width", shingles("words", width).alias("shingles"), F.sort_array(shingle_hashes("words", width)).alias("hashes"))
        each = some if each is None else each.unionByName(some)
    n = F.size("shingles")
    doublings = F.floor(F.log2(n.cast("double"))).cast("int") + 1
    k = F.least(n, 16 + 4 * F.greatest(F.lit(0), doublings - 5))
    return each.select("item_id", "width", n.alias("n"), k.alias("k"), "shingles", F.slice("hashes", F.lit(1), k).alias("sketch"))


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment): items of which a document holds 0.8 of the shingles or more.

    Words are lower-cased runs without punctuation. Each document's distinct shingle hashes are looked up among the
    sketches of all items; pairs with the hits that the item's size class asks for are candidates. Candidates are
    verified on the shingles themselves, over the documents that have one; texts never move. A shingle that many
    documents share costs a row a document; counting is pre-aggregated, and no pair of documents is ever made.

    Null and empty texts hold nothing; items without words are never found; items under 5 words are searched
    whole. Rows that repeat a document id, or an item id, count as one document or item; null ids are a key like
    any other. Empty tables give an empty result; other columns are ignored.
    """
    items = written(item_sketches(items, item_col, item_text_col), "items")
    widths = sorted(r["width"] for r in items.select("width").distinct().collect())  # at most 5
    kinds = {"doc_id": docs.schema[id_col].dataType.simpleString(), "item_id": items.schema["item_id"].dataType.simpleString()}
    if not widths:
        empty = f"doc_id {kinds['doc_id']}, item_id {kinds['item_id']}, n_shared long, n_item long, containment double"
        return docs.sparkSession.createDataFrame([], empty)
    lengths = sorted({sketch_length(1 << b) for b in range(40)} | set(range(1, 17)))
    partial = F.create_map(*[F.lit(x) for k in lengths for x in (k, hits_needed(k, False))])
    need = F.when(F.col("k") == F.col("n"), F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(THRESHOLD)))).otherwise(F.element_at(partial, F.col("k"))).cast("int")
    probes = written(items.select("item_id", "width", need.alias("need"), F.explode("sketch").alias("hash")), "probes")
    texts = docs.select(F.col(id_col).alias("doc_id"), words_of(F.col(text_col)).alias("words"))

    found = None
    for width in widths:
        hashes = texts.select("doc_id", F.explode(shingle_hashes("words", width)).alias("hash"))
        hits = hashes.join(bounded(probes.where(F.col("width") == width)), "hash")
        found = hits if found is None else found.unionByName(hits)
    # a hash counts once for an id, however many of its rows hold it
    counted = found.groupBy("doc_id", "item_id", "hash").agg(F.max("need").alias("need"))
    counted = counted.groupBy("doc_id", "item_id").agg(F.count("*").alias("hits"), F.max("need").alias("need"))
    candidates = written(counted.where("hits >= need").select("doc_id", "item_id"), "candidates")

    suspects, shared = maybe_among(texts, candidates, "doc_id"), None
    listed = written(items.select("item_id", "width", F.explode("shingles").alias("shingle")), "shingles")
    for width in widths:
        rows = suspects.select("doc_id", F.explode(shingles("words", width)).alias("shingle"))
        both = rows.join(bounded(listed.where(F.col("width") == width)), "shingle").select("doc_id", "item_id", "shingle")
        shared = both if shared is None else shared.unionByName(both)
    shared = shared.distinct().groupBy("doc_id", "item_id").agg(F.count("*").alias("n_shared"))
    c, s = candidates.alias("c"), shared.alias("s")
    same = F.col("c.doc_id").eqNullSafe(F.col("s.doc_id")) & F.col("c.item_id").eqNullSafe(F.col("s.item_id"))
    sizes = bounded(written(listed.distinct().groupBy("item_id").agg(F.count("*").alias("n_item")), "sizes")).alias("z")
    pairs = s.join(c, same, "left_semi").join(sizes, F.col("s.item_id").eqNullSafe(F.col("z.item_id")))
    pairs = pairs.select("s.doc_id", "s.item_id", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))
    return pairs.where(F.col("n_shared") >= F.col("n_item") * F.lit(THRESHOLD))


def decontaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that ``contaminated`` reports, all columns kept, whatever they are called.

    Rows that share an id go or stay together. An empty table stays empty; without items nothing goes.
    """
    rows, at = numbered(docs), f"c{place_of(docs, id_col)}"
    found = contaminated(rows, items, at, f"c{place_of(docs, text_col)}", item_col, item_text_col)
    return named_again(without(rows, written(found.select(F.col("doc_id").alias(at)).distinct(), "contaminated"), at), docs.columns)
