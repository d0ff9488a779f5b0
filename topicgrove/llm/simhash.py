"""SimHash fingerprints and their near-duplicate components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicgrove.llm.components import components
from topicgrove.llm.storage import maybe_among, named_again, numbered, place_of, without, written

WINDOW, SEED, MOST_BITS = 4, 42, 4
#: 64 bits are 8 positional bytes; 4 differing bits spoil 4 of them at most, so a linked pair shares 4 at least.
LEAST_SHARED = 8 - MOST_BITS
BLOCK = 2048
_CHUNK = 1 << 16


def _posting_positions() -> list[tuple[int, int, int]]:
    """Triples of byte positions such that any 4 of the 8 positions contain one of them (Turan's construction)."""
    groups = [(0, 1, 2), (3, 4, 5), (6, 7)]
    triples = [t for g in groups for t in combinations(g, 3)]
    for i, g in enumerate(groups):
        triples += [(a, b, c) for a, b in combinations(g, 2) for c in groups[(i + 1) % 3]]
    return triples


POSITIONS = _posting_positions()


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit SimHash of a text's 4-word shingles; 0 if it has no word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if n < WINDOW:
        first, last = [0], [len(joined)]
    else:
        first, last = starts[: n - WINDOW + 1].tolist(), ends[WINDOW - 1 :].tolist()
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_digest
    for i in range(0, len(first), _CHUNK):
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(first[i : i + _CHUNK], last[i : i + _CHUNK], strict=True)])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(first)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, hash, fp): xxhash64 of each whole text, a null one being empty, and its fingerprint as a signed long."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py()) for t in batch.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints)], names=["doc_id", "hash", "fp"])

    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    return rows.mapInArrow(measure, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, hash long, fp long")


def _byte(i: int) -> F.Column:
    return F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(255))


def postings(prints: DataFrame) -> DataFrame:
    """The inverted index: a row (key, fp) for each fingerprint and triple of positional bytes."""
    keys = []
    for j, (a, b, c) in enumerate(POSITIONS):
        byte_key = F.shiftleft(_byte(a), 16).bitwiseOR(F.shiftleft(_byte(b), 8)).bitwiseOR(_byte(c))
        keys.append(byte_key.bitwiseOR(F.lit(j << 24)))
    return prints.select(F.explode(F.array(*keys)).alias("key"), "fp")


def _linked(a: str, b: str) -> F.Column:
    """Count filter, then verification: enough shared positional bytes, few enough differing bits."""
    differing = F.col(a).bitwiseXOR(F.col(b))
    shared = sum((F.shiftrightunsigned(differing, 8 * i).bitwiseAND(F.lit(255)) == 0).cast("int") for i in range(8))
    return (shared >= LEAST_SHARED) & (F.bit_count(differing) <= MOST_BITS)


def shared_bytes(differing: np.ndarray) -> np.ndarray:
    """The number of positional bytes that two fingerprints share, given their bits that differ."""
    return (differing.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)


def _cross_links(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links between components inside each block of rows, which come sorted by (key, i, j); one a pair of components."""
    held = None

    def links(block: pd.DataFrame) -> pd.DataFrame:
        fp, comp = block["fp"].to_numpy(np.int64).view(np.uint64), block["comp"].to_numpy(np.int64)
        group = block["key"].to_numpy(np.int64), block["i"].to_numpy(np.int64), block["j"].to_numpy(np.int64)
        at, lag, found = np.arange(len(block)), 0, []
        while len(at):  # compare each row with the one lag rows on, as long as both are of one block
            lag += 1
            at = at[at + lag < len(block)]
            at = at[np.logical_and.reduce([g[at] == g[at + lag] for g in group])]
            left, right = at, at + lag
            apart = comp[left] != comp[right]
            left, right = left[apart], right[apart]
            differing = fp[left] ^ fp[right]
            counted = shared_bytes(differing) >= LEAST_SHARED  # the count filter, then verification of what it retains
            left, right, differing = left[counted], right[counted], differing[counted]
            ok = np.bitwise_count(differing) <= MOST_BITS
            if ok.any():
                found.append(np.unique(np.stack([comp[left[ok]], comp[right[ok]]], axis=1), axis=0))
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    for frame in frames:
        frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
        if not len(frame):
            continue
        last = frame.iloc[-1]
        open_block = (frame["key"] == last["key"]) & (frame["i"] == last["i"]) & (frame["j"] == last["j"])
        held, whole = frame[open_block], frame[~open_block]
        if len(whole):
            yield links(whole.reset_index(drop=True))
    if held is not None and len(held):
        yield links(held.reset_index(drop=True))


def print_components(prints: DataFrame) -> DataFrame:
    """(fp, root) for distinct fingerprints that have a link and are not the smallest of their component.

    1. Postings on triples of positional bytes: each linked pair shares 4 of 8 and so meets under one triple.
    2. Each member of a posting list is tallied and verified against the list's smallest member only, which gives
       a row a posting; components of these links come first.
    3. Lists that still hold several components are compared in full inside numpy, in blocks of at most 2 x BLOCK
       rows of one list, and only links between components leave: no link is lost, and near copies by the
       thousand, already one component, give no pairs.
    """
    index = postings(prints)
    lists = index.groupBy("key").agg(F.min("fp").alias("head"), F.count("*").alias("n")).where("n > 1")
    shared = written(index.join(lists, "key"), "postings")
    near = shared.where((F.col("fp") != F.col("head")) & _linked("fp", "head")).select(F.col("fp").alias("a"), F.col("head").alias("b"))
    label = written(components(near.distinct()), "near")

    named = shared.join(label, shared.fp == label.node, "left").select("key", "fp", "n", F.coalesce("root", "fp").alias("comp"))
    mixed = named.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key")
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("long")
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    rows = (
        named.join(mixed, "key")
        .select("key", "fp", "comp", blocks.alias("blocks"))
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("key", "fp", "comp", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    )
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    across = written(dealt.mapInPandas(_cross_links, "a long, b long"), "across")
    if across.isEmpty():
        return label
    over = components(across)
    step = over.select(F.col("node").alias("old"), F.col("root").alias("new"))
    moved = label.join(step, label.root == step.old, "left").select("node", F.coalesce("new", "root").alias("root"))
    return written(moved.unionByName(over), "near")


def _rooted(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, hash, fp) of each row, and (fp, root) of each fingerprint."""
    marked = written(fingerprints(docs, id_col, text_col), "fingerprints")
    prints = written(marked.select("fp").distinct(), "prints")
    label = print_components(prints)
    return marked, written(prints.join(label, prints.fp == label.node, "left").select("fp", F.coalesce("root", "fp").alias("root")), "rooted")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): fingerprints link at 4 or fewer differing bits; the id is the smallest reachable.

    A null, empty or blank text has fingerprint 0 and is linked like any other. Equal fingerprints are one vertex,
    so copies add no postings. Repeated rows are all returned. A null id is never a component's smallest unless
    all its ids are null. An empty table gives an empty result; other columns are ignored.
    """
    marked, named = _rooted(docs, id_col, text_col)
    smallest = marked.groupBy("fp").agg(F.min("doc_id").alias("first")).join(named, "fp").groupBy("root").agg(F.min("first").alias("component_id"))
    return marked.join(named.join(smallest, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component, all columns kept, whatever they are called.

    A document is an id and the fingerprint of its text: the one of the smallest id stays, of those that share that
    id the one of the smallest fingerprint and text hash, and of the rows that repeat id and text any one.
    So rows of one id with texts unlike each other are documents of their own, null ids among them, and all stay; an
    id that is null is taken last. Only rows that may have to go, or that may repeat one that stays, move.
    An empty table stays empty.
    """
    rows, at, text_at = numbered(docs), f"c{place_of(docs, id_col)}", f"c{place_of(docs, text_col)}"
    marked, named = _rooted(rows, at, text_at)
    key = lambda id_, hash_: F.xxhash64(id_, hash_, F.col(id_).isNull())
    found = marked.join(named, "fp").groupBy("root", "doc_id", "fp", "hash").agg(F.count("*").alias("n"))
    each = written(found.withColumn("_key", key("doc_id", "hash")), "each")  # a row a document
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "fp", "hash", "_key")
    stays = written(each.groupBy("root").agg(F.min(order).alias("k")).select("k._key"), "stays")
    gone = written(each.select("_key").join(stays, "_key", "left_anti"), "gone")
    again = written(each.where("n > 1").select("_key").join(stays, "_key", "left_semi"), "again")
    hashed = rows.withColumn("_hash", F.xxhash64(F.coalesce(F.col(text_at).cast("string"), F.lit(""))))
    left = without(hashed.withColumn("_key", key(at, "_hash")).drop("_hash"), gone, "_key")
    if again.isEmpty():
        return named_again(left, docs.columns)
    once = maybe_among(left, again, "_key").dropDuplicates(["_key"])
    return named_again(maybe_among(left, again, "_key", among=False).unionByName(once), docs.columns)
