"""Shared storage and the helpers that several operators use: cut lineage, filters by hash cells, safe column names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_kept: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where it is unset on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="topicgrove-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _kept.append(path)
    return path


def clean_up(spark: SparkSession) -> None:
    """Delete the stage files that this process has written; results that read them must have been saved before."""
    while _kept:
        path = spark._jvm.org.apache.hadoop.fs.Path(_kept.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again; a lost executor loses none of it."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with its columns called c0, c1 and so on, so that no working name of an operator can meet one of them."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def place_of(df: DataFrame, name: str) -> int:
    """Which column ``name`` is: exactly so called, or else but for case."""
    names = df.columns
    return names.index(name) if name in names else [c.lower() for c in names].index(name.lower())


def named_again(made: DataFrame, names: list[str], **new: Column) -> DataFrame:
    """The columns c0, c1, ... of ``made`` under ``names`` again, and after them ``new``, before which equal names give way."""
    taken = {n.lower() for n in new}
    kept = [F.col(f"c{i}").alias(c) for i, c in enumerate(names) if c.lower() not in taken]
    return made.select(*kept, *[c.alias(n) for n, c in new.items()])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Elements of a list that one fold of ``scanned`` goes through.
PIECE = 512


def scanned(items: Column, first: Column, carry: Callable[[Column], Column], joined: Callable[[Column, Column], Column], step: Callable[[Column, Column], Column], kept: Callable[[Column], Column]) -> Column:
    """What ``kept`` takes from a fold over a list, in pieces, since each step of a fold copies its whole state.

    ``step`` goes on from a state with an item. ``carry`` tells of a piece what ``joined`` adds to the state before
    it, so that every piece starts where the one before it ends; what is kept of the pieces is put in a row.
    """
    cut = lambda all_: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(all_) - 1) / F.lit(PIECE)).cast("int"))), lambda j: F.slice(all_, j * PIECE + 1, F.lit(PIECE)))
    begin = lambda carried, j: F.aggregate(F.slice(carried, F.lit(1), j), first, joined)
    each = lambda pieces, carried: F.flatten(F.transform(pieces, lambda piece, j: F.aggregate(piece, begin(carried, j), step, kept)))
    return let(items, lambda all_: let(cut(all_), lambda pieces: let(F.transform(pieces, carry), lambda carried: each(pieces, carried))))


#: Cells of ``maybe_among`` for each key, and at most: 64 of them stand in one row of 16 bytes, so that the table
#: that is broadcast has 2^20 rows (16 MB) at most, whatever the input.
CELLS_A_KEY, MOST_CELLS = 64, 1 << 26
#: Rows up to which a counted table may be broadcast.
BROADCAST_ROWS = 200_000


def bounded(df: DataFrame) -> DataFrame:
    """``df``, a written table, marked for broadcast if its counted rows are few; else Spark shuffles both sides."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _bit(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int"))


def maybe_among(df: DataFrame, found: DataFrame, *keys: str, among: bool = True) -> DataFrame:
    """Rows of ``df`` whose keys may be in ``found`` (or, with ``among=False``, surely are not), without a shuffle.

    Hash cells, a bit each, stand for ``found``, a written table whose rows are counted: no key of it is missed, one
    other key in CELLS_A_KEY passes. An exact join must follow where that matters. Where half of MOST_CELLS would not
    do for the keys, nothing is filtered: every row may be among them.
    """
    n = found.count()
    if n > MOST_CELLS // 2:
        return df if among else df.where(F.lit(False))
    cells = min(MOST_CELLS, 1 << max(10, (CELLS_A_KEY * n - 1).bit_length()))
    cell = F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(cells))
    marked = found.select(cell.alias("cell")).groupBy(F.shiftright("cell", 6).alias("_word")).agg(F.bit_or(_bit(F.col("cell").bitwiseAND(F.lit(63)))).alias("_bits"))
    # a semi-join with the bit in its condition: no later join is moved below it
    held = (F.shiftright(cell, 6) == F.col("_word")) & (F.col("_bits").bitwiseAND(_bit(cell.bitwiseAND(F.lit(63)))) != 0)
    return df.join(F.broadcast(marked), held, "left_semi" if among else "left_anti")


def without(df: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """``df`` without the rows whose key is in ``found`` (null equals null); only rows that may be among them move.

    ``found`` has the one column ``key`` and is a written table; columns of ``df`` must not begin with ``_``.
    """
    sure = maybe_among(df, found, key, among=False)
    known = found.select(F.col(key).alias("_found")).distinct()
    rest = maybe_among(df, found, key).join(known, F.col(key).eqNullSafe(F.col("_found")), "left_anti")
    return sure.unionByName(rest)
